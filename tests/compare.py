"""Run a registered query and its check SQL on the same tables and compare."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

TYPES = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "FLOAT": "float", "DATE": "date",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(norm(r[k]) for k in order) for r in rows)


def compare(spark, con, name, build, sql, folder):
    """Problem text, or None when both results are the same rows."""
    df = build(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sorted(kinds) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(kinds)}"
    wrong = [f"{c}: {t} != {kinds[c]}" for c, t in df.dtypes if TYPES.get(kinds[c], kinds[c]) != t]
    if got != want:
        more, less = got - want, want - got
        return f"rows {sum(got.values())} != {sum(want.values())} or values; spark only {list(more)[:4]} sql only {list(less)[:4]} ({sum(more.values())}/{sum(less.values())})" + str(wrong)
    if not got:
        return "both empty"
    return f"types {wrong}" if wrong else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pagemill.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    if os.environ.get("PLAIN_SESSION"):  # the settings of a stranger: only cores and partitions
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate()
    else:
        spark = local_session(8)
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    picked = [n for n in queries if not sys.argv[1:] or any(n.startswith(p) for p in sys.argv[1:])]
    bad = 0
    for name in picked:
        t0 = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - t0:.1f}s {'' if name in oracles else '(rows only)'} {problem or ''}", flush=True)
    print(f"{len(picked)} queries, {bad} bad")
