"""File manifests, stage assets and work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def derive_keys(df: DataFrame, path: str, rules: dict[str, str]) -> DataFrame:
    """Add one key column per rule: the first group of a pattern on the path."""
    return df.select("*", *[F.regexp_extract(path, pattern, 1).alias(name) for name, pattern in rules.items()])


def scan_manifest(spark: SparkSession, root: str, glob: str, rules: dict[str, str]) -> DataFrame:
    """List files below ``root``; only names are read, file contents stay untouched."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "length")
    )
    return derive_keys(files, "path", rules)


def parent_stem_key(path: Column | str) -> Column:
    """``<parent>_<stem>`` for files whose directory names the document."""
    parent = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return F.concat_ws("_", parent, stem)


def write_asset(df: DataFrame, root: str, category: str, stage: str, asset: str) -> str:
    """Replace the splits present in ``df`` below ``<root>/<category>/<stage>/<asset>``."""
    path = "/".join([root.rstrip("/"), category, stage, asset])
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)
    return path


def write_results(df: DataFrame, folder: str) -> None:
    """Detail rows as CSV with a header, column means as CSV without one."""
    from pagemill.operators.aggregates import summarize

    df.write.mode("overwrite").csv(f"{folder}/detail", header=True)
    summarize(df).write.mode("overwrite").csv(f"{folder}/summary", header=False)


def collect_results(out: DataFrame, original: DataFrame, template: DataFrame, truth: DataFrame, key: str = "sample") -> DataFrame:
    """One row per sample with all its parts; the truth may be missing."""
    return out.join(original, key).join(template, key).join(truth, key, "left")


def check_counts(df: DataFrame, expected: DataFrame, by: str = "split") -> DataFrame:
    """Compare row counts with ``expected(by, expected, hard)``.

    Status: ``ok``, ``fail`` (hard rule, or nothing there) or ``warn``.
    """
    found = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    ok = F.when(F.col("expected").isNull(), n > 0).otherwise(n == F.col("expected"))
    status = F.when(ok, "ok").when(F.col("hard") | (n == 0), "fail").otherwise("warn")
    return expected.join(found, by, "left").select(by, "expected", n.alias("n"), status.alias("status"))


def require_counts(df: DataFrame, expected: DataFrame, by: str = "split") -> DataFrame:
    """The hard form: the query fails as soon as one count has status ``fail``."""
    checked = check_counts(df, expected, by)
    message = F.concat(F.lit("wrong row count for "), F.col(by))
    return checked.withColumn("status", F.when(F.col("status") == "fail", F.raise_error(message)).otherwise(F.col("status")))


def pending(inputs: DataFrame, done: DataFrame, key: str = "sample") -> DataFrame:
    return inputs.join(done.select(key), key, "left_anti")


def incomplete(inputs: DataFrame, outputs: DataFrame, sample: str, item: str) -> DataFrame:
    """Samples whose output ids are not exactly their input ids."""
    left = inputs.select(sample, item).distinct().withColumn("_in", F.lit(True))
    right = outputs.select(sample, item).distinct().withColumn("_out", F.lit(True))
    both = left.join(right, [sample, item], "full_outer")
    return both.groupBy(sample).agg(
        F.count_if(F.col("_out").isNull()).alias("missing"),
        F.count_if(F.col("_in").isNull()).alias("extra"),
    ).where("missing + extra > 0")


def mark_errors(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add ``error``: the first check that fails, or NULL. One pass; filter it, or write it by ``error``."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return df.withColumn("error", error)


def limit_samples(df: DataFrame, n: int, key: str = "sample", splits: Sequence[str] | None = None, by: str = "split") -> DataFrame:
    """First ``n`` rows by key in each split; splits not named are kept whole.

    Spark keeps at most ``n`` rows per task and split before the shuffle.
    """
    first = F.row_number().over(Window.partitionBy(by).orderBy(key))
    if splits is None:
        return df.withColumn("_n", first).where(F.col("_n") <= n).drop("_n")
    named = F.col(by).isin(*splits)
    limited = df.where(named).withColumn("_n", first).where(F.col("_n") <= n).drop("_n")
    return limited.unionByName(df.where(~F.coalesce(named, F.lit(False))))


def project_json(df: DataFrame, column: str, paths: dict[str, Sequence[str]]) -> DataFrame:
    """Add one column per name: the first of its JSON paths that has a value."""
    return df.select("*", *[F.coalesce(*[F.get_json_object(column, p) for p in found]).alias(name) for name, found in paths.items()])


def same_word(column: Column, word: str) -> Column:
    """Equal without regard to case and blanks around."""
    return F.lower(F.trim(column)) == word.strip().lower()


def check_contract(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, all rules counted in one pass; NULL breaks a rule."""
    counts = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in rules)
    return counts.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, violations)")


def dedupe_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row by ``order`` for each key, with the number of rows that share the key.

    An aggregate, not a window: copies are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.min(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_best")
    return df.groupBy(*key).agg(best, F.count(F.lit(1)).alias("copies")).select(*key, "_best._row.*", "copies")
