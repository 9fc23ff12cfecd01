"""Operator 6: shards along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to a cell number (strings by their rank among the distinct values, sizes by logarithm). The Hilbert
index of the cells orders the rows, and the order is cut into runs of equal row counts (law ``rows``). A shard then covers
a compact region in all dimensions, so min/max statistics let readers skip most files.

Positions come from a range shuffle: a row's place is its place in its range plus the rows of the ranges before it, so no task
sees more than a range. Texts are read once for size and checksum; only metadata moves.

Cases: null values are a cell of their own (the first); a null text has size 1 and checksum 0; repeated rows are rows of their own
with places side by side; fewer rows than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import parts, set_up, unpacked, whole
from pagemill.session import staged

BITS = 8
SMALL_TABLE = 10_000  # rows; distinct values beyond are joined by a shuffle


def hilbert_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Place of a cell on the Hilbert curve; each coordinate has ``bits`` bits, high bits first.

    On every level the corner of the cube that holds the cell is turned into the frame of the current sub-cube (entry corner
    ``e``, direction ``d``), its Gray code rank is the next digit, and the frame moves on. Corner tables follow from the rule.
    """
    n = len(cells)
    corners = range(1 << n)

    def turn(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)

    gray = [w ^ (w >> 1) for w in corners]
    rank = [gray.index(t) for t in corners]
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in corners]
    ones = lambda w: (~w & (w + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    ahead = [0 if w == 0 else ones(w if w % 2 else w - 1) % n for w in corners]
    digit_of = F.array(*[F.lit(rank[turn(c, n - (d + 1) % n)]) for c in corners for d in range(n)])
    enter = F.array(*[F.lit(turn(entry[w], d + 1)) for w in corners for d in range(n)])
    move = F.array(*[F.lit((d + ahead[w] + 1) % n) for w in corners for d in range(n)])
    at = lambda t, i, d: F.element_at(t, (i * n + d + 1).cast("int"))
    point = F.array(*[c.cast("long") for c in cells])
    levels = F.transform(
        F.sequence(F.lit(bits - 1), F.lit(0)),
        lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda c, j: c + F.call_function("shiftleft", F.call_function("getbit", F.element_at(point, j + 1), i).cast("long"), j)),
    )

    def step(s: Column, corner: Column) -> Column:
        w = at(digit_of, corner.bitwiseXOR(s["e"]), s["d"])
        return F.struct((s["h"] * (1 << n) + w).alias("h"), s["e"].bitwiseXOR(at(enter, w, s["d"]).cast("long")).alias("e"), at(move, w, s["d"]).alias("d"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("e"), F.lit(0).alias("d"))
    return F.aggregate(levels, start, step, lambda s: s["h"])


def ranked(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """Add ``_cell_<column>``: the value's rank among the distinct values, scaled to ``bits`` bits; null first."""
    values = rows.select(F.col(column).alias("_value")).where("_value IS NOT NULL").distinct()
    order = Window.orderBy("_value")  # one row per distinct value
    values = staged(values.withColumn("_no", F.row_number().over(order)), "values")
    n = values.count()
    cell = F.ceil(F.col("_no") * ((1 << bits) - 1) / F.lit(n))  # the whole range, or the curve would cut other dimensions first
    values = values.select("_value", cell.cast("int").alias(f"_cell_{column}"))
    joined = rows.join(F.broadcast(values) if n <= SMALL_TABLE else values, F.col(column) == F.col("_value"), "left").drop("_value")
    return joined.withColumn(f"_cell_{column}", F.coalesce(f"_cell_{column}", F.lit(0)))


def log_cell(size: Column, bits: int = BITS) -> Column:
    """Sizes by logarithm, eight cells per doubling."""
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 8)).cast("int")


def placed(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Add ``_place``, the 0-based place in the order of the columns ``order``, and tell the number of rows."""
    keys = [F.col(c) for c in order]
    numbered = staged(rows.repartitionByRange(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    # a number made by this function is a partition and a place in it; there is one row per partition
    part = F.shiftrightunsigned("_id", 33)
    sums = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = staged(sums.select("_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "range_sizes")
    n = sums.agg(F.sum("_n")).first()[0] or 0
    place = F.col("_before") + F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return numbered.withColumn("_part", part).join(F.broadcast(sums), "_part").withColumn("_place", place).drop("_part", "_n", "_before", "_id"), n


def _cut(rows: DataFrame, n: int, shards: int) -> DataFrame:
    """``shard`` and ``slot`` from the place: run s starts at ceil(s * n / shards), so counts are at most one apart."""
    shard = F.expr(f"_place * {shards} div {max(n, 1)}")
    start = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return rows.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_place") - start).cast("long"))


def _measured(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [(F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).cast("long").alias("_crc")]


def _indexed(rows: DataFrame, bits: int) -> DataFrame:
    rows = ranked(ranked(rows, "_source", bits), "_lang", bits)
    return rows.withColumn("_h", hilbert_index([F.col("_cell__source"), F.col("_cell__lang"), log_cell(F.col("_size"), bits)], bits)).drop("_cell__source", "_cell__lang")


def curve_shards(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """Per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    set_up(docs.sparkSession)
    meta = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang")]
    rows = staged(docs.select(*meta, *_measured(docs)).withColumn("_row", F.monotonically_increasing_id()), "metadata")
    ordered, n = placed(_indexed(rows, bits), ["_h", "doc_id", "_crc", "_size", "_row"])
    return _cut(ordered, n, shards).select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def sharded_documents(docs: DataFrame, shards: int = 16, bits: int = BITS) -> DataFrame:
    """All columns of ``docs`` with ``shard, slot``, laid out in curve order. Here the texts move, once."""
    set_up(docs.sparkSession)
    meta = [F.col("doc_id").cast("long").alias("_doc"), F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang")]
    rows = docs.select(whole(docs), *meta, *_measured(docs))
    ordered, n = placed(_indexed(rows, bits), ["_h", "_doc", "_crc", "_size"])
    kept = docs.drop("shard", "slot")
    return _cut(ordered, n, shards).select(*unpacked(kept), "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """One Parquet folder per shard, rows in curve order."""
    sharded_documents(docs, shards).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
