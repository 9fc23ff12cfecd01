"""Document-shaped views over the test tables, as DataFrames and as SQL.

Both forms of a view have the same meaning. The DataFrame form feeds the
operators, the SQL form feeds the check queries.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.ordered import with_positions
from pagemill.operators.words import line_words, with_cuts
from pagemill.session import SPREAD, prepare
from pagemill.sources.manifest import derive_keys

GRID = 8


class Tables:
    """The given tables by name, plus the views built from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        """The texts. A session for one machine may ask to deal them out, as its tables are single files (``SPREAD``)."""
        rows, spread = self.read("documents"), int(self.spark.conf.get(SPREAD, "0"))
        return rows.repartition(spread) if spread else rows

    benchmark = property(lambda self: self.read("benchmark"))
    labels = property(lambda self: self.read("labels"))
    pages = property(lambda self: self.read("pages"))
    embeddings = property(lambda self: self.read("embeddings"))
    events = property(lambda self: self.read("events"))
    lineitem = property(lambda self: self.read("lineitem"))
    part = property(lambda self: self.read("part"))
    customer = property(lambda self: self.read("customer"))

    @cached_property
    def manifest(self) -> DataFrame:
        keyed = derive_keys(
            self.pages,
            "url",
            {
                "host": r"^https?://([^/]+)",
                "lang": r"^https?://[^/]+/([a-z]+)/",
                "key": r"/([^/?#]+)([?#].*)?$",
            },
        )
        split = F.when(F.col("page_id") % 10 == 0, "test").when(F.col("page_id") % 10 == 1, "val").otherwise("train")
        return keyed.select(F.col("page_id").alias("sample"), "host", "lang", "key", split.alias("split"))

    @cached_property
    def textlines(self) -> DataFrame:
        return self.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))

    @cached_property
    def words(self) -> DataFrame:
        return line_words(self.textlines, ["doc_id", "line_no"]).select(
            "doc_id", "line_no", "word_no", "text",
            (F.col("start") * 6.0).alias("left"),
            (F.col("line_no") * 20.0).alias("top"),
            (F.length("text") * 6.0).alias("width"),
            F.lit(10.0).alias("height"),
        )

    @cached_property
    def word_lines(self) -> DataFrame:
        """The boxes and texts of the words as arrays of their line."""
        times = lambda c, factor: F.transform(c, lambda v: v * factor)
        each = lambda value: F.array_repeat(value, F.size("word_no"))
        return with_cuts(self.textlines).select(
            "doc_id", "line_no", "word_no",
            times("start", 6.0).alias("left"), each(F.col("line_no") * 20.0).alias("top"),
            times("length", 6.0).alias("width"), each(F.lit(10.0)).alias("height"), F.array_remove(F.split("text", " "), "").alias("text"),
        )

    @cached_property
    def line_rows(self) -> DataFrame:
        """One row per text line with its mid line as points; no words, no line."""
        y = F.col("line_no") * 20.0 + 5.0
        # the leading blanks of a line shift its left end, trailing ones do not count
        first = F.length("text") - F.length(F.ltrim("text"))
        last = F.length(F.rtrim("text"))
        points = F.array(
            F.struct((first * 6.0).alias("x"), y.alias("y")),
            F.struct((last * 6.0).alias("x"), y.alias("y")),
        )
        has_words = F.length(F.trim("text")) > 0
        return self.textlines.select(
            "doc_id", "line_no",
            F.lit("text_line").alias("type"),
            F.concat_ws("-", "doc_id", "line_no").alias("id"),
            F.when(has_words, points).alias("line"),
            F.when(has_words, F.lit(10.0)).alias("width"),
            "text",
        )

    @cached_property
    def linedoc(self) -> DataFrame:
        from pagemill.sources.linedocs import nest_lines

        return nest_lines(self.line_rows.withColumn("image_path", F.concat(F.lit("doc/"), "doc_id")), "doc_id", "line_no")

    @cached_property
    def series(self) -> DataFrame:
        return self.embeddings.select("vec_id", F.posexplode(F.expr("transform(embedding, v -> double(v))")).alias("pos", "value"))

    @cached_property
    def grid(self) -> DataFrame:
        return self.series.select(
            F.col("vec_id").alias("sample"),
            F.floor(F.col("pos") / GRID).cast("int").alias("y"),
            (F.col("pos") % GRID).alias("x"),
            "value",
        )

    @cached_property
    def holed_grid(self) -> DataFrame:
        hole = (F.col("sample") + F.col("y") * GRID + F.col("x")) % 7 == 0
        return self.grid.withColumn("value", F.when(~hole, F.col("value")))

    @cached_property
    def poly(self) -> DataFrame:
        rows = self.events.select(
            F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("line_id"),
            "ts", "event_id",
            (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 3.6e9).alias("x"),
            F.col("value").alias("y"),
            F.when(F.col("user_id") % 2 == 0, "text_line").otherwise("visual_line").alias("type"),
        )
        return with_positions(rows, ["line_id"], ["ts", "event_id"], "seq").select(
            "line_id", F.col("seq").cast("int").alias("seq"), "x", "y", "type"
        )

    @cached_property
    def boxes(self) -> DataFrame:
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
                 "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
        rows = with_positions(self.lineitem.select("l_orderkey", *order), ["l_orderkey"], order, "box_id")
        x0, y0 = F.col("l_quantity"), F.col("l_tax") * 100.0
        return rows.select(
            F.col("l_orderkey").alias("sample"), F.col("box_id").cast("int").alias("box_id"),
            x0.alias("x0"), y0.alias("y0"), (x0 + 10.0).alias("x1"), (y0 + 10.0).alias("y1"),
            F.col("l_discount").alias("score"), F.col("l_returnflag").alias("category"),
        )

    @cached_property
    def blocks(self) -> DataFrame:
        """Vectors by side of a match block; a block holds 20 vectors by construction."""
        return self.embeddings.select(
            F.floor(F.col("vec_id") / 20).cast("int").alias("block"), "vec_id", "label",
            F.expr("transform(embedding, v -> double(v))").alias("vec"),
        )

    @cached_property
    def sim(self) -> DataFrame:
        from pagemill.operators.matching import scaled_dot

        side = F.col("vec_id") % 2
        a = self.blocks.where(side == 0).select("block", F.col("vec_id").alias("i"), F.col("vec").alias("a"))
        b = self.blocks.where(side == 1).select("block", F.col("vec_id").alias("j"), F.col("vec").alias("b"))
        return a.join(b, "block").select("block", "i", "j", scaled_dot("a", "b").alias("sim"))

    @cached_property
    def truth(self) -> DataFrame:
        even = self.blocks.where("vec_id % 2 = 0").select("block", F.col("vec_id").alias("i"), "label")
        odd = self.blocks.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("i"), F.col("label").alias("other"))
        gt = F.when(F.col("label") == F.col("other"), F.col("i") + 1).otherwise(F.lit(-1))
        return even.join(odd, "i", "left").select("block", "i", gt.cast("long").alias("gt"))

    @cached_property
    def classes(self) -> DataFrame:
        return self.documents.join(self.labels, "doc_id", "left").select(
            "doc_id",
            (F.col("n_chars") > 1000).cast("int").alias("pred"),
            F.coalesce("quality", F.lit(255)).alias("gt"),
        )

    @cached_property
    def asset_log(self) -> DataFrame:
        action = F.when(F.col("event_type").isin("signup", "purchase"), "create").when(F.col("event_type") == "error", "remove").otherwise("update")
        rows = self.events.select(F.col("user_id").alias("asset"), "ts", "event_id", action.alias("action"))
        return with_positions(rows, ["asset"], ["ts", "event_id"], "seq").select("asset", "seq", "action")


VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "v_manifest": ((), r"""
        SELECT page_id AS sample, regexp_extract(url, '^https?://([^/]+)', 1) AS host,
          regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang,
          regexp_extract(url, '/([^/?#]+)([?#].*)?$', 1) AS key,
          CASE WHEN page_id % 10 = 0 THEN 'test' WHEN page_id % 10 = 1 THEN 'val' ELSE 'train' END AS split
        FROM pages"""),
    "v_textlines": ((), """
        SELECT doc_id, CAST(i AS INT) AS line_no, parts[i + 1] AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, unnest(range(len(parts))) u(i)"""),
    "v_words": (("v_textlines",), """
        SELECT doc_id, line_no, CAST(word_no AS INT) AS word_no, text, 6.0::DOUBLE * o AS "left",
          20.0::DOUBLE * line_no AS top, 6.0::DOUBLE * length(text) AS width, 10.0::DOUBLE AS height
        FROM (SELECT doc_id, line_no, word_no, text,
            coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
          FROM (SELECT doc_id, line_no, i AS word_no, parts[i + 1] AS text
            FROM (SELECT doc_id, line_no, string_split(text, ' ') AS parts FROM v_textlines) p, unnest(range(len(parts))) u(i)) q) r
        WHERE length(text) > 0"""),
    "v_lines": (("v_textlines", "v_words"), """
        SELECT t.doc_id, t.line_no, t.text, b.x0, b.x1, CASE WHEN b.x0 IS NOT NULL THEN 20.0::DOUBLE * t.line_no + 5 END AS y
        FROM v_textlines t LEFT JOIN (SELECT doc_id, line_no, min("left") AS x0, max("left" + width) AS x1
          FROM v_words GROUP BY ALL) b ON t.doc_id = b.doc_id AND t.line_no = b.line_no"""),
    "v_series": ((), """
        SELECT vec_id, CAST(i AS INT) AS pos, CAST(embedding[i + 1] AS DOUBLE) AS value
        FROM embeddings, unnest(range(len(embedding))) u(i)"""),
    "v_grid": (("v_series",), "SELECT vec_id AS sample, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, value FROM v_series"),
    "v_holed": (("v_grid",), "SELECT sample, y, x, CASE WHEN (sample + 8 * y + x) % 7 <> 0 THEN value END AS value FROM v_grid"),
    "v_poly": ((), """
        SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS line_id,
          CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS INT) AS seq,
          (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3.6e9 AS x, value AS y,
          CASE WHEN user_id % 2 = 0 THEN 'text_line' ELSE 'visual_line' END AS type
        FROM events"""),
    "v_boxes": ((), """
        SELECT l_orderkey AS sample, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
            l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS INT) AS box_id,
          l_quantity AS x0, l_tax * 100.0::DOUBLE AS y0, l_quantity + 10.0::DOUBLE AS x1, l_tax * 100.0::DOUBLE + 10.0::DOUBLE AS y1,
          l_discount AS score, l_returnflag AS category
        FROM lineitem"""),
    "v_sim": ((), """
        SELECT CAST(a.vec_id // 20 AS INT) AS block, a.vec_id AS i, b.vec_id AS j,
          list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / 8 AS sim
        FROM embeddings a JOIN embeddings b ON a.vec_id // 20 = b.vec_id // 20 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1"""),
    "v_truth": ((), """
        SELECT CAST(a.vec_id // 20 AS INT) AS block, a.vec_id AS i, CASE WHEN a.label = b.label THEN a.vec_id + 1 ELSE -1 END AS gt
        FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0"""),
    "v_class": ((), """
        SELECT d.doc_id, CAST(n_chars > 1000 AS INT) AS pred, coalesce(quality, 255) AS gt
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
    "v_asset": ((), """
        SELECT user_id AS asset, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
          CASE WHEN event_type IN ('signup', 'purchase') THEN 'create' WHEN event_type = 'error' THEN 'remove' ELSE 'update' END AS action
        FROM events"""),
}


def with_views(views: str, tail: str) -> str:
    """``tail`` with the named views (and what they need) as leading CTEs.

    ``tail`` is a SELECT, or more CTEs followed by a SELECT.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEW_SQL[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in views.split():
        add(name)
    ctes = ", ".join(f"{n} AS ({VIEW_SQL[n][1]})" for n in ordered)
    tail = tail.strip()
    if not ctes:
        return tail if tail.upper().startswith("SELECT") else f"WITH RECURSIVE {tail}"
    return f"WITH RECURSIVE {ctes}{' ' if tail.upper().startswith('SELECT') else ', '}{tail}"
