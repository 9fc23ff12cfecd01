"""Nested line documents and flat key archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_DOC = (
    "image_path string, lines array<struct<line_no:bigint,type:string,id:string,line:string,width:double,text:string,"
    "words:array<struct<text:string,poly:string>>>>"
)


def wkt_points(wkt: Column | str) -> Column:
    """Points of a ``LINESTRING`` or the outer ring of a ``POLYGON``; other text gives NULL."""
    body = F.regexp_extract(wkt, r"^\s*(?:LINESTRING|POLYGON)\s*\(+\s*([^()]*?)\s*\)", 1)
    points = F.transform(
        F.split(body, r"\s*,\s*"),
        lambda p: F.struct(
            F.split(p, r"\s+")[0].try_cast("double").alias("x"),
            F.split(p, r"\s+")[1].try_cast("double").alias("y"),
        ),
    )
    return F.when(F.length(body) > 0, points)


def points_wkt(points: Column | str) -> Column:
    points = F.col(points) if isinstance(points, str) else points
    text = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"], p["y"])), ", ")
    return F.when(points.isNotNull(), F.concat(F.lit("LINESTRING ("), text, F.lit(")")))


def scan_line_docs(df: DataFrame, column: str) -> DataFrame:
    """One row per line of each JSON document; a document without lines keeps one NULL row.

    ``line_pos`` is the number written with the line, so it does not matter in how many parts a document came;
    documents of other writers have no such number and their lines count from 0.
    """
    parsed = df.withColumn("_doc", F.from_json(column, LINE_DOC))
    rows = parsed.select(
        *[c for c in df.columns if c != column], F.col("_doc.image_path").alias("image_path"),
        F.posexplode_outer("_doc.lines").alias("_at", "_line"),
    )
    return rows.select(
        *[c for c in rows.columns if c not in ("_at", "_line")], F.coalesce("_line.line_no", "_at").alias("line_pos"),
        "_line.type", "_line.id", wkt_points("_line.line").alias("line"), "_line.width", "_line.text",
        F.transform("_line.words", lambda w: F.struct(w["text"].alias("text"), wkt_points(w["poly"]).alias("poly"))).alias("words"),
    )


LINES_PER_DOCUMENT = 10000


def nest_lines(lines: DataFrame, key: str, order: str, lines_per_document: int = LINES_PER_DOCUMENT) -> DataFrame:
    """JSON documents ``(key, part, doc)``. ``order`` numbers the lines from 0, and the number is written with the line.

    A part holds the lines of a fixed range of numbers, so no group grows without bound. What ``scan_line_docs`` reads
    back is the same for every limit.
    """
    line = F.struct(F.col(order).cast("long").alias("line_no"), F.col("type"), F.col("id"), points_wkt("line").alias("line"), F.col("width"), F.col("text"))
    part = F.floor(F.col(order) / lines_per_document).cast("int").alias("part")
    nested = lines.groupBy(key, part, "image_path").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return nested.select(key, "part", F.to_json(F.struct("image_path", "lines")).alias("doc"))


def export_line_docs(lines: DataFrame, key: str, order: str, variant: str) -> DataFrame:
    """Line documents from the ``<field>_<variant>`` columns where they hold a value.

    Lines without geometry are left out. A width of 0 counts as missing.
    """

    def pick(name: str) -> Column:
        preferred = f"{name}_{variant}"
        options = [F.col(c) for c in (preferred, name) if c in lines.columns]
        if name == "width":
            options = [F.nullif(c, F.lit(0.0)) for c in options]
        return F.coalesce(*options).alias(name)

    fields = ["line", "width", "text"]
    chosen = lines.select(key, order, "image_path", "type", "id", *[pick(f) for f in fields])
    return nest_lines(chosen.where("line IS NOT NULL"), key, order)


def unflatten_kv(df: DataFrame, fields: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    """Rows ``<id>.<field>`` to one row per id; the id ends at the first dot."""
    name = F.substring_index(key, ".", 1)
    field = F.expr(f"substring({key}, length(substring_index({key}, '.', 1)) + 2)")
    return df.select(name.alias("id"), field.alias("_field"), value).groupBy("id").pivot("_field", list(fields)).agg(F.first(value))


def flatten_kv(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per (id, field) with a dotted key; missing values give no row."""
    long = df.unpivot(["id"], list(fields), "_field", "value").where("value IS NOT NULL")
    return long.select(F.concat_ws(".", "id", "_field").alias("key"), "value")
