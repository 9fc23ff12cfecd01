"""Grouped measures. All of them merge partial results before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint")


def summarize(df: DataFrame) -> DataFrame:
    """Mean of every numeric column, as rows ``(metric, mean)``."""
    names = [n for n, t in df.dtypes if t in NUMBERS]
    means = df.agg(*[F.avg(n).alias(n) for n in names])
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return means.selectExpr(f"stack({len(names)}, {pairs}) AS (metric, mean)")


def channel_stats(df: DataFrame, channel: str, value: str) -> DataFrame:
    """Mean, population standard deviation and count per channel."""
    return df.groupBy(channel).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def score_by_type(df: DataFrame, kind: str, score: str) -> DataFrame:
    """Mean score per type and over all rows (type NULL)."""
    means = df.rollup(kind).agg(F.avg(score).alias("mean"), F.count(F.lit(1)).alias("n"), F.grouping(kind).alias("overall"))
    return means.select(kind, "mean", "n", (F.col("overall") == 1).alias("overall"))


def having_min(a: DataFrame, b: DataFrame, by: str, item: str, n: int) -> DataFrame:
    """Groups with at least ``n`` different items on both sides."""
    enough = lambda df: df.groupBy(by).agg(F.countDistinct(item).alias("_n")).where(F.col("_n") >= n).select(by)
    return enough(a).join(enough(b), by)


def class_counts(df: DataFrame, classes: int, ignore: int = 255) -> DataFrame:
    """Mergeable counts per class: predicted, true and hit. Ignored labels count nowhere."""
    kept = df.where(F.col("gt") != ignore)
    sides = F.array(
        F.struct(F.col("pred").alias("class"), F.lit(1).alias("p"), F.lit(0).alias("t"), (F.col("pred") == F.col("gt")).cast("int").alias("tp")),
        F.struct(F.col("gt").alias("class"), F.lit(0).alias("p"), F.lit(1).alias("t"), F.lit(0).alias("tp")),
    )
    rows = kept.select(F.inline(sides)).where(F.col("class").between(0, classes - 1))
    return rows.groupBy("class").agg(F.sum("p").alias("p"), F.sum("t").alias("t"), F.sum("tp").alias("tp"))


def class_scores(counts: DataFrame) -> DataFrame:
    """IoU in percent, and the shares of false positives and negatives, per class."""
    union = F.col("t") + F.col("p") - F.col("tp") + 1e-10
    return counts.select(
        "class", (F.col("tp") / union * 100).alias("iou"),
        ((F.col("p") - F.col("tp")) / union).alias("fp_ratio"), ((F.col("t") - F.col("tp")) / union).alias("fn_ratio"),
    )


def class_iou(df: DataFrame, classes: int, ignore: int = 255) -> DataFrame:
    """Scores of every class, then their means over all and over the foreground classes (class -1, -2)."""
    spark = df.sparkSession
    counts = spark.range(classes).select(F.col("id").cast("int").alias("class")).join(class_counts(df, classes, ignore), "class", "left").na.fill(0)
    scores = class_scores(counts)
    means = lambda rows, c: rows.agg(F.lit(c).alias("class"), *[F.avg(n).alias(n) for n in ("iou", "fp_ratio", "fn_ratio")])
    return scores.unionByName(means(scores, -1)).unionByName(means(scores.where("class > 0"), -2))


def stability(df: DataFrame, by: Sequence[str], value: str, threshold: float, offset: float) -> DataFrame:
    """Cells above the high threshold over cells above the low one."""
    high, low = F.count_if(F.col(value) > threshold + offset), F.count_if(F.col(value) > threshold - offset)
    return df.groupBy(*by).agg(F.try_divide(high, low).alias("stability"))


def interval_means(df: DataFrame, by: Sequence[str], step: str, every: int, values: Sequence[str]) -> DataFrame:
    """Means over blocks of ``every`` steps, as a meter that is read and cleared."""
    block = F.floor(F.col(step) / every).alias("block")
    return df.groupBy(*by, block).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n"))


def coco_records(images: DataFrame, annotations: DataFrame, order: Sequence[str]) -> dict[str, DataFrame]:
    """The record set ``images``, ``annotations``, ``categories``, one row per record, with running ids.

    ``annotations`` has ``(image, category, bbox, area)``. Ids run over the whole set in order.
    """
    from pagemill.operators.ordered import running_sum, scan, with_positions

    kept = annotations.where("category IS NOT NULL")
    categories = with_positions(kept.select("category").distinct(), [], ["category"], "category_id")
    # an annotation's id is the number of annotations of earlier images and its place in its own, so only images are sorted as a whole
    counts = kept.groupBy("image").agg(F.count(F.lit(1)).alias("_n"))
    known = images.join(counts, "image", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    starts = scan(with_positions(known, [], ["image"], "image_id"), [], "image_id", {"_start": running_sum(F.col("_n"), inclusive=False)})
    image_ids = starts.select("image", "image_id")
    placed = with_positions(kept, ["image"], list(order), "_place")
    rows = placed.join(categories, "category").join(starts.drop("_n"), "image").withColumn("id", F.col("_start") + F.col("_place"))
    return {
        "images": image_ids,
        "annotations": rows.select("id", "image", "image_id", "category_id", "bbox", "area", F.lit(0).alias("iscrowd")),
        "categories": categories.select(F.col("category_id").alias("id"), F.col("category").alias("name")),
    }


def write_coco(records: dict[str, DataFrame], folder: str) -> None:
    """One folder of JSON lines per record kind."""
    for kind, rows in records.items():
        rows.write.mode("overwrite").json(f"{folder}/{kind}")
