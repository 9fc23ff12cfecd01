"""Logs in order: asset versions, best-so-far, monotone acceptance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.ordered import before, running_max, scan, with_positions
from pagemill.session import staged

FOLD_ROWS = 1024


def assets_as_of(log: DataFrame, asset: str = "asset") -> DataFrame:
    """Version of the asset each step sees, before its own action; NULL if there is none.

    ``create`` sets a version, ``update`` only where the asset exists, ``remove`` clears it. An update
    without an asset lies before the next create, so the last create or update counts.
    """
    life = F.when(F.col("action").isin("create", "remove"), F.col("action"))
    version = F.when(F.col("action").isin("create", "update"), F.col("seq"))
    rows = scan(log, [asset], "seq", {"_life": before(life), "_version": before(version)})
    return rows.withColumn("version", F.when(F.col("_life") == "create", F.col("_version"))).drop("_life", "_version")


def best_so_far(df: DataFrame, by: Sequence[str], pos: str, metric: str, patience: int) -> DataFrame:
    """Mark steps that are strictly better than all before, and steps after the stop.

    ``saved``: new best; a NULL metric is none. ``since``: steps without gain up to here. ``stopped``: an earlier step had
    gone ``patience`` steps without gain.
    """
    by = list(by)
    # the greatest (metric, earliest place) up to a step is the last step that was better than all before it
    place = F.when(F.col(metric).isNotNull(), F.struct(F.col(metric).alias("v"), (-F.col(pos)).alias("back")))
    rows = scan(df, by, pos, {"_top": running_max(place)}, keep_chunk=True)
    rows = rows.withColumn("since", F.col(pos) + F.col("_top.back")).drop("_top")
    rows = rows.withColumn("saved", F.coalesce(F.col("since") == 0, F.lit(False)))
    rows = scan(rows, by, pos, {"_over": before(F.when(F.col("since") >= patience, F.lit(1)))})
    return rows.withColumn("stopped", F.col("_over").isNotNull()).drop("_over")


def monotone_accept(df: DataFrame, by: Sequence[str], low: float, high: float, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Keep a point only if the slope from the last kept point lies in [low, high].

    The rule is sequential, but what it carries is one point. Each chunk of positions is folded
    on its own from an assumed entry point; chunks whose entry turns out different are folded
    again, until no entry changes. Chains meet quickly, so few rounds follow the first.
    """
    by = list(by)
    keys = [*by, "_chunk"]
    rows = df.select(*by, "seq", "x", "y").withColumn("_chunk", F.floor(F.col("seq") / fold_rows))
    point = "struct<seq:bigint,x:double,y:double>"
    item = F.struct(F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    chunks = staged(rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("points")), "chunks")

    def accepts(last: Column, p: Column) -> Column:
        slope = (p["y"] - last["y"]) / F.nullif(p["x"] - last["x"], F.lit(0.0))
        return last.isNull() | ((slope >= low) & (slope <= high))

    def exit_point(entry: Column) -> Column:
        return F.aggregate("points", entry, lambda last, p: F.when(F.coalesce(accepts(last, p), F.lit(False)), p).otherwise(last))

    live = staged(chunks.withColumn("entry", F.lit(None).cast(point)).withColumn("exit", exit_point(F.lit(None).cast(point))), "fold")
    order = Window.partitionBy(*by).orderBy("_chunk")
    while True:
        entries = live.select(*keys, "entry", F.lag("exit").over(order).alias("wanted"))
        changed = staged(entries.where(~F.col("entry").eqNullSafe(F.col("wanted"))).select(*keys, "wanted"), "changed")
        if changed.isEmpty():
            break
        again = live.join(changed.withColumn("_again", F.lit(True)), keys, "left")
        entry = F.when(F.col("_again"), F.col("wanted")).otherwise(F.col("entry"))
        again = again.select(*keys, "points", entry.alias("entry"), F.col("exit").alias("_old"), "_again")
        live = staged(again.select(*keys, "points", "entry", F.when(F.col("_again"), exit_point(F.col("entry"))).otherwise(F.col("_old")).alias("exit")), "fold")
    state = F.struct(F.col("entry").alias("last"), F.array().cast("array<bigint>").alias("kept"))
    folded = F.aggregate(
        "points", state,
        lambda s, p: F.when(F.coalesce(accepts(s["last"], p), F.lit(False)), F.struct(p.alias("last"), F.array_append(s["kept"], p["seq"]).alias("kept"))).otherwise(s),
        lambda s: s["kept"],
    )
    kept = live.select(*by, F.explode(folded).alias("seq"))
    return df.join(kept, [*by, "seq"], "left_semi")


def ordered_steps(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "step") -> DataFrame:
    return with_positions(df, by, order, name)
