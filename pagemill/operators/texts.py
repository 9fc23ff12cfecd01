"""Shared passages, alignment and error rates of texts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.operators.words import gram_windows, substring_grams
from pagemill.session import staged


STEP = 4  # n-grams that share one first look-up


def _probe_side(grams: DataFrame) -> DataFrame:
    """Grams to look up, staged: Spark knows the bytes of a staged table and broadcasts it only below its own limit."""
    return staged(grams, "grams")


def text_overlap_join(
    a: DataFrame, b: DataFrame, n: int, a_id: Sequence[str], b_id: Sequence[str], a_text: str = "a", b_text: str = "b", by: Sequence[str] = (),
) -> DataFrame:
    """Id pairs of texts that share a run of at least ``n`` characters; ``a`` is the smaller side.

    With ``by`` only texts of the same sample meet, which makes short runs useful; samples without a text of ``a`` are left out first.

    Two texts share such a run exactly if they share an n-gram, so this is an equi-join
    on n-grams: every joined row is a true result, none is a mere candidate. Without ``by``, of each ``STEP`` neighbouring n-grams of
    ``b`` only the characters they have in common are looked up first, which leaves out most places at a fraction of the look-ups. Repeats of a pair
    are combined in the tasks before the last shuffle.
    """
    by = list(by)
    known = _probe_side(substring_grams(a, a_text, n, [*by, *a_id]).select(*by, *a_id, "gram").distinct())
    if by:
        b = b.join(known.select(*by).distinct(), by, "left_semi")
        grams = substring_grams(b, b_text, n, [*by, *b_id]).select(*by, *b_id, "gram").distinct()
    elif n >= 2 * STEP:
        cores = _probe_side(substring_grams(a, a_text, n - STEP + 1, []).select(F.col("gram").alias("core")).distinct())
        near = gram_windows(b, b_text, n, STEP, b_id).join(cores, "core", "left_semi")
        places = near.select(*b_id, "window", F.explode(F.sequence(F.lit(0), F.length("window") - n)).alias("_i"))
        grams = places.select(*b_id, F.substr(F.col("window"), F.col("_i") + 1, F.lit(n)).alias("gram"))
    else:
        grams = substring_grams(b, b_text, n, b_id)
    return grams.join(known, [*by, "gram"]).select(*by, *a_id, *b_id).distinct()


def _places(text: str) -> tuple[list[dict[str, int]], list[int], list[int], list[int]]:
    """Suffix automaton of a text: of each state the steps, the longest length, the next shorter state and where its runs first end."""
    steps, size, shorter, ends = [{}], [0], [-1], [-1]

    def state(step: dict[str, int], length: int, link: int, end: int) -> int:
        for column, value in zip((steps, size, shorter, ends), (step, length, link, end), strict=True):
            column.append(value)
        return len(steps) - 1

    whole = 0
    for at, sign in enumerate(text):
        new, p = state({}, size[whole] + 1, 0, at), whole
        while p >= 0 and sign not in steps[p]:
            steps[p][sign] = new
            p = shorter[p]
        if p >= 0:
            q = steps[p][sign]
            if size[q] > size[p] + 1:  # the shorter runs of q now end in one more place than its longer ones
                part = state(dict(steps[q]), size[p] + 1, shorter[q], ends[q])
                while p >= 0 and steps[p].get(sign) == q:
                    steps[p][sign] = part
                    p = shorter[p]
                shorter[q] = part
                q = part
            shorter[new] = q
        whole = new
    return steps, size, shorter, ends


def _longest_in(places: tuple[list[dict[str, int]], list[int], list[int], list[int]], text: str) -> tuple[int, int, int]:
    """``(i, j, length)`` of the longest run that ``text`` shares with the text of ``places``, at its first places."""
    steps, size, shorter, ends = places
    state = length = 0
    best = (0, 0, 0)
    for at, sign in enumerate(text):
        while state and sign not in steps[state]:
            state = shorter[state]
            length = size[state]
        if sign in steps[state]:
            state, length = steps[state][sign], length + 1
            best = min(best, (-length, ends[state] - length + 1, at - length + 1))
    return best[1], best[2], -best[0]


@F.pandas_udf(StructType().add("i", "integer").add("j", "integer").add("length", "long"))
def _longest_run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    found: list[tuple[int, int, int]] = [(0, 0, 0)] * len(a)
    for text, rows in pd.Series(range(len(a))).groupby(a.to_numpy(), sort=False):
        places = _places(text)
        for k in rows:
            found[k] = _longest_in(places, b.iloc[k])
    return pd.DataFrame(found, columns=["i", "j", "length"])


def lcs_align(a: DataFrame, b: DataFrame, n: int, a_id: Sequence[str], b_id: Sequence[str], a_text: str = "a", b_text: str = "b") -> DataFrame:
    """Longest common run of each pair, at least ``n`` long: ``(i, j, length)`` of its start.

    Pairs that share an n-gram are found by an equi-join. Each of them is one row, whose texts are walked through once (the automaton of a
    text of ``a`` serves all its pairs in a batch), so repeated n-grams add no rows. Ties go to the earlier place in ``a``, then in
    ``b``. Pairs whose runs are all shorter, null and empty texts give no row; of rows that repeat an id the best counts.
    """
    pair = [*a_id, *b_id]
    pairs = text_overlap_join(a, b, n, a_id, b_id, a_text, b_text)
    texts = pairs.join(a.select(*a_id, F.col(a_text).alias("_a")).where("_a IS NOT NULL"), [*a_id]).join(b.select(*b_id, F.col(b_text).alias("_b")).where("_b IS NOT NULL"), [*b_id])
    runs = texts.select(*pair, _longest_run("_a", "_b").alias("_r"))
    best = runs.groupBy(*pair).agg(F.min(F.struct((-F.col("_r.length")).alias("n"), F.col("_r.i").alias("i"), F.col("_r.j").alias("j"))).alias("_b"))
    return best.select(*pair, "_b.i", "_b.j", (-F.col("_b.n")).alias("length"))


FIRST_BAND, LAST_BAND = 32, 2048


def edit_distance(a: str, b: str) -> Column:
    """Edit distance; the work is that of a band as wide as the distance, not the product of the lengths.

    A band of 32 is tried first, then bands eight times as wide, each only where the one before was too narrow. Past the widest band, and for
    texts that are short anyway, the whole table is filled in. All ways give the exact distance; it is null if a text is.
    """
    bands, width = [], FIRST_BAND
    while width <= LAST_BAND:
        fits = F.greatest(F.length(a), F.length(b)) > 2 * width  # a wider band would be the whole table
        bands.append(F.when(fits, F.nullif(F.levenshtein(a, b, width), F.lit(-1))))
        width *= 8
    return F.coalesce(*bands, F.levenshtein(a, b))


def text_errors(df: DataFrame, truth: str, found: str, ids: Sequence[str] = ()) -> DataFrame:
    """Edit distance, and character error rate against the truth (NULL for an empty truth).

    A distance costs the length times the distance, so few rows can be much work: with ``ids`` they are dealt out first.
    """
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *ids) if ids else df
    return df.withColumn("distance", edit_distance(truth, found)).withColumn("cer", F.try_divide(F.col("distance").cast("double"), F.length(truth).cast("double")))


def mncer(truth: DataFrame, pairs: DataFrame, by: Sequence[str], word: Sequence[str]) -> DataFrame:
    """Mean over truth words of distance / longer length; a word without partner counts 1.

    ``pairs`` holds ``(by, word, truth_text, found_text)``.
    """
    found = pairs.select(*by, *word, "truth_text", "found_text")
    return paired_mncer(truth.select(*by, *word).join(found, [*by, *word], "left"), by)


def paired_mncer(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same of truth words that carry the text of their partner: rows ``(by, truth_text, found_text)``."""
    longer = F.greatest(F.length("truth_text"), F.length("found_text"))
    scored = rows.select(*by, F.try_divide(edit_distance("truth_text", "found_text").cast("double"), longer.cast("double")).alias("_e"))
    return scored.groupBy(*by).agg(F.avg(F.coalesce("_e", F.lit(1.0))).alias("mncer"), F.count("_e").alias("matched"), F.count(F.lit(1)).alias("words"))
