"""Operator 10: benchmark passages found through a positional inverted index.

1. Frequencies: how often each benchmark term stands in the training texts (one combined count).
2. Rarest terms: every window of an item is looked up from its rarest term, and every segment (the item cut into runs of a window's length)
   from as many of its rarest terms that a near copy must hold one of them. A term that no text holds rules its windows out.
3. Postings: for these terms, every place in the training texts is stored as (term, document, position, the terms around it).
   A list of a rare term is short; those of common terms, which make up most of the text, are never needed.
4. Exact matches: each posting is shifted by every offset at which some window holds its term, and the terms that then stand around it are
   joined with the windows as a whole, so a joined row is a match however common the term or however many windows share it.
5. Near matches: a stretch of as many words as a window has, in which a share of a segment's distinct terms stand, in any order.

The texts are gone through twice, whatever the items' size. Benchmark terms are broadcast up to ``BROADCAST_BYTES``, which is checked; beyond it
words are counted before they meet the vocabulary, and bare places are joined by term and get their surroundings by document.
All steps are DataFrame functions.

Cases: null texts have no words; an item shorter than a window is one window, an item without words none; equal items share windows
but are listed each; repeated rows stay repeated; an empty table on either side gives zeros or no rows; other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import set_up, unpacked, whole
from pagemill.session import staged

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # fixed value: what stands between words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
BROADCAST_BYTES = 32 << 20  # of distinct terms, each taken with 64 bytes on top
NEAR = 0.8  # share of a segment's distinct terms in a near match
KEY = ["_doc", "_hash", "_size"]


def terms(text: Column) -> Column:
    """Words after lower-casing A-Z. The array may begin or end with an empty string, which no item term equals."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), SEPARATORS)


def _n_terms(t: Column) -> Column:
    first, last = F.element_at(t, 1) == "", (F.size(t) > 1) & (F.element_at(t, -1) == "")
    return F.coalesce(F.size(t) - first.cast("int") - last.cast("int"), F.lit(0)).cast("long")


def _texts(docs: DataFrame) -> DataFrame:
    """Rows with the same key have the same text, so they share all results."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("_id"), *_key(docs), text.alias("_text"))


def _key(docs: DataFrame) -> list[Column]:
    """The key of a row, never null."""
    text = F.col("text").cast("string")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return [doc.alias("_doc"), F.xxhash64(text).alias("_hash"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("_size")]


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``item, window`` for every window of every item (``item`` as string, ``window`` an array of terms)."""
    t = F.filter(terms(F.col("text").cast("string")), lambda w: w != "")
    rows = items.select(F.col("item_id").cast("string").alias("item"), t.alias("_t")).where(F.size("_t") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_t") - width + 1, F.lit(1)))
    return rows.select("item", F.explode(F.transform(starts, lambda s: F.slice("_t", s, width))).alias("window")).distinct()


def item_segments(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """``item, segment``: the distinct terms of every run of ``width`` words, run after run, the last one flush with the item's end."""
    t = F.filter(terms(F.col("text").cast("string")), lambda w: w != "")
    rows = items.select(F.col("item_id").cast("string").alias("item"), t.alias("_t")).where(F.size("_t") > 0)
    last = F.greatest(F.size("_t") - width + 1, F.lit(1))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), last, F.lit(width)), F.array(last)))
    return rows.select("item", F.explode(F.transform(starts, lambda s: F.array_sort(F.array_distinct(F.slice("_t", s, width))))).alias("segment")).distinct()


def few(rows: DataFrame, more: Column | None = None) -> bool:
    """Whether the distinct terms of a table, and ``more`` bytes in each row, may be broadcast."""
    each = F.octet_length("term") + 64 + (F.lit(0) if more is None else more)
    return (rows.agg(F.sum(each)).first()[0] or 0) <= BROADCAST_BYTES


def frequencies(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``term, n``: places of each vocabulary term in the texts. ``vocabulary`` holds each term once."""
    words = _texts(docs).select(F.explode(terms(F.col("_text"))).alias("term"))
    count = F.count(F.lit(1)).alias("n")
    if few(vocabulary):
        return words.join(F.broadcast(vocabulary), "term").groupBy("term").agg(count)
    return words.groupBy("term").agg(count).join(vocabulary, "term")


def rarest(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``term, at``: the rarest term of each window and its offset. Windows with a term that no text holds are left out."""
    places = windows.select("item", "window", F.posexplode("window").alias("at", "term")).join(counts, "term", "left")
    picked = places.groupBy("item", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "at")).alias("_r"))
    return picked.where("_r.n > 0").select("item", "window", F.col("_r.term").alias("term"), F.col("_r.at").alias("at"))


def rare_few(segments: DataFrame, counts: DataFrame, least: float = NEAR) -> DataFrame:
    """Add ``need, term``: one row for each of the rarest terms of a segment, of which a stretch with ``need`` of its terms holds at least one."""
    places = segments.select("item", "segment", F.explode("segment").alias("term")).join(counts, "term", "left")
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")))  # a window's length at most
    rows = places.groupBy("item", "segment").agg(ranked.alias("_r")).withColumn("need", F.ceil(F.round(F.size("segment") * F.lit(least), 9)).cast("int"))
    rows = rows.select("item", "segment", "need", F.explode(F.slice("_r", F.lit(1), F.size("segment") - F.col("need") + 1)).alias("_r"))
    return rows.where("_r.n > 0").select("item", "segment", "need", F.col("_r.term").alias("term"))


def postings(docs: DataFrame, looked_up: DataFrame, width: int = WINDOW) -> DataFrame:
    """Positional postings of the terms to look up: ``term``, document key, ``pos``, and the terms up to ``width - 1`` before and after."""
    texts = _texts(docs).select(*KEY, terms(F.col("_text")).alias("_t"))
    if few(looked_up):
        found = texts.select(*KEY, "_t", F.posexplode("_t").alias("pos", "term")).join(F.broadcast(looked_up), "term")
    else:
        places = texts.select(*KEY, F.posexplode("_t").alias("pos", "term")).join(looked_up, "term").distinct()
        found = places.join(_texts(docs).dropDuplicates(KEY).select(*KEY, terms(F.col("_text")).alias("_t")), KEY)
    low = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    return found.select(
        "term", *KEY, "pos", F.slice("_t", low + 1, F.col("pos") - low).alias("before"), F.slice("_t", F.col("pos") + 2, width - 1).alias("after")
    )


def phrase_matches(stored: DataFrame, anchored: DataFrame) -> DataFrame:
    """Exact matches: ``item``, document key, ``start``, ``length``."""
    # offset and length of the windows of a term: at most width * width of them
    shapes = anchored.groupBy("term").agg(F.collect_set(F.struct("at", F.size("window").alias("length"))).alias("_s"))
    # a common term has many postings, so they are shuffled by term only where the terms are too many to broadcast
    shapes = F.broadcast(shapes) if few(shapes, 16 * F.size("_s")) else shapes
    shifted = stored.join(shapes, "term").select("term", *KEY, "pos", "before", "after", F.inline("_s"))
    left, right = F.col("at"), F.col("length") - F.col("at") - 1
    shifted = shifted.where((F.size("before") >= left) & (F.size("after") >= right))
    window = F.concat(F.slice("before", F.size("before") - left + 1, left), F.array("term"), F.slice("after", F.lit(1), right))
    shifted = shifted.select("term", "at", *KEY, (F.col("pos") - left).alias("start"), "length", window.alias("window"))
    return shifted.join(anchored, ["term", "at", "window"]).select("item", *KEY, "start", "length")


def proximity_matches(stored: DataFrame, near: DataFrame, width: int = WINDOW) -> DataFrame:
    """Near matches: ``item``, document key, ``pos`` of a rare term, and the largest ``share`` of a segment's distinct terms in ``width`` words around it."""
    met = stored.join(near, "term").withColumn("_a", F.concat("before", F.array("term"), "after"))
    met = met.where(F.size(F.array_intersect("_a", "segment")) >= F.col("need"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_a") - width + 1, F.lit(1)))
    most = F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect(F.slice("_a", s, width), F.col("segment")))))
    met = met.withColumn("_most", most).where(F.col("_most") >= F.col("need"))
    return met.select("item", *KEY, "pos", (F.col("_most") / F.size("segment")).alias("share"))


class Index(NamedTuple):
    """Stored postings, and the windows and segments anchored on their terms."""

    postings: DataFrame
    windows: DataFrame
    segments: DataFrame | None


def index(docs: DataFrame, items: DataFrame, width: int = WINDOW, near: float | None = NEAR) -> Index:
    """The index of all terms that the items are looked up from; without ``near``, only those of exact matches."""
    windows = staged(item_windows(items, width), "windows")
    vocabulary = staged(windows.select(F.explode("window").alias("term")).distinct(), "vocabulary")
    counts = staged(frequencies(docs, vocabulary), "frequencies")
    anchored = staged(rarest(windows, counts), "anchored")
    looked_up, segments = anchored.select("term"), None
    if near is not None:
        segments = staged(rare_few(item_segments(items, width), counts, near), "segments")
        looked_up = looked_up.unionByName(segments.select("term"))
    looked_up = staged(looked_up.distinct(), "looked-up")
    return Index(staged(postings(docs, looked_up, width), "postings"), anchored, segments)


def find_passages(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """All exact matches of all items."""
    found = index(docs, items, width, None)
    return phrase_matches(found.postings, found.windows)


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, parts_hit: int = 20) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near``.

    Contaminated: some word is hit, and at least one in ``parts_hit`` words. ``n_near`` counts the items with a near match (or an exact one
    of a whole segment); it has no part in the decision.
    """
    set_up(docs.sparkSession)
    made = index(docs, items, width)
    found = staged(phrase_matches(made.postings, made.windows), "matches")
    places = found.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    hits = places.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("_items"))
    close = proximity_matches(made.postings, made.segments, width).select(*KEY, "item").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_near"))
    result = hits.join(named, KEY).join(close, KEY, "full_outer")
    sizes = _texts(docs).select("_id", *KEY, _n_terms(terms(F.col("_text"))).alias("n_words"))
    out = sizes.join(result, KEY, "left").select(
        F.col("_id").alias("doc_id"), "n_words", F.coalesce("_items", F.array()).alias("_items"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_near")],
    )
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * parts_hit >= F.col("n_words"))).alias("contaminated"), "n_near",
    )


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WINDOW, parts_hit: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns. Only keys of contaminated texts are joined."""
    set_up(docs.sparkSession)
    found = staged(find_passages(docs, items, width), "matches")
    places = found.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    hits = staged(places.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_hit")), "hits")
    text = F.col("text").cast("string")
    both = docs.select(whole(docs), *_key(docs), _n_terms(terms(text)).alias("_n_terms")).join(hits, KEY, "left")
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * parts_hit >= F.col("_n_terms"))
    return both.where(~F.coalesce(bad, F.lit(False))).select(*unpacked(docs))
