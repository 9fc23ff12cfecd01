"""Operator 9: near copies by MinHash.

1. Every text becomes its set of word shingles; equal sets are one class, represented by its smallest document, from here on.
2. A set is sketched by 128 universal hash minima in 32 bands of 4. Sets at similarity 0.8 share a band with probability
   1 - 4.6e-8. A bucket is a band value that several classes share.
3. Signature verification: inside a bucket, classes whose signatures agree in enough minima (``CLOSE``, five standard deviations
   below 0.8) are tied. Of the ties of a bucket only a spanning forest leaves the task. Buckets of more than
   ``BUCKET`` classes are not split by signatures, their classes are tied to the least one: that only makes coarse groups larger.
4. The components of the ties are coarse groups: no link leaves one. The full sets of a group meet in one task, or, when they
   exceed ``GROUP`` shingles, in one task per pair of blocks. Links are confirmed there on the full sets by counting common
   shingles through postings, and again only a spanning forest leaves.
5. Components of the confirmed links, then copies follow their class.

No group is gathered whole, pairs are never emitted, nothing is capped. Components run in large-star and small-star rounds.

Cases: null, empty and blank texts have no shingles and are components of their own; a text with fewer words than a shingle is one
shingle; rows that repeat a ``doc_id`` form one document for linking (any of their texts links it), and each row is returned
with its own size; rows without ``doc_id`` are left alone; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import byte_sums, grams, known_ids, mix, null_ids, seeds, set_up, slices, spans, texts, words_of
from pagemill.llm.components import connected
from pagemill.session import staged

BANDS, ROWS = 32, 4
CLOSE = 0.62  # 0.8 less five standard deviations of 128 minima
BUCKET = 1000
GROUP = 1 << 20
_A = (seeds(BANDS * ROWS, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (seeds(BANDS * ROWS, 13) >> np.uint64(32)).astype(np.uint32)
_BAND = seeds(BANDS, 17)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of every text; a short text is one shingle."""
    w = words_of(texts, lower=True)
    sums = byte_sums(w.data)
    hashes = spans(sums, w.start, w.end)
    runs = grams(hashes, width)
    out = []
    for lo, hi in zip(w.first[:-1], w.first[1:], strict=True):
        n = hi - lo
        if n >= width:
            out.append(np.unique(runs[lo : hi - width + 1]))
        elif n:
            out.append(mix(grams(hashes[lo:hi], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(len(_A), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(out, (np.multiply.outer(_A, x[at : at + 4096]) + _B[:, None]).min(axis=1), out=out)
    return out


def _sketch(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, column = b["doc_id"].tolist(), b["text"].tolist()
            for lo, hi in slices(column):
                rows = []
                for doc_id, s in zip(ids[lo:hi], shingle_sets(column[lo:hi], width), strict=True):
                    if len(s):
                        m = minima(s)
                        bands = mix((m.reshape(BANDS, ROWS).astype(np.uint64) * (seeds(ROWS, 19) | np.uint64(1))).sum(axis=1, dtype=np.uint64) ^ _BAND)
                        rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), m.astype(np.uint8).tobytes(), bands.view(np.int64).tolist()))
                    else:
                        rows.append((doc_id, 0, None, None, None))
                yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_id", "signature", "bands"])

    return run


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_id, signature, bands``; the signature holds the low byte of every minimum."""
    set_up(docs.sparkSession)
    return null_ids(known_ids(texts(docs)).mapInPandas(_sketch(width), "doc_id long, n_shingles long, set_id binary, signature binary, bands array<long>"))


def forest(near, n: int) -> list[tuple[int, int]]:
    """Spanning forest of a relation over 0 .. n - 1. ``near(i, rest)`` tells which of ``rest`` are tied to i."""
    open_, out = np.ones(n, dtype=bool), []
    for root in range(n):
        if not open_[root]:
            continue
        open_[root] = False
        front = [root]
        while front:
            i = front.pop()
            rest = np.flatnonzero(open_)
            if not len(rest):
                break
            got = rest[near(i, rest)]
            open_[got] = False
            front += got.tolist()
            out += [(int(g), root) for g in got]
    return out


def _tie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ties of each bucket: its members and signatures in, (u, v) out."""
    least = int(np.ceil(CLOSE * len(_A)))
    for b in batches:
        out: list[tuple[int, int]] = []
        for members in b["members"]:
            ids = [m["doc_id"] for m in members]
            signs = np.frombuffer(b"".join(m["signature"] for m in members), dtype=np.uint8).reshape(len(ids), -1)
            ties = forest(lambda i, rest, s=signs: (s[rest] == s[i]).sum(axis=1) >= least, len(ids))
            out += [(ids[i], ids[j]) for i, j in ties]
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def candidate_ties(classes: DataFrame) -> DataFrame:
    """Ties between classes (``doc_id, signature, bands``) that share a bucket: ``u, v``."""
    banded = classes.select("doc_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    members = staged(banded.join(shared, "band"), "members")
    hot = members.where(F.col("n") > BUCKET).select(F.col("doc_id").alias("u"), F.col("least").alias("v")).where("u <> v")
    # buckets of the same classes are one
    small = members.where(F.col("n") <= BUCKET).groupBy("band").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    small = small.select("ids", F.xxhash64("ids").alias("bucket")).groupBy("bucket", "ids").agg(F.count(F.lit(1)))
    each = small.select("bucket", F.explode("ids").alias("doc_id")).join(classes.select("doc_id", "signature"), "doc_id")
    full = each.groupBy("bucket").agg(F.collect_list(F.struct("doc_id", "signature")).alias("members"))
    return hot.unionByName(full.select("members").mapInPandas(_tie, "u long, v long"))


def _blocks(groups: DataFrame) -> DataFrame:
    """Where the sets of coarse groups meet: ``doc_id, place``, once per task that needs the set."""
    sizes = groups.groupBy("component").agg(F.sum("n_shingles").alias("_all"))
    rows = groups.join(sizes, "component")
    n = F.ceil(F.col("_all") / GROUP)
    own = F.pmod(F.xxhash64("doc_id"), n)
    pair = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    return rows.select("doc_id", F.explode(pair).alias("_p")).select("doc_id", "_p.i", "_p.j")


def _confirm(similarity: tuple[int, int]):
    top, bottom = similarity

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable", ignore_index=True)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in rows["shingles"]]
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        holder = np.repeat(np.arange(len(sets)), size)[order]
        _, first, count = np.unique(flat[order], return_index=True, return_counts=True)
        code = np.empty(len(flat), dtype=np.int64)
        code[order] = np.repeat(np.arange(len(first)), count)
        starts = np.concatenate([[0], np.cumsum(size)])

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            mine = code[starts[i] : starts[i + 1]]
            lists, n = first[mine], count[mine]
            at = np.repeat(lists - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(holder[at], minlength=len(sets))[rest]
            return common * bottom >= top * (size[i] + size[rest] - common)

        ids = rows["doc_id"].to_numpy()
        return pd.DataFrame([(ids[i], ids[j]) for i, j in forest(near, len(sets))], columns=["u", "v"], dtype="int64")

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            column = b["text"].tolist()
            for lo, hi in slices(column):
                made = shingle_sets(column[lo:hi], width)
                yield b.iloc[lo:hi].drop(columns="text").assign(shingles=[s.tobytes() for s in made])

    return run


def links(docs: DataFrame, classes: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """Confirmed links, as spanning forests of them: ``u, v``. ``classes`` are one document per distinct set."""
    ties = candidate_ties(classes.select("doc_id", "signature", "bands"))
    coarse = connected(ties)
    groups = coarse.withColumnRenamed("node", "doc_id").join(classes.select("doc_id", "n_shingles", "set_id"), "doc_id")
    places = _blocks(groups.select("doc_id", "component", "n_shingles"))
    keyed = staged(places.join(groups.select("doc_id", "component"), "doc_id"), "places")
    wanted = keyed.select("doc_id").distinct()
    found = texts(docs).join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = found.mapInPandas(_sets(width), "doc_id long, shingles binary").where(F.octet_length("shingles") > 0)
    return sets.join(keyed, "doc_id").groupBy("component", "i", "j").applyInPandas(_confirm(similarity), "u long, v long")


def near_copies(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``. Linked: bottom * common >= top * union, for ``similarity`` (top, bottom)."""
    rows = staged(sketched(docs, width), "sketches")
    some = rows.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    first = staged(some.groupBy("set_id").agg(F.min("doc_id").alias("first")), "classes")
    classes = some.join(first, (some["set_id"] == first["set_id"]) & (some["doc_id"] == first["first"]), "left_semi").dropDuplicates(["set_id"])
    near = staged(links(docs, staged(classes, "classes"), width, similarity), "links")
    copies = some.join(first, "set_id").where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    component = connected(near.unionByName(copies))
    out = rows.select("doc_id", "n_shingles").join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100), repeats: bool = True) -> DataFrame:
    """One document of every component, with all columns.

    Rows that repeat a kept ``doc_id`` all stay, unless ``repeats`` is false: then one row stays of those with the same ``doc_id``
    and text, and of those with the same text and no ``doc_id``.
    """
    gone = near_copies(docs, width, similarity).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    return kept if repeats else _rows_once(docs, kept)


def _rows_once(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Of rows of ``kept`` with the same ``doc_id`` and text, the one with the least hash of all columns."""
    key = [F.col("doc_id").alias("_id"), F.sha2(F.col("text").cast("binary"), 256).alias("_text")]
    if docs.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return kept  # texts need not travel
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.groupBy(*key).agg(F.min_by(row, order).alias("_row")).select("_row.*")
