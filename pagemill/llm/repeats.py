"""Windows that repeat across documents: the frame that operators 3 and 8 share.

A window is a fixed number of neighbouring units (words or bytes) of one document. The question for each window: what is the
smallest document that holds it? Comparing all shards of a corpus with all documents would take quadratic work, so windows are
routed by an anchor, the least hash among the short grams inside a window. Equal windows have equal anchors, and
neighbouring windows mostly share theirs, so a document falls into runs of windows with one anchor.

1. Anchors: every task tells which anchors its documents hold, packed by anchor bucket, each anchor once per document group.
2. Repeated anchors: a bucket finds those in two documents or more, and tells every group that holds one. An anchor in
   many groups is marked hot.
3. Pieces: groups cut their documents' runs with repeated anchors into pieces and send each distinct piece once, with
   the smallest and largest of its documents, to the shard of its anchor. Under a hot anchor single windows are sent, spread by content.
4. Shards: the matcher of the operator finds the smallest document of every window of every piece.
5. Removal: groups repeat their cutting in the same order, look the answers up, and mark the units of windows whose smallest
   document is smaller than their own.

Groups, buckets and shards grow with the bytes of the table, so each fits a task at any size. A hot passage, a group of copies or
a popular anchor reaches a bucket or shard at most once per group. Texts are dealt to groups in one exchange that steps 3 and 5
share. Hashes only route: whether windows are equal is decided on their content.

Rows without ``doc_id`` come after all others. Rows that repeat a ``doc_id`` never count against each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import byte_sums, grams, known_ids, null_ids, set_up, slices, spans, texts, words_of
from pagemill.session import staged

GROUP_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
LEAST = 64  # groups, buckets and shards at least
HOT_GROUPS = 256  # up to so many groups, the pieces of one anchor are at most a fiftieth of their bytes and fit a task
FLUSH = 1 << 20
_MULTI = np.uint32(1 << 31)  # marks, beside a group's number, that several of its documents in one flush hold the anchor

Runs = list[tuple[int, int, int]]  # first window, end of windows, smallest document
Matcher = Callable[[list[bytes], np.ndarray, np.ndarray], list[Runs]]  # pieces, their smallest documents and anchors


@dataclass
class Units:
    """Units of a list of texts: ``data[start[i]:end[i]]`` is unit i, and text t has the units [first[t], first[t + 1])."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    grams: np.ndarray


def byte_units(texts: list[str | None], gram: int) -> Units:
    blobs = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum([len(b) for b in blobs], dtype=np.int64)])
    at = np.arange(len(data) + 1)
    made = max(0, len(data) - gram + 1)
    return Units(data, at[:-1], at[1:], first, spans(byte_sums(data), at[:made], at[:made] + gram))


def word_units(texts: list[str | None], gram: int) -> Units:
    """Words with one space between them, whatever stood there."""
    w = words_of(texts)
    keep = np.zeros(len(w.data) + 1, dtype=np.int8)
    keep[w.start] += 1
    keep[w.end + 1] -= 1
    mask = np.cumsum(keep[:-1], dtype=np.int8) > 0
    data = w.data.copy()
    data[w.end] = 32
    size = w.end - w.start + 1
    end = np.cumsum(size)
    return Units(data[mask], end - size, end - 1, w.first, grams(w.hashes(), gram))


@dataclass(frozen=True)
class Kind:
    units: Callable[[list[str | None], int], Units]
    window: int
    gram: int

    @property
    def longest(self) -> int:
        """Windows in a piece at most; longer runs are cut."""
        return 2 * (self.window - self.gram + 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchor_runs(kind: Kind, u: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, text, first window and number of windows of every run."""
    if len(u.start) < kind.window:
        return np.zeros(0, dtype=np.uint64), *np.zeros((3, 0), dtype=np.int64)
    least = sliding_min(u.grams, kind.window - kind.gram + 1)
    at = np.arange(len(least))
    text = np.repeat(np.arange(len(u.first) - 1), np.diff(u.first))[: len(least)]
    inside = at + kind.window <= u.first[text + 1]
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(least)))
    cuts = -(-size // kind.longest)
    no = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    start, size = np.repeat(start, cuts) + no * kind.longest, np.repeat(size, cuts) - no * kind.longest
    kept = inside[start]
    start, size = start[kept], np.minimum(size, kind.longest)[kept]
    return least[start], text[start], start, size


def _tell_anchors(kind: Kind, buckets: int):
    def packed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        anchor, doc, group = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, anchor))
        anchor, doc, group = anchor[order], doc[order], group[order]
        new = np.ones(len(anchor), dtype=bool)
        new[1:] = anchor[1:] != anchor[:-1]
        run = np.cumsum(new) - 1
        other = np.zeros(len(anchor), dtype=bool)
        other[1:] = ~new[1:] & (doc[1:] != doc[:-1])
        multi = np.bincount(run, other)[run] > 0
        bucket = (anchor % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((group, anchor, bucket))
        anchor, group, multi, bucket = anchor[order], group[order], multi[order], bucket[order]
        once = np.ones(len(anchor), dtype=bool)
        once[1:] = (anchor[1:] != anchor[:-1]) | (group[1:] != group[:-1])
        anchor, bucket = anchor[once], bucket[once]
        held = group[once].astype(np.uint32) | np.where(multi[once], _MULTI, np.uint32(0))
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(at[1:], len(bucket))
        return pd.DataFrame([(int(bucket[a]), anchor[a:b].tobytes(), held[a:b].tobytes()) for a, b in zip(at, ends, strict=True)], columns=["bucket", "anchors", "held"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, waiting = [], 0
        for b in batches:
            column, groups = b["text"].tolist(), b["grp"].to_numpy()
            docs = b["doc_id"].to_numpy()
            for lo, hi in slices(column):
                anchor, text, _, _ = anchor_runs(kind, kind.units(column[lo:hi], kind.gram))
                parts.append((anchor, docs[lo:hi][text], groups[lo:hi][text]))
                waiting += len(anchor)
            if waiting >= FLUSH:
                yield packed(parts)
                parts, waiting = [], 0
        if waiting:
            yield packed(parts)

    return run


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    anchor = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in rows["anchors"]])
    held = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in rows["held"]])
    multi, group = held >= _MULTI, held & ~_MULTI
    order = np.lexsort((group, anchor))
    anchor, group, multi = anchor[order], group[order], multi[order]
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    run = np.cumsum(new) - 1
    once = new | np.concatenate([[True], group[1:] != group[:-1]])
    holders = np.bincount(run, once)[run]
    # a group's second entry is of another document too, met in another task or flush; of rows that repeat an id it only makes pieces
    kept = once & ((holders > 1) | (np.bincount(run, multi | ~once)[run] > 0))
    anchor, group, hot = anchor[kept], group[kept], holders[kept] >= HOT_GROUPS
    order = np.argsort(group, kind="stable")
    anchor, group, hot = anchor[order], group[order], hot[order]
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
    ends = np.append(at[1:], len(group)) if len(group) else []
    out = [(int(group[a]), anchor[a:b].tobytes(), anchor[a:b][hot[a:b]].tobytes()) for a, b in zip(at, ends, strict=True)]
    return pd.DataFrame(out, columns=["grp", "repeated", "hot"])


def _anchors_in(column: pd.Series) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(x for x in column if x is not None), dtype=np.uint64))


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), dtype=bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


@dataclass
class Shard:
    """Distinct pieces of one group for one shard, in order of their first place."""

    number: dict[bytes, int]
    anchors: list[int]
    least: list[int]
    most: list[int]


def _ordered(docs: pd.DataFrame) -> tuple[np.ndarray, list[str | None]]:
    """The same order whenever a group is read."""
    docs = docs.assign(key=docs["text"].fillna("")).sort_values(["doc_id", "key"], kind="stable")
    return docs["doc_id"].to_numpy(), docs["text"].tolist()


def cut(kind: Kind, docs: np.ndarray, column: list[str | None], repeated: np.ndarray, hot: np.ndarray, n_shards: int, shards: dict[int, Shard]):
    """Cut a group's texts slice by slice: (low, high, units, places), a place being (text, first window, windows, shard, number of the piece).

    Fills ``shards``; numbers are given in order of appearance, so a second cutting gives the same ones.
    """
    for lo, hi in slices(column):
        u = kind.units(column[lo:hi], kind.gram)
        anchor, text, start, size = anchor_runs(kind, u)
        kept = _member(anchor, repeated)
        anchor, text, start, size = anchor[kept], text[kept], start[kept], size[kept]
        single = _member(anchor, hot)
        if single.any():  # under a hot anchor every window is a piece
            times = np.where(single, size, 1)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            anchor, text, start, size, single = (np.repeat(x, times) for x in (anchor, text, start, size, single))
            start, size = start + step, np.where(single, 1, size)
        begin, stop = u.start[start], u.end[start + size + kind.window - 2]
        route = anchor.copy()
        if single.any():
            route[single] = spans(byte_sums(u.data), begin[single], stop[single])  # these stand alone, as equal windows are one piece
        shard = (route % np.uint64(n_shards)).tolist()
        blob = u.data.tobytes()
        doc = docs[lo:hi][text].tolist()
        places = []
        for t, d, s, n, a, b, k, f in zip(text.tolist(), doc, start.tolist(), size.tolist(), begin.tolist(), stop.tolist(), shard, route.tolist(), strict=True):
            into = shards.get(k)
            if into is None:
                into = shards[k] = Shard({}, [], [], [])
            piece = blob[a:b]
            no = into.number.get(piece)
            if no is None:
                no = into.number[piece] = len(into.anchors)
                into.anchors.append(f)
                into.least.append(d)
                into.most.append(d)
            else:
                if d < into.least[no]:
                    into.least[no] = d
                if d > into.most[no]:
                    into.most[no] = d
            places.append((t, s, n, k, no))
        yield lo, hi, u, places


PIECES = "shard int, grp int, anchors binary, sizes binary, content binary, least binary, most binary"


def _send_pieces(kind: Kind, n_shards: int):
    def run(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        shards: dict[int, Shard] = {}
        if len(told) and len(docs):
            for _ in cut(kind, *_ordered(docs), _anchors_in(told["repeated"]), _anchors_in(told["hot"]), n_shards, shards):
                pass
        rows = []
        for k, s in shards.items():
            sizes = np.fromiter(map(len, s.number), dtype=np.int32, count=len(s.number))
            # kept small for the shuffle: part of the anchor is enough to keep pieces apart, ids are told as differences
            apart = (np.array(s.anchors, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32)
            least = np.array(s.least)
            packed = zstandard.compress(b"".join(s.number), 1)
            rows.append((k, int(key[0]), apart.tobytes(), sizes.tobytes(), packed, np.diff(least, prepend=0).tobytes(), (np.array(s.most) - least).tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return run


def _answer(match: Matcher):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        first: list[int] = []
        anchor_of: list[int] = []
        used = []
        tops = []
        for anchors, sizes, packed, steps, above in zip(rows["anchors"], rows["sizes"], rows["content"], rows["least"], rows["most"], strict=True):
            content, least = zstandard.decompress(packed), np.cumsum(np.frombuffer(steps, dtype=np.int64))
            tops.append((least + np.frombuffer(above, dtype=np.int64)).tolist())
            ends = np.cumsum(np.frombuffer(sizes, dtype=np.int32), dtype=np.int64).tolist()
            at, mine = 0, []
            for end, a, d in zip(ends, np.frombuffer(anchors, dtype=np.uint32).tolist(), least.tolist(), strict=True):
                piece = content[at:end]
                at = end
                no = number.get(piece)
                if no is None:
                    no = number[piece] = len(first)
                    first.append(d)
                    anchor_of.append(a)
                elif d < first[no]:
                    first[no] = d
                mine.append(no)
            used.append(mine)
        pieces, firsts, anchors_ = list(number), np.array(first, dtype=np.int64), np.array(anchor_of, dtype=np.uint32)
        # a piece that is alone under its anchor has one answer for all its windows; others are matched
        _, back, count = np.unique(anchors_, return_inverse=True, return_counts=True)
        various = np.flatnonzero(count[back] > 1).tolist()
        answers: dict[int, Runs] = dict(zip(various, match([pieces[i] for i in various], firsts[various], anchors_[various]), strict=True)) if various else {}
        out = []
        for group, shard, most, mine in zip(rows["grp"], rows["shard"], tops, used, strict=True):
            found = []
            for k, (no, top) in enumerate(zip(mine, most, strict=True)):
                runs = answers.get(no)
                if runs is None:
                    if first[no] < top:
                        found.append((k, 0, -1, first[no]))
                else:
                    found += [(k, a, b, d) for a, b, d in runs if d < top]
            if found:
                out.append((int(group), int(shard), np.array(found, dtype=np.int64).tobytes()))
        return pd.DataFrame(out, columns=["grp", "shard", "answers"])

    return run


@dataclass
class Removed:
    """What a report gets for a slice of texts: units, and for each unit whether it goes."""

    units: Units
    gone: np.ndarray


def _remove(kind: Kind, n_shards: int, report: Callable[[Removed], list[tuple]], columns: list[str]):
    def run(key: tuple, docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        doc_of, column = _ordered(docs)
        answers: dict[tuple[int, int], Runs] = {}
        for shard, packed in zip(told["shard"], told["answers"], strict=True):
            if packed is not None:
                for k, a, b, d in np.frombuffer(packed, dtype=np.int64).reshape(-1, 4).tolist():
                    answers.setdefault((int(shard), k), []).append((a, b, d))
        rows = []
        for lo, hi, u, places in cut(kind, doc_of, column, _anchors_in(told["repeated"]), _anchors_in(told["hot"]), n_shards, {}):
            step = np.zeros(len(u.start) + 1, dtype=np.int64)
            low, high = [], []
            for t, s, n, shard, no in places:
                for a, b, d in answers.get((shard, no), ()):
                    if d < doc_of[lo + t]:
                        low.append(s + a)
                        high.append(s + (n if b < 0 else b) - 1 + kind.window)
            np.add.at(step, np.array(low, dtype=np.int64), 1)
            np.add.at(step, np.array(high, dtype=np.int64), -1)
            told_rows = report(Removed(u, np.cumsum(step)[:-1] > 0))
            rows += [(d, *r) for d, r in zip(doc_of[lo:hi].tolist(), told_rows, strict=True)]
        return pd.DataFrame(rows, columns=["doc_id", *columns])

    return run


def remove_repeats(docs: DataFrame, kind: Kind, match: Matcher, report: Callable[[Removed], list[tuple]], schema: str) -> DataFrame:
    """Mark the units of every window that a smaller document holds, and report on each document.

    ``match`` gets distinct pieces with their smallest documents and anchors, and returns runs of windows with theirs. ``report`` gives a
    row in ``schema`` for every text of a slice.
    """
    set_up(docs.sparkSession)
    rows = known_ids(texts(docs))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = shards = max(LEAST, math.ceil(total / GROUP_BYTES))
    buckets = max(LEAST, math.ceil(total / BUCKET_BYTES))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    anchors = rows.mapInPandas(_tell_anchors(kind, buckets), "bucket int, anchors binary, held binary")
    repeated = staged(anchors.groupBy("bucket").applyInPandas(_repeated, "grp int, repeated binary, hot binary"), "repeated")
    by_group = rows.groupBy("grp")
    pieces = by_group.cogroup(repeated.groupBy("grp")).applyInPandas(_send_pieces(kind, shards), PIECES)
    answers = pieces.groupBy("shard").applyInPandas(_answer(match), "grp int, shard int, answers binary")
    told = repeated.select("grp", "repeated", "hot", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("answers")).unionByName(
        answers.select("grp", F.lit(None).cast("binary").alias("repeated"), F.lit(None).cast("binary").alias("hot"), "shard", "answers")
    )
    columns = [c.split()[0] for c in schema.split(", ")]
    return null_ids(by_group.cogroup(told.groupBy("grp")).applyInPandas(_remove(kind, shards, report, columns), f"doc_id long, {schema}"))
