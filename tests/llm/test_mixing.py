"""Mixing: targets against a plain loop, permutations, blocks and slots followed by hand, edge cases."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, target string"


def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    whole, fixed = budget * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        share = {s: (whole - sum(fixed.values())) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_permutation(spark):
    for n in (1, 2, 3, 7, 10, 64, 1000, 4097):
        got = [r[0] for r in spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long"), 5)).collect()]
        assert sorted(got) == list(range(n))
        if n > 100:
            assert sum(a == b for a, b in enumerate(got)) < 20 and sum(abs(a - b) == 1 for a, b in zip(got, got[1:], strict=False)) < n / 20


def test_targets_and_words(docs):
    got = M.mix_sources(docs).collect()
    sizes = defaultdict(int)
    text = {r.doc_id: r for r in docs.collect()}
    for r in got:
        assert r.size == len(text[r.doc_id].text.split()) if text[r.doc_id].text.isascii() else True
        sizes[text[r.doc_id].source] += r.size
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        s = text[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert abs(sum(taken.values()) / sum(sizes.values()) - 1.5) < 0.001
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix_sources(docs.repartition(7)).collect()))


def test_capped_sources(spark):
    for sizes in [{"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 1}, {"a": 100, "b": 1, "c": 1, "d": 1}, {"x": 0, "y": 50}]:
        rows = M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r.source: r.target for r in rows} == pytest.approx(plain_targets(sizes))


def test_slots_by_hand(spark, docs):
    """Taken words are those of the documents' blocks, slot by slot; the shards' counts are draws."""
    rows = M.measured(docs)
    placed, sources = M._planned(rows, 5)
    streams = defaultdict(list)
    for r in sorted(placed.collect(), key=lambda r: (r.no, r.start, r.size)):
        assert r.start == len(streams[r.no])  # streams have no gaps
        streams[r.no] += [r.doc_id] * r.size
    got, shards, seen = Counter(), set(), defaultdict(list)
    for s in M.slots(sources, shard_words=50_000).collect():
        got.update(streams[s.no][s.block * M.BLOCK : s.block * M.BLOCK + s.words])
        shards.add(s.shard)
        seen[s.no, s["pass"]].append(s.block)
    assert all(len(b) == len(set(b)) for b in seen.values()) and len(shards) > 5
    assert {r.doc_id: r.taken for r in M.mix_sources(docs).collect() if r.taken} == dict(got)


def test_documents_of_the_mix(docs):
    taken = {r.doc_id: r.taken for r in M.mix_sources(docs).collect() if r.taken}
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    got, first = Counter(), {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        w = M.SEPARATORS and [x for x in __import__("re").split(r"[ \t\n\x0b\f\r]+", r.text) if x]
        got[r.doc_id] += len(w)
        assert r.n_chars == len(r.text) and (r.text == first[r.doc_id] or len(w) < len(first[r.doc_id].split()))
    assert got == taken


def test_edges(spark):
    rows = [(1, "a b c", "s", "x", "y"), (1, "a b c", "s", "x", "y"), (2, None, "s", "x", "y"), (3, "", None, "x", "y"), (4, " \t\x0b q\n", None, "", ""), (None, "m n", "t", "", ""), (5, "w " * 100_000, "u", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = M.mix_sources(docs).collect()
    assert sorted(r.size for r in got) == [0, 0, 1, 2, 3, 3, 100_000]
    assert all(r.taken <= 2 * r.size for r in got) and {r.source_size for r in got} == {6, 1, 2, 100_000}
    assert M.mixed_documents(docs).columns == docs.columns
    words = sum(len(r.text.split()) for r in M.mixed_documents(docs).collect())
    assert words == sum(r.taken for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix_sources(empty).count() == 0 and M.mixed_documents(empty).count() == 0
    nothing = spark.createDataFrame([(1, None, None, "", "")], SCHEMA)
    assert [tuple(r) for r in M.mix_sources(nothing).collect()] == [(1, 0, 0, 0.0, 0)] and M.mixed_documents(nothing).count() == 0


def test_counts_per_shard_are_a_draw(spark):
    """Every shard owns the slots that the draw gave it, and the counts spread as a multinomial draw does."""
    sizes = spark.createDataFrame([("a", 400_000), ("b", 90_000), (None, 700)], "source string, source_size long")
    sources = M.targets(sizes)
    drawn = M.draws(sources, 64, 5, 8192).collect()
    made = M.slots(sources, 64, 5, 8192).collect()
    counts = Counter((r.no, r.shard) for r in made)
    assert counts == {(r.no, r.shard): r.n for r in drawn}
    want = {r.no: round(r.target) for r in sources.collect()}
    assert {n: sum(r.words for r in made if r.no == n) for n in want} == want
    for no in want:
        each = [r.n for r in drawn if r.no == no]
        total, shards = sum(each), round(sum(want.values()) / 8192)
        spread = sum((n - total / shards) ** 2 for n in each) / (total / shards) + (shards - len(each)) * total / shards
        assert abs(spread - (shards - 1)) < 5 * (2 * shards) ** 0.5  # chi-squared


def test_many_rows_without_id_spread(spark):
    """A third of the rows without id: no chunk holds them all."""
    docs = spark.createDataFrame([(None if k % 3 else k, "same five words of text", "s") for k in range(3000)], "doc_id long, text string, source string")
    placed, _ = M._planned(M.measured(docs), 5)
    starts = sorted(r.start for r in placed.collect())
    assert starts == list(range(0, 15_000, 5))
