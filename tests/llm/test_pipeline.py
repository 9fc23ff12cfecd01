"""The pipeline: every stage on its own input against plain versions of its rule."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C
from pagemill.llm.quality import score_quality
from pagemill.session import staged
from tests.llm.test_mixing import plain_targets
from tests.llm.test_near_copies import brute as near_brute
from tests.llm.test_phrase_index import brute as phrase_brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """Input of every stage, and the result."""
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in C.STAGES:
        out.append(staged(stage(spark, out[-1], FOLDER), name))
    return [(t.columns, [r.asDict() for r in t.collect()]) for t in out]


def words(text):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]


def key(rows):
    return sorted((r["doc_id"], r["text"]) for r in rows)


def test_columns(tables):
    assert [c for c, _ in tables[:-1]] == [tables[0][0]] * 5 and set(tables[0][0]) | {"shard", "slot"} == set(tables[-1][0])


def test_quality(spark, tables):
    scored = score_quality(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
    good = {r.doc_id for r in scored if r.predicted}
    assert key(tables[1][1]) == key([r for r in tables[0][1] if r["doc_id"] in good]) and len(good) < len(tables[0][1])


def test_near_copies(tables):
    rows = tables[1][1]
    want = near_brute([(r["doc_id"], r["text"]) for r in rows], 5)
    assert key(tables[2][1]) == key([r for r in rows if want[r["doc_id"]][1] == r["doc_id"]]) and len(tables[2][1]) < len(rows)


def test_decontaminate(spark, tables):
    rows = tables[2][1]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {d for d, *_, is_bad in phrase_brute([(r["doc_id"], r["text"]) for r in rows], items) if is_bad}
    assert key(tables[3][1]) == key([r for r in rows if r["doc_id"] not in bad])


def test_mix(tables):
    rows, out = tables[3][1], tables[4][1]
    sizes, taken, each = defaultdict(int), Counter(), Counter()
    text = {r["doc_id"]: words(r["text"]) for r in rows}
    for r in rows:
        sizes[r["source"]] += len(text[r["doc_id"]])
    for r in out:
        w = words(r["text"])
        taken[r["source"]] += len(w)
        each[r["doc_id"]] += len(w)
        assert not Counter(w) - Counter(text[r["doc_id"]])
    want = plain_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want) and all(n <= 2 * len(text[d]) for d, n in each.items())


def test_shard(tables):
    rows, out = tables[4][1], tables[5][1]
    assert key(out) == key(rows)
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and sorted((r["shard"], r["slot"]) for r in out) == sorted((s, k) for s, n in counts.items() for k in range(n))


def test_run(spark, tables):
    got = C.run(spark, FOLDER).collect()
    assert key([r.asDict() for r in got]) == key(tables[-1][1])


def test_edges(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, a further column; then empty tables."""
    some = [(1, "A plain text of some words, and more of them.", "en", "s", 1, "u"), (1, "A plain text of some words, and more of them.", "en", "s", 1, "u"), (2, None, None, None, None, None), (3, "", "en", "s", 0, None), (None, "another text", None, None, None, "x")]
    for name, rows in (("full", some), ("none", [])):
        folder = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard_hint string").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "no such passage")] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = C.run(spark, folder)
        assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "shard_hint", "shard", "slot"}
        assert (out.count() > 0) == bool(rows)


OWN = ["_h", "_no", "_size", "_hash", "_gone", "_id", "n_hit", "_doc", "_source", "_key", "_text", "start", "pass", "block", "component", "node", "score", "_whole_row"]


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_columns_named_as_the_stages_own(spark, name, stage):
    """Further columns come back as they were given, whatever their names."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    more = docs.select("*", *[(docs["doc_id"] * 100 + k).alias(c) for k, c in enumerate(OWN)])
    out = stage(spark, more, FOLDER)
    assert set(more.columns) <= set(out.columns)
    rows = out.collect()
    assert rows and all(r[c] == r.doc_id * 100 + k for r in rows for k, c in enumerate(OWN))
