"""Token counts: pieces against whole texts, the cache, and edge cases."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTER, WHOLE = T.Counter(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 1.\n\té'’  \x1c\x85\U0001f600<|endoftx>"), max_size=40), max_size=5))
def test_pieces_add_up(texts):
    assert COUNTER(texts) == [len(WHOLE.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_documents(spark, name):
    path = public_tokenizers.path(name)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = Tokenizer.from_file(path)
    want = {r.doc_id: len(whole.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    got = T.token_counts(docs, path, limit=100).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_special_strings_and_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a<|endoftext|>b", "z"), (3, "a<|endoftext|>b", "z"), (4, "é", None), (None, "a b", "q"), (5, "long " * 300_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = sorted(T.token_counts(docs, PATH).collect(), key=str)
    want = [len(WHOLE.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    assert sorted(r.n_tokens for r in got) == sorted(want) and sorted(r.n_bytes for r in got) == sorted(len((t or "").encode()) for _, t, _ in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_counts(empty, PATH).count() == 0


def test_cache_is_used_and_grows(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    a = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three")], "doc_id long, text string")
    T.fill_cache(a, PATH, cache)
    stored = spark.read.parquet(cache)
    assert stored.count() == 2
    T.fill_cache(a, PATH, cache)
    assert spark.read.parquet(cache).count() == 2  # no misses
    # a stored count is taken as it is, so this shows that hits are not encoded again
    planted = spark.createDataFrame([("planted",)], "text string").select(T.digest().alias("digest"))
    planted.selectExpr("digest", f"'{T.version_of(PATH)}' AS version", "99L AS n_tokens").write.mode("append").parquet(cache)
    b = spark.createDataFrame([(7, "planted"), (8, "new text")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in T.token_counts(b, PATH, cache).collect()} == {7: 99, 8: 2}
    assert spark.read.parquet(cache).count() == 4
    other = public_tokenizers.path("word_bpe_49k.json")  # another version shares no counts
    T.fill_cache(a, other, cache)
    assert spark.read.parquet(cache).count() == 6


def test_texts_of_rows_without_id(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    rows = [(None, "a b"), (None, "a b"), (None, "b"), (1, "b"), (2, "c d"), (2, "c d"), (None, None)]
    got = T.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), PATH, cache).collect()
    count = {t: len(WHOLE.encode(t or "", add_special_tokens=False).ids) for _, t in rows}
    assert sorted(((r.doc_id, r.n_tokens, r.over_limit) for r in got), key=str) == sorted(((i, count[t], False) for i, t in rows), key=str)
    assert spark.read.parquet(cache).count() == 4  # one row per distinct text
