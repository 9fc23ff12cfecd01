"""Passages and near matches by the index against a plain search, terms beyond the broadcast bound, edge cases."""

import hashlib
import random
import re

from pagemill.llm import phrase_index as P

DOCS = "doc_id long, text string, n_words string, item string, pos int"
ITEMS = "item_id long, text string, doc_id string"


def words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in text or "")) if w]


def near_items(d, items, width):
    out = set()
    for item_id, passage, *_ in items:
        t = words(passage)
        last = max(len(t) - width, 0)
        for s in {*range(0, last + 1, width), last} if t else ():
            distinct = set(t[s : s + width])
            if any(len(distinct & set(d[p : p + width])) * 5 >= len(distinct) * 4 for p in range(len(d))):
                out.add(str(item_id))
    return out


def brute(docs, items, width=13):
    out = []
    for doc_id, text, *_ in docs:
        d, hit, named = words(text), set(), set()
        for item_id, passage, *_ in items:
            t = words(passage)
            for s in range(max(len(t) - width + 1, 1) if t else 0):
                w = t[s : s + width]
                for p in range(len(d) - len(w) + 1):
                    if d[p : p + len(w)] == w:
                        hit |= set(range(p, p + len(w)))
                        named.add(str(item_id))
        sha = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc_id, len(d), len(hit), len(named), sha, bool(hit) and 20 * len(hit) >= len(d), len(near_items(d, items, width))))
    return sorted(out, key=str)


def test_random_texts(spark, monkeypatch):
    draw = random.Random(2)
    vocabulary = ["a", "B", "é", "É", "x1", "yy"]
    text = lambda n: "".join(draw.choice(vocabulary) + draw.choice([" ", ", ", "\n"]) for _ in range(draw.randint(0, n)))
    items = [(k, text(7), "") for k in range(12)] + [(3, "b B", ""), (50, "one, two; " * 9, ""), (51, None, ""), (52, " ... ", "")]
    docs = [(k, text(40), "", "", 0) for k in range(40)] + [(7, None, "", "", 0), (8, "", "", "", 0), (9, "ONE two " * 30, "", "", 0), (9, "ONE two " * 30, "", "", 0), (None, "a b", "", "", 0)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for width in (3, 13):
        assert sorted(map(tuple, P.contamination(d, i, width).collect()), key=str) == brute(docs, items, width)
    kept = sorted(tuple(r) for r in P.clean_documents(d, i, 3).fillna(-1).collect())
    bad = [r[5] for r in sorted(brute(docs, items, 3), key=str)]
    assert len(kept) == bad.count(False)
    monkeypatch.setattr(P, "BROADCAST_BYTES", 60)  # terms beyond the bound give the same
    for width in (3, 13):
        assert sorted(map(tuple, P.contamination(d, i, width).collect()), key=str) == brute(docs, items, width)


def test_long_text_and_empty_tables(spark):
    passage = " ".join(f"t{k}" for k in range(20))
    d = spark.createDataFrame([(1, "w " * 300_000 + passage, "", "", 0), (2, passage, "", "", 0)], DOCS)
    i = spark.createDataFrame([(1, passage, "")], ITEMS)
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in P.contamination(d, i).collect()}
    assert got == {1: (300_020, 20, False), 2: (20, 20, True)}
    assert [r.doc_id for r in P.clean_documents(d, i).collect()] == [1] and P.clean_documents(d, i).columns == d.columns
    no_docs, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert P.contamination(no_docs, i).count() == 0
    assert {r.n_hit for r in P.contamination(d, no_items).collect()} == {0} and P.clean_documents(d, no_items).count() == 2


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon"
    texts = ["x epsilon of delta and gamma with beta alpha y", "alpha q r s beta", "beta gamma delta epsilon", "alpha beta gamma x delta" + " y" * 9 + " epsilon"]
    d = spark.createDataFrame([(k + 1, t, "", "", 0) for k, t in enumerate(texts)], DOCS)
    i = spark.createDataFrame([(1, item, "")], ITEMS)
    found = P.index(d, i)
    near = {(r._doc, r.share) for r in P.proximity_matches(found.postings, found.segments).collect()}
    assert near == {("1", 1.0), ("3", 0.8), ("4", 0.8)}
    assert P.phrase_matches(found.postings, found.windows).count() == 0


def test_near_copies_of_long_items(spark):
    """Two words of thirteen replaced, the rarest ones too, or all put in another order, are found; three are not."""
    item = [f"rare{k}" for k in range(3)] + [f"w{k}" for k in range(10)]
    swap = lambda *at: " ".join("zz" if k in at else w for k, w in enumerate(item))
    texts = [swap(0, 1), swap(0, 1, 2), swap(5), " ".join(reversed(item)), " ".join(item[3:]) * 5]
    d = spark.createDataFrame([(k, f"so {t} on", "", "", 0) for k, t in enumerate(texts)], DOCS)
    i = spark.createDataFrame([(1, " ".join(item), "")], ITEMS)
    assert {r.doc_id: r.n_near for r in P.contamination(d, i).collect()} == {0: 1, 1: 0, 2: 1, 3: 1, 4: 0}


def test_windows_of_one_common_term(spark):
    """A posting meets windows as a whole, so many windows of one common term make no more rows than there are matches."""
    run = "a " * 400
    items = [(k, "a " * k + f"b{k} " + "a " * 12, "") for k in range(1, 12)] + [(50, "a " * 13, "")]
    d = spark.createDataFrame([(1, run, "", "", 0), (2, run + "b3 " + run, "", "", 0)], DOCS)
    found = P.index(d, spark.createDataFrame(items, ITEMS), near=None)
    matches = P.phrase_matches(found.postings, found.windows)
    assert {(r.item, r._doc): r["count"] for r in matches.groupBy("item", "_doc").count().collect()} == {("50", "1"): 388, ("50", "2"): 776, ("3", "2"): 4}
