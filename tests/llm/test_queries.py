"""Queries of this subpackage against their check SQL."""

import pytest

from pagemill.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert compare(spark, duck(folder), name, QUERIES[name], ORACLES[name], folder) is None


COLUMNS = {  # what each query has to return
    1: ("n_bytes bigint", "n_tokens bigint", "over_limit boolean"),
    2: ("n_email bigint", "n_ip bigint", "n_card bigint", "n_phone bigint", "base_sha256 string", "spans string"),
    3: ("n_words bigint", "n_removed bigint", "kept_sha256 string"),
    5: ("size bigint", "source_size bigint", "target double", "taken bigint"),
    6: ("size bigint", "text_crc32 bigint", "law string", "shard int", "slot bigint", "grown_shard int"),
    7: ("held_out boolean", "score double", "predicted int"),
    8: ("n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"),
    9: ("n_shingles bigint", "component_id bigint", "kept boolean"),
    10: ("n_words bigint", "n_hit bigint", "n_items bigint", "items_sha256 string", "contaminated boolean"),
}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if int(n[2:].split("_")[0]) in COLUMNS))
def test_every_document_is_told(spark, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert {"doc_id bigint", *COLUMNS[int(name[2:].split("_")[0])]} <= {f"{c} {t}" for c, t in got.dtypes}
    assert sorted(r.doc_id for r in got.collect()) == list(range(200))


def test_neighbours_query(spark):
    got = QUERIES["op4_curve_neighbours"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert sorted((r.query_id, r["rank"]) for r in got.collect()) == [(q, k) for q in range(0, 500, 100) for k in range(1, 11)]


@pytest.mark.parametrize("name, columns", [
    ("op11_spelling_groups", "word string, form string, root string, n bigint, n_near bigint, form_n bigint"),
    ("op12_collocations", "lang string, rank int, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"),
    ("op13_norm_search", "query_id bigint, rank int, vec_id bigint, score bigint"),
])
def test_columns(spark, name, columns):
    assert ", ".join(f"{c} {t}" for c, t in QUERIES[name](spark, "/root/testdata/sf0.001").dtypes) == columns
