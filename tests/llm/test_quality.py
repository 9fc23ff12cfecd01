"""The discriminant: moments against numpy, densities against the textbook formula, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from pagemill.llm.quality import STATISTICS, Discriminant, discriminant, fit, keep_good, measured, score_quality, statistics

SCHEMA = "doc_id long, text string, score double"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


def test_density():
    draw = np.random.default_rng(1)
    x = [draw.normal(size=(50, 3)), draw.normal(size=(70, 3)) @ np.diag([1, 2, 3]) + 1]
    model = discriminant(np.array([50.0, 70.0]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), 0.05)
    for k in (0, 1):
        cov = np.linalg.inv(model.factors[k].T @ model.factors[k])
        assert np.allclose(model.log_dets[k], np.linalg.slogdet(cov)[1])
        assert np.allclose(cov, np.cov(x[k].T, bias=True), atol=0.5)
    at = draw.normal(size=(5, 3))

    def log_density(k):
        cov = np.linalg.inv(model.factors[k].T @ model.factors[k])
        d = at - model.means[k]
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1]

    assert np.allclose(model.score(at), 1 / (1 + np.exp(-(log_density(1) - log_density(0) + np.log(70 / 50)))))


def test_fit_is_the_model_of_the_training_rows(tables):
    docs, labels = tables
    model = fit(measured(docs), labels)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    x = [[], []]
    for r in docs.select("doc_id", "text").collect():
        if r.doc_id in quality and zlib.crc32(str(r.doc_id).encode()) % 5:
            x[quality[r.doc_id]].append(statistics([r.text])[0])
    x = [np.array(v) for v in x]
    same = discriminant(np.array([float(len(v)) for v in x]), np.array([v.sum(0) for v in x]), np.array([v.T @ v for v in x]), 0.05)
    assert np.allclose(same.means, model.means) and np.allclose(same.log_dets, model.log_dets)


def test_held_out_accuracy(tables):
    docs, labels = tables
    rows = score_quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.97
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97


def test_scores_use_texts_only(spark, tables):
    docs, labels = tables
    a = {r.text: r.score for r in score_quality(docs, labels).join(docs, "doc_id").collect()}
    mixed = docs.selectExpr("doc_id", "text", "'xx' AS lang", "'zz' AS source")
    assert {r.text: r.score for r in score_quality(mixed, labels).join(docs, "doc_id").collect()} == pytest.approx(a)


def test_edges(spark):
    rows = [(1, "a b c", 0.5), (1, "a b c", 0.5), (2, None, 0.1), (3, "", 0.2), (None, "x", 0.3), (4, "word " * 200_000, 0.1), (5, "!!! ???", 0.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = score_quality(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == 7 and {r.score for r in none} == {0.5}
    both = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 0, 0), (2, 1, 0), (2, 0, 0), (None, 1, 0), (4, None, 1)], LABELS)
    got = score_quality(docs, both).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert {r.score for r in score_quality(docs, both.where("doc_id = 1")).collect()} == {1.0}
    empty = spark.createDataFrame([], SCHEMA)
    assert score_quality(empty, both).count() == 0
    kept = keep_good(docs, both)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got) and keep_good(empty, both).count() == 0


def test_statistics_shape():
    assert statistics(["a", None, "", "é " * 9]).shape == (4, len(STATISTICS)) and np.isfinite(statistics([None, "\n"])).all()
    assert statistics([]).shape == (0, len(STATISTICS))
    assert Discriminant(0.5).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
