"""Operator 7: a regularised quadratic discriminant over document statistics.

Every text becomes a short vector of transformed statistics. Each class (quality 0 or 1) is a Gaussian whose covariance is
shrunk towards a scaled identity and factored once (Cholesky, cached in the model). A score is the logistic of the
difference of the two log densities, each of them a Mahalanobis distance and a log determinant, plus the log prior odds.

The moments (count, sum, sum of products by class) are added up in Spark over all training rows, so the fit needs no
sample and the driver gets a fixed number of values. ``labels``, ``lang``, ``source`` and ``doc_id`` are never inputs of a score.

Cases: null and empty texts have the statistics of an empty text and a score as any other; documents labelled both ways
do not train; repeated labels count once; with one class only, or none, every score is the share of label 1 (0.5 without labels);
an empty table gives an empty result; a statistic that never varies is carried by the shrinkage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import known_ids, null_ids, set_up, slices, texts, words_of
from pagemill.session import staged

STATISTICS = ["length", "word_length", "upper", "digit", "symbol", "high", "line_length", "distinct", "repeat", "marked", "plain", "spread"]
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[b for b in range(33, 127) if not _ALNUM[b] and chr(b) not in ".,;:'-()"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _logit(hits: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Log odds of a share, smoothed so that 0 and 1 stay finite."""
    return np.log((hits + 0.5) / (np.maximum(of - hits, 0) + 0.5))


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of transformed statistics per text, computed over the whole text."""
    w = words_of(texts)
    rows = len(texts)
    doc = np.repeat(np.arange(rows), np.diff(w.first))
    n_words = np.diff(w.first).astype(float)
    size = w.end - w.start
    n_bytes = np.bincount(doc, size, rows)

    def by_byte(table: np.ndarray) -> np.ndarray:
        hits = np.concatenate([[0], np.cumsum(table[w.data])])
        return hits[w.end] - hits[w.start]

    def total(per_word: np.ndarray) -> np.ndarray:
        return np.bincount(doc, per_word, rows)

    upper, digit, high = np.zeros((3, 256), dtype=bool)
    upper[65:91], digit[48:58], high[128:] = True, True, True
    letters, symbols = by_byte(_LETTER), by_byte(_SYMBOL)
    hashes = w.hashes()
    same = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    distinct, spread = np.zeros(rows), np.zeros(rows)
    for i in range(rows):
        _, n = np.unique(hashes[w.first[i] : w.first[i + 1]], return_counts=True)
        if len(n):
            p = n / n.sum()
            distinct[i], spread[i] = len(n), -(p * np.log(p)).sum()
    lines = np.fromiter(((t or "").count("\n") + 1 for t in texts), dtype=float, count=rows)
    out = np.stack(
        [
            np.log1p(n_bytes),
            np.log1p(n_bytes / np.maximum(n_words, 1)),
            _logit(total(by_byte(upper)), total(letters)),
            _logit(total(by_byte(digit)), n_bytes),
            _logit(total(symbols), n_bytes),
            _logit(total(by_byte(high)), n_bytes),
            np.log1p(n_words / lines),
            np.log1p(distinct) - 0.7 * np.log1p(n_words),  # distinct words grow about as this power of the length
            _logit(total(same), n_words),
            _logit(total((symbols > 0) & (letters > 0)), n_words),
            _logit(total(letters == size), n_words),
            spread / np.log(np.maximum(n_words, 1) + 1),
        ],
        axis=1,
    )
    return np.round(out, 9)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes; ``None`` factors stand for a constant score."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    log_dets: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        density = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.factors[k].T
            density.append(-0.5 * (z * z).sum(axis=1) - 0.5 * self.log_dets[k])
        odds = density[1] - density[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float) -> Discriminant:
    """The model of given moments of class 0 and class 1."""
    n = counts.sum()
    if n == 0 or not counts.all():
        return Discriminant(float(counts[1] / n) if n else 0.5)
    means, factors, dets = [], [], []
    pooled = sum(products[k] - np.outer(sums[k], sums[k]) / counts[k] for k in (0, 1)) / n
    floor = 1e-6 + np.diag(pooled).mean() * 1e-6
    for k in (0, 1):
        mean = sums[k] / counts[k]
        cov = products[k] / counts[k] - np.outer(mean, mean)
        # few rows lean on the pooled covariance, and always a little on a scaled identity
        lean = len(mean) / (len(mean) + counts[k])
        cov = (1 - lean) * cov + lean * pooled
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(cov).mean() * np.eye(len(mean)) + floor * np.eye(len(mean))
        lower = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(float(counts[1] / n), np.array(means), np.array(factors), np.array(dets))


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        column = b["text"].tolist()
        for lo, hi in slices(column):
            yield pd.DataFrame({"doc_id": b["doc_id"].iloc[lo:hi], "x": list(statistics(column[lo:hi]))})


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` with the statistics of every text."""
    set_up(docs.sparkSession)
    return null_ids(known_ids(texts(docs)).mapInPandas(_measure, "doc_id long, x array<double>"))


def in_fold(doc_id: Column | str = "doc_id") -> Column:
    """True for documents that are held out of training."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(rows: DataFrame, labels: DataFrame, shrinkage: float = 0.05) -> Discriminant:
    """Fit on ``rows`` (``doc_id, x``) with ``labels`` (``doc_id, quality``) outside the held-out fold."""
    wide = len(STATISTICS)
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    told = told.where(~in_fold()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    train = rows.join(told, "doc_id").select("quality", "x")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moments = np.zeros((2, 1 + wide + wide * wide))
        for b in batches:
            for k in (0, 1):
                mine = b["x"][b["quality"] == k]
                if len(mine):
                    x = np.stack(mine)
                    moments[k] += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        at = np.arange(moments[0].size)
        yield pd.DataFrame({"k": np.repeat([0, 1], at.size), "at": np.tile(at, 2), "v": moments.ravel()})

    sums = np.zeros((2, 1 + wide + wide * wide))
    for k, at, v in train.mapInPandas(add, "k int, at int, v double").groupBy("k", "at").agg(F.sum("v")).collect():  # 2 x 157 values
        sums[k, at] = v
    return discriminant(sums[:, 0], sums[:, 1 : 1 + wide], sums[:, 1 + wide :].reshape(2, wide, wide), shrinkage)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, shrinkage: float = 0.05) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``."""
    rows = staged(measured(docs), "statistics")
    model = fit(rows, labels, shrinkage)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(np.stack(b["x"])) if len(b) else []})

    scored = null_ids(known_ids(rows).mapInPandas(apply, "doc_id long, score double"))
    return scored.select("doc_id", in_fold().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns. Texts are measured in place, not shuffled."""
    rows = staged(measured(docs), "statistics")
    model = fit(rows, labels)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        column = text.tolist()
        got = [model.score(statistics(column[lo:hi])) for lo, hi in slices(column)]
        return pd.Series(np.concatenate(got) if got else np.zeros(0))

    return docs.where(score(F.col("text").cast("string")) >= threshold)
