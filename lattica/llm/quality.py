"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

One pass over the texts yields a short row of statistics a document. Per class, sums of the statistics
and of their products over every labelled training row give means and covariances; each covariance is
shrunk towards the pooled one and that towards a multiple of the identity, and factored once by
Cholesky. A score is the logistic of the difference of the classes' log densities, whose Mahalanobis
terms come from solves against the cached factors, plus the log of the class sizes' ratio.

Cases: null and empty texts have the statistics of a text without words and are scored like any other;
null doc_id counts as not held out and is never trained on; rows with the same doc_id are scored each
for itself; with fewer than two rows of a class, the score of every text is the share of label 1 (or 0.5
without labels); an empty table gives no rows; further columns are passed on, and added ones get
underscores where one has their name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K
from ._common import free_name, small_batches, stash, table

FOLDS = 5
THRESHOLD = 0.3
#: Share of the pooled covariance in each class's, and of the identity in the pooled one.
SHRINK_POOLED, SHRINK_IDENTITY = 0.1, 0.02
EPSILON = 1e-3
#: A share is taken as if so many further words (or bytes) had been seen that hold the usual share, so that short texts are no outliers.
USUAL_WORDS, USUAL_BYTES = 12, 60
USUAL = {"word_length": 5.0, "word_spread": 3.0, "upper": 0.04, "digit": 0.0, "stop_mark": 0.03, "symbol": 0.0, "short": 0.35, "distinct": 0.75, "adjacent": 0.0, "top": 0.06, "line_words": 60.0}

STATISTICS = ("words", "word_length", "word_spread", "upper", "digit", "stop_mark", "symbol", "short", "distinct", "adjacent", "top", "line_words")

# classes of bytes
_SPACE, _LOWER, _UPPER, _DIGIT, _MARK, _SYMBOL, _HIGH = range(7)
_CLASS = np.full(256, _SYMBOL, np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = _LOWER, _UPPER, _DIGIT, _HIGH
_CLASS[[*b".,;:?'\"-"]] = _MARK
_CLASS[~K.SPACED] = _SPACE


def _share(name: str, part: np.ndarray, whole: np.ndarray, more: int) -> np.ndarray:
    """Log odds of a share."""
    x = (part + more * USUAL[name]) / (whole + more)
    return np.log((x + EPSILON) / (1 - x + EPSILON))


def _block(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    data, starts, ends, first = K.words(texts, K.SPACED)
    sizes = np.array([len(t) + 1 for t in texts])
    counts = np.bincount(np.repeat(np.arange(n) * 7, sizes) + _CLASS[data], minlength=7 * n).reshape(n, 7)
    lines = np.add.reduceat((data == 10).astype(np.int64), np.cumsum(sizes) - sizes)
    solid = counts[:, 1:].sum(1)
    of = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(np.float64)
    total = np.diff(first)
    mean = (np.bincount(of, length, n) + USUAL_WORDS * USUAL["word_length"]) / (total + USUAL_WORDS)
    square = np.bincount(of, (length - mean[of]) ** 2, n) + USUAL_WORDS * USUAL["word_spread"] ** 2
    spread = np.sqrt(square / (total + USUAL_WORDS))
    short = np.bincount(of, length <= 3, n)
    h = K.byte_hashes(data, starts, ends)
    again = np.bincount(of[1:], (h[1:] == h[:-1]) & (of[1:] == of[:-1]), n) if len(h) else np.zeros(n)
    key = np.sort((of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    run = K.distinct_runs(key)
    owner = (key[run] >> np.uint64(40)).astype(np.int64)
    distinct, top = np.bincount(owner, minlength=n), np.zeros(n)
    np.maximum.at(top, owner, np.diff(np.append(run, len(key))))
    return np.column_stack(
        [
            np.log1p(total),
            np.log1p(mean),
            np.log1p(spread),
            _share("upper", counts[:, _UPPER], counts[:, _UPPER] + counts[:, _LOWER], USUAL_BYTES),
            _share("digit", counts[:, _DIGIT], solid, USUAL_BYTES),
            _share("stop_mark", counts[:, _MARK], solid, USUAL_BYTES),
            _share("symbol", counts[:, _SYMBOL], solid, USUAL_BYTES),
            _share("short", short, total, USUAL_WORDS),
            _share("distinct", distinct, total, USUAL_WORDS),
            _share("adjacent", again, total, USUAL_WORDS),
            _share("top", top, total, USUAL_WORDS),
            np.log1p((total + USUAL["line_words"]) / (lines + 1)),
        ]
    )


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each whole text."""
    parts = [_block(texts[a:b]) for a, b in K.blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and log terms, over scaled statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiten: np.ndarray
    log_term: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        log_density = [t - 0.5 * (((z - m) @ w.T) ** 2).sum(1) for m, w, t in zip(self.means, self.whiten, self.log_term, strict=True)]
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def fit(labelled: DataFrame, label: str = "quality", pooled: float = SHRINK_POOLED, identity: float = SHRINK_IDENTITY) -> Discriminant:
    """Fit on every row of ``labelled``, which has ``label`` in {0, 1} and, as last column, the statistics.

    Only sums leave the executors: their number depends on the statistics, not on the rows.
    """
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.get(labelled.columns[-1], i) for i in range(d)]
    sums = [F.count("*"), *[F.sum(c) for c in x], *[F.sum(x[i] * x[j]) for i, j in pairs]]
    rows = labelled.where(F.col(label).isin(0, 1)).groupBy(label).agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).collect()
    by = {int(r[0]): r[1:] for r in rows}
    n = np.array([by[c][0] if c in by else 0 for c in (0, 1)], float)
    share = n[1] / n.sum() if n.sum() else 0.5
    if n.min() < 2:
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), share)
    means, scatter = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        means[c] = np.array(by[c][1 : d + 1]) / n[c]
        for (i, j), s in zip(pairs, by[c][d + 1 :], strict=True):
            scatter[c, i, j] = scatter[c, j, i] = s - n[c] * means[c, i] * means[c, j]
    within = scatter.sum(0) / n.sum()
    centre, scale = means.mean(0), np.sqrt(np.maximum(np.diag(within), 1e-8))
    means, scatter = (means - centre) / scale, scatter / np.outer(scale, scale)
    shared = scatter.sum(0) / n.sum()
    shared = (1 - identity) * shared + identity * np.trace(shared) / d * np.eye(d)
    whiten, log_term = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - pooled) * scatter[c] / n[c] + pooled * shared)
        whiten.append(np.linalg.solve(factor, np.eye(d)))
        log_term.append(math.log(n[c]) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, means, np.array(whiten), np.array(log_term), share)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and, last, ``statistics``: the array of the statistics of column text."""
    name = free_name(docs, "statistics")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"{name} array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(K.as_bytes(batch.column("text")))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(STATISTICS), dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, name])

    small_batches(docs.sparkSession)
    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, "text"])]).mapInArrow(run, schema)


def with_score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``stats`` (any columns and, last, the statistics) with ``score`` instead of the statistics."""
    *keep, name = stats.columns
    score = free_name(stats, "score")
    schema = ", ".join([*(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in keep), f"{score} double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(name).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.score(x))], names=[*keep, score])

    return stats.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fit on the labelled rows of ``stats`` (doc_id and, last, the statistics) outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull()).select("doc_id", label).where(~held_out(F.col("doc_id")))
    return fit(known.join(stats.select("doc_id", F.col(f"`{stats.columns[-1]}`").alias("statistics")), "doc_id"), label)


def reject_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``. Each text is read by the kernel once."""
    stats = stash(with_statistics(docs, docs.columns), "quality")
    scored = with_score(stats, train(stats, labels))
    return scored.where(F.col(f"`{scored.columns[-1]}`") >= threshold).select(*[f"`{c}`" for c in docs.columns])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stash(with_statistics(table(spark, sf_dir, "documents"), ["doc_id"]), "quality")
    model = train(stats, table(spark, sf_dir, "labels"))
    scored = with_score(stats, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.round("score", 9).alias("score"), (F.round("score", 9) >= THRESHOLD).cast("int").alias("predicted"))
