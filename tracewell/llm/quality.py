"""Quality by Bradley-Terry ranking.

Documents of label 1 are preferred to documents of label 0. A document's strength is linear in features of its
whole text, and a preference pair's probability is the logistic function of the difference of strengths; the
weights minimise the logistic loss over pairs of labelled documents, on differences of features. Strengths are
mapped to 0..1 by a logistic curve fitted to the same labels, which keeps their order. Documents are then
thresholded by a quantile of the scores.

The model is fitted on a bounded sample of labelled documents (``MAX_LABELS``, those with the least hash of their
id); everything else runs over all rows, in one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import row_type

#: Labelled documents that the model is fitted on, at most.
MAX_LABELS = 20_000
#: Preference pairs drawn from them for each document of the scarcer label.
PAIRS_EACH = 20

_CLASSES = (b"!", b"|", b"#$%&*@^_~<>=+{}[]\\/", b".,;:'\"()-?", b"0123456789", bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)), b"\n", bytes(range(0x80, 0x100)))
_MATRIX = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _MATRIX[list(_c), _i] = 1.0


def features(text: str | None) -> np.ndarray:
    """Features of a whole text: shares of character classes, and how words and lines repeat. An empty or null text has all zeros."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return np.zeros(2 * (len(_CLASSES) + 8))
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _MATRIX / len(data)
    counts, lines = Counter(words), [line for line in data.split(b"\n") if line]
    n = len(words)
    letters = shares[5] + shares[6] + 1e-9
    base = np.array([
        *shares, shares[5] / letters, len(data) / n / 10, len(counts) / n, max(counts.values()) / n, sum(map(bytes.isupper, words)) / n,
        1 - len(set(lines)) / max(1, len(lines)), min(1.0, 10 / n), min(1.0, len(lines) / n),
    ])
    return np.concatenate([base, np.log(base + 0.003)])


@dataclass(frozen=True)
class Ranker:
    """Weights of the strengths, and the curve from strengths to scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float
    #: Share of the labelled documents with label 0: the quantile that parts them.
    share: float
    #: The score at that quantile of the labelled documents: those above it are as many as have label 1.
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.strength(x) + self.offset, -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray | None, ridge: float, rounds: int = 25) -> np.ndarray:
    """Weights of least logistic loss by Newton steps; without y every row is a win."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (p - (1.0 if y is None else y)) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        w = w - (step := np.linalg.solve(bend, slope))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Ranker:
    """Learn from feature rows and labels 0 and 1. With one label only, every score is that label's smoothed share."""
    share = float((1 - y).mean()) if len(y) else 0.5
    width = x.shape[1]
    if len(np.unique(y)) < 2:
        level = (y.sum() + 1) / (len(y) + 2)
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width), 1.0, float(np.log(level / (1 - level))), share, 0.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = PAIRS_EACH * min(len(better), len(worse))
    weights = _logistic(z[rng.choice(better, n)] - z[rng.choice(worse, n)], None, ridge=1.0)
    strength = z @ weights
    slope, offset = _logistic(np.column_stack([strength, np.ones(len(y))]), y, ridge=1e-3)
    score = 1 / (1 + np.exp(-np.clip(slope * strength + offset, -35, 35)))
    return Ranker(mean, scale, weights, float(slope), float(offset), share, float(np.quantile(score, share, method="lower")))


def held_out(doc_id):
    """The documents whose labels are never learned from: crc32 of the id as text leaves no remainder by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Ranker:
    """Fit on at most ``max_labels`` labelled documents that aren't held out.

    Rows without doc_id or quality are left out; several labels of a document count as their mean, rounded. Labels
    without a document are left out; of several texts of a document the least counts, so no more than ``max_labels``
    rows reach the driver. Without any label every score is one half.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    )

    def run(batches):
        for batch in batches:
            rows = [features(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])

    # the sample is bounded by max_labels rows of two numbers, so it is broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("_y").alias("_y"), F.min("text").alias("text"))
    rows = rows.select("_y", "text").mapInArrow(run, "y double, x array<double>").toArrow()
    y = np.array(rows.column("y").to_pylist(), float)
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(y), -1) if len(y) else np.zeros((0, len(features(None))))
    order = np.lexsort((*x.T, y)) if len(y) else np.arange(0)  # rows come in any order; the fit must not depend on it
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Ranker, column: str = "score") -> DataFrame:
    """``docs`` with all its columns and the score of each text (0 to 1; empty and null texts have one too); a column of that name is replaced."""
    rest = [c for c in docs.columns if c != column]
    packed = docs.select(F.struct(*rest).alias("row"), F.col("text").alias("text"))

    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]) if batch.num_rows else np.zeros((0, len(model.weights)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["row", "score"])

    scored = packed.mapInArrow(run, row_type(packed, ["row"], score="double"))
    return scored.select(*(F.col("row").getField(c).alias(c) for c in rest), F.col("score").alias(column))


def keep_best(scored: DataFrame, quantile: float, column: str = "score") -> DataFrame:
    """The rows whose score is at or above the given quantile of all scores (as ``percentile_approx`` finds it); rows of equal score stay or go together."""
    at = scored.agg(F.percentile_approx(column, quantile, 10_000)).first()[0]
    return scored if at is None else scored.where(F.col(column) >= at)


def keep_good(docs: DataFrame, model: Ranker) -> DataFrame:
    """``docs``, all its columns, without the documents that the model rejects: scores at or below the quantile of the labelled scores that parts label 0 from label 1.

    A model fitted on one label or on none rejects nothing. Repeated rows stay or go together.
    """
    whole = docs.select("text", F.struct(*docs.columns).alias("whole"))
    return score(whole, model).where(F.col("score") > model.threshold).select("whole.*")


def digest_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
