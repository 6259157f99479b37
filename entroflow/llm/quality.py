"""Quality scores from Bradley-Terry pairwise ranking.

Labelled rows form preference pairs (a row of label 1 over a row of label 0). A document's worth is linear in features
of its whole text; logistic loss on feature differences of the pairs fits the weights by Newton's method. The threshold
is a quantile of the fitted worths, the one that splits the labels best, and scores are shifted so that it lies at 0.7.

The classifier is fitted on a bounded sample of labelled rows: PER_LABEL rows of each label, those with the smallest
hash of doc_id, and PAIRS pairs of them. Every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

PER_LABEL = 3000
PAIRS = 30_000
CUT = 0.7
FEATURES = ("upper", "symbols", "digits", "repeats", "distinct", "word_length", "same_lines", "words")

PROSE = b".,;:'\"-()?"


def _classes() -> np.ndarray:
    b = np.arange(256)
    letter = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
    digit = (b >= 48) & (b <= 57)
    ascii_mark = (b > 32) & (b < 127) & ~letter & ~digit
    return np.stack([(b >= 65) & (b <= 90), letter, digit, ascii_mark & ~np.isin(b, list(PROSE)), b > 32], axis=1).astype(float)


CLASSES = _classes()


def features(text: str | None) -> list[float]:
    """Features of a whole text; null is empty, and an empty text has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    upper, letters, digits, symbols, seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES
    lines = raw.split(b"\n")
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        upper / max(letters, 1),
        (symbols / seen) ** 0.5,
        (digits / seen) ** 0.5,
        (repeats / n) ** 0.5,
        np.log1p(len(set(words))) / np.log1p(n),
        min(seen / n / 10, 2.0),
        1 - len(set(lines)) / len(lines),
        np.log1p(n) / 10,
    ]


@dataclass
class Ranking:
    """score = sigmoid(worth - threshold + logit(CUT)), worth = weights . (features - mean) / scale."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        worth = (x - self.mean) / self.scale @ self.weights
        z = np.clip(worth - self.threshold + np.log(CUT / (1 - CUT)), -500, 500)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 25) -> Ranking | None:
    """Fit on features x and labels y (0 or 1); None unless both labels occur."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = (x - mean) / scale
    rng = np.random.default_rng(0)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (1 - p) / pairs - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    worth = z @ w
    low, high = np.sort(worth[bad]), np.sort(worth[good])
    grid = np.unique(np.quantile(worth, np.linspace(0, 1, 2001)))
    # A document of label 1 that falls below the threshold weighs as much as one of label 0 above it.
    wrong = np.searchsorted(high, grid) / len(high) + 1 - np.searchsorted(low, grid) / len(low)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    upper = grid[best[-1]]
    below = worth[worth < upper]
    return Ranking(mean, scale, w, float((upper + below.max()) / 2 if len(below) else upper))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Ranking | None:
    """Fit on rows of docs (doc_id, text) that labels (doc_id, quality) marks and that aren't held out.

    Null ids and null qualities teach nothing; a doc_id with both labels counts as 0.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(*order).limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_label rows: safe to broadcast, so no text is shuffled.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], ["quality", "x"])

    rows = sample.mapInArrow(run, "quality long, x array<double>").collect()
    if not rows:
        return None
    rows = sorted((r.quality, tuple(r.x)) for r in rows)
    return fit(np.array([x for _, x in rows]), np.array([q for q, _ in rows]))


def score_quality(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """Score each row of (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts are scored by their (zero) features. Without a ranking, when no pair was labelled, each row
    scores CUT and passes. Rows map one to one; repeated rows score alike, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = b.column(2).to_pylist()
            x = np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            s = ranking.score(x) if ranking else np.full(len(texts), CUT)
            predicted = pa.array((s >= CUT).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), predicted], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """The rows of docs whose text is predicted 1, with all their columns; scored in one pass without a shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            if ranking and b.num_rows:
                b = b.filter(pa.array(ranking.score(np.array([features(t) for t in b.column(at).to_pylist()])) >= CUT))
            yield b

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
