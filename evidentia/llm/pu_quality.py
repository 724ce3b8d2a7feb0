"""Quality classifier by positive-unlabelled learning.

Trusted positives are the training rows labelled 1; everything else is unlabelled. The class prior of the unlabelled texts is
estimated from the scores of a first positive-against-unlabelled fit: over the scores' tails, the least ratio of the
unlabelled mass to the positive mass bounds the share of positives. The final model minimises the non-negative
unbiased risk prior * R_p+ + max(0, R_u- - prior * R_p-) with the logistic loss.

Features come from whole texts in one pass: shares of the pairs of neighbouring character classes (letters by case, digits, blanks,
line ends, sentence marks, symbols, bars, ...), and word statistics. They are bounded in number, need no vocabulary and no label.

The fit sees at most `most_positives` and `most_unlabelled` texts, picked by a hash of the id: bounded samples of labelled and
unlabelled rows. Scoring sees every row, in one map over the table with a model of a few kilobytes.

Cases: a null or empty text has all-zero features and gets a score; a very long text is read whole; null ids are scored but never train; repeated rows are scored
each; without positives or without unlabelled texts every score is 0.5; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import text as T

#: Fixed classes of bytes; all bytes of 128 and more are one class, of letters.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "|", "#*$%&<>@~^", "\"'()-/")
N_CLASSES = len(CLASSES) + 2
N_WORD_FEATURES = 7
N_FEATURES = N_CLASSES * N_CLASSES + N_WORD_FEATURES
MOST_POSITIVES = 20_000
#: Standard deviations beyond which a feature says no more, in the fit and in scores.
CLIP = 8.0
MOST_UNLABELLED = 20_000


def _class_of() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.int64)
    for k, chars in enumerate(CLASSES):
        for c in chars:
            out[ord(c)] = k
    out[128:] = len(CLASSES) + 1
    return out


def features(texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES for each text."""
    kinds = _class_of()
    rows = []
    for w in T.words(texts):
        n = w.last - w.first
        out = np.zeros((n, N_FEATURES))
        sizes = np.diff(w.offsets)
        if len(w.data):
            owner = np.repeat(np.arange(n), sizes)
            k = kinds[w.data]
            pair = owner[:-1] * N_CLASSES**2 + k[:-1] * N_CLASSES + k[1:]
            pair = pair[owner[:-1] == owner[1:]]
            out[:, : N_CLASSES**2] = np.bincount(pair, minlength=n * N_CLASSES**2).reshape(n, -1) / np.maximum(1, sizes)[:, None]
            counts = np.diff(w.bounds)
            lengths = (w.ends - w.starts).astype(float)
            own = w.owners()
            total = np.bincount(own, weights=lengths, minlength=n)
            distinct = np.zeros(n)
            order = np.lexsort((w.hashes, own))
            h, o = w.hashes[order], own[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            distinct = np.bincount(o[first], minlength=n)
            many = np.maximum(1, counts)
            extra = np.stack([np.log1p(counts) / 10, total / many / 20, distinct / many, counts < 20, np.bincount(own, weights=lengths > 20, minlength=n) / many, counts == 0, np.bincount(own[1:], weights=(w.hashes[1:] == w.hashes[:-1]) & (own[1:] == own[:-1]), minlength=n) / many], axis=1)
            out[:, N_CLASSES**2 :] = extra
        rows.append(out)
    return np.concatenate(rows) if rows else np.zeros((0, N_FEATURES))


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _squash(np.clip((x - self.mean) / self.scale, -CLIP, CLIP) @ self.weights + self.bias)


def _descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam on a parameter vector."""
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least_mass: float = 0.25) -> float:
    """Share of positives among the unlabelled: the least ratio of tail masses, over tails that hold enough positives."""
    cuts = np.quantile(positive, np.linspace(0, 1 - least_mass, 60))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    return float(np.clip((u / p).min(), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 2e-3) -> QualityModel:
    """Non-negative PU fit on feature rows."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros(N_FEATURES), 0.0, np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.5)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale[scale < 1e-6] = 1.0
    p, u = np.clip((positive - mean) / scale, -CLIP, CLIP), np.clip((unlabelled - mean) / scale, -CLIP, CLIP)
    p, u = (np.concatenate([x, np.ones((len(x), 1))], axis=1) for x in (p, u))
    ridge = np.full(p.shape[1], decay + 3.0 / len(p))  # few positives, little trust
    ridge[-1] = 0

    # the prior is read off texts that the first fit has not seen: two halves judge each other
    tails = []
    for half in (0, 1):
        a, c = p[half::2], u[half::2]

        def plain(theta: np.ndarray, a: np.ndarray = a, c: np.ndarray = c) -> np.ndarray:
            return -a.T @ (1 - _squash(a @ theta)) / len(a) + c.T @ _squash(c @ theta) / len(c) + 10 * ridge * theta

        if len(a) and len(c) and len(p) > 1 and len(u) > 1:
            first = _descend(plain, p.shape[1], steps // 2, rate)
            tails.append((p[1 - half :: 2] @ first, u[1 - half :: 2] @ first))
    prior = float(np.mean([class_prior(a, c) for a, c in tails])) if tails else 0.5

    def risk(theta: np.ndarray) -> np.ndarray:
        sp, su = _squash(p @ theta), _squash(u @ theta)
        up = -p.T @ (1 - sp) / len(p)
        negative = np.mean(np.logaddexp(0, np.clip(u @ theta, -40, 40))) - prior * np.mean(np.logaddexp(0, np.clip(p @ theta, -40, 40)))
        down = u.T @ su / len(u) - prior * p.T @ sp / len(p)
        # below zero the negative risk overfits: step back along it
        return (prior * up + down if negative >= 0 else -down) + ridge * theta

    theta = _descend(risk, p.shape[1], steps, rate / 2)
    return QualityModel(theta[:-1], float(theta[-1]), mean, scale, prior)


def _feature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(0)).astype(np.float32)
        yield pa.record_batch([batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))], names=["kind", "x"])


def train(documents: DataFrame, positives: DataFrame, most_positives: int = MOST_POSITIVES, most_unlabelled: int = MOST_UNLABELLED) -> QualityModel:
    """documents(id, text), positives(id). Bounded samples by a hash of the id, all other documents being unlabelled; of several rows of one id the text with the least hash."""
    by_hash = [F.xxhash64("id"), F.col("id")]
    pos = positives.where("id IS NOT NULL").distinct().orderBy(*by_hash).limit(most_positives)
    ids = documents.select("id").where("id IS NOT NULL").distinct()
    unl = ids.join(positives.select("id").distinct(), "id", "left_anti").orderBy(*by_hash).limit(most_unlabelled)
    picked = pos.select("id", F.lit(1).alias("kind")).unionByName(unl.select("id", F.lit(0).alias("kind")))
    # at most most_positives + most_unlabelled ids: a bounded side
    once = documents.join(F.broadcast(picked), "id").groupBy("id", "kind").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = once.select("text", "kind").mapInArrow(_feature_task, "kind int, x array<float>").toArrow()
    kind = rows.column("kind").to_numpy()
    x = np.array(rows.column("x").combine_chunks().flatten().to_numpy(), float).reshape(-1, N_FEATURES)
    order = np.lexsort((*x.T, kind))  # arrival order must not matter
    return fit(x[order][kind[order] == 1], x[order][kind[order] == 0])


def score(documents: DataFrame, model: QualityModel) -> DataFrame:
    """documents(id, text) -> id, score."""
    # plain arrays are sent: workers may know this package's classes by value only
    fields = {k: v for k, v in vars(model).items()}
    sent = documents.sparkSession.sparkContext.broadcast(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = QualityModel(**sent.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(judge.score(features(batch.column(1))))], names=["id", "score"])

    return documents.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, score double")
