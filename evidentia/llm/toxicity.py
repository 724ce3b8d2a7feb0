"""Toxicity by a counterfactual-regularised classifier.

A text is the set of its words (A-Z lowered, marks at their edges cut off), hashed into 2^18 places. A sparse logistic model is
fitted with an L1 penalty; in every training sentence with an identity term, and in neutral carrier sentences, each
term is swapped for each other one of its list, and the squared change of the score's logit is added to the loss. Group
mentions alone therefore cannot carry weight: the model can learn only from the words around them.

A text is judged by its most telling words: its logit is the bias plus the weights of its distinct words, so one toxic
passage counts the same in a long text as in a short one.

The fit sees at most `most_labels` labelled texts, picked by a hash of the id. Scoring is one map over the table with a
broadcast of 2^18 weights, whatever the input.

Cases: a null or empty text scores by the bias alone; a very long text is its set of words like any other; null ids are scored but never train; repeated rows are scored each; without labels
of both kinds every score is the share of label 1 (0 if there is none); an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import text as T

BITS = 18
MOST_LABELS = 20_000
#: Fixed list: identity terms that may be swapped for each other.
IDENTITY_TERMS = (
    "women", "men", "girls", "boys", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino", "immigrant", "immigrants",
    "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "atheist", "disabled", "deaf", "blind", "old", "young",
)
#: Fixed list: neutral sentences for terms that training texts lack.
CARRIERS = ("i am {}", "my friends are {}", "the {} people came by", "she said that they were {}")
_EDGE_MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_"


def _words(text: str) -> set[str]:
    return {x for x in (w.strip(_EDGE_MARKS) for w in _lower(text).split()) if x}


def _lower(text: str) -> str:
    return text.lower() if text.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def places(words: set[str]) -> np.ndarray:
    """Sorted hashed places of a set of words."""
    if not words:
        return np.zeros(0, np.int32)
    w = next(T.words(pa.array([" ".join(words)])))
    return np.unique((w.hashes >> np.uint64(64 - BITS)).astype(np.int32))


def text_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all texts end to end (distinct in each text), and the texts' bounds.

    Edge marks are cut by moving the start and end of each word over the bytes of such marks.
    """
    mark = np.zeros(256, bool)
    mark[[ord(c) for c in _EDGE_MARKS]] = True
    found, counts = [], []
    for w in T.words(texts):
        n = w.last - w.first
        s, e = w.starts.copy(), w.ends.copy()
        while True:  # one mark on either side of every word at a time
            move = (s < e) & mark[w.data[np.minimum(s, len(w.data) - 1)]] if len(s) else np.zeros(0, bool)
            s[move] += 1
            back = (s < e) & mark[w.data[np.maximum(e - 1, 0)]] if len(s) else np.zeros(0, bool)
            e[back] -= 1
            if not move.any() and not back.any():
                break
        h = w.spans(s, e)
        key = (w.owners().astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64)
        key = np.unique(key[s < e])
        found.append((key & ((1 << BITS) - 1)).astype(np.int32))
        counts.append(np.bincount(key >> BITS, minlength=n))
    if not found:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def score(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[at])])
        return 1 / (1 + np.exp(-np.clip(total[bounds[1:]] - total[bounds[:-1]] + self.bias, -40, 40)))


def swaps(rows: list[np.ndarray], terms: tuple[str, ...] = IDENTITY_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Every sentence's swaps: (row, place taken out), (place put in) for each term of the row and each other term that it lacks.

    Returns pairs (out, in) of places and how many sentences make each swap: a swap changes a sentence's logit by the weight put in less
    the weight taken out, whatever its other words, so the penalty over all swapped sentences is a sum over pairs with these counts.
    """
    at = np.array([int(places({t})[0]) for t in terms])
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    has = np.zeros((len(rows), len(terms)), bool)
    order = np.argsort(at)
    held = np.isin(flat, at)
    has[owner[held], order[np.searchsorted(at[order], flat[held])]] = True
    # sentences that hold a and lack b
    counts = has.astype(np.int64).T @ (~has).astype(np.int64)
    a, b = np.nonzero(counts)
    return np.stack([at[a], at[b]], axis=1), counts[a, b]


def _telling(rows: list[np.ndarray], labels: np.ndarray, least_texts: int, least_z: float) -> np.ndarray:
    """Places whose share of texts differs between the labels."""
    n1 = labels.sum()
    n0 = len(labels) - n1
    one = np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y] or [np.zeros(0, int)]), minlength=1 << BITS)
    zero = np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if not y] or [np.zeros(0, int)]), minlength=1 << BITS)
    p = (one + zero + 1) / (n1 + n0 + 2)
    z = (one / n1 - zero / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return (np.abs(z) >= least_z) & (one + zero >= least_texts)


def fit(rows: list[np.ndarray], labels: np.ndarray, terms: tuple[str, ...] = IDENTITY_TERMS, swap_penalty: float = 1.0, l1: float = 2e-4,
        steps: int = 500, least_texts: int = 3, least_z: float = 3.0) -> ToxicityModel:
    """Accelerated proximal descent on the words whose share among the two labels differs by `least_z` standard errors, and the terms."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not len(labels) or share in (0.0, 1.0):
        p = min(max(share, 1e-9), 1 - 1e-9)
        return ToxicityModel(np.zeros(1 << BITS), float(np.log(p / (1 - p))) if share else -40.0)
    carriers = [places(_words(c.format(t))) for c in CARRIERS for t in terms]
    x = rows + carriers
    y = np.concatenate([labels, np.zeros(len(carriers))])
    # a carrier counts little: it is there for its term, not for its other words
    heavy = np.concatenate([np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum())), np.full(len(carriers), 0.02 / len(carriers))])
    flat, owner = np.concatenate(x), np.repeat(np.arange(len(x)), [len(r) for r in x])
    term_places = np.concatenate([places({t}) for t in terms])
    keep = _telling(rows, labels, least_texts, least_z)
    keep[term_places] = True
    keep = keep[flat]
    flat, owner = flat[keep], owner[keep]
    used, col = np.unique(flat, return_inverse=True)
    pairs, times = swaps(x, terms)
    swapped = np.searchsorted(used, pairs)
    share_of = swap_penalty * times / max(1, times.sum())
    # a diagonal bound of the curvature: each text's words move together, each term is in many swaps
    words_of = np.bincount(owner, minlength=len(x)) + 1.0
    curve = 0.25 * np.bincount(col, weights=(heavy * words_of)[owner], minlength=len(used)) + 1e-9
    curve += 2 * np.bincount(swapped.ravel(), weights=np.repeat(share_of, 2), minlength=len(used))
    curve_b = 0.25 * float((heavy * words_of).sum())
    w, b = np.zeros(len(used)), 0.0
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        z = np.bincount(owner, weights=ahead_w[col], minlength=len(x)) + ahead_b
        miss = heavy * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        g = np.bincount(col, weights=miss[owner], minlength=len(used))
        gap = share_of * (ahead_w[swapped[:, 0]] - ahead_w[swapped[:, 1]])
        g += np.bincount(swapped[:, 0], weights=gap, minlength=len(used)) - np.bincount(swapped[:, 1], weights=gap, minlength=len(used))
        new = ahead_w - g / curve
        new = np.sign(new) * np.maximum(np.abs(new) - l1 / curve, 0)
        new_b = ahead_b - miss.sum() / curve_b
        t, pull = (1 + np.sqrt(1 + 4 * t * t)) / 2, (t - 1) / ((1 + np.sqrt(1 + 4 * t * t)) / 2)
        ahead_w, ahead_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return ToxicityModel(weights, float(b))


def _places_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, bounds = text_places(batch.column(0))
        yield pa.record_batch([batch.column(1), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(at))], names=["label", "at"])


def train(documents: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> ToxicityModel:
    """documents(id, text), labels(id, label 0/1): a bounded sample of the labelled ids by a hash of the id; of several rows of one id the text with the least hash."""
    picked = labels.where("id IS NOT NULL AND label IS NOT NULL").dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(most_labels)
    # at most most_labels rows: a bounded side
    once = documents.join(F.broadcast(picked), "id").groupBy("id", F.col("label").cast("int").alias("label")).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = once.select("text", "label").mapInArrow(_places_task, "label int, at array<int>").toArrow()
    at = rows.column("at").combine_chunks()
    flat, offs = at.flatten().to_numpy(), np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])
    y = rows.column("label").to_numpy()
    texts = [flat[offs[k] : offs[k + 1]] for k in range(len(y))]
    order = sorted(range(len(y)), key=lambda k: (y[k], len(texts[k]), texts[k].tobytes()))  # arrival order must not matter
    return fit([texts[k] for k in order], y[order].astype(float))


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """documents(id, text) -> id, score."""
    # plain arrays are sent: workers may know this package's classes by value only
    fields = {k: v for k, v in vars(model).items()}
    sent = documents.sparkSession.sparkContext.broadcast(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = ToxicityModel(**sent.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(judge.score(*text_places(batch.column(1))))], names=["id", "score"])

    return documents.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, score double")
