"""Language-model scoring with a log-frequency Bloom filter.

Counting. Every training text gives hashed n-grams of orders 1..`order` (words with A-Z lowered, then one end
token). Tasks send sorted (hash, count) runs, cut by hash range, through one shuffle; each range is summed where it
arrives, so counts are exact over all training texts and nothing is gathered.

Model. A count c is quantised to q = 1 + floor(log_b c) and the keys (gram, 1..q) are put in a Bloom filter. Each hash range owns
its own stretch of the filter, sized by its own keys, so a range's bits are made where its counts are summed and the counts themselves
are not kept. The filter grows with the n-grams, so a key has as many bits at any size; it is broadcast in slices of whole ranges, of
`most_filter_bytes` at most. An n-gram seen once is at level 1 (one key).

Scoring. A count is read back by probing (gram, 1), (gram, 2), ... until a probe fails; a run of j hits stands for the middle of
[b^(j-1), b^j). A task scores a group of texts of bounded size at a time and passes over it once for each slice, holding one slice in
memory; every key is answered by the slice of its range, so the cut into slices changes no score. Probabilities interpolate the orders with Witten-Bell-like weights; order 1 is add-half smoothed.

The base score needs exact counts of every word. The most frequent words, `head_words` at most, are broadcast and
cover nearly all tokens; the other (word, text) pairs are rare by definition and meet the exact counts in a shuffle join.

Cases: a null or empty text is its end token; very long texts are read whole, a group of their own; other columns are not read, whatever their names; a null id has no remainder, so it trains and is not held out; repeated rows are scored
one by one, and each counts in training; an empty table gives no rows; with no training text every count is 0 (V = 0, N = 0).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import text as T
from evidentia.session import Tables, small_batches

END = np.uint64(0xE7037ED1A0B428DB)
#: Hash ranges: a power of two from 64 up, two for each input partition, so that a range's counts fit a task at any size.
RANGES = (64, 1 << 16)
HEAD_WORDS = 1 << 18
#: Of one slice of the filter; the filter itself has no bound.
MOST_FILTER_BYTES = 32 << 20
#: Bytes of text that a task passes over together when the filter has several slices.
GROUP_BYTES = 6 << 20
PROBES = 2
BITS_PER_KEY = 10
LOG_BASE = 2.0
_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def token_stream(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk with the end token after each text, and the texts' bounds."""
    ends = w.bounds[1:]
    tokens = np.insert(w.hashes, ends, END)
    bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
    return tokens, bounds


def gram_hashes(tokens: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each token, and whether it lies inside its text."""
    if order == 1:
        return tokens, np.ones(len(tokens), bool)
    out = np.zeros(len(tokens), np.uint64)
    grams = T.ngram_hashes(tokens, order)
    out[order - 1 :] = grams ^ np.uint64(order)
    return out, gram_inside(tokens, bounds, order)


def gram_inside(tokens: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """Whether the n-gram that ends at each token lies inside its text."""
    inside = np.ones(len(tokens), bool)
    for k in range(order - 1):
        at = bounds[:-1] + k
        inside[at[at < len(tokens)]] = False
    return inside


def _run(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = np.unique(hashes, return_counts=True)
    return hashes, counts


def _count_task(order: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {n: [] for n in range(1, order + 1)}
        size = 0
        for batch in batches:
            for w in T.words(batch.column(0)):
                tokens, bounds = token_stream(w)
                for n in held:
                    h, inside = gram_hashes(tokens, bounds, n)
                    held[n].append(h[inside])
                size += len(tokens)
                if size > 4_000_000:
                    yield from _flush(held, ranges)
                    size = 0
        yield from _flush(held, ranges)

    return run


def _flush(held: dict[int, list[np.ndarray]], ranges: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for n, parts in held.items():
        if parts:
            hashes, counts = _run(np.concatenate(parts))
            parts.clear()
            edges = np.searchsorted(_range_of(hashes, ranges), np.arange(ranges + 1))
            for r in range(ranges):
                a, z = edges[r], edges[r + 1]
                if a < z:
                    # 40 bits tell the n-grams of a range apart for the filter; words keep all 64
                    keys = hashes[a:z]
                    packed = keys.astype("<u8").tobytes() if n == 1 else _pack40(keys)
                    rows.append((n * ranges + r, packed, np.minimum(counts[a:z], 2**31 - 1).astype("<u4" if counts[a:z].max() > 255 else "u1").tobytes()))
    if rows:
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["part", "keys", "counts"])


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int64)


def _pack40(keys: np.ndarray) -> bytes:
    """Bytes 2..6 of each key, counted from the top: with the first six bits of the range, 46 bits of the hash. Stored as five byte planes, which compress."""
    rows = (keys & np.uint64((1 << 58) - 1)) >> np.uint64(18)
    return np.ascontiguousarray(rows.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _unpack40(data: bytes, r: int, ranges: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(5, -1)
    rows = np.zeros((planes.shape[1], 8), np.uint8)
    rows[:, :5] = planes.T
    return (rows.view("<u8").ravel().astype(np.uint64) << np.uint64(18)) | (np.uint64(r * 64 // ranges) << np.uint64(58))


def reduced(h: np.ndarray) -> np.ndarray:
    """The part of an n-gram hash that the filter knows."""
    return h & ~np.uint64((1 << 18) - 1)


class _Sums:
    """Sums of runs of one part, merged when the waiting ones outgrow what is merged: memory follows the distinct keys."""

    def __init__(self):
        self.keys, self.counts, self.wait, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.wait.append((keys, counts))
        self.n += len(keys)
        if self.n > max(1_000_000, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        if self.wait:
            keys = np.concatenate([self.keys, *(k for k, _ in self.wait)])
            counts = np.concatenate([self.counts, *(c for _, c in self.wait)])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
            self.wait, self.n = [], 0


def _sum_task(ranges: int):
    """Rows sorted by range -> for each range the bits of its stretch of the filter, and its words with their exact counts."""

    def finish(r: int, sums: dict[int, _Sums]) -> pa.RecordBatch:
        filled, words = [], None
        for n, s in sums.items():
            s.merge()
            filled.append((reduced(s.keys) if n == 1 else s.keys, quantise(s.counts)))
            if n == 1:
                words = s
        stretch = (BITS_PER_KEY * sum(int(q.sum()) for _, q in filled) // 8 + 8) * 8
        bits = np.zeros(stretch, bool)
        for k, q in filled:
            for level in range(1, int(q.max(initial=0)) + 1):
                for at in _places(k[q >= level], level, stretch):
                    bits[at] = True
        h, c = (words.keys, words.counts) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        row = (r, np.packbits(bits, bitorder="little").tobytes(), len(h), int(c.sum()), h.astype("<u8").tobytes(), c.astype("<i8").tobytes())
        return pa.record_batch([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["r", "bits", "types", "tokens", "h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, _Sums] = {}
        now = None
        for batch in batches:
            for part, keys, counts in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                part, keys, counts = part.as_py(), keys.as_buffer(), counts.as_buffer()
                n, r = divmod(part, ranges)
                if now is not None and r != now:
                    yield finish(now, sums)
                    sums = {}
                now = r
                k = np.frombuffer(keys, "<u8") if n == 1 else _unpack40(keys, r, ranges)
                c = np.frombuffer(counts, "u1" if counts.size == len(k) else "<u4").astype(np.int64)
                sums.setdefault(n, _Sums()).add(k, c)
        if now is not None:
            yield finish(now, sums)

    return run


def quantise(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(LOG_BASE) + 1e-9).astype(np.int64)


def middle(levels: np.ndarray) -> np.ndarray:
    """The count that a run of so many hits stands for; 0 for none, 1 for one."""
    return np.where(levels > 0, (LOG_BASE ** (levels - 1) + LOG_BASE**levels - 1) / 2, 0.0)


def _places(keys: np.ndarray, level: int, stretch) -> list[np.ndarray]:
    """Bits of (key, level) within a stretch of so many bits (one, or one for each key)."""
    h = T.mix(keys + np.uint64(level * 0xD6E8FEB86659FD93 % 2**64))
    return [(((h * np.uint64(s)) >> np.uint64(32)).astype(np.int64) & 0xFFFFFFFF) % stretch for s in _SALTS[:PROBES]]


@dataclass
class Slice:
    """The bits of the ranges first, first + 1, ... of the filter, and where each one's stretch begins; what a pass broadcasts."""

    bits: np.ndarray
    first: int
    begins: np.ndarray
    ranges: int

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Hits of repeated membership probes; 0 for keys of other ranges."""
        keys = reduced(keys)
        levels = np.zeros(len(keys), np.uint8)
        r = _range_of(keys, self.ranges) - self.first
        alive = np.flatnonzero((r >= 0) & (r < len(self.begins) - 1))
        alive = alive[self.begins[r[alive] + 1] > self.begins[r[alive]]]
        for level in range(1, 64):
            if not len(alive):
                break
            hit = np.ones(len(alive), bool)
            begin = self.begins[r[alive]]
            for at in _places(keys[alive], level, self.begins[r[alive] + 1] - begin):
                at += begin
                hit &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            levels[alive] = level
        return levels


@dataclass
class Model:
    """The totals, and the stored bits that the filter's slices are made of; sizes: bytes of each range's bits."""

    table: DataFrame
    sizes: np.ndarray
    order: int
    tokens: int
    types: int
    most_filter_bytes: int

    def slices(self) -> Iterator[Slice]:
        first, ranges = 0, len(self.sizes)
        while first < ranges:
            last = max(first + 1, int(np.searchsorted(np.cumsum(self.sizes[first:]), self.most_filter_bytes, side="right")) + first)
            begins = np.concatenate([[0], np.cumsum(self.sizes[first:last])])
            own = self.table.select("r", "bits")
            bits = np.zeros(int(begins[-1]), np.uint8)
            for row in (own if last - first == ranges else own.where(F.col("r").between(first, last - 1))).toLocalIterator():
                at = begins[row["r"] - first]
                bits[at : at + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
            yield Slice(bits, first, 8 * begins, ranges)
            first = last

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Counts as the filter gives them."""
        return middle(sum((s.levels(keys).astype(np.int64) for s in self.slices()), np.zeros(len(keys), np.int64)))

    def scorer(self) -> Scorer:
        return Scorer(self.order, self.tokens, self.types)


@dataclass
class Scorer:
    """Probabilities from the levels read back; what a task needs beside the filter."""

    order: int
    tokens: int
    types: int

    def log10_probabilities(self, levels: np.ndarray, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of each token after the words before it in its text."""
        counts = middle(levels[0].astype(np.int64))
        p = (counts + 0.5) / (self.tokens + 0.5 * (self.types + 1))
        history = np.concatenate([[0.0], counts[:-1]])
        for n in range(2, self.order + 1):
            inside = gram_inside(tokens, bounds, n)
            own = middle(levels[n - 1].astype(np.int64))
            own = np.minimum(own, history)
            # weight of the longer history: h / (h + discount); what it holds back goes to the shorter one
            weight = np.where(inside & (history > 0), history / (history + 10.0 * np.sqrt(history) + 5.0), 0.0)
            p = np.where(inside, weight * own / np.maximum(history, 1.0) + (1 - weight) * p, p)
            history = np.concatenate([[0.0], own[:-1]])
        return np.log10(np.minimum(p, 1.0))


def train(training_texts: DataFrame, order: int = 3, most_filter_bytes: int = MOST_FILTER_BYTES) -> tuple[Model, DataFrame]:
    """The model, and the exact counts of all training words: (h, c)."""
    ranges = min(RANGES[1], max(RANGES[0], 1 << (2 * training_texts.rdd.getNumPartitions() - 1).bit_length()))
    runs = training_texts.mapInArrow(_count_task(order, ranges), "part long, keys binary, counts binary")
    r = F.pmod("part", F.lit(ranges))
    with small_batches(training_texts.sparkSession):
        table = Tables(training_texts.sparkSession, "language-model").store(
            "filter", runs.repartition(r).sortWithinPartitions(r).mapInArrow(_sum_task(ranges), "r long, bits binary, types long, tokens long, h binary, c binary")
        )
    sizes, tokens, types = np.zeros(ranges, np.int64), 0, 0
    for row in table.select("r", F.length("bits").alias("n"), "types", "tokens").collect():  # a row for each range
        sizes[row["r"]] = row["n"]
        tokens, types = tokens + row["tokens"], types + row["types"]
    return Model(table, sizes, order, tokens, types, most_filter_bytes), table.select("h", "c").mapInArrow(_vocabulary_task, "h long, c long")


def _vocabulary_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.record_batch([pa.array(np.frombuffer(keys, "<i8")), pa.array(np.frombuffer(counts, "<i8"))], names=["h", "c"])


class _Chunk:
    """A chunk's tokens, the keys of each order, and the levels read back so far."""

    def __init__(self, w: T.Words, order: int):
        self.tokens, self.bounds = token_stream(w)
        words, back = np.unique(self.tokens, return_inverse=True)
        self.back = back.astype(np.int32)
        grams = [gram_hashes(self.tokens, self.bounds, n) for n in range(2, order + 1)]
        self.keys = [words, *(h[inside] for h, inside in grams)]
        self.inside = [inside for _, inside in grams]
        self.read = [np.zeros(len(k), np.uint8) for k in self.keys]

    def probe(self, held: Slice) -> None:
        for k, read in zip(self.keys, self.read, strict=True):
            np.maximum(read, held.levels(k), out=read)

    def levels(self) -> np.ndarray:
        out = np.zeros((len(self.keys), len(self.tokens)), np.uint8)
        out[0] = self.read[0][self.back]
        for row, inside, read in zip(out[1:], self.inside, self.read[1:], strict=True):
            row[inside] = read
        return out


def _one_slice(sent, only: bool) -> Slice:
    """The slice from its broadcast; one of several is not kept, so that a task holds one at a time."""
    held = sent.value
    if not only and getattr(sent, "_path", None):
        vars(sent).pop("_value", None)
    return held


def _groups(batches: Iterator[pa.RecordBatch], order: int, most: int) -> Iterator[list[tuple[pa.RecordBatch, list[_Chunk]]]]:
    """Runs of batches, parted where they outgrow `most` bytes."""
    group, size = [], 0
    for batch in batches:
        group.append((batch, [_Chunk(w, order) for w in T.words(batch.column(1))]))
        size += batch.nbytes
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _score_task(sent_slices, model, sent_head):
    """Scores by the model, and for the base score the sum over frequent words and the rare words left to join."""

    def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[_Chunk]]]:
        only = len(sent_slices) == 1
        for group in _groups(batches, model.order, 1 if only else GROUP_BYTES):
            for sent in sent_slices:
                held = _one_slice(sent, only)
                for _, chunks in group:
                    for c in chunks:
                        c.probe(held)
                del held
            yield from group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_counts = sent_head.value
        row = TaskContext.get().partitionId() << 33
        for batch, chunks in _probed(batches):
            n_tokens, n_known, base, score, rare, times = [], [], [], [], [], []
            for c in chunks:
                tokens, bounds = c.tokens, c.bounds
                at = bounds[:-1]
                n_tokens.append(np.diff(bounds))
                score.append(np.add.reduceat(model.log10_probabilities(c.levels(), tokens, bounds), at))
                place = np.minimum(np.searchsorted(head, tokens), max(0, len(head) - 1))
                frequent = (head[place] == tokens) if len(head) else np.zeros(len(tokens), bool)
                count = np.where(frequent, head_counts[place] if len(head) else 0, 0)
                logs = np.where(frequent, np.log10((count + 0.5) / (model.tokens + 0.5 * (model.types + 1))), 0.0)
                base.append(np.add.reduceat(logs, at))
                n_known.append(np.add.reduceat(frequent.astype(np.int64), at))
                for k in range(len(at)):
                    own = tokens[bounds[k] : bounds[k + 1]][~frequent[bounds[k] : bounds[k + 1]]]
                    own, n = np.unique(own, return_counts=True)
                    rare.append(own)
                    times.append(n)
            if not n_tokens:
                continue
            edges = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32))
            yield pa.record_batch(
                [pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), pa.array(np.concatenate(n_tokens)), pa.array(np.concatenate(n_known)), pa.array(np.concatenate(base)), pa.array(np.concatenate(score)),
                 pa.ListArray.from_arrays(edges, pa.array(np.concatenate(rare).view(np.int64))), pa.ListArray.from_arrays(edges, pa.array(np.concatenate(times).astype(np.int32)))],
                names=["row", "id", "n_tokens", "n_known", "base", "score", "rare", "times"],
            )
            row += batch.num_rows

    return run


def _head(vocabulary: DataFrame, head_words: int) -> pa.Table:
    """The words above the least count (in eighths of a doubling) that `head_words` words at most reach."""
    grade = F.floor(8 * F.log2("c"))
    graded = sorted(map(tuple, vocabulary.groupBy(grade.alias("g")).count().collect()), reverse=True)  # some hundred grades
    within = [g for (g, _), n in zip(graded, np.cumsum([n for _, n in graded]), strict=True) if n <= head_words]
    return vocabulary.where(grade >= within[-1] if within else F.lit(False)).toArrow()


def score(texts: DataFrame, model: Model, vocabulary: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """texts(id, text) -> id, n_tokens, n_known, base_score, score; a row each, ids may repeat."""
    sc = texts.sparkSession.sparkContext
    top = _head(vocabulary, head_words)
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    head = (h[order], top.column("c").to_numpy()[order])
    task = _score_task([sc.broadcast(s) for s in model.slices()], model.scorer(), sc.broadcast(head))
    with small_batches(texts.sparkSession):
        scored = Tables(texts.sparkSession, "language-model-scores").store(
            "scored", texts.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(task, "row long, id long, n_tokens long, n_known long, base double, score double, rare array<long>, times array<int>")
        )
    rare = scored.select("row", F.explode(F.arrays_zip(F.col("rare").alias("h"), F.col("times").alias("k"))).alias("e")).select("row", F.col("e.h").alias("h"), F.col("e.k").alias("k"))
    unit = F.lit(model.tokens + 0.5 * (model.types + 1))
    met = rare.join(vocabulary, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = met.groupBy("row").agg(F.sum(F.col("k") * F.log10((F.col("c") + 0.5) / unit)).alias("rb"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rk"))
    out = scored.select("row", "id", "n_tokens", "n_known", "base", "score").join(sums, "row", "left")
    return out.select("id", "n_tokens", (F.col("n_known") + F.coalesce("rk", F.lit(0))).cast("long").alias("n_known"), (F.col("base") + F.coalesce("rb", F.lit(0.0))).alias("base_score"), "score")
