"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit check.

Sequences are words (A-Z lowered). The CGK walk of a window copies the word at its place and, by a random bit of that
word and the step, stays or moves on: an edit shifts two walks for a few steps until they meet
again, so edit distance becomes Hamming distance. A bit-sampling hash is the words copied at `sampled`
random steps of the walk; `tables` such hashes give the target recall.

* The benchmark side is small and of checked size: every window start of every item is walked and hashed.
* The corpus side walks a window at every `stride`-th word of every text. A passage of n words holds about n / stride
  sampled starts, and each meets the items' windows that begin at the same word: an unedited passage is always
  found, an edited one where one of its windows agrees at the sampled steps in one table.
* The walks sample, and at the full rate their windows agree too seldom (README has the recall by length), so every corpus word
  also begins the word seeds of the pigeonhole: an item cut into int(rate * words) + 1 pieces keeps one of them unedited in
  every stretch within the rate, so no leak is missed whatever its length and edits.
* Every (document, item, place) that collides is checked: the least word edit distance between the whole
  item and any stretch of the text around the place, by dynamic programming over a batch of candidates.
  It counts as a leak at `edit_rate` * item words or fewer.

Items are grouped by length so that no walk leaves its item (a step moves by one word at most).
One pass over the texts, no shuffle; the corpus is never gathered. A benchmark larger than
`most_items_bytes` is handled in slices of that size, each its own broadcast and pass.

Recall is 1: the seeds alone reach every stretch within the rate, and the checked region around a seed holds the whole stretch.
A candidate goes to the edit program only if enough of the item's words stand in its region, which every leak fulfils.

Cases: null and empty texts and items match nothing; items of fewer than LEAST_WORDS words are too short to be
evidence and match nothing; very long texts are walked whole; repeated documents each get their rows, repeated items too; ties in distance keep the first
place; empty tables give no rows; only id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import text as T
from evidentia.session import cut

STRIDE = 4
TABLES = 12
SAMPLED = 4
LEAST_WORDS = 8
EDIT_RATE = 0.25
MOST_ITEMS_BYTES = 32 << 20
#: Steps of a walk. An item takes the longest that leaves it STRIDE window starts, so that one of them is sampled in an unedited copy.
CLASSES = (4, 8, 16, 32)
_MAP_BITS = 22


def _plans(seed: int) -> dict[int, np.ndarray]:
    """For each length class, the sampled steps of each table."""
    rng = np.random.default_rng(seed)
    return {d: np.array([np.sort(rng.choice(d, min(SAMPLED, d), replace=False)) for _ in range(TABLES)]) for d in CLASSES}


def walk_keys(hashes: np.ndarray, starts: np.ndarray, classes: list[int], plans: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """CGK walks from each start (the hashes must reach far enough) -> for each class, keys[table, start]."""
    place = starts.astype(np.int64, copy=True)
    wanted = {int(s) for d in classes for s in plans[d].ravel()}
    copied: dict[int, np.ndarray] = {}
    for step in range(max(classes)):
        at = hashes[place]
        if step in wanted:
            copied[step] = at
        place += ((at >> np.uint64(step + 7)) & np.uint64(1)).astype(np.int64)
    out = {}
    for d in classes:
        keys = np.empty((TABLES, len(starts)), np.uint64)
        for t, steps in enumerate(plans[d]):
            h = np.full(len(starts), np.uint64(0x51ED270B * (t + 1) + d), np.uint64)
            for s in steps:
                h = (h ^ copied[int(s)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            keys[t] = h
        out[d] = keys
    return out


def seeds(words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the most + 1 pieces, as even as can be, that `most` edits cannot all touch: offsets and lengths (of 1 word at least)."""
    edges = np.arange(most + 2) * len(words) // (most + 1)
    keep = np.diff(edges) > 0
    return edges[:-1][keep], np.diff(edges)[keep]


def _class(n: int) -> int:
    return max(d for d in CLASSES if d + STRIDE - 1 <= n)


class ItemIndex:
    """The walked windows of the benchmark items: sorted keys, and the item and offset of each."""

    def __init__(self, ids: list, texts: list[str | None], rate: float = EDIT_RATE, seed: int = 5):
        self.seed = seed
        self.ids, self.words = [], []
        for w in T.words(pa.array(texts, pa.string())):
            for k in range(w.last - w.first):
                h = w.hashes[w.bounds[k] : w.bounds[k + 1]]
                if len(h) >= LEAST_WORDS:
                    self.ids.append(ids[w.first + k])
                    self.words.append(h)
        plans = _plans(seed)
        keys, item, offset = [], [], []
        self.classes = sorted({_class(len(h)) for h in self.words})
        for n, h in enumerate(self.words):
            d = _class(len(h))
            starts = np.arange(len(h) - d + 1)
            k = walk_keys(h, starts, [d], plans)[d]
            keys.append(k.ravel())
            item.append(np.full(k.size, n))
            offset.append(np.tile(starts, TABLES))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.offset = np.concatenate(offset)[order] if offset else np.zeros(0, np.int64)
        self.map = np.zeros(1 << _MAP_BITS, bool)
        self.map[(self.keys >> np.uint64(64 - _MAP_BITS)).astype(np.int64)] = True
        self._add_seeds(rate)

    def _add_seeds(self, rate: float) -> None:
        """For each piece length: sorted hashes of the items' pieces, the item and offset of each, and their map."""
        pieces: dict[int, list[tuple[int, int, np.uint64]]] = {}
        for n, h in enumerate(self.words):
            for at, length in zip(*seeds(h, int(rate * len(h))), strict=True):
                pieces.setdefault(int(length), []).append((n, int(at), T.ngram_hashes(h[at : at + length], int(length))[0]))
        self.seeds = {}
        for length, rows in pieces.items():
            item, offset, keys = (np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.int64, np.int64, np.uint64), strict=True))
            order = np.argsort(keys, kind="stable")
            near = np.zeros(1 << _MAP_BITS, bool)
            near[(keys >> np.uint64(64 - _MAP_BITS)).astype(np.int64)] = True
            self.seeds[length] = (keys[order], item[order], offset[order], near)

    def seeded(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, item, offset) wherever a piece of an item stands in the chunk."""
        found = [np.zeros((3, 0), np.int64)]
        for length, (keys, item, offset, map_) in self.seeds.items():
            grams = T.ngram_hashes(hashes, length)
            near = np.flatnonzero(map_[(grams >> np.uint64(64 - _MAP_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, grams[near], "left"), np.searchsorted(keys, grams[near], "right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([np.repeat(near, n), item[at], offset[at]]))
        return tuple(np.concatenate(found, axis=1))

    def candidates(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, item, offset) of the sampled windows that collide with an item's window."""
        found = []
        for keys in walk_keys(hashes, starts, self.classes, _plans(self.seed)).values():
            for row in keys:
                near = np.flatnonzero(self.map[(row >> np.uint64(64 - _MAP_BITS)).astype(np.int64)])
                if not len(near):
                    continue
                lo, hi = np.searchsorted(self.keys, row[near], "left"), np.searchsorted(self.keys, row[near], "right")
                n = hi - lo
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(np.stack([np.repeat(starts[near], n), self.item[at], self.offset[at]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(found, axis=1))


def edit_distances(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of the item to any stretch of each region (rows), and where that stretch ends."""
    width = regions.shape[1]
    ramp = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((len(regions), width + 1), np.int32)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions != word), out=new[:, 1:])
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    return row.min(axis=1), row.argmin(axis=1)


def _leaks_of(w: T.Words, index: ItemIndex, rate: float) -> list[tuple[int, int, int, int]]:
    """(text number, item number, distance, last word of the stretch) for each leaked item of each text of a chunk."""
    n = len(w.hashes)
    if not n or not index.classes:
        return []
    pad = max(CLASSES) + 1
    hashes = np.concatenate([w.hashes, np.arange(1, pad + 1, dtype=np.uint64)])
    counts = (np.diff(w.bounds) + STRIDE - 1) // STRIDE
    first = np.repeat(w.bounds[:-1], counts)
    starts = first + STRIDE * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    start, item, offset = (np.concatenate(c) for c in zip(index.candidates(hashes, starts), index.seeded(w.hashes), strict=True))
    if not len(start):
        return []
    doc = np.searchsorted(w.bounds, start, side="right") - 1
    begin = start - offset  # where the item would begin
    # collisions of one passage agree on its place up to the edits: one check for each stretch of places
    size = np.array([len(h) for h in index.words])
    slot = begin // np.maximum(1, size[item] // 4)
    _, one = np.unique(np.stack([doc, item, slot]), axis=1, return_index=True)
    doc, item, begin = doc[one], item[one], begin[one]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for k in np.unique(item):
        words = index.words[k]
        most = int(rate * len(words))
        rows = np.flatnonzero(item == k)
        slack = most + len(words) // 4 + 1
        span = np.arange(-slack, len(words) + slack)
        for part in np.array_split(rows, max(1, len(rows) * len(span) // 2_000_000)):
            at = begin[part, None] + span
            inside = (at >= w.bounds[doc[part]][:, None]) & (at < w.bounds[doc[part] + 1][:, None])
            regions = np.where(inside, w.hashes[np.clip(at, 0, n - 1)], np.uint64(0))
            # every word of the item beyond `most` stands in the region: a bound that spares most of the programming
            near = np.isin(regions, words).sum(axis=1) >= len(words) - most
            part, regions = part[near], regions[near]
            if not len(part):
                continue
            distance, end = edit_distances(words, regions)
            for r, dist, e in zip(part, distance, end, strict=True):
                if dist <= most:
                    key = (int(doc[r]), int(k))
                    place = int(begin[r] - slack + e - w.bounds[doc[r]])
                    if key not in best or (dist, place) < best[key]:
                        best[key] = (int(dist), place)
    return [(w.first + d, k, dist, place) for (d, k), (dist, place) in sorted(best.items())]


def find_leaks(documents: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", most_items_bytes: int = MOST_ITEMS_BYTES) -> DataFrame:
    """doc_id, item_id, edit_distance, item_words, end_word: one row for each document and item it leaks."""
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = None
    for sent in _indexes(documents, benchmark, edit_rate, item_col, item_text_col, most_items_bytes):
        found = docs.mapInArrow(_leak_task(sent, edit_rate), "doc_id long, item_id long, edit_distance int, item_words int, end_word int")
        out = found if out is None else out.unionByName(found)
    return out


def _indexes(documents: DataFrame, benchmark: DataFrame, edit_rate: float, item_col: str = "item_id", item_text_col: str = "text", most_items_bytes: int = MOST_ITEMS_BYTES) -> Iterator:
    """A broadcast index for each slice of the benchmark, of a checked size; repeated items are dealt over the slices."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // most_items_bytes))
    if slices > 1:
        items = cut(items.withColumn("k", F.pmod(F.monotonically_increasing_id(), F.lit(slices))))
    for k in range(slices):
        rows = (items if slices == 1 else items.where(F.col("k") == k)).select("item_id", "text").orderBy("item_id", "text").collect()
        yield documents.sparkSession.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows], edit_rate))


def without_leaks(documents: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, text_col: str = "text", **columns) -> DataFrame:
    """The rows of `documents` whose text leaks no item, in one pass; every row is judged by its own text, whatever its id."""
    at = documents.columns.index(text_col)
    out = documents
    for sent in _indexes(documents, benchmark, edit_rate, **columns):
        out = out.mapInArrow(_clean_task(sent, edit_rate, at), documents.schema)
    return out


def _clean_task(sent, rate: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for w in T.words(batch.column(at)):
                clean[[leak[0] for leak in _leaks_of(w, index, rate)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _leak_task(sent, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            ids = batch.column(0)
            found = [x for w in T.words(batch.column(1)) for x in _leaks_of(w, index, rate)]
            if found:
                doc, item, distance, place = zip(*found, strict=True)
                yield pa.record_batch(
                    [ids.take(pa.array(doc)), pa.array([index.ids[k] for k in item], pa.int64()), pa.array(distance, pa.int32()),
                     pa.array([len(index.words[k]) for k in item], pa.int32()), pa.array(place, pa.int32())],
                    names=["doc_id", "item_id", "edit_distance", "item_words", "end_word"],
                )

    return run
