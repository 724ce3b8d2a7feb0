"""Vector code compression: product codes whose nearest entries are found in a ball tree for each part position.

A vector's components become integers, and its parts are coded each by the nearest entry of the codebook of their position. Codebooks
start as the parts of the first vectors and are replaced, round after round, by the floored means of what they were assigned. The
integer vectors are written once; a round is one pass over them, in which each task sums its parts by entry, and one small
aggregation (parts x entries rows, which is all that goes to the driver). Codebooks and trees, of as many rows, are what is broadcast.

The tree: entries are halved by their widest coordinate down to small leaves; a node keeps an integer centre and the largest distance of
its entries from it, rounded up. A part first goes to the leaf whose centre is nearest on the way down, which gives it a distance; then
every node whose ball may hold an entry at that distance or less is visited (triangle inequality, bounds rounded outwards, equality
included, so that a tie with a lower index is found). Distances that decide are exact integers.

Cases: rows whose vector is null, empty, or has a null or non-finite component are dropped; null ids sort after all others; repeated rows
and ids are vectors of their own (the first entries are ordered by id, then vector); fewer vectors than entries make smaller codebooks;
an empty table gives no rows; null labels are one label. Vectors of unequal length, of a length that the parts do not divide, or with a
component beyond 2^14 are refused with an error, as they have no parts or no exact distances. Only the id, vector and label columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.session import Tables

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LEAF = 8
#: Largest integer component: the errors of vectors of up to 8,192 components are then below 2^63.
MOST = 1 << 24
#: Labels, if counted to be so many at most, are broadcast with their sums (16 bytes each); more are joined by shuffle, each dealt over `SALTS`.
MOST_BROADCAST_LABELS = 200_000
SALTS = 16
BATCH = 4096


@dataclass
class Tree:
    """A ball tree as arrays: node k's entries are order[first[k]:last[k]]; left[k] is -1 in a leaf, else its children are left[k] and left[k] + 1."""

    entries: np.ndarray
    order: np.ndarray
    first: list[int]
    last: list[int]
    left: list[int]
    centre: np.ndarray
    radius: np.ndarray


def build_tree(entries: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.arange(len(entries))
    first, last, left = [0], [len(entries)], [-1]
    k = 0
    while k < len(first):
        own = order[first[k] : last[k]]
        if len(own) > leaf:
            spread = entries[own].max(axis=0) - entries[own].min(axis=0)
            order[first[k] : last[k]] = own[np.argsort(entries[own, spread.argmax()], kind="stable")]
            middle = (first[k] + last[k]) // 2
            left[k] = len(first)
            first += [first[k], middle]
            last += [middle, last[k]]
            left += [-1, -1]
        k += 1
    centre = np.stack([entries[order[a:z]].sum(axis=0) // max(z - a, 1) for a, z in zip(first, last, strict=True)])
    far = [_squared(entries[order[a:z]], centre[k][None, :]).max() for k, (a, z) in enumerate(zip(first, last, strict=True))]
    return Tree(entries, order, first, last, left, centre, _up(np.array(far)))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows that belong together (or of all rows to one)."""
    d = a - b
    return np.einsum("ij,ij->i", d, d) if d.shape[1] else np.zeros(len(d), np.int64)


def _up(squared: np.ndarray) -> np.ndarray:
    """A little above the root of integers, whatever was rounded."""
    return np.nextafter(np.sqrt(squared.astype(np.float64)) * (1 + 2.0**-50), np.inf)


def _down(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - 2.0**-50)


def nearest(tree: Tree, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point (ties to the lower index) and its exact squared distance."""
    n = len(points)
    best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, len(tree.entries), np.int64)

    def look(k: int, rows: np.ndarray) -> None:
        """Exact distances of the rows to a leaf's entries; a nearer one, or one as near with a lower index, is taken."""
        for e in tree.order[tree.first[k] : tree.last[k]]:
            d = _squared(points[rows], tree.entries[e][None, :])
            better = (d < best[rows]) | ((d == best[rows]) & (e < who[rows]))
            best[rows[better]], who[rows[better]] = d[better], e

    at = {0: np.arange(n)}
    seen: dict[int, np.ndarray] = {}
    while at:
        k, rows = at.popitem()
        if tree.left[k] < 0:
            look(k, rows)
            seen[k] = rows
            continue
        a = tree.left[k]
        nearer = _squared(points[rows], tree.centre[a][None, :]) <= _squared(points[rows], tree.centre[a + 1][None, :])
        at |= {k: r for k, r in ((a, rows[nearer]), (a + 1, rows[~nearer])) if len(r)}
    todo = [(0, np.arange(n))]
    while todo:
        k, rows = todo.pop()
        reach = _up(best[rows]) + tree.radius[k]
        rows = rows[_down(_squared(points[rows], tree.centre[k][None, :])) <= np.nextafter(reach, np.inf)]
        if tree.left[k] >= 0:
            todo += [(tree.left[k] + 1, rows), (tree.left[k], rows)] if len(rows) else []
        else:
            look(k, np.setdiff1d(rows, seen[k], assume_unique=True) if k in seen else rows)
    return who, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _codes(trees: list[Tree], vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part position, nearest entries, squared distances) of every vector."""
    width = vectors.shape[1] // len(trees)
    for p, tree in enumerate(trees):
        yield p, *nearest(tree, vectors[:, p * width : (p + 1) * width])


def _sum_task(held, width: int, schema: pa.Schema):
    """A task's sums and counts by part position and entry: its only rows, whatever it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build_tree(np.array(c, np.int64)) for c in held.value]
        sums = [np.zeros((len(t.entries), width // len(trees)), object) for t in trees]
        counts = [np.zeros(len(t.entries), np.int64) for t in trees]
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                vectors = _matrix(batch.column(0).slice(i, BATCH), width)
                for p, who, _ in _codes(trees, vectors):
                    part = np.zeros(sums[p].shape, np.int64)  # at most BATCH * MOST, below 2^63
                    np.add.at(part, who, vectors[:, p * part.shape[1] : (p + 1) * part.shape[1]])
                    sums[p] += part
                    counts[p] += np.bincount(who, minlength=len(counts[p]))
        rows = [(p, e, int(counts[p][e]), list(map(int, sums[p][e]))) for p in range(len(trees)) for e in np.flatnonzero(counts[p]).tolist()]
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema=schema)

    return run


def _code_task(held, width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build_tree(np.array(c, np.int64)) for c in held.value]
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                codes, error = np.zeros((part.num_rows, len(trees)), np.int64), np.zeros(part.num_rows, np.int64)
                for p, who, far in _codes(trees, _matrix(part.column(2), width)):
                    codes[:, p] = who
                    error += far
                digits = -(-max(max(len(t.entries) for t in trees) - 1, 1).bit_length() // 4)
                text = ["".join(f"{c:0{max(digits, 2)}x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text), pa.array(error)], schema=schema)

    return run


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, v: the integer components of usable vectors."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    usable = x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    within = F.forall(x, lambda c: F.abs(c * scale) <= MOST)
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("int"))
    checked = F.when(within, whole).otherwise(F.raise_error(F.lit(f"a component beyond {MOST} / {scale} has no exact code")))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.when(usable, checked).alias("v")).where("v IS NOT NULL")


def _next(codebook: list[list[int]], rows: dict[int, tuple[int, list[int]]]) -> list[list[int]]:
    """Entries replaced by the floored means of their parts; unused ones stay."""
    return [[s // rows[e][0] for s in rows[e][1]] if e in rows else entry for e, entry in enumerate(codebook)]


@dataclass
class Codes:
    """Coded rows (id, label, code, error) and the codebooks, by part position, entry and place in the part."""

    rows: DataFrame
    codebooks: list[list[list[int]]]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.codebooks for entry in book for x in entry).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codes:
    """Fit codebooks on all usable vectors and code each of them."""
    spark = vectors.sparkSession
    tables = Tables(spark, "vector-codes")
    kept = tables.store("vectors", _kept(vectors, id_col, vector_col, label_col, scale))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    empty = spark.createDataFrame([], "id long, label long, code string, error long")
    if not first:
        return Codes(empty, [[] for _ in range(parts)])
    width = len(first[0]["v"])
    if width % parts or kept.where(F.size("v") != width).limit(1).count():
        raise ValueError(f"vectors of one length that {parts} divides are coded, not of {width} and others")
    step = width // parts
    books = [[list(r["v"][p * step : (p + 1) * step]) for r in first] for p in range(parts)]
    total = "array<decimal(38,0)>"
    summed = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.decimal128(38, 0)))])
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)
        sums = kept.select("v").mapInArrow(_sum_task(held, width, summed), f"part int, entry int, n long, total {total}")
        adds = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(step)]
        found: list[dict] = [{} for _ in range(parts)]
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *adds).collect():  # parts x entries rows at most
            found[r["part"]][r["entry"]] = (r["n"], [int(r[f"t{i}"]) for i in range(step)])
        books = [_next(book, rows) for book, rows in zip(books, found, strict=True)]
    coded = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])
    rows = kept.select("id", "label", "v").mapInArrow(_code_task(spark.sparkContext.broadcast(books), width, coded), "id long, label long, code string, error long")
    return Codes(tables.store("codes", rows), books)


def with_label_error(rows: DataFrame) -> DataFrame:
    """Each row with the errors of its label summed (null labels together). Sums are combined before they are shuffled, and no label's rows are gathered."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    if sums.count() <= MOST_BROADCAST_LABELS:
        return _beside(rows, F.broadcast(sums), F.col("l").eqNullSafe(F.col("label")))
    salted = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id", "code", "error"), F.lit(SALTS)).cast("int"))
    return _beside(dealt, salted, F.col("l").eqNullSafe(F.col("label")) & (F.col("part") == F.col("salt")))


def _beside(rows: DataFrame, sums: DataFrame, same: Column) -> DataFrame:
    return rows.join(sums.withColumnRenamed("label", "l"), same).select("id", "label", "code", "error", "label_error")
