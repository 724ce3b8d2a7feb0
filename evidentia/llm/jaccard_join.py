"""N-gram Jaccard self-join: a size-aware heavy-light join, exact for any table.

Sets are distinct word shingles, seen as 64-bit hashes; two sets A, B link when |A & B| >= c(|A|, |B|), the overlap that the
Jaccard bound asks for. Equal sets are one node (64-bit number of the set), so copies cost one row each and no pairs.

* Small sets (size <= x) enumerate subsets of the fixed sizes c(n, m) over the sizes m of possible partners. Two
  small sets link exactly if they share a subset of size c(n, m), and then each links to the smallest set that
  has this subset: a star per subset, no pairs and no check.
* Large sets scan inverted lists. Shingles are ordered by how common they are (a fixed-size count
  sketch over all documents; any order is right, a good one is fast). The first |A| - ceil(t |A|) + 1 shingles of a set are its list
  entries: linked sets share one at least. Lists are scanned twice. First every set is compared with the heads of
  its lists, the sets in which the list's shingle stands foremost: in a family of near copies that is the text they come from, as
  it has no rare shingles of its own. That joins families in linear time. Then only lists that still hold different components are
  joined with themselves, by shingle and size class: an entry at place p of a set of n can only serve a partner of
  at most 7 (n - p) / 3 - n shingles (at 0.75), and sets of the list's largest component meet only sets of others.
  Pairs whose sizes and parities (2,048 bits a set, 32,768 a large one: an upper bound of what two sets share) allow a link are verified on their whole sets.
  Pairs inside a component are never made: they cannot change it.
* The boundary x is where the summed cost of subsets passes the cost of scanning, from the counted sizes and the sketch.
* The list of a very frequent shingle is dealt over several tasks by its sets' numbers.

Cases: null and empty texts have no shingles and link with nothing; fewer words than `size` make one
shingle; very long texts are sets as others, of as many shingles; repeated rows (also of one id) are one node and come back as rows; null ids
link like others and have their component's least id, or null; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import text as T
from evidentia.llm.components import components
from evidentia.session import Tables, small_batches

SKETCH_BITS = 22
BLOCK_BITS = 16
#: Sizes up to which the cost of subsets is weighed; a set of 30 has over 30,000 subsets, more than any list entry costs.
MOST_SMALL = 30
#: Bits of the filter that tells which documents' sets a round needs: at most 8 MB, whatever the input.
FILTER_BITS = (16, 26)
#: Classes of the parities that bound an overlap: for sets, and for those of so many shingles and more, which would fill as few.
PARITY_BITS, LARGE_SET, LARGE_PARITY_BITS = 2048, 2200, 32768
#: Tables of pairs of at most so many rows (counted) are broadcast, 16 bytes a row; larger ones are joined by shuffle.
MOST_BROADCAST_ROWS = 500_000
#: Heads compared for each set.
HEADS = 3
#: Entries of one shingle, as the sketch counts them, that go to one task.
HOT_ENTRIES = 1 << 16


def overlap(n: int, m: int, num: int, den: int) -> int:
    """Least overlap of sets of n and m elements whose Jaccard similarity is num / den or more."""
    return -(-num * (n + m) // (num + den))


def partners(n: int, num: int, den: int) -> range:
    """Sizes that a set similar to one of n elements can have."""
    return range(-(-num * n // den), den * n // num + 1)


def prefix(n: int, num: int, den: int) -> int:
    """List entries of a set: one more than it can lack of a partner's elements."""
    return min(n, n - -(-num * n // den) + 1)


def subset_sizes(n: int, x: int, num: int, den: int) -> list[int]:
    return sorted({overlap(n, m, num, den) for m in partners(n, num, den) if m <= x and overlap(n, m, num, den) <= n})


# ---- pass 1: counts of shingles in a fixed number of buckets, and of small sizes


def _count_task(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        sizes = np.zeros(MOST_SMALL + 1, np.int64)
        held: list[np.ndarray] = []
        for batch in batches:
            for w in T.words(batch.column(0)):
                for _, s in T.shingle_sets(w, size):
                    if len(s) <= MOST_SMALL:
                        sizes[len(s)] += 1
                    held.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                if sum(map(len, held)) > 1 << SKETCH_BITS:
                    sketch += np.bincount(np.concatenate(held), minlength=len(sketch)).astype(np.uint32)
                    held = []
        if held:
            sketch += np.bincount(np.concatenate(held), minlength=len(sketch)).astype(np.uint32)
        yield _count_rows(sketch, sizes)

    return run


def _count_rows(sketch: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    keys, data = [-1], [sizes.astype("<i8").tobytes()]
    for k, block in enumerate(sketch.reshape(-1, 1 << BLOCK_BITS)):
        if block.any():
            keys.append(k)
            data.append(block.astype("u1" if block.max() < 256 else "<u4").tobytes())
    return pa.record_batch([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=["key", "data"])


def _sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of each key as they come, so memory holds one block per key of the partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            kind = "<i8" if k < 0 else "u1" if len(d) == 1 << BLOCK_BITS else "<u4"
            part = np.frombuffer(d, kind).astype(np.int64)
            sums[k] = sums[k] + part if k in sums else part
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([np.minimum(v, 2**32 - 1).astype("<i8" if k < 0 else "<u4").tobytes() for k, v in sums.items()], pa.binary())], names=["key", "data"])


def count_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket counts (2^22, whatever the input) and the number of sets of each small size."""
    parts = texts.mapInArrow(_count_task(size), "key long, data binary")
    rows = parts.repartition(16, "key").mapInArrow(_sum_task, "key long, data binary").collect()
    sketch, sizes = np.zeros(1 << SKETCH_BITS, np.uint32), np.zeros(MOST_SMALL + 1, np.int64)
    for r in rows:
        if r["key"] < 0:
            sizes = np.frombuffer(r["data"], "<i8")
        else:
            sketch[r["key"] << BLOCK_BITS : (r["key"] + 1) << BLOCK_BITS] = np.frombuffer(r["data"], "<u4")
    return sketch, sizes


def boundary(sketch: np.ndarray, sizes: np.ndarray, num: int, den: int) -> int:
    """The size x up to which enumerating subsets costs less than scanning lists."""
    total = float(sketch.sum(dtype=np.float64))
    noise = total / len(sketch)
    squares = sum(float((part.astype(np.float64) ** 2).sum()) for part in sketch.reshape(-1, 1 << BLOCK_BITS))
    scanned = max(1.0, squares / total - noise) if total else 1.0
    best, x, cost = 0.0, 1, 0.0
    for s in range(2, MOST_SMALL + 1):
        subsets = sum(comb(s, c) for c in subset_sizes(s, MOST_SMALL, num, den))
        cost += float(sizes[s]) * (subsets - prefix(s, num, den) * (1 + scanned))
        if cost < best:
            best, x = cost, s
    return x


# ---- pass 2: nodes and their list entries


def _node_of(s: np.ndarray) -> int | None:
    """The number of a set: equal sets are one node."""
    return int(T.mix(np.array([np.bitwise_xor.reduce(T.mix(s)) ^ np.uint64(len(s))], np.uint64)).view(np.int64)[0]) if len(s) else None


def _parities(s: np.ndarray) -> np.ndarray:
    """For each class of hashes whether the set has an odd number of them, as words of 64 bits.

    Two sets differ by one element at least for each class in which their parities differ, so parities bound what they can share.
    """
    classes = PARITY_BITS if len(s) < LARGE_SET else LARGE_PARITY_BITS
    odd = np.bincount((s & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _node_task(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), _node_of(s), _parities(s)) for w in T.words(batch.column(1)) for _, s in T.shingle_sets(w, size)]
            flat = np.concatenate([p for *_, p in found]) if found else np.zeros(0, np.int64)
            edges = pa.array(np.concatenate([[0], np.cumsum([len(p) for *_, p in found])]).astype(np.int32))
            yield pa.record_batch([batch.column(0), pa.array([n for n, *_ in found], pa.int32()), pa.array([k for _, k, _ in found], pa.int64()), pa.ListArray.from_arrays(edges, pa.array(flat))], names=["id", "n", "node", "odd"])

    return run


#: An entry's subset size c, log2 of the tasks its list is dealt over, set size n and place among the set's entries: 6, 4, 28 and 25 bits of meta.
META = {"c": "CAST(shiftright(meta, 57) AS INT)", "k": "CAST(shiftright(meta, 53) & 15 AS INT)", "n": "CAST(shiftright(meta, 25) & 268435455 AS INT)", "pos": "CAST(meta & 33554431 AS INT)"}
#: The shingle of an entry of a dealt list, whose key also holds the task's number.
SHINGLE = f"key ^ shiftleft(node & (shiftleft(1L, {META['k']}) - 1), 40)"


def _entry_task(order, size: int, x: int, num: int, den: int, hot: int):
    """key, node, meta: three long columns, as these rows are the operator's largest shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = order.value
        seen: set[int] = set()
        for batch in batches:
            for w in T.words(batch.column(0)):
                keys, owners, metas = [], [], []
                for _, s in T.shingle_sets(w, size):
                    n, node = len(s), _node_of(s)
                    if not n or node in seen:
                        continue
                    if len(seen) < 1_000_000:  # entries of a node once per task; repeats from other tasks go where lists meet
                        seen.add(node)
                    before = len(keys)
                    if n <= x:
                        for want in subset_sizes(n, x, num, den):
                            subs = s[np.array(list(combinations(range(n), want)))]
                            keys.append(T.mix(T.mix(subs).sum(axis=1, dtype=np.uint64) + np.uint64(want)))
                            metas.append(np.full(len(subs), want << 57 | n << 25, np.int64))
                    if partners(n, num, den)[-1] > x:
                        p = prefix(n, num, den)
                        rank = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                        at = np.lexsort((s, rank))[:p]
                        rank = rank[at].astype(np.int64)
                        k = np.where(rank > hot, np.ceil(np.log2(np.maximum(rank, 1) / hot)), 0).clip(0, 15).astype(np.int64)
                        keys.append(s[at] ^ ((np.int64(node) & ((1 << k) - 1)) << 40).view(np.uint64))
                        metas.append(np.arange(p, dtype=np.int64) + (n << 25) + (k << 53))
                    made = sum(len(k) for k in keys[before:])
                    owners.append(np.full(made, node, np.int64))
                if keys:
                    columns = (np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(metas))
                    yield pa.record_batch([pa.array(c) for c in columns], names=["key", "node", "meta"])

    return run


# ---- verification on whole sets


def _filter_bits(n: int) -> int:
    return min(FILTER_BITS[1], max(FILTER_BITS[0], int(np.ceil(np.log2(16 * max(1, n))))))


def _filter_of(places: DataFrame, bits: int) -> np.ndarray:
    """A filter of places(b) below 2^bits, of bounded size: where it is too small it only lets more rows through to the exact join."""
    one = F.expr("shiftleft(1L, CAST(b & 63 AS INT))")
    found = places.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(one).alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("w").to_numpy()] = found.column("m").to_numpy().view(np.uint64)
    return out


def _possible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """pairs(a, b) -> those whose sizes and parities allow a link: both ends are found in one pass over the nodes and meet by pair."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    ends = F.broadcast(ends) if pairs.count() <= MOST_BROADCAST_ROWS else ends
    side = lambda c, end: F.first(F.when(F.col("node") == F.col(end), F.col(c)), ignorenulls=True)
    met = nodes.join(ends, "node").groupBy("a", "b").agg(side("n", "a").alias("n"), side("n", "b").alias("m"), side("odd", "a").alias("oa"), side("odd", "b").alias("ob"))
    apart = "aggregate(zip_with(oa, ob, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return met.where(f"size(oa) <> size(ob) OR (n + m - {apart}) DIV 2 >= ({num} * (n + m) + {num + den - 1}) DIV {num + den}").select("a", "b")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted(node, id): stored -> node, s: the whole shingle sets, read from the documents that bounded filters of the ids and nodes let through.

    A node comes once from each task that meets it; a node that no filter holds may come too.
    """
    bits = _filter_bits(wanted.count())
    id_place, last = F.pmod(F.xxhash64("id"), F.lit(1 << bits)), (1 << bits) - 1
    sent = docs.sparkSession.sparkContext.broadcast((_filter_of(wanted.select(id_place.alias("b")), bits), _filter_of(wanted.select(F.col("node").bitwiseAND(F.lit(last).cast("long")).alias("b")), bits)))

    def held(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((mask[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            part = batch.filter(pa.array(held(sent.value[0], batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))))
            sets = []
            for w in T.words(part.column(0)):
                for _, s in T.shingle_sets(w, size):
                    node = _node_of(s)
                    if node is not None and node not in seen and held(sent.value[1], np.array([node & last]))[0]:
                        if len(seen) < 1_000_000:
                            seen.add(node)
                        sets.append((node, s.astype("<u8").tobytes()))
            if sets:
                yield pa.record_batch([pa.array([k for k, _ in sets], pa.int64()), pa.array([s for _, s in sets], pa.binary())], names=["node", "s"])

    return docs.select("text", id_place.alias("b")).mapInArrow(run, "node long, s binary")


def _verify_task(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(sa, "<u8"), np.frombuffer(sb, "<u8")
                both = np.sort(np.concatenate([a, b]), kind="stable")
                keep.append(int((both[1:] == both[:-1]).sum()) * (num + den) >= num * (len(a) + len(b)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, num: int, den: int, tables: Tables, turn: str) -> DataFrame:
    """pairs(a, b) -> those that link, stored. Pairs that sizes and parities rule out go first; the whole sets of the rest are dealt by node, once for both ends."""
    pairs = tables.store(f"met-{turn}", pairs)
    pairs = tables.store(f"pairs-{turn}", _possible(pairs, nodes, num, den))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = tables.store(f"wanted-{turn}", ends.join(nodes, "node").select("node", "id"))
    sets = _sets(docs, wanted, size).repartition(F.col("node"))
    right = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = right.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    links = tables.store(f"links-{turn}", both.select("a", "b", "sa", "sb").mapInArrow(_verify_task(num, den), "a long, b long").distinct())
    for name in ("met", "wanted", "pairs"):
        tables.drop(f"{name}-{turn}")
    return links


def _head_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """For each set (b) the heads (a) it shares most lists with, at most HEADS of them: a number of pairs in proportion to the sets."""
    fits = f"node <> head AND {num} * greatest(n, hn) <= {den} * least(n, hn)"
    met = lists.where(fits).groupBy(F.col("head").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("k"))
    best = Window.partitionBy("b").orderBy(F.desc("k"), "a")
    return met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= HEADS).select("a", "b")


def _early(num: int, den: int) -> str:
    """The entry can serve a partner of no fewer shingles."""
    return f"pos <= n - (2 * n * {num} + {num + den - 1}) DIV {num + den}"


def _open_lists(lists: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """key, node, n, pos, comp, main of the entries whose list holds several components and an early entry; main: the entry is of the list's largest one."""
    labelled = lists.join(found, "node", "left").select("key", "node", "n", "pos", F.coalesce("component", "node").alias("comp"))
    parts = labelled.groupBy("key", "comp").agg(F.count("*").alias("k"), F.bool_or(F.expr(_early(num, den))).alias("early"))
    mixed = parts.groupBy("key").agg(F.max_by("comp", "k").alias("large"), F.count("*").alias("parts"), F.bool_or("early").alias("early")).where("parts > 1 AND early")
    return labelled.join(mixed.select("key", "large"), "key").select("key", "node", "n", "pos", "comp", (F.col("comp") == F.col("large")).alias("main"))


def _last_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that share an early enough entry; a has no fewer shingles than b.

    Lists are joined by shingle and size class (classes as wide as the range of partners, so a set meets two at most), and a set of the
    list's largest component meets the others only.
    """
    classed = f"CAST(floor(ln({{m}}) / {float(np.log(den / num))!r}) AS INT)" if num < den else "CAST({m} AS INT)"
    lo, hi = f"(n * {num} + {den} - 1) DIV {den}", f"least(n, (n - pos) * {num + den} DIV {num} - n)"
    large = lists.where(f"{lo} <= {hi}").select("key", F.col("node").alias("a"), "n", "pos", "comp", "main", F.explode(F.expr(f"sequence({classed.format(m=lo)}, {classed.format(m=hi)})")).alias("class"))
    small = lists.where(_early(num, den)).select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("comp").alias("cb"), F.col("main").alias("side"), F.expr(classed.format(m="n")).alias("class"))
    least = f"(({num} * (n + m) + {num + den - 1}) DIV {num + den})"
    near = f"a <> b AND comp <> cb AND m BETWEEN {lo} AND {hi} AND pos <= n - {least} AND at <= m - {least} AND (m < n OR b < a)"
    parts = [left.drop("main").join(right.drop("side"), ["key", "class"]).where(near).select("a", "b") for left, right in ((large.where("NOT main"), small), (large.where("main"), small.where("NOT side")))]
    return parts[0].unionByName(parts[1]).distinct()


def jaccard_join(documents: DataFrame, size: int = 5, similarity: tuple[int, int] = (75, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component: the least id reachable over links, its own included."""
    with small_batches(documents.sparkSession):
        rows, found = _families(documents, size, similarity, id_col, text_col)
    labelled = rows.join(found, "node", "left").withColumn("set", F.coalesce("component", "node"))
    least = labelled.where("set IS NOT NULL").groupBy("set").agg(F.min("id").alias("least"))
    out = labelled.join(least, "set", "left")
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "id").alias("component"))


def _families(documents: DataFrame, size: int, similarity: tuple[int, int], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored: the rows (id, n, node), and the components (node, component) of the nodes that link."""
    spark = documents.sparkSession
    tables = Tables(spark, "jaccard-join")
    num, den = similarity
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sketch, small = count_shingles(docs.select("text"), size)
    x = boundary(sketch, small, num, den)
    hot = max(HOT_ENTRIES, 8 * int(sketch.mean()))
    order = spark.sparkContext.broadcast(sketch)
    del sketch
    rows = tables.store("rows", docs.mapInArrow(_node_task(size), "id long, n int, node long, odd array<long>"))
    nodes = tables.store("nodes", rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("odd").alias("odd")))
    rows = rows.drop("odd")

    entries = docs.select("text").mapInArrow(_entry_task(order, size, x, num, den, hot), "key long, node long, meta long").repartition(F.col("key"))
    # both sides of the join read all columns of the entries, so that one shuffle serves both. Foremost: by place over size, for subsets by size
    rank = f"CASE WHEN {META['c']} > 0 THEN CAST({META['n']} AS BIGINT) ELSE shiftleft(CAST({META['pos']} * 1e9D / {META['n']} AS BIGINT), 28) | {META['n']} END"
    dealt = F.expr(f"{META['k']} > 0")
    heads = entries.groupBy("key").agg(F.min_by("node", F.expr(rank)).alias("head"), F.min(F.expr(rank)).alias("hr"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bool_or(dealt).alias("dealt"))
    heads = heads.where("lo <> hi OR dealt").select("key", "head", F.expr("CAST(hr & 268435455 AS INT)").alias("hn"))
    star = f"node <> head AND {num} * ({META['n']} + hn) <= {num + den} * {META['c']}"
    held = entries.join(heads.hint("shuffle_hash"), "key").dropDuplicates(["key", "node"]).where(f"{META['c']} = 0 OR ({star})")
    held = held.select(F.expr(f"CASE WHEN {META['c']} = 0 THEN {SHINGLE} END").alias("key"), "node", F.expr(META["n"]).alias("n"), F.expr(META["pos"]).alias("pos"), "head", "hn")
    met = tables.store("lists", held)
    links = met.where("key IS NULL").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    lists = met.where("key IS NOT NULL")

    links = tables.store("first", links.unionByName(_verify(docs, nodes, _head_pairs(lists, num, den), size, num, den, tables, "heads")))
    found = tables.store("families", components(links))
    # whatever can still join components
    last = tables.store("open", _open_lists(lists.drop("head", "hn"), found, num, den))
    tables.drop("lists")
    more = _verify(docs, nodes, _last_pairs(last, num, den), size, num, den, tables, "last")
    tables.drop("open")
    star = found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
    return rows, tables.store("components", components(star.unionByName(more)))
