"""Target-distribution importance resampling over bucket-partitioned inverted postings.

Documents are drawn so that their words look like those of a target collection. Features are runs of words, hashed to buckets; a bucket's
gain is the smoothed log ratio of its shares in target and source; a document's weight is the sum of its features' gains; with a seeded
Gumbel term added, the highest scores are a sample without replacement.

    1. a block of some thousand texts becomes inverted lists, bucket -> (place of the document in the block, count), written once. A row holds
       a part of one list or one document, so what Spark holds while it reads and writes them does not follow the size of a block or a file
    2. bucket totals of both collections meet by bucket (combined on the map side), and each bucket's gain is computed where they meet
    3. lists are shuffled by part of the buckets to the gains of that part: two bytes a posting and its count. A bucket of a frequent word has a
       posting of nearly every document, so the lists of a part are dealt by block over cells, each with the gains
    4. contributions count * gain are summed by document, first where they arise: a cell has about `CELL_DOCS` documents at most, and a
       document at most a sum for each part
    5. scores are ordered by ranges, and a range's ranks begin after the sizes of the ranges before it

Cases: a null or empty text, and one without words, has no features, weight 0, and is not drawn; a null id is hashed as an empty string and
comes last among equal scores; repeated rows are documents of their own (equal scores and ids are ordered by their number of features);
very long texts are counted in stretches; an empty table gives no rows, an empty target has no counts; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import Tables, small_batches

BUCKETS = 10_000
MOST_WORDS = 1
LEAST_WORDS = 20
#: Parts of the buckets; about how many documents a cell has at most, and the least number of cells of a part.
PARTS = 16
CELL_DOCS = 1 << 16
LEAST_CELLS = 64
SEED = 2024
#: Bytes of text whose words are held at once, and features remembered by a worker (a full memory is emptied).
STRETCH_BYTES = 1 << 20
MOST_FEATURES = 500_000
#: Documents of a block of inverted lists (places in it take two bytes), and postings that end a block early.
BLOCK_DOCS = 1 << 12
BLOCK_POSTINGS = 1 << 20
#: Postings of a row: readers and writers hold some thousand rows at once, whatever their size.
ROW_POSTINGS = 1 << 8
#: Rows of lists sent to Spark at once.
BATCH_ROWS = 1 << 12

_state: dict = {}


def _spaced() -> bytes:
    """A-Z lowered; every ASCII byte but digits and letters is a space."""
    keep = b"0123456789abcdefghijklmnopqrstuvwxyz"
    return bytes(b if b >= 128 or b in keep else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _bucket_of(feature: bytes, buckets: int) -> int:
    seen = _state.setdefault(buckets, {})
    if len(seen) > MOST_FEATURES:
        seen.clear()
    if feature not in seen:
        seen[feature] = zlib.crc32(feature) % buckets
    return seen[feature]


def _stretches(text: bytes) -> Iterator[bytes]:
    """A text with spaces between its words, in runs of whole words."""
    at = 0
    while len(text) - at > STRETCH_BYTES:
        end = text.find(b" ", at + STRETCH_BYTES)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _text_buckets(text: bytes, buckets: int, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Words of a text, its buckets in ascending order, and how many of its features each holds."""
    n_words, tail, parts = 0, [], []
    for stretch in _stretches(text):
        words = stretch.split()
        n_words += len(words)
        features = list(words)
        run = tail + words  # runs that end in this stretch
        for n in range(2, most + 1):
            features += [b" ".join(run[i : i + n]) for i in range(max(0, len(tail) - n + 1), len(run) - n + 1)]
        tail = run[len(run) - most + 1 :] if most > 1 else []
        found = np.fromiter((_bucket_of(f, buckets) for f in features), np.int64, len(features))
        parts.append(np.unique(found, return_counts=True))
    if len(parts) == 1:
        return n_words, *parts[0]
    total = np.zeros(buckets, np.int64)
    for bucket, count in parts:
        total[bucket] += count
    return n_words, np.flatnonzero(total), total[total > 0]


#: A row has a bucket and a part of its list, or the place of a document in its block and what is known of it; the other columns are null.
_ROWS = "block long, bucket int, docs array<smallint>, counts array<int>, doc int, id long, n_words long, n_features long"
_ARROW = pa.schema([
    ("block", pa.int64()), ("bucket", pa.int32()), ("docs", pa.list_(pa.int16())), ("counts", pa.list_(pa.int32())),
    ("doc", pa.int32()), ("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()),
])


def _batch(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _block_rows(block: int, ids: list, sizes: list[tuple[int, int]], rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One block: its documents, and for each bucket the list of its documents' places and counts."""
    n = len(rows)
    known = {"id": pa.array(ids, pa.int64()), "n_words": pa.array([w for w, _ in sizes], pa.int64()), "n_features": pa.array([f for _, f in sizes], pa.int64())}
    yield _batch(n, {"block": pa.array(np.full(n, block)), "doc": pa.array(np.arange(n, dtype=np.int32)), **known})
    lens = np.fromiter((len(b) for b, _ in rows), np.int64, n)
    bucket, count = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    order = np.argsort(bucket, kind="stable")
    bucket, count, doc = bucket[order], count[order].astype(np.int32), np.repeat(np.arange(n, dtype=np.int16), lens)[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    within = np.arange(len(bucket)) - np.repeat(first, np.diff(first, append=len(bucket)))
    starts = np.flatnonzero(within % ROW_POSTINGS == 0)
    bounds = pa.array(np.append(starts, len(bucket)).astype(np.int32))
    lists = {"docs": pa.ListArray.from_arrays(bounds, pa.array(doc)), "counts": pa.ListArray.from_arrays(bounds, pa.array(count))}
    found = _batch(len(starts), {"block": pa.array(np.full(len(starts), block)), "bucket": pa.array(bucket[starts].astype(np.int32)), **lists})
    for at in range(0, len(starts), BATCH_ROWS):
        yield found.slice(at, BATCH_ROWS)


def _invert(buckets: int, most: int):
    table = _spaced()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        ids, sizes, rows = [], [], []
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n_words, bucket, count = _text_buckets((text or "").encode().translate(table), buckets, most)
                    ids.append(doc)
                    sizes.append((n_words, int(count.sum())))
                    rows.append((bucket, count))
                    held += len(bucket)
                    if len(ids) == BLOCK_DOCS or held >= BLOCK_POSTINGS:
                        yield from _block_rows(block, ids, sizes, rows)
                        block, held, ids, sizes, rows = block + 1, 0, [], [], []
        if ids:
            yield from _block_rows(block, ids, sizes, rows)

    return run


def _inverted(texts: DataFrame, id_col: str | None, text_col: str, buckets: int, most: int) -> DataFrame:
    """Documents by block, and their inverted lists."""
    ids = F.col(f"`{id_col}`").cast("long") if id_col else F.lit(None).cast("long")
    return texts.select(ids.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_invert(buckets, most), _ROWS)


def _lists(blocks: DataFrame) -> DataFrame:
    """bucket, block, docs, counts: a row or more for each bucket of a block."""
    return blocks.where("bucket IS NOT NULL").select("bucket", "block", "docs", "counts")


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Inverted lists of both collections -> bucket, gain: their counts are summed where each bucket's rows meet. Totals are one row."""
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    marked = source.select("bucket", n.alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), n.alias("t")))
    met = marked.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = marked.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = ((F.col("t") + 1).cast("double") * float(total["s"] + buckets)) / ((F.col("s") + 1).cast("double") * float(total["t"] + buckets))
    return met.where("s > 0").select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def _part_and_slot() -> tuple[Column, Column]:
    return F.pmod("bucket", F.lit(PARTS)), F.floor(F.col("bucket") / PARTS).cast("int")


def _dealt(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Lists with the cell of their part and block, and the number of cells of a part."""
    cells = max(LEAST_CELLS, -(-blocks.where("doc IS NOT NULL").count() // CELL_DOCS))
    part, slot = _part_and_slot()
    cell = F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int") * PARTS + part
    return _lists(blocks).select(cell.alias("cell"), "block", slot.alias("slot"), "docs", "counts"), cells


def _weights(blocks: DataFrame, gains: DataFrame, buckets: int) -> DataFrame:
    """block, doc, weight of the documents with features: each list meets its bucket's gain in its cell."""
    dealt, cells = _dealt(blocks)
    part, slot = _part_and_slot()
    held = gains.groupBy(part.alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(slot.alias("slot"), "gain"))).alias("gain"))
    in_order = F.transform(F.sequence(F.lit(0), F.lit((buckets - 1) // PARTS)), lambda i: F.try_element_at("gain", i))
    each = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: k * PARTS + F.col("part"))
    wanted = held.select(in_order.alias("gains"), each.alias("cells")).select("gains", F.explode("cells").alias("cell"))
    met = dealt.join(wanted.hint("shuffle_hash"), "cell").select("block", F.get("gains", F.col("slot")).alias("gain"), F.arrays_zip("docs", "counts").alias("list"))
    met = met.select("block", "gain", F.explode("list").alias("p"))
    return met.groupBy("block", F.col("p.docs").cast("int").alias("doc")).agg(F.sum(F.col("p.counts") * F.col("gain")).alias("weight"))


def _noise(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)): u from the first 32 bits of the seeded hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def _ranked(scored: DataFrame, tables: Tables) -> DataFrame:
    """Rows with their place in the order of scores. Only the sizes of ranges (a row for each part file) go through one window."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "n_features", "block", "doc"]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = tables.store("ordered", dealt.withColumn("place", F.monotonically_increasing_id()))
    stored = stored.withColumn("range", F.shiftright("place", 33)).withColumn("within", F.col("place").bitwiseAND((1 << 33) - 1))
    sizes = stored.groupBy("range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    return stored.join(F.broadcast(sizes.select("range", F.coalesce(before, F.lit(0)).alias("before"))), "range").withColumn("rank", F.col("before") + F.col("within") + 1)


def resample(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, most_words: int = MOST_WORDS, least_words: int = LEAST_WORDS,
             percent: int = 10, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """id, n_features, weight, score, rank of every document; of those with `least_words` words, `percent` in a hundred are drawn and ranked."""
    tables = Tables(documents.sparkSession, "importance")
    with small_batches(documents.sparkSession):
        blocks = tables.store("blocks", _inverted(documents, id_col, text_col, buckets, most_words))
        wanted = tables.store("target", _inverted(target, None, target_text_col, buckets, most_words))
    gains = tables.store("gains", bucket_gains(_lists(blocks), _lists(wanted), buckets))
    parts = _weights(blocks, gains, buckets)
    docs = blocks.where("doc IS NOT NULL").select("block", "doc", "id", "n_words", "n_features")
    weighed = docs.join(parts, ["block", "doc"], "left").withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long"))
    scored = tables.store("scored", weighed.withColumn("score", F.col("weight") + _noise(F.col("id"), seed)))
    eligible = F.col("n_words") >= least_words
    drawn = scored.where(eligible).count() * percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long")
    ranked = _ranked(scored.where(eligible), tables).select("id", "n_features", "weight", "score", rank.alias("rank"))
    return ranked.unionByName(scored.where(~eligible).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
