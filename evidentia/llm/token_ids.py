"""Token-ID output by bit-plane shuffling.

Layout of an output folder: a Parquet table of chunks, one part file per shard, written and committed by Spark, so a lost
executor leaves no half file. Shards follow each other in ascending document id; a shard is one
stream of ids cut into blocks of `block` ids. A chunk row holds one block:

    shard, chunk     place in the stream                     n_ids            ids in the block
    first_ordinal    number in its shard of the first document of the block
    first_piece      0 if that document begins here, else how many blocks of it came before
    doc_ids, lens    documents with ids in the block, and how many of their ids
    open             the last document goes on in the next block
    first_key        first document id of the shard (orders the shards)
    planes, sizes    plane kind and the compressed size of each plane
    payload          the planes, each compressed with zstandard, end to end

Byte planes: plane k has byte k of every id. Bit planes: plane k has bit k of every id, eight ids to a byte. All columns but
the payload are the chunk index: they are read without it.

Cases: a null or empty text has only the end id; a very long text goes on over as many blocks as it needs; a null document id sorts first; repeated rows are documents of their own;
an empty table writes an empty folder and reads back no rows; only the id and text columns are read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import text as T
from evidentia.session import Tables, checkpoint_dir, small_batches

BLOCK = 1 << 16
END_ID = 2
#: Words remembered by a worker; a full memory is emptied.
MOST_WORDS = 1_000_000
_encoders: dict = {}

CHUNK_SCHEMA = (
    "shard int, chunk int, n_ids int, first_ordinal long, first_piece int, doc_ids array<long>, lens array<int>, open boolean, "
    "first_key long, planes string, sizes array<int>, payload binary"
)


def _kinds() -> np.ndarray:
    """Of each byte: 0 letter, 1 digit, 2 mark, 3 to be left to the tokenizer."""
    out = np.full(256, 2, np.int8)
    out[48:58] = 1
    out[65:91] = out[97:123] = 0
    out[0xC3] = 0
    out[128:0xC3] = out[0xC4:] = out[39] = 3
    return out


class Encoder:
    """Whole-text encoding with a tokenizers file of the byte-level kind.

    These tokenizers first cut a text into pieces, each encoded by itself: runs of letters, of digits and of marks, each with the
    one space before it. So a text's ids are those of its pieces in order. Pieces repeat: each is encoded once per worker, and a
    text's ids are gathered from a table. Pieces are found where this is plain to see from the bytes (ASCII and the
    letters U+00C0 to U+00FF); a word with other characters or an apostrophe is one piece for the table, and a text with other or
    adjoining white space, or with the string of an added token, is encoded in one go. So is every text by a tokenizer whose file
    names another normalizer, pre-tokenizer or post-processor. The table's keys are 64-bit hashes of pieces, a million at most at a time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        cutting = file.get("pre_tokenizer") or {}
        self.cuts = (cutting.get("type"), cutting.get("add_prefix_space"), cutting.get("use_regex", True)) == ("ByteLevel", False, True)
        self.cuts &= file.get("normalizer") is None and file.get("post_processor") is None and not any(t.get("normalized") or t.get("single_word") for t in file.get("added_tokens", []))
        self.added = [t["content"].encode() for t in file.get("added_tokens", [])]
        self._forget()

    def _forget(self) -> None:
        self.index: dict[int, int] = {}
        self.pool, self.first, self.count = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)
        self.used = 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, keys: list[int], pieces: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(self.index), int(counts.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(ids) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.first[n : n + len(ids)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(ids)] = counts
        self.index.update(zip(keys, range(n, n + len(ids)), strict=True))
        self.used += total

    def _odd(self, w: T.Words) -> np.ndarray:
        """Texts with white space other than single spaces and line feeds between words, or with an added token."""
        d = w.data
        n = w.last - w.first
        if not len(d) or not self.cuts:
            return np.full(n, not self.cuts)
        blank = (d == 32) | (d == 10)
        bad = ((d >= 9) & (d <= 13) & (d != 10)) | ((d >= 28) & (d <= 31))
        bad[1:] |= blank[1:] & blank[:-1]
        # white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000
        at = np.flatnonzero((d[:-1] == 0xC2) | ((d[:-1] >= 0xE1) & (d[:-1] <= 0xE3)))
        two = d[at].astype(int) * 256 + d[at + 1]
        three = d[np.minimum(at + 2, len(d) - 1)]
        wide = np.isin(two, (0xC285, 0xC2A0, 0xE19A, 0xE281, 0xE380)) | ((two == 0xE280) & ((three <= 0x8A) | np.isin(three, (0xA8, 0xA9, 0xAF))))
        bad[at[wide]] = True
        raw = d.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                bad[at] = True
                at = raw.find(token, at + 1)
        full = w.offsets[1:] > w.offsets[:-1]
        bad[w.offsets[:-1][full]] |= blank[w.offsets[:-1][full]]
        bad[w.offsets[1:][full] - 1] |= blank[w.offsets[1:][full] - 1]
        return np.bincount(np.searchsorted(w.offsets, np.flatnonzero(bad), side="right") - 1, minlength=n)[:n] > 0

    @staticmethod
    def _pieces(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, without the blanks before words."""
        d = w.data
        kind = _kinds()[d]
        latin = np.flatnonzero(d[:-1] == 0xC3)
        kind[latin[(d[latin + 1] != 0x97) & (d[latin + 1] != 0xB7)] + 1] = 0
        odd = np.concatenate([[0], np.cumsum(kind == 3)])
        plain = odd[w.ends] == odd[w.starts]
        turns = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        word = np.searchsorted(w.starts, turns, side="right") - 1
        turns = turns[(word >= 0) & (turns > w.starts[word]) & (turns < w.ends[word]) & plain[word]] if len(w.starts) else turns[:0]
        starts = np.sort(np.concatenate([w.starts, turns]))
        word = np.searchsorted(w.starts, starts, side="right") - 1
        ends = np.minimum(np.concatenate([starts[1:], [len(d)]]), w.ends[word])
        return starts, ends

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in order."""
        for w in T.words(texts, lower=False):
            if len(self.index) > MOST_WORDS:
                self._forget()
            odd = self._odd(w)
            starts, ends = self._pieces(w) if len(w.starts) else (w.starts, w.ends)
            bounds = np.searchsorted(starts, w.offsets)
            owner = np.repeat(np.arange(w.last - w.first), np.diff(bounds))
            # the blank before a word is part of its first piece
            last = w.data[np.maximum(starts - 1, 0)] if len(starts) else np.zeros(0, np.uint8)
            led = ((last == 32) | (last == 10)) & (starts > w.offsets[owner])
            before = np.where(led, last, 0).astype(np.uint64)
            keys = w.spans(starts, ends) ^ T.mix(before)
            keys[odd[owner]] = 0
            distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
            rows = np.fromiter((self.index.get(k, -1) for k in distinct.tolist()), np.int64, len(distinct))
            new = np.flatnonzero((rows < 0) & (distinct != 0))
            if len(new):
                raw = w.data.tobytes()
                spans = zip((starts[where[new]] - led[where[new]]).tolist(), ends[where[new]].tolist(), strict=True)
                self._learn(distinct[new].tolist(), [raw[a:z].decode() for a, z in spans])
                rows[new] = np.arange(len(self.index) - len(new), len(self.index))
            counts = np.where(rows >= 0, self.count[rows], 0)[back]
            begins = self.first[np.maximum(rows, 0)][back]
            upto = np.cumsum(counts)
            ids = self.pool[np.repeat(begins - (upto - counts), counts) + np.arange(upto[-1] if len(upto) else 0)]
            edges = np.concatenate([[0], upto])[bounds]
            for k in range(w.last - w.first):
                if odd[k]:
                    yield self._ids([w.data[w.offsets[k] : w.offsets[k + 1]].tobytes().decode()])[0]
                else:
                    yield ids[edges[k] : edges[k + 1]]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(ids: np.ndarray, planes: str) -> tuple[list[int], bytes]:
    """Planes of a block of ids, each compressed."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bit":
        raw = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        raw = np.ascontiguousarray(rows.T)
    press = zstandard.ZstdCompressor(level=1)
    done = [press.compress(r.tobytes()) for r in raw]
    return [len(d) for d in done], b"".join(done)


def unpack(payload: bytes, sizes: list[int], n: int, planes: str) -> np.ndarray:
    """The ids of a block."""
    ends = np.cumsum(sizes)
    raw = [zstandard.ZstdDecompressor().decompress(payload[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
    rows = np.stack([np.frombuffer(r, np.uint8) for r in raw])
    if planes == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :n].T, axis=1, bitorder="little")
        return np.ascontiguousarray(rows).view("<u4").ravel()
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def _write_task(path: str, end_id: int, block: int, planes: str):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, enc = TaskContext.get().partitionId(), encoder(path)
        held, pieces, ordinal, chunk, first_piece, first_key = bytearray(), [], 0, 0, 0, None

        def cut_block(n: int, more: bool) -> pa.RecordBatch:
            """The first n held ids; `pieces` are exactly their documents, `more`: the last one goes on."""
            nonlocal chunk
            sizes, payload = pack(np.frombuffer(bytes(held[: 4 * n]), "<u4"), planes)
            row = {"shard": shard, "chunk": chunk, "n_ids": n, "first_ordinal": ordinal, "first_piece": first_piece, "doc_ids": [p[0] for p in pieces],
                   "lens": [p[1] for p in pieces], "open": more, "first_key": first_key, "planes": planes, "sizes": sizes, "payload": payload}
            del held[: 4 * n]
            chunk += 1
            return pa.RecordBatch.from_pylist([row], schema=_arrow_schema())

        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                ids = part.column(0).to_pylist()
                if first_key is None and ids:
                    first_key = ids[0]
                for doc, tokens in zip(ids, enc.encode(part.column(1)), strict=True):
                    left = len(tokens) + 1
                    held += tokens.tobytes()
                    held += end
                    while left:
                        room = block - sum(p[1] for p in pieces)
                        took = min(left, room)
                        pieces.append((doc, took))
                        left -= took
                        if took == room:
                            yield cut_block(block, left > 0)
                            ordinal += len(pieces) - (left > 0)
                            first_piece = (first_piece + 1 if len(pieces) == 1 else 1) if left else 0
                            pieces = []
        if pieces:
            yield cut_block(len(held) // 4, False)

    return run


def _arrow_schema() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int32()), ("first_ordinal", pa.int64()), ("first_piece", pa.int32()),
                      ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int32())), ("open", pa.bool_()), ("first_key", pa.int64()),
                      ("planes", pa.string()), ("sizes", pa.list_(pa.int32())), ("payload", pa.binary())])


def write_ids(documents: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, block: int = BLOCK, planes: str = "byte",
              id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the chunks in ascending document id."""
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # the hash parts the rows of one id, or of none
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    with small_batches(documents.sparkSession):
        ordered.mapInArrow(_write_task(tokenizer, end_id, block, planes), CHUNK_SCHEMA).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk index: everything but the payload, with each chunk's first place in the whole sequence of ids."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(folder).drop("payload")
    shards = chunks.groupBy("shard").agg(F.min("first_key").alias("key"), F.sum("n_ids").alias("ids"))  # a row for each file
    sorted_shards = Window.orderBy(F.col("key").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(sorted_shards), F.lit(0)).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.withColumn("__within", F.coalesce(within, F.lit(0))).join(shards, "shard")
    return chunks.withColumn("first_id", (F.col("before") + F.col("__within")).cast("long")).drop("before", "__within")


def _read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("shard", "chunk", "ordinal", "piece", "doc_id", "at", "n", "whole", "crc", "ids")}
        for row in batch.to_pylist():
            raw = unpack(row["payload"], row["sizes"], row["n_ids"], row["planes"]).astype("<u4").tobytes()
            at, last = 0, len(row["lens"]) - 1
            for k, (doc, n) in enumerate(zip(row["doc_ids"], row["lens"], strict=True)):
                piece = row["first_piece"] if k == 0 else 0
                whole = piece == 0 and not (k == last and row["open"])
                own = raw[4 * at : 4 * (at + n)]
                for key, v in (("shard", row["shard"]), ("chunk", row["chunk"]), ("ordinal", row["first_ordinal"] + k), ("piece", piece), ("doc_id", doc), ("at", at),
                               ("n", n), ("whole", whole), ("crc", zlib.crc32(own) if whole else None), ("ids", None if whole else own)):
                    out[key].append(v)
                at += n
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("ordinal", pa.int64()), ("piece", pa.int32()), ("doc_id", pa.int64()),
                                                               ("at", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()), ("crc", pa.int64()), ("ids", pa.binary())]))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. Only documents that cross a block are joined from pieces."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(folder)
    pieces = Tables(spark, "token-pieces").store(
        "pieces", chunks.mapInArrow(_read_task, "shard int, chunk int, ordinal long, piece int, doc_id long, at long, n long, whole boolean, crc long, ids binary")
    )
    whole = pieces.where("whole").select("shard", "chunk", "doc_id", "at", "n", F.col("crc").alias("ids_crc32"))
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.hex("ids").alias("h")))), lambda p: p["h"]), ""))
    first = F.min(F.struct("piece", "chunk", "at", "doc_id"))
    parted = pieces.where("NOT whole").groupBy("shard", "ordinal").agg(first.alias("f"), F.sum("n").alias("n"), joined.alias("all"))
    parted = parted.select("shard", F.col("f.chunk").alias("chunk"), F.col("f.doc_id").alias("doc_id"), F.col("f.at").alias("at"), "n", F.crc32("all").alias("ids_crc32"))
    index = read_index(spark, folder).select("shard", "chunk", "first_id")
    return whole.unionByName(parted).join(index, ["shard", "chunk"]).select("doc_id", (F.col("first_id") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")


def output_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place that spark.checkpoint.dir names."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
