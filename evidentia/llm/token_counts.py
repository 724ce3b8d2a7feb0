"""Token counts by rank-synchronous array merging.

A tokenizers file of the byte-level BPE kind cuts a text into pre-tokens and merges each one's symbols pair by pair, lowest rank first.
Only the number of symbols that survive is wanted here, so nothing is encoded: the distinct pre-tokens of a stretch of a batch are held as
one ragged numpy array of symbols; in every round each pre-token's pair of lowest rank is applied wherever it stands in it, in all
pre-tokens at once; a pre-token without a pair left is done, and its symbols are counted. Counts of pre-tokens are remembered per worker.

Applying all occurrences of a pair at once gives what merging them one by one, leftmost first, gives, unless the symbol that the merge
makes is part of a pair of lower rank (several merges may make one symbol). Such ranks are known from the file; there only the leftmost
occurrence is applied in a round. Overlapping occurrences (of a pair of equal symbols) are taken from the left.

A long pre-token (without white space, of thousands of symbols) has many rounds, each of which would read it all: its pairs are kept by
rank instead, so that a round touches the occurrences of one rank and their neighbours only.

Cases: a null or empty text has no bytes and no tokens; very long texts are cut in stretches before white space, where a pre-token always
ends; null ids and repeated rows are documents of their own; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text whose new pre-tokens are merged together, and of a stretch of a long text.
BATCH_CHARS = 1 << 20
STRETCH_CHARS = 1 << 16
#: Pre-tokens remembered by a worker (a full memory is emptied), and the longest ones that are.
MOST_PIECES = 300_000
LONGEST_PIECE = 64
#: Symbols from which on a pre-token's pairs are kept by rank.
LONG_PIECE = 1 << 11
NONE = np.int32(2**31 - 1)
#: Fixed: the cut of byte-level tokenizers into pre-tokens.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_counters: dict = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters for themselves, the others by U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeTable:
    """Pairs of symbols by rank, as arrays."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        left, right, made = (np.fromiter((vocab[p] for p in part), np.int64, len(pairs)) for part in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = left << 32 | right
        self.order = np.argsort(keys).astype(np.int32)
        self.keys, self.made = keys[self.order], made
        self.bytes = np.array([vocab[c] for c in _byte_letters()], np.int64)
        # the lowest rank of a pair with this symbol in it; a merge that makes a symbol of a lower one is done one by one
        first = np.full(max(vocab.values()) + 1, NONE, np.int64)
        for part in (left, right):
            np.minimum.at(first, part, np.arange(len(pairs)))
        self.single = first[made] < np.arange(len(pairs))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], NONE).astype(np.int32)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols each pre-token is left with."""
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        for k in np.flatnonzero(lens >= LONG_PIECE):
            out[k] = self._count_long(pieces[k])
        who = np.flatnonzero((lens > 0) & (lens < LONG_PIECE))
        out[who] = self._count_ragged([pieces[k] for k in who.tolist()], lens[who]) if len(who) else 0
        return out

    def _count_ragged(self, pieces: list[bytes], lens: np.ndarray) -> np.ndarray:
        sym = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        out, who = np.zeros(len(pieces), np.int64), np.arange(len(pieces))
        rank = np.full(len(sym), NONE)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[np.cumsum(lens) - 1] = NONE
        while len(who):
            starts = np.cumsum(lens) - lens
            least = np.minimum.reduceat(rank, starts)
            going = least < NONE
            if not going.all():
                out[who[~going]] = lens[~going]
                keep = np.repeat(going, lens)
                sym, rank, who, lens, least = sym[keep], rank[keep], who[going], lens[going], least[going]
                starts = np.cumsum(lens) - lens
                if not len(who):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lens))
            owner = np.repeat(np.arange(len(who)), lens)[at]
            first = np.ones(len(at), bool)
            first[1:] = owner[1:] != owner[:-1]
            taken = ~self.single[least[owner]] | first
            at, owner = at[taken], owner[taken]
            own = _every_other(at, at + 1)
            at, owner = at[own], owner[own]
            sym[at] = self.made[least[owner]]
            rank[at] = rank[at + 1]  # NONE if the right symbol was the last
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = at - np.arange(len(at))  # each merge before moves it by one
            sym, rank = sym[keep], rank[keep]
            lens = lens - np.bincount(owner, minlength=len(who))
            starts = np.cumsum(lens) - lens
            inner = place[place + 1 < np.repeat(starts + lens, np.bincount(owner, minlength=len(who)))]
            before = place[place > starts[owner]] - 1
            fresh = np.concatenate([inner, before])
            rank[fresh] = self.ranks(sym[fresh], sym[fresh + 1])
        return out

    def _count_long(self, piece: bytes) -> int:
        sym = self.bytes[np.frombuffer(piece, np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, NONE)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        held: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            if len(at):
                at = at[np.argsort(rank[at], kind="stable")]
                edges = np.flatnonzero(np.diff(rank[at])) + 1
                for part in np.split(at, edges):
                    r = int(rank[part[0]])
                    if r not in held:
                        held[r] = []
                        heapq.heappush(heap, r)
                    held[r].append(part)

        put(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(held.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.single[r]:
                put(at[1:])
                at = at[:1]
            at = at[_every_other(at, after[at])]
            gone = after[at]
            n -= len(at)
            sym[at] = self.made[r]
            rank[gone] = NONE
            after[at] = after[gone]
            inner = after[at] < len(sym)
            before[after[at][inner]] = at[inner]
            rank[at[~inner]] = NONE
            left = before[at]
            fresh = np.unique(np.concatenate([at[inner], left[left >= 0]]))
            rank[fresh] = self.ranks(sym[fresh], sym[after[fresh]])
            put(fresh)
        return n


def _every_other(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of places whose pairs overlap (the next place is where this pair ends), the first, the third and so on of each run."""
    if not len(at):
        return np.zeros(0, bool)
    begins = np.ones(len(at), bool)
    begins[1:] = at[1:] != following[:-1]
    run_start = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    return (np.arange(len(at)) - run_start) % 2 == 0


class Counter:
    """Counts tokens of whole texts with a tokenizers file: byte-level BPE without a normalizer, as the library reads it."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cutting = file["model"], file.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain &= (cutting.get("type"), bool(cutting.get("add_prefix_space")), cutting.get("use_regex", True)) == ("ByteLevel", False, True)
        added = file.get("added_tokens", [])
        plain &= file.get("normalizer") is None and not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))
        if not plain:
            raise ValueError("token counts are merged for byte-level BPE files without a normalizer")
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.table = MergeTable(model["vocab"], model["merges"])
        self.cut = regex.compile(CUT)
        self.kinds = (regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\s"))
        self.turn = regex.compile(r"(?<=\S)\s")
        # the longest of the tokens that begin at a place is taken
        names = sorted((t["content"] for t in added if t["content"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.known = set(map(chr, range(128)))
        self.moved: dict[int, str] = {}
        self.memory: dict[str, int] = {}

    def _learn_letters(self, letters: set[str]) -> None:
        """Unicode grows, and the library's tables may be older than those read here: each new character is shown to the library's own cut."""
        for c in letters:
            beside = [len(self.cutter.pre_tokenize_str(s)) == 1 for s in ("a" + c, "1" + c, "!" + c)]
            kind = next((k for k, one in zip("a1!", beside, strict=True) if one), "\n")
            here = next((k for k, p in zip("a1\n", self.kinds, strict=True) if p.match(c)), "!")
            if kind != here:
                self.moved[ord(c)] = kind
        self.known |= letters

    def _stretches(self, text: str) -> Iterator[str]:
        """The text between added tokens, cut before white space that follows other characters."""
        at, n = 0, len(text)
        while n - at > STRETCH_CHARS:
            found = self.turn.search(text, at + STRETCH_CHARS)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a stretch."""
        if not text.isascii():
            letters = set(text)
            if not letters <= self.known:
                self._learn_letters(letters - self.known)
            if self.moved and not letters.isdisjoint(map(chr, self.moved)):
                return [text[m.start() : m.end()] for m in self.cut.finditer(text.translate(self.moved))]
        return self.cut.findall(text)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        chars = 0
        for k, text in enumerate(texts):
            parts = [text or ""]
            if self.added is not None and text and self.added.search(text):
                out[k] += sum(1 for _ in self.added.finditer(text))
                parts = self.added.split(text)
            for part in parts:
                for stretch in self._stretches(part):
                    if stretch:
                        held.append((k, self.pieces(stretch)))
                        chars += len(stretch)
                        if chars >= BATCH_CHARS:
                            self._settle(held, out)
                            held, chars = [], 0
        self._settle(held, out)
        return out

    def _settle(self, held: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        if len(self.memory) > MOST_PIECES:
            self.memory.clear()
        new = list(set().union(*(p for _, p in held)) - self.memory.keys())
        counted = dict(zip(new, self.table.counts([p.encode() for p in new]).tolist(), strict=True))
        self.memory.update(counted)
        for k, pieces in held:
            out[k] += sum(map(self.memory.__getitem__, pieces))
        for p in new:
            if len(p) > LONGEST_PIECE:
                del self.memory[p]


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _task(path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                n_bytes = pc.fill_null(pc.cast(pc.binary_length(part.column(1)), pa.int64()), 0)
                yield pa.RecordBatch.from_arrays([part.column(0), n_bytes, pa.array(count(part.column(1).to_pylist()))], schema=schema)

    return run


def count_tokens(documents: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every document: one pass over the texts, without a shuffle.

    The tokenizers file is read by its path on every worker, as the library reads it.
    """
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    counted = docs.mapInArrow(_task(tokenizer, schema), "id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
