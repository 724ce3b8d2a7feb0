"""Vectorised word hashing shared by the operators whose tasks work on Arrow batches.

A batch of texts is seen as one byte array. Words are the maximal runs of bytes other than
space, \\t, \\n, \\v, \\f and \\r. The hash of a word mixes two polynomials over random values of its bytes, one modulo 2^64 and one modulo a
prime: words exist whose polynomials modulo 2^64 agree for every base, and the prime tells them apart. Both are taken from running sums, so a
batch costs a few numpy passes whatever its texts look like.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEPARATORS = (9, 10, 11, 12, 13, 32)
CHUNK_BYTES = 1 << 20

PRIME = (1 << 31) - 1

_state: dict = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo the prime."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:n].astype(np.uint32)


def _tables(n: int) -> dict[str, np.ndarray]:
    """Byte values (as they are, and with A-Z lowered), separators, powers and inverse powers up to n; `_p`: modulo the prime."""
    if "plain" not in _state:
        plain = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        lower = plain.copy()
        lower[65:91] = plain[97:123]
        sep = np.zeros(256, bool)
        sep[list(SEPARATORS)] = True
        plain_p = np.random.default_rng(20250917).integers(1, PRIME, 256, dtype=np.uint64)
        lower_p = plain_p.copy()
        lower_p[65:91] = plain_p[97:123]
        _state.update(plain=plain, lower=lower, plain_p=plain_p, lower_p=lower_p, sep=sep, pow=np.ones(1, np.uint64), inv=np.ones(1, np.uint64), pow_p=np.ones(1, np.uint32), inv_p=np.ones(1, np.uint32))
    if len(_state["pow"]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        base = 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            for key, b in (("pow", base), ("inv", pow(base, -1, 1 << 64))):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                _state[key] = np.cumprod(steps, dtype=np.uint64)
        base_p = 1_284_865_837
        _state.update(pow_p=_powers(base_p, size), inv_p=_powers(pow(base_p, -1, PRIME), size))
    return _state


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Word hashes of the texts first..last of a batch; text i owns hashes[bounds[i - first]:bounds[i - first + 1]]."""

    first: int
    last: int
    hashes: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray
    sums_p: np.ndarray

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of other stretches of the chunk's bytes."""
        return _spans(self.sums, self.sums_p, starts, ends)

    def owners(self) -> np.ndarray:
        """For each word, the number of its text in this chunk."""
        return np.repeat(np.arange(self.last - self.first), np.diff(self.bounds))


def _spans(sums: np.ndarray, sums_p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    t, p = _state, np.uint64(PRIME)
    low = (sums_p[ends] - sums_p[starts]) % p * t["inv_p"][starts].astype(np.uint64) % p
    return mix((sums[ends] - sums[starts]) * t["inv"][starts] + mix(low))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `most` bytes; a longer text is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(texts: pa.Array, lower: bool = True, most: int = CHUNK_BYTES) -> Iterator[Words]:
    """Hash every word of every text, chunk by chunk."""
    data, offsets = buffers(texts)
    for i, j in chunks(offsets, most):
        offs = offsets[i : j + 1] - offsets[i]
        b = data[offsets[i] : offsets[j]]
        t = _tables(len(b))
        inside = ~t["sep"][b]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offs[1:-1]
        edges = edges[(edges > 0) & (edges < len(b))]
        start[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        total, total_p = np.zeros(len(b) + 1, np.uint64), np.zeros(len(b) + 1, np.uint64)
        kind = "lower" if lower else "plain"
        values = t[kind][b]
        values *= t["pow"][: len(b)]
        np.cumsum(values, out=total[1:])
        np.take(t[f"{kind}_p"], b, out=values, mode="clip")
        values *= t["pow_p"][: len(b)]
        values %= np.uint64(PRIME)
        np.cumsum(values, out=total_p[1:])
        del values
        yield Words(i, j, _spans(total, total_p, s, e), np.searchsorted(s, offs), b, offs, s, e, total, total_p)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each of the first len - n + 1 words (text edges are the caller's matter)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k, c in enumerate(_factors(n)):
        out += hashes[k : k + m] * c
    return mix(out)


def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(w: Words, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, its distinct shingle hashes in ascending order). Fewer than `size` words make one shingle; none make none."""
    grams = ngram_hashes(w.hashes, size)
    factors = _factors(size)
    for k in range(w.last - w.first):
        a, z = int(w.bounds[k]), int(w.bounds[k + 1])
        n = z - a
        if n >= size:
            g = np.sort(grams[a : z - size + 1])
            keep = np.empty(len(g), bool)
            keep[0] = True
            np.not_equal(g[1:], g[:-1], out=keep[1:])
            yield w.first + k, g[keep]
        elif n:
            yield w.first + k, mix(np.array([(w.hashes[a:z] * factors[:n]).sum(dtype=np.uint64) ^ np.uint64(n)], np.uint64))
        else:
            yield w.first + k, np.zeros(0, np.uint64)
