"""Source maps: base64 VLQ mappings decoded to sorted generated ranges, and stack frames placed in them by an as-of join.

`segments` turns a table of maps into one row for each mapped place; `place_frames` gives each frame the last segment of its generated file and line that
begins at or before its column. A map's mappings are decoded as arrays: one array of digits, values where a digit ends one, running sums for what
the format keeps as differences. A map is one unit by nature; frames and segments are joined by (file, line), never gathered.

Cases: a map that is no JSON object of version 3, is an index of sections or has broken mappings gives no segments, and its frames stay as they are, as do
frames of unmapped files, lines and columns; a segment without a source ends the range before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.joins import as_of

#: Fixed: the digits of base64 in order.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_VALUES = np.full(256, -1, np.int64)
_VALUES[np.frombuffer(DIGITS.encode(), np.uint8)] = np.arange(64)
_SEGMENTS = "file string, line int, column int, source string, source_line int, source_column int, name string"


def decode(mappings: str) -> np.ndarray | None:
    """Rows (line, column, source, source line, source column, name) of a mappings text, all from 0, -1 where there is none; None if it is broken."""
    raw = np.frombuffer(mappings.encode("ascii", "replace"), np.uint8)
    mark = (raw == 44) | (raw == 59)
    digit = _VALUES[raw]
    if (digit[~mark] < 0).any():
        return None
    at = np.flatnonzero(~mark)
    if not len(at):
        return np.zeros((0, 6), np.int64)
    d = digit[at]
    last = d < 32
    # a value is a run of digits up to one without the continuation bit; it may not run over a mark
    ends = np.flatnonzero(last)
    begins = np.concatenate([[0], ends[:-1] + 1])
    if not last[-1] or (at[ends] - at[begins] != ends - begins).any() or (ends - begins > 11).any():
        return None
    place = np.arange(len(d)) - np.repeat(begins, ends - begins + 1)
    value = np.add.reduceat((d & 31) << (5 * place), begins)
    value = np.where(value & 1, -(value >> 1), value >> 1)
    # which segment and line each value is in
    segment = np.cumsum(mark)[at[begins]]
    line = np.cumsum(raw == 59)[at[begins]]
    first = np.flatnonzero(np.diff(segment, prepend=-1))
    width = np.diff(np.append(first, len(segment)))
    if not np.isin(width, (1, 4, 5)).all():
        return None
    out = np.full((len(first), 6), -1, np.int64)
    out[:, 0] = line[first]
    column = np.cumsum(value[first])
    new = np.flatnonzero(np.diff(out[:, 0], prepend=-1))  # columns start anew on each line
    out[:, 1] = column - np.repeat(column[new] - value[first][new], np.diff(np.append(new, len(first))))
    placed, named = width >= 4, width == 5
    for k in range(1, 4):
        out[placed, k + 1] = np.cumsum(value[first[placed] + k])
    out[named, 5] = np.cumsum(value[first[named] + 4])
    return None if (out[:, 1] < 0).any() or (out[placed, 2:5] < 0).any() else out


def encode(rows: list[tuple[int, ...]]) -> str:
    """The mappings text of rows (line, column) or (line, column, source, source line, source column[, name]) in order, all from 0."""

    def vlq(n: int) -> str:
        n, text = (-n << 1 | 1) if n < 0 else n << 1, ""
        while True:
            n, d = n >> 5, n & 31
            text += DIGITS[d | (32 if n else 0)]
            if not n:
                return text

    out, line, column, held = [], 0, 0, [0, 0, 0, 0]
    text = ""
    for row in rows:
        if row[0] > line:
            text += ",".join(out) + ";" * (row[0] - line)
            out, line, column = [], row[0], 0
        part = vlq(row[1] - column)
        column = row[1]
        for k, v in enumerate(row[2:]):
            part += vlq(v - held[k])
            held[k] = v
        out.append(part)
    return text + ",".join(out)


def encode_array(rows: np.ndarray) -> str:
    """encode() of rows with a source each and no name, five columns in order, as arrays: the same text."""
    if not len(rows):
        return ""
    lines = np.diff(rows[:, 0], prepend=0)
    values = np.diff(rows[:, 1:], axis=0, prepend=np.zeros((1, 4), np.int64))
    values[lines > 0, 0] = rows[lines > 0, 1]  # columns start anew on each line
    signed = np.where(values < 0, (-values << 1) | 1, values << 1).ravel()
    digits = np.maximum(1, (np.frexp(signed.astype(np.float64))[1] + 4) // 5)
    # before a segment stand its line's marks, or a comma between two of one line
    marks = np.where(lines > 0, lines, 1)
    marks[0] = lines[0]
    sizes = digits.reshape(-1, 4).sum(axis=1) + marks
    out = np.full(int(sizes.sum()), 44, np.uint8)
    begins = np.cumsum(sizes) - sizes
    new = np.repeat(begins, lines) + np.arange(lines.sum()) - np.repeat(np.cumsum(lines) - lines, lines)
    out[new] = 59
    ends = np.cumsum(digits)
    place = np.arange(ends[-1]) - np.repeat(ends - digits, digits)
    digit = (np.repeat(signed, digits) >> (5 * place)) & 31
    digit |= np.where(place < np.repeat(digits, digits) - 1, 32, 0)
    first = np.repeat(np.cumsum(marks), 4) + ends - digits
    out[np.repeat(first, digits) + place] = np.frombuffer(DIGITS.encode(), np.uint8)[digit]
    return out.tobytes().decode()


def source_path(source: Column) -> Column:
    """A source's path without a bundler's scheme and leading dots."""
    return F.regexp_replace(F.regexp_replace(source, r"^webpack://[^/]*/", ""), r"^(\./)+", "")


def _read(text: str | None) -> tuple[dict, np.ndarray] | None:
    try:
        m = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(m, dict) or m.get("version") != 3 or "sections" in m or not isinstance(m.get("mappings"), str):
        return None
    rows = decode(m["mappings"])
    names, sources = m.get("names") or [], m.get("sources") or []
    if rows is None or (len(rows) and (rows[:, 2].max() >= len(sources) or rows[:, 5].max() >= len(names))):
        return None
    return m, rows


def _segment_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("source", pa.string()), ("source_line", pa.int32()), ("source_column", pa.int32()), ("name", pa.string())])
    for batch in batches:
        for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = _read(text)
            if found is None or not len(found[1]):
                continue
            m, rows = found
            root = (m.get("sourceRoot") or "").rstrip("/")
            sources = [None if s is None else f"{root}/{s}" if root else s for s in m.get("sources") or []] + [None]
            names = [*(m.get("names") or []), None]
            number = lambda v: pa.array(np.where(v < 0, 0, v + 1).astype(np.int32), mask=v < 0)
            columns = [pa.array([file] * len(rows)), number(rows[:, 0]), number(rows[:, 1]), pa.array([sources[k] for k in rows[:, 2]], pa.string()), number(rows[:, 3]), number(rows[:, 4]), pa.array([names[k] for k in rows[:, 5]], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def segments(maps: DataFrame) -> DataFrame:
    """maps(file, map) -> file, line, column, source, source_line, source_column, name: every mapped place, lines and columns from 1 as in a stack."""
    rows = maps.select(F.col("file").cast("string").alias("file"), F.col("map").cast("string").alias("map")).where("file IS NOT NULL").mapInArrow(_segment_task, _SEGMENTS)
    return rows.withColumn("source", source_path(F.col("source")))


def place_frames(frames: DataFrame, mapped: DataFrame) -> DataFrame:
    """frames(file, line, column, ...) with source, source_line, source_column and name of their place, null where no map covers it.

    Segments of files and lines that no frame names are dropped before the two are ordered together.
    """
    typed = frames.withColumn("column", F.col("column").cast("int")).withColumn("line", F.col("line").cast("int"))
    mapped = mapped.join(typed.select("file", "line").distinct(), ["file", "line"], "left_semi")
    hit = as_of(typed, mapped, ["file", "line"], "column", strict=False)
    return hit.select(*typed.columns, *[F.col(f"match.{c}").alias(c) for c in ("source", "source_line", "source_column", "name")])
