"""Hashes of word sequences, computed over whole Arrow batches at once.

The texts are expected in word form: words joined by single blanks, no blank at either end. A polynomial prefix sum over the bytes of a chunk
gives the hash of every run of words by one subtraction, so the cost is a few passes over the bytes, whatever the number of runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 21
SLOTS = 1 << 20  # of a sketch of counts: 4 MB as sent to the executors, whatever the input
PART = 4096  # slots in one row of a sketch while it is summed


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that every bit depends on every other."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each; a longer text is a range of its own."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls and the offsets of its rows in them."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


_FORM = np.full(256, 32, np.uint8)
for _a, _b, _shift in ((48, 58, 0), (97, 123, 0), (65, 91, 32)):
    _FORM[_a:_b] = np.arange(_a, _b) + _shift


def word_form(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of ASCII letters and digits of each text in lower case, joined by single blanks, and their number. The column has no nulls."""
    data, at = string_bytes(column)
    data = _FORM[data]
    blank = data == 32
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~blank, out=inside[1:])
    lengths = np.diff(at)
    row_start = np.repeat(inside[at[:-1]], lengths)
    last = np.zeros(len(data), bool)
    last[:-1] = ~blank[1:]  # the last blank of a run, before a word
    ends = at[1:][lengths > 0] - 1
    last[ends] = False  # the next word is of the next row
    gap = blank & last & (inside[:-1] > row_start)  # not before the first word
    keep = ~blank | gap
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    gaps = np.zeros(len(data) + 1, np.int64)
    np.cumsum(gap, out=gaps[1:])
    offsets = kept[at]
    n = gaps[at[1:]] - gaps[at[:-1]] + (np.diff(offsets) > 0)
    out = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[keep].tobytes()))
    return out.cast(pa.string()), n


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of every run of k words, repeats included, in order of rows."""
    data, at = string_bytes(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(data)
    blank = data == 32
    start, end = ~blank, ~blank
    start, end = start.copy(), end.copy()
    start[1:] &= blank[:-1]
    end[:-1] &= blank[1:]
    edges = at[1:-1][at[1:-1] < n]
    start[edges] = ~blank[edges]
    before = edges[edges > 0] - 1
    end[before] = ~blank[before]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    row = np.searchsorted(at, a, "right") - 1
    if len(a) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * power[:-1], out=total[1:])
    del power
    inverse = np.full(n + 1, _INVERSE, np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    same = row[: len(row) - k + 1] == row[k - 1 :]
    a, b, row = a[: len(a) - k + 1][same], b[k - 1 :][same], row[: len(row) - k + 1][same]
    return row, mix((total[b] - total[a]) * inverse[a])


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of row and hash once, sorted."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]


def slot_counts(texts: DataFrame, hashes: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """How often the hashes of each slot, their leading 20 bits, occur in the one column of texts. Summed by executors; SLOTS numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for a, b in chunks(batch.column(0)):
                total += np.bincount((hashes(batch.column(0).slice(a, b - a)) >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
        if total.any():
            rows = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).reshape(-1, PART)
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.arange(len(rows), dtype=np.int32)), "counts": pa.array([r.tobytes() for r in rows], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(PART, np.int64)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_buffer(), np.uint32)
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    schema = "part int, counts binary"
    out = np.zeros((SLOTS // PART, PART), np.uint32)
    for r in texts.mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect():
        out[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    return out.reshape(-1)
