"""Binary columns of Arrow batches as arrays: numbers, stretches of bytes and whole groups, for all rows of a batch at once.

A number that lies outside its row's bytes reads as 0, as in the column functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of rows that a task hands on at once.
BATCH_BYTES = 4 << 20
#: Zeros behind the bytes of a column, so that a place just behind them can be read.
BEHIND = 8


def octets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes) of the rows of a binary column; a null is empty."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.zeros(ends[-1] - ends[0] + BEHIND, np.uint8)
    if held is not None:
        data[:-BEHIND] = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    return data, ends[:-1] - ends[0], sizes


def unsigned(data: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Big-endian numbers at places ``at`` of rows."""
    inside = (at >= 0) & (length >= at + size)
    place = np.where(inside, start + at, 0)
    out = np.zeros(len(place), np.int64)
    for i in range(size):
        out = out << 8 | data[place + i]
    return np.where(inside, out, 0)


def signed(data: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    value = unsigned(data, start, length, at, size)
    return np.where(value >= 1 << (8 * size - 1), value - (1 << (8 * size)), value)


def stretches(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of stretches of bytes."""
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    places = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[places])])


def cuts(sizes: np.ndarray, most: int = BATCH_BYTES) -> Iterator[slice]:
    """Slices of rows that hold ``most`` bytes or are one row."""
    ends, first = np.cumsum(sizes), 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield slice(first, last)
        first = last


def groups(column: pa.Array) -> np.ndarray:
    """Places where the value of a sorted column changes, the first and the end among them; nulls are equal."""
    same = pc.fill_null(pc.equal(column[1:], column[:-1]), False)
    both = pc.and_(column[1:].is_null(), column[:-1].is_null())
    return np.concatenate([[0], np.flatnonzero(~pc.or_(same, both).to_numpy(zero_copy_only=False)) + 1, [len(column)]])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of batches that are sorted by a key, cut where the key changes."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(groups(batch.column(key))[-2])
        if last:
            held.append(batch.slice(0, last))
            yield joined()
            held = [batch.slice(last)]
        elif held and held[-1].column(key)[-1] != batch.column(key)[0]:
            yield joined()
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield joined()
