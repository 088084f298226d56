"""Vectorised word, shingle and window hashing over Arrow string columns.

Everything here works on the UTF-8 bytes of a slice of rows at once. A slice is
bounded in bytes, not rows, so one very long text only makes one larger slice.
Hashes are 64-bit and the same in every process and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values by rule."""
    return _splitmix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = _stream(256, 11)
_PLACE = _stream(1 << 12, 77) | np.uint64(1)

#: ASCII lower-casing of bytes; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _table(allowed) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for lo, hi in allowed:
        t[lo : hi + 1] = True
    return t


#: Bytes of words after lower-casing: digits, letters and everything beyond ASCII.
ALNUM = _table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
#: Bytes of words between white space.
NONSPACE = ~_table([(0x20, 0x20), (0x09, 0x0D)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        return _splitmix(x)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, offsets of each (n + 1), and which are null. A null text is empty."""
    nulls = np.asarray(column.is_null())
    if nulls.any():
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), nulls
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0], nulls


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text; at least one row each."""
    column = batch.column(batch.schema.get_field_index(text))
    _, off, _ = text_bytes(column)
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


class Words:
    """Words of a slice of texts, in order: place, row, and hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, breaks: np.ndarray | None = None):
        """breaks: places at which a new word begins even though the byte before belongs to one."""
        self.data = LOWER[data]
        self.offsets = offsets
        n = len(data)
        inside = letters[self.data]
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            first = offsets[:-1]
            before[first[first < n]] = False
            if breaks is not None:
                before &= ~breaks
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:] & before[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self._inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        packed = self.data[self._inside]
        at = np.zeros(len(length), np.int64)
        np.cumsum(length[:-1], out=at[1:])
        place = np.arange(len(packed), dtype=np.int64) - np.repeat(at, length)
        with np.errstate(over="ignore"):
            # beyond the table the place itself still weighs in, through the second factor
            value = _BYTE[packed] * _PLACE[place & 4095]
            far = place > 4095
            if far.any():
                value[far] *= (place[far] >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            return _splitmix(np.add.reduceat(value, at) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def counts(self, rows: int) -> np.ndarray:
        """Words of each row."""
        return np.bincount(self.row, minlength=rows).astype(np.int64)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def join(self, i: int, n: int) -> bytes:
        """n words from the i-th on, with one space between."""
        return b" ".join(self.word(k) for k in range(i, i + n))


_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values; len(h) - n + 1 of them, whether or not one row holds the run."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:m].copy()
        for k in range(1, n):
            out *= _STEP
            out += h[k : k + m]
        return _splitmix(out + np.uint64(n))


def within(row: np.ndarray, n: int) -> np.ndarray:
    """Whether each run of n values lies in one row."""
    m = len(row) - n + 1
    return row[:m] == row[n - 1 :] if m > 0 else np.zeros(0, bool)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for length[0] values, then the same for the next."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=at[1:])
    return np.arange(total, dtype=np.int64) - np.repeat(at - start, length)


def runs(flags: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of each maximal run of set flags within a row."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.empty(len(flags), bool)
    new[0] = True
    new[1:] = row[1:] != row[:-1]
    begin = flags.copy()
    begin[1:] &= ~flags[:-1] | new[1:]
    stop = flags.copy()
    stop[:-1] &= ~flags[1:] | new[1:]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def lists(values: np.ndarray, row: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """A list for each row, of the values whose row it is; row ascends."""
    off = np.zeros(rows + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=rows), out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
