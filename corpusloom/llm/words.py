"""Vectorised words and word hashes over Arrow text buffers.

Texts are UTF-8 bytes. A separator table of 256 entries says which bytes end a
word; A-Z count as a-z. All work is on flat numpy arrays, in slices of about a
megabyte, so memory does not depend on the batch and only the longest text is
ever held as arrays at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The words of the contracts: everything but U+0020 and U+0009 to U+000D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Words of letters and digits: ASCII punctuation and controls separate too, bytes of other scripts don't.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 at least of the base and of its inverse. Those of an ordinary slice are kept, those of a longer text aren't."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = max(n, SLICE_BYTES * 5 // 4)
    up, down = np.full(size, _BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if n <= SLICE_BYTES * 5 // 4:
        _powers = tables
    return tables


def forget_powers() -> None:
    global _powers
    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


@dataclass
class Words:
    """Words of consecutive rows: row number, byte bounds inside `text`, and a hash of the lower-cased bytes."""

    first_row: int
    n_rows: int
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray  # lower-cased bytes
    sums: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.row - self.first_row, minlength=self.n_rows)

    def bounds(self) -> np.ndarray:
        """Positions in the arrays at which each row begins, and the end."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = power_tables(len(self.text) + 1)
        return mix((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(np.uint64))


def as_binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as large binary without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    return pc.fill_null(column, pa.scalar(b"", pa.large_binary())) if column.null_count else column


def words_of(column: pa.Array, separators: np.ndarray = SPACES, need_hash: bool = True) -> Iterator[Words]:
    """The words of each row, in slices of consecutive rows that cover all rows."""
    column = as_binary(column)
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        last = min(last, n)
        at = offsets[row : last + 1] - offsets[row]
        text = data[offsets[row] : offsets[last]]
        inside = ~separators[text]
        before = np.empty(len(text) + 1, bool)
        before[0] = False
        before[1:] = inside
        after = np.empty(len(text) + 1, bool)
        after[:-1] = inside
        after[-1] = False
        before[at] = False
        after[at] = False
        start = np.flatnonzero(inside & ~before[:-1])
        end = np.flatnonzero(inside & ~after[1:]) + 1
        rows = row + np.searchsorted(at, start, side="right") - 1
        lower = _LOWER[text]
        if need_hash:
            up, _ = power_tables(len(text) + 1)
            sums = np.empty(len(text) + 1, np.uint64)
            sums[0] = 0
            np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
        else:
            sums = np.zeros(0, np.uint64)
        w = Words(row, last - row, rows, start, end, np.zeros(0, np.uint64), lower, sums)
        if need_hash:
            w.hash = w.span_hash(start, end)
        yield w
        row = last


#: Odd multipliers, one for each place in a shingle.
PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word's index, hash) of each run of k words within a row."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += w.hash[i : i + n] * PLACES[i % 64]
    whole = np.flatnonzero(w.row[:n] == w.row[k - 1 :])
    return whole, mix(total[whole])


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
