"""Vectorised helpers over the UTF-8 buffers of Arrow string columns.

Spark hands a task its rows as Arrow batches; everything here looks at one batch
as one run of bytes, so that whole texts are split and hashed without a Python
loop over words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of a slice. A longer text is a slice of its own. Spark hands over batches of up to spark.sql.execution.arrow.maxBytesPerBatch (64 MB).
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20

_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE_ROWS rows and about SLICE_BYTES bytes of text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = 0
        while at < n:
            end = int(np.searchsorted(total, total[at] + SLICE_BYTES, "right")) - 1
            end = min(max(end, at + 1), at + SLICE_ROWS, n)
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 16)
        up, down = np.full(m, _ODD, np.uint64), np.full(m, _ODD_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans, from one running polynomial sum."""
    up, down = _power_tables(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:-1], out=run[1:])
    return mixed((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def byte_class(pattern_excludes: Iterable[int]) -> np.ndarray:
    """Truth table of 256 bytes: those that a word may hold."""
    table = np.ones(256, bool)
    table[list(pattern_excludes)] = False
    return table


#: [^\x20\x09-\x0D]+
SPACED = byte_class([0x20, *range(0x09, 0x0E)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing
ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of a slice of texts: byte spans, hashes, and where each text's words begin."""

    def __init__(self, column: pa.Array, table: np.ndarray, lower: bool):
        self.data, self.offsets = utf8(column)
        if lower:
            self.data = LOWER[self.data]
        inside = table[self.data]
        n = len(self.data)
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        self.hash = span_hashes(self.data, self.start, self.end)
        #: words[bounds[i]:bounds[i + 1]] are those of text i
        self.bounds = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of first word, hash) of every run of k words within one text."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[:m] == self.text[k - 1 :])
        value = np.zeros(len(at), np.uint64)
        for j in range(k):
            value = mixed(value * np.uint64(_ODD) + self.hash[at + j])
        return at, value


def point_hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As span_hashes, over code points."""
    up, down = _power_tables(len(points) + 1)
    run = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
    return mixed((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
