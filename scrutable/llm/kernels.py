"""Vectorised helpers that run inside tasks: Arrow text columns, words, rolling hashes.

Texts arrive as Arrow string columns. A batch is cut into slices of about one megabyte of text, so
the working arrays of a task stay small whatever the batch size; one longer text is a slice of its own.
Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTE = np.random.RandomState(20240229).randint(1, 1 << 62, 256).astype(np.uint64)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Record batches cut so that each holds about `limit` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and where each row starts (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (a run without ASCII white space), and each row's first word."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        size = max(n, 2 * len(_POWERS[kind]), 1 << 16)
        base = np.full(size, _ODD if kind == "up" else _INVERSE, np.uint64)
        base[0] = 1
        _POWERS[kind] = np.cumprod(base, dtype=np.uint64)
    return _POWERS[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for every span at once, the same wherever the span lies."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers("up", len(values)), out=total[1:])
    return mix((total[end] - total[start]) * _powers("down", len(values) + 1)[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE[data], start, end)


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of `size` words that lies in one row, and each row's first window."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=bounds[1:])
    return np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], counts), bounds


def shingles(column, size: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted set of word-shingle hashes, end to end, and where each row starts.

    A row with fewer words than `size` has its whole word sequence as its one shingle; without words, none.
    """
    data, offsets = text_bytes(column)
    start, end, first = word_spans(data, offsets)
    words = word_hashes(lower_ascii(data) if lower else data, start, end)
    at, _ = windows(first, size)
    row = np.repeat(np.arange(len(first) - 1), np.maximum(np.diff(first) - size + 1, 0))
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < size))
    begin = np.concatenate([at, first[short]])
    stop = np.concatenate([at + size, first[short + 1]])
    row = np.concatenate([row, short])
    h = span_hashes(words, begin, stop)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(first)))
