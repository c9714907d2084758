"""Words of whole Arrow text columns as numpy arrays: boundaries, documents and 64-bit hashes, without a loop by word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, 1 << 20), base, np.uint64)
        p[0] = 1
        _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers[name][:n]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes; a longer document is a range of its own."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


@dataclass
class Words:
    start: np.ndarray  # byte offsets
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # of each document and the end: index of its first word
    hash: np.ndarray


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of buf[start:end], mixed; equal for equal bytes wherever they stand."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers("up", BASE, n), out=sums[1:])
    return mixed((sums[end] - sums[start]) * powers("down", UNBASE, n + 1)[start])


def words_of(buf: np.ndarray, offsets: np.ndarray, lower: bool, between: np.ndarray = SPACE) -> Words:
    """The maximal runs of bytes that are not `between`, within documents."""
    n, docs = len(buf), len(offsets) - 1
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(docs + 1, np.int64), np.zeros(0, np.uint64))
    word = ~between[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[[0, n]] = True
    start = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
    end = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(start, end, doc, np.searchsorted(start, offsets), span_hashes(LOWER[buf] if lower else buf, start, end))


def stretches(buf: np.ndarray, between: np.ndarray = SPACE, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` bytes that end behind a byte of `between`, so that long texts are read piece by piece."""
    at, n = 0, len(buf)
    while at < n:
        to = min(n, at + limit)
        while to < n and not between[buf[to - 1]]:
            gap = np.flatnonzero(between[buf[to : to + limit]])
            to = to + int(gap[0]) + 1 if len(gap) else min(n, to + limit)
        yield at, to
        at = to


#: Five digits of every id below 100,000, the place of what follows, and which of them are written.
DIGITS = np.full((100_000, 6), 48, np.uint8)
for _k in range(5):
    DIGITS[:, _k] += (np.arange(100_000) // 10 ** (4 - _k) % 10).astype(np.uint8)
WRITTEN = np.ones((100_000, 6), bool)
for _k in range(4):
    WRITTEN[:, _k] = np.arange(100_000) >= 10 ** (4 - _k)


def decimals(ids: np.ndarray, after: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the ids in decimal, each followed by a byte; where each one ends)."""
    rows = DIGITS[ids]
    rows[:, 5] = after
    keep = WRITTEN[ids]
    return rows[keep], np.cumsum(keep.sum(1))
