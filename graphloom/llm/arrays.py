"""Vectorised views of text columns: words, hashes and shingles as flat numpy arrays with offsets.

Text is handled as UTF-8 bytes. A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Hashes are 64-bit; two
different words or shingles meet with a chance of 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


#: What operators keep in a worker from one partition to the next, by operator.
CACHES: dict[str, dict] = {}


def _begin(keeps: str) -> None:
    for name, cache in CACHES.items():
        if name != keeps:
            cache.clear()


def _end() -> None:
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable, keeps: str = "") -> Callable:
    """The same partition function for a worker that is used again: caches of other operators than ``keeps`` are dropped at
    its start, and memory that it has freed goes back to the system at its end."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(keeps)
        try:
            yield from run(batches)
        finally:
            _end()

    return lean


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n-1."""
    if len(_powers.get("up", ())) < max(1, n):
        size = (int(n) // (1 << 20) + 1) << 20
        for name, b in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (data[j] + 1) * BASE**j over j < i; span_hash reads hashes of substrings from it."""
    up, _ = powers(len(data))
    p = np.empty(len(data) + 1, np.uint64)
    p[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal strings have equal hashes wherever they stand."""
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string column; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        _, off = utf8(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's range in them (rows + 1)."""
    inside = ~SPACE[data]
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, off: np.ndarray, part: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each lower-cased word, and each row's range in them (rows + 1). Rows are taken ``part`` bytes at a time."""
    hashes, rows, at, base = [], [np.zeros(1, np.int64)], 0, 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + part, "right")) - 1)
        low = LOWER[data[off[at] : off[to]]]
        starts, ends, r = word_spans(low, off[at : to + 1] - off[at])
        hashes.append(span_hash(prefix_hash(low), starts, ends))
        rows.append(r[1:] + base)
        base, at = base + len(starts), to
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.concatenate(rows)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words; entry i covers words i..i+size-1, rows not heeded."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0xC6A4A7935BD1E995) + words[k : k + n]
    return mix(h)


def shingles(words: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All shingles (with repeats) and each row's range in them. Fewer than ``size`` words make one shingle; none make none."""
    n = np.diff(rows)
    full = window_hashes(words, size)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_rows = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(out_rows[-1], np.uint64)
    long = np.flatnonzero(n >= size)
    if len(long):
        src = spread(rows[:-1][long], counts[long])
        out[spread(out_rows[:-1][long], counts[long])] = full[src]
    for r in np.flatnonzero((n > 0) & (n < size)):
        out[out_rows[r]] = window_hashes(words[rows[r] : rows[r + 1]], int(n[r]))[0]
    return out, out_rows


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), then those of starts[1], and so on."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - first, counts)


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, sorted, and the new ranges."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], np.searchsorted(r[keep], np.arange(len(rows)))
