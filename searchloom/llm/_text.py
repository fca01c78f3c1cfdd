"""Vectorised text helpers for Arrow batches: word bounds, line bounds and 64-bit hashes over UTF-8 bytes.

All helpers work on one slice of a batch at a time, so a task holds a few megabytes of text however large
its partition is. White space is the ASCII set x20, x09-x0D; letters are lowered only in A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 19
LONG = 256  # bytes beyond which a span is hashed by itself

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_STEP, -1, 1 << 64)
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # keeps the first n bytes of a lane
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            base, back = np.full(size, _STEP, np.uint64), np.full(size, _INVERSE, np.uint64)
            base[0] = back[0] = 1
            _powers, _inverses = np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty, and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; a longer row is a run of its own."""
    data, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, at + 60_000, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal for equal bytes.

    Lanes of eight bytes are chained through mix(), which is no sum of bytes by place: spans of one lane and one length
    never collide, others do by chance alone. A span beyond LONG bytes has its XXH3. Two seeds give 128 bits.
    """
    size = ends - starts
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    with np.errstate(over="ignore"):
        h = mix((size.astype(np.uint64) + np.uint64(seed * 0x51ED270B + 1)) * np.uint64(_STEP))
        live = np.flatnonzero((size > 0) & (size <= LONG))
        done = 0
        while len(live):
            left = size[live] - done
            h[live] = mix((h[live] ^ (lanes[starts[live] + done] & _FIRST[np.minimum(left, 8)])) * np.uint64(0xD6E8FEB86659FD93))
            live, done = live[left > 8], done + 8
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows, and each row's first word's index (one more entry at the end)."""
    solid = ~SPACE[data]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[first] = solid[first]
    last = first[first > 0] - 1
    stop[last] = solid[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive entries, len(h) - k + 1 of them, whatever row they belong to."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k > 6:
        powers, inverses = _grown(len(h) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * powers[: len(h)], out=total[1:])
            return mix((total[k:] - total[:n]) * inverses[:n] + np.uint64(k))
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out = out * np.uint64(_STEP) + h[j : j + n]
        return mix(out + np.uint64(k))


def inside(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k entries fit into one row, and their rows, for rows bounded by `bounds`."""
    counts = np.maximum(np.diff(bounds) - (k - 1), 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    shift = np.cumsum(counts) - counts
    return np.arange(len(rows)) - np.repeat(shift - bounds[:-1], counts), rows


def shingles(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True):
    """Distinct hashed k-word shingles of each row, ascending: (values, bounds of rows, words in each row).

    A row of fewer than k words has its whole sequence as one shingle; a row without words has none.
    """
    data = LOWER[data] if lower else data
    starts, ends, bounds = words(data, offsets)
    h = spans(data, starts, ends)
    counts = np.diff(bounds)
    sizes = np.where(counts >= k, counts - (k - 1), counts > 0)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    values, rows = np.zeros(cuts[-1], np.uint64), np.repeat(np.arange(len(counts)), sizes)
    short = np.flatnonzero((counts > 0) & (counts < k))
    long = np.ones(len(values), bool)
    long[cuts[short]] = False
    at = inside(bounds, k)[0]
    if len(at):
        values[long] = grams(h, k)[at]
    with np.errstate(over="ignore"):
        for n in range(1, k):  # rows of n words
            mine = short[counts[short] == n]
            total = np.full(len(mine), n * 977, np.uint64)
            for j in range(n):
                total += h[bounds[mine] + j] * np.uint64(pow(_STEP, j, 1 << 64))
            values[cuts[mine]] = mix(total)
    if len(values) < 64 * len(counts):
        order = np.argsort(values)
        order = order[np.argsort(rows[order].astype(np.uint16), kind="stable")]
        values = values[order]
    else:  # rows are sorted one by one where they are long
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[fresh], rows[fresh]
    return values, np.searchsorted(rows, np.arange(len(offsets))), counts
