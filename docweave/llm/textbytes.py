"""Vectorised word and shingle hashing over the UTF-8 bytes of Arrow string columns.

Texts are handled as one byte buffer per slice of a batch, so the cost is a few
numpy passes per byte and memory is bounded by ``SLICE_BYTES`` (or by the longest
single text), whatever the batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0xD6E8FEB86659FD93)

#: Bytes that belong to a word, by the two word definitions in use.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash base and its inverse to the powers 0..n-1 modulo 2**64, kept per process."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, _BASE_INV)]
    return _powers[0], _powers[1]


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Yield (first row, buffer, offsets, valid) for runs of rows of at most ``limit`` bytes.

    ``buffer`` is the rows' bytes, ``offsets`` has one more entry than rows; null rows
    are empty and False in ``valid``.
    """
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i], valid[i:j]
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and each row's first word (one more entry than rows)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = table[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: polynomial prefix sums, then a finaliser."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive word hashes (rows are not told apart here)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _STEP + h[j : j + n]
    return mix(out + np.uint64(k))


def row_windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each row, in row order, and where each row's begin (one more entry than rows);
    a row of fewer words, but not none, has one window of all of them."""
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    every = window_hashes(h, k)
    # the window that starts at each word; those of short rows are put in below
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
    out = every[np.minimum(at, max(len(every) - 1, 0))] if len(every) else np.zeros(begin[-1], np.uint64)
    for r in np.flatnonzero((counts > 0) & (counts < k)).tolist():
        out[begin[r]] = window_hashes(h[first[r] : first[r + 1]], int(counts[r]))[0]
    return out, begin


def distinct_per_row(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes' upper 44 bits of the distinct hashes of each row, ascending; rows must be fewer than 2**20."""
    row = np.repeat(np.arange(len(begin) - 1, dtype=np.uint64), np.diff(begin))
    key = np.sort((row << np.uint64(44)) | (h >> np.uint64(20)))
    keep = np.ones(len(key), bool)
    keep[1:] = key[1:] != key[:-1]
    key = key[keep]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1)


def shingle_sets(column: pa.Array, k: int = 5):
    """Yield (first row, set sizes, distinct shingle hashes ascending within each row, where each row's begin) per slice of a column."""
    for i, buf, offsets, _ in slices(column):
        low = LOWER[buf]
        starts, ends, first = word_spans(low, offsets, NOT_SPACE)
        hashes, begin = row_windows(span_hashes(low, starts, ends), first, k)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            hashes[a:b].sort()
        keep = np.ones(len(hashes), bool)
        keep[1:] = hashes[1:] != hashes[:-1]
        keep[begin[:-1][begin[:-1] < len(hashes)]] = True
        begin = np.concatenate([[0], np.cumsum(keep)])[begin]
        yield i, np.diff(begin), hashes[keep], begin


def row_bytes(buf: np.ndarray, offsets: np.ndarray, r: int) -> bytes:
    return buf[offsets[r] : offsets[r + 1]].tobytes()
