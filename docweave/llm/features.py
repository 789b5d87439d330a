"""Language-neutral features of whole texts: shares of byte classes, word and line shapes, repetition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textbytes import LOWER, NOT_SPACE, distinct_per_row, row_windows, slices, span_hashes, word_spans


def _table(*ranges) -> np.ndarray:
    t = np.zeros(256, bool)
    for r in ranges:
        t[r] = True
    return t


_UPPER, _DIGIT = _table(slice(0x41, 0x5B)), _table(slice(0x30, 0x3A))
_LETTER = _table(slice(0x41, 0x5B), slice(0x61, 0x7B), slice(0x80, 256))
_STOPS = _table([ord(c) for c in ".,;:?'-\"()"])
_MARKS = _table([ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"])
_NAMES = ("upper", "digit", "letter", "stops", "marks", "white", "wide")
#: Two classes to a table, counted in the halves of one number, so that a running sum serves both.
_PAIRS = [a.astype(np.uint64) | b.astype(np.uint64) << np.uint64(32) for a, b in ((_UPPER, _DIGIT), (_LETTER, _STOPS), (_MARKS, ~NOT_SPACE), (_table(slice(0x80, 256)), _table()))]
_LOW = np.uint64((1 << 32) - 1)

#: The features, in order.
NAMES = (
    *(f"share_{n}" for n in _NAMES),
    "log_words",
    "word_bytes",
    "distinct_words",
    "distinct_3grams",
    "words_with_marks",
    "words_of_marks",
    "words_all_upper",
    "words_end_stop",
    "line_words",
    "line_repeats",
    "long_words",
    "repeated_next",
    *(f"log_{n}" for n in ("repeated_next", "words_with_marks", "words_of_marks", "words_all_upper")),
)


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def text_stats(column: pa.Array):
    """Yield (first row, float32 matrix of features, word hashes, first word of each row) per slice; a null text is empty."""
    for i, buf, offsets, _ in slices(column):
        n = len(offsets) - 1
        size = np.maximum(np.diff(offsets), 1)
        low = LOWER[buf]
        starts, ends, first = word_spans(buf, offsets, NOT_SPACE)
        h = span_hashes(low, starts, ends)
        count = np.diff(first)
        some = np.maximum(count, 1)
        row = np.repeat(np.arange(n), count)
        totals = []
        for t in _PAIRS:
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(t[buf], out=total[1:])
            totals.append(total)
        both = [t[offsets[1:]] - t[offsets[:-1]] for t in totals]
        cols = [x / size for b in both for x in (b & _LOW, b >> np.uint64(32))][: len(_NAMES)]
        cols += [np.log1p(count), _per_row(ends - starts, first) / some]
        cols.append(_distinct(h, first) / some)
        grams, begin = row_windows(h, first, 3)
        cols.append(_distinct(grams, begin) / np.maximum(np.diff(begin), 1))
        upper, letters, marks = ((t[ends] - t[starts]) & _LOW for t in totals[:3])
        cols += [_per_row(x, first) / some for x in (marks > 0, letters == 0, (upper > 1) & (upper == letters), _STOPS[buf[ends - 1]] if len(ends) else np.zeros(0))]
        # a line ends at a line feed or with its row
        ends_of = np.unique(np.concatenate([np.flatnonzero(buf == 10), offsets[1:]]))
        begins = np.concatenate([[0], ends_of[:-1]]) if len(ends_of) else ends_of
        begins = begins + (buf[np.minimum(begins, max(len(buf) - 1, 0))] == 10) * (begins > 0) if len(buf) else begins
        some_text = ends_of > begins
        line_hash = span_hashes(low, begins[some_text], ends_of[some_text])
        line_first = np.searchsorted(begins[some_text], offsets)
        n_lines = np.diff(line_first)
        cols.append(np.log1p(count / np.maximum(n_lines, 1)))
        cols.append(np.where(n_lines > 0, 1 - _distinct(line_hash, line_first) / np.maximum(n_lines, 1), 0))
        cols.append(_per_row(ends - starts > 24, first) / some)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        cols.append(_per_row(again, first) / some)
        # counts too, for a passage of another kind within a long text
        cols += [np.log1p(_per_row(x, first)) for x in (again, marks > 0, letters == 0, (upper > 1) & (upper == letters))]
        yield i, np.stack(cols, 1).astype(np.float32), h, first


def _distinct(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many distinct hashes each row has."""
    return np.bincount(distinct_per_row(h, begin)[0], minlength=len(begin) - 1)


def standardise(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Clipped standard scores, their squares and a constant."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z * z / 6, np.ones((len(z), 1))], 1)
