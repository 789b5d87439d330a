"""License scans: ordered signature rules over whole texts.

Hundreds of regexes, each gated by a keyword: a rule's regex runs only where its keyword
occurs, and the keywords are looked for with plain substring search. Detections carry
the rule's priority; one that lies within another of equal or higher priority (lower
number) is suppressed, and where two cover the same span the earlier rule wins.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_safe
from .license_rules import RULES
from .textbytes import ALNUM, LOWER, row_bytes, slices, span_hashes, word_spans

#: The base: places where a phrase's words stand consecutively, and the label each gives.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The score of a detection by the priority of its rule: full texts and identifiers first, bare names last.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.75, 4: 0.5}


_GAP = r"[\s*#/;\"'>-]"


class Rule:
    __slots__ = ("order", "priority", "label", "keyword", "pattern")

    def __init__(self, order: int, line: str):
        priority, self.label, keyword, pattern = (x.strip() for x in line.split("|", 3))
        self.order, self.priority, self.keyword = order, int(priority), keyword.encode()
        # a blank outside a class stands for any white space and comment marks between words, one with ? for none as well
        self.pattern = re.compile(re.sub(r"\[[^]]*\]| \??", lambda m: {" ": _GAP + "+", " ?": _GAP + "*"}.get(m[0], m[0]), pattern).encode())


@cache
def rules() -> tuple[tuple[tuple[bytes, ...], tuple[Rule, ...]], ...]:
    """The rules in order, grouped by keyword. All words of a keyword must occur, the longest is tried first."""
    by: dict[bytes, list[Rule]] = {}
    for n, line in enumerate(x for x in RULES.strip().splitlines() if x.strip() and not x.startswith("#")):
        by.setdefault((r := Rule(n, line)).keyword, []).append(r)
    return tuple((tuple(sorted(k.split(), key=len, reverse=True)), tuple(v)) for k, v in by.items())


@cache
def _by_longest() -> tuple[tuple[bytes, tuple], ...]:
    """The keyword groups by the longest word of the keyword, so each word is looked for once a text."""
    by: dict[bytes, list] = {}
    for words, group in rules():
        by.setdefault(words[0], []).append((words[1:], group))
    return tuple((k, tuple(v)) for k, v in by.items())


def detections(low: bytes) -> list[tuple[int, int, str, int]]:
    """(start, stop, label, priority) of the surviving detections in a lower-cased text, by place; offsets in bytes."""
    found = [(m.start(), m.end(), r) for first, group in _by_longest() if first in low for words, own in group if all(w in low for w in words) for r in own for m in r.pattern.finditer(low) if m.end() > m.start()]
    return suppress(found)


def suppress(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, str, int]]:
    """Interval containment: by start, longest first, earlier rule first; a detection within one of equal or higher priority goes.

    The stack holds the detections that can still contain a later one, so the scan is
    linear but for the few that overlap at a place.
    """
    out, alive = [], []
    for s, e, r in sorted(found, key=lambda x: (x[0], -x[1], x[2].priority, x[2].order)):
        alive = [a for a in alive if a[1] > s]
        if not any(a[1] >= e and a[2] <= r.priority for a in alive):
            # one of the same span that came first with a lower priority is beaten by this one
            beaten = [a for a in alive if a[0] == s and a[1] == e and a[2] > r.priority]
            for a in beaten:
                alive.remove(a)
                out.remove((a[0], a[1], a[3], a[2]))
            alive.append((s, e, r.priority, r.label))
            out.append((s, e, r.label, r.priority))
    return out


def _phrases() -> list[tuple[str, np.ndarray]]:
    out = []
    for phrase, label in BASE.items():
        buf = np.frombuffer(phrase.encode(), np.uint8)
        starts, ends, _ = word_spans(buf, np.array([0, len(buf)]), ALNUM)
        out.append((label, span_hashes(buf, starts, ends)))
    return out


def _scan(batches):
    phrases = _phrases()
    for b in batches:
        n = b.num_rows
        n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first_word, last_word = [None] * n, [None] * n
        base: list[set[str]] = [set() for _ in range(n)]
        labels, score, spans = [""] * n, np.zeros(n), [[]] * n
        for i, buf, offsets, _ in slices(b.column(1)):
            low = LOWER[buf]
            starts, ends, first = word_spans(low, offsets, ALNUM)
            h = span_hashes(low, starts, ends)
            n_words[i : i + len(first) - 1] = np.diff(first)
            for label, p in phrases:
                hit = np.ones(max(0, len(h) - len(p) + 1), bool)
                for j, x in enumerate(p):
                    hit &= h[j : j + len(hit)] == x
                at = np.flatnonzero(hit)
                row = np.searchsorted(first, at, "right") - 1
                for w, r in zip(at.tolist(), row.tolist()):
                    if w + len(p) <= first[r + 1]:
                        w, r = w - int(first[r]), i + r
                        n_base[r] += 1
                        base[r].add(label)
                        first_word[r] = w if first_word[r] is None else min(w, first_word[r])
                        last_word[r] = w if last_word[r] is None else max(w, last_word[r])
            for r in range(len(offsets) - 1):
                found = detections(row_bytes(low, offsets, r))
                spans[i + r] = [{"start": s, "stop": e, "label": x, "priority": p} for s, e, x, p in found]
                labels[i + r] = ",".join(sorted(base[i + r] | {x for _, _, x, _ in found}))
                score[i + r] = max([0.9 if base[i + r] else 0.0, *(CONFIDENCE[p] for *_, p in found)])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n_words), pa.array(n_base), pa.array(first_word, pa.int64()), pa.array(last_word, pa.int64()), pa.array([",".join(sorted(x)) for x in base]), pa.array(labels), pa.array(score), pa.array(spans, _SPANS)],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Only ASCII letters are folded. A null or empty text has no words, no labels (empty strings), score 0 and null places. spans are
    the surviving detections with byte offsets into the UTF-8 text; of two rules that cover the same span the one of
    higher priority, then the earlier, wins. Texts are read whole, however long. Rows are judged on their own, so
    repeated rows repeat their result; a null doc_id is carried through; an empty table gives an empty result; only
    doc_id and text are read.
    """
    source = docs.select(null_safe(docs, "doc_id", "long"), null_safe(docs, "text", "string"))
    return source.mapInArrow(
        _scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,stop:long,label:string,priority:int>>",
    )


def license_report(docs: DataFrame) -> DataFrame:
    """The digest of the registered query: ``scan_licenses`` without spans; edge cases as there."""
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))
