"""Benchmark decontamination by winnowing.

Of each document and each benchmark item the minimum hash of every sliding window of
k-grams is kept; documents and items that share such a fingerprint are compared around
it, and the hit is extended word by word in both directions. With k-grams of ``k`` words
and windows of ``window - k + 1`` of them, every shared span of ``window`` words shares a
fingerprint at the same place, so nothing is missed; extension removes chance hits. Items
shorter than a window are looked up whole, by their own length.

Benchmark fingerprints travel to the tasks in blocks of at most ``BLOCK_WORDS`` words (one
block for any usual benchmark); the documents stream past each block in the same scan.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import ALNUM, LOWER, slices, span_hashes, window_hashes, word_spans

#: Words of benchmark items that travel to the tasks at once (8 bytes each, and as much again for fingerprints).
BLOCK_WORDS = 2_000_000

_ADDED = [("n_words", "long"), ("n_hit", "long"), ("items", "array<string>"), ("spans", "array<struct<start:long,stop:long>>")]
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def _word_hashes(column):
    for i, buf, offsets, _ in slices(column):
        low = LOWER[buf]
        starts, ends, first = word_spans(low, offsets, ALNUM)
        yield i, span_hashes(low, starts, ends), first


def _window_minima(grams: np.ndarray, w: int) -> np.ndarray:
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = grams[:n].copy()
    for j in range(1, w):
        np.minimum(out, grams[j : j + n], out=out)
    return out


class Fingerprints:
    """The fingerprints of a block of items, ready for lookup."""

    def __init__(self, ids: list, texts: list, window: int, k: int):
        self.window, self.k, self.ids = window, k, [str(i) for i in ids]
        self.words: list[np.ndarray] = []
        for _, h, first in _word_hashes(pa.array(texts, pa.large_string())):
            self.words += [h[a:b] for a, b in zip(first[:-1], first[1:])]
        places: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        for n, h in enumerate(self.words):
            if len(h) >= window:
                grams = window_hashes(h, k)
                # places with equal words all around, as far as a window with them reaches, find the same hits: one is enough
                q = np.flatnonzero(np.isin(grams, _window_minima(grams, window - k + 1)))
                reach = window - k
                wide = np.concatenate([np.zeros(reach, np.uint64), h, np.zeros(reach, np.uint64)])
                around = window_hashes(wide, 2 * reach + k)
                for i in np.sort(np.unique(around[q], return_index=True)[1]).tolist():
                    places.setdefault(int(grams[q[i]]), []).append((n, int(q[i])))
            elif len(h):
                self.short.setdefault(len(h), {}).setdefault(int(window_hashes(h, len(h))[0]), []).append(n)
        self.places = places
        self.sorted = np.array(sorted(places), np.uint64)
        self.short_sorted = {m: np.array(sorted(x), np.uint64) for m, x in self.short.items()}

    @staticmethod
    def _known(values: np.ndarray, among: np.ndarray) -> np.ndarray:
        if not len(among) or not len(values):
            return np.zeros(len(values), bool)
        return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values

    def hits(self, h: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Per row with hits: (item, start, stop) in words of the row."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        w = self.window - self.k + 1
        grams = window_hashes(h, self.k)
        least = _window_minima(grams, w)
        at = np.flatnonzero(self._known(least, self.sorted))
        if len(at):
            row = np.searchsorted(first, at, "right") - 1
            inside = at + self.window <= first[row + 1]
            seen: dict[tuple[int, int, int], int] = {}
            spent: dict[tuple[int, int], tuple[int, int]] = {}
            reach = self.window - self.k
            at = at[inside]
            # where the fingerprints stand; neighbouring windows mostly share theirs
            p_all = np.unique(np.concatenate([at[grams[at + j] == least[at]] + j for j in range(w)]))
            row = np.searchsorted(first, p_all, "right") - 1
            for p, r in zip(p_all.tolist(), row.tolist()):
                a, b = int(first[r]), int(first[r + 1])
                for n, q in self.places[int(grams[p])]:
                    if seen.get((r, n, p - q), -1) > p:
                        continue
                    # every window with this gram lies in a span of the item that is known already
                    s, e = spent.get((r, n), (0, 0))
                    if s <= max(a, p - reach) and min(b, p + self.window) <= e:
                        continue
                    s, e = self._extend(h, a, b, p, self.words[n], q)
                    seen[r, n, p - q] = e
                    if e - s >= self.window:
                        out.setdefault(r, []).append((n, s - a, e - a))
                        spent[r, n] = (s, e)
        for m, table in self.short.items():
            found = window_hashes(h, m)
            at = np.flatnonzero(self._known(found, self.short_sorted[m]))
            row = np.searchsorted(first, at, "right") - 1
            for i, r in zip(at.tolist(), row.tolist()):
                if i + m <= first[r + 1]:
                    for n in table[int(found[i])]:
                        if np.array_equal(h[i : i + m], self.words[n]):
                            out.setdefault(r, []).append((n, i - int(first[r]), i - int(first[r]) + m))
        return out

    @staticmethod
    def _extend(h, a, b, p, item, q):
        """The longest span of equal words around document word p and item word q."""
        back, on = min(p - a, q), min(b - p, len(item) - q)
        differ = np.flatnonzero(h[p - back : p][::-1] != item[q - back : q][::-1])
        s = p - (int(differ[0]) if len(differ) else back)
        differ = np.flatnonzero(h[p : p + on] != item[q : q + on])
        return s, p + (int(differ[0]) if len(differ) else on)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _scan(block, text_at: int, before: int | None, names: list[str]):
    """Add the hits of one block; ``before`` is where the columns of an earlier block begin."""

    def run(batches):
        prints = block.value
        for b in batches:
            n_words, items, spans = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            if before is not None:
                items = b.column(before + 2).to_pylist()
                spans = [[(x["start"], x["stop"]) for x in s] for s in b.column(before + 3).to_pylist()]
            for i, h, first in _word_hashes(b.column(text_at)):
                n_words[i : i + len(first) - 1] = np.diff(first)
                for r, found in prints.hits(h, first).items():
                    items[i + r] = sorted({*items[i + r], *(prints.ids[n] for n, *_ in found)})
                    spans[i + r] = _merge(spans[i + r] + [(s, e) for _, s, e in found])
            hit = [sum(e - s for s, e in x) for x in spans]
            flat = pa.array([{"start": s, "stop": e} for x in spans for s, e in x], _SPAN)
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in spans])]), pa.int32())
            columns = [b.column(i) for i in range(before if before is not None else b.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.ListArray.from_arrays(at, flat)], names)

    return run


def _blocks(items: DataFrame, window: int, k: int):
    ids, texts, words = [], [], 0
    for r in items.toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        words += len(r.text) // 2 + 1
        if words >= BLOCK_WORDS:
            yield Fingerprints(ids, texts, window, k)
            ids, texts, words = [], [], 0
    yield Fingerprints(ids, texts, window, k)


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted item_ids as text) and spans (word ranges, merged) added.

    A word is hit if it lies in an occurrence of ``window`` consecutive words of an item
    (of all its words, if it has fewer). Null and wordless texts have no words and no hits;
    items without words match nothing; an item_id that is repeated counts once; a null
    item_id is read as the text 'None'. ``prefix`` keeps the added names apart from columns that docs has.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = [prefix + n for n, _ in _ADDED]
    if taken := set(names) & set(docs.columns):
        raise ValueError(f"docs already has {sorted(taken)}: give a prefix")
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(", ".join(f"`{prefix}{n}` {t}" for n, t in _ADDED)).fields])
    out, before = docs, None
    for prints in _blocks(items, window, k):
        block = docs.sparkSession.sparkContext.broadcast(prints)
        out = out.mapInArrow(_scan(block, docs.columns.index("text"), before, schema.names), schema)
        before = len(docs.columns)
    return out


def decontamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; edge cases as in ``mark_contaminated``."""
    marked = mark_contaminated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, window, k)
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs`` without a hit; all their columns, of any names, as they are. Each row is decided by its own text, so
    repeated rows and null ids don't matter; edge cases as in ``mark_contaminated``."""
    prefix = "mark_"
    while any((prefix + n).lower() in {c.lower() for c in docs.columns} for n, _ in _ADDED):
        prefix += "_"
    return mark_contaminated(docs, benchmark, window, k, prefix).where(F.col(f"{prefix}n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def report_by_brute_force(docs: list[tuple], items: list[tuple], window: int = 10) -> list[tuple]:
    """The same report by comparing every window of every item with every place; for tests."""
    import re

    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(window, len(v))
            for q in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[q : q + n]:
                        hit.update(range(p, p + n))
                        named.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out
