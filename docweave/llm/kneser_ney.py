"""Language identification by interpolated Kneser-Ney character models.

Words are read between boundary marks; each language has a model of character n-grams
up to ``ORDER`` over such words. Counts come from all training texts, summed on the
executors by n-gram hash; discounts, totals, continuation counts and probabilities are aggregates and joins over
all of them. A language's model is a sorted array of hashes of n-grams, and for each what its log
probability adds to that of its back-off, and the log back-off weight it has as a context. The log probability of a
place is the sum of these over its n-grams and contexts, so a model can be cut anywhere: one that is too large
for a task is read in blocks, and texts stream past each. The language with the lowest cross-entropy per character wins.

Rejection: a text whose best cross-entropy is higher than all but ``REJECT`` of the
training texts of that language is marked as in none of the languages.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, null_safe
from .textbytes import mix

#: Longest n-gram, in characters.
ORDER = 4
#: Rows in a block of the models, one for each n-gram or context and language; larger models take more blocks, none is left out.
BLOCK = 4_000_000
#: Share of training texts whose best cross-entropy counts as too high.
REJECT = 0.002
#: Words whose scores a task keeps from one text to the next; beyond that it starts anew.
KEPT_WORDS = 200_000


def _numbers() -> str:
    """Characters that count as alphanumeric for regexes but are numbers and no letters, as a character class's body."""
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.category(chr(c)) in ("No", "Nl"):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(re.escape(chr(a)) + (f"-{re.escape(chr(b))}" if b > a else "") for a, b in runs)


#: Runs of letters (category L).
_WORD = re.compile(rf"[^\W\d_{_numbers()}]+")
_SALT = [np.uint64((0x9E3779B97F4A7C15 * (n + 1)) & (2**64 - 1)) for n in range(ORDER + 1)]
_C1 = np.uint64(0xD6E8FEB86659FD93)
#: Probability of a character that was never seen.
UNKNOWN = 1e-6
MARK = 1  # code point of the word boundary


def grams_of(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """As ``_all_grams`` without the opening marks, which are context only: hashes for n = 1..ORDER, and each place's word."""
    grams, word, place, _ = _all_grams(words)
    return [g[place > 0] for g in grams], word[place > 0]


def _all_grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """For n = 1..ORDER the hash of the n characters that end at each place of ``^word$`` (0 where a word has too few
    before it), over all words in a row; each place's word, its number in the word, and whether the word ends there."""
    text = "".join("\x01" + w + "\x01" for w in words)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(code)) - np.repeat(np.cumsum(lens) - lens, lens)
    out, h = [], np.zeros(len(code), np.uint64)
    for n in range(1, ORDER + 1):
        shifted = np.zeros(len(code), np.uint64)
        shifted[n - 1 :] = code[: len(code) - n + 1]
        h = h * _C1 + mix(shifted + _SALT[n])
        g = mix(h + _SALT[n]) | np.uint64(1)
        g[place < n - 1] = 0
        out.append(g)
    return out, word, place, place == lens[word] - 1


def _context(words: list[str]) -> list[np.ndarray]:
    """For n = 1..ORDER the hash, as in ``grams_of``, of the n - 1 characters before each place: of one that ends a place earlier."""
    text = "".join("\x01" + w + "\x01" for w in words)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.array([len(w) + 2 for w in words])
    place = np.arange(len(code)) - np.repeat(np.cumsum(lens) - lens, lens)
    out, h = [np.zeros(int((place > 0).sum()), np.uint64)], np.zeros(len(code), np.uint64)
    for n in range(2, ORDER + 1):
        shifted = np.zeros(len(code), np.uint64)
        shifted[n - 1 :] = code[: len(code) - n + 1]
        h = h * _C1 + mix(shifted + _SALT[n - 1])
        g = mix(h + _SALT[n - 1]) | np.uint64(1)
        g[place < n - 1] = 0
        out.append(g[place > 0])
    return out


def _count(batches):
    """Per language the n-grams of all its texts: (lang, n, gram, context, suffix, count), summed per task."""
    sums: dict[str, Counter] = {}
    for b in batches:
        texts, langs = b.column(0), b.column(1).to_pylist()
        for lo in range(0, b.num_rows, 256):
            for t, lang in zip(texts.slice(lo, 256).to_pylist(), langs[lo : lo + 256]):
                sums.setdefault(lang, Counter()).update(_WORD.findall((t or "").lower()))
            if sum(len(x) for x in sums.values()) > 300_000:
                yield from _emit(sums)
                sums = {}
    yield from _emit(sums)


def _emit(sums):
    for lang, own in sums.items():
        if not own:
            continue
        words, counts = list(own), np.array(list(own.values()), np.int64)
        grams, word = grams_of(words)
        contexts = _context(words)
        for n in range(1, ORDER + 1):
            g = grams[n - 1]
            ok = g != 0
            if not ok.any():  # all words are shorter
                continue
            g, c, w = g[ok], contexts[n - 1][ok], counts[word[ok]]
            s = grams[n - 2][ok] if n > 1 else np.zeros(len(g), np.uint64)
            u, first, inv = np.unique(g, return_index=True, return_inverse=True)
            total = np.bincount(inv, w, len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(u), pa.string()), pa.array(np.full(len(u), n, np.int32)), pa.array(u.view(np.int64)), pa.array(c[first].view(np.int64)), pa.array(s[first].view(np.int64)), pa.array(total)],
                ["lang", "n", "gram", "context", "suffix", "count"],
            )


def _fit(counts: DataFrame, scratch: Scratch) -> tuple[list[str], np.ndarray, DataFrame]:
    """The languages in order, the log probability of a place before any n-gram is known, and what n-grams and
    contexts add to it: (key, lang, gain, weight), from all rows (lang, n, gram, context, suffix, count)."""
    longer = counts.where("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("suffix").alias("gram")).agg(F.count("*").alias("more"))
    # lower orders count the different characters an n-gram continues, where longer n-grams show them
    rows = scratch.keep(counts.join(longer, ["lang", "n", "gram"], "left").select("lang", "n", "gram", "context", "suffix", F.coalesce("more", "count").alias("c")))
    ones = {r.n: (r.n1, r.n2) for r in rows.groupBy("n").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect()}
    d = F.lit(0.5)
    for n, (n1, n2) in ones.items():
        if n1 and n2:
            d = F.when(F.col("n") == n, F.lit(n1 / (n1 + 2 * n2))).otherwise(d)
    totals = rows.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), (d * F.count("*") / F.sum("c")).alias("weight"))
    totals = scratch.keep(totals)
    first = {r.lang: r.weight for r in totals.where("n = 1").collect()}
    langs = sorted(first)
    terms = scratch.keep(rows.join(totals, ["lang", "n", "context"]).select("lang", "n", "gram", "suffix", (F.greatest(F.col("c") - d, F.lit(0.0)) / F.col("total")).alias("term"), "weight"))
    parts, below = [], None
    for n in range(1, ORDER + 1):
        own = terms.where(F.col("n") == n)
        # an n-gram's suffix has been counted wherever the n-gram has
        own = own.withColumn("below", F.lit(UNKNOWN)) if below is None else own.join(below, ["lang", "suffix"])
        own = scratch.keep(own.select("lang", "gram", (F.col("term") + F.col("weight") * F.col("below")).alias("prob"), (F.col("weight") * F.col("below")).alias("back")))
        parts.append(own.select(F.col("gram").alias("key"), "lang", F.log(F.col("prob") / F.col("back")).alias("gain"), F.lit(0.0).alias("weight")))
        below = own.select("lang", F.col("gram").alias("suffix"), F.col("prob").alias("below"))
    parts.append(totals.where("n > 1").select(F.col("context").alias("key"), "lang", F.lit(0.0).alias("gain"), F.log("weight").alias("weight")))
    table = parts[0]
    for x in parts[1:]:
        table = table.unionByName(x)
    table = table.groupBy("lang", "key").agg(F.sum("gain").cast("float").alias("gain"), F.sum("weight").cast("float").alias("weight"))
    return langs, np.array([np.log(UNKNOWN * first[x]) for x in langs]), scratch.keep(table)


class Model:
    """For each language a sorted array of hashes of n-grams and contexts, and what each adds to log probabilities as the one and as the other."""

    def __init__(self, langs: list[str], base: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.langs, self.base, self.tables = langs, base, tables
        self._kept: dict[str, int] = {}
        self._scores, self._places = np.zeros((0, len(langs))), np.zeros(0, np.int64)

    def __getstate__(self):
        return self.langs, self.base, self.tables

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def blocks(cls, counts: DataFrame, scratch: Scratch):
        """Models that add up to the whole, each of about ``BLOCK`` rows; only the first holds the base."""
        langs, base, table = _fit(counts, scratch)
        n = max(1, -(-table.count() // BLOCK))
        for i in range(n):
            part = table.where(F.pmod(F.shiftright("key", 1), F.lit(n)) == i).toArrow()
            lang = part["lang"].combine_chunks().dictionary_encode()
            codes, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
            keys, gain, weight = part["key"].to_numpy().view(np.uint64), part["gain"].to_numpy(), part["weight"].to_numpy()
            tables = []
            for x in langs:
                own = np.flatnonzero(codes == names.index(x)) if x in names else np.zeros(0, np.int64)
                own = own[np.argsort(keys[own])]
                tables.append((keys[own], gain[own], weight[own]))
            yield cls(langs, base if i == 0 else np.zeros(len(langs)), tables)

    @classmethod
    def fit(cls, counts: DataFrame) -> Model:
        """The whole from rows (lang, n, gram, context, suffix, count), for models of one block."""
        (model,) = cls.blocks(counts, Scratch(counts.sparkSession))
        return model

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What the model adds to the log probability of each word by each language, and the word's places."""
        grams, word, place, ends = _all_grams(words)
        out = [np.where(place > 0, x, 0.0) for x in self.base]
        for g in grams:
            distinct, at = np.unique(g, return_inverse=True)
            inner, context = at[place > 0], at[~ends]
            for total, (keys, gain, weight) in zip(out, self.tables):
                if not len(keys):
                    continue
                j = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                hit = (keys[j] == distinct) & (distinct != 0)
                total[place > 0] += np.where(hit, gain[j], 0)[inner]
                # as the context of the next place; the longest is of ORDER - 1 characters, longer n-grams have no weight
                total[~ends] += np.where(hit, weight[j], 0)[context]
        scores = np.stack([np.bincount(word, x, len(words)) for x in out], 1) if out else np.zeros((len(words), 0))
        return scores, np.bincount(word[place > 0], minlength=len(words))

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """What the model adds to the log probability of each text by each language, and the text's places.

        Words that were met before in this task are looked up, not computed again.
        """
        per = [Counter(_WORD.findall(t.lower())) if t else Counter() for t in texts]
        if len(self._kept) > KEPT_WORDS:
            self._kept, self._scores, self._places = {}, self._scores[:0], self._places[:0]
        fresh = [w for w in set().union(*per) if w not in self._kept]
        if fresh:
            self._kept.update(zip(fresh, range(len(self._kept), len(self._kept) + len(fresh))))
            scores, places = self.word_scores(fresh)
            self._scores, self._places = np.concatenate([self._scores, scores]), np.concatenate([self._places, places])
        sizes = np.array([len(own) for own in per], np.int64)
        n = int(sizes.sum())
        nums = np.fromiter(chain.from_iterable(map(self._kept.__getitem__, own) for own in per), np.int64, n)
        counts = np.fromiter(chain.from_iterable(own.values() for own in per), np.int64, n)
        row = np.repeat(np.arange(len(texts)), sizes)
        total = np.stack([np.bincount(row, self._scores[nums, k] * counts, len(texts)) for k in range(len(self.langs))], 1) if self.langs else np.zeros((len(texts), 0))
        return total, np.bincount(row, self._places[nums] * counts, len(texts))


def _few(column: pa.Array, limit: int = 4 << 20):
    """Lists of texts of about ``limit`` bytes."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit)))
        yield i, column.slice(i, j - i).to_pylist()
        i = j


def _add(model):
    """Per row of (doc_id, text, lang, sums): sums with what this block adds."""

    def run(batches):
        m = model.value
        for b in batches:
            sums = [(m.totals(texts)[0] + _sums(b, i, len(texts), m)).tolist() for i, texts in _few(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x for part in sums for x in part], pa.list_(pa.float64()))], ["doc_id", "text", "lang", "sums"])

    return run


def _sums(b: pa.RecordBatch, i: int, n: int, m: Model):
    """What earlier blocks have added for n rows from i."""
    return np.array(b.column(3).slice(i, n).to_pylist()).reshape(n, len(m.langs)) if b.num_columns > 3 else 0.0


def _score(model):
    """Per row of (doc_id, text, lang), and sums of earlier blocks: the prediction, its score, the best cross-entropy, and that of ``lang``."""

    def run(batches):
        m = model.value
        at = {x: i for i, x in enumerate(m.langs)}
        for b in batches:
            langs, pred, score, best, own = b.column(2).to_pylist(), [], [], [], []
            for i, texts in _few(b.column(1)):
                total, places = m.totals(texts)
                h = -(total + _sums(b, i, len(texts), m)) / np.maximum(places, 1)[:, None]
                if not m.langs:
                    h = np.zeros((len(texts), 1))
                p = np.exp(-(h - h.min(1, keepdims=True)) * places[:, None])
                p /= p.sum(1, keepdims=True)
                k = h.argmin(1)
                for r, t in enumerate(texts):
                    known = bool(m.langs) and bool(t) and places[r] > 0
                    pred.append(m.langs[k[r]] if known else "und")
                    score.append(float(p[r, k[r]]) if known else 0.0)
                    best.append(float(h[r, k[r]]) if known else None)
                    own.append(float(h[r, at[langs[i + r]]]) if known and langs[i + r] in at else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(best, pa.float64()), b.column(2), pa.array(own, pa.float64())], ["doc_id", "lang_pred", "score", "cross_entropy", "lang", "own"]
            )

    return run


def identify_languages(docs: DataFrame, learn: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, cross_entropy, rejected.

    Rows that meet ``learn`` teach, if they have text and lang. lang_pred is ``und`` for a null text, one without a
    letter (Unicode category L), or where nothing was learned; score is the winner's posterior (0 to 1) under equal
    priors. cross_entropy is per place, null for ``und``. rejected: it is higher than all but ``REJECT`` of the teaching
    rows of that language have by their own model, or there is none. Ties go to the first language in order. Rows
    are judged on their own, so repeated rows repeat their result, though as teachers each counts; a null doc_id or
    lang is carried through; texts are read whole, however long; an empty table gives an empty result. Only doc_id,
    text and lang are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    lang = null_safe(docs, "lang", "string")
    source = docs.select(null_safe(docs, "doc_id", "long"), null_safe(docs, "text", "string"), F.when(learn, lang).alias("lang"))
    known = source.select("text", "lang").where("text is not null and lang is not null")
    counts = known.mapInArrow(_count, "lang string, n int, gram long, context long, suffix long, count long")
    counts = counts.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"), F.first("context").alias("context"), F.first("suffix").alias("suffix"))
    counts = scratch.keep(counts)
    model = None
    for more in Model.blocks(counts, scratch):
        if model is not None:  # all blocks but the last
            after = scratch.keep(source.mapInArrow(_add(model), "doc_id long, text string, lang string, sums array<double>"))
            if "sums" in source.columns:
                scratch.drop(source)
            model.unpersist()
            source = after
        model = spark.sparkContext.broadcast(more)
    scored = scratch.keep(source.mapInArrow(_score(model), "doc_id long, lang_pred string, score double, cross_entropy double, lang string, own double"))
    if "sums" in source.columns:
        scratch.drop(source)
    limits = scored.where("own is not null").groupBy(F.col("lang").alias("of")).agg(F.percentile_approx("own", 1 - REJECT, 10_000).alias("limit")).collect()
    limit = F.lit(None).cast("double")
    for r in limits:
        limit = F.when(F.col("lang_pred") == r.of, F.lit(float(r.limit))).otherwise(limit)
    return scored.select("doc_id", "lang_pred", "score", "cross_entropy", F.coalesce(F.col("cross_entropy") > limit, F.lit(True)).alias("rejected"))


def language_report(docs: DataFrame) -> DataFrame:
    """The folds of the registered query: rows whose crc32(doc_id) mod 4 is 2 teach nothing. Edge cases as in ``identify_languages``."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    out = identify_languages(docs, fold != 2)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"), F.round("cross_entropy", 6).alias("cross_entropy"), "rejected")
