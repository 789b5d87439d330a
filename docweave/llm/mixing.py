"""Mixing to target weights with soft domain membership.

A classifier fitted on the labelled table gives every document a posterior over domains (clean, toxic,
low quality). Each document gets a rate, the expected number of times it is used; the expected tokens
of a domain are the sum over documents of tokens x rate x posterior. Projected gradient descent on the
weighted least squares distance of these totals from the targets starts from rate 1 and keeps rates
nonnegative. A step takes one pass over a narrow table on the executors and returns one number for
each domain; a document's rate follows from its own posterior and the steps' errors, so rates are
never gathered. Rates then become whole copies by a systematic draw.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, add_sketches, null_safe, numbered, only_rows, sketch_rows, unused
from .features import NAMES, standardise, text_stats
from .pu_quality import _adam
from .textbytes import distinct_per_row

DOMAINS = ("clean", "toxic", "low_quality")
#: Target shares of tokens.
TARGETS = {"clean": 0.98, "toxic": 0.01, "low_quality": 0.01}
#: Bound on the labelled rows that the classifier is fitted on, drawn by a hash of doc_id.
SAMPLE = 20_000
#: Hash slots in which words are told apart, and how many of them, the most telling, become features.
SLOTS, PIECES, CHOSEN = 1 << 18, 64, 192
#: Most steps of the descent, and the largest error of a domain, as a share of its tokens, at which it stops.
STEPS, ENOUGH = 40, 1e-4
#: Rates this close to a whole number are that number, in the fit as in its result: what is all but surely clean stays as it is.
NEAR = 0.02
#: Steps after which the rates are written down.
WRITTEN = 6


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _presence(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, slot) of a slice."""
    row, top = distinct_per_row(h & ~np.uint64((1 << 46) - 1), first)
    return row, (top >> np.uint64(26)).astype(np.int64)


def _slot_counts(batches):
    """How many documents of each domain hold each slot."""
    out = np.zeros((len(DOMAINS), SLOTS), np.int64)
    for b in batches:
        d = b.column(1).to_numpy()
        for i, _, h, first in text_stats(b.column(0)):
            row, slot = _presence(h, first)
            np.add.at(out, (d[i + row], slot), 1)
    parts = sketch_rows(out.ravel(), PIECES * len(DOMAINS))
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], ["piece", "counts"])


def _rows(column: pa.Array, chosen: np.ndarray):
    """(first row, features with the chosen words' presence, word counts) per slice."""
    place = np.full(SLOTS, -1)
    place[chosen] = np.arange(len(chosen))
    for i, x, h, first in text_stats(column):
        row, slot = _presence(h, first)
        words = np.zeros((len(x), len(chosen)), np.float32)
        ok = place[slot] >= 0
        words[row[ok], place[slot[ok]]] = 1
        yield i, x, words, np.diff(first)


def _sample_rows(chosen):
    def run(batches):
        for b in batches:
            d = b.column(1).to_numpy()
            for i, x, words, _ in _rows(b.column(0), chosen):
                yield pa.RecordBatch.from_arrays([pa.array(d[i : i + len(x)]), pa.array([r.tobytes() for r in x]), pa.array([np.packbits(r.astype(bool)).tobytes() for r in words])], ["d", "x", "w"])

    return run


class Classifier:
    """Softmax regression on standardised features and chosen words."""

    def __init__(self, chosen: np.ndarray, d: np.ndarray, x: np.ndarray, words: np.ndarray):
        self.chosen, self.mean, self.scale = chosen, x.mean(0), x.std(0) + 1e-4
        z, y = self._inputs(x, words), np.eye(len(DOMAINS))[d]
        seen = y.sum(0) > 0
        w = _adam(lambda w: z.T @ (self._soft(z @ w) - y) / len(z) + 1e-4 * w, np.zeros((z.shape[1], len(DOMAINS))), 250)
        w[-1, ~seen] = -40  # a domain without labelled rows holds nothing
        self.w = w.astype(np.float32)

    def _inputs(self, x, words):
        return np.concatenate([words * 2, standardise(x, self.mean, self.scale)], 1).astype(np.float32)

    @staticmethod
    def _soft(s):
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posterior(self, x, words):
        return self._soft((self._inputs(x, words) @ self.w).astype(np.float64))


def _posteriors(model):
    def run(batches):
        m = model.value
        for b in batches:
            n, p = [np.zeros(0, np.int64)], [np.zeros((0, len(DOMAINS)))]
            for _, x, words, count in _rows(b.column(1), m.chosen if m else np.zeros(0, np.int64)):
                n.append(count)
                p.append(m.posterior(x, words) if m else np.tile(np.eye(len(DOMAINS))[0], (len(x), 1)))
            p = np.round(np.concatenate(p), 6)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n)), b.column(2), b.column(3), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))], ["doc_id", "n_tokens", "row_hash", "row_no", *(f"p_{x}" for x in DOMAINS)])

    return run


def fit_classifier(docs: DataFrame, labels: DataFrame) -> Classifier | None:
    """From at most ``SAMPLE`` (and a fifth) labelled documents; a doc_id with several labels takes the worst of them."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    total = known.count()
    share = min(1.0, SAMPLE / max(1, total))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(int(1.2 * SAMPLE))
    domain = F.when(F.col("t") == 1, 1).when(F.col("q") == 0, 2).otherwise(0).cast("long")
    # at most 1.2 SAMPLE rows of 16 bytes
    rows = docs.join(F.broadcast(known.select("doc_id", domain.alias("d"))), "doc_id").select("text", "d")
    counts = add_sketches(rows.mapInArrow(_slot_counts, "piece int, counts binary"), SLOTS * len(DOMAINS), PIECES * len(DOMAINS)).reshape(len(DOMAINS), SLOTS)
    chosen: set[int] = set()
    for k in range(len(DOMAINS)):  # those that tell a domain from the rest, by chi-square over document counts
        inside, outside = counts[k], counts.sum(0) - counts[k]
        n_in, n_out = max(1, inside.max()), max(1, outside.max())
        expected = (inside + outside) * (n_in / (n_in + n_out))
        chi = (inside - expected) ** 2 / np.maximum(expected, 1)
        chosen.update(np.argsort(-chi, kind="stable")[: CHOSEN // len(DOMAINS)].tolist())
    chosen = np.array(sorted(chosen))
    sample = rows.mapInArrow(_sample_rows(chosen), "d long, x binary, w binary").limit(2 * SAMPLE).collect()
    if not sample:
        return None
    d = np.array([r.d for r in sample])
    x = np.frombuffer(b"".join(bytes(r.x) for r in sample), np.float32).reshape(len(d), len(NAMES)).astype(np.float64)
    w = np.unpackbits(np.frombuffer(b"".join(bytes(r.w) for r in sample), np.uint8).reshape(len(d), -1), axis=1)[:, : len(chosen)]
    return Classifier(chosen, d, x, w.astype(np.float32))


def _rate(errors: list[np.ndarray], most: float) -> Column:
    """A document's rate after further steps with these errors: less posterior times error, kept within 0 and ``most``."""
    sql = "rate"
    for e in errors:
        sql = f"least({float(most)!r}D, greatest(0D, {sql} - ({' + '.join(f'p_{x} * {float(v)!r}D' for x, v in zip(DOMAINS, e))})))"
    return F.expr(sql)


def _whole(rate: Column) -> Column:
    return F.when(F.abs(rate - F.round(rate)) <= NEAR, F.round(rate)).otherwise(rate)


def goals(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Tokens to keep of each domain, of the tokens at hand and the target weights.

    The whole is the largest at which domains that make up more than half of the targets have enough for theirs:
    the median of have/want, weighted by want. These meet their targets exactly; a scarcer domain keeps all it has and
    falls short, so it never takes the others down with it. The whole follows the tokens without a step; only
    domains of which there is nothing at all leave the targets.
    """
    want = np.where(have > 0, want, 0.0)
    if not want.sum() > 0:
        return np.zeros(len(have))
    ratio = np.where(want > 0, have / np.where(want > 0, want, 1.0), 0.0)
    order = np.argsort(-ratio, kind="stable")
    whole = ratio[order[np.searchsorted(np.cumsum(want[order]), (0.5 + 1e-9) * want.sum())]]
    return np.minimum(want * whole, have)


def _fit_rates(rows: DataFrame, targets: dict[str, float], most: float, scratch: Scratch) -> tuple[DataFrame, np.ndarray, int]:
    """``rows`` with their rates, the remaining error of each domain as a share of its tokens, and how many steps were taken."""

    def totals(rate):
        r = rows.agg(*[F.coalesce(F.sum(F.col("n_tokens") * rate * F.col(f"p_{x}")), F.lit(0.0)) for x in DOMAINS]).first()
        return np.array([float(v) for v in r])

    have = totals(F.lit(1.0))
    goal = goals(have, np.array([targets.get(x, 0.0) for x in DOMAINS]))
    errors: list[np.ndarray] = []
    before, off, n = np.full(len(DOMAINS), np.inf), np.zeros(len(DOMAINS)), 0
    for n in range(STEPS + 1):
        off = (totals(_whole(_rate(errors, most))) - goal) / np.maximum(have, 1.0)
        if n == STEPS or np.abs(off).max() < ENOUGH or np.abs(off - before).max() < ENOUGH / 10:
            break  # on target, or as near as the bound on the rates allows
        before = off
        errors.append(off)
        if len(errors) == WRITTEN:  # keeps the expression short
            rows, errors = scratch.keep(rows.withColumn("rate", _rate(errors, most))), []
    return rows.withColumn("rate", F.round(_whole(_rate(errors, most)), 6)), off, n


#: Rows that a range of the systematic draw should hold at most.
RANGE_ROWS = 200_000


def _copies(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with copies: the whole part of each rate, and of the fractions a systematic draw.

    Rows with a fraction are put in order of their likeliest domain, tokens and a hash, and every row where the running sum of
    fractions passes a whole number (shifted by a half) gets one more copy: so copies of any stretch of that order, and
    with it tokens of any domain, are within one row of what the rates say. The order is cut into ranges; only their sums, one
    number each, meet on the driver. What ties in all of these is told apart by the rows' numbers, so no range is filled by it.
    """
    whole = F.floor(F.col("rate")).cast("long")
    part = rows.where(F.col("rate") > whole)
    if not part.take(1):
        return rows.withColumn("copies", whole)
    n = part.count()
    top = F.greatest(*[F.col(f"p_{x}") for x in DOMAINS])
    domain = F.lit(len(DOMAINS))
    for k, x in reversed(list(enumerate(DOMAINS))):
        domain = F.when(F.col(f"p_{x}") == top, k).otherwise(domain)
    order = [domain.alias("dom"), "n_tokens", "row_hash", F.xxhash64("row_no").alias("mixed")]
    ranges = max(1, -(-n // RANGE_ROWS))
    keys = part.select("row_no", *order, (F.round((F.col("rate") - whole) * 1_000_000)).cast("long").alias("millionths"))
    placed = scratch.keep(keys.repartitionByRange(ranges, "dom", "n_tokens", "row_hash", "mixed").withColumn("range", F.spark_partition_id()))
    before, sums = {}, 0
    for r in sorted(placed.groupBy("range").agg(F.sum("millionths").alias("s")).collect(), key=lambda r: r["range"]):
        before[r["range"]], sums = sums, sums + r.s
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "range int, before long")
    upto = F.sum("millionths").over(W.partitionBy("range").orderBy("dom", "n_tokens", "row_hash", "mixed", "row_no").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("before") + 500_000
    more = placed.join(F.broadcast(offsets), "range").withColumn("upto", upto).where(F.expr("upto div 1000000 > (upto - millionths) div 1000000")).select("row_no", F.lit(1).cast("long").alias("more"))
    return rows.join(scratch.keep(more), "row_no", "left").withColumn("copies", whole + F.coalesce("more", F.lit(0))).drop("more")


class Mixture:
    """The rates of a corpus: ``rows`` (row_no, doc_id, n_tokens, row_hash, p_<domain>, rate, copies), and how near they came.

    ``residual`` has, for each domain, expected tokens less those to be kept, as a share of the tokens there were:
    within ``ENOUGH`` where the descent met its targets. ``steps`` is how many steps it took.
    """

    def __init__(self, rows: DataFrame, residual: dict[str, float], steps: int):
        self.rows, self.residual, self.steps = rows, residual, steps


def _mixture(numbered_docs: DataFrame, row_no: str, labels: DataFrame, targets: dict[str, float] | None, most: float, scratch: Scratch) -> Mixture:
    source = numbered_docs.select(null_safe(numbered_docs, "doc_id", "long"), null_safe(numbered_docs, "text", "string"), F.col(row_no).alias("row_no"))
    model = source.sparkSession.sparkContext.broadcast(fit_classifier(source.select("doc_id", "text"), labels))
    schema = "doc_id long, n_tokens long, row_hash long, row_no long, " + ", ".join(f"p_{x} double" for x in DOMAINS)
    rows = source.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_hash"), "row_no").mapInArrow(_posteriors(model), schema)
    rows = scratch.keep(rows.withColumn("rate", F.lit(1.0)))
    rows, off, steps = _fit_rates(rows, TARGETS if targets is None else targets, most, scratch)
    return Mixture(_copies(scratch.keep(rows), scratch), dict(zip(DOMAINS, off.tolist())), steps)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float = 1.0) -> Mixture:
    """Rates and copies of every row of ``docs``, and the residual of the fit.

    ``targets`` are shares of the expected tokens by domain, by default ``TARGETS``, which ask for as much clean text as a
    filtered web corpus has, so that clean documents stay once; ``goals`` sets the size of the whole so that no document needs
    to be repeated, and a scarce domain stays below its target. ``most`` bounds the rates. A text that is null or
    empty has no tokens and takes the rate of its posterior; without labels every document is clean. copies are whole: see
    ``_copies``; repeated rows share their rate, and their copies add up to its multiple. Rows are told apart by numbers of
    their own, so null and repeated ids don't matter; texts are read whole; an empty table gives an empty result. Only
    doc_id and text are read.
    """
    scratch = Scratch(docs.sparkSession)
    # the ids of the rows of a table or of a written frame come out alike whenever they are read
    name = unused("row_no", docs)
    return _mixture(docs.withColumn(name, F.monotonically_increasing_id()), name, labels, targets, most, scratch)


def document_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float = 1.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, p_<domain>, rate, copies; see ``mix``."""
    return mix(docs, labels, targets, most).rows.select("doc_id", "n_tokens", *[f"p_{x}" for x in DOMAINS], "rate", "copies")


def mixing_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of the registered query: ``document_rates`` and, the same in every row, the residual of the clean domain's
    fit and of the worst one (shares of a domain's tokens); edge cases as in ``mix``."""
    m = mix(docs, labels)
    worst = max(map(abs, m.residual.values()))
    return m.rows.select("doc_id", "n_tokens", *[f"p_{x}" for x in DOMAINS], "rate", "copies", F.lit(round(worst, 6)).alias("residual"))


def apply_mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say; all their columns, of any names, as they are. Edge cases as in ``mix``."""
    scratch = Scratch(docs.sparkSession)
    rows, row_no = numbered(scratch, docs)
    # rates of at most 1 make no second copies, so a row stays or goes
    gone = _mixture(rows, row_no, labels, targets, 1.0, scratch).rows.where("copies < 1").select("row_no")
    return only_rows(rows, row_no, gone, keep=False).select(*[F.col(f"`{c}`") for c in docs.columns])
