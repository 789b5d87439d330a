"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a structured random product code: the space is rotated at random and cut into
blocks, each with its own codebook of unit vectors; a filter takes one code word from every
block. A vector passes the filters whose direction it exceeds a threshold with, found by list-decoding
the code (block by block, branches cut by what the remaining blocks can add), not by
trying them all. Vectors of one label that share a filter are compared
in the first filter they share. There are the more filters the more vectors there are, so what passes one doesn't grow.

Vectors travel to their filters in single precision; pairs that this leaves within rounding of the threshold are compared once
more, in double precision. A hot filter is cut into tiles of about ``TILE`` vectors and pairs of tiles become groups of their
own, so no task holds a whole group. A vector's links are counted where they are found; pairs travel only as
far as they join components: one link for each vector and group.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

#: Directions that a vector passes at least, of the fewest filters and for each doubling of them: its threshold is lowered until it
#: has so many. A random vector passes two more on average. So many that of pairs right at 0.93 more than 99.8 % share one.
LEAST, LEAST_MORE = 14, 2
#: Vectors that pass a filter, all labels together, once there are more than the fewest filters.
CROWD = 256
#: Fewest code words of a block, and most: beyond that a block is added.
FEWEST, MOST = 16, 64
#: Vectors of a filter that are compared in one group with as many others.
TILE = 2048
SEED = 20_240_601


def code_size(n: int) -> tuple[int, int]:
    """Blocks and words of the code for n vectors."""
    filters, blocks = max(FEWEST**3, n * (LEAST + 2) / CROWD), 3
    while filters ** (1 / blocks) > MOST:
        blocks += 1
    return blocks, max(FEWEST, round(filters ** (1 / blocks)))


class ProductCode:
    def __init__(self, dim: int, blocks: int = 3, words: int = FEWEST, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dim, self.n_words = dim, words
        self.least = min(words**blocks, LEAST + round(LEAST_MORE * max(0.0, np.log2(float(words) ** blocks / FEWEST**3))))
        self.threshold = NormalDist().inv_cdf(1 - min(0.5, (self.least + 2) / float(words) ** blocks))
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        cuts = np.linspace(0, dim, blocks + 1).astype(int)
        self.parts = []
        for a, b in zip(cuts, cuts[1:]):
            w = rng.normal(size=(words, max(1, b - a)))
            w = w / np.linalg.norm(w, axis=1, keepdims=True) * np.sqrt(max(1, b - a))
            self.parts.append((a, b, w[:, : b - a].T))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filters (numbers below 2**31, ascending) that each unit vector passes, one after the other, and how many each has."""
        x = unit @ self.rotation
        scores = [x[:, a:b] @ w for a, b, w in self.parts]
        rest = np.cumsum([np.zeros(len(x)), *[s.max(1) for s in scores[::-1]]], 0)[::-1]
        rows, codes, todo, goal = [], [], np.arange(len(x)), self.threshold
        while len(todo):
            row, code, total = todo, np.zeros(len(todo), np.int64), np.zeros(len(todo))
            for n, s in enumerate(scores):  # branches that the remaining blocks can't lift over the goal end here
                sums = total[:, None] + s[row]
                i, j = np.nonzero(sums + rest[n + 1][row][:, None] >= goal)
                row, code, total = row[i], code[i] * self.n_words + j, sums[i, j]
            few = np.bincount(row, minlength=len(x))[todo] < self.least
            done = np.zeros(len(x), bool)
            done[todo[~few]] = True
            rows.append(row[done[row]])
            codes.append(code[done[row]] & 0x7FFFFFFF)
            todo, goal = todo[few], goal - 0.25
        row, code = (np.concatenate(y) if y else np.zeros(0, np.int64) for y in (rows, codes))
        both = np.unique((row << 31) | code)
        return (both & 0x7FFFFFFF).astype(np.int32), np.bincount(both >> 31, minlength=len(x))


def _clean(batches):
    """Unit vectors as bytes (null where a vector can't be compared); one row in, one row out."""
    for b in batches:
        vec = b.column("embedding")
        size = np.diff(vec.offsets.to_numpy()) if b.num_rows else np.zeros(0, np.int64)
        begin = vec.offsets.to_numpy()[:-1] if b.num_rows else size
        flat = vec.values
        x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
        there = vec.is_valid().to_numpy(zero_copy_only=False) & (size > 0)
        out: list[bytes | None] = [None] * b.num_rows
        for dim in np.unique(size[there]).tolist():
            at = np.flatnonzero(there & (size == dim))
            v = x[begin[at][:, None] + np.arange(dim)]
            top = np.abs(v).max(1)
            ok = np.isfinite(top) & (top > 0)
            v = v[ok] / top[ok][:, None]
            v /= np.sqrt((v * v).sum(1))[:, None]
            for r, u in zip(at[ok].tolist(), v):
                out[r] = u.tobytes()
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([len(v) // 8 if v else None for v in out], pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "v"])


def _decode_rows(blocks: int, words: int):
    """Each class with its vector in single precision and all filters it passes."""
    step = max(16, 4_000_000 // words**2)

    def run(batches):
        codes: dict[int, ProductCode] = {}
        for b in batches:
            for lo in range(0, b.num_rows, step):
                c = b.slice(lo, step)
                dims = c.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    part = c.take(pa.array(np.flatnonzero(dims == dim)))
                    x = np.frombuffer(b"".join(part.column("v").to_pylist()), np.float64).reshape(-1, dim)
                    filters, n = codes.setdefault(dim, ProductCode(dim, blocks, words)).decode(x)
                    every = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(filters))
                    single = pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("c", "lab", "dim", "copies", "rep", "v")), single, every], ["c", "lab", "dim", "copies", "rep", "v", "s", "filters"])

    return run


def _whole_runs(batches, column: str):
    """Tables of whole runs of equal values of a sorted column; the last run of a batch waits for the next."""
    left = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(column).to_numpy()
        begin = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
        if left and left[-1].column(column)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(left)
            left = []
        for f, to in zip(begin, begin[1:]):
            yield pa.Table.from_batches([*left, b.slice(f, to - f)])
            left = []
        left.append(b.slice(begin[-1]))
    if left:
        yield pa.Table.from_batches(left)


class _Earlier:
    """Tells which pairs of a group share a filter before the group's own."""

    def __init__(self, lists: pa.ChunkedArray, before: int):
        lists = lists.combine_chunks()
        value = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        early = value < before
        value, row = value[early], row[early]
        _, column, times = np.unique(value, return_inverse=True, return_counts=True)
        more = times[column] > 1  # a filter that only one of them passes isn't shared
        self.row, self.column = row[more], np.unique(column[more], return_inverse=True)[1]
        self.n, self.width = len(lists), int(self.column.max()) + 1 if len(self.column) else 0

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)), bool)
        place = np.full(self.n, -1)
        for lo in range(0, self.width, 1024):
            some = (self.column >= lo) & (self.column < lo + 1024)
            sides = []
            for side in (a, b):
                place[:] = -1
                place[side] = np.arange(len(side))
                at = place[self.row[some]]
                m = np.zeros((len(side), min(1024, self.width - lo)), np.float32)
                m[at[at >= 0], self.column[some][at >= 0] - lo] = 1
                sides.append(m)
            out |= sides[0] @ sides[1].T > 0
        return out


def _compare(threshold: float):
    """Links within one pair of tiles, each counted in the first filter that its two vectors share.

    Gives per vector (c) the links found here, weighted by copies (n), and the smallest vector it is joined to here (p); and
    pairs (c, p) without n that only double precision can decide.
    """

    def run(batches):
        for t in _whole_runs(batches, "g"):
            if t.num_rows < 2:
                continue
            filter_, ta, tb = (t.column(x)[0].as_py() for x in ("filter", "ta", "tb"))
            c, copies, tile = (t.column(x).to_numpy() for x in ("c", "copies", "tile"))
            x = np.frombuffer(b"".join(t.column("s").to_pylist()), np.float32).reshape(len(c), -1)
            margin = 1e-5 + 2e-7 * x.shape[1]
            a, b = np.flatnonzero(tile == ta), np.flatnonzero(tile == tb)
            earlier, weight = None, copies.astype(np.float64)
            degree, root = np.zeros(len(c)), np.arange(len(c))
            near: list[tuple[np.ndarray, np.ndarray]] = []
            for lo in range(0, len(a), 512):
                block = a[lo : lo + 512]
                sim = x[block] @ x[b].T
                linked = sim >= threshold - margin
                if ta == tb:
                    linked &= c[block][:, None] < c[b][None, :]
                rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
                if not len(rows):
                    continue
                earlier = earlier or _Earlier(t.column("filters"), filter_)
                block, to = block[rows], b[cols]
                linked = linked[np.ix_(rows, cols)] & ~earlier.shared(block, to)
                sure = linked & (sim[np.ix_(rows, cols)] >= threshold + margin)
                i, j = np.nonzero(linked & ~sure)
                near.append((c[block[i]], c[to[j]]))
                degree[block] += sure @ weight[to]
                np.add.at(degree, to, weight[block] @ sure)
                for r in np.flatnonzero(sure.any(1)).tolist():
                    parts = np.unique(np.append(root[to[sure[r]]], root[block[r]]))
                    if len(parts) > 1:
                        root[np.isin(root, parts[1:])] = parts[0]
            used = np.flatnonzero(degree)
            first, second = (np.concatenate([p[k] for p in near]) if near else np.zeros(0, np.int64) for k in (0, 1))
            n = pa.concat_arrays([pa.array(degree[used].astype(np.int64)), pa.nulls(len(first), pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([c[used], first])), n, pa.array(np.concatenate([c[root[used]], second]))], ["c", "n", "p"])

    return run


def _exact(threshold: float):
    """The pairs of (c, p, v, w) whose cosine, in double precision, reaches the threshold."""

    def run(batches):
        for b in batches:
            v, w = (b.column(k).to_pylist() for k in ("v", "w"))
            ok = [float(np.dot(np.frombuffer(x, np.float64), np.frombuffer(y, np.float64))) >= threshold for x, y in zip(v, w)]
            yield b.select(["c", "p", "copies", "others"]).filter(pa.array(ok, pa.bool_()))

    return run


def cap_near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null and their cosine is at least
    ``threshold``; n_links counts the other rows linked directly (copies too), component_id is the
    smallest vec_id reachable, kept says that the row is it. Null, empty and zero vectors and those with
    null or non-finite components, and rows without a label, link with nothing. Vectors of
    different lengths never link. A null vec_id names no component but its own (null, kept false); repeated rows
    link with each other. An empty table gives an empty result. Further columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.xxhash64(F.col("label").cast("string")).alias("lab"), F.col("label").isNull().alias("bare"))
    rows = rows.select("vec_id", F.when(~F.col("bare"), F.col("embedding")).alias("embedding"), F.col("lab").alias("label"))
    rows = rows.mapInArrow(_clean, "vec_id long, label long, dim int, v binary").withColumnRenamed("label", "lab")
    rows = scratch.keep(rows.withColumn("c", F.when(F.col("v").isNotNull(), F.xxhash64("lab", "v"))))
    classes = rows.where("v is not null").groupBy("c").agg(F.first("lab").alias("lab"), F.first("dim").alias("dim"), F.count("*").alias("copies"), F.min("vec_id").alias("rep"), F.first("v").alias("v"))
    blocks, words = code_size(rows.where("v is not null").count())
    classes = scratch.keep(classes.mapInArrow(_decode_rows(blocks, words), "c long, lab long, dim int, copies long, rep long, v binary, s binary, filters array<int>"))
    passed = classes.select("c", "lab", "dim", "copies", "s", "filters", F.explode("filters").alias("filter"))

    sizes = classes.select("lab", "dim", F.explode("filters").alias("filter")).groupBy("lab", "dim", "filter").count()
    hot = scratch.keep(sizes.where(F.col("count") > TILE).select("lab", "dim", "filter", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")))
    if hot.take(1):
        passed = passed.join(hot, ["lab", "dim", "filter"], "left")
    else:
        passed = passed.withColumn("tiles", F.lit(None).cast("int"))
    tile = F.pmod(F.xxhash64("c"), F.coalesce("tiles", F.lit(1))).cast("int")
    passed = passed.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    passed = passed.select("filter", "c", "copies", "s", "filters", "tile", low.alias("ta"), high.alias("tb"), F.xxhash64("lab", "dim", "filter", low, high).alias("g"))
    found = scratch.keep(passed.repartition("g").sortWithinPartitions("g").mapInArrow(_compare(threshold), "c long, n long, p long"))

    side = lambda x, v, n: classes.select(F.col("c").alias(x), F.col("v").alias(v), F.col("copies").alias(n))
    near = found.where("n is null").select("c", "p").join(side("c", "v", "copies"), "c").join(side("p", "w", "others"), "p")
    near = scratch.keep(near.select("c", "p", "copies", "others", "v", "w").mapInArrow(_exact(threshold), "c long, p long, copies long, others long"))
    both = F.explode(F.array(F.struct("c", F.col("others").alias("n")), F.struct(F.col("p").alias("c"), F.col("copies").alias("n"))))
    links = found.where("n is not null").select("c", "n").unionByName(near.select(both.alias("e")).select("e.c", "e.n"))
    joins = found.where("n is not null").select("c", "p").unionByName(near.select("c", "p"))

    parts = connected_components(scratch, joins.select(F.col("c").alias("a"), F.col("p").alias("b")))
    named = classes.select("c", "copies", "rep").join(parts, F.col("c") == F.col("node"), "left").withColumn("component", F.coalesce("component", "c"))
    named = named.join(links.groupBy("c").agg(F.sum("n").alias("n")), "c", "left").select("c", "rep", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = scratch.keep(named)
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("c", "n_links", "component_id")
    linked = rows.where("c is not null").join(named, "c").select("vec_id", "n_links", "component_id")
    alone = rows.where("c is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
