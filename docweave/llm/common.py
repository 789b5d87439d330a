"""Helpers of the training-data operators: durable intermediate tables, fixed-size
sketches gathered from all tasks, and connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = jdir.get() if jdir.isDefined() else tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", at) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return at.rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Tables written to the shared folder, so a lost executor never costs finished work.

    ``keep`` writes a frame and reads it back, which also cuts its lineage and gives the
    planner true sizes; ``drop`` removes a table that no later step reads. What the
    result still reads goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/docweave-{uuid.uuid4().hex}", {}
        atexit.register(self._end)
        # texts are long: the default of 10,000 rows a batch costs each task several buffers of tens of MB
        if int(spark.conf.get(_BATCH, "10000")) >= 10_000:
            spark.conf.set(_BATCH, "4000")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _end(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended before the process does
            pass

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        self.paths[len(self.paths)] = path
        out._docweave_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            self._delete(f._docweave_path)

    def release(self) -> None:
        """Has Spark delete the shuffle files of finished steps, which stay until the driver happens to collect its garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def null_safe(df: DataFrame, name: str, dtype: str) -> Column:
    """A column of the input by name and type; a null of that type where the input lacks it."""
    return F.col(f"`{name}`").cast(dtype).alias(name) if name in df.columns else F.lit(None).cast(dtype).alias(name)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, made longer until no column of the frames has it (names are compared without case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``docs``, written once, with a number of their own, and the name of that column.

    Decisions about single rows are joined back by it, so repeated rows, null ids and clashing names can't blur them.
    """
    name = unused("row_no", docs)
    return scratch.keep(docs.withColumn(name, F.monotonically_increasing_id())), name


#: Row numbers of a block of bits, and blocks that are broadcast at once (64 MB).
BLOCK_ROWS, BLOCKS = 1 << 16, 8192


def only_rows(rows: DataFrame, row_no: str, chosen: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of a ``numbered`` frame whose number is in the only column of ``chosen``, or those whose isn't.

    The rows themselves stay where they are: the numbers travel, as a bit for each row of the table. The driver gets one bit a
    row, and at most 64 MB of them are broadcast at once.
    """

    def run(batches):
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            block, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(block).tolist():
                bits.setdefault(k, np.zeros(BLOCK_ROWS, bool))[at[block == k]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), pa.array([np.packbits(x[: int(x.nonzero()[0][-1]) + 1]).tobytes() for x in bits.values()], pa.binary())], ["block", "bits"])

    no = F.col(chosen.columns[0])
    dealt = chosen.select((F.shiftright(no, 16)).alias("block"), no.bitwiseAND(BLOCK_ROWS - 1).alias("at")).repartition("block")
    blocks = sorted((r.block, bytes(r.bits)) for r in dealt.mapInArrow(run, "block long, bits binary").collect())

    def among(sent):
        @F.arrow_udf("boolean")
        def test(numbers: pa.Array) -> pa.Array:
            n = numbers.to_numpy(zero_copy_only=False)
            hit, block = np.zeros(len(n), bool), n >> 16
            for k in np.unique(block).tolist():
                if k in sent.value:
                    bits, own = np.unpackbits(np.frombuffer(sent.value[k], np.uint8)), np.flatnonzero(block == k)
                    at = n[own] & (BLOCK_ROWS - 1)
                    hit[own] = (at < len(bits)) & bits[np.minimum(at, len(bits) - 1)].astype(bool)
            return pa.array(hit if keep else ~hit)

        return test

    out, column = None, F.col(f"`{row_no}`")
    cuts = [blocks[i][0] << 16 for i in range(BLOCKS, len(blocks), BLOCKS)]
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = rows if low is None else rows.where(column >= low)
        part = part if high is None else part.where(column < high)
        sent = rows.sparkSession.sparkContext.broadcast(dict(blocks[i * BLOCKS : (i + 1) * BLOCKS]))
        part = part.where(among(sent)(column))
        out = part if out is None else out.unionByName(part)
    return out


# -- fixed-size sketches -----------------------------------------------------------------


def sketch_rows(counts: np.ndarray, pieces: int) -> list[tuple[int, bytes]]:
    """A task's table of counts in ``pieces`` equal parts; parts of zeros are left out."""
    return [(i, p.astype(np.int64).tobytes()) for i, p in enumerate(np.split(counts, pieces)) if p.any()]


def add_sketches(rows: DataFrame, size: int, pieces: int, dtype=np.int64) -> np.ndarray:
    """Sum the parts ``(piece, counts)`` of all tasks into one table of ``size`` counts.

    Parts are summed on the executors, streaming, one array of ``size / pieces`` counts
    for each part at hand; the driver gets ``size`` numbers whatever the input.
    """

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1)):
                part = np.frombuffer(raw.as_buffer(), dtype)
                if i in sums:
                    sums[i] += part
                else:
                    sums[i] = part.copy()
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "counts"])

    out = np.zeros((pieces, size // pieces), dtype)
    for r in rows.select("piece", "counts").repartition("piece").mapInArrow(total, "piece int, counts binary").collect():
        out[r.piece] += np.frombuffer(r.counts, dtype)
    return out.ravel()


# -- connected components ----------------------------------------------------------------


#: Links that a task joins at once, before it passes on what they come to.
_AT_ONCE = 500_000


def _contract(batches):
    """Stars (u, v) of the components of a task's links: one link for each node but the smallest."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars():
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = list(range(len(nodes)))
        for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            while root[j] != j:
                root[j] = root[root[j]]
                j = root[j]
            root[max(i, j)] = min(i, j)
        for i in range(len(root)):  # roots are smaller, so they are final by now
            root[i] = root[root[i]]
        least = nodes[root]
        more = least < nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[more]), pa.array(least[more])], ["u", "v"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= _AT_ONCE:
            yield stars()
            held.clear()
    if held:
        yield stars()


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): component is the smallest node reachable.

    Each round first joins what lies in one task, then, unless all links have come to be stars, takes a large-star
    and a small-star step: grouped minima and equi-joins on the edge table. The edges never grow, and each
    round is written to the shared folder. Nodes are longs; a null or self link adds nothing.
    """
    step = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    while True:
        now = scratch.keep(step.mapInArrow(_contract, "u long, v long"))
        ends = now.select(F.explode(F.array(F.struct("u", F.col("v").alias("up")), F.struct(F.col("v").alias("u"), F.lit(None).cast("long").alias("up")))).alias("e")).select("e.*")
        # a node of a star has one link up, or none and only links from below
        odd = ends.groupBy("u").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.max(F.col("up").isNull()).alias("below")).where("low <> high OR (below AND low IS NOT NULL)")
        if not odd.limit(1).count():
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", F.col("m").alias("v"), F.col("v").alias("x"))
        step = small.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("x").alias("u"), "v"))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
    now = now.distinct()
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
