"""Sharding by sampled splitters: records are range-partitioned on (text hash, doc_id, row) at the
quantiles of a size-weighted sample of keys; ranges that turn out overfull are subdivided.

Equal texts lie side by side in key order, so a group stays in one shard, or in neighbouring
ones where it is larger than its share. Exact totals of every range then place each record:
running bytes before its range, plus those within it. Law ``bytes``: a shard's size differs
from total / shards by less than the sizes of the records at its two ends. The last part of a key is a hash of the row's
number, so even rows that are repeated as a whole can be cut into ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, null_safe

#: Keys drawn for each range in each round of sampling; they are what reaches the driver, 24 bytes each.
PER_RANGE = 20
#: Records that a range should hold at most; ranges over twice their share of bytes are cut again.
RANGE_ROWS, MIN_RANGES, MAX_RANGES = 200_000, 192, 32_768
#: Rounds of subdivision.
ROUNDS = 6

_KEY = ["h", "id", "row"]


def _ranges(bounds: list[tuple[int, int, int]]):
    """Adds to rows with a key the number of bounds that are not above it."""
    hs = np.array([b[0] for b in bounds], np.int64)
    rest = np.array([b[1:] for b in bounds], [("id", np.int64), ("row", np.int64)])

    def run(batches):
        for b in batches:
            h = b.column("h").to_numpy()
            at, end = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
            tied = np.flatnonzero(end > at)
            if len(tied):  # bounds of the same hash: told apart by the rest of the key
                own = np.empty(len(tied), rest.dtype)
                own["id"], own["row"] = b.column("id").to_numpy()[tied], b.column("row").to_numpy()[tied]
                begin = at[tied]
                for first in np.unique(begin).tolist():
                    some = np.flatnonzero(begin == first)
                    at[tied[some]] += np.searchsorted(rest[first : end[tied[some[0]]]], own[some], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "range"])

    return run


def _draw(rows: DataFrame, per_byte: float, seed: int) -> list[tuple[int, int, int]]:
    """Keys drawn with a chance proportional to size, by a hash of the key (so a rerun draws the same)."""
    chance = (F.xxhash64(*_KEY, F.lit(seed)).cast("double") / F.lit(2.0**64) + 0.5) < F.col("size") * F.lit(per_byte)
    return sorted(tuple(r) for r in rows.where(chance).select(*_KEY).collect())


def shard_report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8 (a null text has none; its crc32 is that of no
    bytes). slot counts a shard's records from 0 in key order. Null doc_ids sort before all
    others; repeated rows are placed one after the other; a very long text is one record, and its shard is as much
    larger; an empty table gives an empty result. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(null_safe(docs, "doc_id", "long"), null_safe(docs, "text", "string")).select(
        "doc_id",
        F.coalesce("doc_id", F.lit(-(2**63))).alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.monotonically_increasing_id()).alias("row"),
    )
    rows = scratch.keep(rows)
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = int(min(MAX_RANGES, max(MIN_RANGES, n // RANGE_ROWS)))
    share = max(1, total // ranges)

    drawn = _draw(rows, PER_RANGE * ranges / max(1, total), 0)
    bounds = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []
    for seed in range(1, ROUNDS + 1):
        bounds = sorted(set(bounds))
        placed = rows.mapInArrow(_ranges(bounds), "doc_id long, id long, size long, text_crc32 long, h long, `row` long, `range` int")
        sums = {r["range"]: r for r in placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(F.struct(*_KEY)).alias("low"), F.max(F.struct(*_KEY)).alias("high")).collect()}
        full = {k: r for k, r in sums.items() if r.bytes > 2 * share and r.low != r.high}
        if not full or seed == ROUNDS:
            break
        over = sum(r.bytes for r in full.values())
        cuts = int(np.ceil(over / share))
        more = _draw(placed.where(F.col("range").isin(list(full))), min(1.0, PER_RANGE * cuts / over), seed)
        bounds += [more[len(more) * i // cuts] for i in range(1, cuts)] if more else []
        bounds += [tuple(r.high) for r in full.values()]

    order = sorted(sums)
    before, start = 0, {}
    for k in order:
        start[k] = before
        before += sums[k].bytes
    offsets = spark.createDataFrame([(k, start[k]) for k in order], "range int, bytes_before long")
    w = W.partitionBy("range").orderBy(*_KEY).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = placed.join(F.broadcast(offsets), "range").withColumn("upto", F.sum("size").over(w) + F.col("bytes_before"))
    middle = F.col("upto") * 2 - F.col("size")
    shard = F.least(F.lit(shards - 1), F.expr(f"CAST({shards} AS DECIMAL(10,0))") * middle.cast("decimal(27,0)") / F.lit(2 * max(1, total)).cast("decimal(27,0)")).cast("int")
    placed = scratch.keep(placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "range", "shard", "upto"))
    counts = sorted((r["range"], r["shard"], r["count"]) for r in placed.groupBy("range", "shard").count().collect())
    seen, first = {}, []
    for k, s, c in counts:
        first.append((k, s, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + c
    firsts = spark.createDataFrame(first, "range int, shard int, rows_before long")
    rank = F.row_number().over(W.partitionBy("range", "shard").orderBy("upto"))
    return placed.join(F.broadcast(firsts), ["range", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rows_before") + rank - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
