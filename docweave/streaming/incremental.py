"""Incremental analysis with Structured Streaming: change events update the state of documents, and findings follow.

Each micro-batch keeps the last change of every path, writes a new version of the document table, recomputes
the findings of changed documents and of the pages that link to them, and leaves tombstones for documents that
vanished. Versions are plain tables in the shared folder, so a restarted query goes on from the last one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Change events: op is ``upsert`` or ``delete``.
CHANGES = "doc_path string, text string, op string, ts timestamp"


def last_changes(batch: DataFrame) -> DataFrame:
    """The latest event of each path; ties in time go to the later operation by name, then text."""
    w = W.partitionBy("doc_path").orderBy(F.desc("ts"), F.desc("op"), F.desc("text"))
    return batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def apply_changes(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """The document table after the changes."""
    return docs.join(changes.select("doc_path"), "doc_path", "left_anti").unionByName(changes.where("op = 'upsert'").select("doc_path", "text"))


class IncrementalAnalysis:
    """Keeps ``docs`` and ``findings`` tables under ``path`` up to date with a stream of changes.

    ``rules`` computes findings (with doc_path) of documents from (all documents, documents to analyse); ``edges``
    gives (src_path, dst_path) of links, by which pages that link to a changed one are analysed again.
    """

    def __init__(self, spark: SparkSession, path: str, rules: Callable[[DataFrame, DataFrame], DataFrame], edges: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.rules, self.edges = spark, path.rstrip("/"), rules, edges
        self.version = -1

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/v{self.version}")

    def start_from(self, docs: DataFrame) -> None:
        self.version = 0
        docs.select("doc_path", "text").write.mode("overwrite").parquet(f"{self.path}/docs/v0")
        docs = self._read("docs")
        self.rules(docs, docs).write.mode("overwrite").parquet(f"{self.path}/findings/v0")

    def docs(self) -> DataFrame:
        return self._read("docs")

    def findings(self) -> DataFrame:
        return self._read("findings")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch. Replaying it gives the same tables, as the version is the batch's own."""
        self.version = batch_id
        before, found = self.docs(), self._read("findings")
        changes = last_changes(batch)
        self_next = batch_id + 1
        apply_changes(before, changes).write.mode("overwrite").parquet(f"{self.path}/docs/v{self_next}")
        after = self.spark.read.parquet(f"{self.path}/docs/v{self_next}")
        touched = changes.select("doc_path")
        links = self.edges(before).unionByName(self.edges(after)).distinct()
        again = touched.unionByName(links.join(touched.withColumnRenamed("doc_path", "dst_path"), "dst_path", "left_semi").select(F.col("src_path").alias("doc_path"))).distinct()
        again.write.mode("overwrite").parquet(f"{self.path}/touched/v{self_next}")
        again = self.spark.read.parquet(f"{self.path}/touched/v{self_next}")
        fresh = self.rules(after, after.join(again, "doc_path", "left_semi"))
        found.join(again, "doc_path", "left_anti").unionByName(fresh).write.mode("overwrite").parquet(f"{self.path}/findings/v{self_next}")
        self.version = self_next

    def cleared(self) -> DataFrame:
        """Tombstones: documents that had findings before the last batch and have none now."""
        if self.version < 1:
            return self.findings().select("doc_path").limit(0)
        return self.spark.read.parquet(f"{self.path}/findings/v{self.version - 1}").select("doc_path").distinct().join(self.findings().select("doc_path"), "doc_path", "left_anti")

    def run(self, stream: DataFrame, checkpoint: str):
        """Start a query over a stream of changes that works off what is there and ends."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(changes: DataFrame, quiet: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """A stream of (doc_path, n_changes, last_ts): bursts of changes to a path that end with ``quiet`` time without one."""
    return (
        changes.withWatermark("ts", late)
        .groupBy("doc_path", F.session_window("ts", quiet))
        .agg(F.count("*").alias("n_changes"), F.max("ts").alias("last_ts"))
        .select("doc_path", "n_changes", "last_ts")
    )


def cache_misses(docs: DataFrame, cache: DataFrame, config_hash: str) -> DataFrame:
    """Documents whose content, under this configuration, isn't in the cache (content_hash, config_hash): the work to do."""
    keyed = docs.withColumn("content_hash", F.sha2("text", 256)).withColumn("config_hash", F.lit(config_hash))
    return keyed.join(cache.select("content_hash", "config_hash"), ["content_hash", "config_hash"], "left_anti").select("doc_path", "text", "content_hash")
