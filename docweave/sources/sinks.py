"""Sinks: findings as JSON, SARIF, annotations and baselines.

Documents of findings are made on the executors where they can grow (one line a finding); the single JSON
documents that tools expect are written by one task, from rows that are already findings, not corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SARIF security severities and the codes that fail an invocation.
SECURITY_SEVERITY = {"Z201": "9.5", "Z203": "9.5", "Z202": "9.0", "Z204": "9.0", "Z205": "9.0"}


def annotations(findings: DataFrame) -> DataFrame:
    """One workflow annotation line for each finding (severity, doc_path, line_no, code, message)."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("notice")
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return findings.select(F.format_string("::%s file=%s,line=%d,title=%s::%s", level, F.col("doc_path"), F.greatest(F.col("line_no"), F.lit(1)), F.col("code"), escape(F.col("message"))).alias("value"))


def _result() -> Column:
    region = F.struct(F.greatest(F.col("line_no"), F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("doc_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    level = F.when(F.col("severity").isin("error", "warning"), F.col("severity")).otherwise("note")
    return F.struct(F.col("code").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))


def sarif(findings: DataFrame, tool: str = "docweave") -> DataFrame:
    """One row (json) with a SARIF 2.1.0 document; results are in order of path, line, code and message."""
    security = F.create_map(*[F.lit(x) for kv in SECURITY_SEVERITY.items() for x in kv])
    rows = findings.select(F.struct("doc_path", "line_no", "code", "message", _result().alias("r")).alias("x"), "code")
    rule = F.struct(F.col("code").alias("id"), F.struct(security[F.col("code")].alias("security-severity")).alias("properties"))
    both = rows.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("results"), F.array_sort(F.collect_set(rule)).alias("rules"), F.coalesce(F.max(F.col("code").isin(list(SECURITY_SEVERITY))), F.lit(False)).alias("breached"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.array(F.struct((~F.col("breached")).alias("executionSuccessful"))).alias("invocations"), F.col("results"))
    return both.select(F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("json"))


def findings_json(findings: DataFrame) -> DataFrame:
    """One row (json): findings in order, and how many of each severity."""
    rows = findings.select(F.struct("doc_path", "line_no", "code", "severity", "message").alias("x"), "severity")
    counts = [F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("error", "warning", "info")]
    return rows.agg(F.array_sort(F.collect_list("x")).alias("findings"), *counts).select(F.to_json(F.struct("findings", F.struct("error", "warning", "info").alias("summary"))).alias("json"))


def baseline(findings_with_signatures: DataFrame, score: int, created_at: str) -> DataFrame:
    """One row (json): a baseline with sorted distinct signatures."""
    return findings_with_signatures.agg(F.array_sort(F.collect_set("signature")).alias("signatures"), F.count("*").alias("findings_count")).select(
        F.to_json(F.struct(F.lit("1").alias("version"), F.lit(created_at).alias("created_at"), F.lit(score).alias("score"), "findings_count", "signatures")).alias("json")
    )


def read_baseline(spark, path: str) -> DataFrame:
    """(signature) of a baseline file."""
    return spark.read.json(path, schema="signatures array<string>", multiLine=True).select(F.explode("signatures").alias("signature"))


def url_probe(urls: DataFrame, probe, width: int = 20) -> DataFrame:
    """(url, status) of distinct URLs by ``probe(url) -> status``, at most ``width`` tasks at once; 401, 403 and 429 count as alive."""
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"url": b["url"], "status": [int(probe(u)) for u in b["url"]]})

    found = urls.select("url").distinct().repartition(width).mapInPandas(run, "url string, status int")
    return found.withColumn("alive", (F.col("status") < 400) | F.col("status").isin(401, 403, 429))
