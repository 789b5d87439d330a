"""What is told of findings: filters, counts, reports with context, snapshots, audits, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import mask_secret
from .lines import document_lines

#: Codes that a filter by code never hides, and sections of a full check by code.
ALWAYS_SHOWN = ["Z110", "Z111"]
SECTIONS = {"links": ["Z101", "Z102", "Z103", "Z104", "Z105"], "orphans": ["Z402"], "snippets": ["Z503"], "unused_assets": ["Z405"], "nav_contract": ["Z406"], "references": ["Z301", "Z302", "Z303"]}


def only(findings: DataFrame, codes: list[str] | None) -> DataFrame:
    """Findings of the given codes, and of configuration errors; all if none are given."""
    return findings if not codes else findings.where(F.col("code").isin([*codes, *ALWAYS_SHOWN]))


def shown(findings: DataFrame, info: bool = False) -> DataFrame:
    """Findings without notes, unless they are asked for."""
    return findings if info else findings.where("severity <> 'info'")


def quiet_counts(findings: DataFrame) -> DataFrame:
    """One row: files with findings, errors, warnings, breaches."""
    n = lambda c: F.count(F.when(c, 1))
    return findings.agg(F.countDistinct("doc_path").alias("files"), n(F.col("severity") == "error").alias("errors"), n(F.col("severity") == "warning").alias("warnings"), n(F.col("code").isin("Z201", "Z203", "Z204")).alias("breaches"))


def file_reports(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_path, n_findings, has_errors) of every document, also those without findings."""
    per = findings.groupBy("doc_path").agg(F.count("*").alias("n_findings"), F.max(F.col("severity") == "error").alias("has_errors"))
    return docs.select("doc_path").join(per, "doc_path", "left").fillna(0, ["n_findings"]).withColumn("has_errors", F.coalesce("has_errors", F.lit(False)))


def with_context(docs: DataFrame, findings: DataFrame, reach: int = 2) -> DataFrame:
    """Findings with ``context``: their line and ``reach`` more on both sides, numbered, the line itself marked; credentials are starred.

    Lines are joined by document and number, so no window holds a document.
    """
    near = findings.withColumn("at", F.explode(F.sequence(F.greatest(F.col("line_no") - reach, F.lit(1)), F.col("line_no") + reach))).where("line_no > 0")
    rows = near.join(document_lines(docs).select("doc_path", F.col("line_no").alias("at"), "line"), ["doc_path", "at"])
    text = F.when((F.col("code") == "Z201") & (F.col("match_text") != ""), F.replace("line", F.col("match_text"), mask_secret(F.col("match_text")))).otherwise(F.col("line"))
    mark = F.when(F.col("at") == F.col("line_no"), "> ").otherwise("  ")
    key = ["doc_path", "line_no", "code", "match_text"]
    rows = rows.select(*key, "at", F.concat(mark, F.col("at").cast("string"), F.lit(" | "), text).alias("shown")).distinct()
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x["shown"]), "\n").alias("context"))


def section_counts(findings: DataFrame) -> DataFrame:
    """(section, n) of a full check's sections, those without findings too."""
    section = F.lit(None).cast("string")
    for name, codes in SECTIONS.items():
        section = F.when(F.col("code").isin(codes), name).otherwise(section)
    per = findings.withColumn("section", section).where("section IS NOT NULL").groupBy("section").agg(F.count("*").alias("n"))
    return findings.sparkSession.createDataFrame([(x,) for x in SECTIONS], "section string").join(per, "section", "left").fillna(0, ["n"])


def section_lines(findings: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(section, json): one JSON object a finding, for the sections of a full check; ``allowed`` (doc_path, line_no, code) filters by semi-join.

    A writer frames each section's lines as one array; no task gathers them.
    """
    rows = findings if allowed is None else findings.join(allowed.select("doc_path", "line_no", "code").distinct(), ["doc_path", "line_no", "code"], "left_semi")
    section = F.lit(None).cast("string")
    for name, codes in SECTIONS.items():
        section = F.when(F.col("code").isin(codes), name).otherwise(section)
    return rows.select(section.alias("section"), F.to_json(F.struct(F.col("doc_path").alias("file"), F.col("line_no").alias("line"), "code", "match_text")).alias("json")).where("section IS NOT NULL")


def url_occurrences(links: DataFrame) -> DataFrame:
    """(url, n, n_docs, first_path): every external URL once, to be probed; ``fan_out`` brings results back to the places."""
    rows = links.where(F.regexp_like("url", F.lit("(?i)^https?://")))
    return rows.groupBy("url").agg(F.count("*").alias("n"), F.countDistinct("doc_path").alias("n_docs"), F.min("doc_path").alias("first_path"))


def without_prefixes(urls: DataFrame, prefixes: list[str]) -> DataFrame:
    """URLs that begin with none of the excluded prefixes."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith("url", F.lit(p))
    return urls.where(~hit)


def outside_security(links: DataFrame, findings: DataFrame) -> DataFrame:
    """Links of documents without a credential or forbidden term: those of others are never probed."""
    return links.join(findings.where(F.col("code").isin("Z201", "Z204")).select("doc_path").distinct(), "doc_path", "left_anti")


def fan_out(links: DataFrame, failed: DataFrame) -> DataFrame:
    """(doc_path, line_no, url, status) of every place where a failed URL (url, status) occurs."""
    return links.join(failed.select("url", "status"), "url").select("doc_path", "line_no", "url", "status")


def reusable(cache: DataFrame, now: int, ttl: int = 86_400) -> DataFrame:
    """Cached answers (url, status, ts in seconds) that still hold: status 200 and younger than ``ttl``."""
    return cache.where((F.col("status") == 200) & (F.col("ts") > now - ttl))


def hit_rate(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """One row (docs, hits, rate) of documents whose content hash is cached."""
    keyed = docs.select(F.sha2("text", 256).alias("content_hash")).join(cache.select("content_hash").distinct().withColumn("hit", F.lit(1)), "content_hash", "left")
    return keyed.agg(F.count("*").alias("docs"), F.count("hit").alias("hits")).withColumn("rate", F.round(F.col("hits") / F.greatest("docs", F.lit(1)), 4))


def stale_paths(cache: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_path) of cached documents that are gone."""
    return cache.select("doc_path").distinct().join(docs.select("doc_path"), "doc_path", "left_anti")


def site_counts(docs: DataFrame, assets: DataFrame) -> DataFrame:
    """One row (docs, assets, bytes)."""
    return docs.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).crossJoin(assets.agg(F.count("*").alias("assets"))).select("docs", "assets", "bytes")


def routes_digest(routes: DataFrame, buckets: int = 64) -> DataFrame:
    """One row (digest) of the whole site: SHA-256 over the digests of ``buckets`` sorted parts, so no task sorts all routes."""
    row = F.concat_ws("\t", "url", "source", "status")
    part = F.sha2(row, 256)
    per = routes.select(F.conv(F.substring(part, 1, 4), 16, 10).cast("int").alias("n"), part.alias("h")).withColumn("bucket", F.col("n") % buckets)
    per = per.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), ","), 256).alias("digest"))


def snapshot(total: DataFrame, categories: DataFrame, created_at: str) -> DataFrame:
    """One row (json): the score and its four categories, to be compared with later."""
    per = categories.agg(F.array_sort(F.collect_list(F.struct("category", "issues", "category_score", "contribution"))).alias("categories"))
    return total.crossJoin(per).select(F.to_json(F.struct(F.lit(2).alias("schema_version"), F.lit(created_at).alias("timestamp"), "score", "suppressions", "categories")).alias("json"))


def badge(total: DataFrame) -> DataFrame:
    """One row (label, message, color) of a badge for the score."""
    color = F.when(F.col("score") >= 90, "brightgreen").when(F.col("score") >= 70, "yellow").when(F.col("score") >= 50, "orange").otherwise("red")
    return total.select(F.lit("docs score").alias("label"), F.concat(F.col("score").cast("string"), F.lit("/100")).alias("message"), color.alias("color"))


def audit(findings: DataFrame, directives: DataFrame, per_file: list[tuple[str, list[str]]], cap: int = 30) -> DataFrame:
    """One row: debt (inline directives, per-file ignores as glob and code), its status, findings, breaches and whether the audit passes."""
    ignored = len({(g, c) for g, codes in per_file for c in codes})
    debt = directives.agg(F.count("*").alias("inline"))
    found = findings.agg(F.count("*").alias("findings"), F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("code").isin("Z201", "Z203", "Z204"), 1)).alias("breaches"))
    n = F.col("inline") + ignored
    out = debt.crossJoin(found).select("inline", F.lit(ignored).cast("long").alias("per_file"), n.cast("long").alias("debt"), F.when(n <= 0, "CLEAN").when(n > cap, "CRITICAL").otherwise("MANAGED").alias("status"), "findings", "errors", "breaches")
    return out.withColumn("passes", (F.col("status") != "CRITICAL") & (F.col("breaches") == 0))


def cap_exceeded(directives: DataFrame, cap: int = 30) -> DataFrame:
    """One row (json) if there are more directives than ``cap``, else none."""
    n = directives.agg(F.count("*").alias("n"))
    return n.where(F.col("n") > cap).select(F.to_json(F.struct(F.lit("suppression-cap-exceeded").alias("error"), "n", F.lit(cap).alias("cap"))).alias("json"))


def by_place(findings: DataFrame) -> DataFrame:
    """Findings in order of path, line, code and text, for writers."""
    return findings.orderBy("doc_path", "line_no", "code", "match_text")


def first_of_each(findings: DataFrame) -> DataFrame:
    """(doc_path, code, line_no) of the earliest finding of each code in a document."""
    return findings.groupBy("doc_path", "code").agg(F.min("line_no").alias("line_no"))


def running(findings: DataFrame) -> DataFrame:
    """Findings with how many of their document came before, by line."""
    return findings.withColumn("n_before", F.row_number().over(W.partitionBy("doc_path").orderBy("line_no", "code", "match_text")) - 1)
