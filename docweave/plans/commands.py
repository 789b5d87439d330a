"""Whole checks as compositions of operators: each returns frames, nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.documents import snippet_errors
from ..operators import governance, graph, lines, links, reports, rules, score, secrets

#: Severity with which findings are reported where it isn't a warning.
SEVERITY = {c: "error" for c in ("Z101", "Z102", "Z104", "Z105", "Z107", "Z108", "Z121", "Z124", "Z201", "Z202", "Z203", "Z204", "Z205", "Z301", "Z503", "Z506", "Z516", "Z613", "Z614", "Z616")} | {"Z106": "info", "Z123": "info", "Z401": "info"}


def _as(df: DataFrame, code: str, match: str = "''", line: str = "line_no", path: str = "doc_path") -> DataFrame:
    return df.select(F.expr(path).alias("doc_path"), F.expr(line).cast("int").alias("line_no"), F.lit(code).alias("code"), F.expr(match).cast("string").alias("match_text"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_links(docs: DataFrame, nav: DataFrame | None = None, assets: DataFrame | None = None) -> DataFrame:
    coded = lambda df: df.select("doc_path", "line_no", "code", F.col("url").alias("match_text"))
    parts = [
        coded(links.broken_links(docs, nav)), _as(links.missing_anchors(docs), "Z102", "url"), coded(links.path_findings(docs)), _as(links.circular_anchors(docs), "Z107", "url"),
        _as(links.empty_labels(docs), "Z108", "url"), links.html_findings(docs).select("doc_path", "line_no", "code", F.lit("").alias("match_text")),
    ]
    return _union(parts + ([_as(links.missing_files(docs, assets), "Z104", "url")] if assets is not None else []))


def check_references(docs: DataFrame) -> DataFrame:
    return _union([_as(links.dangling_references(docs), "Z301", "ref_id"), _as(links.dead_definitions(docs), "Z302", "ref_id"), _as(links.duplicate_definitions(docs), "Z303", "ref_id")])


def check_content(docs: DataFrame) -> DataFrame:
    return _union([
        _as(rules.placeholders(docs), "Z501", "match_text"), _as(rules.short_content(docs), "Z502", line="1"), _as(rules.untagged_code(docs), "Z505"), _as(rules.malformed_frontmatter(docs), "Z506"), _as(rules.heading_hierarchy(docs), "Z510"),
        _as(rules.long_sentences(docs), "Z511"), _as(rules.empty_sections(docs), "Z512"), _as(rules.duplicate_headings(docs), "Z513", "norm_title"), _as(rules.generic_alt(docs), "Z514", "alt"), _as(rules.bare_urls(docs), "Z515", "url"),
        _as(rules.multiple_h1(docs), "Z516"), _as(rules.heading_punctuation(docs), "Z517"), _as(rules.fake_lists(docs), "Z520"), _as(rules.missing_alt(docs), "Z403"),
        _as(secrets.secrets(docs), "Z201", "family"), _as(snippet_errors(lines.code_blocks(docs)), "Z503", line="fence_line"),
    ])


def check_topology(docs: DataFrame, nav: DataFrame | None = None, assets: DataFrame | None = None) -> DataFrame:
    """Findings on whole files and the graph of links: indexes, orphans, assets, pages out of reach, dead ends, cycles."""
    edges, sites = graph.written(links.edges(docs)), links.routes(docs, nav)
    home = docs.sparkSession.createDataFrame([("/",)], "url string")
    parts = [
        _as(links.missing_indexes(docs), "Z401", line="0", path="folder"), _as(graph.unreachable(sites, edges, home), "Z410", line="0", path="source"),
        _as(graph.dead_ends(sites, edges), "Z411", line="0", path="source"), _as(links.links_into_cycles(docs, edges), "Z106", "url"),
    ]
    if nav is not None:
        parts.append(_as(links.orphan_pages(docs, nav), "Z402", line="0", path="rel_path"))
    if assets is not None:
        parts.append(_as(links.unused_assets(docs, assets), "Z405", line="0", path="rel_path"))
    return _union(parts)


def check_all(docs: DataFrame, nav: DataFrame | None = None, assets: DataFrame | None = None, ignores: list | None = None, policies: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """(doc_path, line_no, code, ordinal, match_text, severity) of all findings that suppressions and ignores leave.

    Lines are split once and written; ``policies`` are further findings, as ``config.policy_findings`` gives them; ``only`` keeps codes.
    Directives that consume nothing are findings too (Z603).
    """
    docs = links.prepared(docs)
    parts = [check_links(docs, nav, assets), check_references(docs), check_content(docs), check_topology(docs, nav, assets)]
    found = _union(parts + ([policies.select("doc_path", "line_no", "code", "match_text")] if policies is not None else []))
    found = graph.written(found.withColumn("ordinal", F.row_number().over(W.partitionBy("doc_path", "line_no", "code").orderBy("match_text")) - 1))
    directives = graph.written(lines.suppressions(docs))
    dead = governance.dead_suppressions(found, directives).groupBy("doc_path", "line_no").count()
    dead = dead.select("doc_path", "line_no", F.lit("Z603").alias("code"), F.lit("").alias("match_text"), F.lit(0).alias("ordinal"))
    found = governance.per_file_ignores(governance.apply_suppressions(found, directives).unionByName(dead), ignores or [])
    severity = F.coalesce(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("code")], F.lit("warning"))
    return reports.only(found.withColumn("severity", severity), only)


def site_score(docs: DataFrame, nav: DataFrame | None = None, assets: DataFrame | None = None) -> DataFrame:
    """The score of everything that ``check_all`` finds, less a point for each directive."""
    n = lines.suppressions(docs).count()
    return score.total_score(score.findings_by_code(check_all(docs, nav, assets)), n)
