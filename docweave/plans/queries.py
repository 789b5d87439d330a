"""The registered queries of the document operators: each takes (spark, sf_dir) and returns a frame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import Rule, autofix, snippet_errors, user_rules
from ..operators import governance, graph, lines, links, masks, reports, routing, rules, score, secrets
from ..sources import config, sinks
from ..sources.shipping import ship
from .commands import check_all, site_score
from .corpus import ASSETS, site

#: Settings that the queries and their oracles share.
WEASEL = ["basically", "clearly", "obviously", "quite", "simply", "very"]
TERMS = ["OldBrand"]
IGNORES = [("orders/1*.md", ["Z501"]), ("*", ["Z515"]), ("blog/*", ["*"])]
NAMESPACES = [("orders/1", ["cust/1", "cust/2"]), ("orders/", ["cust/3"])]
ALLOWLIST = ["/home", "/unused/"]
SCHEMA = {"status": "^(open|done)$"}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as documents of the engine."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_path"), "text")


def assets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in ASSETS], "rel_path string")


def nav(docs: DataFrame) -> DataFrame:
    """The site's navigation: home, and customers whose number doesn't end in 7."""
    return docs.where(~F.regexp_like("doc_path", F.lit(r"^(cust/[0-9]*7\.md|orders/.*)$"))).select(F.col("doc_path").alias("rel_path"))


def on_site(f: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: f(site(spark, sf_dir), *args)


def on_parsed(f: Callable[..., DataFrame], raw: tuple[str, ...] | None = (), visible: tuple[str, ...] | None = ()) -> Query:
    """On the site, for what reads its lines several times: they are split once, all of them or those that hold a literal."""
    return lambda spark, sf_dir: f(links.prepared(site(spark, sf_dir), raw, visible))


#: Literals of the lines that rules of ``findings`` and directives look for.
RAW = ("#", "http://", "https://", *rules.PLACEHOLDER_WORDS, *TERMS, "docweave:ignore")
VISIBLE = ("](", "]:")
#: Literals of visible lines with references, and with links of all forms.
REFERENCES = ("][", "]:", "[")
ALL_FORMS = (*REFERENCES, "](", "<")


def on_findings(f: Callable[[DataFrame], DataFrame]) -> Query:
    """On the site, for what builds on ``findings``."""
    return on_parsed(f, RAW, VISIBLE)


def on_prose(f: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: f(prose(spark, sf_dir), *args)


def findings(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no, code, ordinal, match_text) of the rules that queries on findings build on."""
    part = lambda df, code, match="''", ordinal="0": df.select("doc_path", "line_no", F.lit(code).alias("code"), F.expr(ordinal).cast("int").alias("ordinal"), F.expr(match).cast("string").alias("match_text"))
    return (
        links.broken_links(docs, nav(docs).unionByName(docs.where("startswith(doc_path, 'orders/')").select(F.col("doc_path").alias("rel_path"))))
        .select("doc_path", "line_no", "code", F.lit(0).alias("ordinal"), F.col("url").alias("match_text"))
        .unionByName(part(rules.obsolete_terms(docs, TERMS), "Z601", "match_text", "ordinal"))
        .unionByName(part(rules.placeholders(docs), "Z501", "match_text", "CASE WHEN lower(match_text) = 'todo' THEN 0 ELSE 1 END"))
        .unionByName(part(rules.bare_urls(docs), "Z515", "url", "ordinal"))
        .unionByName(part(rules.multiple_h1(docs), "Z516"))
        .unionByName(part(links.duplicate_definitions(docs), "Z303", "ref_id"))
    )


def hygiene(docs: DataFrame) -> DataFrame:
    return score.findings_by_code(findings(docs))


QUERIES |= {
    "lines_explode": on_prose(lambda d: lines.document_lines(d).select(F.col("doc_path").cast("long").alias("doc_id"), "line_no", "line")),
    "fence_state": on_site(lambda d: lines.document_lines(d).select("doc_path", "line_no", "in_fence", "is_marker", "in_frontmatter")),
    "frontmatter_map": on_site(lines.frontmatter),
    "headings": on_site(lines.headings),
    "heading_slugs": on_site(links.heading_slugs),
    "heading_hierarchy": on_site(rules.heading_hierarchy),
    "duplicate_headings": on_site(rules.duplicate_headings),
    "multiple_h1": on_site(rules.multiple_h1),
    "heading_punctuation": on_site(rules.heading_punctuation),
    "empty_sections": on_site(rules.empty_sections),
    "word_counts": on_prose(rules.visible_word_counts),
    "short_content": on_prose(rules.short_content),
    "long_sentences": on_prose(rules.long_sentences),
    "passive_voice": on_prose(rules.passive_voice),
    "weasel_words": on_site(rules.weasel_words, WEASEL),
    "placeholders": on_site(rules.placeholders),
    "forbidden_content": on_prose(rules.forbidden_content, [r"password\S+", r"(?i)\brights\b"]),
    "custom_rule": on_site(rules.custom_rule, [("ZZ-PARCEL", r"\bparcel\b", "say box", "warning"), ("ZZ-NUM", r"[0-9]{3,}", "number", "info")]),
    "bare_urls": on_site(rules.bare_urls),
    "missing_alt": on_site(rules.missing_alt),
    "generic_alt": on_site(rules.generic_alt),
    "untagged_code": on_site(rules.untagged_code),
    "malformed_frontmatter": on_site(rules.malformed_frontmatter),
    "fake_lists": on_site(rules.fake_lists),
    "document_complexity": on_site(rules.document_complexity),
    "secret_scan": on_site(secrets.secrets),
    "obsolete_terms": on_site(rules.obsolete_terms, TERMS),
    "html_links": lambda spark, sf_dir: links.page_hrefs(table(spark, sf_dir, "pages")),
    "html_hygiene": on_site(links.html_findings),
    "inline_links": on_site(links.inline_links),
    "empty_labels": on_site(links.empty_labels),
    "circular_anchors": on_site(links.circular_anchors),
    "ref_definitions": on_site(links.ref_definitions),
    "ref_dangling": on_parsed(links.dangling_references, None, REFERENCES),
    "ref_dead": on_parsed(links.dead_definitions, None, REFERENCES),
    "ref_duplicate": on_site(links.duplicate_definitions),
    "ref_integrity": on_parsed(links.reference_integrity, None, REFERENCES),
    "anchors": on_site(links.anchors),
    "routes": on_site(lambda d: links.routes(d, nav(d))),
    "route_collisions": on_site(lambda d: links.routes(d.unionByName(d.where("doc_path = 'index.md'").withColumn("doc_path", F.lit("README.md")))).where("status = 'CONFLICT'")),
    "route_digest": on_site(lambda d: links.routes(d).groupBy("url").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources")).select("url", F.sha2(F.concat("url", F.lit(":"), "sources"), 256).alias("digest"))),
    "broken_links": on_site(links.broken_links),
    "orphan_links": on_site(lambda d: links.broken_links(d, nav(d)).where("code = 'Z103'")),
    "missing_anchors": on_parsed(links.missing_anchors, ("#",), ("](", "id=")),
    "missing_files": lambda spark, sf_dir: links.missing_files(site(spark, sf_dir), assets(spark)),
    "path_findings": on_site(links.path_findings),
    "unused_assets": lambda spark, sf_dir: links.unused_assets(site(spark, sf_dir), assets(spark)),
    "orphan_pages": on_site(lambda d: links.orphan_pages(d, nav(d))),
    "missing_indexes": on_site(links.missing_indexes),
    "edges": on_site(links.edges),
    "reachability": on_site(lambda d: graph.reachable(links.edges(d), d.sparkSession.createDataFrame([("/",)], "url string"))),
    "unreachable": on_site(lambda d: graph.unreachable(links.routes(d), links.edges(d), d.sparkSession.createDataFrame([("/",)], "url string")).select("url")),
    "dead_ends": on_site(lambda d: graph.dead_ends(links.routes(d), links.edges(d)).select("url")),
    "cycle_members": on_site(lambda d: graph.cycle_members(links.edges(d))),
    "cycle_links": on_parsed(links.links_into_cycles, None, ("](",)),
    "suppressions": on_site(lines.suppressions),
    "suppressions_applied": on_findings(lambda d: governance.apply_suppressions(findings(d), lines.suppressions(d))),
    "dead_suppressions": on_findings(lambda d: governance.dead_suppressions(findings(d), lines.suppressions(d))),
    "per_file_ignores": on_findings(lambda d: governance.per_file_ignores(findings(d), IGNORES)),
    "directory_policies": on_findings(lambda d: governance.directory_policies(findings(d), IGNORES, audit=True)),
    "stale_policies": on_findings(lambda d: governance.stale_policies(findings(d), IGNORES)),
    "required_keys": on_site(governance.required_keys, ["status", "title"]),
    "forbidden_keys": on_site(governance.forbidden_keys, ["internal"]),
    "key_schema": on_site(governance.key_schema, SCHEMA),
    "domain_policy": on_site(lambda d: governance.domain_policy(links.ref_definitions(d).select("doc_path", "line_no", "url"), ["example.com", "example.org"], ["other.example.org"])),
    "domain_allowlist": on_site(lambda d: governance.domain_policy(links.ref_definitions(d).select("doc_path", "line_no", "url"), ["example.com"], [])),
    "scheme_policy": on_site(lambda d: governance.scheme_policy(links.html_nodes(d).select("doc_path", "line_no", F.col("href").alias("url")), ["https"])),
    "namespace_policy": on_site(governance.namespace_policy, NAMESPACES),
    "required_headings": on_site(governance.required_headings, [r"(?i)^notes", r"^Second"]),
    "unused_allowlist": on_site(governance.unused_allowlist, ALLOWLIST),
    "findings_by_code": on_findings(hygiene),
    "category_scores": on_findings(lambda d: score.category_scores(hygiene(d))),
    "total_score": on_findings(lambda d: score.total_score(hygiene(d), 3)),
    "suppression_hotspots": on_site(lambda d: score.suppression_hotspots(lines.suppressions(d))),
    "baseline_signatures": on_findings(lambda d: governance.with_signatures(findings(d)).select("doc_path", "line_no", "ordinal", "code", "signature")),
    "baseline_diff": on_findings(lambda d: governance.baseline_diff(findings(d), governance.with_signatures(findings(d).where("endswith(doc_path, '1.md') OR endswith(doc_path, '2.md')")))),
}


class NoParcel(Rule):
    """A sample of a user's rule: a word that should not be used."""

    code = "house:NO-PARCEL"

    def visit_line(self, path, line_no, line):
        if "parcel" in line:
            yield line_no, "say box", "parcel"


LOCALES = ["de", "fr"]
POLICY = config.RuleConfig(required_keys=["status"], forbidden_keys=["internal"], key_schema=SCHEMA, allowed_schemes=["https"], namespaces=dict(NAMESPACES), required_headings=["^Second"], max_complexity=26, weasel_words=["very"])


def graded(docs: DataFrame) -> DataFrame:
    return findings(docs).withColumn("severity", F.when(F.col("code").isin("Z101", "Z516"), "error").when(F.col("code") == "Z515", "info").otherwise("warning"))


def localised(docs: DataFrame) -> DataFrame:
    """The customers' pages again, in two other locales, one as a folder and one as a suffix; one page exists in German only."""
    cust = docs.where("startswith(doc_path, 'cust/')")
    de = cust.select(F.concat(F.lit("de/"), "doc_path").alias("doc_path"), "text")
    fr = cust.select(F.regexp_replace("doc_path", r"\.md$", ".fr.md").alias("doc_path"), "text")
    extra = docs.where("doc_path = 'index.md'").select(F.lit("de/only.md").alias("doc_path"), "text")
    return docs.unionByName(de).unionByName(fr).unionByName(extra)


def values(spark: SparkSession, name: str, *rows: str) -> DataFrame:
    return spark.createDataFrame([(r,) for r in rows], f"{name} string")


QUERIES |= {
    "split_secrets": on_site(secrets.split_secrets),
    "forbidden_terms": on_site(secrets.forbidden_terms, ["packed BY hand", "key AKIA", "c++"]),
    "html_depth": on_prose(lambda d: masks.html_depth(d.withColumn("text", F.regexp_replace("text", "(?m) the ", "\n<div>x\n</p><section>y</div></div>\n"))).select("doc_path", "line_no", "depth")),
    "math_masked": on_prose(lambda d: d.select("doc_path", F.sha2(masks.without_math(F.replace("text", F.lit(" the "), F.lit("$$"))), 256).alias("digest"))),
    "sentences_across_lines": on_site(lambda d: masks.long_sentences_across_lines(d, 12)),
    "first_content_line": on_site(masks.first_content_line),
    "page_metadata": on_site(lambda d: masks.metadata(d.withColumn("text", F.regexp_replace("text", "title: Order ([0-9])", "slug: s-$1\ndraft: TRUE\ntags: [a$1, 'b']\ntitle: Order $1"))).select("doc_path", "slug", "draft", "unlisted", F.array_join("tags", "|").alias("tags"))),
    "utf16_columns": on_prose(lambda d: masks.utf16_columns(lines.document_lines(d.withColumn("text", F.concat(F.lit("\U0001F600x "), "text"))).select("doc_path", "line_no", "line", F.regexp_extract("line", "[a-z]+$", 0).alias("match_text")).where("match_text <> ''")).select("doc_path", "line_no", "col_utf16")),
    "flat_routes": on_site(lambda d: routing.engine_routes(d, "flat", nav(d))),
    "locale_routes": on_site(lambda d: routing.engine_routes(localised(d), "folder", nav(d), LOCALES)),
    "entry_points": on_site(lambda d: routing.entry_points(links.routes(d, nav(d)), True)),
    "broken_with_fallbacks": on_site(lambda d: routing.broken_links_under(localised(d).withColumn("text", F.replace("text", F.lit("1.md)"), F.lit("1.html)"))), links.routes(d), "folder", LOCALES)),
    "links_of_all_forms": on_parsed(routing.links_of_all_forms, None, ALL_FORMS),
    "broken_in_all_forms": on_parsed(lambda d: routing.broken_in_all_forms(d, links.routes(d)), None, ALL_FORMS),
    "missing_alternates": on_site(lambda d: routing.missing_alternates(values(d.sparkSession, "link", "/cust/1/", "cust/2", "/de/", "https://x.example/", "/"), links.routes(d))),
    "missing_declared": lambda spark, sf_dir: ship(spark) or routing.missing_declared(values(spark, "rel_path", "img/logo.png", "/img/favicon.ico", "https://x.example/a.css", "files/data.zip"), assets(spark)),
    "virtual_routes": on_site(lambda d: routing.virtual_routes(d, values(d.sparkSession, "doc_path", "tmp/note.md", "index.md"))),
    "topology_delta": on_site(lambda d: graph.topology_delta(graph.dead_ends(links.routes(d), links.edges(d)), graph.dead_ends(links.routes(d), links.edges(d).where("NOT startswith(src, '/cust/4')")))),
    "only_codes": on_findings(lambda d: reports.only(findings(d), ["Z516", "Z303"])),
    "shown_findings": on_findings(lambda d: reports.shown(graded(d)).groupBy("severity").count()),
    "quiet_counts": on_findings(lambda d: reports.quiet_counts(graded(d))),
    "file_reports": on_findings(lambda d: reports.file_reports(d, graded(d))),
    "finding_context": on_findings(lambda d: reports.with_context(d, findings(d).where("code = 'Z516'")).select("doc_path", "line_no", "context")),
    "section_counts": on_findings(lambda d: reports.section_counts(findings(d))),
    "section_lines": on_findings(lambda d: reports.section_lines(findings(d), findings(d).where("endswith(doc_path, '2.md')")).groupBy("section").agg(F.count("*").alias("n"), F.min("json").alias("first"))),
    "first_of_each": on_findings(lambda d: reports.first_of_each(findings(d))),
    "url_occurrences": on_site(lambda d: reports.without_prefixes(reports.url_occurrences(links.ref_definitions(d)), ["https://other."])),
    "outside_security": on_site(lambda d: reports.outside_security(links.ref_definitions(d).select("doc_path", "line_no", "url"), secrets.secrets(d).select("doc_path", F.lit("Z201").alias("code")))),
    "probe_fan_out": on_site(lambda d: reports.fan_out(links.ref_definitions(d), d.sparkSession.createDataFrame([("https://other.example.org/b", 404)], "url string, status int"))),
    "url_cache_reusable": lambda spark, sf_dir: reports.reusable(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("url"), F.when(F.col("o_orderkey") % 3 == 0, 404).otherwise(200).alias("status"), (F.col("o_orderkey") % 1000 * 100).alias("ts")), 100_000, 50_000),
    "cache_hit_rate": on_site(lambda d: reports.hit_rate(d, d.where("endswith(doc_path, '2.md')").select(F.sha2("text", 256).alias("content_hash")))),
    "stale_cache_paths": on_site(lambda d: reports.stale_paths(d.select("doc_path").unionByName(values(d.sparkSession, "doc_path", "gone.md")), d.where("NOT startswith(doc_path, 'cust/1')"))),
    "site_counts": lambda spark, sf_dir: reports.site_counts(site(spark, sf_dir), assets(spark)),
    "routes_snapshot": on_site(lambda d: reports.routes_digest(links.routes(d, nav(d)))),
    "score_snapshot": on_findings(lambda d: reports.snapshot(score.total_score(hygiene(d), 3), score.category_scores(hygiene(d)), "2024-01-01").select(F.get_json_object("json", "$.score").alias("score"), F.get_json_object("json", "$.categories[0].category").alias("first"))),
    "score_badge": on_findings(lambda d: reports.badge(score.total_score(hygiene(d), 3))),
    "audit_report": on_findings(lambda d: reports.audit(graded(d), lines.suppressions(d), IGNORES)),
    "cap_exceeded": on_site(lambda d: reports.cap_exceeded(lines.suppressions(d), 1)),
    "policy_findings": on_parsed(lambda d: config.policy_findings(d, POLICY)),
    "graph_rule": on_site(lambda d: routing.graph_rule(d, lambda l, r: l.join(r.where("url = '/'").select(F.col("source").alias("target")), "target").select("doc_path", "line_no", F.lit("house:HOME").alias("code"), F.col("url").alias("match_text")))),
}


# Queries that SQL can't express (parsers, user code, sequential rewrites); tests compare them with expected rows.
QUERIES |= {
    "snippet_errors": on_site(lambda d: snippet_errors(lines.code_blocks(d))),
    "autofix_preview": on_site(autofix),
    "user_rule": on_site(lambda d: user_rules(d, [NoParcel()])),
    "check_all": lambda spark, sf_dir: check_all(site(spark, sf_dir), nav(site(spark, sf_dir)), assets(spark), IGNORES),
    "site_score": lambda spark, sf_dir: site_score(site(spark, sf_dir), nav(site(spark, sf_dir)), assets(spark)),
    "sarif": on_findings(lambda d: sinks.sarif(findings(d).select("doc_path", "line_no", "code", F.lit("warning").alias("severity"), F.col("match_text").alias("message")))),
}
