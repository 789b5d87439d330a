"""Suppressions, ignores, policies and baselines: which findings count, and which settings are stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import glob_regex, matches, signature
from .lines import frontmatter, headings
from .links import inline_links, resolve

#: Codes that no directive and no policy can switch off.
NON_SUPPRESSIBLE = ["Z110", "Z111", "Z201", "Z202", "Z203", "Z204", "Z205"]


def _paired(findings: DataFrame, directives: DataFrame) -> tuple[DataFrame, DataFrame]:
    key = ["doc_path", "line_no", "code"]
    f = findings.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy("ordinal")))
    d = directives.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy("ordinal")))
    return f, d


def apply_suppressions(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings (doc_path, line_no, code, ordinal, ...) that no directive of their line and code consumes; one directive consumes one finding."""
    f, d = _paired(findings, directives.where(~F.col("code").isin(NON_SUPPRESSIBLE)))
    return f.join(d.select("doc_path", "line_no", "code", "rn"), ["doc_path", "line_no", "code", "rn"], "left_anti").select(*findings.columns)


def dead_suppressions(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Z603: directives that consumed nothing."""
    f, d = _paired(findings, directives)
    return d.join(f.select("doc_path", "line_no", "code", "rn"), ["doc_path", "line_no", "code", "rn"], "left_anti").select("doc_path", "line_no", "code", "ordinal")


def _glob_hit(path: Column, code: Column, rules: list[tuple[str, list[str]]]) -> list[Column]:
    """For each rule (glob, codes) whether it takes a finding; ``*`` among codes takes all. Rules are few and folded into the plan."""
    return [F.regexp_like(path, F.lit(glob_regex(g))) & (F.lit("*" in codes) | code.isin(codes)) for g, codes in rules]


def per_file_ignores(findings: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Findings that no (glob, codes) rule drops; security codes are exempt."""
    hit = F.lit(False)
    for h in _glob_hit(F.col("doc_path"), F.col("code"), rules):
        hit = hit | h
    return findings.where(~hit | F.col("code").isin(NON_SUPPRESSIBLE))


def directory_policies(findings: DataFrame, rules: list[tuple[str, list[str]]], audit: bool = False) -> DataFrame:
    """As ``per_file_ignores``; in audit mode findings stay and their policy (number from 0, else null) is told."""
    policy = F.lit(None).cast("int")
    for n, h in reversed(list(enumerate(_glob_hit(F.col("doc_path"), F.col("code"), rules)))):
        policy = F.when(h & ~F.col("code").isin(NON_SUPPRESSIBLE), n).otherwise(policy)
    out = findings.withColumn("policy", policy)
    return out if audit else out.where("policy IS NULL").drop("policy")


def stale_policies(findings: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Z620: (policy, glob) of rules that took no finding: one aggregate over the findings, whatever their number."""
    used = [F.coalesce(F.max(h), F.lit(False)).alias(f"u{n}") for n, h in enumerate(_glob_hit(F.col("doc_path"), F.col("code"), rules))]
    one = findings.agg(*used)
    rows = F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(g).alias("glob"), F.col(f"u{n}").alias("used")) for n, (g, _) in enumerate(rules)])
    return one.select(F.explode(rows).alias("r")).where("NOT r.used").select("r.policy", "r.glob")


# -- frontmatter, domain and namespace policies -----------------------------------------


def _keys(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def required_keys(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Z610: (doc_path, key) of required frontmatter keys that a document lacks."""
    have = frontmatter(docs).groupBy("doc_path").agg(F.collect_set("key").alias("have"))
    rows = docs.select("doc_path").join(have, "doc_path", "left")
    lacking = F.array_except(F.array(*[F.lit(k) for k in sorted(keys)]), F.coalesce("have", F.array().cast("array<string>")))
    return rows.select("doc_path", F.explode(lacking).alias("key"))


def forbidden_keys(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Z612."""
    return frontmatter(docs).where(F.col("key").isin(keys)).select("doc_path", "key")


def key_schema(docs: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Z613: (doc_path, key, value) whose value the key's regex isn't found in."""
    bad = F.lit(False)
    for k, p in schema.items():
        bad = bad | ((F.col("key") == k) & ~matches(F.col("value"), p))
    return frontmatter(docs).where(bad).select("doc_path", "key", "value")


def _hosts(links: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return links.withColumn("host", host).where("host <> ''")


def _under(host: Column, domains: list[str]) -> Column:
    hit = F.lit(False)
    for d in domains:
        hit = hit | (host == d.lower()) | F.endswith(host, F.lit("." + d.lower()))
    return hit


def domain_policy(links: DataFrame, allowed: list[str], forbidden: list[str]) -> DataFrame:
    """Adds code: Z614 for hosts under no allowed domain (checked first, if any are given), Z611 for those under a forbidden one."""
    code = F.when(~_under(F.col("host"), allowed), "Z614") if allowed else F.when(F.lit(False), "")
    code = code.when(_under(F.col("host"), forbidden), "Z611")
    return _hosts(links).withColumn("code", code).where("code IS NOT NULL")


def scheme_policy(links: DataFrame, schemes: list[str]) -> DataFrame:
    """Z615: links with a scheme outside of ``schemes``; javascript: and data: are left to Z205."""
    scheme = F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return links.withColumn("scheme", scheme).where((F.col("scheme") != "") & ~F.col("scheme").isin([*schemes, "javascript", "data"]))


def namespace_policy(docs: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Z616: links from pages under a source prefix to targets under one of its forbidden prefixes; the first source prefix that fits counts."""
    forbidden = F.array().cast("array<string>")
    for source, targets in reversed(rules):
        forbidden = F.when(F.startswith("doc_path", F.lit(source)), F.array(*[F.lit(t) for t in targets])).otherwise(forbidden)
    rows = resolve(inline_links(docs)).where("outcome = 'ok'").withColumn("hit", F.filter(forbidden, lambda t: F.startswith("target", t)))
    return rows.where(F.size("hit") > 0).select("doc_path", "line_no", "url", F.get("hit", F.lit(0)).alias("namespace"))


def required_headings(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """Z618: (doc_path, pattern) of patterns that none of a document's headings holds."""
    found = headings(docs).groupBy("doc_path").agg(*[F.max(matches(F.col("raw_title"), p)).alias(f"h{n}") for n, p in enumerate(patterns)])
    rows = docs.select("doc_path").join(found, "doc_path", "left")
    lacking = F.filter(F.array(*[F.when(~F.coalesce(F.col(f"h{n}"), F.lit(False)), F.lit(p)) for n, p in enumerate(patterns)]), lambda x: x.isNotNull())
    return rows.select("doc_path", F.explode(lacking).alias("pattern"))


def unused_allowlist(docs: DataFrame, prefixes: list[str]) -> DataFrame:
    """Z110 (stale): prefixes that no absolute link starts with."""
    one = inline_links(docs).where("startswith(url, '/')").agg(*[F.coalesce(F.max(F.startswith("url", F.lit(p))), F.lit(False)).alias(f"u{n}") for n, p in enumerate(prefixes)])
    rows = F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"u{n}").alias("used")) for n, p in enumerate(prefixes)])
    return one.select(F.explode(rows).alias("r")).where("NOT r.used").select("r.prefix")


# -- exclusion --------------------------------------------------------------------------


def excluded(path: Column, system: list[str], include: list[str], exclude: list[str], ignored: list[str]) -> Column:
    """Layered exclusion of a file by the first layer that speaks: system folders, forced includes, excludes, ignore globs."""
    folders = F.split(path, "/")
    any_glob = lambda globs: F.lit(False) if not globs else F.regexp_like(path, F.lit("|".join(f"(?:{glob_regex(g)})" for g in globs)))
    return F.when(F.arrays_overlap(folders, F.array(*[F.lit(s) for s in system])), True).when(any_glob(include), False).when(any_glob(exclude), True).otherwise(any_glob(ignored))


# -- baselines ----------------------------------------------------------------------------


def with_signatures(findings: DataFrame) -> DataFrame:
    return findings.withColumn("signature", signature(F.col("code"), F.col("doc_path"), F.col("match_text")))


def baseline_diff(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: baselined, new and fixed findings against a table of signatures."""
    known = baseline.select("signature").distinct().withColumn("known", F.lit(True))
    joined = with_signatures(findings).join(known, "signature", "left")
    n = baseline.select("signature").distinct().agg(F.count("*").alias("n_base"))
    per = joined.agg(F.count(F.when(F.col("known"), 1)).alias("baselined"), F.count(F.when(F.col("known").isNull(), 1)).alias("new"), F.countDistinct(F.when(F.col("known"), F.col("signature"))).alias("matched"))
    return per.crossJoin(n).select("baselined", "new", F.greatest(F.col("n_base") - F.col("matched"), F.lit(0)).alias("fixed"))
