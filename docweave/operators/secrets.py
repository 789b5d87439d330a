"""Credentials and forbidden terms: families on raw, normalised and joined lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import first_match, matches, replace_all
from .lines import document_lines
from .links import ref_definitions

#: Family, literal that must occur, pattern.
SECRET_FAMILIES = [
    ("openai-api-key", "sk-", r"sk-[A-Za-z0-9]{48}"),
    ("github-token", "gh", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("gitlab-pat", "glpat-", r"glpat-[A-Za-z0-9_-]{20,}"),
    ("aws-access-key", "AKIA", r"AKIA[0-9A-Z]{16}"),
    ("stripe-live-key", "sk_live_", r"sk_live_[0-9A-Za-z]{24}"),
    ("slack-token", "xox", r"xox[baprs]-[0-9A-Za-z-]{10,48}"),
    ("google-api-key", "AIza", r"AIza[0-9A-Za-z_-]{35}"),
    ("private-key", "-----BEGIN", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("hex-encoded-payload", "\\x", r"(?:\\x[0-9a-fA-F]{2}){3,}"),
]
#: Format characters that don't show (soft hyphen, zero-width and direction marks, byte-order mark).
_UNSEEN = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


def normalised(line: Column) -> Column:
    """A line without what splits a credential for the eye only: unseen characters, comments, code marks, quotes joined by ``+``, table bars."""
    line = F.translate(line, _UNSEEN, "")
    line = replace_all(line, r"<!--.*?-->|/\*.*?\*/")
    line = F.replace(F.replace(F.replace(line, F.lit("&#45;"), F.lit("-")), F.lit("&#95;"), F.lit("_")), F.lit("&amp;"), F.lit("&"))
    line = replace_all(line, r"[\"'`]?\s*\+\s*[\"'`]")
    return F.replace(F.translate(line, "`", ""), F.lit("|"), F.lit(" "))


#: What a line that is worth a look holds: a family's literal, or anything that the normaliser takes out.
_WORTH = [*[g for _, g, _ in SECRET_FAMILIES], "+", "`", "|", "&", *_UNSEEN, "<!--", "/*"]


def _worth_a_look(line: Column) -> Column:
    """Lines with a family's literal, or with anything that the normaliser takes out: one search a line, so regexes of families see few."""
    return F.regexp_like(line, F.lit("|".join([re.escape(g) for _, g, _ in SECRET_FAMILIES] + [r"[+`|&" + _UNSEEN + "]", "<!--", r"/\*"])))


def _families(line: Column) -> Column:
    """(family, match_text) of the families that a line holds; the literal part guards the regex."""
    found = [F.struct(F.lit(n).alias("family"), F.when(F.contains(line, F.lit(guard)), first_match(line, p)).otherwise("").alias("match_text")) for n, guard, p in SECRET_FAMILIES]
    return F.filter(F.array(*found), lambda x: x["match_text"] != "")


def secrets(docs: DataFrame) -> DataFrame:
    """Z201: (doc_path, line_no, family, match_text) on every raw line, fenced and frontmatter too: one finding for each family and line, in the line as it is or normalised."""
    raw, clean = _families(F.col("line")), _families(normalised(F.col("line")))
    more = F.filter(clean, lambda x: ~F.array_contains(F.transform(raw, lambda y: y["family"]), x["family"]))
    return document_lines(docs, *_WORTH).where(_worth_a_look(F.col("line"))).select("doc_path", "line_no", F.explode(F.concat(raw, more)).alias("f")).select("doc_path", "line_no", "f.family", "f.match_text")


def split_secrets(docs: DataFrame) -> DataFrame:
    """Credentials that only a line joined with the one before shows: (doc_path, line_no of the second, family, match_text)."""
    w = W.partitionBy("doc_path").orderBy("line_no")
    end = F.rtrim("line", F.lit(" \t\\\\+\"'"))
    rows = document_lines(docs).select("doc_path", "line_no", "line", F.lag(end).over(w).alias("before")).where("before IS NOT NULL")
    both = F.concat("before", F.ltrim("line", F.lit(" \t+\"'")))
    own = F.transform(F.concat(_families(F.col("line")), _families(F.col("before"))), lambda y: y["family"])
    return rows.select("doc_path", "line_no", F.explode(F.filter(_families(both), lambda x: ~F.array_contains(own, x["family"]))).alias("f")).select("doc_path", "line_no", "f.family", "f.match_text")


def definition_secrets(docs: DataFrame) -> DataFrame:
    """Z201 in URLs of reference definitions, on lines that show none as they are."""
    rows = ref_definitions(docs).select("doc_path", "line_no", F.explode(_families(F.col("url"))).alias("f")).select("doc_path", "line_no", "f.family", "f.match_text")
    return rows.join(secrets(docs).select("doc_path", "line_no").distinct(), ["doc_path", "line_no"], "left_anti")


def forbidden_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Z204: (doc_path, line_no, match_text) of the first literal term, in any case, in each line that holds no credential."""
    pattern = "(?i)(?:" + "|".join(re.escape(t) for t in sorted(terms)) + ")"
    rows = document_lines(docs, *terms).where(matches(F.col("line"), pattern) & (F.size(_families(F.col("line"))) == 0))
    return rows.select("doc_path", "line_no", first_match(F.col("line"), pattern).alias("match_text"))
