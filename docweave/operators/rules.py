"""Finding rules on headings, prose, images and code: each a function of documents that returns its findings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import linebytes
from ..functions.text import find_all, first_match, matches, replace_all, strip, word_count
from .lines import document_lines, headings, prose_lines

# Word lists and patterns that results depend on.
PASSIVE = r"(?i)\b(is|are|was|were|be|been|being)\s+([a-z]+(?:ed|en)|done|seen|made|found|built|written|read|set|put|known|taken|chosen|given|held|left|sent)\b"
PLACEHOLDER_WORDS = ["todo", "fixme", "wip", "tbd"]
PLACEHOLDERS = [rf"(?i)\b{w}\b" for w in PLACEHOLDER_WORDS]
GENERIC_ALT = ["image", "screenshot", "picture", "photo", "icon", "graphic", "logo", "img", "figure", "thumbnail", "untitled"]
GENERIC_ALT_OF = ["image of", "picture of", "photo of", "screenshot of", "graphic of", "icon of", "logo of", "thumbnail of", "figure of"]
BARE_URL = r"https?://[^\s<>`\"'\[\]\(\)]+"


def _per_doc(*order: str):
    return W.partitionBy("doc_path").orderBy(*order)


# -- headings -----------------------------------------------------------------------------


def heading_hierarchy(docs: DataFrame) -> DataFrame:
    """Z510: a level more than one below the heading before it."""
    rows = headings(docs).withColumn("previous", F.lag("level").over(_per_doc("line_no")))
    return rows.where("level > previous + 1").select("doc_path", "line_no", "level", "previous")


def empty_sections(docs: DataFrame) -> DataFrame:
    """Z512: a heading without a line of content before the next one or the end. Fences are content, comments aren't.

    A document's lines are at hand in the pass that splits them, so nothing is shuffled.
    """
    return docs.select(F.col("doc_path").cast("string"), F.col("text").cast("string")).mapInArrow(linebytes.empty_sections, "doc_path string, line_no int")


def duplicate_headings(docs: DataFrame) -> DataFrame:
    """Z513: the second and later heading of one wording in a document, with the first one's line."""
    w = W.partitionBy("doc_path", "norm_title").orderBy("line_no")
    rows = headings(docs).withColumn("rank", F.row_number().over(w)).withColumn("first_line", F.first("line_no").over(w))
    return rows.where("rank > 1").select("doc_path", "line_no", "norm_title", "first_line")


def multiple_h1(docs: DataFrame) -> DataFrame:
    """Z516: every first-level heading after a document's first."""
    rows = headings(docs).where("level = 1").withColumn("rank", F.row_number().over(_per_doc("line_no")))
    return rows.where("rank > 1").select("doc_path", "line_no", "rank")


def heading_punctuation(docs: DataFrame) -> DataFrame:
    """Z517: a heading that ends in ``. : ;``."""
    title = strip(replace_all(F.col("raw_title"), r"\{#[^}]*\}\s*$"))
    return headings(docs).withColumn("mark", F.right(title, F.lit(1))).where(F.col("mark").isin(".", ":", ";")).select("doc_path", "line_no", "mark")


# -- prose --------------------------------------------------------------------------------


def visible_word_counts(docs: DataFrame) -> DataFrame:
    """(doc_path, words): words outside of comments and frontmatter."""
    text = F.coalesce("text", F.lit(""))
    text = F.regexp_replace(text, r"(?s)\{/\*.*?\*/\}", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?s)\A---\n.*?\n---(\n|\z)", "")
    return docs.select("doc_path", word_count(text).alias("words"))


def short_content(docs: DataFrame, least: int = 50) -> DataFrame:
    """Z502: fewer visible words than ``least``; files whose name starts with ``_`` are left out."""
    return visible_word_counts(docs).where(F.col("words") < least).where(~F.regexp_like("doc_path", F.lit(r"(^|/)_[^/]*$")))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no, words) of the sentences within single lines; ``. ! ? ;`` end one before a blank or the line's end."""
    line = F.regexp_replace(strip("line"), r"([.!?;])[\t\n\f\r ]+", "$1\u0001")
    rows = prose_lines(docs).select("doc_path", "line_no", F.posexplode(F.split(line, "\u0001")).alias("ordinal", "sentence"))
    return rows.where("sentence <> ''").select("doc_path", "line_no", "ordinal", word_count(F.col("sentence")).alias("words"))


def long_sentences(docs: DataFrame, most: int = 40) -> DataFrame:
    """Z511 by lines: sentences of more than ``most`` words."""
    return sentences(docs).where(F.col("words") > most)


def pattern_findings(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_path, line_no, ordinal, match_text) of every match in prose, with code, tags, comments and links taken out."""
    line = F.col("line")
    for mask in (r"`[^`]+`", r"<!--.*?-->", r"<[^>]+>", r"!?\[[^\]]*\]\([^)]+\)"):
        line = replace_all(line, mask, " ")
    return prose_lines(docs).select("doc_path", "line_no", F.posexplode(find_all(line, pattern)).alias("ordinal", "match_text"))


def passive_voice(docs: DataFrame) -> DataFrame:
    """Z518."""
    return pattern_findings(docs, PASSIVE)


def weasel_words(docs: DataFrame, words: list[str]) -> DataFrame:
    """Z519: configured words, in any case, as whole words."""
    return pattern_findings(docs, r"(?i)\b(?:" + "|".join(re.escape(w) for w in sorted(words)) + r")\b")


def _each_pattern(lines: DataFrame, patterns: list[str], guard: Column | None = None) -> DataFrame:
    """The first match of each pattern in each line; the patterns are few and fixed, so they unfold into an array."""
    lines = lines if guard is None else lines.where(guard)
    found = F.filter(F.array(*[F.struct(F.lit(p).alias("pattern"), first_match(F.col("line"), p).alias("match_text")) for p in patterns]), lambda x: x["match_text"] != "")
    return lines.select("doc_path", "line_no", F.explode(found).alias("f")).select("doc_path", "line_no", "f.pattern", "f.match_text")


def _holds(words: list[str]) -> Column:
    """Lines that hold a word in some case: a cheap test before a pattern. Words beyond ASCII, whose case may depend on their place, aren't tested."""
    if not all(w.isascii() for w in words):
        return F.lit(True)
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower("line").contains(w.lower())
    return hit


def placeholders(docs: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Z501: one finding for each pattern and line (fences are left out, frontmatter isn't)."""
    rows = document_lines(docs, *([] if patterns else PLACEHOLDER_WORDS)).where("in_frontmatter OR (NOT in_fence AND NOT is_marker)")
    return _each_pattern(rows, patterns or PLACEHOLDERS, None if patterns else _holds(PLACEHOLDER_WORDS))


def forbidden_content(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """Z617: one finding for each pattern and prose line."""
    return _each_pattern(prose_lines(docs), patterns)


def custom_rule(docs: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """Declarative line rules (id, pattern, message, severity): the first match of each in every line, fences included.

    Ids start with ``ZZ-``; the patterns must be of the linear-time dialect. Both are checked before any job runs.
    """
    if bad := [r[0] for r in rules if not r[0].startswith("ZZ-")]:
        raise ValueError(f"custom rule ids must start with ZZ-: {bad}")
    rows = document_lines(docs)
    found = F.filter(
        F.array(*[F.struct(F.lit(i).alias("code"), F.lit(s).alias("severity"), F.lit(m).alias("message"), first_match(F.col("line"), p).alias("match_text")) for i, p, m, s in rules]), lambda x: x["match_text"] != ""
    )
    return rows.select("doc_path", "line_no", F.explode(found).alias("f")).select("doc_path", "line_no", "f.code", "f.severity", "f.message", "f.match_text")


def bare_urls(docs: DataFrame) -> DataFrame:
    """Z515: URLs in prose that are neither links, autolinks, code, attributes nor definitions."""
    line = F.col("line")
    for mask in (r"<!--.*?-->", r"<https?://[^>]+>", r"!?\[[^\]]*\]\([^)]+\)", r"`[^`]+`", r"<[^>]+>"):
        line = replace_all(line, mask, " ")
    rows = prose_lines(docs, "http://", "https://").where((F.col("line").contains("http://") | F.col("line").contains("https://")) & ~matches(F.col("line"), r"^\s*\[[^\]]+\]:\s*\S+"))
    rows = rows.select("doc_path", "line_no", F.posexplode(find_all(line, BARE_URL)).alias("ordinal", "raw"))
    return rows.select("doc_path", "line_no", "ordinal", F.rtrim("raw", F.lit(".,;:!?")).alias("url")).where("url <> ''")


def images(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no, ordinal, alt, in_fence) of Markdown images, fenced ones too."""
    rows = document_lines(docs, "![").where(F.col("line").contains("![") & ~F.col("in_frontmatter"))
    return rows.select("doc_path", "line_no", "in_fence", F.posexplode(find_all(F.col("line"), r"!\[([^\]]*)\]\([^)]*\)", 1)).alias("ordinal", "alt"))


def missing_alt(docs: DataFrame) -> DataFrame:
    """Z403: images, wherever they stand, without alternative text."""
    md = images(docs).where(strip("alt") == "").select("doc_path", "line_no")
    rows = document_lines(docs, "<img").where(F.lower("line").contains("<img"))
    tags = rows.select("doc_path", "line_no", F.explode(find_all(F.col("line"), r"(?i)<img\b[^>]*>")).alias("tag"))
    html = tags.where(strip(first_match(F.col("tag"), r"(?i)\salt\s*=\s*[\"']([^\"']*)[\"']", 1)) == "").select("doc_path", "line_no")
    return md.unionByName(html)


#: One of the generic words, alone or with a number, or a text that begins like ``image of``, within stray marks.
GENERIC = rf"(?i)^[\s_.:-]*(?:(?:{'|'.join(GENERIC_ALT)})(?:\s+[0-9]+)?[\s_.:-]*$|(?:{'|'.join(GENERIC_ALT_OF)}))"


def is_generic_alt(alt: Column) -> Column:
    return matches(alt, GENERIC)


def generic_alt(docs: DataFrame) -> DataFrame:
    """Z514: alternative text that says nothing."""
    return images(docs).where(~F.col("in_fence") & is_generic_alt(F.col("alt"))).select("doc_path", "line_no", "alt")


def untagged_code(docs: DataFrame) -> DataFrame:
    """Z505: strict fences that open without a language."""
    rows = document_lines(docs, "```", "~~~").where("fence_kind = 'open'")
    return rows.where(strip(F.regexp_replace("line", r"^(`{3,}|~{3,})", "")) == "").select("doc_path", "line_no")


def malformed_frontmatter(docs: DataFrame) -> DataFrame:
    """Z506: a first line that starts like a frontmatter mark but isn't one."""
    first = F.rtrim(F.substring_index(F.col("text"), "\n", 1))
    return docs.where(F.startswith(first, F.lit("--")) & (first != "---")).select("doc_path", F.lit(1).alias("line_no"), first.alias("line"))


def fake_lists(docs: DataFrame) -> DataFrame:
    """Z520 as runs: three or more lines in a row that end in ``;`` or ``,`` (islands by difference of counters)."""
    line = strip("line")
    rows = prose_lines(docs, ";", ",").where(F.endswith(line, F.lit(";")) | F.endswith(line, F.lit(",")))
    rows = rows.where(~matches(line, r"^(?:[#|]|[-*+]\s|[0-9]+[.)]\s)") & ~F.regexp_like(line, F.lit(r"(?i)^(and|or|but|nor)\b")))
    rows = rows.withColumn("island", F.col("line_no") - F.row_number().over(_per_doc("line_no")))
    return rows.groupBy("doc_path", "island").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n_lines")).where("n_lines >= 3").select("doc_path", "line_no", "n_lines")


def document_complexity(docs: DataFrame) -> DataFrame:
    """(doc_path, words, n_headings, max_depth, n_links, complexity): words // 50 + 2 headings + 3 depth + 2 links."""
    rows = prose_lines(docs).select(
        "doc_path",
        F.when(matches(strip("line"), r"^#{1,6}\s+.+$"), F.length(first_match(strip("line"), r"^(#{1,6})", 1))).alias("level"),
        F.when(F.startswith(strip("line"), F.lit("#")), 0).otherwise(word_count(F.col("line"))).alias("words"),
        F.size(find_all(F.col("line"), r"\[[^\]]*\]\([^)]+\)")).alias("links"),
    )
    per = rows.groupBy("doc_path").agg(F.sum("words").alias("words"), F.count("level").alias("n_headings"), F.greatest(F.max("level"), F.lit(1)).alias("max_depth"), F.sum("links").alias("n_links"))
    return per.withColumn("complexity", F.floor(F.col("words") / 50) + 2 * F.col("n_headings") + 3 * F.col("max_depth") + 2 * F.col("n_links"))


def obsolete_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Z601: obsolete brand terms as whole words in any case, outside of strict fences (the opening line is read)."""
    rows = document_lines(docs, *terms).where("fence_kind IS NULL OR fence_kind = 'open'").where(_holds(terms))
    pattern = r"(?i)\b(?:" + "|".join(re.escape(t) for t in sorted(terms)) + r")\b"
    return rows.select("doc_path", "line_no", F.posexplode(find_all(F.col("line"), pattern)).alias("ordinal", "match_text"))
