"""What prose rules must not see, over several lines: math, HTML blocks; sentences across lines; places by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import find_all, first_match, matches, replace_all, strip, word_count
from .lines import document_lines, frontmatter, prose_lines

#: Elements whose content is a block of HTML.
BLOCK_TAGS = "address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table ul".split()


def without_math(text: Column) -> Column:
    """The text with display math, of one line or more, and inline math blanked; line ends stay."""
    blocks = F.array_join(F.transform(F.split(text, r"\$\$"), lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, r"[^\n]", " ")).otherwise(x)), "  ")
    # an opened display that never closes is text
    odd = F.size(F.split(text, r"\$\$")) % 2 == 0
    return F.regexp_replace(F.when(odd, text).otherwise(blocks), r"\$[^$\n]+\$", " ")


def html_depth(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no, line, depth) of prose lines: how many block elements are open where the line begins, never below zero.

    The floor at zero is a running minimum: depth is the running sum of openings less closings, less the least that sum has been.
    """
    names = "|".join(BLOCK_TAGS)
    opened = F.size(find_all(F.col("line"), rf"(?i)<(?:{names})(?:\s[^>]*)?>"))
    closed = F.size(find_all(F.col("line"), rf"(?i)</(?:{names})\s*>"))
    upto = W.partitionBy("doc_path").orderBy("line_no")
    rows = prose_lines(docs).withColumn("step", opened - closed)
    rows = rows.withColumn("total", F.sum("step").over(upto.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("after", F.col("total") - F.least(F.lit(0), F.min("total").over(upto.rowsBetween(W.unboundedPreceding, W.currentRow))))
    return rows.select("doc_path", "line_no", "line", F.coalesce(F.lag("after").over(upto), F.lit(0)).cast("int").alias("depth"))


def outside_html(docs: DataFrame) -> DataFrame:
    """Prose lines that neither lie in a block of HTML nor hold one of its tags."""
    names = "|".join(BLOCK_TAGS)
    return html_depth(docs).where((F.col("depth") == 0) & ~matches(F.col("line"), rf"(?i)</?(?:{names})(?:\s[^>]*)?>")).select("doc_path", "line_no", "line")


def long_sentences_across_lines(docs: DataFrame, most: int = 40) -> DataFrame:
    """Z511: (doc_path, line_no, words) of sentences of more than ``most`` words; they run over lines until ``. ! ? ;``, and end at blank lines, headings, bullets, tables, quotes and HTML.

    Lines between breaks are islands of a running count; an island's lines are joined, cut at the marks, and each sentence keeps the line it begins in.
    """
    upto = W.partitionBy("doc_path").orderBy("line_no")
    line = strip("line")
    rows = outside_html(docs).select("doc_path", "line_no", line.alias("line"))
    gap = F.coalesce(F.col("line_no") - F.lag("line_no").over(upto) > 1, F.lit(True))
    rows = rows.withColumn("gap", gap).withColumn("breaks", (F.col("line") == "") | matches(F.col("line"), r"^(?:#{1,6}\s|[-*+]\s|[0-9]+[.)]\s|[|>])"))
    after = F.coalesce(F.lag("breaks").over(upto), F.lit(True))
    rows = rows.withColumn("island", F.sum((F.col("gap") | F.col("breaks") | after).cast("int")).over(upto)).where("line <> '' AND NOT startswith(line, '#') AND NOT startswith(line, '|')")
    # each line is marked where it begins, so sentences can tell
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(F.lit("\u0002"), x["line_no"].cast("string"), F.lit("\u0003"), x["line"])), " ")
    rows = rows.groupBy("doc_path", "island").agg(text.alias("text"))
    pieces = F.split(F.regexp_replace("text", r"([.!?;])(?=[\t\n\f\r ]|$)", "$1\u0001"), "\u0001")
    rows = rows.select("doc_path", "island", F.posexplode(pieces).alias("n", "sentence"))
    mark = "\u0002[0-9]+\u0003"
    before = F.last(F.when(F.col("sentence").rlike(mark), F.regexp_extract("sentence", "(?s).*\u0002([0-9]+)\u0003", 1)), ignorenulls=True).over(W.partitionBy("doc_path", "island").orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    own = F.when(F.regexp_like(F.col("sentence"), F.lit("^ ?\u0002")), F.regexp_extract("sentence", "\u0002([0-9]+)\u0003", 1))
    rows = rows.select("doc_path", F.coalesce(own, before).cast("int").alias("line_no"), word_count(F.regexp_replace("sentence", mark, "")).alias("words"))
    return rows.where(F.col("words") > most)


def first_content_line(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no) of the first line that is neither frontmatter, blank, a comment nor a heading; 1 where there is none."""
    rows = document_lines(docs).where("NOT in_frontmatter").where((strip(replace_all(F.col("line"), r"<!--.*?-->")) != "") & ~matches(strip("line"), r"^#{1,6}\s"))
    return docs.select("doc_path").join(rows.groupBy("doc_path").agg(F.min("line_no").alias("line_no")), "doc_path", "left").fillna(1, ["line_no"])


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_path, slug, draft, unlisted, tags) of frontmatter; tags from ``[a, b]`` or from a list of ``- a`` lines."""
    keys = frontmatter(docs).where("key IN ('slug', 'draft', 'unlisted', 'tags')").groupBy("doc_path").pivot("key", ["slug", "draft", "unlisted", "tags"]).agg(F.first("value"))
    w = W.partitionBy("doc_path").orderBy("line_no")
    rows = document_lines(docs).where("in_frontmatter")
    key = F.when(matches(F.col("line"), r"^[A-Za-z0-9_-]+\s*:"), first_match(F.col("line"), r"^([A-Za-z0-9_-]+)", 1))
    rows = rows.withColumn("key", F.last(key, ignorenulls=True).over(w)).where((F.col("key") == "tags") & matches(F.col("line"), r"^\s*-\s+\S"))
    listed = rows.groupBy("doc_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.btrim(first_match(x["line"], r"^\s*-\s+(.*)$", 1), F.lit(" \t'\""))).alias("listed"))
    inline = F.filter(F.transform(F.split(F.btrim("tags", F.lit("[] ")), ","), lambda x: F.btrim(x, F.lit(" \t'\""))), lambda x: x != "")
    yes = lambda c: F.coalesce(F.lower(c).isin("true", "yes", "on"), F.lit(False))
    out = docs.select("doc_path").join(keys, "doc_path", "left").join(listed, "doc_path", "left")
    return out.select("doc_path", "slug", yes("draft").alias("draft"), yes("unlisted").alias("unlisted"), F.coalesce("listed", F.when(F.coalesce("tags", F.lit("")) != "", inline), F.array().cast("array<string>")).alias("tags"))


def utf16_columns(findings: DataFrame) -> DataFrame:
    """Adds col_utf16: where match_text begins in its line (from 0) in UTF-16 units, as editors count; -1 where it isn't there."""
    before = F.when(F.instr("line", F.col("match_text")) > 0, F.substr("line", F.lit(1), F.instr("line", F.col("match_text")) - 1))
    wide = F.size(F.regexp_extract_all(before, F.lit(r"[^\x{0}-\x{FFFF}]"), F.lit(0)))
    return findings.withColumn("col_utf16", F.coalesce(F.length(before) + wide, F.lit(-1)))


def line_of(text: Column, at: Column) -> Column:
    """The number of the line that holds the character at a position from 0: line ends before it, and one."""
    return F.size(F.split(F.substr(text, F.lit(1), at), "\n"))
