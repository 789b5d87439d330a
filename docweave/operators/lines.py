"""Lines of documents and their state (fence, frontmatter), without a shuffle: a scan and one pass over its buffers, whatever the number of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linebytes import SCHEMA, lines_of
from ..functions.text import find_all, first_match, matches, replace_all, strip
from .graph import written

HEADING = r"^(#{1,6})\s+(.+)$"


def line_pass(docs: DataFrame, literals: tuple[str, ...], visible: bool = False) -> DataFrame:
    """One pass over the texts: see ``linebytes.lines_of``."""
    return docs.select(F.col("doc_path").cast("string"), F.col("text").cast("string")).mapInArrow(lines_of(() if "" in literals else literals, visible), SCHEMA)


def prepared_for(have: tuple[DataFrame, tuple[str, ...]] | None, literals: tuple[str, ...]) -> DataFrame | None:
    """The table of a pass that has been written, if it holds all lines with ``literals``."""
    if have is not None and (not have[1] or (literals and set(literals) <= set(have[1]))):
        return have[0]
    return None


def prepared(docs: DataFrame, *literals: str) -> DataFrame:
    """``docs`` whose lines are split and told apart once, and written: all rules on the frame returned read that table.

    With ``literals`` only lines that hold one of them are written, and rules that look for others pass over the texts themselves.
    """
    out = docs.select("doc_path", "text")
    out._docweave_lines = (written(document_lines(docs, *literals)), literals)
    return out


def document_lines(docs: DataFrame, *literals: str) -> DataFrame:
    """(doc_path, line_no, line, in_fence, is_marker, in_frontmatter, fence_kind) of every line; with ``literals`` of those that
    hold one of them in any case, and maybe of others: a rule that can't match other lines still looks for itself.

    in_fence and is_marker follow the simple rule: every line that starts, after blanks, with three backticks or tildes
    toggles. fence_kind follows the strict rule (``open``, ``close``, ``in`` or null): a fence opens at column 0 and is closed
    only by the same character, at least as long, with nothing after it. in_frontmatter: from a first line ``---`` to
    the next, both included; fences within don't count for in_fence.
    """
    lines = prepared_for(getattr(docs, "_docweave_lines", None), literals)
    return line_pass(docs, literals) if lines is None else lines


def prose_lines(docs: DataFrame, *literals: str) -> DataFrame:
    """Lines that prose rules see: neither frontmatter nor fenced nor fence markers."""
    return document_lines(docs, *literals).where(~F.col("in_frontmatter") & ~F.col("in_fence") & ~F.col("is_marker")).select("doc_path", "line_no", "line")


def headings(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no, level, raw_title, norm_title) of ATX headings in prose."""
    lines = prose_lines(docs, "#").where(F.col("line").contains("#") & matches(strip(F.col("line")), HEADING))
    line = strip(F.col("line"))
    title = strip(first_match(line, HEADING, 2))
    clean = strip(replace_all(title, r"\{#[^}]*\}\s*$"))
    return lines.select("doc_path", "line_no", F.length(first_match(line, HEADING, 1)).alias("level"), title.alias("raw_title"), F.lower(F.regexp_replace(clean, r"[\t\n\f\r ]+", " ")).alias("norm_title"))


def frontmatter(docs: DataFrame) -> DataFrame:
    """(doc_path, key, value) of top-level frontmatter lines; of a repeated key the last counts."""
    rows = document_lines(docs).where("in_frontmatter AND line_no > 1").where(matches(F.col("line"), r"^[A-Za-z0-9_-]+\s*:"))
    rows = rows.select("doc_path", "line_no", first_match(F.col("line"), r"^([A-Za-z0-9_-]+)\s*:", 1).alias("key"), F.btrim(strip(first_match(F.col("line"), r"^[A-Za-z0-9_-]+\s*:(.*)$", 1)), F.lit("'\"")).alias("value"))
    return rows.groupBy("doc_path", "key").agg(F.max_by("value", "line_no").alias("value"))


def code_blocks(docs: DataFrame) -> DataFrame:
    """(doc_path, lang, snippet, fence_line) of strict fences, from one pass over each document's own lines."""
    rows = document_lines(docs).where("fence_kind IS NOT NULL AND fence_kind <> 'close'")
    opener = F.when(F.col("fence_kind") == "open", F.col("line_no"))
    from pyspark.sql import Window as W

    rows = rows.withColumn("fence_line", F.last(opener, ignorenulls=True).over(W.partitionBy("doc_path").orderBy("line_no")))
    body = F.array_sort(F.collect_list(F.when(F.col("fence_kind") == "in", F.struct("line_no", "line"))))
    return rows.groupBy("doc_path", "fence_line").agg(
        F.lower(F.max(F.when(F.col("fence_kind") == "open", first_match(F.col("line"), r"^(?:`{3,}|~{3,})\s*([A-Za-z0-9_+-]*)", 1)))).alias("lang"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("snippet")
    )


def suppressions(docs: DataFrame, marker: str = "docweave") -> DataFrame:
    """(doc_path, line_no, code, ordinal) of directives ``<!-- marker:ignore Z123 -->`` outside of strict fences and inline code."""
    pattern = rf"(?:<!--|\{{/\*)\s*{marker}:ignore\s+(Z[0-9]{{3}})\b"
    rows = document_lines(docs, f"{marker}:ignore").where("fence_kind IS NULL").where(F.col("line").contains(f"{marker}:ignore"))
    rows = rows.select("doc_path", "line_no", F.posexplode(find_all(replace_all(F.col("line"), r"`[^`]+`"), pattern, 1)).alias("ordinal", "code"))
    return rows.select("doc_path", "line_no", "code", "ordinal")
