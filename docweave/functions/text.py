"""Column functions on text: linear-time regex dialect, strips, paths, globs, slugs."""

from __future__ import annotations

import html
import re
import unicodedata
import urllib.parse

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII word boundary and white space as linear-time engines read them; the JVM's own are Unicode-aware.
_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_UNSUPPORTED = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]")
BLANKS = " \t\r\f\x0b"


def jvm_regex(pattern: str) -> str:
    """A pattern of the linear-time dialect, spelled so that the JVM's engine matches the same text.

    ``\\b`` and ``\\s`` become ASCII, ``.`` and ``$`` end lines at ``\\n`` only. Look-around and back references,
    which the dialect lacks, raise ValueError: so a user's pattern fails on the driver, before any job.
    """
    if _UNSUPPORTED.search(re.sub(r"\\\\", "", pattern)):
        raise ValueError(f"look-around and back references are not supported: {pattern!r}")
    re.compile(pattern)
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            out.append({"b": "\\b" if inside else _BOUNDARY, "s": "\\t\\n\\f\\r " if inside else "[\\t\\n\\f\\r ]", "S": "\\S" if inside else "[^\\t\\n\\f\\r ]"}.get(n, c + n))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(c)
        i += 1
    return "(?d)" + "".join(out)


def rx(pattern: str) -> Column:
    return F.lit(jvm_regex(pattern))


def matches(col: Column, pattern: str) -> Column:
    return F.regexp_like(col, rx(pattern))


def find_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, rx(pattern), F.lit(group))


def first_match(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(col, jvm_regex(pattern), group)


def replace_all(col: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(col, rx(pattern), F.lit(by))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def word_count(col: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.filter(F.split(col, "[\\t\\n\\x0B\\f\\r ]+"), lambda w: w != ""))


def normpath(path: Column) -> Column:
    """A relative POSIX path with ``.`` and ``..`` folded; leading ``..`` that escape are kept."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.array_append(acc, p)
        ),
    )
    return F.array_join(folded, "/")


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def _target(doc_path: str | None, url: str | None) -> str | None:
    if doc_path is None or url is None:
        return None
    path = re.split("[?#]", url, maxsplit=1)[0]
    if "%" in path and not re.search("%(?![0-9A-Fa-f]{2})", path):
        path = urllib.parse.unquote(path)
    if path == "":
        return doc_path
    base = "" if url.startswith("/") else doc_path.rpartition("/")[0]
    out: list[str] = []
    for x in (f"{base}/{path}" if base else path).split("/"):
        if x == ".." and out and out[-1] != "..":
            out.pop()
        elif x not in ("", "."):
            out.append(x)
    return "/".join(out)


@F.arrow_udf(T.StringType())
def link_target(doc_path: pa.Array, url: pa.Array) -> pa.Array:
    """The path within the site that a local URL on a page names: query and fragment cut, escapes decoded unless one is malformed, ``.`` and ``..`` folded.

    Built-in functions fold with lambdas, which the planner repeats in every filter on the path; this is computed once a link.
    """
    return pa.array(map(_target, doc_path.to_pylist(), url.to_pylist()), pa.string())


def glob_regex(glob: str) -> str:
    """A whole-string regex for a glob: ``*`` crosses folders, ``?`` is one character, ``[!x]`` negates."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        j = glob.find("]", i + 2) if c == "[" else -1
        if c == "[" and j > 0:
            body = glob[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = j
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def slug_ascii(title: Column) -> Column:
    """Slug of a heading by built-in functions: exact for ASCII titles. An explicit ``{#id}`` wins."""
    explicit = F.regexp_extract(title, r"\{#([^}\s]+)\}", 1)
    plain = F.regexp_replace(F.regexp_replace(title, r"\{[^}]*\}", ""), r"<[^>]+>", "")
    slug = F.regexp_replace(F.lower(plain), r"[^0-9a-z_\t\n\f\r -]", "")
    slug = F.regexp_replace(F.btrim(slug), r"[\t\n\f\r -]+", "-")
    return F.when(explicit != "", explicit).otherwise(F.btrim(slug, F.lit("-")))


@F.pandas_udf(T.StringType())
def slug_unicode(title: pd.Series) -> pd.Series:
    """Slug of a heading with compatibility decomposition, which no built-in function offers."""

    def one(t):
        if t is None:
            return None
        if m := re.search(r"\{#([^}\s]+)\}", t):
            return m[1]
        t = re.sub(r"<[^>]+>", "", re.sub(r"\{[^}]*\}", "", t))
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()
        return re.sub(r"[\s-]+", "-", re.sub(r"[^0-9a-z_\s-]", "", t).strip()).strip("-")

    return title.map(one)


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references decoded, all of them, which no built-in function does; for attribute values, which are few and short."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def signature(code: Column, path: Column, match: Column) -> Column:
    """Stable identity of a finding: line numbers don't matter."""
    return F.substring(F.sha2(F.concat_ws(":", F.upper(code), F.ltrim(path, F.lit("./")), match), 256), 1, 16)


def mask_secret(s: Column) -> Column:
    """Up to 8 characters all starred, else the first and last four stay."""
    n = F.length(s)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(s, 1, 4), F.repeat(F.lit("*"), n - 8), F.right(s, F.lit(4))))
