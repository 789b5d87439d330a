"""Per-document Python functions, run in batches: snippet parsers, automatic fixes, and user rules.

These need parsers or sequential state that SQL can't express; each is a plain function of one document's text, wrapped
so that an error in one rule becomes a finding and the scan goes on.
"""

from __future__ import annotations

import ast
import json
import re
import textwrap
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

try:
    import yaml
except ImportError:  # YAML snippets are then not checked
    yaml = None

FINDING = "doc_path string, line_no int, code string, severity string, message string, match_text string"
_COLUMNS = [x.split()[0] for x in FINDING.split(", ")]


def parse_error(lang: str, snippet: str) -> str | None:
    """Why a code block doesn't parse, or None; languages that aren't checked never fail."""
    text = textwrap.dedent(snippet)
    try:
        if lang in ("python", "py"):
            ast.parse(text)
        elif lang == "json":
            json.loads(text)
        elif lang == "toml":
            tomllib.loads(text)
        elif lang in ("yaml", "yml") and yaml is not None:
            list(yaml.compose_all(text))
    except (SyntaxError, ValueError, tomllib.TOMLDecodeError) as e:
        return str(e).splitlines()[0][:200]
    except Exception as e:
        if yaml is not None and isinstance(e, yaml.YAMLError):
            return str(e).splitlines()[0][:200]
        raise
    return None


def snippet_errors(blocks: DataFrame) -> DataFrame:
    """Z503: (doc_path, fence_line, lang, error) of code blocks that don't parse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(error=[parse_error(x, s or "") for x, s in zip(b["lang"], b["snippet"])])
            yield b.loc[b["error"].notna(), ["doc_path", "fence_line", "lang", "error"]]

    return blocks.where("lang IN ('python', 'py', 'json', 'toml', 'yaml', 'yml')").mapInPandas(run, "doc_path string, fence_line int, lang string, error string")


# -- user rules ---------------------------------------------------------------------------


class Rule:
    """A user's rule: override what is needed. Codes carry the plugin's name, ``plugin:CODE``."""

    code, severity = "plugin:RULE", "warning"

    def visit_document(self, path: str, text: str) -> Iterator[tuple[int, str, str]]:
        return iter(())

    def visit_line(self, path: str, line_no: int, line: str) -> Iterator[tuple[int, str, str]]:
        return iter(())

    def check(self, path: str, text: str) -> Iterator[tuple[int, str, str]]:
        """(line_no, message, match_text) of each finding."""
        yield from self.visit_document(path, text)
        for n, line in enumerate(text.split("\n"), 1):
            yield from self.visit_line(path, n, line)


def validate_rules(rules: list[Rule]) -> None:
    """The contract of user rules, before any job runs: own codes, known severities, picklable."""
    for r in rules:
        if ":" not in r.code or re.fullmatch(r"Z\d{3}", r.code):
            raise ValueError(f"rule codes are <plugin>:<code>, not {r.code!r}")
        if r.severity not in ("error", "warning", "info"):
            raise ValueError(f"{r.code}: severity {r.severity!r} is kept for the engine")
        cloudpickle.dumps(r)


def run_rule(rule: Rule, text: str, path: str = "test.md") -> list[tuple[int, str, str]]:
    """A rule's findings on one text, for tests of rules."""
    return list(rule.check(path, text))


def user_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of user rules; a rule that raises gives one Z901 finding for the document and the others go on."""
    validate_rules(rules)

    def run(batches):
        for b in batches:
            out = []
            for path, text in zip(b["doc_path"], b["text"]):
                for r in rules:
                    try:
                        out += [(path, n, r.code, r.severity, m, x) for n, m, x in r.check(path, text or "")]
                    except Exception as e:
                        out.append((path, 0, "Z901", "warning", f"{r.code} failed: {type(e).__name__}: {e}", ""))
            yield pd.DataFrame(out, columns=_COLUMNS)

    return docs.select("doc_path", "text").mapInPandas(run, FINDING)


# -- fixes --------------------------------------------------------------------------------


def _outside_fences(text: str, fix: Callable[[str], str]) -> str:
    inside, out = False, []
    for line in text.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            inside = not inside
            out.append(line)
        else:
            out.append(line if inside else fix(line))
    return "\n".join(out)


def fix_empty_links(text: str) -> str:
    """Z108: a link without a label gets ``TODO``."""
    return _outside_fences(text, lambda x: re.sub(r"(?<!!)\[\s*\]\(", "[TODO](", x))


def fix_untagged_code(text: str) -> str:
    """Z505: a strict fence that opens without a language gets ``text``."""
    out, mark = [], None
    for line in text.split("\n"):
        m = re.match(r"(`{3,}|~{3,})(.*)$", line)
        if m and mark is None:
            mark = m[1]
            line = line if m[2].strip() else m[1] + "text"
        elif m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2].strip():
            mark = None
        out.append(line)
    return "\n".join(out)


def fix_bare_urls(text: str) -> str:
    """Z515: bare URLs are put in angle brackets; links, code, tags and definitions stay."""
    keep = r"`[^`]*`|!?\[[^\]]*\]\([^)]*\)|<[^>]*>|^\s*\[[^\]]+\]:.*$"

    def one(m):
        if m[0].startswith("http"):
            url = m[0].rstrip(".,;:!?")
            return f"<{url}>{m[0][len(url) :]}"
        return m[0]

    return _outside_fences(text, lambda x: re.sub(keep + r"|https?://[^\s<>`\"'\[\]()]+", one, x))


def fix_heading_punctuation(text: str) -> str:
    """Z517: one closing mark goes."""
    return _outside_fences(text, lambda x: re.sub(r"^(#{1,6}\s+.*[^.:;\s])[.:;](\s*(?:\{#[^}]*\})?\s*)$", r"\1\2", x))


def fix_dead_suppressions(text: str, dead: set[int], marker: str = "docweave") -> str:
    """Z603: directives on the given lines go."""
    lines = text.split("\n")
    for n in dead:
        lines[n - 1] = re.sub(rf"\s*(?:<!--|\{{/\*)\s*{marker}:ignore\s+Z\d{{3}}.*?(?:-->|\*/\}})", "", lines[n - 1])
    return "\n".join(lines)


def fix_fake_lists(text: str) -> str:
    """Z520: runs of three or more lines that end in ``;`` or ``,`` become lists, with a closing line that ends in a full stop."""
    lines, i = text.split("\n"), 0
    inside = False
    while i < len(lines):
        if re.match(r"\s*(```|~~~)", lines[i]):
            inside = not inside
        j = i
        while not inside and j < len(lines) and re.search(r"[;,]\s*$", lines[j]) and not re.match(r"\s*([#|]|[-*+]\s|\d+[.)]\s)", lines[j]):
            j += 1
        if j - i >= 3:
            j += j < len(lines) and lines[j].rstrip().endswith(".")
            lines[i:j] = ["- " + x.strip() for x in lines[i:j]]
        i = max(j, i + 1)
    return "\n".join(lines)


FIXES: dict[str, Callable[[str], str]] = {
    "Z108": fix_empty_links,
    "Z505": fix_untagged_code,
    "Z515": fix_bare_urls,
    "Z517": fix_heading_punctuation,
    "Z520": fix_fake_lists,
}


def autofix(docs: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """(doc_path, text, applied): documents after the fixes, in order, and which of them changed something. Fixing twice changes nothing more."""
    chosen = {c: f for c, f in FIXES.items() if codes is None or c in codes}

    def run(batches):
        for b in batches:
            texts, applied = [], []
            for text in b["text"]:
                done, text = [], text or ""
                for c, f in chosen.items():
                    if (new := f(text)) != text:
                        done.append(c)
                        text = new
                texts.append(text)
                applied.append(done)
            yield pd.DataFrame({"doc_path": b["doc_path"], "text": texts, "applied": applied})

    return docs.select("doc_path", "text").mapInPandas(run, "doc_path string, text string, applied array<string>")
