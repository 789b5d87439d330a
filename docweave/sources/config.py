"""Rule configuration: where it is found, how it is checked, and the policies that it switches on. Driver side: small files."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance, links, rules
from .trees import merged

#: Names of the files that hold a rule configuration of its own, and that mark a site's root, first ones first.
OWN_FILE, ROOT_MARKS = "docweave.toml", (".git", "docweave.toml", "mkdocs.yml", "package.json")
#: Site engines by the file that shows them, first ones first; without any, a plain folder.
ENGINES = (("prebuilt", "routes.json"), ("flat", "flat.toml"), ("folder", "mkdocs.yml"))


class ConfigError(ValueError):
    """A configuration that stops a check: ``code`` is Z000 for a missing root, Z001 for an unreadable configuration."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code

    def payload(self) -> str:
        return json.dumps({"error": {"code": self.code, "message": str(self)}})


@dataclass
class RuleConfig:
    """Settings with their defaults. Unknown keys are an error, so a misspelt policy can't be off without a word."""

    fail_under: int = 0
    strict: bool = False
    exclude: list = field(default_factory=list)
    include: list = field(default_factory=list)
    allowlist: list = field(default_factory=list)
    forbidden_terms: list = field(default_factory=list)
    per_file_ignores: dict = field(default_factory=dict)
    required_keys: list = field(default_factory=list)
    forbidden_keys: list = field(default_factory=list)
    key_schema: dict = field(default_factory=dict)
    allowed_domains: list = field(default_factory=list)
    forbidden_domains: list = field(default_factory=list)
    allowed_schemes: list = field(default_factory=list)
    namespaces: dict = field(default_factory=dict)
    required_headings: list = field(default_factory=list)
    forbidden_patterns: list = field(default_factory=list)
    max_complexity: int = 0
    weasel_words: list = field(default_factory=list)


def schema_errors(data: dict) -> list[str]:
    """What doesn't fit the settings: unknown keys, wrong types, and keys of the root that a table has swallowed."""
    known = {f.name: f for f in fields(RuleConfig)}
    out = []
    for k, v in data.items():
        if k not in known:
            inside = sorted(set(v) & set(known)) if isinstance(v, dict) else []
            out.append(f"{k}: keys of the root stand below a table: {', '.join(inside)}" if inside else f"{k}: unknown key")
            continue
        want = type(RuleConfig().__dict__[k])
        if not isinstance(v, want) or (want is int and isinstance(v, bool)):
            out.append(f"{k}: expected {want.__name__}, found {type(v).__name__}")
        elif isinstance(v, dict) and (inside := sorted(set(v) & set(known))):
            out.append(f"{k}: keys of the root stand below a table: {', '.join(inside)}")
    return out


def parse_config(text: str, kind: str = "own") -> tuple[RuleConfig, list[tuple[str, str]]]:
    """The configuration and its findings (code, message): Z110 where it doesn't parse, Z111 where it doesn't fit; what fits is used."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return RuleConfig(), [("Z110", str(e))]
    if kind == "pyproject":
        data = data.get("tool", {}).get("docweave", {})
    errors = schema_errors(data)
    bad = {e.split(":")[0] for e in errors}
    return RuleConfig(**{k: v for k, v in data.items() if k not in bad}), [("Z111", e) for e in errors]


def find_root(start: str, fallback: bool = False) -> str:
    """The nearest folder at or above ``start`` with a mark of a root; else ``start`` if that is allowed, else Z000."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if any((folder / m).exists() for m in ROOT_MARKS):
            return str(folder)
    if fallback:
        return str(here)
    raise ConfigError("Z000", f"no site root at or above {start}")


def load_config(root: str, local: dict | None = None) -> tuple[RuleConfig, list[tuple[str, str]]]:
    """The own file before the project file before defaults, with a local overlay merged in."""
    for name, kind in ((OWN_FILE, "own"), ("pyproject.toml", "pyproject")):
        at = Path(root) / name
        if at.exists():
            config, found = parse_config(at.read_text(encoding="utf-8"), kind)
            if kind == "own" or config != RuleConfig() or found:
                return (RuleConfig(**merged(config.__dict__, local)) if local else config), found
    return RuleConfig(**merged(RuleConfig().__dict__, local or {})), []


def discover_engine(root: str) -> str:
    return next((engine for engine, mark in ENGINES if (Path(root) / mark).exists()), "standalone")


def mount_prefix(content_root: str, site_root: str) -> str:
    """The URL prefix under which a further content root is mounted: its path within the site's root, else its name."""
    a, b = PurePosixPath(content_root), PurePosixPath(site_root)
    return a.relative_to(b).as_posix().removeprefix(".") if a.is_relative_to(b) else a.name


def locales_of(config: dict) -> tuple[str | None, list[str], bool]:
    """(default, others, fallback) of a site configuration's ``i18n``; a fallback without a default locale is an error."""
    i18n = config.get("i18n") or {}
    names = [(x["locale"], bool(x.get("default"))) if isinstance(x, dict) else (str(x), False) for x in i18n.get("languages", [])]
    default = next((n for n, d in names if d), None)
    fallback = bool(i18n.get("fallback_to_default"))
    if fallback and default is None:
        raise ConfigError("Z001", "i18n: a fallback needs a default locale")
    return default, [n for n, _ in names if n != default], fallback


def included_roots(config_of, start: str) -> list[str]:
    """Content roots of a site that includes others (``config_of(root)`` gives ``include_roots``), each once, however they include each other."""
    out, todo = [], [start]
    while todo:
        root = todo.pop(0)
        if root not in out:
            out.append(root)
            todo += [str(PurePosixPath(root, x)) for x in config_of(root).get("include_roots", [])]
    return out


def config_findings(spark: SparkSession, path: str, found: list[tuple[str, str]]) -> DataFrame:
    """Findings of a configuration as rows of the findings table."""
    return spark.createDataFrame([(path, 0, c, m) for c, m in found], "doc_path string, line_no int, code string, match_text string")


def policy_findings(docs: DataFrame, config: RuleConfig) -> DataFrame:
    """(doc_path, line_no, code, match_text) of every policy that the configuration switches on; what is off isn't built."""
    parts = []
    part = lambda df, code, match, line="0": parts.append(df.select("doc_path", F.expr(line).cast("int").alias("line_no"), F.lit(code).alias("code"), F.expr(match).cast("string").alias("match_text")))
    places = links.inline_links(docs)
    if config.required_keys:
        part(governance.required_keys(docs, config.required_keys), "Z610", "key")
    if config.forbidden_keys:
        part(governance.forbidden_keys(docs, config.forbidden_keys), "Z612", "key")
    if config.key_schema:
        part(governance.key_schema(docs, config.key_schema), "Z613", "key")
    if config.allowed_domains or config.forbidden_domains:
        hosts = governance.domain_policy(places, config.allowed_domains, config.forbidden_domains)
        parts.append(hosts.select("doc_path", "line_no", "code", F.col("host").alias("match_text")))
    if config.allowed_schemes:
        part(governance.scheme_policy(places, config.allowed_schemes), "Z615", "scheme", "line_no")
    if config.namespaces:
        part(governance.namespace_policy(docs, list(config.namespaces.items())), "Z616", "url", "line_no")
    if config.forbidden_patterns:
        part(rules.forbidden_content(docs, config.forbidden_patterns), "Z617", "match_text", "line_no")
    if config.required_headings:
        part(governance.required_headings(docs, config.required_headings), "Z618", "pattern")
    if config.max_complexity:
        part(rules.document_complexity(docs).where(F.col("complexity") > config.max_complexity), "Z619", "complexity")
    if config.weasel_words:
        part(rules.weasel_words(docs, config.weasel_words), "Z519", "match_text", "line_no")
    out = docs.sparkSession.createDataFrame([], "doc_path string, line_no int, code string, match_text string")
    for p in parts:
        out = out.unionByName(p)
    return out
