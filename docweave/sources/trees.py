"""Sources: document trees, assets, overlays, locales; and the configuration files around them."""

from __future__ import annotations

import fnmatch
import json
import tomllib
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex

try:
    import yaml
except ImportError:  # YAML site configurations can't be read then
    yaml = None

DOC_SUFFIXES = (".md", ".mdx")


def relative(path, root: str):
    """The part of a file URI below ``root``."""
    tail = PurePosixPath(root).as_posix().rstrip("/") + "/"
    return F.url_decode(F.replace(F.substring_index(path, tail, -1), F.lit("+"), F.lit("%2B")))


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """(doc_path, text) of the Markdown files below a folder, in any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,mdx}").load(root)
    return files.select(relative(F.col("path"), root).alias("doc_path"), F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n").alias("text"))


def asset_tree(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path) of the other files; only names are read, contents are pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(relative(F.col("path"), root).alias("rel_path"))
    return files.where(~F.regexp_like("rel_path", F.lit(r"\.mdx?$")))


def with_locale(docs: DataFrame, locale: str) -> DataFrame:
    """Documents of a locale's tree, mounted under its name."""
    return docs.withColumn("doc_path", F.concat(F.lit(locale + "/"), "doc_path"))


def mounted(docs: DataFrame, prefix: str) -> DataFrame:
    """Documents of a further content root, mounted under a URL prefix."""
    return docs.withColumn("doc_path", F.concat(F.lit(prefix.strip("/") + "/"), "doc_path")) if prefix.strip("/") else docs


def overlaid(docs: DataFrame, buffers: DataFrame) -> DataFrame:
    """Open buffers (doc_path, text) shadow documents, and add those that aren't saved yet."""
    return docs.join(buffers.select("doc_path"), "doc_path", "left_anti").unionByName(buffers.select("doc_path", "text"))


def restricted(docs: DataFrame, target: str | None) -> DataFrame:
    """Only one file, or the files below a folder."""
    if not target:
        return docs
    target = target.rstrip("/")
    return docs.where((F.col("doc_path") == target) | F.startswith("doc_path", F.lit(target + "/")))


def staged(docs: DataFrame, paths: list[str]) -> DataFrame:
    """The documents that a list of changed paths names."""
    names = docs.sparkSession.createDataFrame([(p,) for p in paths if p.endswith(DOC_SUFFIXES)], "doc_path string")
    return docs.join(names, "doc_path", "left_semi")


def prebuilt_routes(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """(doc_path, url, status) from a JSON map of path to route; documents that it lacks are IGNORED."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<url:string,status:string,slug:string>>").alias("m"))
    rows = text.select(F.explode("m").alias("doc_path", "r")).select("doc_path", "r.url", "r.status")
    return docs.select("doc_path").join(rows, "doc_path", "left").withColumn("status", F.coalesce("status", F.lit("IGNORED")))


# -- configuration (driver side: small files) -------------------------------------------


def ignore_globs(text: str) -> list[tuple[str, bool]]:
    """The patterns of an ignore file as (regex, excludes): the last that matches a path decides."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        excludes, line = (False, line[1:]) if line.startswith("!") else (True, line)
        anchored, folder = "/" in line.rstrip("/"), line.endswith("/")
        body = glob_regex(line.strip("/")).removeprefix("(?s)^").removesuffix("$").replace(".*.*/", "(?:.*/)?").replace(".*.*", "\0").replace(".*", "[^/]*").replace("\0", ".*")
        out.append((("^" if anchored else "(?:^|.*/)") + body + ("/.*" if folder else "(?:/.*)?") + "$", excludes))
    return out


def ignored(path, patterns: list[tuple[str, bool]]):
    out = F.lit(False)
    for regex, excludes in patterns:
        out = F.when(F.regexp_like(path, F.lit(regex)), F.lit(excludes)).otherwise(out)
    return out


def nav_paths(nav) -> list[str]:
    """Document paths of a nested navigation (lists, titles to targets, strings); ``dir/`` means its index."""
    if isinstance(nav, str):
        nav = nav + "index.md" if nav.endswith("/") else nav
        return [nav.lstrip("/")] if nav.endswith(DOC_SUFFIXES) else []
    if isinstance(nav, dict):
        return [p for v in nav.values() for p in nav_paths(v)]
    return [p for v in nav or [] for p in nav_paths(v)]


def site_config(text: str, kind: str) -> dict:
    """A site configuration in YAML, TOML or JSON; unknown YAML tags are read as null."""
    if kind == "toml":
        return tomllib.loads(text)
    if kind == "json":
        return json.loads(text)
    if yaml is None:
        raise RuntimeError("reading YAML needs the yaml module")

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_multi_constructor("", lambda loader, suffix, node: None)
    return yaml.load(text, Loader) or {}


def merged(base: dict, local: dict) -> dict:
    """A local overlay on a configuration: lists add up without repeats, tables merge, the rest is replaced."""
    out = dict(base)
    for k, v in local.items():
        if isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = out[k] + [x for x in v if x not in out[k]]
        elif isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = merged(out[k], v)
        else:
            out[k] = v
    return out


def glob_match(path: str, glob: str) -> bool:
    return fnmatch.fnmatchcase(path, glob)
