"""Routes by site engine: strategies for URLs, locales, entry points, alternates and declared assets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import is_local, page_links, page_of, resolve, route_url


def flat_url(path: Column) -> Column:
    """URL of a page where pages are files: ``a/b.md`` is ``/a/b.html``; an index or README is its folder's ``index.html``."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.mdx?$", ""), r"(^|/)README$", "$1index")
    return F.when(~F.regexp_like(path, F.lit(r"\.mdx?$")), F.concat(F.lit("/"), path)).otherwise(F.concat(F.lit("/"), bare, F.lit(".html")))


#: URL strategies by name; a site's engine chooses one, and further ones can be registered.
STRATEGIES: dict[str, Callable[[Column], Column]] = {"folder": route_url, "flat": flat_url}


def register_strategy(name: str, strategy: Callable[[Column], Column]) -> None:
    """Add a URL strategy for a site engine; one of the same name is replaced."""
    STRATEGIES[name] = strategy


def default_locale_path(path: Column, locales: list[str]) -> Column:
    """The path in the default locale's tree: a leading folder that names another locale, or a suffix such as ``.de`` before the type, goes."""
    for x in locales:
        path = F.when(F.startswith(path, F.lit(x + "/")), F.substr(path, F.lit(len(x) + 2))).when(F.regexp_like(path, F.lit(rf"\.{x}\.mdx?$")), F.regexp_replace(path, rf"\.{x}(\.mdx?)$", "$1")).otherwise(path)
    return path


def engine_routes(docs: DataFrame, strategy: str = "folder", nav: DataFrame | None = None, locales: list[str] | None = None) -> DataFrame:
    """(url, source, status) under a URL strategy: CONFLICT where documents share a URL, ORPHAN beside a nav that lacks the document.

    A page of another locale is in the nav if its page of the default locale is: it is that page's shadow.
    """
    rows = docs.select(STRATEGIES[strategy](F.col("doc_path")).alias("url"), F.col("doc_path").alias("source"))
    if nav is not None:
        listed = nav.select(F.col("rel_path").alias("key"), F.lit(True).alias("listed")).distinct()
        rows = rows.withColumn("key", default_locale_path(F.col("source"), locales or [])).join(listed, "key", "left")
    else:
        rows = rows.withColumn("listed", F.lit(True))
    rows = rows.join(rows.groupBy("url").agg(F.count("*").alias("n")), "url")
    return rows.select("url", "source", F.when(F.col("n") > 1, "CONFLICT").when(F.col("listed"), "REACHABLE").otherwise("ORPHAN").alias("status"))


def entry_points(routes: DataFrame, has_nav: bool) -> DataFrame:
    """(url): with a nav the root and what the nav lists, without one every page."""
    return routes.where((F.col("status") == "REACHABLE") | (F.col("url") == "/")).select("url").distinct() if has_nav else routes.select("url").distinct()


def broken_links_under(docs: DataFrame, routes: DataFrame, strategy: str = "folder", locales: list[str] | None = None) -> DataFrame:
    """(doc_path, line_no, url, code): Z101 and Z103 under a strategy. A URL that has no route is tried once more as the page of an
    ``.html`` file, and, with locales, as the default locale's page."""
    links = resolve_all(docs).withColumn("page", F.regexp_replace("target", r"\.html?$", ".md"))
    url = STRATEGIES[strategy]
    links = links.withColumn("u1", url(page_of(F.col("target")))).withColumn("u2", url(page_of(F.col("page")))).withColumn("u3", url(page_of(default_locale_path(F.col("page"), locales or []))))
    sites = routes.groupBy("url").agg(F.min("status").alias("status"))
    for n in ("1", "2", "3"):  # each try is an equi-join on a URL
        links = links.join(sites.select(F.col("url").alias(f"u{n}"), F.col("status").alias(f"s{n}")), f"u{n}", "left")
    status = F.coalesce("s1", "s2", "s3")
    return links.select("doc_path", "line_no", "url", F.when(status.isNull(), "Z101").when(status == "ORPHAN", "Z103").alias("code")).where("code IS NOT NULL")


def resolve_all(docs: DataFrame) -> DataFrame:
    """Resolved links to pages and to ``.html`` files, absolute ones too."""
    from .links import inline_links

    rows = resolve(inline_links(docs).where("node_type = 'inline'")).where("outcome = 'ok'")
    return rows.where(F.regexp_like("target", F.lit(r"(\.mdx?$|\.html?$|/$|^[^.]*$)")))


def links_of_all_forms(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no, form, url): targets of inline links, of HTML links and images, and of reference definitions that are used."""
    from .links import _used_ids, html_nodes, inline_links, ref_definitions

    inline = inline_links(docs).select("doc_path", "line_no", F.lit("inline").alias("form"), "url")
    nodes = html_nodes(docs).where("href <> ''").select("doc_path", "line_no", F.lit("html").alias("form"), F.col("href").alias("url"))
    defs = ref_definitions(docs).where("is_first").join(_used_ids(docs), ["doc_path", "ref_id"], "left_semi").select("doc_path", "line_no", F.lit("reference").alias("form"), "url")
    return inline.unionByName(nodes).unionByName(defs)


def broken_in_all_forms(docs: DataFrame, routes: DataFrame) -> DataFrame:
    """Z101 over links of all forms, absolute ones too: (doc_path, line_no, form, url) of pages without a route."""
    rows = resolve(links_of_all_forms(docs)).where("outcome = 'ok'").where(F.regexp_like("target", F.lit(r"(\.mdx?$|/$|^[^.]*$)")))
    return rows.withColumn("route", route_url(page_of(F.col("target")))).join(routes.select(F.col("url").alias("route")).distinct(), "route", "left_anti").select("doc_path", "line_no", "form", "url")


def missing_alternates(alternates: DataFrame, routes: DataFrame) -> DataFrame:
    """Z406: (link) of declared alternates that are local and no route's URL."""
    local = alternates.where(is_local(F.col("link")))
    url = F.concat(F.lit("/"), F.btrim("link", F.lit("/")), F.lit("/"))
    return local.withColumn("url", F.regexp_replace(url, "^//$", "/")).join(routes.select("url").distinct(), "url", "left_anti").select("link")


def missing_declared(declared: DataFrame, assets: DataFrame) -> DataFrame:
    """Z404: (rel_path) of a theme's declared files (logo, favicon, styles) that are no assets."""
    return declared.where(is_local(F.col("rel_path"))).select(F.ltrim("rel_path", F.lit("/")).alias("rel_path")).distinct().join(assets.select("rel_path"), "rel_path", "left_anti")


def virtual_routes(docs: DataFrame, buffers: DataFrame) -> DataFrame:
    """(url, source) of open buffers that are no documents of the site."""
    rows = buffers.join(docs.select("doc_path"), "doc_path", "left_anti")
    return rows.select(F.concat(F.lit("/_virtual/"), F.regexp_replace("doc_path", "^.*/", "")).alias("url"), F.col("doc_path").alias("source"))


def graph_rule(docs: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A user's rule on the graph: ``rule(links, routes)`` gives findings (doc_path, line_no, code, match_text), by joins of its own."""
    from .links import routes

    return rule(page_links(docs), routes(docs)).select("doc_path", "line_no", "code", "match_text")
