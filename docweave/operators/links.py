"""Links, anchors, references and HTML nodes, and their resolution against the site's routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import dirname, find_all, first_match, link_target, matches, replace_all, slug_ascii, slug_unicode, strip, unescape
from . import lines
from .graph import cycle_links, written
from .lines import headings

#: Attributes that HTML links may carry, those that hide where a link leads, and folders that mark a path as a system path.
SAFE_ATTRIBUTES = ["href", "src", "id", "class", "title", "rel", "target", "lang", "download", "alt", "width", "height", "loading", "decoding", "data-docweave-ignore"]
OPAQUE_ATTRIBUTES = ["data-url", "data-path", "data-target", "data-route"]
SYSTEM_FOLDERS = ["etc", "root", "var", "proc", "sys", "usr"]
INLINE = r"!?\[[^\]]*\]\(([^)\s]*)[^)]*\)"
DEFINITION = r"^ {0,3}\[([^\]^][^\]]*)\]:\s*(\S+)"


def _visible(docs: DataFrame, *literals: str) -> DataFrame:
    """Lines outside strict fences, with comments and inline code taken out; ``literals`` as in ``document_lines``."""
    if (seen := lines.prepared_for(getattr(docs, "_docweave_visible", None), literals)) is not None:
        return seen
    line = F.when(F.col("line").contains("`"), replace_all(F.col("line"), r"`[^`]+`")).otherwise(F.col("line"))
    return lines.line_pass(docs, literals, visible=True).select("doc_path", "line_no", line.alias("line"))


def prepared(docs: DataFrame, raw: tuple[str, ...] | None = (), visible: tuple[str, ...] | None = ()) -> DataFrame:
    """``docs`` with its lines, and what of them is visible, written once: every rule on the frame returned reads these tables.

    ``raw`` and ``visible`` are literals, as in ``lines.prepared``; with none all lines are written, with None no table.
    """
    out = docs.select("doc_path", "text") if raw is None else lines.prepared(docs, *raw)
    if visible is not None:
        out._docweave_visible = (written(_visible(docs, *visible)), visible)
    return out


def inline_links(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no, ordinal, url, node_type, label) of inline links and images."""
    rows = _visible(docs, "](").where(F.col("line").contains("]("))
    rows = rows.select("doc_path", "line_no", F.posexplode(find_all(F.col("line"), INLINE)).alias("ordinal", "raw"))
    kind = F.when(F.startswith("raw", F.lit("!")), "image").otherwise("inline")
    return rows.select("doc_path", "line_no", "ordinal", first_match(F.col("raw"), INLINE, 1).alias("url"), kind.alias("node_type"), first_match(F.col("raw"), r"^!?\[([^\]]*)\]", 1).alias("label"))


def ref_definitions(docs: DataFrame) -> DataFrame:
    """(doc_path, ref_id, url, line_no, is_first, n_defs); ids are compared without case and outer blanks."""
    rows = _visible(docs, "]:").where(F.col("line").contains("]:") & matches(F.col("line"), DEFINITION))
    rows = rows.select("doc_path", F.lower(strip(first_match(F.col("line"), DEFINITION, 1))).alias("ref_id"), first_match(F.col("line"), DEFINITION, 2).alias("url"), "line_no")
    w = W.partitionBy("doc_path", "ref_id")
    return rows.withColumn("is_first", F.row_number().over(w.orderBy("line_no")) == 1).withColumn("n_defs", F.count("*").over(w))


def ref_uses(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no, ref_id) of full references ``[text][id]`` and collapsed ones ``[id][]``."""
    pattern = r"\[[^\]\[]+\]\[[^\]\[]*\]"
    rows = _visible(docs, "][").where(F.col("line").contains("]["))
    rows = rows.select("doc_path", "line_no", F.explode(find_all(F.col("line"), pattern)).alias("raw"))
    own, text = first_match(F.col("raw"), r"\]\[([^\]]*)\]$", 1), first_match(F.col("raw"), r"^\[([^\]]+)\]", 1)
    return rows.select("doc_path", "line_no", F.lower(strip(F.when(own == "", text).otherwise(own))).alias("ref_id"))


def ref_shortcuts(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no, ref_id) of bracketed texts that are neither links, definitions nor other references: ``[id]`` is one if the id is defined."""
    rows = _visible(docs, "[").where(F.col("line").contains("["))
    bare = replace_all(F.col("line"), r"\[[^\]\[]*\](?:\[[^\]\[]*\]|\([^)]*\)|:)")
    rows = rows.select("doc_path", "line_no", F.explode(find_all(bare, r"\[([^\]\[]+)\]", 1)).alias("ref_id"))
    return rows.select("doc_path", "line_no", F.lower(strip(F.col("ref_id"))).alias("ref_id"))


def _used_ids(docs: DataFrame) -> DataFrame:
    return ref_uses(docs).unionByName(ref_shortcuts(docs)).select("doc_path", "ref_id").distinct()


def dangling_references(docs: DataFrame) -> DataFrame:
    """Uses of ids that their document doesn't define."""
    return ref_uses(docs).join(ref_definitions(docs).select("doc_path", "ref_id").distinct(), ["doc_path", "ref_id"], "left_anti").select("doc_path", "line_no", "ref_id")


def dead_definitions(docs: DataFrame) -> DataFrame:
    """First definitions that no reference in their document uses."""
    return ref_definitions(docs).where("is_first").join(_used_ids(docs), ["doc_path", "ref_id"], "left_anti").select("doc_path", "line_no", "ref_id")


def duplicate_definitions(docs: DataFrame) -> DataFrame:
    return ref_definitions(docs).where("is_first AND n_defs > 1").select("doc_path", "line_no", "ref_id", "n_defs")


def reference_integrity(docs: DataFrame) -> DataFrame:
    """(doc_path, n_defs, n_used, integrity): share of definitions in use, in percent; 100 without any."""
    used = _used_ids(docs).withColumn("used", F.lit(1))
    per = ref_definitions(docs).where("is_first").join(used, ["doc_path", "ref_id"], "left").groupBy("doc_path").agg(F.count("*").alias("n_defs"), F.count("used").alias("n_used"))
    out = docs.select("doc_path").join(per, "doc_path", "left").fillna(0, ["n_defs", "n_used"])
    return out.withColumn("integrity", F.when(F.col("n_defs") == 0, 100.0).otherwise(F.col("n_used") * 100.0 / F.col("n_defs")))


def heading_slugs(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no, slug) of headings; only titles beyond ASCII leave the JVM, for their decomposition."""
    rows, plain = headings(docs), F.regexp_like("raw_title", F.lit(r"^[\x00-\x7F]*$"))
    return rows.where(plain).select("doc_path", "line_no", slug_ascii(F.col("raw_title")).alias("slug")).unionByName(rows.where(~plain).select("doc_path", "line_no", slug_unicode("raw_title").alias("slug")))


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_path, anchor): heading slugs, explicit ids and HTML ids."""
    slugs = heading_slugs(docs).select("doc_path", F.col("slug").alias("anchor"))
    ids = _visible(docs, "id=").where(F.col("line").contains("id=")).select("doc_path", F.explode(find_all(F.col("line"), r"<[A-Za-z][^>]*\bid=[\"']([^\"']+)[\"']", 1)).alias("anchor"))
    return slugs.unionByName(ids).where("anchor <> ''").distinct()


# -- routes and resolution --------------------------------------------------------------


def route_url(path: Column) -> Column:
    """Folder-style URL of a document: ``a/b.md`` is ``/a/b/``, an index or README stands for its folder; assets keep their path."""
    bare = F.regexp_replace(path, r"\.mdx?$", "")
    folder = F.regexp_replace(bare, r"(^|/)(index|README)$", "$1")
    url = F.concat(F.lit("/"), F.btrim(folder, F.lit("/")), F.lit("/"))
    return F.when(~F.regexp_like(path, F.lit(r"\.mdx?$")), F.concat(F.lit("/"), path)).otherwise(F.regexp_replace(url, "^//$", "/"))


def page_of(target: Column) -> Column:
    """The document that a link's target names: a folder, or a path without a type, names its index."""
    return F.when(target == "", "index.md").when(F.regexp_like(target, F.lit(r"(^|/)[^./]+$")), F.concat(target, F.lit("/index.md"))).otherwise(target)


def routes(docs: DataFrame, nav: DataFrame | None = None) -> DataFrame:
    """(url, source, status): CONFLICT where documents share a URL, ORPHAN where a nav is given that lacks the document.

    Conflicts are counted by a grouped aggregate and joined back, so a URL that many documents claim can't fill one window.
    """
    rows = docs.select(route_url(F.col("doc_path")).alias("url"), F.col("doc_path").alias("source"))
    if nav is not None:
        rows = rows.join(nav.select(F.col("rel_path").alias("source"), F.lit(True).alias("in_nav")), "source", "left")
    else:
        rows = rows.withColumn("in_nav", F.lit(True))
    counts = rows.groupBy("url").agg(F.count("*").alias("n"))
    rows = rows.join(counts, "url")
    return rows.select("url", "source", F.when(F.col("n") > 1, "CONFLICT").when(F.col("in_nav"), "REACHABLE").otherwise("ORPHAN").alias("status"))


def is_local(url: Column) -> Column:
    """Neither empty, nor a bare fragment, nor with a scheme or a host."""
    return (url != "") & ~F.regexp_like(url, F.lit(r"^([A-Za-z][A-Za-z0-9+.-]*:|//|#)"))


def resolve(links: DataFrame) -> DataFrame:
    """Adds to local links target (path within the site), anchor and outcome: ``ok`` or ``escapes``."""
    rows = links.where(is_local(F.col("url")))
    rows = rows.withColumn("anchor", F.regexp_extract("url", "#(.*)$", 1)).withColumn("is_absolute", F.startswith("url", F.lit("/")))
    return rows.withColumn("target", link_target("doc_path", "url")).withColumn("outcome", F.when(F.startswith("target", F.lit("..")), "escapes").otherwise("ok"))


def page_links(docs: DataFrame) -> DataFrame:
    """Resolved links to pages (no images, no asset suffixes)."""
    return resolve(inline_links(docs).where("node_type = 'inline'")).where(F.regexp_like("target", F.lit(r"(\.mdx?$|/$|^[^.]*$)")))


def broken_links(docs: DataFrame, nav: DataFrame | None = None) -> DataFrame:
    """(doc_path, line_no, url, code): Z101 where the target has no route, Z103 where its route is an orphan.

    One left join on the canonical URL; broadcast or shuffled as the planner's size check decides.
    """
    links = page_links(docs).where("outcome = 'ok' AND NOT is_absolute").withColumn("route", route_url(page_of(F.col("target"))))
    sites = routes(docs, nav).groupBy("url").agg(F.min("status").alias("status")).withColumnRenamed("url", "route")
    code = F.when(F.col("status").isNull(), "Z101").when(F.col("status") == "ORPHAN", "Z103")
    return links.join(sites, "route", "left").select("doc_path", "line_no", "url", code.alias("code")).where("code IS NOT NULL")


def missing_anchors(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no, url): links whose page exists but lacks the fragment."""
    links = page_links(docs).where("outcome = 'ok' AND anchor <> ''")
    known = docs.select(F.col("doc_path").alias("target"))
    have = anchors(docs).select(F.col("doc_path").alias("target"), "anchor")
    return links.join(known, "target", "left_semi").join(have, ["target", "anchor"], "left_anti").select("doc_path", "line_no", "url")


def missing_files(docs: DataFrame, assets: DataFrame) -> DataFrame:
    """Images whose file is neither an asset nor a document."""
    images = resolve(inline_links(docs).where("node_type = 'image'")).where("outcome = 'ok'")
    known = assets.select(F.col("rel_path").alias("target")).unionByName(docs.select(F.col("doc_path").alias("target")))
    return images.join(known, "target", "left_anti").select("doc_path", "line_no", "url", "target")


def path_findings(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no, url, code): Z203 for escapes or absolute paths into system folders, Z202 for other escapes, Z105 for absolute links."""
    rows = resolve(inline_links(docs))
    system = F.regexp_like("url", F.lit(r"(^|/)(" + "|".join(SYSTEM_FOLDERS) + ")(/|$)"))
    code = F.when(((F.col("outcome") == "escapes") | F.col("is_absolute")) & system, "Z203").when(F.col("outcome") == "escapes", "Z202").when(F.col("is_absolute"), "Z105")
    return rows.select("doc_path", "line_no", "url", code.alias("code")).where("code IS NOT NULL")


def circular_anchors(docs: DataFrame) -> DataFrame:
    """Z107: a link to a fragment of its own page that only repeats its label."""
    rows = inline_links(docs).where("node_type = 'inline' AND startswith(url, '#')")
    return rows.where(F.replace(strip(F.lower("label")), F.lit(" "), F.lit("-")) == F.lower(F.substring("url", 2, 10_000))).select("doc_path", "line_no", "url")


def empty_labels(docs: DataFrame) -> DataFrame:
    """Z108: links without a label."""
    return inline_links(docs).where("node_type = 'inline' AND label = ''").select("doc_path", "line_no", "url")


def html_nodes(docs: DataFrame) -> DataFrame:
    """(doc_path, line_no, ordinal, tag, href, attributes, findings) of ``<a>`` and ``<img>``.

    findings: Z205 for a javascript: or data: target (entities decoded), Z124 for event handlers and attributes that hide the target, Z121 for a missing target,
    Z122 for ``#``, Z123 for other schemes, Z120 for attributes outside the safe ones.
    """
    tag = r"<(?:a|img|A|IMG)(?:\s[^>]*)?>"
    rows = _visible(docs, "<").where(F.col("line").contains("<"))
    rows = rows.select("doc_path", "line_no", F.posexplode(find_all(F.col("line"), tag)).alias("ordinal", "raw"))
    names = F.array_distinct(F.transform(find_all(F.col("raw"), r"\s([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=", 1), F.lower))
    href = strip(first_match(F.col("raw"), r"(?i)\s(?:href|src)\s*=\s*[\"']([^\"']*)[\"']", 1))
    rows = rows.select("doc_path", "line_no", "ordinal", F.lower(first_match(F.col("raw"), r"^<([A-Za-z]+)", 1)).alias("tag"), href.alias("href"), names.alias("attributes"))
    rows = rows.withColumn("decoded", unescape("href"))
    plain = F.lower(F.regexp_replace("decoded", r"[\x00-\x20]", ""))
    safe = F.array(*[F.lit(x) for x in SAFE_ATTRIBUTES])
    opaque = lambda a: F.startswith(a, F.lit("on")) | a.isin(OPAQUE_ATTRIBUTES)
    handlers = F.exists("attributes", opaque)
    unknown = F.exists("attributes", lambda a: ~F.array_contains(safe, a) & ~opaque(a) & ~F.startswith(a, F.lit("aria-")))
    bad = F.regexp_like(plain, F.lit("^(javascript|data):"))
    found = F.array_compact(
        F.array(
            F.when(bad, "Z205"),
            F.when(handlers, "Z124"),
            F.when(F.col("href") == "", "Z121"),
            F.when(F.col("href") == "#", "Z122"),
            F.when(F.regexp_like(plain, F.lit("^(mailto|tel|ftp):")), "Z123"),
            F.when(unknown, "Z120"),
        )
    )
    return rows.withColumn("findings", found).drop("decoded")


def html_findings(docs: DataFrame) -> DataFrame:
    return html_nodes(docs).select("doc_path", "line_no", "ordinal", F.explode("findings").alias("code"))


def page_hrefs(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, href) of the ``<a href>`` of raw HTML pages."""
    return pages.select("page_id", F.posexplode(find_all(F.col("html"), r"<a\s[^>]*href=\"([^\"]*)\"", 1)).alias("ordinal", "href"))


def used_assets(docs: DataFrame) -> DataFrame:
    """Distinct asset paths that any page refers to."""
    inline = resolve(inline_links(docs)).where("outcome = 'ok'").select("target")
    html = resolve(html_nodes(docs).select("doc_path", "line_no", F.col("href").alias("url"))).where("outcome = 'ok'").select("target")
    defs = resolve(ref_definitions(docs).select("doc_path", "line_no", "url")).where("outcome = 'ok'").select("target")
    return inline.unionByName(html).unionByName(defs).distinct()


def unused_assets(docs: DataFrame, assets: DataFrame) -> DataFrame:
    return assets.join(used_assets(docs).withColumnRenamed("target", "rel_path"), "rel_path", "left_anti")


def orphan_pages(docs: DataFrame, nav: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_path").alias("rel_path")).join(nav.select("rel_path"), "rel_path", "left_anti")


def missing_indexes(docs: DataFrame) -> DataFrame:
    """Folders, other than the root, that hold documents but no index page."""
    folder = dirname(F.col("doc_path"))
    rows = docs.select(folder.alias("folder"), F.regexp_like("doc_path", F.lit(r"(^|/)(index|README)\.mdx?$")).alias("is_index"))
    return rows.groupBy("folder").agg(F.max("is_index").alias("has_index"), F.count("*").alias("n_docs")).where("NOT has_index AND folder <> ''").select("folder", "n_docs")


def edges(docs: DataFrame) -> DataFrame:
    """(src, dst) URLs of links between known pages."""
    known = docs.select(F.col("doc_path").alias("target"))
    rows = page_links(docs).where("outcome = 'ok'").join(known, "target", "left_semi")
    return rows.select(route_url(F.col("doc_path")).alias("src"), route_url(F.col("target")).alias("dst")).distinct()


def links_into_cycles(docs: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """Z106: (doc_path, line_no, url) of links, from any page, to a page that lies on a cycle of links."""
    known = docs.select(F.col("doc_path").alias("target"))
    rows = page_links(docs).where("outcome = 'ok'").join(known, "target", "left_semi").withColumn("target_url", route_url(F.col("target")))
    return cycle_links(rows, edges(docs) if graph is None else graph)
