"""Link-graph operators: reachability, dead ends, cycles, by iterated equi-joins."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = jdir.get() if jdir.isDefined() else tempfile.mkdtemp(prefix="docweave-")
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage of an iteration for good."""
    path = f"{shared_dir(df.sparkSession)}/docweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Edges of a graph that one task takes in whole (two numbers each, about 100 MB with its arrays); larger ones go round by round.
SMALL_GRAPH = 4_000_000
#: Edges, neighbours by the name of their source, whose components are contracted in one task before a larger graph goes round by round.
CHUNK = 500_000


def _in_one_task(edges: DataFrame, start: DataFrame, search, schema: str) -> DataFrame:
    """``search(src, dst, start)`` over the whole graph, in one task: only for graphs whose edges have been counted."""
    rows = edges.select("src", "dst").unionByName(start.select(F.lit(None).cast("string").alias("src"), F.col("url").alias("dst")))

    def run(batches):
        import pyarrow as pa

        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts)
            bare = t.column("src").is_null().to_numpy()
            src, dst = (np.array(t.column(x).to_pylist(), object) for x in ("src", "dst"))
            names, at = np.unique(np.concatenate([src[~bare], dst]).astype(str), return_inverse=True)
            n = int((~bare).sum())
            own, value = search(len(names), at[:n], at[n:][~bare], at[n:][bare])
            yield pa.RecordBatch.from_arrays([pa.array(names[own].tolist(), pa.string()), pa.array(value, pa.int32())], ["url", "value"])

    return rows.coalesce(1).mapInArrow(run, schema)


def _neighbours(n: int, src: np.ndarray, dst: np.ndarray):
    """Where each node's targets begin, and the targets."""
    order = np.argsort(src, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]), dst[order]


def _targets(begin: np.ndarray, to: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    size = begin[nodes + 1] - begin[nodes]
    at = np.repeat(begin[nodes] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return np.unique(to[at])


def _depths(n: int, src: np.ndarray, dst: np.ndarray, start: np.ndarray):
    begin, to = _neighbours(n, src, dst)
    depth, frontier, d = np.full(n, -1), np.unique(start), 0
    while len(frontier):
        depth[frontier] = d
        frontier = _targets(begin, to, frontier)
        frontier = frontier[depth[frontier] < 0]
        d += 1
    seen = np.flatnonzero(depth >= 0)
    return seen, depth[seen]


def _parts(n: int, src: np.ndarray, dst: np.ndarray) -> list[list[int]]:
    """The strongly connected components of several nodes (Tarjan's algorithm with a stack of its own)."""
    begin, to = _neighbours(n, src, dst)
    begin, to = begin.tolist(), to.tolist()
    index, low, on, stack, found, count = [-1] * n, [0] * n, [False] * n, [], [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, begin[root])]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            v, i = work.pop()
            if i < begin[v + 1]:
                work.append((v, i + 1))
                w = to[i]
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    on[w] = True
                    work.append((w, begin[w]))
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == index[v]:
                part = stack[_last(stack, v) :]
                del stack[len(stack) - len(part) :]
                for w in part:
                    on[w] = False
                if len(part) > 1:
                    found.append(part)
    return found


def _on_cycles(n: int, src: np.ndarray, dst: np.ndarray, _):
    """Nodes of strongly connected components of several nodes, and those that link to themselves."""
    own = np.array(sorted(set(src[src == dst].tolist()).union(*_parts(n, src, dst))), np.int64)
    return own, np.zeros(len(own), np.int64)


def _local_parts(batches):
    """(url, part) of the components that lie within ``CHUNK`` edges in a row: part is the component's smallest URL."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def parts(held):
        t = pa.Table.from_batches(held).combine_chunks()
        names = pc.unique(t.column("src")).sort()
        src, dst = (pc.index_in(t.column(x), value_set=names) for x in ("src", "dst"))
        within = dst.is_valid().to_numpy()
        found = _parts(len(names), src.to_numpy()[within], dst.drop_null().to_numpy())
        url = [i for p in found for i in p]
        least = [i for p in found for i in [min(p)] * len(p)]
        return pa.RecordBatch.from_arrays([names.take(pa.array(x, pa.int64())) for x in (url, least)], ["url", "part"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield parts(held)
            held, n = [], 0
    if n:
        yield parts(held)


def _contracted(edges: DataFrame, local: DataFrame) -> DataFrame:
    """The edges between what the components (url, part) come to, each once."""
    for end in ("src", "dst"):
        edges = edges.join(local.select(F.col("url").alias(end), "part"), end, "left").withColumn(end, F.coalesce("part", end)).drop("part")
    return edges.where("src <> dst").select("src", "dst").distinct()


def _last(stack: list[int], v: int) -> int:
    i = len(stack) - 1
    while stack[i] != v:
        i -= 1
    return i


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(url, depth) of the nodes that ``start`` (url) reaches over edges (src, dst), breadth first, however deep.

    A graph of at most ``SMALL_GRAPH`` edges, counted first, is searched in one task. Beyond, each round joins only the frontier with the
    edges and drops what is known by an anti-join; both are shuffled by URL or broadcast as their size allows. Rounds end
    when the frontier is empty.
    """
    edges, start = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")), start.where("url IS NOT NULL")
    if edges.count() <= SMALL_GRAPH:
        return _in_one_task(edges, start, _depths, "url string, value int").select("url", F.col("value").alias("depth"))
    frontier = written(start.select("url").distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while frontier.take(1):
        depth += 1
        step = edges.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        frontier = written(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
        if depth % 20 == 0:  # keeps the union short
            seen = written(seen)
    return seen


def unreachable(routes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """Z410: routes that no entry point reaches."""
    return routes.select("url", "source").join(reachable(edges, start).select("url"), "url", "left_anti")


def dead_ends(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Z411: routes without an outgoing link."""
    return routes.select("url", "source").join(edges.select(F.col("src").alias("url")).distinct(), "url", "left_anti")


def cycle_members(edges: DataFrame) -> DataFrame:
    """(url) of the nodes that lie on a cycle.

    A graph of at most ``SMALL_GRAPH`` edges, counted first, is searched in one task. Of a larger one, components of pages whose URLs lie
    near each other are found by chunks and contracted, each to one node; then nodes without an incoming or an outgoing edge are trimmed
    until none is left or the rest is small. What remains lies on cycles or between
    them. Of that core, colours (the largest node that reaches a node) are spread forward, and a node is on the
    cycle of its colour if it reaches that colour's own node backward; found parts are taken out and the rest goes on, until
    nothing is left.
    """
    edges = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    n = edges.count()
    if n <= SMALL_GRAPH:
        return _whole(edges)
    loops = edges.where("src = dst").select(F.col("src").alias("url"))
    local = written(edges.repartitionByRange(n // CHUNK + 1, "src").sortWithinPartitions("src").mapInArrow(_local_parts, "url string, part string"))
    core = written(_contracted(edges, local))
    found = loops.unionByName(local.select("url"))
    while (core := _trim(core)).take(1):
        if core.count() <= SMALL_GRAPH:
            found = found.unionByName(_whole(core))
            break
        colour = written(core.select(F.col("src").alias("url")).unionByName(core.select(F.col("dst").alias("url"))).distinct().withColumn("colour", F.col("url")))
        while True:
            push = core.join(colour.withColumnRenamed("url", "src"), "src").groupBy(F.col("dst").alias("url")).agg(F.max("colour").alias("more"))
            after = written(colour.join(push, "url", "left").select("url", F.greatest("colour", F.coalesce("more", "colour")).alias("colour"), (F.col("more") > F.col("colour")).alias("grew")))
            colour = after.select("url", "colour")
            if not after.where("grew").take(1):
                break
        same = core.join(colour.select(F.col("url").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("url").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst")
        roots = colour.where("url = colour").select("url")
        back = reachable(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots).select("url")
        on = written(back.join(same.select(F.col("dst").alias("url")).distinct(), "url", "left_semi"))
        found = found.unionByName(on)
        core = written(core.join(back.withColumnRenamed("url", "src"), "src", "left_anti").join(back.withColumnRenamed("url", "dst"), "dst", "left_anti"))
    return found.distinct()


def _whole(edges: DataFrame) -> DataFrame:
    return _in_one_task(edges, edges.select(F.col("src").alias("url")).limit(0), _on_cycles, "url string, value int").select("url")


def _trim(core: DataFrame) -> DataFrame:
    """Edges whose source has an incoming and whose target an outgoing edge, to the fixed point or until they are few."""
    n = core.count()
    while n > SMALL_GRAPH:
        core = written(core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        m = core.count()
        if m == n:
            break
        n = m
    return core


def dependents(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Pages that link to changed pages (url): the reverse index is the same edge table, read by its target."""
    return edges.join(changed.select(F.col("url").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("url")).distinct()


def cycle_links(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Z106: links (doc_path, line_no, url, target_url, from anywhere) whose target lies on a cycle."""
    return links.join(cycle_members(edges).withColumnRenamed("url", "target_url"), "target_url", "left_semi").select("doc_path", "line_no", "url")


def topology_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(url, change) of URLs in one of two sets only, such as the dead ends of two versions: ``gone`` or ``new``."""
    a, b = before.select("url").distinct(), after.select("url").distinct()
    return a.join(b, "url", "left_anti").withColumn("change", F.lit("gone")).unionByName(b.join(a, "url", "left_anti").withColumn("change", F.lit("new")))
