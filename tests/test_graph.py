from docweave.operators import graph


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_reachability_and_dead_ends(spark):
    e = edges(spark, ("i", "a"), ("a", "b"), ("x", "a"))
    routes = spark.createDataFrame([(u, u + ".md") for u in "iabx"], "url string, source string")
    start = spark.createDataFrame([("i",)], "url string")
    assert {(r.url, r.depth) for r in graph.reachable(e, start).collect()} == {("i", 0), ("a", 1), ("b", 2)}
    assert [r.url for r in graph.unreachable(routes, e, start).collect()] == ["x"]
    assert [r.url for r in graph.dead_ends(routes, e).collect()] == ["b"]


def test_every_node_on_a_cycle_is_found(spark):
    e = edges(spark, ("1", "2"), ("2", "3"), ("3", "1"), ("2", "4"), ("4", "3"), ("0", "1"), ("4", "5"), ("7", "7"))
    assert {r.url for r in graph.cycle_members(e).collect()} == {"1", "2", "3", "4", "7"}
    assert graph.cycle_members(edges(spark, ("1", "2"), ("2", "3"))).count() == 0


def test_cycles_of_graphs_beyond_one_task(spark, monkeypatch):
    """Rings of neighbours, a long ring across all chunks, chains and loops, with every limit made small."""
    import random

    monkeypatch.setattr(graph, "CHUNK", 40)
    r = random.Random(3)
    name = lambda i: f"/p{i:03d}/"
    pairs = {(name(i), name(i - i % 5 + (i + 1) % 5)) for i in range(100)} | {(name(110 + i), name(111 + i)) for i in range(3)} | {(name(50), name(50)), (name(119), name(119))}
    pairs |= {(name(200 + i * 7 % 30), name(200 + (i + 1) * 7 % 30)) for i in range(30)} | {(name(r.randrange(300, 320)), name(r.randrange(300, 320))) for _ in range(24)}
    e = edges(spark, *sorted(pairs))
    want = {x.url for x in graph.cycle_members(e).collect()}
    assert {name(i) for i in range(100)} | {name(119)} | {name(200 + i) for i in range(30)} <= want and not {name(110 + i) for i in range(3)} & want
    trims, trim = [], graph._trim

    def told(core):
        trims.append(core.count())
        return trim(core)

    monkeypatch.setattr(graph, "_trim", told)
    monkeypatch.setattr(graph, "SMALL_GRAPH", 60)
    assert sorted(x.url for x in graph.cycle_members(e).collect()) == sorted(want)
    assert trims[0] < len(pairs) - 60  # most rings of neighbours went before any round
