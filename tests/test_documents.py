from docweave.functions.documents import FIXES, Rule, autofix, parse_error, run_rule, snippet_errors, user_rules
from docweave.operators import lines
from docweave.sources import sinks, trees
from docweave.streaming.incremental import CHANGES, IncrementalAnalysis


def test_snippets(spark):
    d = spark.createDataFrame([("a.md", "```json\n{\"a\": }\n```\n```python\nx = 1\n```\n```toml\nx = \n```")], "doc_path string, text string")
    assert sorted(r.fence_line for r in snippet_errors(lines.code_blocks(d)).collect()) == [1, 7]
    assert parse_error("cobol", "?") is None


def test_fixes_are_idempotent(spark):
    text = "## Why:\n[](a.md) https://a.b/c.\n```\nhttps://x\n```\none;\ntwo;\nthree;\nend."
    out = autofix(spark.createDataFrame([("a.md", text)], "doc_path string, text string")).first()
    assert out.text == "## Why\n[TODO](a.md) <https://a.b/c>.\n```text\nhttps://x\n```\n- one;\n- two;\n- three;\n- end."
    for f in FIXES.values():
        assert f(out.text) == out.text


class Bad(Rule):
    code = "t:BAD"

    def visit_document(self, path, text):
        raise RuntimeError("no")
        yield


class Found(Rule):
    code = "t:FOUND"

    def visit_line(self, path, n, line):
        if "x" in line:
            yield n, "an x", "x"


def test_user_rules_are_isolated(spark):
    d = spark.createDataFrame([("a.md", "y\nx")], "doc_path string, text string")
    assert {(r.code, r.line_no) for r in user_rules(d, [Bad(), Found()]).collect()} == {("Z901", 0), ("t:FOUND", 2)}
    assert run_rule(Found(), "x") == [(1, "an x", "x")]


def test_tree_sources(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "a.md").write_text("# A\r\nb")
    (tmp_path / "d" / "sub" / "c d.mdx").write_text("x")
    (tmp_path / "d" / "img.png").write_bytes(b"1")
    root = str(tmp_path / "d")
    assert {(r.doc_path, r.text) for r in trees.markdown_tree(spark, root).collect()} == {("a.md", "# A\nb"), ("sub/c d.mdx", "x")}
    assert [r.rel_path for r in trees.asset_tree(spark, root).collect()] == ["img.png"]
    assert trees.nav_paths([{"Home": "index.md"}, {"G": ["g/", "x.html"]}]) == ["index.md", "g/index.md"]
    assert trees.merged({"a": [1], "b": {"c": 1}}, {"a": [1, 2], "b": {"d": 2}}) == {"a": [1, 2], "b": {"c": 1, "d": 2}}
    df = spark.createDataFrame([("build/x.md",), ("a/keep.log",), ("a/b.log",)], "p string")
    assert [r.p for r in df.where(trees.ignored(df.p, trees.ignore_globs("build/\n*.log\n!keep.log"))).collect()] == ["build/x.md", "a/b.log"]


def test_sarif(spark):
    import json

    f = spark.createDataFrame([("b.md", 0, "Z501", "warning", "m"), ("a.md", 3, "Z203", "error", "n")], "doc_path string, line_no int, code string, severity string, message string")
    doc = json.loads(sinks.sarif(f).first().json)
    run = doc["runs"][0]
    assert [r["ruleId"] for r in run["results"]] == ["Z203", "Z501"] and run["invocations"][0]["executionSuccessful"] is False
    assert run["results"][1]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from docweave.operators import links

    def rules(everything, some):
        return links.broken_links(everything).join(some.select("doc_path"), "doc_path", "left_semi")

    def edges(docs):
        return links.page_links(docs).select(F.col("doc_path").alias("src_path"), F.col("target").alias("dst_path"))

    job = IncrementalAnalysis(spark, str(tmp_path / "state"), rules, edges)
    job.start_from(spark.createDataFrame([("a.md", "[b](b.md)"), ("b.md", "x")], "doc_path string, text string"))
    assert job.findings().count() == 0
    source = tmp_path / "in"
    spark.createDataFrame([("b.md", None, "delete", None), ("c.md", "[n](none.md)", "upsert", None)], CHANGES).withColumn("ts", F.current_timestamp()).coalesce(1).write.json(str(source))
    job.run(spark.readStream.schema(CHANGES).json(str(source)), str(tmp_path / "cp")).awaitTermination()
    want = {(r.doc_path, r.url) for r in links.broken_links(job.docs()).collect()}
    assert {(r.doc_path, r.url) for r in job.findings().collect()} == want == {("a.md", "b.md"), ("c.md", "none.md")}
