"""The pass over text buffers: states on odd inputs, literals, and that nothing is shuffled for them."""

from docweave.functions.linebytes import Lines
from docweave.operators import lines, links, rules
from docweave.plans import corpus


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}.md", t) for i, t in enumerate(texts)], "doc_path string, text string")


def test_a_form_feed_is_a_blank_and_a_letter_is_not(spark):
    got = lines.document_lines(docs(spark, "\f```\nx\n\f```\n", "f```\nx", "---\na: b\nf---\nc\n---\nd")).collect()
    assert [(r.doc_path, r.line_no) for r in got if r.is_marker] == [("d0.md", 1), ("d0.md", 3)]
    assert [(r.doc_path, r.line_no) for r in got if r.in_fence] == [("d0.md", 2)]
    assert [r.line_no for r in got if r.in_frontmatter] == [1, 2, 3, 4, 5]


def test_lines_keep_their_numbers_where_a_comment_holds_any_line_end(spark):
    text = "a <!-- x\ry\r\nz\n --> [b](c.md)\r[d](e.md)"
    assert [(r.line_no, r.url) for r in links.inline_links(docs(spark, text)).collect()] == [(4, "c.md"), (5, "e.md")]


def test_states_end_with_their_document():
    x = Lines([b"```\nopen", None, b"", b"\n", b"~~~~\n```\n~~~\n~~~~~ \nfree", b"---\nnever closed"])
    assert x.doc[x.real].tolist() == [0, 0, 3, 4, 4, 4, 4, 4, 5, 5]
    assert x.kind[x.real].tolist() == [1, 3, 0, 1, 3, 3, 2, 0, 0, 0]
    assert x.in_frontmatter[x.real].tolist() == [False] * 8 + [True] * 2


def test_rules_find_the_same_in_tables_of_some_lines(spark):
    d = docs(spark, "# A\nToDo wip\n`x` [a](b.md) http://a.b/c\n[r]`y`: z\n# B\n", "plain\nOLDbrand [c](d.md)")
    some = links.prepared(d, ("#", "todo", "fixme", "wip", "tbd"), ("](",))
    for f in (lines.headings, rules.placeholders, rules.multiple_h1, rules.bare_urls, links.inline_links, links.ref_definitions, lambda x: rules.obsolete_terms(x, ["OldBrand"])):
        whole = sorted(f(d).collect())
        assert whole and sorted(f(some).collect()) == whole
    assert some._docweave_lines[0].count() == 3 and some._docweave_visible[0].count() == 3


def test_neither_lines_nor_empty_sections_are_shuffled(spark):
    d = docs(spark, "# A\n<!-- only -->\n## B\ntext\n```\n# no\n```\n### C\n")
    for f in (lines.document_lines, rules.empty_sections):
        plan = f(d)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Generate" not in plan
    assert sorted(r.line_no for r in rules.empty_sections(d).collect()) == [1, 8]


def test_pages_are_dealt_out_by_the_number_of_orders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "PAGES", 100)
    spark.range(1000).selectExpr("id AS o_orderkey", "id AS o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    parts = corpus.site(spark, str(tmp_path)).where("startswith(doc_path, 'orders/')").rdd.glom().map(len).collect()
    assert sum(parts) == 1000 and max(parts) < 250
