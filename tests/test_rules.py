"""Golden cases of the document rules: small texts and the rows they must give."""

import pytest

from docweave.functions.text import glob_regex, jvm_regex, normpath, slug_ascii, slug_unicode
from docweave.operators import governance, lines, links, rules, score

FENCE = "```"


def docs(spark, *texts, **named):
    rows = [(f"d{i}.md", t) for i, t in enumerate(texts)] + list(named.items())
    return spark.createDataFrame(rows, "doc_path string, text string")


def line_nos(df):
    return sorted(r.line_no for r in df.collect())


@pytest.mark.parametrize(
    "rule, text, expected",
    [
        (rules.heading_hierarchy, "# A\n### B", [2]),
        (rules.heading_hierarchy, f"# A\n{FENCE}\n### x\n{FENCE}\n## B", []),
        (rules.empty_sections, "# A\n\n## B\ntext", [1]),
        (rules.empty_sections, f"# A\n{FENCE}\nx\n{FENCE}", []),
        (rules.empty_sections, "# A\n<!-- only a comment -->", [1]),
        (rules.duplicate_headings, "## Setup\nx\n##  setup {#s2}", [3]),
        (rules.multiple_h1, "# A\nx\n# B", [3]),
        (rules.heading_punctuation, "## Why:", [1]),
        (rules.heading_punctuation, "## Why", []),
        (rules.long_sentences, " ".join(["w"] * 40) + " end.", [1]),
        (rules.long_sentences, " ".join(["w"] * 39) + " end.", []),
        (rules.bare_urls, "see https://a.b/c.", [1]),
        (rules.bare_urls, "<https://a.b/c> `https://a.b` [x](https://a.b)", []),
        (rules.bare_urls, "[r]: https://a.b", []),
        (rules.passive_voice, "é is built", [1]),
        (rules.passive_voice, "éis built", [1]),
        (rules.fake_lists, "one;\ntwo;\nthree;", [1]),
        (rules.fake_lists, "one;\ntwo;", []),
        (rules.untagged_code, f"{FENCE}\nx\n{FENCE}\n{FENCE}python\ny\n{FENCE}", [1]),
        (rules.malformed_frontmatter, "----\na: b", [1]),
        (rules.malformed_frontmatter, "---\na: b\n---", []),
        (rules.missing_alt, "![](a.png) ![x](b.png)", [1]),
        (rules.generic_alt, "![screenshot 2](a.png)", [1]),
        (rules.generic_alt, "![Image of a cat](a.png)", [1]),
        (rules.generic_alt, "![Chart of sales](a.png)", []),
        (links.circular_anchors, "[quick start](#quick-start)", [1]),
        (links.empty_labels, "[](a.md)\n![](a.png)", [1]),
    ],
)
def test_line_rules(spark, rule, text, expected):
    assert line_nos(rule(docs(spark, text))) == expected


def test_placeholders_one_for_each_pattern(spark):
    assert len(rules.placeholders(docs(spark, "TODO fixme")).collect()) == 2


def test_strict_fences(spark):
    text = f"````\n{FENCE}\ninside\n````x\n````\nafter"
    kinds = [r.fence_kind for r in lines.document_lines(docs(spark, text)).orderBy("line_no").collect()]
    assert kinds == ["open", "in", "in", "in", "close", None]


def test_unclosed_frontmatter_and_empty_texts(spark):
    got = lines.document_lines(docs(spark, "---\na: b", "", None)).collect()
    assert [r.in_frontmatter for r in got] == [True, True]


def test_references(spark):
    d = docs(spark, "[t][nope] and [u][A]\n\n[a]: x.md\n[A]: y.md\n[dead]: z.md")
    assert [r.ref_id for r in links.dangling_references(d).collect()] == ["nope"]
    assert [r.ref_id for r in links.dead_definitions(d).collect()] == ["dead"]
    assert [(r.ref_id, r.line_no) for r in links.duplicate_definitions(d).collect()] == [("a", 3)]
    assert links.reference_integrity(d).first().integrity == 50.0


@pytest.mark.parametrize(
    "tag, code",
    [
        ('<a foo=1 href="x" foo="1">', "Z120"),
        ("<a>", "Z121"),
        ('<a href="#">', "Z122"),
        ('<a href="mailto:x">', "Z123"),
        ('<a href="x" onclick="y">', "Z124"),
        ('<a href="java&#x73;cript:1">', "Z205"),
    ],
)
def test_html(spark, tag, code):
    assert [r.code for r in links.html_findings(docs(spark, tag)).collect()] == [code]


def test_links_and_routes(spark):
    d = docs(spark, **{"index.md": "[a](a/b.md#one) [c](gone.md) [u](../../etc/passwd) [s](/x/y.md)", "a/b.md": "# One", "a/README.md": "x", "a/index.md": "y"})
    assert [(r.url, r.code) for r in links.broken_links(d).collect()] == [("gone.md", "Z101")]
    assert links.missing_anchors(d).count() == 0
    assert {(r.url, r.code) for r in links.path_findings(d).collect()} == {("../../etc/passwd", "Z203"), ("/x/y.md", "Z105")}
    assert {r.source for r in links.routes(d).where("status = 'CONFLICT'").collect()} == {"a/README.md", "a/index.md"}


def test_suppression_consumes_one_finding(spark):
    found = spark.createDataFrame([("d", 1, "Z501", 0, "a"), ("d", 1, "Z501", 1, "b"), ("d", 2, "Z201", 0, "c")], "doc_path string, line_no int, code string, ordinal int, match_text string")
    directives = spark.createDataFrame([("d", 1, "Z501", 0), ("d", 2, "Z201", 0), ("d", 3, "Z501", 0)], "doc_path string, line_no int, code string, ordinal int")
    assert {r.match_text for r in governance.apply_suppressions(found, directives).collect()} == {"b", "c"}
    assert [r.line_no for r in governance.dead_suppressions(found, directives).collect()] == [3]


@pytest.mark.parametrize("counts, suppressions, expected", [({}, 0, 100), ({"Z101": 5}, 0, 70), ({"Z505": 1000}, 0, 80), ({"Z402": 7}, 0, 75), ({"Z601": 11}, 0, None), ({"Z204": 1}, 0, 0), ({}, 5, 95), ({"Z601": 40}, 0, 70)])
def test_scores(spark, counts, suppressions, expected):
    df = spark.createDataFrame(list(counts.items()), "code string, n long")
    got = score.total_score(df, suppressions).first().score
    assert got == expected if expected is not None else 70 <= got < 80


def test_text_functions(spark):
    df = spark.createDataFrame([("a/./b/../c", "Crème Brûlée: {x}"), ("../../x", "A  b!")], "p string, t string")
    got = df.select(normpath(df.p).alias("n"), slug_ascii(df.t).alias("a"), slug_unicode(df.t).alias("u")).collect()
    assert [r.n for r in got] == ["a/c", "../../x"]
    assert got[1].a == got[1].u == "a-b"
    assert got[0].u == "creme-brulee"


def test_regexes_and_globs():
    with pytest.raises(ValueError):
        jvm_regex(r"(?=x)")
    with pytest.raises(ValueError):
        rules.custom_rule(None, [("Z501", "x", "m", "warning")])
    assert glob_regex("a/*.m[!x]") == r"(?s)^a/.*\.m[^x]$"
