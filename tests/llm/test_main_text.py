"""Main text: labelled pages that weren't learned from, awkward markup, hostile pages."""

import html
import time
from collections import Counter

import pytest

from docweave.llm import labelled, main_text


def gold(page):
    blocks, words = [], []
    for within, kind, value, e in main_text._labelled_texts(page, main_text.weights()):
        if kind != "text":
            if value in main_text._BLOCKS:
                blocks.append("".join(words))
                words = []
        elif within and not (e and e.hidden):
            words.append(value)
    blocks.append("".join(words))
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_held_out_pages():
    hit = extra = lost = 0
    for page in labelled.pages(200, 77):
        want, got = Counter(gold(page).split()), Counter(main_text.main_text(page.replace("«", "").replace("»", "")).split())
        same = sum((want & got).values())
        hit, extra, lost = hit + same, extra + sum(got.values()) - same, lost + sum(want.values()) - same
    assert 2 * hit / (2 * hit + extra + lost) > 0.97


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>one two three four</p><svg class='x' /><p>second paragraph is here</p></article>", "one two three four second paragraph is here"),
        ("<article><p>one two three <select><option>x</p><p>second paragraph stays</p></article>", "one two three second paragraph stays"),
        ('<article><div class="entry-header"><h1>The title</h1></div><p>the text goes on</p><section id="related-work"><h2>Related work</h2><p>much has been written</p></section></article><footer>foot</footer>', "The title the text goes on Related work much has been written"),
        ('<div class="content has-sidebar"><p>an opening paragraph that stands before the article</p><article><p>then the article itself follows</p></article></div>', "an opening paragraph that stands before the article then the article itself follows"),
        ('<div class="wrapper header-fixed overflow-hidden"><div id="search-results"><article><h1>A</h1><p>text stays</p></article></div></div>', "A text stays"),
        ("<article><p>one</p><p aria-hidden='false'>two words</p><p aria-hidden='true'>no</p><p hidden>no</p></article>", "one two words"),
        ('<article><p>long enough text of the article</p></article><div class="comments"><article class="comment"><p>I like it so very much indeed</p></article></div>', "long enough text of the article"),
        ("a &lt; b", "a < b"),
        ("a < b and c > d", "a < b and c > d"),
        ('<p title="a>b">text here</p>', "text here"),
        ("<p>kept words</p><script>never closed <p>hidden</p>", "kept words"),
        ("just words", "just words"),
    ],
)
def test_markup(page, text):
    assert main_text.main_text(page) == text


@pytest.mark.parametrize("page", ["<body>" + "<a " * 300_000, "<a b='" * 150_001 + ">", "<!-- " * 200_000, "<script>" * 120_000, "<i>" * 250_000 + "x", "<p>" * 250_000, "<" * 900_000, "</p>" * 250_000, "<select><p>" * 80_000, '<a class="' + "x " * 400_000 + '">a</a>'])
def test_hostile_pages_take_linear_time(page):
    main_text.weights()
    t = time.perf_counter()
    main_text.main_text(page)
    assert time.perf_counter() - t < 12  # a quadratic scan takes minutes


def test_long_page_ties_and_empty_tables(spark):
    long = "<article>" + "<p>some words of the text</p>" * 40_000 + "</article>"
    df = spark.createDataFrame([(1, "u", long, "x"), (2, None, "<p>one two</p><nav><a>m</a></nav><p>six ten</p>", "x"), (None, "u", None, "x")], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in main_text.extract_main_text(df).collect()}
    assert rows[1].text == " ".join(["some words of the text"] * 40_000) and rows[1].n_chars == len(rows[1].text)
    assert "m" not in rows[2].text.split() and rows[None].text == ""
    assert main_text.extract_main_text(df.limit(0)).count() == 0
