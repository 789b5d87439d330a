"""Main text of HTML pages by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score by where they stand, positive where labelled pages
have main text and negative where they have menus, adverts and the like; tags score negative. One linear scan finds the
contiguous region of the highest sum. What the region keeps are its words that score positive, block by block.

All weights are learned from labelled pages (``labelled``): where words stand is told by the elements around them and by
the tokens of their class, id and role, whole and in parts, in a logistic model; a tag's weight is the log ratio of how often
it occurs within and without main text. Class and id of an element that holds an article say nothing about
the words (a wrapper may well be called ``has-sidebar``).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_safe
from .labelled import pages as labelled_pages
from .pu_quality import _adam

#: Elements that break the line, so text before and after belongs to different blocks.
_BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu meta nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Elements whose content is no markup and up to whose end tag, or else the page's end, nothing shows.
_RAW = frozenset("script style textarea iframe noembed noframes xmp".split())
#: Elements whose content never shows.
_UNSEEN = frozenset("head title noscript template svg math select datalist object canvas audio video".split())
#: Elements that a block's start tag closes, as none can stand in them.
_BROKEN_BY_BLOCKS = frozenset("svg math select datalist".split())
_CONTENT = frozenset(("article", "main"))
_CLOSE = {x: re.compile(rf"</{x}(?=[\s/>]|$)", re.I) for x in _RAW}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"=[ \t\n\f\r]*+([\"'])|>")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden|aria-label|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/]|$))", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")


class _Tags:
    """Finds tags from left to right; what has turned out not to come any more is not looked for again, so the scan is linear."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        i = self.page.find(what, at)
        if i < 0:
            self.gone.add(what)
        return i

    def end(self, at: int) -> int:
        """Where the tag that is open at ``at`` ends (its ``>``), quoted values skipped; -1 if it never does."""
        first = self.find(">", at)
        if first < 0 or (self.page.find('"', at, first) < 0 and self.page.find("'", at, first) < 0):
            return first
        while m := _QUOTE_OR_END.search(self.page, at):
            if m[1] is None:
                return m.start()
            close = self.find(m[1], m.end())
            at = close + 1 if close >= 0 else m.end()
        self.gone.add(">")
        return -1


def _pieces(page: str):
    """(kind, name, value) in order: ``text`` with its text, ``<`` and ``/`` with a tag's name and its attributes."""
    tags, at, i = _Tags(page), 0, 0
    while (i := page.find("<", i)) >= 0:
        m = _NAME.match(page, i + 1)
        if m:
            stop = tags.end(m.end())
        elif page.startswith("<!--", i):
            stop = tags.find("-->", i + 4)
            stop = stop + 2 if stop >= 0 else len(page)
        elif page.startswith(("<!", "<?", "</"), i):
            stop = tags.find(">", i)
        else:
            i += 1
            continue
        if stop < 0:  # no tag ends from here on: an opened one hides the rest of its line of text
            break
        if i > at:
            yield "text", "", page[at:i]
        at = i = stop + 1
        if not m:
            continue
        name = m[2].lower()
        if m[1]:
            yield "/", name, ""
            continue
        value = page[m.end() : stop]
        closed = value.endswith("/")
        yield "<", name, value
        if name in _RAW and not (closed and name == "iframe"):
            close = _CLOSE[name].search(page, at) if f"</{name}" not in tags.gone else None
            if close is None:
                tags.gone.add(f"</{name}")
                at = i = len(page)
            else:
                at = i = close.start()
        elif closed and name not in _BLOCKS | _VOID:
            yield "/", name, ""
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!?]", rest) if i >= 0 else None
        yield "text", "", rest[: cut.start()] if cut else rest


def _own(name: str, value: str) -> tuple[frozenset, bool]:
    """The features of an element, and whether its style or attributes hide it."""
    out, hidden = {f"<{name}"}, name in _UNSEEN
    if value:
        for key, a, b, c in _ATTRIBUTE.findall(value):
            key, text = key.lower(), (a or b or c).lower()
            if key == "hidden" or key == "aria-hidden" and text == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", text):
                hidden = True
            elif key in ("class", "id", "role", "aria-label", "itemprop"):
                for token in text.split():
                    out.add(f"{key}={token}")
                    parts = _PART.findall(token)
                    out.update(f"{key}~{p}" for p in parts)
    return frozenset(out), hidden


class _Element:
    __slots__ = ("name", "own", "hidden", "above", "wraps", "path", "score")

    def __init__(self, name, own, hidden, above):
        self.name, self.own, self.hidden, self.above, self.wraps = name, own, hidden or bool(above and above.hidden), above, False
        self.path, self.score = None, 0.0


def _settle(elements: list[_Element], known: dict[str, float]) -> None:
    """Gives each element its path, the features of itself and of all around it (of wrappers only the name and what speaks for them), and its score.

    Elements come after those that hold them; one that adds nothing shares the path of its holder.
    """
    for e in elements:
        up = e.above.path if e.above else frozenset()
        own = frozenset(x for x in e.own if x[0] == "<" or known.get(x, 0.0) > 0) if e.wraps else e.own
        if e.above and own <= up:
            e.path, e.score = up, e.above.score
        else:
            e.path = up | own
            e.score = _bounded(known["1"] + sum(known.get(f, 0.0) for f in e.path)) if known else 0.0


def _bounded(w: float) -> float:
    return max(-_MOST, min(_MOST, w))


def parse(page: str, known: dict[str, float] | None = None, cache: dict | None = None) -> list[tuple[str, str, _Element | None]]:
    """(kind, name or text, element) in order: ``<`` and ``/`` for tags, ``text`` with the element that it stands in.

    With ``known`` weights elements carry only features that have one, so what is kept for an element is bounded.
    """
    known, cache = known or {}, {} if cache is None else cache
    out, stack, elements, open_names = [], [], [], {}

    def close(n: int) -> None:
        while len(stack) > n:
            open_names[stack.pop().name] -= 1

    for kind, name, value in _pieces(page):
        if kind == "text":
            out.append(("text", value, stack[-1] if stack else None))
            continue
        out.append((kind, name, None))
        if kind == "/":
            if not open_names.get(name):
                continue
            for n in range(len(stack) - 1, max(-1, len(stack) - 1 - _DEEP), -1):
                if stack[n].name == name:
                    close(n)
                    break
                if stack[n].name in _CONTENT and name in _WITHIN:
                    break  # a stray end tag closes nothing beyond its article
            continue
        if name in _VOID:
            continue
        if stack and name in _BLOCKS:
            if name not in ("option", "optgroup") and _BROKEN_BY_BLOCKS & open_names.keys() and any(open_names.get(x) for x in _BROKEN_BY_BLOCKS):
                close(next(n for n, e in enumerate(stack) if e.name in _BROKEN_BY_BLOCKS))
            if stack and stack[-1].name == "p":  # a paragraph ends where a block begins
                close(len(stack) - 1)
        if name in _SIBLINGS and stack and stack[-1].name == name:
            close(len(stack) - 1)
        if (own := cache.get((name, value))) is None:
            features, hidden = _own(name, value)
            speaks = 1.0 + sum(known.get(x, 0.0) for x in features if x[0] != "<")
            content = not hidden and speaks > 0 and (name in _CONTENT or "role=main" in features or "itemprop=articlebody" in features)
            own = frozenset(x for x in features if x in known) if known else features, hidden, content
            if len(cache) < 10_000:
                cache[name, value] = own
        e = _Element(name, own[0], own[1], stack[-1] if stack else None)
        stack.append(e)
        open_names[name] = open_names.get(name, 0) + 1
        elements.append(e)
        if own[2] and not e.hidden:
            up = e.above
            while up is not None and not up.wraps:
                up.wraps, up = up.name not in _CONTENT, up.above
    _settle(elements, known)
    return out


#: How far up an end tag looks for what it ends.
_DEEP = 200
_WITHIN = frozenset("p span div section li b i em strong a".split())
_SIBLINGS = frozenset("li option dt dd tr td th".split())
#: Pages that the weights are learned from, steps of the descent, and the penalty on squared weights.
PAGES, STEPS, PENALTY = 500, 250, 1e-4
#: Bounds of the score of a word and of a tag.
_MOST, _TAG_LEAST, _TAG_MOST = 4.0, -2.0, -0.05


def _labelled_texts(page: str, known: dict[str, float] | None = None):
    """(within, kind, text, element) of a labelled page, whose main text stands between « and »."""
    within = False
    for kind, value, e in parse(page.replace("«", "<x-in></x-in>").replace("»", "<x-out></x-out>"), known):
        if value in ("x-in", "x-out") and kind != "text":
            within = value == "x-in"
            continue
        yield within, kind, value, e


@cache
def weights() -> dict[str, float]:
    """Weights of features of where words stand, of tags (``tag<name``, ``tag/name``), and the constant ``1``."""
    shown = labelled_pages(PAGES, 1)
    out: dict[str, float] = {}
    for _ in range(2):  # the second time with what the first has told of articles that are comments
        index: dict[str, int] = {"1": 0}
        rows, cols, y, n = [], [], [], []
        tags: tuple[Counter, Counter] = (Counter(), Counter())
        for page in shown:
            for within, kind, value, e in _labelled_texts(page, out):
                if kind != "text":
                    tags[within][kind + value] += 1
                elif value.strip() and not (e and e.hidden):
                    for f in ("1", *(e.path if e else ())):
                        rows.append(len(y))
                        cols.append(index.setdefault(f, len(index)))
                    y.append(within)
                    n.append(min(len(value.split()), 20))
        rows, cols, y, n = np.array(rows), np.array(cols), np.array(y, float), np.array(n, float) ** 0.5
        share = n / n.sum()

        def gradient(w):
            p = 1 / (1 + np.exp(-np.bincount(rows, w[cols], len(y))))  # noqa: B023
            return np.bincount(cols, ((p - y) * share)[rows], len(w)) + PENALTY * w  # noqa: B023

        w = _adam(gradient, np.zeros(len(index)), STEPS, 0.1)
        out = {f: float(w[i]) for f, i in index.items()}
        for name in {*tags[0], *tags[1]}:
            ratio = math.log((tags[1][name] + 0.5) / (sum(tags[1].values()) + 1)) - math.log((tags[0][name] + 0.5) / (sum(tags[0].values()) + 1))
            out["tag" + name] = max(_TAG_LEAST, min(ratio / 2, _TAG_MOST))
    return out


def _scored(page: str, known: dict[str, float], cache: dict) -> list[tuple[str, str, float]]:
    """(kind, name or text, score) in order; hidden text is left out."""
    out, bare = [], _bounded(known["1"])
    for kind, value, e in parse(page, known, cache):
        if kind != "text":
            out.append((kind, value, known.get("tag" + kind + value, -0.3)))
        elif e is None or not e.hidden:
            out.append(("text", value, 0.0 if not value or value.isspace() else e.score if e else bare))
    return out


#: A part that scores negative is left out anyway, so a long one within the main text must not cut it in two.
_PART_LEAST = -12.0


def main_text(page: str | None, known: dict[str, float] | None = None, cache: dict | None = None) -> str:
    """The main text of a page; empty where there is none."""
    if not page:
        return ""
    known = weights() if known is None else known
    parts = _scored(page, known, {} if cache is None else cache)
    best, begin, stop, run, start = 0.0, 0, 0, 0.0, 0
    for i, (kind, text, w) in enumerate(parts):
        if run <= 0:
            run, start = 0.0, i
        run += w if kind != "text" else max(w * len(text.split()), _PART_LEAST)
        if run > best:
            best, begin, stop = run, start, i + 1
    # short lines at both ends score too little to be reached over their tags: what stands as surely as the region's words joins it
    sure = [w for kind, text, w in parts[begin:stop] if kind == "text" and w > 0 and text.strip()]
    level = min(sure, default=0.0)
    begin, stop = _reach(parts, begin, -1, level), _reach(parts, stop, 1, level)
    blocks, words = [], []
    for kind, text, w in parts[begin:stop]:
        if kind != "text":
            if text in _BLOCKS:
                blocks.append("".join(words))
                words = []
        elif w >= 0:
            words.append(text)
        else:
            blocks.append("".join(words))
            words = []
    blocks.append("".join(words))
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def _reach(parts: list, at: int, step: int, level: float) -> int:
    """The end of a region moved outward over text that scores at least ``level``, up to the first that scores negative."""
    i = at - 1 if step < 0 else at
    while level > 0 and 0 <= i < len(parts):
        kind, text, w = parts[i]
        if kind == "text" and text.strip():
            if w < level:
                break
            at = i if step < 0 else i + 1
        i += step
    return at


def _extract(known):
    def run(batches):
        cache: dict = {}
        for b in batches:
            texts = [main_text(x, known, cache) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty page, or one without words that score positive, gives an empty text. Pages are read
    whole, in linear time, and on their own; repeated rows give equal results; of two regions that score the same the first
    is taken. Broken markup is read as browsers do, as far as it makes sense: an unclosed comment, script or style
    hides what follows, other elements end with what holds them. A null page_id or url is carried through; an empty table
    gives an empty result; further columns are not read.
    """
    source = pages.select(null_safe(pages, "page_id", "long"), null_safe(pages, "url", "string"), null_safe(pages, "html", "string"))
    return source.mapInArrow(_extract(weights()), "page_id long, url string, text string, n_chars long")
