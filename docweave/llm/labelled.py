"""Labelled pages that the weights of the main text are learned from.

Pages are made from a seed: layouts, names of classes and ids, lengths and the order of parts are drawn, so that many kinds of
sites are shown, and every stretch of main text stands between « and ». Other seeds give pages to test on.
"""

from __future__ import annotations

import random

_SOUNDS = "ka lo mi ter an sol ver ing da ne rus tal en fo gra li".split()

#: Names that sites give to parts that are not main text, by kind.
PARTS = {
    "menu": "nav navbar menu main-menu mainmenu top-nav navigation site-nav nav-menu primary-menu breadcrumb breadcrumbs navbar-nav skip-links language-switcher menu-item topbar",
    "header": "header site-header page-header masthead banner top-bar logo branding header-inner header-top",
    "footer": "footer site-footer page-footer colophon footer-widgets copyright bottom foot credits footer-bottom legal imprint",
    "sidebar": "sidebar side aside widget widgets widget-area sidebar-primary secondary right-rail rail archive tag-cloud categories",
    "advert": "ad ads advert advertisement sponsored sponsor promo ad-slot adsbygoogle banner-ad promotion google-ad ad-container teaser-ad",
    "notice": "cookie cookies cookie-notice cookie-banner consent gdpr notice alert popup modal overlay cookie-consent newsletter newsletter-signup subscribe signup paywall",
    "comments": "comments comment comment-list commentlist replies reply disqus respond comment-body comment-content user-comments discussion comments-area reviews",
    "share": "share sharing social social-share share-buttons follow-us addthis sharedaddy social-links",
    "related": "related related-posts related-articles recommended recommendations more-stories you-may-like read-more-links also-read most-read popular trending",
    "pager": "pagination pager page-numbers prev-next post-navigation toolbar search search-form login user-menu",
}
#: Names of main text, and of wrappers around everything.
CONTENT = "content main main-content article article-body post post-content entry entry-content story story-body text body-text page-content prose markdown-body article-content blog-post single-post news-text".split()
WRAPPERS = "wrapper page container has-sidebar no-sidebar with-sidebar header-fixed has-ads layout row site two-columns sidebar-left page-with-footer no-comments sticky-header theme-nav overflow-hidden search-results-page app root".split()
#: Names of blocks within main text; some share words with other parts.
INNER = "entry-header article-header post-title headline lead intro section abstract figure caption note quote summary entry-title story-header post-header subtitle text-block paragraph chapter byline-free article-footer-note".split()
_TOPICS = "related work results method history search navigation cookies footer header advertising comments sidebar menus introduction notice share banner widgets discussion".split()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(_SOUNDS) for _ in range(r.randrange(1, 4))) for _ in range(max(1, n)))


def _named(r: random.Random, names: list[str]) -> str:
    """A class or id attribute, or none."""
    kind = r.random()
    name = r.choice(names)
    if kind < 0.1:
        return ""
    if kind < 0.65:
        return f' class="{name}"' if r.random() < 0.7 else f' class="{name} {r.choice(["clearfix", "col", "inner", "box", "block", "x1"])}"'
    return f' id="{name}"'


def _links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{r.randrange(99)}">{_words(r, r.randrange(1, 4))}</a></li>' for _ in range(n)) + "</ul>"


def _part(r: random.Random, kind: str) -> str:
    """A part that is no main text."""
    names = PARTS[kind].split()
    named = _named(r, names) or f' class="{names[0]}"'
    prose = "".join(f"<p>{_words(r, r.randrange(3, 30))}</p>" for _ in range(r.randrange(1, 4)))
    if kind == "menu":
        tag = r.choice(["nav", "nav", "div", "ul"])
        return f"<{tag}{named if tag != 'nav' or r.random() < 0.5 else ''}>{_links(r, r.randrange(2, 9))}</{tag}>"
    if kind == "header":
        tag = r.choice(["header", "div"])
        return f"<{tag}{named if tag == 'div' or r.random() < 0.5 else ''}><a href='/'>{_words(r, 2)}</a><p>{_words(r, r.randrange(2, 9))}</p></{tag}>"
    if kind == "footer":
        tag = r.choice(["footer", "footer", "div"])
        inner = r.choice([f"<p>{_words(r, r.randrange(4, 30))}</p>", _links(r, 3), f"&copy; {_words(r, r.randrange(3, 20))} &middot; {_words(r, r.randrange(3, 12))}"])
        if r.random() < 0.3:
            inner = f'<div class="{r.choice(["container", "content", "row", "inner"])}">{inner}</div>'
        return f"<{tag}{named if tag == 'div' or r.random() < 0.4 else ''}>{inner}</{tag}>"
    if kind == "sidebar":
        tag = r.choice(["aside", "div", "section"])
        return f"<{tag}{named if tag != 'aside' or r.random() < 0.5 else ''}><h3>{_words(r, 2)}</h3>{r.choice([prose, _links(r, 4)])}</{tag}>"
    if kind == "comments":
        one = lambda: f'<{(t := r.choice(["div", "article", "li"]))} class="{r.choice(["comment", "comment-body", "reply", "comment even"])}"><p>{_words(r, r.randrange(4, 40))}</p></{t}>'
        return f"<{(t := r.choice(['div', 'section']))}{named}><h3>{_words(r, 1)}</h3>{''.join(one() for _ in range(r.randrange(1, 6)))}</{t}>"
    if kind == "pager":
        return r.choice([f"<div{named}><a>{_words(r, 1)}</a> <a>{_words(r, 1)}</a></div>", f"<form{named if r.random() < 0.5 else ''}><label>{_words(r, 2)}</label><input><button>{_words(r, 1)}</button></form>", f"<form><p>{_words(r, r.randrange(3, 12))}</p><button>{_words(r, 2)}</button></form>"])
    if kind == "notice" and r.random() < 0.3:
        return f'<dialog open>{prose}</dialog>' if r.random() < 0.5 else f'<div role="{r.choice(["alert", "dialog", "alertdialog", "banner", "complementary"])}">{prose}</div>'
    return f"<{(t := r.choice(['div', 'div', 'section', 'p']))}{named}>{prose if t != 'p' else _words(r, r.randrange(3, 25))}</{t}>"


def _content(r: random.Random, inside: bool) -> str:
    """Blocks of main text, now and then with another part between them."""
    out, title = [], f"<h1>{_words(r, r.randrange(2, 9))}</h1>"
    if r.random() < 0.3:
        title = f'<{(t := r.choice(["div", "header"]))} class="{r.choice(["entry-header", "article-header", "post-header", "story-header", "headline"])}">{title}</{t}>' if inside or r.random() < 0.5 else f"<div>{title}</div>"
    if r.random() < 0.85:
        out.append(f"«{title}»")
    for _ in range(r.randrange(1, 9)):
        kind = r.random()
        text = _words(r, r.choice([r.randrange(1, 8), r.randrange(8, 80)]))
        if kind < 0.55:
            out.append(f"«<p>{text}</p>»")
        elif kind < 0.62:
            out.append(f"«<h2>{_words(r, 3)}</h2><p>{text}</p>»")
        elif kind < 0.69:
            out.append(f"«<ul><li>{_words(r, 4)}</li><li>{text}</li></ul>»")
        elif kind < 0.74:
            out.append(f"«<blockquote>{text}</blockquote>»")
        elif kind < 0.79:
            out.append(f'«<p><b>{_words(r, 3)}</b> {text} <a href="/x">{_words(r, 2)}</a> {_words(r, 5)}</p>»')
        elif kind < 0.83:
            out.append(f'«<{(t := r.choice(["div", "figure", "p", "span"]))} class="{r.choice(INNER)}">{text}</{t}>»')
        elif kind < 0.9 and inside:
            a, b = r.sample(_TOPICS, 2)
            out.append(f'«<section {r.choice(["id", "id", "class"])}="{r.choice([f"{a}-{b}", f"sec-{a}", f"{a}-of-{b}", f"{a}-in-practice"])}"><h2>{a} {b}</h2><p>{text}</p></section>»')
        elif kind < 0.94:
            out.append(f"«<table><tr><td>{_words(r, 2)}</td><td>{_words(r, 3)}</td></tr></table>»" if inside else f"«<pre>{text}</pre>»")
        elif kind < 0.97:
            out.append(_part(r, r.choice(["advert", "advert", "share", "related", "notice", "sidebar", "pager"])))
        else:
            out.append(f"«<p>{text}<br>{_words(r, 12)}</p>»")
    return "".join(out)


def page(r: random.Random) -> str:
    kind = r.random()
    if kind < 0.35:
        body = f"<article{_named(r, CONTENT) if r.random() < 0.4 else ''}>{_content(r, True)}</article>"
        body = f"<main>{body}</main>" if r.random() < 0.3 else body
    elif kind < 0.45:
        body = f"<main{_named(r, CONTENT) if r.random() < 0.4 else ''}>{_content(r, True)}</main>"
    elif kind < 0.5:
        body = f'<div role="main">{_content(r, True)}</div>'
    elif kind < 0.75:
        body = f"<div{_named(r, CONTENT)}>{_content(r, True)}</div>"
        body = f"<div{_named(r, CONTENT)}>{body}</div>" if r.random() < 0.25 else body
    else:
        body = _content(r, False)
    if r.random() < 0.25:
        body = f"«<p>{_words(r, r.randrange(5, 40))}</p>»{body}"
    before = [_part(r, k) for k in r.sample(["menu", "menu", "header", "notice", "advert", "pager", "share"], r.randrange(1, 4))]
    after = [_part(r, k) for k in r.sample(["footer", "comments", "sidebar", "related", "share", "pager", "advert", "notice"], r.randrange(0, 5))] + ([_part(r, "footer")] if r.random() < 0.8 else [])
    whole = "".join(before) + body + "".join(after)
    for _ in range(r.randrange(3)):
        whole = f"<div{_named(r, WRAPPERS)}>{whole}</div>"
    if r.random() < 0.05:
        whole = f"<form id='aspnetForm'>{whole}</form>"
    top = f' class="{r.choice(WRAPPERS)}"' if r.random() < 0.3 else ""
    return f"<html><head><title>{_words(r, 4)}</title><script>var x='<p>';</script></head><body{top}>{whole}</body></html>"


def pages(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [page(r) for _ in range(n)]
