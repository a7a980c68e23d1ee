"""Labelled pages from which the extraction model is trained.

Every block's label is that of its nearest ancestor, itself included, with
``data-main``: 1 for main text, 0 for all else.  The pages are invented: each
puts together parts that its number selects, so that menus, adverts, notices,
comments and articles of all lengths stand in many places.  On some pages names
say nothing: classes and ids are replaced by made-up ones, or an article carries
the names of its topics, which may be those of other things.
"""

from __future__ import annotations

import re

PAGES = 1500
_WORDS = ("the river wall was built by hand and it holds when rain comes over the hill so people in town walk there every day "
          "to look at boats that bring stone from far away while children count gulls").split()


class _Choice:
    """Fixed choices for one page: a linear congruential sequence."""

    def __init__(self, seed: int):
        self.state = seed * 2654435761 % 2**32

    def below(self, n: int) -> int:
        self.state = (self.state * 1664525 + 1013904223) % 2**32
        return (self.state >> 8) % n

    def of(self, options):
        return options[self.below(len(options))]

    def sentence(self) -> str:
        n = 1 + self.below(24)
        at = self.below(len(_WORDS))
        text = " ".join(_WORDS[(at + i * 7) % len(_WORDS)] for i in range(n))
        return text.capitalize() + self.of((".", ".", ".", ".", "?", "!", ""))

    def text(self) -> str:
        return " ".join(self.sentence() for _ in range(self.of((1, 1, 2, 4, 9))))


def _menu(c: _Choice) -> str:
    links = [f'<a href="/{i}">{c.of(_WORDS)} {c.of(("", c.of(_WORDS)))}</a>' for i in range(2 + c.below(7))]
    return c.of(("<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>", " | ".join(links), "".join(f"<div>{x}</div>" for x in links)))


def _paragraphs(c: _Choice, most: int = 4) -> str:
    return "".join(f"<p>{c.text()}</p>" for _ in range(1 + c.below(most)))


def _remark(c: _Choice) -> str:
    """A reader's comment: often with a name, a date or a link to answer."""
    name = c.of(("", f"<b>{c.of(_WORDS).capitalize()}</b>: ", f"<h4>{c.of(_WORDS).capitalize()} {c.of(_WORDS).capitalize()}</h4>", f"<span>{1 + c.below(28)} {c.of(('May', 'June', 'March'))} {2001 + c.below(24)}</span> "))
    answer = c.of(("", "", f'<a href="#r{c.below(99)}">{c.of(("Reply", "Answer", "Report", "Like"))}</a>'))
    return c.of((f"<p>{name}{c.sentence()}</p>{answer}", f"{name}<p>{c.text()}</p>{answer}", f"<p>{name}{c.text()} {answer}</p>"))


def _other(c: _Choice, where: str) -> str:
    """Something that is not main text."""
    kinds = {
        "top": (lambda: f'<nav data-main="0">{_menu(c)}</nav>', lambda: f'<header data-main="0">{c.of((_menu(c), f"<p>{c.text()}</p>", f"<h1>{c.sentence()}</h1>{_menu(c)}"))}</header>',
                lambda: f'<div class="{c.of(("navbar", "main-menu", "site-header", "top nav", "breadcrumbs", "masthead"))}" data-main="0">{c.of((_menu(c), _paragraphs(c, 1)))}</div>',
                lambda: f'<div id="{c.of(("menu", "header", "navigation"))}" data-main="0">{_menu(c)}</div>', lambda: f'<ul class="menu" data-main="0"><li>{c.sentence()}</li><li>{c.sentence()}</li></ul>'),
        "side": (lambda: f'<aside data-main="0"><h3>{c.sentence()}</h3>{c.of((_menu(c), _paragraphs(c)))}</aside>',
                 lambda: f'<div class="{c.of(("sidebar", "widget", "related", "right sidebar", "promo-box"))}" data-main="0">{c.of((_menu(c), _paragraphs(c)))}</div>',
                 lambda: f'<section class="related" data-main="0"><h2>{c.sentence()}</h2>{_menu(c)}</section>'),
        "within": (lambda: f'<div class="{c.of(("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner"))}" data-main="0">{c.of((c.text(), _paragraphs(c, 2)))}</div>',
                   lambda: f'<div class="{c.of(("newsletter", "share", "social-share", "related", "subscribe"))}" data-main="0">{c.of((_menu(c), _paragraphs(c, 2)))}</div>',
                   lambda: f'<form data-main="0">{c.of(("", "<p>" + c.sentence() + "</p>"))}<label>{c.of(_WORDS)}</label><input name="q"></form>', lambda: f'<aside data-main="0">{_paragraphs(c, 2)}</aside>'),
        "notice": (lambda: f'<div class="{c.of(("notice", "cookie-banner", "cookie-notice", "gdpr consent", "alert", "popup", "modal"))}" data-main="0">{c.of((c.text(), _paragraphs(c, 2)))}</div>',
                   lambda: f'<div id="{c.of(("cookies", "consent", "notice"))}" data-main="0">{_paragraphs(c, 2)}</div>', lambda: f'<div role="{c.of(("banner", "alert", "search", "navigation"))}" data-main="0">{_paragraphs(c, 1)}</div>',
                   lambda: f'<section class="notice" data-main="0">{_paragraphs(c, 2)}</section>', lambda: f'<p class="notice" data-main="0">{c.text()}</p>', lambda: f'<dialog data-main="0">{_paragraphs(c, 2)}</dialog>'),
        "comments": (lambda: f'<section class="{c.of(("comments", "comments", "feedback", "discussion", "responses"))}" data-main="0"><h3>{c.sentence()}</h3>' + "".join(f'<div class="comment">{_remark(c)}</div>' for _ in range(1 + c.below(5))) + "</section>",
                     lambda: f'<div id="{c.of(("comments", "disqus_thread", "replies", "reactions"))}" data-main="0"><ol>' + "".join(f"<li>{_remark(c)}</li>" for _ in range(1 + c.below(5))) + "</ol></div>",
                     lambda: f'<div class="{c.of(("reader-comments", "feedback", "readers"))}" data-main="0">' + "".join(f'<article class="comment">{_remark(c)}</article>' for _ in range(1 + c.below(4))) + "</div>",
                     lambda: f'<ul class="{c.of(("comment-list", "opinions"))}" data-main="0">' + "".join(f"<li>{c.text()}</li>" for _ in range(1 + c.below(5))) + "</ul>",
                     lambda: f'<{c.of(("div", "section"))} {c.of(("class", "id"))}="{c.of(("comments", "comments", "comment", "replies"))}" data-main="0">{_paragraphs(c, 3)}</div></section>',
                     lambda: "".join(f'<div class="comment" data-main="0">{c.of((c.text(), _paragraphs(c, 1)))}</div>' for _ in range(1 + c.below(3))),
                     lambda: f'<div class="{c.of(("feedback", "comments", "responses"))}" data-main="0">' + "".join(f"<div>{_remark(c)}</div>" for _ in range(1 + c.below(5))) + "</div>"),
        "end": (lambda: f'<footer data-main="0">{c.of(("&copy; " + c.text(), _menu(c), _paragraphs(c, 2), c.text()))}</footer>',
                lambda: f'<div class="{c.of(("footer", "site-footer", "legal", "page-footer"))}" data-main="0">{c.of((c.text(), _menu(c), _paragraphs(c, 2)))}</div>', lambda: f'<div id="footer" data-main="0">{c.text()}</div>'),
    }
    return c.of(kinds[where])()


def _few(c: _Choice) -> str:
    """Two to six words, with or without a full stop."""
    at = c.below(len(_WORDS))
    return " ".join(_WORDS[(at + i * 5) % len(_WORDS)] for i in range(1 + c.below(6))).capitalize() + c.of(("", "", "."))


def _list(c: _Choice) -> str:
    """A list of an article: ingredients, steps, terms, works with links; its items may be as short as those of a menu."""
    n = 1 + c.below(8)
    item = c.of((lambda: _few(c), lambda: _few(c), lambda: c.sentence(), lambda: f"{1 + c.below(900)} {_few(c)}", lambda: f'<a href="/{c.below(99)}">{_few(c)}</a>', lambda: f'<a href="/{c.below(99)}">{_few(c)}</a> {c.of(("", "-", ","))} {_few(c)}', lambda: f"<b>{_few(c)}</b> {c.text()}", lambda: f"<p>{_few(c)}</p>"))
    kind = c.of(("ul", "ul", "ol", "ol", "dl", "table"))
    if kind == "dl":
        return "<dl>" + "".join(f"<dt>{_few(c)}</dt><dd>{item()}</dd>" for _ in range(n)) + "</dl>"
    if kind == "table":
        return "<table>" + c.of(("", f"<tr><th>{_few(c)}</th><th>{_few(c)}</th></tr>")) + "".join(f"<tr><td>{_few(c)}</td><td>{c.below(5000)}</td></tr>" for _ in range(n)) + "</table>"
    close = c.of(("</li>", "</li>", ""))
    return f"<{kind}>" + "".join(f"<li>{item()}{close}" for _ in range(n)) + f"</{kind}>"


def _body(c: _Choice) -> str:
    """Blocks of main text, at times with something else between."""
    out = [c.of(("", "", f"<h1>{c.sentence()}</h1>", f"<h1>{c.sentence()}</h1>", f"<header><h1>{c.sentence()}</h1></header>"))]
    for _ in range(1 + c.below(7)):
        out.append(c.of((f"<p>{c.text()}</p>", f"<p>{c.text()}</p>", f"<p>{c.text()}</p>", f"<p>{c.sentence()} <a href='/x'>{c.sentence()}</a> {c.text()}</p>", f"<p><b>{c.text()}<br><p>{c.text()}</p>",
                         f"<h2>{c.sentence()}</h2><p>{c.text()}</p>", f"<ul><li>{c.text()}</li><li>{c.text()}</li></ul>", f"<blockquote>{c.of((c.text(), _paragraphs(c, 2)))}</blockquote>",
                         f"<table><tr><td>{c.sentence()}</td><td>{c.sentence()}</td></tr></table>", f"<pre>{c.text()}</pre>", f"<figure><figcaption>{c.sentence()}</figcaption></figure>", f"<div>{c.text()}</div>",
                         f"<section><h2>{c.sentence()}</h2>{_paragraphs(c)}</section>", f"<dl><dt>{c.sentence()}</dt><dd>{c.text()}</dd></dl>", f"<div>{_paragraphs(c)}</div>")))
        if c.below(3) == 0:
            out.append(c.of((_list(c), _list(c), f"<h{2 + c.below(2)}>{_few(c)}</h2>{_list(c)}", f"<p>{_few(c)}:</p>{_list(c)}")))
        if c.below(5) == 0:
            out.append(_other(c, c.of(("within", "within", "notice"))))
    return "".join(out)


def _topics(c: _Choice) -> str:
    """Names that an article has for what it is about; they may be those of menus, adverts and the like."""
    if c.below(3):
        return ""
    topics = ("advert", "advertising", "newsletter", "comments", "footer", "header", "menu", "sidebar", "sponsored", "notice", "banner", "nav", "related", "share", "promo", "cookies", "social", "widget", "news", "town")
    of = lambda: c.of((f"tag-{c.of(topics)}", f"category-{c.of(topics)}", f"topic-{c.of(topics)}", f"{c.of(topics)}-guidelines", f"post-{c.of(topics)}"))
    return f' class="{c.of(("post", "entry", "article-body", "hentry", "story"))} {of()} {of()}"'


def _article(c: _Choice) -> str:
    body, after = _body(c), _other(c, "comments") if c.below(3) == 0 else ""
    kind = c.below(12)
    if kind < 3:
        return f'<article{_topics(c)} data-main="1">{body}{after}</article>'
    if kind == 3:
        return f'<main{_topics(c)} data-main="1">{body}{after}</main>'
    if kind in (8, 9):
        return f'<div{_topics(c)} data-main="1">{body}{after}</div>'
    if kind == 4:
        return f'<main><article data-main="1">{body}</article>{after}</main>'
    if kind == 5:
        return f'<div data-main="1">{body}</div>{after}'
    if kind == 6:
        return f'<article><div class="{c.of(("entry-content", "post-body", "article-text"))}" data-main="1">{body}</div>{after}</article>'
    return f'<div class="{c.of(("post-content", "content", "story", "article", "text", "entry", "main-content", "post"))}" data-main="1">{body}{after}</div>'


def labelled_page(number: int) -> str:
    c = _Choice(number)
    if c.below(8) == 0:  # nothing around the article
        return _renamed(c, f'<body data-main="1">{"".join(_other(c, "top") for _ in range(c.below(2)))}{_body(c)}{"".join(_other(c, c.of(("end", "comments", "side"))) for _ in range(c.below(3)))}</body>')
    top = "".join(_other(c, "top") for _ in range(c.below(3)))
    if c.below(3) == 0:
        top += _other(c, "notice")
    if c.below(3) == 0:
        top += _other(c, "within")
    main = _article(c) if c.below(20) else ""
    side = _other(c, "side") if c.below(2) else ""
    comments = _other(c, "comments") if c.below(4) == 0 else ""
    middle = c.of((main + side, side + main)) + comments
    middle = c.of((middle, f"<div>{middle}</div>", f'<div id="wrapper" class="{c.of(("page", "container", "row"))}">{middle}</div>'))
    end = "".join(_other(c, "end") for _ in range(c.below(3)))
    return _renamed(c, f"<html><head><title>{c.sentence()}</title></head><body>{top}{middle}{end}</body></html>")


def _renamed(c: _Choice, page: str) -> str:
    """At times every class and id is another word that says nothing."""
    if c.below(6):
        return page
    names: dict[str, str] = {}

    def other(m):
        made = "".join(chr(97 + c.below(26)) for _ in range(3 + c.below(4))) + str(c.below(99))
        return f'{m[1]}="{names.setdefault(m[2], made)}"'

    return re.sub(r'\b(class|id)="([^"]*)"', other, page)


def labelled_pages(n: int = PAGES) -> list[str]:
    return [labelled_page(i) for i in range(1, n + 1)]
