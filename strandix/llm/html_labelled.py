"""Labelled pages to train the extraction model on, generated from a seed.

Pages are put together from the parts that web pages have (site header, menu, notice, advert, article, sidebar,
reader comments, forms, footer) in many spellings of tags and class names. The label of a page is the set of its
content blocks; here each text says itself whether it is content: those words start with the mark.
"""

from __future__ import annotations

import random

MARK = "✓"

_SYLLABLES = "ba co di fu ge ha in jo ka lo mi ne on pe qui ra so te un va we xi yo zu än ér ño ch st ing the of and".split()
_CLASS = {
    "header": ["header", "site-header", "masthead", "top-bar", "page_header", "topnav"],
    "nav": ["nav", "menu", "main-menu", "navbar", "navigation", "breadcrumbs", "toc-links", "pagination"],
    "notice": ["notice", "cookie-notice", "cookie", "consent", "alert", "gdpr-banner", "paywall-message", "popup"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner"],
    "side": ["sidebar", "side", "widget", "related", "related-posts", "recommended", "trending", "most-read"],
    "comments": ["comments", "comment-list", "reader-comments", "responses", "discussion", "disqus"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "legal", "colophon"],
    "form": ["search", "login", "newsletter", "subscribe", "signup", "contact-form"],
    "share": ["share", "social", "share-buttons", "tags", "byline-tools"],
    "main": ["content", "post", "article", "article-body", "entry-content", "story", "post-content", "main", "text", "body-text"],
}


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int, mark: bool = False) -> str:
        r = self.r
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(lo, hi))]
        stops = r.random() < 0.8
        out = [w + (r.choice([".", ",", ",", "."]) if stops and r.random() < 0.15 else "") for w in out]
        return (MARK if mark else "") + " ".join(out).capitalize() + ("." if stops else "")

    def attr(self, kind: str) -> str:
        r = self.r
        name = r.choice(_CLASS[kind])
        return r.choice([f' class="{name}"', f' id="{name}"', f" class='x{r.randint(1, 9)} {name}'", f' class="{name} col-{r.randint(1, 12)}"'])

    def box(self, kind: str, inner: str, tags: list[str]) -> str:
        tag = self.r.choice(tags)
        plain = tag not in ("div", "section", "ul") and self.r.random() < 0.5
        return f"<{tag}{'' if plain else self.attr(kind)}>{inner}</{tag}>"

    def links(self, lo: int, hi: int) -> str:
        items = [f'<li><a href="/{i}">{self.words(1, 4)}</a></li>' for i in range(self.r.randint(lo, hi))]
        return "<ul>" + "".join(items) + "</ul>"

    def inline(self, text: str) -> str:
        r = self.r
        parts = text.split(" ")
        if len(parts) > 4 and r.random() < 0.4:
            i = r.randrange(1, len(parts) - 1)
            parts[i] = r.choice(["<a href='#'>{}</a>", "<b>{}</b>", "<em>{}</em>", "<span>{}</span>", "{}<br>"]).format(parts[i])
        return " ".join(parts)

    def article(self) -> str:
        r = self.r
        out = [f"<{(h := r.choice(['h1', 'h1', 'h2']))}>{self.words(2, 12, True)}</{h}>"]
        if r.random() < 0.15:
            out = [f"<header>{out[0]}</header>"]
        loose = r.random() < 0.3
        for _ in range(r.choice([1, 2, 3, 4, 6, 9])):
            k = r.random()
            text = self.inline(self.words(*r.choice([(1, 2), (3, 12), (15, 60), (40, 120)]), True))
            if k < 0.68:
                out.append((f"<p><b>{text}<br>" if r.random() < 0.3 else f"<p>{text}") if loose else f"<p>{text}</p>")
            elif k < 0.74:
                out.append(f"<h{(n := r.randint(2, 4))}>{self.words(1, 8, True)}</h{n}>")
            elif k < 0.80:
                out.append("<ul>" + "".join(f"<li>{self.words(3, 25, True)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.84:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif k < 0.87:
                out.append(f"<div>{text}</div>")
            elif k < 0.89:
                out.append("<table><tr>" + "".join(f"<td>{self.words(1, 6, True)}</td>" for _ in range(3)) + "</tr></table>")
            elif k < 0.93:
                out.append(self.ad())
            elif k < 0.96:
                out.append(self.box("share", self.links(2, 4), ["div", "ul"]))
            else:
                out.append(f"<script>var a = \"<p>{self.words(2, 5)}</p>\";</script>")
        tag = r.choice(["article", "article", "main", "div", "section"])
        return f"<{tag}{self.attr('main') if tag in ('div', 'section') or r.random() < 0.3 else ''}>" + "".join(out) + f"</{tag}>"

    def ad(self) -> str:
        return self.box("ad", self.r.choice(["{}", "<p>{}</p>", "<a href='#'>{}</a>"]).format(self.words(2, 18)), ["div", "div", "aside"])

    def form(self) -> str:
        return f"<form{self.attr('form') if self.r.random() < 0.6 else ''}><label>{self.words(1, 3)}</label><input name=q><p>{self.words(2, 12)}</p><button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        one = lambda: self.r.choice(["<div class='comment'><h4>{}</h4><p>{}</p></div>", "<li class=\"comment\"><b>{}</b><p>{}</p></li>"]).format(self.words(1, 2), self.words(3, 60))
        return self.box("comments", f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 5))) + (self.form() if self.r.random() < 0.4 else ""), ["div", "section", "div"])

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 4)}</h3>" + self.r.choice([self.links(2, 6), f"<p>{self.words(4, 40)}</p>", f"<div>{self.words(3, 30)}</div>"])
        return self.box("side", inner, ["aside", "aside", "div"])

    def html(self) -> str:
        r = self.r
        some = lambda p, f: [f()] if r.random() < p else []
        head = some(0.5, lambda: self.box("header", r.choice([f"<h2>{self.words(1, 3)}</h2>", f"<p>{self.words(2, 9)}</p>", f"<a href='/'>{self.words(1, 3)}</a>"]) + (self.box("nav", self.links(2, 6), ["nav"]) if r.random() < 0.4 else "") + (self.form() if r.random() < 0.2 else ""), ["header", "header", "div"]))
        head += some(0.7, lambda: self.box("nav", self.links(3, 8), ["nav", "nav", "div", "ul"]))
        head += some(0.3, lambda: self.box("notice", f"<p>{self.words(5, 40)}</p>" if r.random() < 0.6 else self.words(5, 40), ["div", "div", "section"]))
        head += some(0.6, self.ad)
        tail = some(0.4, self.side) + some(0.3, self.ad) + some(0.35, self.comments) + some(0.2, self.form)
        tail += some(0.8, lambda: self.box("footer", r.choice(["&copy; {}", "<p>{}</p>", "<p>&copy; {}</p>"]).format(self.words(3, 30)) + (self.links(1, 4) if r.random() < 0.3 else ""), ["footer", "footer", "div"]))
        tail += some(0.1, lambda: self.box("notice", f"<p>{self.words(5, 30)}</p>", ["div"]))
        main = self.article() if r.random() < 0.85 else self.article() + self.side()
        body = "".join(head) + main + "".join(tail)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<div{r.choice(['', ' class=wrapper', ' id=page', ' class=container'])}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{a:b}}</style></head><body>{body}" + r.choice(["</body></html>", ""])


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    return [_Page(seed * 1_000_003 + i).html() for i in range(n)]
