"""Labelled pages for the model of ``html_content``: composed by a seeded generator from parts whose label is known.

Attribute ``y`` is the label of an element and of what is in it: 1 for content, 0 for the rest. Layout elements that hold both
have none.
"""

from __future__ import annotations

import random

_WORDS = "time people city water music river report market school garden light road story house winter summer letter engine bridge paper north glass field paint voice table chair number plan idea friend window".split()
_CONTENT = ["content", "article-body", "post-content", "entry-content", "main", "story", "body-text", "main-text", "page-content", "single-post", "prose", "markdown-body", "c-article__body", "articleBody", "mainContent", "blog-post", "text"]
_NEUTRAL = ["row", "col-8", "container", "wrapper", "inner", "clearfix", "box", "u-mt-2", "lead", "section", "block", "grid"]
_ABOUT = ["has-sidebar", "with-ads", "no-comments", "layout has-header", "page-with-sidebar", "is-modal"]

#: What isn't content, by kind: (tags, classes or ids, fillings). Fillings: L links, S short text, T long text, F fields of a form.
NOISE = {
    "menu": (["nav", "nav", "div", "ul", "menu"], ["main-nav", "navbar", "top-menu", "breadcrumbs", "pagination", "toc", "tabs", "site-navigation", "skip-links", "toolbar"], ["LLLL", "LL", "L", "U", "U", "LONG"]),
    "header": (["header", "header", "div"], ["site-header", "masthead", "page-header", "topbar", "header"], ["SU", "S", "SS", "LLL", "LF"]),
    "footer": (["footer", "footer", "div"], ["footer", "site-footer", "colophon", "copyright", "legal", "bottom"], ["S", "SL", "SLLL", "TU", "T"]),
    "side": (["aside", "aside", "div"], ["sidebar", "right-rail", "widget-area", "widget", "side", "complementary"], ["SU", "ST", "T", "SLL", "TT"]),
    "more": (["div", "section", "aside", "ul"], ["related-posts", "recommended", "trending", "popular", "more-stories", "tags", "recirc"], ["SU", "LLL", "SLLL", "STL"]),
    "advert": (["div", "div", "aside", "section", "p", "span", "ins"], ["ad", "ads", "ad-slot", "advert-banner", "sponsored", "promo-box", "adsense", "advertisement", "outbrain", "promoted"], ["S", "T", "L", "SL", "TT"]),
    "notice": (["div", "div", "section", "dialog", "aside", "p"], ["cookie-notice", "cookie-consent", "gdpr-banner", "newsletter-signup", "popup", "modal", "alert", "paywall", "subscribe", "notice"], ["T", "S", "TL", "SF", "TF", "ST"]),
    "social": (["div", "ul", "p"], ["share-buttons", "social-links", "follow-us", "sharing"], ["LLL", "S", "SLL", "B"]),
    "talk": (["section", "div", "ol", "aside"], ["comments", "comment-list", "disqus_thread", "respond", "reviews", "discussion", "commentlist"], ["SCC", "CCC", "SC", "SCF", "TT", "ST"]),
    "form": (["form", "form", "div", "fieldset"], ["search-form", "contact-form", "form", "search"], ["F", "SF", "FF", "TF", "SB"]),
}
_BARE = {"menu": ["nav"], "header": ["header"], "footer": ["footer"], "side": ["aside"], "form": ["form", "fieldset"]}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        w = [self.r.choice(_WORDS) for _ in range(n)]
        w[0] = w[0].capitalize()
        return " ".join(w)

    def short(self) -> str:
        return self.words(self.r.randint(1, 6)) + self.r.choice(["", "", ".", ":"])

    def long(self) -> str:
        return " ".join(self.words(self.r.randint(6, 18)) + "." for _ in range(self.r.randint(2, 5)))

    def link(self, n: int = 3) -> str:
        return f"<a href='/x'>{self.words(self.r.randint(1, n))}</a>"

    def attributes(self, names: list[str], chance: float = 0.85) -> str:
        if self.r.random() > chance:
            return ""
        name = self.r.choice(names)
        return f" id='{name}'" if self.r.random() < 0.25 else f" class='{name}'" if self.r.random() < 0.7 else f" class='{self.r.choice(_NEUTRAL)} {name}'"

    def fill(self, how: str) -> str:
        out = []
        if how == "LONG":
            return self.link(24)
        for c in how:
            p = self.r.choice(["p", "p", "div", "span", "h3"])
            if c == "L":
                out.append(self.link() if self.r.random() < 0.6 else f"<p>{self.link(8)}</p>")
            elif c == "U":
                out.append("<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>")
            elif c == "S":
                out.append(f"<{p}>{self.short()}</{p}>" if self.r.random() < 0.7 else self.short())
            elif c == "T":
                out.append(f"<p>{self.long()}</p>" if self.r.random() < 0.8 else self.long())
            elif c == "C":
                tag = self.r.choice(["div", "li", "article"])
                out.append(f"<{tag} class='comment'><p class='comment-author'>{self.short()}</p><p>{self.long() if self.r.random() < 0.7 else self.short()}</p></{tag}>")
            elif c == "B":
                out.append(f"<button>{self.short()}</button>")
            elif c == "F":
                out.append(f"<form><label>{self.short()}</label><input name=q><p>{self.short()}</p><button>{self.short()}</button></form>" if self.r.random() < 0.5 else f"<label>{self.short()}</label> <input> <button>{self.short()}</button>")
        return " ".join(out)

    def noise(self, kind: str) -> str:
        tags, names, fillings = NOISE[kind]
        tag = self.r.choice(tags)
        marks = self.attributes(names, 0.5 if tag in _BARE.get(kind, ()) else 1.0)
        inner = self.fill(self.r.choice(fillings))
        if tag == "ul":
            inner = f"<li>{inner}</li>"
        if self.r.random() < 0.2:
            inner = f"<div class='{self.r.choice(_NEUTRAL)}'>{inner}</div>"
        return f"<{tag} y=0{marks}>{inner}</{tag}>"

    def block(self) -> str:
        k = self.r.random()
        if k < 0.5:
            mark = self.attributes(_NEUTRAL, 0.1)
            return f"<p{mark}>{self.long()}</p>"
        if k < 0.62:
            return f"<p>{self.short()}</p>"
        if k < 0.68:
            return f"<p>{self.long()} {self.link()} {self.long()}</p>"
        if k < 0.74:
            return f"<h{self.r.choice('234')}>{self.short()}</h2>" if self.r.random() < 0.2 else f"<h2>{self.short()}</h2>"
        if k < 0.80:
            tag = self.r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{self.r.choice([self.short, self.long])()}</li>" for _ in range(self.r.randint(2, 5))) + f"</{tag}>"
        if k < 0.84:
            return f"<blockquote><p>{self.long()}</p></blockquote>"
        if k < 0.87:
            return f"<figure><img src=x><figcaption>{self.short()}</figcaption></figure>"
        if k < 0.90:
            return "<table>" + "".join(f"<tr><td>{self.short()}<td>{self.short()}" for _ in range(3)) + "</table>"
        if k < 0.92:
            return f"<pre>{self.long()}</pre>"
        if k < 0.94:
            return f"<dl><dt>{self.short()}<dd>{self.long()}</dl>"
        if k < 0.96:
            return f"<p class='{self.r.choice(['byline', 'author', 'post-meta', 'date'])}'>{self.short()}</p>"
        return f"<div{self.attributes(_NEUTRAL, 0.5)}><p>{self.long()}</p><p>{self.r.choice([self.short, self.long])()}</p></div>"

    def story(self) -> str:
        head = f"<h1>{self.short()}</h1>"
        if self.r.random() < 0.2:
            head = f"<header y=1>{head}" + (f"<p>{self.short()}</p>" if self.r.random() < 0.5 else "") + "</header>"
        parts = [head] if self.r.random() < 0.75 else []
        short = self.r.random() < 0.3
        for _ in range(self.r.randint(1, 2) if short else self.r.randint(2, 7)):
            parts.append(f"<p>{self.long()}</p>" if short else self.block())
            if self.r.random() < 0.22:
                parts.append(self.noise(self.r.choice([k for k in NOISE if k != "header"])))
        if self.r.random() < 0.25:
            parts.append(self.noise(self.r.choice(["social", "more", "talk", "footer", "form", "notice"])))
        return "".join(parts)

    def wrapped(self, inner: str) -> str:
        for _ in range(self.r.randint(0, 3)):
            mark = self.attributes(_NEUTRAL if self.r.random() < 0.8 else _ABOUT, 0.7)
            inner = f"<div{mark}>{inner}</div>"
        return inner

    def page(self) -> str:
        before = [self.noise(self.r.choice(["menu", "header", "notice", "advert"])) for _ in range(self.r.randint(0, 3))]
        after = [self.noise(self.r.choice(["footer", "side", "talk", "more", "form", "advert", "notice", "social", "menu"])) for _ in range(self.r.randint(0, 4))]
        layout = self.r.randint(0, 6)
        if layout <= 1:
            story = f"<article y=1{self.attributes(_CONTENT, 0.3)}>{self.story()}</article>"
            if self.r.random() < 0.5:
                story = f"<main>{story}{''.join(after[:1])}</main>"
        elif layout == 2:
            story = f"<main y=1{self.attributes(_CONTENT, 0.3)}>{self.story()}</main>"
        elif layout <= 4:
            story = f"<div y=1{self.attributes(_CONTENT, 1.0)}>{self.story()}</div>"
        elif layout == 5:
            story = f"<table><tr><td>{''.join(before[:1])}</td><td y=1>{self.story()}</td></tr></table>"
        else:
            story = f"<div y=1{self.attributes(_NEUTRAL, 0.5)}>{self.story()}</div>"
        whole = "".join(before) + self.wrapped(story) + "".join(after)
        if self.r.random() < 0.15:
            whole = f"<form{self.attributes(['aspnetForm', 'form1'], 0.5)} method=post>{whole}</form>"
        return self.wrapped(whole)


def labelled_pages(n: int = 300, seed: int = 11) -> list[str]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
