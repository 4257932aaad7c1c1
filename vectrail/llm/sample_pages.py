"""Labelled pages made from a seed, to learn what main text looks like among the rest of a page.

Every run of text starts with a mark telling main text from the rest. Words are random syllables,
so nothing is learned of any language; layouts, tags, class names, lengths and places vary. Page k of a
seed is always the same, and no pages are an empty list.
"""

from __future__ import annotations

import random

MAIN, REST = "", ""
SYLLABLES = "an ba che do en fi gra ho in ka lu me no or pe qui ra so ti un ve wi xa yo zu".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, n: int) -> str:
        out, left = [], 0
        for k in range(n):
            w = self.word()
            if left == 0:
                w, left = w.capitalize(), self.r.randint(1, 18)
            left -= 1
            if left == 0 or k == n - 1:
                w += self.r.choice(".......!?")
                left = 0
            out.append(w)
        return " ".join(out)

    def length(self) -> int:
        return self.r.choice((1, 2, 3, self.r.randint(4, 15), self.r.randint(10, 60), self.r.randint(20, 120), self.r.randint(60, 500)))

    def pick(self, *options):
        return self.r.choice(options)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def tag(self, tag: str, inner: str, name: str = "") -> str:
        if name:
            name = " " + self.pick("class", "class", "id") + '="' + self.pick(name, name, f"{name} {self.word()}", f"site-{name}") + '"'
        return f"<{tag}{name}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        own = [f'<li><a href="/{self.word()}">{REST}{self.words(self.r.randint(1, 3)).rstrip(".!?")}</a></li>' for _ in range(n)]
        return self.tag(self.pick("ul", "ul", "ol"), "".join(own), self.pick("", "", "menu"))

    def rest(self, low: int = 2, high: int = 30) -> str:
        return REST + self.words(self.r.randint(low, high))

    # Parts of a page that aren't main text.
    def nav(self) -> str:
        if self.chance(0.2):
            flat = " | ".join(f'<a href="/{self.word()}">{REST}{self.word()}</a>' for _ in range(self.r.randint(3, 8)))
            return self.tag(self.pick("nav", "div", "p"), flat, self.pick("breadcrumbs", "navigation", "menu"))
        inner = self.links(self.r.randint(2, 9))
        return self.pick(self.tag("nav", inner), self.tag("nav", inner, "navbar"), self.tag("div", inner, self.pick("menu", "nav", "topnav")), self.tag("nav", inner, "pagination"))

    def header(self) -> str:
        inner = self.tag(self.pick("div", "p", "h1", "h2", "span", "a"), self.rest(1, 6)) + (self.tag("p", self.rest(3, 14)) if self.chance(0.5) else "") + (self.nav() if self.chance(0.4) else "")
        return self.pick(self.tag("header", inner), self.tag("header", inner, "masthead"), self.tag("div", inner, self.pick("header", "topbar", "branding")))

    def footer(self) -> str:
        inner = self.pick(f"{REST}&copy; {self.word()} &middot; {self.words(self.r.randint(2, 15))}", self.tag("p", self.rest(3, 30)), self.links(4) + self.tag("p", f"{REST}Copyright {self.word()}"), self.rest(2, 20))
        return self.pick(self.tag("footer", inner), self.tag("footer", inner), self.tag("div", inner, self.pick("footer", "copyright", "colophon")))

    def side(self) -> str:
        inner = "".join(self.pick(self.tag("h3", self.rest(1, 4)) + self.links(self.r.randint(2, 6)), self.tag("p", self.rest(4, 80)), self.tag("div", self.tag("p", self.rest(3, 40)), "widget"), self.rest(4, 30)) for _ in range(self.r.randint(1, 3)))
        return self.pick(self.tag("aside", inner), self.tag("aside", inner, "sidebar"), self.tag("div", inner, self.pick("sidebar", "secondary", "rail")))

    def advert(self) -> str:
        inner = self.pick(self.rest(2, 25), self.rest(2, 25), self.tag("p", self.rest(3, 40)), self.tag("a", self.rest(2, 12)))
        return self.tag(self.pick("div", "div", "section", "aside", "ins", "div" if "<p" in inner else "p"), inner, self.pick("ad", "ads", "advert", "sponsored", "promo", "banner", "advertisement"))

    def notice(self) -> str:
        inner = self.pick(self.rest(4, 40), self.tag("p", self.rest(4, 40)), self.tag("p", self.rest(4, 30)) + self.tag("button", self.rest(1, 3)))
        return self.tag(self.pick("div", "div", "section", "aside"), inner, self.pick("cookie-notice", "cookie-consent", "notice", "alert", "newsletter", "popup", "subscribe", "gdpr", "announcement", "disclaimer"))

    def form(self) -> str:
        inner = self.pick("", self.tag("p", self.rest(3, 20)), self.tag("h3", self.rest(1, 5))) + f"<label>{self.rest(1, 4)}</label><input type=text>" + self.pick("", f"<select><option>{self.rest(1, 2)}<option>{self.rest(1, 2)}</select>", f"<textarea>{self.rest(1, 9)}</textarea>") + self.tag("button", self.rest(1, 2))
        return self.pick(self.tag("form", inner), self.tag("form", inner, self.pick("search", "login", "contact", "signup")), self.tag("div", self.tag("form", inner), "search"))

    def share(self) -> str:
        return self.tag(self.pick("div", "section", "ul"), self.pick(self.links(3), self.tag("h4", self.rest(1, 4)) + self.links(4), self.rest(1, 6)), self.pick("share", "social", "related", "recommended", "trending", "tags"))

    def comments(self) -> str:
        one = lambda: self.pick(
            self.tag("div", self.tag("p", self.rest(2, 90)), "comment"),
            self.tag("li", self.tag("b", self.rest(1, 2)) + self.tag("p", self.rest(2, 60)), "comment"),
            self.tag("div", self.tag("span", self.rest(1, 3)) + " " + self.rest(3, 60), "comment"),
            self.tag("article", self.tag("p", self.rest(3, 70)), "comment"),
            self.tag("p", self.rest(3, 70)),
        )
        inner = self.pick("", self.tag("h3", self.rest(1, 3)), self.tag("h2", self.rest(1, 3))) + "".join(one() for _ in range(self.r.randint(1, 6))) + (self.form() if self.chance(0.3) else "")
        return self.tag(self.pick("div", "section", "section", "ol", "aside"), inner, self.pick("comments", "comments", "commentlist", "comment-section", "responses replies", "discussion", "reader-comments"))

    def meta(self) -> str:
        return self.tag(self.pick("div", "p"), self.rest(2, 8), self.pick("byline", "meta", "post-meta", "date"))

    # Main text.
    def block(self) -> str:
        kind = self.r.random()
        text = MAIN + self.words(self.length())
        if kind < 0.55:
            return self.pick(f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p>{text} <a href=/x>{self.words(2)}</a> {self.words(5)}</p>", f"<p class={self.word()}>{text}</p>")
        if kind < 0.65:
            return self.tag(self.pick("h2", "h3", "h4"), MAIN + self.words(self.r.randint(1, 8)).rstrip("."))
        if kind < 0.73:
            return self.tag(self.pick("ul", "ol"), "".join(f"<li>{MAIN}{self.words(self.r.randint(1, 25))}</li>" for _ in range(self.r.randint(1, 6))))
        if kind < 0.78:
            return self.tag("blockquote", self.pick(text, f"<p>{text}</p>"))
        if kind < 0.82:
            return f"<pre>{text}</pre>"
        if kind < 0.87:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{MAIN}{self.words(self.r.randint(1, 6))}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(1, 4))) + "</table>"
        if kind < 0.91:
            return f"<figure><img src=x><figcaption>{MAIN}{self.words(self.r.randint(2, 15))}</figcaption></figure>"
        if kind < 0.95:
            return self.tag("div", text)
        return f"<section><h2>{MAIN}{self.words(3)}</h2><p>{text}</p></section>"

    def article(self) -> str:
        parts = [self.block() for _ in range(self.pick(1, 1, 2, 3, self.r.randint(3, 10), self.r.randint(5, 25)))]
        title = self.pick("", self.tag("h1", MAIN + self.words(self.r.randint(1, 14))), self.tag("h1", MAIN + self.words(self.r.randint(1, 14))), f"<header><h1>{MAIN}{self.words(6)}</h1></header>")
        for maker, p in ((self.advert, 0.25), (self.notice, 0.15), (self.share, 0.2), (self.form, 0.1), (self.side, 0.12)):
            if self.chance(p):
                parts.insert(self.r.randint(0, len(parts)), maker())
        tail = (self.comments() if self.chance(0.2) else "") + (self.share() if self.chance(0.1) else "") + (self.footer_in() if self.chance(0.08) else "")
        return title + "".join(parts) + tail

    def footer_in(self) -> str:
        return self.tag("footer", self.rest(2, 12))

    def page(self) -> str:
        if self.chance(0.03):
            return self.pick(MAIN + self.words(self.r.randint(5, 200)), "".join(f"<p>{MAIN}{self.words(self.length())}</p>" for _ in range(5)))
        inner = self.article()
        main = self.pick(
            self.tag("article", inner), self.tag("article", inner), self.tag("article", inner, self.pick("post", "story", "entry")), self.tag("main", inner),
            self.tag("main", self.tag("article", inner)), self.tag("div", inner, self.pick("content", "post-content", "entry-content", "article-body", "story", "main")),
            self.tag("div", self.tag("div", inner), "content"), self.tag("section", inner, "content"), inner, self.tag("div", inner),
            f'<table><tr><td>{inner}</td></tr></table>',
        )
        above = [f() for f, p in ((self.header, 0.5), (self.nav, 0.7), (self.notice, 0.25), (self.advert, 0.4), (self.form, 0.12), (self.side, 0.2)) if self.chance(p)]
        self.r.shuffle(above)
        below = [f() for f, p in ((self.side, 0.3), (self.advert, 0.25), (self.comments, 0.3), (self.share, 0.2), (self.notice, 0.15), (self.form, 0.1), (self.nav, 0.12)) if self.chance(p)]
        self.r.shuffle(below)
        if self.chance(0.85):
            below.append(self.footer())
        body = "".join(above) + main + "".join(below)
        if self.chance(0.25):
            body = self.tag("div", body, self.pick("", "wrapper", "container", "page"))
        return f"<!DOCTYPE html><html><head><title>{REST}{self.words(4)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def pages(n: int, seed: int) -> list[str]:
    return [Maker(seed * 1_000_003 + k).page() for k in range(n)]
