"""Labelled pages from which the weights of text extraction are learned.

Pages are put together from a seed: site layouts of many kinds, with and without telling element and class names, around
main text of invented words. Every text is written with whether it is main text, so the labels are exact."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

_PARTS = "ba do ke li mo nu ra se ti vo an er ing on ver schö é ción le ter str pla gre mi sa".split()
#: Words of any text, so that they tell nothing.
_COMMON = "a all and are at by for free go half in is it new next now of on one or order our out read site system text the this time to top up use was we week what you your".split()
#: Names that sites give to elements of each kind; a site may as well give none or invented ones.
_NAMES = {
    "nav": ["nav", "navbar", "menu", "main-menu", "navigation", "topnav", "breadcrumb", "breadcrumbs", "toolbar", "pagination"],
    "header": ["header", "site-header", "masthead", "topbar", "branding"],
    "footer": ["footer", "site-footer", "page-footer", "copyright", "contentinfo", "colophon", "imprint"],
    "side": ["sidebar", "side-bar", "related", "related-posts", "recommended", "popular", "most-read", "widget", "widget-area", "complementary", "teasers"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "sponsor", "promo", "promotion", "banner", "ad-box"],
    "notice": ["cookie", "cookies", "cookie-notice", "consent", "notice", "popup", "modal", "newsletter", "newsletter-signup", "subscribe", "alert", "disclaimer", "signup", "overlay"],
    "share": ["share", "sharing", "social", "social-links", "share-buttons"],
    "comments": ["comments", "comment-list", "comment", "replies", "disqus", "respond", "reader-comments", "discussion"],
    "main": ["content", "article", "post", "entry", "entry-content", "story", "text", "body", "article-body", "post-content", "main", "page-content", "prose"],
    "frame": ["wrapper", "container", "page", "site", "row", "col", "widget-container", "elementor-widget-container", "section", "inner", "layout", "form-wrapper", "header-layout"],
}
_LABELS = {
    "nav": ["Home", "News", "About us", "Contact", "Sport", "Culture", "Archive", "Shop", "Sign in", "Next page", "Start page of this site", "Skip to content"],
    "notice": ["We use cookies to improve this site.", "This site uses cookies. By going on you accept them.", "Sign up for our newsletter", "Subscribe today and save a third of the price", "Your browser is out of date.", "Accept all"],
    "side": ["Related", "Most read", "Read more", "Popular this week", "You may also like", "Latest posts", "Tags", "See also"],
    "comments": ["Comments", "3 comments", "Discussion", "Leave a reply", "Responses", "What readers say"],
    "footer": ["All rights reserved", "Terms of use", "Privacy", "Imprint", "Contact", "Powered by a free system", "Back to top"],
    "ad": ["Advertisement", "Sponsored", "Buy now at half the price", "Limited offer, order today"],
    "share": ["Share", "Print", "Send by mail", "Like this"],
    "form": ["Name", "E-mail", "Search", "Your message", "Send", "Password", "Remember me"],
}


@dataclass
class Page:
    """A page as it is written: markup, and the blocks of main text in order."""

    rng: random.Random
    plain: bool  # no telling names at all
    html: list[str] = field(default_factory=list)
    main: list[str] = field(default_factory=list)

    def word(self) -> str:
        if self.rng.random() < 0.2:
            return self.rng.choice(_COMMON)
        return "".join(self.rng.choices(_PARTS, k=self.rng.randint(1, 4)))

    def sentence(self, low: int, high: int) -> str:
        w = [self.word() for _ in range(self.rng.randint(low, high))]
        for i in range(len(w) - 1):
            if self.rng.random() < 0.07:
                w[i] += ","
        return " ".join(w).capitalize() + self.rng.choice([".", ".", ".", "?", "!", "", ""])

    def prose(self) -> str:
        r = self.rng
        kind = r.random()
        return self.sentence(1, 4) if kind < 0.12 else self.sentence(4, 14) if kind < 0.35 else " ".join(self.sentence(4, 18) for _ in range(r.randint(2, 7)))

    def name(self, kind: str) -> str:
        r = self.rng
        if r.random() < (0.9 if self.plain else 0.15):
            return r.choice(["", "", f' class="{self.word()}-{r.randint(1, 99)}"'])
        return f' {r.choice(["class", "class", "class", "id"])}="{r.choice(_NAMES[kind])}{r.choice(["", "", "", " " + self.word(), "-" + self.word()])}"'

    def put(self, *parts: str) -> None:
        self.html += parts

    def element(self, tags: list[str], kind: str, inner) -> None:
        tag = self.rng.choice(["div", "section"] if self.plain and self.rng.random() < 0.7 else tags)
        self.put(f"<{tag}{self.name(kind)}>")
        inner()
        self.put(f"</{tag}>" if self.rng.random() < 0.97 or tag not in ("li", "p") else "")

    def links(self, n: int, labels: list[str]) -> None:
        r = self.rng
        listed = r.random() < 0.7
        self.put("<ul>" if listed else "")
        for _ in range(n):
            text = r.choice(labels) if r.random() < 0.5 else self.sentence(1, 5)
            self.put("<li>" if listed else "", f'<a href="/{self.word()}">{text}</a>', r.choice(["</li>", "</li>", ""]) if listed else r.choice([" ", " | ", " &middot; "]))
        self.put("</ul>" if listed else "")

    def text(self, tag: str, text: str, main: bool) -> None:
        """One block; main text may hold markup and links within."""
        r = self.rng
        shown = text
        if main:
            self.main.append(text)
            w = text.split(" ")
            for _ in range(r.choice([0, 0, 1, 2])):
                i = r.randrange(len(w))
                t = r.choice(["a href='/x'", "b", "i", "em", "label", "span class=n", "a href=/y"])
                if "<" not in w[i] and r.random() < 0.8:
                    w[i] = f"<{t}>{w[i]}</{t.split()[0]}>"
            shown = r.choice([" ", " ", "\n"]).join(w)
        closing = f"</{tag}>" if r.random() < 0.9 or tag not in ("p", "li") else ""
        self.put(f"<{tag}>{'<b>' if main and r.random() < 0.04 else ''}{shown}{'<br>' if r.random() < 0.05 else ''}{closing}", r.choice(["", "\n"]))

    # What surrounds the main text

    def nav(self) -> None:
        self.element(["nav", "nav", "div", "ul"], "nav", lambda: self.links(self.rng.randint(2, 9), _LABELS["nav"]))

    def header(self) -> None:
        def inner():
            self.put(f'<a href="/">{self.sentence(1, 3)}</a>')
            if self.rng.random() < 0.5:
                self.form()
            if self.rng.random() < 0.5:
                self.nav()
            if self.rng.random() < 0.4:
                self.text("p", self.sentence(2, 8), False)

        self.element(["header", "header", "div"], "header", inner)

    def form(self) -> None:
        def inner():
            self.put("<form>" if self.rng.random() < 0.7 else "<form action='/s'>")
            for _ in range(self.rng.randint(1, 3)):
                self.put(f"<label>{self.rng.choice(_LABELS['form'])}</label><input name=q> ", self.rng.choice(["", "<p>", "<br>"]))
            self.put(f"<button>{self.rng.choice(_LABELS['form'])}</button></form>")

        self.element(["div", "section"], "notice", inner) if self.rng.random() < 0.4 else inner()

    def notice(self) -> None:
        def inner():
            self.text("p" if self.rng.random() < 0.5 else "span", self.rng.choice(_LABELS["notice"]) if self.rng.random() < 0.6 else self.sentence(4, 16), False)
            self.put(f"<button>{self.sentence(1, 2)}</button>" if self.rng.random() < 0.6 else "")

        self.element(["div", "aside", "section", "dialog"], "notice", inner)

    def ad(self) -> None:
        def inner():
            if self.rng.random() < 0.3:
                self.put(self.rng.choice(_LABELS["ad"]), " ")
            self.text(self.rng.choice(["p", "span", "div"]), self.sentence(3, 18), False)

        self.element(["div", "div", "aside"], "ad", inner)

    def share(self) -> None:
        self.element(["div", "ul"], "share", lambda: self.links(self.rng.randint(2, 4), _LABELS["share"]))

    def side(self) -> None:
        def inner():
            self.put(f"<h3>{self.rng.choice(_LABELS['side'])}</h3>" if self.rng.random() < 0.7 else "")
            if self.rng.random() < 0.5:
                self.links(self.rng.randint(2, 6), _LABELS["side"])
            else:
                self.teasers()

        self.element(["aside", "aside", "div", "section"], "side", inner)

    def teasers(self) -> None:
        """Other stories in short, linked by their headings."""
        tag, level = self.rng.choice(["article", "article", "div", "li"]), self.rng.choice([2, 3, 3, 4])
        for _ in range(self.rng.randint(1, 3)):
            self.put(f"<{tag}><h{level}><a href=/t>{self.sentence(2, 7)}</a></h{level}>")
            self.text("p", self.sentence(3, 14), False)
            self.put(f"<a href=/t>{self.rng.choice(['Read more', 'More', 'Go on reading'])}</a>" if self.rng.random() < 0.3 else "", f"</{tag}>")

    def comments(self) -> None:
        def inner():
            self.put(f"<h3>{self.rng.choice(_LABELS['comments'])}</h3>" if self.rng.random() < 0.8 or self.plain else "")
            for _ in range(self.rng.randint(1, 5)):
                self.put(self.rng.choice(["<div>", "<li>", "<div class='comment'>", "<article class=comment>"]))
                self.put(f"<b>{self.sentence(1, 2)}</b> " if self.rng.random() < 0.5 else "")
                self.text("p", " ".join(self.sentence(2, 14) for _ in range(self.rng.randint(1, 3))), False)
                self.put(f"<a href='#r'>{self.rng.choice(['Reply', 'Answer', 'Report'])}</a>" if self.rng.random() < 0.5 else "", "</div>")

        self.element(["section", "div", "ol"], "comments", inner)

    def footer(self) -> None:
        def inner():
            r = self.rng
            kind = r.random()
            if kind < 0.5:
                self.put(r.choice(["&copy; ", "&copy; 2020 ", ""]), self.word(), ".example ", r.choice(["&middot; ", "", "\n"]), self.sentence(1, 12))
            else:
                self.text("p", r.choice(["&copy; ", ""]) + (r.choice(_LABELS["footer"]) if r.random() < 0.6 else self.sentence(1, 12)), False)
            if r.random() < 0.5:
                self.links(r.randint(1, 4), _LABELS["footer"])

        self.element(["footer", "footer", "footer", "div"], "footer", inner)

    # The main text

    def body(self) -> None:
        r = self.rng
        long = r.choice([1, 1, 2, 3, 4, 6, 10, 16])
        if r.random() < 0.75:
            title = self.sentence(1, 9)
            inside = r.random() < 0.2
            self.put("<header>" if inside else "")
            self.text("h1", title, True)
            self.put("</header>" if inside else "")
        for i in range(long):
            kind = r.random()
            if kind < 0.78:
                self.text("p", self.prose(), True)
            elif kind < 0.84:
                self.text(r.choice(["h2", "h3"]), self.sentence(1, 6), True)
                self.text("p", self.prose(), True)
            elif kind < 0.9:
                self.put("<ul>")
                for _ in range(r.randint(2, 4)):
                    self.text("li", self.sentence(1, 7), True)
                self.put("</ul>")
            elif kind < 0.93:
                self.text(r.choice(["blockquote", "pre", "div"]), self.prose(), True)
            elif kind < 0.95:
                self.put("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    self.text("td", self.sentence(1, 4), True)
                self.put("</tr></table>")
            elif i and i + 1 < long:
                r.choice([self.ad, self.ad, self.notice, self.share, self.side])()

    def wrapped(self, inner, deep: int) -> None:
        if not deep:
            return inner()
        tag = self.rng.choice(["div", "div", "div", "form", "section", "table><tr><td"])
        name = self.name("frame") if tag != "table><tr><td" else ""
        self.put(f"<{tag}{name}>")
        self.wrapped(inner, deep - 1)
        self.put("</td></tr></table>" if tag == "table><tr><td" else f"</{tag}>")


def page(seed: int) -> tuple[str, list[str]]:
    """Markup and blocks of main text of one page."""
    r = random.Random(seed)
    p = Page(r, r.random() < 0.3)
    if r.random() < 0.05:  # text without markup
        text = p.prose()
        return text, [text]
    if r.random() < 0.06:  # a few words in little markup, perhaps cut off
        tag = r.choice(["article", "div", "main", "body", ""])
        p.put(f"<{tag}>" if tag else "")
        for _ in range(r.randint(1, 2)):
            text = " ".join(p.word() for _ in range(r.randint(2, 9)))
            p.main.append(text)
            p.put("<p>", text, r.choice(["</p>", ""]))
        p.put(f"</{tag}>" if tag and r.random() < 0.5 else "")
        return "".join(p.html), p.main
    density = r.choice([0.0, 0.1, 0.3, 0.6, 0.6, 0.8])  # how much stands around the main text
    whole_page = r.random() < 0.85
    if whole_page:
        p.put("<!DOCTYPE html><html><head><title>", p.sentence(2, 6), "</title><style>p{margin:0}</style></head><body>")

    def around(*kinds):
        for make in kinds:
            if r.random() < density:
                make()

    def main():
        tag = r.choice(["article", "article", "main", "div", "div", "section"]) if not p.plain else r.choice(["div", "section", "article"])
        if r.random() < 0.12:
            return p.body()
        if r.random() < 0.1:  # each paragraph in a frame of its own
            for _ in range(r.randint(2, 4)):
                p.wrapped(lambda: p.text("p", p.prose(), True), 2)
            return None
        p.put(f"<{tag}{p.name('main')}>")
        p.body()
        around(*([p.share] if r.random() < 0.3 else []))
        p.put(f"</{tag}>")
        return None

    def whole():
        around(p.notice, p.header, p.nav, p.nav, p.ad)
        if r.random() < density / 2:
            p.side()
        p.wrapped(main, r.choice([0, 0, 0, 1, 2]))
        around(p.share, p.ad, p.side)
        if r.random() < 0.15:
            p.teasers()
        if r.random() < density / 3 + 0.25:
            p.comments()
        around(p.notice, p.footer, p.footer)

    p.wrapped(whole, r.choice([0, 0, 0, 1, 2]))
    p.put("<script>var t='</p>';</script></body></html>" if whole_page and r.random() < 0.8 else "")
    return "".join(p.html), p.main


def pages(count: int = 1200, seed: int = 1) -> list[tuple[str, list[str]]]:
    """So many labelled pages; another seed gives others."""
    return [page(seed * 1_000_003 + i) for i in range(count)]
