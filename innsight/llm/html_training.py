"""Labelled pages for the block labeller, made from a rule.

A page is a shuffled arrangement of the parts that web pages have, in the ways
they are commonly marked up: the article in one of several containers, and
menus, headers, footers, sidebars, notices, adverts, forms and reader comments
around and inside it. Words are random syllables, so only the markup and the
form of the text can be learned. Each block's label is known as it is written.
"""

from __future__ import annotations

import random

# Usual markup, as (open tag, close tag).
ARTICLES = [
    ("<article>", "</article>"),
    ("<article>", "</article>"),
    ("<article>", "</article>"),
    ('<article class="post">', "</article>"),
    ("<main>", "</main>"),
    ("<main><article>", "</article></main>"),
    ('<div id="content">', "</div>"),
    ('<div class="article-body">', "</div>"),
    ('<div class="entry-content">', "</div>"),
    ('<section class="story">', "</section>"),
    ('<div role="main">', "</div>"),
    ("<div>", "</div>"),
    ('<div class="page wrapper">', "</div>"),
    ("<section>", "</section>"),
    ("", ""),
]
ADVERTS = [
    ('<div class="ad">', "</div>"),
    ('<div class="advert">', "</div>"),
    ('<aside class="sponsored">', "</aside>"),
    ('<div id="banner-ad">', "</div>"),
    ('<div class="promo">', "</div>"),
    ('<section class="advertisement">', "</section>"),
    ('<p class="ads">', "</p>"),
]
NOTICES = [
    ('<div class="cookie-notice">', "</div>"),
    ('<div class="notice">', "</div>"),
    ('<div role="alert">', "</div>"),
    ('<div id="consent-banner">', "</div>"),
    ('<dialog class="popup">', "</dialog>"),
    ('<p class="disclaimer">', "</p>"),
    ('<aside class="notice">', "</aside>"),
    ('<div class="newsletter">', "</div>"),
]
SIDEBARS = [
    ("<aside>", "</aside>"),
    ('<aside class="sidebar">', "</aside>"),
    ('<div class="sidebar">', "</div>"),
    ('<div id="related">', "</div>"),
    ('<section class="related-posts">', "</section>"),
    ('<div class="widget">', "</div>"),
]
COMMENTS = [
    ('<section class="comments">', "</section>"),
    ('<div id="comments">', "</div>"),
    ('<div class="comment">', "</div>"),
    ('<ol class="comment-list">', "</ol>"),
    ('<section id="discussion">', "</section>"),
    ('<article class="comment">', "</article>"),
    ('<div class="replies">', "</div>"),
]
ITEMS = [
    ("<article>", "</article>"),
    ("<div>", "</div>"),
    ('<div class="comment-body">', "</div>"),
    ('<article class="comment">', "</article>"),
]
MENUS = [
    ("<nav>", "</nav>"),
    ('<nav class="menu">', "</nav>"),
    ('<div class="navbar">', "</div>"),
    ('<ul class="breadcrumb">', "</ul>"),
    ('<div role="navigation">', "</div>"),
    ('<div class="pagination">', "</div>"),
    ('<div class="share-links">', "</div>"),
]
HEADERS = [("<header>", "</header>"), ('<div class="header">', "</div>"), ('<div id="masthead">', "</div>"), ('<div role="banner">', "</div>")]
FOOTERS = [("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="copyright">', "</div>"), ('<div role="contentinfo">', "</div>")]
SYLLABLES = "ba be da de en er ka la le mi na no or ra re sa ta te un vo".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []

    def words(self, least: int, most: int) -> str:
        words = ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 3))) for _ in range(self.rng.randint(least, most))]
        words[0] = words[0].capitalize()
        return " ".join(words) + self.rng.choice([".", ".", ".", "", "!", ","])

    def block(self, opened: str, closed: str, text: str, main: bool) -> None:
        self.out.append(opened + text + closed)
        self.labels.append(main)

    def paragraph(self, main: bool, least: int = 1, most: int = 60) -> None:
        text = self.words(least, most)
        if self.rng.random() < 0.2:
            text += f' <a href="/x">{self.words(1, 3)}</a> {self.words(1, 8)}'
        self.block("<p>", "</p>", text, main)

    def link_list(self, kind: tuple[str, str], main: bool = False) -> None:
        opened, closed = kind
        as_list = not opened.startswith(("<ul", "<ol"))
        self.out.append(opened + ("<ul>" if as_list else ""))
        for _ in range(self.rng.randint(2, 7)):
            self.block("<li>", "</li>", f'<a href="/{self.words(1, 1)}">{self.words(1, 2)}</a>', main)
        self.out.append(("</ul>" if as_list else "") + closed)

    def around(self, kind: tuple[str, str]) -> None:
        opened, closed = kind
        if opened.startswith("<p") or self.rng.random() < 0.5:
            self.block(opened, closed, self.words(1, 25), False)
            return
        item = self.rng.choice([("", ""), ("", ""), *ITEMS[:2]])
        self.out.append(opened + item[0])
        if self.rng.random() < 0.4:
            self.block("<h3>", "</h3>", self.words(1, 4), False)
        for _ in range(self.rng.randint(1, 3)):
            self.paragraph(False, 1, 30)
        self.out.append(item[1] + closed)

    def comments(self) -> None:
        opened, closed = self.rng.choice(COMMENTS)
        item = ("<li>", "</li>") if opened.startswith("<ol") else self.rng.choice(ITEMS)
        self.out.append(opened)
        for _ in range(self.rng.randint(1, 4)):
            self.out.append(item[0])
            self.block('<div class="author">', "</div>", self.words(1, 2), False)
            self.paragraph(False, 2, 50)
            self.out.append(item[1])
        self.out.append(closed)

    def form(self) -> None:
        self.out.append('<form action="/q"><input name="q">')
        for _ in range(self.rng.randint(1, 3)):
            self.block("<div><label>", "</label></div>", self.words(1, 4), False)
        self.block("<button>", "</button>", self.words(1, 2), False)
        self.out.append("</form>")

    def footer(self) -> None:
        opened, closed = self.rng.choice(FOOTERS)
        self.block(opened, closed, f"&copy; {self.words(1, 3)} &middot; {self.words(1, 20)}", False)

    def distraction(self) -> None:
        kind = self.rng.randrange(7)
        if kind == 0:
            self.around(self.rng.choice(ADVERTS))
        elif kind == 1:
            self.around(self.rng.choice(NOTICES))
        elif kind == 2:
            self.around(self.rng.choice(SIDEBARS))
        elif kind == 3:
            self.form()
        elif kind == 4:
            self.link_list(self.rng.choice(MENUS))
        elif kind == 5:
            self.comments()
        else:
            self.link_list(self.rng.choice(SIDEBARS))

    def article(self) -> None:
        opened, closed = self.rng.choice(ARTICLES)
        self.out.append(opened)
        if self.rng.random() < 0.8:
            self.block("<h1>", "</h1>", self.words(1, 12), True)
        for _ in range(self.rng.randint(1, 9)):
            kind = self.rng.random()
            if kind < 0.7:
                self.paragraph(True)
            elif kind < 0.8:
                self.block("<h2>", "</h2>", self.words(1, 6), True)
            elif kind < 0.85:
                self.block("<blockquote>", "</blockquote>", self.words(2, 30), True)
            elif kind < 0.9:
                self.out.append("<ul>")
                for _ in range(self.rng.randint(2, 5)):
                    self.block("<li>", "</li>", self.words(1, 15), True)
                self.out.append("</ul>")
            elif kind < 0.93:
                self.block("<pre>", "</pre>", self.words(2, 20), True)
            elif kind < 0.96:
                self.out.append("<table><tr>")
                for _ in range(self.rng.randint(2, 4)):
                    self.block("<td>", "</td>", self.words(1, 3), True)
                self.out.append("</tr></table>")
            else:
                self.distraction()
        self.out.append(closed)


def labelled_pages(count: int, seed: int = 9) -> list[tuple[str, list[bool]]]:
    """(html, label per block: part of the article or not) of ``count`` pages."""
    rng = random.Random(seed)
    pages = []
    for _ in range(count):
        page = _Page(rng)
        page.out.append("<!DOCTYPE html><html><head><title>" + page.words(1, 5) + "</title></head><body>")
        alone = rng.random() < 0.25  # an article and nothing else
        if not alone and rng.random() < 0.6:
            opened, closed = rng.choice(HEADERS)
            page.block(opened, closed, page.words(1, 6), False)
        for _ in range(0 if alone else rng.randint(0, 3)):
            page.distraction()
        page.article()
        for _ in range(0 if alone else rng.randint(0, 3)):
            page.distraction()
        if not alone and rng.random() < 0.8:
            page.footer()
        page.out.append("</body></html>")
        pages.append(("".join(page.out), page.labels))
    return pages
