"""Small labelled web pages, written for this package, from which extraction weights are learned.

Each page is a list of (html, is_content) pieces; the pieces joined are the page.
"""

from __future__ import annotations

import random

_WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt labore magna aliquyam erat voluptua vero accusam justo duo dolores rebum stet clita kasd gubergren".split()

#: Containers of the article.
_ARTICLE = [
    ("<article>", "</article>"), ("<main>", "</main>"), ('<main id="main"><article class="post">', "</article></main>"),
    ('<div class="content">', "</div>"), ('<div id="content" class="article-body">', "</div>"), ('<div class="post-body entry">', "</div>"),
    ('<section class="story text">', "</section>"), ('<div role="main">', "</div>"), ('<div itemprop="articleBody">', "</div>"),
]
#: What stands around or inside it: opening, closing, whether it holds links.
_AROUND = [
    ("<nav>", "</nav>", True), ('<div class="menu nav">', "</div>", True), ('<ul class="breadcrumb navbar">', "</ul>", True), ('<div role="navigation">', "</div>", True),
    ("<header>", "</header>", True), ('<div id="header" class="masthead banner top">', "</div>", True), ('<div class="logo branding">', "</div>", False),
    ("<footer>", "</footer>", False), ('<div id="footer" class="copyright bottom legal">', "</div>", False), ('<div role="contentinfo">', "</div>", False),
    ("<aside>", "</aside>", True), ('<div class="sidebar widget">', "</div>", True), ('<div class="related recommended more links">', "</div>", True), ('<div role="complementary">', "</div>", True),
    ('<div class="ad">', "</div>", False), ('<div class="ads advert advertisement">', "</div>", False), ('<div class="sponsor sponsored promo banner">', "</div>", False), ('<section class="promotion teaser">', "</section>", False),
    ('<div class="cookie consent notice">', "</div>", False), ('<div id="cookies" class="banner popup modal overlay">', "</div>", False), ('<div class="alert notification">', "</div>", False), ('<div role="alert">', "</div>", False), ("<dialog>", "</dialog>", False),
    ("<form>", "</form>", False), ('<form class="newsletter subscribe signup search login">', "</form>", False), ('<div class="newsletter subscribe">', "</div>", False), ('<div class="search">', "</div>", False),
    ('<div id="comments" class="comments">', "</div>", False), ('<section class="comment-list discussion replies">', "</section>", False), ('<ol class="comment reply responses">', "</ol>", False), ('<div id="disqus" class="respond">', "</div>", False),
    ('<div class="share social sharing">', "</div>", True), ('<div class="tags meta byline author">', "</div>", True), ('<div class="pagination pager">', "</div>", True), ("<noscript>", "</noscript>", False), ("<button>", "</button>", False), ("<select>", "</select>", False), ("<menu>", "</menu>", True),
]


def _say(rng: random.Random, n: int) -> str:
    return " ".join(rng.choices(_WORDS, k=n)).capitalize() + "."


def _around(rng: random.Random, which: tuple) -> str:
    start, end, links = which
    if links:
        return start + "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.choices(_WORDS, k=rng.randint(3, 8))) + "</ul>" + end
    return start + rng.choice(["", "<p>"]) + _say(rng, rng.randint(3, 25)) + end


def labelled_pages(n: int = 240, seed: int = 5) -> list[list[tuple[str, bool]]]:
    rng = random.Random(seed)
    pages = []
    for i in range(n):
        start, end = _ARTICLE[i % len(_ARTICLE)]
        page = [("<!DOCTYPE html><html><head><title>" + _say(rng, 5) + "</title><style>p{margin:0}</style></head><body>", False)]
        page += [(_around(rng, _AROUND[(i * 3 + k) % len(_AROUND)]), False) for k in range(3)]
        page.append((start, True))
        page.append((rng.choice(["<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>"]).format(_say(rng, 6)), True))
        for _ in range(rng.randint(1, 9)):
            text = _say(rng, rng.randint(2, 60))
            page.append((rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{} <a href='/x'>dolor</a> sit.</p>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<h2>{}</h2>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>", "<section><p>{}</p></section>"]).format(text), True))
            if rng.random() < 0.15:
                page.append((_around(rng, rng.choice([a for a in _AROUND if not a[0].startswith("<header")])), False))
        page.append((end, True))
        page += [(_around(rng, _AROUND[(i * 5 + k) % len(_AROUND)]), False) for k in range(3)]
        page.append(("</body></html>" if rng.random() < 0.7 else "", False))
        pages.append(page)
    return pages
