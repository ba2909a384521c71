"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a sequence of words, which score positive, and tags, which score negative;
one linear scan finds the contiguous run with the highest sum.  The weights are
learned from labelled pages (``html_labels``): a word weighs by how often words under
such a container belong to an article, a tag by how often tags of its kind stand outside
of one.  Inside the run, containers whose words mostly do not belong (adverts, forms,
reader comments and so on) are left out.

Scripts, styles, comments and markup never are text.  Character references are decoded,
white space in a block becomes one space, blocks are joined by one space.

Time is linear in the page, however deep its elements nest and whatever quotes are open:
an element knows the least share of those around it, and where a tag ends is looked up.

Defined cases: a null or empty page, or one without words, has the empty text; tags may
be unclosed or cut off; a body closes an open head; very long pages are read whole;
repeated rows each get their own row; an empty table gives no rows; a column ``text`` is
replaced, others are carried along whatever their names.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import lean, quoted, table
from tidelake.llm.html_labels import labelled_pages

#: Comments; elements whose content is never text; declarations.  Then tags with whole
#: quoted values, and tags whose quotes are not closed, which end at the next angle bracket.
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|svg|math|iframe|object|textarea|title)\b[^>]*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>")
_LOOSE = re.compile(r"[^<>]*+(?:>|\Z)")
_LABEL = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
#: Tags that stand in a line of text and do not end a block; br is a space in it.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINERS = frozenset("head header nav footer aside main article section div form ul ol dl menu table dialog noscript button select fieldset details figure body blockquote".split())
_VOID = frozenset("br hr img input link meta area base col embed source track wbr".split())
_GENERIC = frozenset("div section ul ol dl table body span figure blockquote details".split())
_HOLDS = ("article", "main")


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element is called: its tag, and the words of its class, id, role and itemprop.

    A generic element that has such words goes by them alone.
    """
    words = [w.lower() for m in _LABEL.findall(attributes) for w in _WORD.findall(m)] if attributes else []
    labels = tuple(dict.fromkeys(f".{w}" for w in words))
    return labels if labels and tag in _GENERIC else (tag, *labels)


class Node:
    """An open container: its names, whether an article's own container is around it, and what weights say of it."""

    __slots__ = ("parent", "names", "held", "holds", "share", "strong")

    def __init__(self, parent: Node | None, tag: str, names: tuple[str, ...]):
        self.parent, self.names = parent, names
        self.held = parent is not None and parent.holds
        self.holds = self.held or tag in _HOLDS
        self.share, self.strong = 0.6, False


def _tag_ends(source: str) -> Callable[[int], int]:
    """Where a tag whose attributes begin at a position has its closing bracket outside of quotes; -1: nowhere."""
    marks = [(m.start(), m[0]) for m in re.finditer("[>\"']", source)]
    places = [at for at, _ in marks]
    ends, later = [-1] * (len(marks) + 1), {"\"": -1, "'": -1}
    for k in range(len(marks) - 1, -1, -1):
        at, mark = marks[k]
        if mark == ">":
            ends[k] = at
        else:
            close = later[mark]
            ends[k] = ends[close + 1] if close >= 0 else -1
            later[mark] = k
    return lambda begin: ends[bisect_left(places, begin)]


class Page:
    """Tokens of a page: (tag names or None, innermost container, text, is_block), and its containers as they open."""

    def __init__(self, source: str):
        self.tokens: list[tuple] = []
        self.nodes: list[Node] = []
        stack: list[tuple[str, Node]] = []
        count: Counter = Counter()
        node: Node | None = None
        at = begin = 0
        last = source.rfind(">")
        ends = None

        while (begin := source.find("<", begin)) >= 0:
            m = _TAG.match(source, begin)
            # no search runs to the end of the page for a bracket that is not there
            other = _OTHER.match(source, begin) if begin < last or not m else None
            if other:
                stop, tag = other.end(), ""
            elif m:
                stop, tag = -1, m[2].lower()
                if ends is not None:
                    stop = ends(m.end()) + 1 or -1
                elif begin < last and (whole := _QUOTED.match(source, m.end())):
                    stop = whole.end()
                elif begin < last:
                    ends = _tag_ends(source)  # from the first tag that is not closed outside of quotes
                if stop < 0:
                    loose = _LOOSE.match(source, m.end())
                    stop = loose.end() if loose else -1
            else:
                stop = -1
            if stop < 0:
                begin += 1
                continue
            if at < begin:
                self.tokens.append((None, node, _html.unescape(source[at:begin]), False))
            at = stop
            if other:
                begin = stop
                if other[1]:
                    self.tokens.append(((other[1].lower(),), node, "", True))
                continue
            if tag == "br":
                begin = stop
                self.tokens.append((None, node, " ", False))
                continue
            closing = bool(m[1])
            names = _names(tag, "" if closing else source[m.end() : stop].removesuffix(">"))
            begin = stop
            if tag in _CONTAINERS:
                if closing:
                    if count[tag]:
                        names = self._close(stack, count, tag)
                else:
                    if tag == "body":
                        while count["head"]:
                            self._close(stack, count, "head")
                    stack.append((tag, Node(stack[-1][1] if stack else None, tag, names)))
                    self.nodes.append(stack[-1][1])
                    count[tag] += 1
                node = stack[-1][1] if stack else None
            self.tokens.append((names, node, "", tag not in _INLINE))
        if at < len(source):
            self.tokens.append((None, node, _html.unescape(source[at:]), False))

    @staticmethod
    def _close(stack: list, count: Counter, tag: str) -> tuple[str, ...]:
        """Close the containers up to the next one of that tag; its names."""
        while True:
            name, node = stack.pop()
            count[name] -= 1
            if name == tag:
                return node.names


class Weights:
    """Shares of articles by element name, and the scale of tags against words."""

    def __init__(self, word_share: dict, tag_share: dict, scale: float):
        self.word_share, self.tag_share, self.scale = word_share, tag_share, scale
        self._share = lru_cache(65536)(self._share_of)

    def __reduce__(self):
        return Weights, (self.word_share, self.tag_share, self.scale)

    def _share_of(self, kind: tuple) -> float:
        """How far words in this container belong to an article; the most telling name decides."""
        names, held = kind
        if len(names) == 1 and names[0] in _GENERIC:
            return 0.6  # says nothing by itself
        known = [self.word_share[k] for n in names if (k := next((k for k in ((n, held), (n, not held)) if k in self.word_share), None))]
        if not known:
            return 0.6
        return min(known) if min(known) < 0.3 else max(known)

    def weigh(self, page: Page) -> None:
        """Give every container the least share of those around it, and whether one is an article's own."""
        for node in page.nodes:
            share, up = self._share((node.names, node.held)), node.parent
            node.share = share if up is None else min(share, up.share)
            node.strong = share >= 0.9 or (up is not None and up.strong)

    @staticmethod
    def belongs(node: Node | None) -> float:
        return 0.6 if node is None else node.share

    def tag(self, names: tuple, node: Node | None) -> float:
        """Negative; an insert inside an article's own container does not part it."""
        known = [self.tag_share[n] for n in names if n in self.tag_share]
        held = node is not None and node.strong
        return -0.1 - self.scale * (0.02 if held else 1) * (1 - (min(known) if known else 0.9))

    def run(self, page: Page) -> tuple[int, int]:
        """First and end token of the maximum-scoring run."""
        self.weigh(page)
        best, best_run, total, start = 0.0, (0, 0), 0.0, 0
        for i, (names, node, text, _) in enumerate(page.tokens):
            total += self.tag(names, node) if names else (0.02 + self.belongs(node)) * len(text.split())
            if total <= 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, best_run = total, (start, i + 1)
        return best_run

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        a, b = self.run(page)
        blocks: list[list[str]] = [[]]
        for names, node, text, block in page.tokens[a:b]:
            if names:
                if block:
                    blocks.append([])
            elif self.belongs(node) >= 0.5:
                blocks[-1].append(text)
        return " ".join(" ".join(t) for x in blocks if (t := "".join(x).split()))


def learn(pages: list[list[tuple[str, bool]]] | None = None) -> Weights:
    """Weights from labelled pages: shares by counting, the scale by the most words put right."""
    pages = labelled_pages() if pages is None else pages
    words: dict = defaultdict(lambda: [0, 0])
    tags: dict = defaultdict(lambda: [0, 0])
    for page in pages:
        marks, whole = [], ""
        for piece, content in page:
            whole += piece
            marks.append((len(whole), content))
        tokens = Page(whole).tokens
        # which piece a token is from: pieces hold whole tokens
        own = [(t, content) for piece, content in page for t in Page(piece).tokens]
        for (names, node, text, _), (_, content) in zip(tokens, own, strict=True):
            if names:
                for n in names:
                    tags[n][0] += content
                    tags[n][1] += 1
            elif node:
                for n in node.names:
                    words[(n, node.held)][0] += content * len(text.split())
                    words[(n, node.held)][1] += len(text.split())
    share = lambda x: {k: (a + 0.5) / (n + 1) for k, (a, n) in x.items() if n}
    best = None
    for scale in (1, 2, 4, 8, 16, 32):
        weights = Weights(share(words), share(tags), scale)
        wrong = 0
        for page in pages:
            want = Page("".join(x for x, content in page if content))
            want_text = " ".join(t for *_, text, _ in want.tokens if (t := " ".join(text.split())))
            got = weights.extract("".join(x for x, _ in page))
            wrong += abs(len(want_text.split()) - len(got.split()))
        if best is None or wrong < best[0]:
            best = (wrong, weights)
    return best[1]


def extract_text(pages: DataFrame, weights: Weights | None = None, html: str = "html") -> DataFrame:
    """``pages`` with the main text in column ``text`` (in place of any column of that name); only the pages go to Python."""
    weights = weights or learn()
    shared = pages.sparkSession.sparkContext.broadcast((weights.word_share, weights.tag_share, weights.scale))  # some kB

    @lean
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Weights(*shared.value)
        for sources in arrays:
            yield pa.array([own.extract(x.as_py()) for x in sources], pa.string())

    rows = pages.select(F.struct(*map(quoted, pages.columns)).alias("row"), F.arrow_udf(run, "string")(quoted(html).cast("string")).alias("found"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in pages.columns if c != "text"], F.col("found").alias("text"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
