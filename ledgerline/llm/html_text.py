"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative, words in links by their own weight; the
weights are log odds of lying inside the main region, fitted on labelled pages: the ones below, and pages of the table
whose own markup labels them (one <article>). One linear scan (Kadane) finds the contiguous region with the best sum.

The region says where the article is; its edges, where short blocks and many tags meet, are then settled by blocks. In
an article or main with most of the region's words all is read that isn't mostly links: titles, leads, tables, code.
Elsewhere the region goes on over the blocks of running text beside it, up to the first block of another kind, and over
the headings before it. Reader comments are left out: from a heading that says so (COMMENT_WORDS), and entries in a
row, late on the page, that each have a date and blocks of their own.

The names of elements (class, role, label; outside articles the id) are weighed on the same pages: the weights of a
name's words sum up to the log odds that words under it are main text, and a word that no labelled page knows speaks
for the text. Where an element's least name outweighs a word, every word in it scores below zero;
the element is left out wherever it stands and costs the region a penalty. So are the elements that are by definition
not text (navigation, footer, aside, form, embedded objects). Headings are never left out by name. An element left out
by name, a form or a header with most of the words of the core (the longest article or main that isn't left out; the
page, if none has a tenth of its words) costs the penalty and is read.

Text between block tags is a block: references decoded, white space turned into one space, trimmed; blocks are joined
by two newlines. Nothing is cut for length. Null, empty or wordless html: an empty text. A boilerplate element that
is never closed, or closes itself, ends where it begins; script, style, textarea and title run to the page's end. Repeated rows: extracted each. Other columns take no part. Empty table: no rows.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What follows a tag's name: quotes open only after "=", so a stray one can't reach over ">".
REST = r"(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+|=)*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|(?P<tag><(?P<raw>script|style|textarea|title)(?![a-zA-Z0-9:-]){REST}>)(?:.*?</(?P=raw)\s*>|.*\Z)"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>{REST})>|<[!?][^>]*>",
    re.S | re.I,
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset(["br", "td", "th"])
EMBEDDED = frozenset("noscript template svg iframe object canvas".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
LEFT_OUT = frozenset("nav footer aside form button select option menu dialog header label input".split())
#: Left out even with most of the words.
ALWAYS = LEFT_OUT - {"form", "header"} | EMBEDDED
VOID = frozenset(["input", "br", "hr", "img", "meta", "link"])
ATTRIBUTE = re.compile(r"([^\s/>=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
#: The weight of a name's word that no labelled page knows.
UNKNOWN = 4.0
#: Before the words of names inside an article or main, which have a further weight of their own.
INSIDE = "in:"


@dataclass
class Weights:
    tags: dict[str, float] = field(default_factory=dict)
    word: float = 1.0
    linked: float = -1.0
    left_out: float = -3.0
    unseen: float = -1.0
    names: dict[str, float] = field(default_factory=dict)

    def of_name(self, words: tuple[str, ...], inside: bool) -> float:
        """What a name says of its element; inside: of an article or main."""
        return sum(self.names.get(x, UNKNOWN) + (self.names.get(INSIDE + x, 0.0) if inside else 0.0) for x in words)


@dataclass
class Piece:
    kind: str  # "text", "tag", "gone"
    key: str = ""
    text: str = ""
    words: int = 0
    linked: bool = False
    at: int = 0


def names_of(rest: str, ids: bool = True) -> list[tuple[str, ...]]:
    """The words of each class, role, label and (with `ids`) id."""
    found: list[tuple[str, ...]] = []
    if "=" in rest:
        for m in ATTRIBUTE.finditer(rest):
            kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if kind in ("class", "role") or (kind == "id" and ids):
                names = value.split()
            elif kind == "aria-label":
                names = [value]
            else:
                continue
            found += [words for name in names if (words := tuple({w.lower(): 0 for w in PART.findall(name)}))]
    return found


def _left_out(rest: str, w: Weights, ids: bool = True, inside: bool = False) -> bool:
    """Whether the names make each word of the element score below zero."""
    return any(w.of_name(x, inside) + w.word < 0 for x in names_of(rest, ids))


@dataclass
class Token:
    start: int
    end: int
    raw: bool = False
    close: bool = False
    name: str = ""
    rest: str = ""


def _tokens(page: str) -> list[Token]:
    """Comments, raw elements and tags in order. Inside an svg a raw tag may close itself."""
    found: list[Token] = []
    at, drawings = 0, 0
    while m := TOKEN.search(page, at):
        at = m.end()
        name = (m["name"] or m["raw"] or "").lower()
        rest = m["rest"] or ""
        if m["raw"] and drawings and m["tag"].endswith("/>"):
            at = m.end("tag")
        elif name == "svg" and not rest.endswith("/"):
            drawings = max(0, drawings + (-1 if m["close"] else 1))
        found.append(Token(m.start(), at, bool(m["raw"]), bool(m["close"]), name, rest))
    return found


def _ends(found: list[Token]) -> dict[int, int]:
    """The closing tag of each tag that has one."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for i, m in enumerate(found):
        if m.name and not m.raw:
            stack = opened.setdefault(m.name, [])
            if not m.close:
                if not m.rest.endswith("/"):
                    stack.append(i)
            elif stack:
                ends[stack.pop()] = i
    return ends


class _Core:
    """Where the page's words outside links are."""

    def __init__(self, page: str, found: list[Token], ends: dict[int, int], w: Weights) -> None:
        self.upto: list[int] = []  # words before a token
        n, at, past = 0, 0, -1
        spans = []
        for i, m in enumerate(found):
            if i > past:
                n += len(page[at : m.start].split())
            self.upto.append(n)
            at = m.end
            if not m.close:
                name = m.name
                if (name == "a" or name in ALWAYS) and i in ends:
                    past = max(past, ends[i])
                elif name in ("article", "main") and not _left_out(m.rest, w):
                    spans.append((i, ends.get(i, len(found))))
        self.upto.append(n + len(page[at:].split()))
        words = lambda x: self.upto[x[1]] - self.upto[x[0]]
        whole = (0, len(found))
        longest = max(spans, key=words, default=whole)
        self.span = longest if words(longest) * 10 >= self.upto[-1] else whole
        self.words = self.upto[self.span[1]] - (self.upto[self.span[0]] if self.span != whole else 0)

    def held_by(self, begin: int, end: int) -> bool:
        """Whether the element from one token to another has most of the core."""
        a, b = max(begin, self.span[0]), min(end, self.span[1])
        return a < b and (self.upto[b] - self.upto[a]) * 2 > self.words


def pieces(page: str, w: Weights) -> list[Piece]:
    """The page's texts and tags in order; a boilerplate element is one piece."""
    found = _tokens(page)
    ends = _ends(found)
    core: _Core | None = None
    out: list[Piece] = []
    at, i, links, inside, articles = 0, 0, 0, 0, 0

    def add_text(a: int, b: int) -> None:
        if a < b:
            text = page[a:b]
            if "&" in text:
                text = references.unescape(text)
            out.append(Piece("text", text=text, words=len(text.split()), linked=links > 0, at=a))

    while i < len(found):
        m = found[i]
        add_text(at, m.start)
        at = m.end
        if m.raw:
            out.append(Piece("gone", m.name, at=m.start))
        elif m.name:
            name, rest = m.name, m.rest
            if m.close:
                if name == "a":
                    links = max(0, links - 1)
                elif name in ("article", "main"):
                    inside = max(0, inside - 1)
                    if name == "article":
                        articles = max(0, articles - 1)
                out.append(Piece("tag", "/" + name, at=m.start))
            else:
                named = name not in HEADINGS and _left_out(rest, w, not articles, inside > 0)
                drop = named or name in ALWAYS or (name in LEFT_OUT and not (name == "header" and inside))
                if name in ("html", "body", "article", "main"):
                    drop = named and name == "article"
                end = ends.get(i) if drop and name not in VOID else None
                if end is not None and name not in ALWAYS:
                    core = core or _Core(page, found, ends, w)
                    if core.held_by(i, end):
                        out.append(Piece("gone", name, at=m.start))
                        end = None
                if end is not None:
                    out.append(Piece("gone", name, at=m.start))
                    i, at = end, found[end].end
                else:
                    if name == "a":
                        links += 1
                    elif name in ("article", "main"):
                        inside += 1
                        articles += name == "article"
                    out.append(Piece("tag", name, at=m.start))
        i += 1
    add_text(at, len(page))
    return out


def best_region(parts: list[Piece], w: Weights) -> tuple[int, int]:
    """First and last piece of the contiguous region with the greatest score (first such; 0, -1 if none is positive)."""
    best, region, score, start = 0.0, (0, -1), 0.0, 0
    for i, p in enumerate(parts):
        if p.kind == "text":
            score += p.words * (w.linked if p.linked else w.word)
        elif p.kind == "gone":
            score += w.left_out
        else:
            score += w.tags.get(p.key, w.unseen)
        if score <= 0:
            score, start = 0.0, i + 1
        elif score > best:
            best, region = score, (start, i)
    return region


def blocks(parts: list[Piece]) -> str:
    out: list[str] = []
    now: list[str] = []

    def finish() -> None:
        if block := " ".join("".join(now).split()):
            out.append(block)
        now.clear()

    for p in parts:
        if p.kind == "text":
            now.append(p.text)
        elif (name := p.key.lstrip("/")) in SPACED:
            now.append(" ")
        elif p.kind == "gone" or name in BLOCKS:
            if p.kind == "tag" or name in BLOCKS:
                finish()
    finish()
    return "\n\n".join(out)


#: Elements that make up running text beside paragraphs.
TEXTUAL = frozenset("p pre table ul ol dl blockquote figure details hr h1 h2 h3 h4 h5 h6".split())
#: How the heading above reader comments begins, after its number if it has one.
COMMENT_WORDS = "comments comment responses response replies reply thoughts discussion kommentare kommentar antworten commentaires commentaire réponses comentarios comentario respuestas"
COMMENT_HEADING = re.compile(r"(?:\d+\s+(?:WORDS)(?:\s+(?:on|to|zu|auf|sur|à|en|a)\b.*)?|(?:WORDS)(?:\s*[(:].*)?)\s*".replace("WORDS", "|".join(COMMENT_WORDS.split())), re.I)
DATED = re.compile(r"\b(?:\d{4}-\d\d?-\d\d?|\d\d?[./]\d\d?[./]\d{2,4}|\d\d?:\d\d|\d+\s+(?:minutes?|hours?|days?|weeks?|months?|years?)\s+ago)\b", re.I)


class _Tree:
    """The elements of a page's pieces, and which pieces are read."""

    def __init__(self, parts: list[Piece], first: int, last: int) -> None:
        self.parts, self.first, self.last = parts, first, last
        self.read = [first <= i <= last for i in range(len(parts))]
        self.end: dict[int, int] = {}
        opened: dict[str, list[int]] = {}
        for i, p in enumerate(parts):
            if p.kind == "tag":
                if p.key[0] != "/":
                    opened.setdefault(p.key, []).append(i)
                elif opened.get(p.key[1:]):
                    self.end[opened[p.key[1:]].pop()] = i
        text = [(0, 0) if p.kind != "text" else (p.words, p.words * p.linked) for p in parts]
        self.words, self.linked = ([0, *accumulate(x)] for x in zip(*text, strict=True))

    def of(self, a: int, b: int) -> tuple[int, int]:
        """Words, and words in links, of the pieces a..b."""
        return self.words[b + 1] - self.words[a], self.linked[b + 1] - self.linked[a]

    def around(self, a: int, b: int) -> tuple[int, int]:
        """The innermost block element that holds the pieces a..b; the page, if none does."""
        return max(((i, j) for i, j in self.end.items() if i < a and b < j and self.parts[i].key in BLOCKS), default=(-1, len(self.parts)))

    def children(self, a: int, b: int) -> list[tuple[int, int]]:
        out, i = [], a + 1
        while i < b:
            end = min(self.end.get(i, i), b - 1)
            out.append((i, end))
            i = end + 1
        return out

    def plain(self, a: int, b: int) -> bool:
        """Whether most words aren't in links."""
        words, linked = self.of(a, b)
        return linked * 2 <= words and self.parts[a].kind != "gone"

    def fill(self, a: int, b: int) -> None:
        """Read what stands in an element beside the region, but for what is mostly links."""
        for i, j in self.children(a, b):
            if j < self.first or i > self.last:
                if self.plain(i, j):
                    self.read[i : j + 1] = [True] * (j + 1 - i)
            elif (i < self.first or j > self.last) and j > i:
                self.read[i] = self.read[j] = True
                self.fill(i, j)

    def core(self) -> tuple[int, int] | None:
        """The smallest article or main with most of the region's words; an article alone in it stands for a main."""
        whole, _ = self.of(self.first, self.last)
        inside = lambda x: self.of(max(x[0], self.first), min(x[1], self.last))[0] if max(x[0], self.first) <= min(x[1], self.last) else 0
        held = [x for x in self.end.items() if self.parts[x[0]].key in ("article", "main") and inside(x) * 2 > whole]
        return min(held, key=lambda x: x[1] - x[0], default=None)

    def siblings(self, a: int, b: int) -> None:
        """Read the blocks of running text that go on from the region in the element around it, up to the first that is
        something else; before it also what holds a heading, and the headings before the element."""
        textual = lambda i: self.parts[i].kind == "text" or self.parts[i].key in TEXTUAL or self.parts[i].key.lstrip("/") not in BLOCKS
        heading = lambda i, j: any(p.key in HEADINGS for p in self.parts[i : j + 1])
        for i, j in self.children(a, b):
            if i <= self.last and j >= self.first and (i < self.first or j > self.last) and j > i:
                self.read[i] = self.read[j] = True
                self.fill(i, j)
        after = [x for x in self.children(a, b) if x[0] > self.last]
        before = [x for x in self.children(a, b) if x[1] < self.first][::-1]
        for side, fits in ((after, lambda i, j: textual(i)), (before, lambda i, j: textual(i) or heading(i, j))):
            for i, j in side:
                if not self.plain(i, j) or not fits(i, j):
                    break
                self.read[i : j + 1] = [True] * (j + 1 - i)
        while a >= 0:
            up = self.around(a, b)
            for i, j in [x for x in self.children(*up) if x[1] < a][::-1]:
                if self.of(i, j)[0] and not (self.plain(i, j) and heading(i, j) and self.of(i, j)[0] <= 60):
                    return
                if self.of(i, j)[0]:
                    self.read[i : j + 1] = [True] * (j + 1 - i)
                    return
            a, b = up

    def drop_comments(self) -> None:
        """Reader comments are left out: an element that begins with a heading of comments, or what follows such a heading
        in its element; and the last element of several dated entries, each with blocks of its own."""
        for i, j in sorted(self.end.items()):
            if self.parts[i].key in HEADINGS and self.parts[i].key != "h1" and self.read[i] and COMMENT_HEADING.fullmatch(" ".join("".join(p.text for p in self.parts[i : j + 1]).split())):
                a, b = self.around(i, j)
                whole = a >= 0 and self.parts[a].key not in ("article", "main", "body", "html") and not self.of(a, i)[0]
                self.read[a if whole else i : b] = [False] * (b - (a if whole else i))
        half = self.words[-1] // 2
        for a, b in sorted(self.end.items()):
            if self.parts[a].key in ("div", "section", "ol", "ul") and self.read[a] and self.words[a] >= half:
                entries = [x for x in self.children(a, b) if self.of(*x)[0]]
                if len(entries) > 1 and all(self._entry(*x) for x in entries) and len({self.parts[i].key for i, _ in entries}) == 1:
                    self.read[a : b + 1] = [False] * (b + 1 - a)

    def _entry(self, a: int, b: int) -> bool:
        head = " ".join(p.text for p in self.parts[a : b + 1] if p.kind == "text")[:200]
        inner = any(p.kind == "tag" and p.key in BLOCKS for p in self.parts[a + 1 : b])
        return self.parts[a].key in ("div", "li", "article", "section") and inner and (bool(DATED.search(head)) or any(p.key == "time" for p in self.parts[a:b]))


def main_text(page: str | None, w: Weights) -> str:
    parts = pieces(page, w) if page else []
    first, last = best_region(parts, w)
    if last < first:
        return ""
    tree = _Tree(parts, first, last)
    core = tree.core()
    if core:
        tree.fill(*core)
    else:
        tree.siblings(*tree.around(first, last))
    tree.drop_comments()
    # what isn't read still parts the blocks beside it
    inline = lambda p: p.kind == "tag" and p.key.lstrip("/") not in BLOCKS
    return blocks([p if read or inline(p) else Piece("tag", "div") for p, read in zip(parts, tree.read, strict=True)])


Labelled = tuple[str, list[tuple[int, int]]]  # a page, and where its main text begins and ends


def _odds(a: float, b: float) -> float:
    return math.log((a + 0.5) / (b + 0.5))


def _clip(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))


def fit_names(labelled: list[Labelled], steps: int = 400, keep: float = 0.01) -> dict[str, float]:
    """Weights of words of names, whose sum is the log odds that words under a name are main text: logistic regression
    over the distinct names of the pages, with a small penalty (`keep`) on the weights."""
    seen: dict[tuple[str, ...], list[int]] = {}
    for page, spans in labelled:
        found = _tokens(page)
        ends = _ends(found)
        opened: list[tuple[int, list[tuple[str, ...]], bool]] = []  # closing tag, names, whether an article or main
        at = 0
        for i, m in enumerate([*found, Token(len(page), len(page))]):
            if n := len(page[at : m.start].split()):
                main = any(a <= at < b for a, b in spans)
                for name in {x for _, names, _ in opened for x in names}:
                    seen.setdefault(name, [0, 0])[main] += n
            at = m.end
            opened = [x for x in opened if x[0] > i]
            if m.name and not m.close and i in ends:
                inside = any(x[2] for x in opened)
                names = [(*x, *(INSIDE + word for word in x if inside)) for x in names_of(m.rest)]
                opened.append((ends[i], names, m.name in ("article", "main")))
    words = sorted({word for name in seen for word in name})
    place = {word: i for i, word in enumerate(words)}
    x = np.zeros((len(seen), len(words)))
    for row, name in enumerate(seen):
        x[row, [place[word] for word in name]] = 1
    goal = np.array([main / (main + other) for other, main in seen.values()])
    weight = np.zeros(len(words))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ weight)))
        weight -= 0.5 * (x.T @ (p - goal) + keep * weight)
    return dict(zip(words, weight.tolist(), strict=True))


def fit(labelled: list[Labelled]) -> Weights:
    """Weights from pages with the places where their main text begins and ends."""
    tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
    words: Counter = Counter()
    names = Weights(names=fit_names(labelled))
    for page, spans in labelled:
        for p in pieces(page, names):
            inside = any(a <= p.at < b for a, b in spans)
            if p.kind == "text":
                words[inside, p.linked] += p.words
            elif p.kind == "tag":
                tags[inside][p.key] += 1
    scale = lambda k: _clip(_odds(tags[True][k], tags[False][k]) * 2, -24.0, -0.2)
    return Weights(
        tags={k: scale(k) for k in tags[True].keys() | tags[False].keys()},
        word=_clip(_odds(words[True, False], words[False, False]) / 2, 0.25, 2.0),
        linked=_clip(_odds(words[True, True], words[False, True]) / 2, -2.0, 0.5),
        names=names.names,
    )


def _example(*parts: str) -> Labelled:
    """A page of parts that are by turns not main text and main text."""
    spans, at = [], 0
    for i, part in enumerate(parts):
        if i % 2:
            spans.append((at, at + len(part)))
        at += len(part)
    return "".join(parts), spans


_PROSE = "<p>" + "several plain words that tell a story at some length, with a <a href='x'>link</a> and <b>weight</b>. " * 4 + "</p>"


def _named(*names: str) -> str:
    return "".join(f'<div class="{x}"><span>short words beside it</span> <a>a link</a></div>' for x in names)


def _inner(*names: str) -> str:
    return "".join(f'<div class="{x}">{_PROSE}</div>' for x in names)


#: Labelled pages of common layouts, the names of their elements with them.
LABELLED = [
    _example("<html><body><div><ul><li><a>home</a></li><li><a>news</a></li></ul></div><article>", "<h1>A title</h1>" + _PROSE * 3, "</article><div><a>next page</a> <a>previous page</a></div></body></html>"),
    _example("<html><body><table><tr><td><a>start</a></td></tr></table><div>", "<h1>A title of words</h1>" + _PROSE * 2 + "<h2>Part</h2>" + _PROSE, "</div><div><ul><li><a>about us</a></li><li><a>contact</a></li></ul></div><div>all rights reserved</div></body></html>"),
    _example("<html><body><section><a>log in</a></section><main>", "<h2>Words</h2>" + _PROSE + "<ul><li>one point made</li><li>another point made</li></ul>" + _PROSE + "<blockquote>said somebody once</blockquote>", "</main><section><h3>more</h3><a>other things to read</a></section></body></html>"),
    _example("<html><body><div><div>short line</div></div><div><div>", _PROSE * 4, "</div></div><div><span>made with care</span></div></body></html>"),
    # names around and between the text of an article
    _example(
        '<html><body><div class="site page wrapper has-sidebar no-ads with-menu"><div class="site-header masthead banner">a name</div>' + _named("main-nav navbar", "menu", "main-menu", "primary-menu", "navigation top", "breadcrumb", "breadcrumbs-list", "toolbar login", "skip-link", "search-box")
        + '<div id="main" class="container main-content layout"><article class="post entry">', '<header class="header entry-header">The title of it</header>' + _inner("entry-content", "post-body text", "article-text section"),
        _named("ad", "ads", "ad-slot", "adv", "advert", "adverts-box", "advertisement", "advertising-block", "share", "share-buttons", "sharing social", "promo", "promo-box", "newsletter-signup", "related", "related-posts", "sponsor", "sponsored-content"),
        _inner("story-text", "body content-block", "list-item", "story"),
        "</article></div>" + _named("comments", "comments-area", "comment-list", "comment reply", "replies respond", "disqus") + _named("sidebar left", "sidebar-right", "sidebar", "widget", "widget-area secondary") + _named("pagination", "pager bottom", "site-footer", "footer global") + "</div></body></html>",
    ),
    # and of a page without one
    _example(
        '<html><body>' + _named("cookie-notice", "cookies", "consent", "notice", "notices", "modal", "popup", "overlay", "banner-top", "login-form", "contentinfo", "toolbar") + '<div id="page" class="wrapper outer inner"><div class="content">',
        "<h1>A title of words</h1>" + _inner("text", "post-content", "section-body", "main-text", "article-body"),
        _named("recommended", "recommended-list", "related-list", "promoted", "promotion", "disclaimer", "social-links", "subscribe", "subscription-box", "signup", "newsletter", "ad-container", "ad-banner", "advertisement-wrapper"),
        _inner("content-area", "page-content", "item-text"),
        "</div>" + _named("reply-list", "comment-form", "respond", "menu-list", "footer-links", "nav-links", "pager-links", "sidebar-content", "widget-content") + "</div></body></html>",
    ),
]


def marked_by_article(page: str | None) -> Labelled | None:
    if page and len(re.findall(r"<article\b", page, re.I)) == 1:
        a, b = re.search(r"<article\b[^>]*>", page, re.I), page.lower().rfind("</article")
        if a and b > a.end():
            return page, [(a.end(), b)]
    return None


def weights_for(pages: DataFrame, sample: int = 300) -> Weights:
    """Weights from LABELLED and at most `sample` pages, chosen by a hash, that hold one article element."""
    marked = pages.filter(F.lower("html").contains("<article")).select("page_id")
    chosen = marked.orderBy(F.xxhash64(F.lit(23), "page_id"), "page_id").limit(sample)
    # at most `sample` ids, so they are broadcast; only these pages travel to the driver
    some = pages.join(F.broadcast(chosen.distinct()), "page_id").groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect()
    return fit(LABELLED * 4 + [x for r in some if (x := marked_by_article(r["html"]))])


def extracted(pages: DataFrame, w: Weights) -> DataFrame:
    """page_id, url, text, n_chars."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, w) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def page_texts(pages: DataFrame) -> DataFrame:
    return extracted(pages, weights_for(pages))
