"""Main text of HTML pages: flat text blocks, their neighbours, and a small decision tree.

A page is cut at block tags into a flat list of text blocks. A block's features are its word count and link density,
those of the blocks before and after it, and where it and they stand (in an article, in a part that its tag, class, id or
role names as boilerplate, in a heading). A decision tree over all of them, trained on the labelled blocks of TRAINING
below, says which blocks are main text. What a name says is weighed by what it holds: a form or a named part around most
of the page's text is its frame, and articles that hold less than a third of the text are cards beside it. Pages are
independent rows: no shuffle, and a page is read once from left to right, whatever is left open in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the HTML standard, and words that sites use for parts of a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = ("script", "style", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "title", "head")
CONTAINERS = frozenset("article aside body dd div dl dt fieldset figcaption figure footer form header li main menu nav ol section table tbody td th tr ul p h1 h2 h3 h4 h5 h6 a button label dialog details blockquote pre".split())
BOILERPLATE_TAGS = frozenset("aside button dialog footer form label menu nav".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising alert banner breadcrumb breadcrumbs byline captcha comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown feedback footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion recommended register related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored sponsors subscribe tags toolbar topbar widget widgets".split()
)
#: In a class name, what makes a word in it say something about the page's state rather than about the part ("has-sidebar").
STATE_WORDS = frozenset("has no not with without is are can open opened closed enabled disabled result results".split())
#: In the name of a header, what makes it the heading of the text.
CONTENT_WORDS = frozenset("article content entry headline post story".split())
#: Words for what readers say: never a frame of the text, and also read in the name of an article.
READER_WORDS = frozenset("comment comments commentlist disqus feedback replies reply respond".split())
#: Words that also name the subject or the layout of what is around the text.
FRAME_WORDS = frozenset("banner header recommended register related search share sharing sidebar skip social tags toolbar topbar widget widgets".split())
BOILERPLATE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())

#: Of these the rest of the page is theirs if their end is missing; of the others only the tag itself is left out then.
RAW = ("script", "style")
#: Parts of the page as a whole: their classes describe the page.
ROOTS = ("html", "body", "main", "article")
#: A block with so many words, few of them linked, is a paragraph; a frame holds one at least.
PARAGRAPH_WORDS = 8
#: Named parts inside each other that are told apart; a part deeper still is one with that around it.
DEEPEST = 16

_SKIP = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in SKIPPED}
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|!--|[!?])")
_TAG_EDGE = re.compile(r"=\s*([\"'])|>")


@dataclass
class Block:
    """A run of text between two block tags; parts: the numbers of the named parts that it stands in."""

    text: str
    words: int
    linked: int
    article: bool
    boilerplate: bool
    heading: bool
    parts: tuple[int, ...] = ()


@dataclass
class Part:
    """An element whose tag or name says that it is no main text."""

    soft: bool  # may be a frame of the page's text if an article, a main part or a first heading begins in it
    layout: bool  # may be one without
    holds_text: bool = False


_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _named(attributes: str, header: bool = False) -> set[str]:
    """The words by which class, id or role name a part that is not main text."""
    named: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        if name.lower() == "role":
            named |= BOILERPLATE_ROLES.intersection([value.strip().lower()])
            continue
        for token in value.split():
            words = [w for w in re.split(r"[^a-z]+", _CAMEL.sub(" ", token).lower()) if w]
            told = BOILERPLATE_WORDS.intersection(words)
            if told and STATE_WORDS.isdisjoint(words) and not (header and told == {"header"} and not CONTENT_WORDS.isdisjoint(words)):
                named |= told
    return named


def _content_header(attributes: str) -> bool:
    """Whether a header is named as that of a text."""
    words = {w for _, a, b, c in _ATTRIBUTE.findall(attributes) for w in re.split(r"[^a-z]+", _CAMEL.sub(" ", a or b or c).lower())}
    return not CONTENT_WORDS.isdisjoint(words)


class _Tags:
    """The ends of tags and of skipped elements in a page; what is not found once is never looked for again, so a page is read once."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def end(self, at: int) -> int:
        """Behind the `>` of the tag whose name ends at `at`; a quoted value may hold one. -1 if there is none."""
        while True:
            edge = None if ">" in self.missing else _TAG_EDGE.search(self.page, at)
            if not edge:
                self.missing.add(">")
                return -1
            if not edge[1]:
                return edge.end()
            closing = self.find(edge[1], edge.end())
            at = edge.end() if closing < 0 else closing + 1

    def skipped(self, name: str, at: int) -> int:
        """Behind the end tag of a skipped element; -1 if there is none."""
        if name in self.missing:
            return -1
        found = _SKIP[name].search(self.page, at)
        if not found:
            self.missing.add(name)
            return -1
        return found.end()


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; scripts, styles, comments and markup are left out."""
    out: list[Block] = []
    stack: list[tuple[str, bool, tuple[int, ...], bool]] = []  # tag, article, named parts, heading
    parts: list[Part] = []
    opened: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        nonlocal pieces
        if not pieces:
            return
        text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
        if text:
            linked = sum(len(html.unescape(p).split()) for p, in_link in pieces if in_link)
            _, article, inside, heading = stack[-1] if stack else ("", False, (), False)
            out.append(Block(text, len(text.split()), linked, article, False, heading, inside))
        pieces = []

    tags, at = _Tags(page), 0
    while at < len(page):
        tag = _MARKUP.search(page, at)
        end = len(page) if not tag else tags.end(tag.end()) if tag[2] else tags.find("-->" if tag[0] == "<!--" else ">", tag.end())
        if not tag or tag[2] and end < 0:  # no tag is closed from here on: the rest is text
            pieces.append((page[at:], links > 0))
            break
        if tag.start() > at:
            pieces.append((page[at : tag.start()], links > 0))
        if not tag[2]:
            at = len(page) if end < 0 else end + (3 if tag[0] == "<!--" else 1)
            continue
        at, attributes = end, page[tag.end() : end - 1]
        name, closing = tag[2].lower(), bool(tag[1])
        if name in _SKIP:
            if not closing and name != "head" and not attributes.rstrip().endswith("/"):  # what a head holds is skipped one by one
                end = tags.skipped(name, at)
                at = end if end >= 0 else len(page) if name in RAW else at
            continue
        if name == "a":
            links = max(0, links - 1) if closing else 1
        if name in INLINE:
            continue
        flush()
        if name not in CONTAINERS:
            continue
        if closing:
            while opened[name]:  # elements left open inside end with it
                inner = stack.pop()[0]
                opened[inner] -= 1
                if inner == name:
                    break
        elif not attributes.rstrip().endswith("/"):
            if name == "p" and stack and stack[-1][0] == "p":
                opened[stack.pop()[0]] -= 1
            _, article, inside, _ = stack[-1] if stack else ("", False, (), False)
            named = _named(attributes, header=name == "header")
            nested = name == "article" and any(x[0] == "article" for x in stack)
            if name in ROOTS:
                own = nested or name == "article" and not READER_WORDS.isdisjoint(named)
            else:
                own = bool(named) or name in BOILERPLATE_TAGS or name == "header" and not article and not _content_header(attributes)
            if (name in ("article", "main") or name == "h1") and not own:
                for k in inside:
                    parts[k].holds_text = True
            if own and len(inside) < DEEPEST:
                soft = name == "form" or name not in BOILERPLATE_TAGS and name not in ("header", "article")
                parts.append(Part(soft, name == "form" or soft and named <= FRAME_WORDS))
                inside = (*inside, len(parts) - 1)
            opened[name] += 1
            stack.append((name, article or name in ("article", "main") and not own, inside, len(name) == 2 and name[0] == "h" and name[1].isdigit()))
    flush()
    return _weighed(out, parts)


def _weighed(out: list[Block], parts: list[Part]) -> list[Block]:
    """The blocks with what their surroundings say, once it is known how much of the page's text these hold."""
    plain = [b.words - b.linked for b in out]
    held, paragraphs = [0] * len(parts), [False] * len(parts)
    for b, words in zip(out, plain, strict=True):
        for k in b.parts:
            held[k] += words
            paragraphs[k] = paragraphs[k] or words >= PARAGRAPH_WORDS
    total = sum(plain)
    frame = [p.soft and 2 * n > total and has and (p.holds_text or p.layout) for p, n, has in zip(parts, held, paragraphs, strict=True)]
    for b in out:
        b.boilerplate = any(not frame[k] for k in b.parts)
    text = sum(n for b, n in zip(out, plain, strict=True) if not b.boilerplate)
    if 3 * sum(n for b, n in zip(out, plain, strict=True) if b.article and not b.boilerplate) < text:
        for b in out:
            b.article = False
    return out


#: The columns of the features; of two splits that are as good the tree takes the earlier column.
COLUMNS = ("boilerplate", "article", "density", "density before", "density after", "boilerplate before", "boilerplate after", "words", "words before", "words after", "heading", "page has an article")


def features(found: list[Block]) -> np.ndarray:
    """A row of COLUMNS for each block."""
    words = np.array([0, *[b.words for b in found], 0], float)
    density = np.array([0, *[b.linked / b.words for b in found], 0], float)
    named = np.array([0, *[b.boilerplate for b in found], 0], float)
    own = np.array([[b.article, b.heading] for b in found], float).reshape(-1, 2)
    some = np.full(len(found), float(any(b.article for b in found)))
    around = lambda x: (x[:-2], x[2:])
    return np.stack((named[1:-1], own[:, 0], density[1:-1], *around(density), *around(named), words[1:-1], *around(words), own[:, 1], some), axis=1)


_LONG = "The quick measure of a long river is taken by those who walk along its banks every day and write down what they see there in the morning light."


def _said(*lengths: int, tag: str = "p", link: int = 0) -> str:
    """Paragraphs of so many words; every `link`th one is a link."""
    words = _LONG.split()
    texts = [" ".join(words[k % len(words)] for k in range(n)) for n in lengths]
    return "".join(f"<{tag}><a href=/{k}>{t}</a></{tag}>" if link and k % link == link - 1 else f"<{tag}>{t}</{tag}>" for k, t in enumerate(texts))


#: The labelled table: pages as (is main text, block) pairs. The blocks' features and neighbours come from the same code as at use.
TRAINING: tuple[tuple[tuple[bool, str], ...], ...] = (
    ((False, "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul></nav>"), (False, "<div class='ad'>Buy two, get one free today only.</div>"), (True, "<article><h1>A river walk</h1>"), (True, f"<p>{_LONG}</p>"), (True, "<p>Short.</p>"), (True, f"<p>{_LONG} <a href=/x>more of it</a></p></article>"), (False, f"<footer>Copyright by the walkers. {_LONG}</footer>")),
    ((False, f"<header><h1>The Site</h1><p>{_LONG}</p></header>"), (True, "<main><h2>Bread</h2>"), (True, "<p>Yes.</p>"), (True, "<ul><li>flour</li><li>water and salt</li></ul>"), (False, f"<section id='comments'><p>{_LONG}</p><p>Nice one!</p></section>"), (True, f"<p>{_LONG}</p></main>"), (False, f"<aside><p>{_LONG}</p></aside>")),
    ((False, "<div id='menu'><a href=/>Start</a> <a href=/n>News</a> <a href=/s>Sport</a></div>"), (True, "<div><h1>News of the day</h1>"), (True, f"<p>{_LONG}</p>"), (True, f"<p>{_LONG}{_LONG}</p></div>"), (False, "<div><a href=/1>Read this next</a></div>"), (False, "<div><a href=/2>And this one too</a></div>"), (False, f"<div class='cookie-notice'>{_LONG}</div>")),
    ((False, "<a href=/>Home</a>"), (False, "<p>Menu</p>"), (True, f"<p>{_LONG}</p>"), (True, f"<p>{_LONG}</p>"), (True, "<p>And so it went on.</p>"), (True, f"<p>{_LONG}</p>"), (False, f"<form><p>{_LONG}</p><label>Your name</label></form>"), (False, "<p><a href=/c>Contact</a> and <a href=/i>imprint</a></p>"), (False, "<p>2024</p>")),
    ((False, "<div class='sidebar'><h3>Popular</h3><p>One thing that many people read.</p></div>"), (True, "<article><p>Te.</p>"), (True, "<p>En la.</p>"), (True, "<p>Ed, <a href=/>see</a>.</p>"), (False, f"<div class='advert'>{_LONG}</div>"), (True, "<p><a href=/l>A paragraph that is one link</a></p></article>"), (False, "<footer>By us</footer>")),
    ((False, "<ul><li><a href=/>Up</a></li></ul>"), (False, "<div>Thursday</div>"), (True, "<article><h2>Notes</h2>"), (True, "<p>Da.</p>"), (True, "<p><a href=/k>here</a></p>"), (True, f"<p>{_LONG}</p>"), (True, "<p>An end.</p></article>")),
    ((True, "<main><p>One word.</p>"), (True, "<p>Then <a href=/>two links</a> <a href=/>in it</a></p>"), (True, "<ul><li><a href=/>first</a></li><li><a href=/>second</a></li></ul></main>"),),
    ((False, "<p><a href=/>Home</a></p>"), (False, "<p><a href=/>Map</a></p>"), (True, "<h1>On walking</h1>"), (True, f"<p>{_LONG}</p>"), (True, "<blockquote>Slowly, said the other.</blockquote>"), (True, f"<div>{_LONG}</div>")),
    # Nothing but the neighbours tells these lines apart: as long, as free of links, in no article.
    ((False, "<div><a href=/>Up one page</a></div>"), (False, "<div>Thursday the first of May</div>"), (False, "<div><a href=/m>A map of the place</a></div>"), (True, f"<div>{_LONG}</div>"), (True, "<div>And so it went on.</div>"), (True, f"<div>{_LONG}{_LONG}</div>"), (False, "<div><a href=/n>The next one</a></div>"), (False, "<div>Read by many this week</div>"), (False, "<div><a href=/o>One more</a></div>")),
    ((False, "<p><a href=/a>All of them</a></p>"), (False, "<p>Ten stories that you missed</p>"), (False, "<p><a href=/b>See the list</a></p>"), (True, f"<p>{_LONG}</p>"), (True, "<p>Nobody knew what to say then.</p>"), (True, f"<p>{_LONG}</p>"), (True, "<p>It was late.</p>"), (True, f"<p>{_LONG}{_LONG}</p>")),
    ((False, "<td><a href=/>Start</a></td>"), (False, "<td>Our shop is open all day</td>"), (False, "<td><a href=/q>Questions</a></td>"), (False, "<td>Prices from nine a month on</td>"), (False, "<td><a href=/r>Rooms</a></td>"), (True, f"<td>{_LONG}</td>"), (True, "<td>He laughed and went out again.</td>"), (True, f"<td>{_LONG}</td>")),
    ((True, f"<p>{_LONG}</p>"),),
    # Articles of paragraphs of every length, links among them; that end in a short line, or have text beside them.
    ((False, "<div>Thursday</div>"), (True, f"<article>{_said(1, 30, 2, 60, 3, 5, 28, 4, 1, 1, 9, 2, 17, 40, 3)}</article>"), (False, "<div>Filed under rivers</div>")),
    ((False, f"<div>{_said(6, 3)}</div>"), (True, f"<article>{_said(2, 1, 7, 3, 30, 5, 2, 19, 4, 33, 1, 12, 70, 6, 2, link=4)}</article>"), (False, f"<div>{_said(4, 9)}</div>")),
    ((False, f"<p>{_LONG}</p>"), (True, f"<main>{_said(12, 3, 45, 1, 2, 30, 8, 30, 2, 5, 1, 3, 26, tag='li', link=5)}</main>"), (False, f"<p>{_LONG}</p>"), (False, "<p>Two words</p>")),
    ((False, "<ul><li><a href=/>Home</a></li></ul>"), (True, f"<article><h1>A day</h1><p>{_LONG}</p>"), (True, "<p>It was over by noon.</p></article>"), (False, "<div>Posted on a Monday</div>"), (False, "<div><a href=/o>Older</a></div>")),
    ((False, "<div>Reading time: one minute</div>"), (True, f"<article><p>{_LONG}</p>"), (True, "<p>So be it, said the man.</p>"), (True, f"<p>{_LONG}</p>"), (True, "<p>Then nothing.</p></article>")),
    ((True, f"<main><p>{_LONG}</p>"), (True, f"<p>{_LONG}</p>"), (True, "<p>Good night to you all.</p></main>"), (False, "<p>Thank you for reading this far.</p>"), (False, "<p><a href=/>Start</a></p>")),
    ((True, f"<div>{_LONG}</div>"), (True, f"<div>{_LONG}</div>"), (True, "<div>That was all of it.</div>")),
    ((False, "<header>The site of those who walk</header>"), (True, f"<div>{_LONG}</div>"), (True, "<div>Gone.</div>"), (False, "<footer>Written by us</footer>")),
    ((False, "<div class='banner'>Everything must go</div>"), (True, "<h2>Of mills and millers</h2>"), (True, f"<p>{_LONG}</p>"), (False, "<div class='share'>Tell others</div>"), (True, f"<p>{_LONG}</p>"), (False, "<div class='cookies'>We use cookies</div>"), (False, "<p>All rights reserved</p>")),
    ((True, "<h1>The mill</h1>"), (True, f"<p>{_LONG}</p>"), (True, f"<p>{_LONG}</p>"), (True, f"<p>{_LONG}</p>")),
    ((False, "<p><a href=/>Start</a></p>"), (True, f"<div>{_LONG}</div>"), (True, f"<div>{_LONG}</div>"), (False, "<p><a href=/k>Contact</a></p>")),
    # Verse, dialogue and short pages; lists of links as long as a paragraph; paragraphs with links in them.
    ((True, "<h1>Title</h1>"), (True, "<p>Three words here.</p>")),
    ((True, "<p>One line.</p>"),),
    ((False, "<div><a href=/>Up</a></div>"), (False, "<div><a href=/a>All poems</a></div>"), (True, "<h1>The heron</h1>"), (True, "<p>It stood in the reeds</p>"), (True, "<p>as still as a word</p>"), (True, "<p>nobody says,</p>"), (True, "<p>and was gone.</p>"), (False, "<div><a href=/n>The next poem</a></div>"), (False, "<div><a href=/l>The last one</a></div>")),
    ((False, "<ul><li><a href=/>Home</a></li><li><a href=/p>Plays</a></li></ul>"), (True, "<h2>Second act</h2>"), (True, "<div>Where is he?</div>"), (True, "<div>Gone to the harbour, they say, and not alone.</div>"), (True, "<div>When?</div>"), (True, "<div>Before it was light.</div>"), (False, "<ul><li><a href=/3>Third act</a></li><li><a href=/i>Contents</a></li></ul>")),
    ((False, "<div>" + " ".join(f"<a href=/{k}>story {k}</a>" for k in range(12)) + "</div>"), (True, f"<div>{_LONG}</div>"), (False, "<div>" + " ".join(f"<a href=/{k}>more from the shelf number {k}</a>" for k in range(9)) + "</div>"), (True, f"<div>{_LONG}{_LONG}</div>"), (True, "<div>The end.</div>"), (False, "<div>" + " ".join(f"<a href=/t{k}>topic {k}</a>" for k in range(20)) + "</div>")),
    ((True, "<h1>Sources</h1>"), (True, "<p>Much of this is in <a href=/1>the first book</a>, some of it in <a href=/2>the second</a>, and the rest was told to me by the miller.</p>"), (True, "<p>See <a href=/3>his letters</a> too.</p>"), (True, f"<p>{_LONG}</p>"), (False, "<p><a href=/x>Contact</a></p>")),
    ((False, "<table><tr><td><a href=/>Start</a></td><td><a href=/s>Search</a></td></tr></table>"), (True, f"<p>{_LONG}</p>"), (True, "<ul><li>flour</li><li>salt</li><li>a cup of water</li></ul>"), (True, f"<p>{_LONG}</p>"), (True, "<p>Serve it warm.</p>"), (False, "<div><a href=/b>Back to all of the recipes that we have</a></div>")),
    ((True, f"<p>{_LONG}</p>"), (True, "<p>Nobody saw it again.</p>"), (False, "<p><a href=/l>Back to the list</a></p>")),
    ((False, f"<form>{_LONG}</form>"), (True, f"<article>{_LONG}</article>"), (False, f"<div>{_LONG}</div>"), (False, "<div>Four more words follow</div>")),
    ((False, f"<div role='banner'>{_LONG}</div>"), (False, "<ul><li><a href=/>Go</a></li></ul>"), (True, f"<td>{_LONG}</td>"), (True, f"<td>{_LONG}{_LONG}</td>"), (False, f"<div class='comments'><div>{_LONG}</div></div>"), (False, "<p>All rights reserved</p>")),
)


@dataclass
class Tree:
    """A binary decision tree: column < limit goes left; a leaf has the share of main text."""

    column: int = -1
    limit: float = 0.0
    share: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None or self.right is None:
            return np.full(len(x), self.share > 0.5)
        goes = x[:, self.column] < self.limit
        out = np.empty(len(x), bool)
        out[goes], out[~goes] = self.left.predict(x[goes]), self.right.predict(x[~goes])
        return out


def _split(x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
    """The split with the least Gini impurity; of equal ones the first column, and its lowest limit, wins."""
    share = float(y.mean())
    found, least = None, share * (1 - share) - 1e-9
    for column in range(x.shape[1]):
        values = np.unique(x[:, column])
        for limit in (values[1:] + values[:-1]) / 2:
            goes = x[:, column] < limit
            a, b = y[goes].mean(), y[~goes].mean()
            score = goes.mean() * a * (1 - a) + (~goes).mean() * b * (1 - b)
            if score < least - 1e-9:
                found, least = (column, float(limit)), score
    return found


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9) -> Tree:
    share = float(y.mean())
    found = None if depth == 0 or share in (0.0, 1.0) else _split(x, y)
    if not found:
        return Tree(share=share)
    goes = x[:, found[0]] < found[1]
    return Tree(*found, share, grow(x[goes], y[goes], depth - 1), grow(x[~goes], y[~goes], depth - 1))


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the training pages' blocks."""
    xs, ys = [], []
    for page in TRAINING:
        found, labels, before = [], [], ""
        for label, part in page:
            before += part
            found = blocks(before)
            labels += [label] * (len(found) - len(labels))
        xs.append(features(found))
        ys.append(np.array(labels, bool))
    return np.concatenate(xs), np.concatenate(ys)


def train() -> Tree:
    return grow(*labelled())


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, keep in zip(found, tree.predict(features(found)), strict=True) if keep)


def extract(pages: DataFrame, tree: Tree | None = None, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars): the main text of each whole page, its blocks joined by line feeds.

    One row for each row, repeated rows and ids too; an empty table gives an empty result. A null or empty page, or one
    without main text, has an empty text. What is malformed (a tag, quote or element that nothing ends) costs only itself;
    scripts and styles run to the end of the page where theirs is missing. Other columns are not read.
    """
    tree = tree or train()
    kind = pages.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", tree) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), "url", F.col(html_col).alias("html"))
    return rows.mapInArrow(read, f"id {kind}, url string, text string, n_chars bigint").withColumnRenamed("id", id_col)
