"""Main text of web pages from flat blocks and a small decision tree.

A page becomes a flat list of text blocks, broken at block-level tags. Each block has its
word count and link density, those of its neighbours, and what its ancestors say (a main or
article element; a navigation, header, footer, aside or form element; a class, id or role
that names page furniture). A decision tree, grown with the Gini index from the small
labelled table below, calls each block content or not; the content blocks in page order,
joined by one space, are the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ship_code, table

# Fixed values of HTML: elements whose text is never shown, that never have an end tag, and that stay within a line.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video head title select datalist textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
#: Elements that close an open element of the same kind.
ALIKE = frozenset("p li dt dd tr td th option".split())
MAIN = frozenset("article main".split())
FURNITURE = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Words of a class, id or role that name what isn't the article.
NAMES = frozenset(
    """ad ads advert advertisement advertising adverts sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay
    nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc sidebar aside rail widget widgets header masthead topbar footer colophon copyright legal
    comment comments respond reply replies discussion disqus feedback share sharing social related recommended recommendations trending newsletter subscribe subscription signup login search
    contentinfo complementary tags byline hidden""".split()
)
#: Beginnings of such words.
STEMS = ("comment", "advert", "adsby", "sponsor", "cookie", "newsletter", "sidebar", "breadcrumb", "navig", "footer")
#: Words that say only where a box stands or what kind of box it is: in a compound name the word before them names it.
BOXES = frozenset(
    """area articles bar block blocks body bottom box btn button buttons card cards cell center col column container content div element entry form frame group head holder icon icons
    info inner item items label law layer layout left line link links list lists main media message more news outer page pages pane panel part post posts primary reading region results
    right row secondary section site slot stories story tab tabs text this title toggle top unit view wrap wrapper zone""".split()
)
MAIN_NAMES = frozenset("article content main post entry story body text".split())

#: A comment, CDATA, a declaration, or the beginning of a tag with its name.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/<>]*+)""", re.S)
#: The attributes of a tag up to a quote that opens a value (one after an equals sign; other quotes are plain), or up to the tag's end.
_PLAIN = re.compile(r"""[^<>=]*+(?:=\s*+(?!["'])[^\s<>]*+[^<>=]*+)*+(?:=\s*+(["']))?""")
_BROKEN = re.compile(r"[^<>]*+")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN_ATTRIBUTE = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

FEATURES = ("in_furniture", "named_furniture", "in_header", "in_main", "named_main", "heading", "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after")


def _head(words: list[str]) -> str:
    """The word that says what a compound name names: its last one but for boxes, numbers and single letters ("social-history" is a history)."""
    return next((w for w in reversed(words) if len(w) > 1 and not w.isdigit() and w not in BOXES), "")


class _Frame:
    __slots__ = ("tag", "main", "furniture", "named", "header", "named_main", "heading", "link", "hidden")

    def __init__(self, tag: str, up: _Frame | None = None, attributes: str = ""):
        self.tag = tag
        for k in self.__slots__[1:]:
            setattr(self, k, getattr(up, k) if up else False)
        names, heads = set(), set()
        for _, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
            for name in _CAMEL.sub("-", a or b or c).lower().split():
                words = _SPLIT.split(name)
                names.update(words)
                heads.add(_head(words))
        if self.main or names & MAIN_NAMES:
            heads.discard("header")  # the head of an article is part of it
        if (heads & NAMES or any(h.startswith(STEMS) for h in heads)) and tag not in ("body", "html", "article", "main"):
            self.named = True
        elif names & MAIN_NAMES:
            self.named_main = True
        if tag in MAIN or "role" in attributes and names & {"main", "article"}:
            self.main = True
        if tag in FURNITURE:
            self.furniture = True
        if tag == "header" and not self.main:
            self.header = True
        self.heading = self.heading or len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        self.link = self.link or tag == "a"
        self.hidden = self.hidden or tag in HIDDEN or bool(attributes) and bool(_HIDDEN_ATTRIBUTE.search(attributes))


def _attributes(html: str, at: int, broken: set[int]) -> tuple[str, int]:
    """The attributes that begin at ``at``, with quoted values of any length, and where their tag ends.

    If a quote isn't closed, or a '<' comes first, the tag ends at the next '<' or '>', quoted or
    not. ``broken`` keeps the quotes that led there, so that no value of a page is passed over twice in vain.
    """
    k, opened = at, []
    while True:
        m = _PLAIN.match(html, k)
        k = m.end()
        if not m[1]:
            if html.startswith(">", k):
                return html[at:k], k + 1
            break
        shut = -1 if k in broken else html.find(m[1], k)
        opened.append(k)
        if shut < 0:
            break
        k = shut + 1
    broken.update(opened)
    k = _BROKEN.match(html, at).end()
    return html[at:k], k + html.startswith(">", k)


class _Blocks:
    """The flat text blocks of a page: (text, words, words in links, frame of the first text)."""

    def __init__(self, html: str):
        self.out: list[tuple[str, int, int, _Frame]] = []
        self.parts: list[tuple[str, bool]] = []
        self.frame: _Frame | None = None
        stack = [_Frame("html")]
        at, end = 0, len(html)
        broken: set[int] = set()
        while at < end:
            m = _TOKEN.search(html, at)
            if not m:
                self.text(html[at:], stack[-1])
                break
            if m.start() > at:
                self.text(html[at : m.start()], stack[-1])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self.raw(m[0][9:].removesuffix("]]>"), stack[-1])
                continue
            attributes, at = _attributes(html, at, broken)
            if m[1]:
                self.close(stack, tag)
                continue
            if tag == "br":
                self.raw(" ", stack[-1])
                continue
            if tag not in INLINE:
                self.flush()
            if tag in VOID or attributes.endswith("/") and tag in RAW:
                continue
            if tag in RAW:
                shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = shut.end() if shut else end
                continue
            if tag in ALIKE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if stack[k].tag not in INLINE:
                        break
            elif tag not in INLINE and tag != "html":
                # a block ends an open paragraph
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
                    if stack[k].tag not in INLINE:
                        break
            stack.append(_Frame(tag, stack[-1], attributes))
        self.flush()

    def close(self, stack: list[_Frame], tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return
            if tag in INLINE and stack[k].tag not in INLINE:
                return

    def text(self, s: str, frame: _Frame) -> None:
        self.raw(unescape(s) if "&" in s else s, frame)

    def raw(self, s: str, frame: _Frame) -> None:
        if not frame.hidden:
            if self.frame is None and not s.isspace():
                self.frame = frame
            self.parts.append((s, frame.link))

    def flush(self) -> None:
        if self.frame is not None:
            words = "".join(s for s, _ in self.parts).split()
            if words:
                linked = sum(len(s.split()) for s, link in self.parts if link)
                self.out.append((" ".join(words), len(words), min(linked, len(words)), self.frame))
        self.parts, self.frame = [], None


def blocks(html: str | None) -> tuple[list[str], np.ndarray]:
    """The blocks' texts, and a row of FEATURES for each."""
    found = _Blocks(html).out if html else []
    x = np.zeros((len(found), len(FEATURES)))
    for k, (_, words, linked, f) in enumerate(found):
        x[k, :8] = f.furniture, f.named, f.header, f.main, f.named_main, f.heading, words, linked / words
    if len(found) > 1:
        x[1:, 8:10] = x[:-1, 6:8]
        x[:-1, 10:12] = x[1:, 6:8]
    return [b[0] for b in found], x


# The labelled table: small invented pages, and for each of their blocks in page order 1 (article) or 0.
LABELLED = (
    ('<body><nav><ul><li><a href=/a>Home</a><li><a href=/b>World news</a></ul></nav><div class="ad">Buy the best shoes in town today and save a lot of money.</div><article><h1>A long day at sea</h1><p>The ship left the harbour early in the morning while most of the town was asleep.</p><p>Nobody spoke.</p><p>It rained.</p><p>By noon the wind had turned and the sails were <a href=/s>reefed</a> for the third time that week.</p></article><footer>&copy; 2020 The Gazette, all rights reserved by the publisher.</footer></body>', "000111110"),
    ('<body><header><h1>The Daily Page</h1><p>News since 1901</p></header><main><h2>Bridges</h2><p>Old bridges are often narrow because carts were narrow when these were built.</p><ul><li>Stone</li><li>Timber and iron</li></ul><p>See <a href=/x>another long page about bridges</a>.</p></main><aside><h3>Popular</h3><p>Ten bridges you have to see before the summer is over and the rains begin.</p></aside></body>', "001111100"),
    ('<body><div id="menu"><a href=/1>Start</a> <a href=/2>Shop</a></div><div id="content"><h1>Clocks</h1><p>A clock that loses a minute a day is a poor clock but a good lesson in patience.</p><p>Short one.</p></div><div id="sidebar"><p>Our shop has a sale on clocks of every size until the end of the month.</p></div><div class="comments"><p>I had such a clock when I was a child and never once did it strike the hour.</p></div></body>', "011100"),
    ('<body><div class="cookie-notice"><p>We use cookies to give you the best experience on our site, please accept them.</p><button>Accept</button></div><article><header><h1>On tea</h1></header><p>Tea is best when the water has just stopped boiling and the pot is warm.</p><section class="comments"><h3>Comments</h3><p>I disagree with all of this because coffee is better on every morning of the week.</p></section></article></body>', "001100"),
    ('<body><form><label>Your name</label><p>Please fill in the whole form so that we can answer you within a few days.</p></form><div><p>Rivers carry sand to the sea all year, and the sea carries it back to the beaches.</p><p>That is all.</p><p>Some of it stays in the dunes behind the beach where grass can hold it for a century.</p></div><div><a href=/1>One</a> | <a href=/2>Two</a> | <a href=/3>Three</a></div></body>', "001110"),
    ('<body><table><tr><td><a href=/q>Index</a><td><p>The garden was laid out in the year of the great storm by two brothers from the north.</p><p>It still stands and may be seen on Sundays when the gate is open to all.</p></table><p class="copyright">Copyright by the owners of the garden and of this page.</p></body>', "0110"),
    ('<body><article><h1>Salt</h1><p>Salt.</p><div class="advert"><p>Salt mills at half the price this week only in all of our shops.</p></div><p>Salt was money once, and a road was named after it because of the carts that brought it.</p><aside><p>Read next: why pepper was worth more than gold in the time of the great fairs.</p></aside><p>Gone.</p></article></body>', "110101"),
    ('<body><main><nav><a href=/a>Part one</a> <a href=/b>Part two</a></nav><h1>Part one</h1><p>No.</p><p><a href=/whole>This whole line of the article is a link</a></p><p>Yes, said the miller, and shut the door before the rain came in.</p><form><p>Subscribe to our letter and get a new story every week without any cost.</p></form></main><footer><p>Printed in the old town by the river. All stories are true or nearly so.</p></footer></body>', "0111100"),
    ('<body><div class="top-banner">Free delivery on all orders over twenty pounds until the end of this week.</div><div class="post"><h2>Bread</h2><p>Flour, water, salt and time make a loaf; the rest is patience and a hot oven.</p><p>Wait.</p></div><div class="related"><ul><li><a href=/1>Cakes for the winter</a></li><li><a href=/2>All about yeast</a></li></ul></div></body>', "011100"),
    ('<body><article><h1>Rope</h1><p>Hemp.</p><ul><li><a href=/h>Hemp</a></li><li>Flax is softer</li></ul><blockquote>A rope is only as good as its worst yard.</blockquote></article><div id="comments"><p>Great text, thanks a lot for writing all of this down for us!</p></div><div class="share"><a href=/t>Tweet</a></div></body>', "1111100"),
    # pages on which nothing names the furniture: words and links of a block and of its neighbours tell
    ('<body><div><a href=/1>Home</a> <a href=/2>Shop</a> <a href=/3>About us</a></div><div><h2>Wells</h2><p>A well that was dug by hand is rarely deeper than a tall tree is high.</p><p>The water was drawn with a bucket until the pump came to the village in that year.</p></div><div>Terms of use</div><div><a href=/i>Imprint</a> <a href=/k>Contact</a></div></body>', "011100"),
    ('<body><table><tr><td><a href=/n>News</a><td><a href=/s>Sport</a></table><div><p>The match was lost in the last minute when the ball hit the post and came back.</p><p>It rained.</p><p>Nobody in the stand had brought a coat, and the last bus had left an hour before.</p></div><p><b>Posted by the editor</b></p><div><a href=/o>Older</a> | <a href=/e>Newer</a></div></body>', "0011100"),
    ('<body><p>Closed today.</p></body>', "1"),
    ('<body><div><p>Snow fell on the pass all night and the road was shut to carts at dawn.</p><p>By the evening the first sledges came down with the mail and a sick man.</p></div><div>More like this</div><ul><li><a href=/1>The long winter</a><li><a href=/2>Roads over the mountains</a><li><a href=/3>Post in old times</a></ul></body>', "110000"),
    ('<body><ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul><div>You are here</div><ul><li><a href=/3>Three</a></ul><h1>Nails</h1><p>Nails were made one by one and sold by weight, so that a barn cost a year of nails.</p><p>See <a href=/h>hammers</a> for the tool that drove them and for the men who made it.</p></body>', "0000111"),
    ('<body><article><h1>Links of the week</h1><ul><li><a href=/1>A fine essay on moss</a><li><a href=/2>Stone walls</a><li><a href=/3>Hedges and how to lay them</a></ul><p>That is all for now.</p></article></body>', "11111"),
    ('<body><div><a href=/a>Start</a></div><div><h1>Ferries</h1><p>The ferry was a raft on a rope, and the river did the work of moving it across.</p><h2>Prices</h2><p>A man paid a penny, a horse paid two, and a priest went over for nothing at all.</p><h2>The end</h2><p>When the bridge was built the rope was sold to the mill, where it hangs to this day.</p></div><div>Page one of nine</div><div><a href=/2>Next page</a></div></body>', "011111100"),
    ('<body><div><a href=/1>Login</a> <a href=/2>Register</a></div><div>Get our best stories every week in your own mailbox</div><div><a href=/s>Subscribe now</a></div><p>Moss grows on the north side of trees, or so the boys of the village were told by the smith.</p><p>It grows on every side that stays wet for long enough, which in that wood was all of them.</p></body>', "00011"),
    ('<body><p>Ink was made of oak galls, iron and gum, and it was brown before it was ever black.</p><p>Old letters have faded <a href=/f>to the colour of weak tea</a> and are kept in the dark by those who own them.</p><p><a href=/b>Back to the list of all letters</a></p></body>', "110"),
    ('<body><div><h1>Kites</h1><p>Paper, string, two sticks and a windy hill.</p><p>The tail keeps it straight.</p><p>A kite without a tail spins until the string is wound up and it falls like a stone.</p></div><div><a href=/1>Tops</a> <a href=/2>Marbles</a> <a href=/3>Hoops</a></div><div>All rights are ours</div><div><a href=/p>Privacy</a></div></body>', "1111000"),
    ('<body><main><h1>Index</h1><p><a href=/1>Chapter one</a></p><p><a href=/2>Chapter two</a></p><p><a href=/3>Chapter three of the book in which the mill burns down</a></p><p>The rest is lost.</p></main><div><a href=/t>Top</a></div></body>', "111110"),
)


class Tree:
    """A binary decision tree grown with the Gini index until its leaves are pure."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.feature, self.value = -1, int(2 * y.sum() >= len(y)) if len(y) else 0
        if depth == 0 or len(set(y.tolist())) < 2:
            return
        best = None
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for cut_at in (values[1:] + values[:-1]) / 2:
                left = x[:, j] <= cut_at
                gini = sum(len(s) * (1 - (p := s.mean()) ** 2 - (1 - p) ** 2) for s in (y[left], y[~left]))
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, j, cut_at)
        if best is None:
            return
        _, self.feature, self.cut = best
        left = x[:, self.feature] <= self.cut
        self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        left = x[:, self.feature] <= self.cut
        out = np.empty(len(x), int)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled table's blocks."""
    xs, ys = [], []
    for html, labels in LABELLED:
        texts, x = blocks(html)
        if len(texts) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(texts)} blocks: {texts}")
        xs.append(x)
        ys.append([int(c) for c in labels])
    return np.concatenate(xs), np.concatenate(ys)


@cache
def tree() -> Tree:
    x, y = labelled_blocks()
    return Tree(x, y)


def main_text(html: str | None) -> str:
    """The main text of one page; empty for null, empty or contentless pages."""
    texts, x = blocks(html)
    return " ".join(t for t, keep in zip(texts, tree().predict(x), strict=True) if keep) if texts else ""


def with_main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df with a column ``out``: the main text of column ``html``, never null.

    Rows keep their order and number; a column named ``out`` that df already has is replaced.
    """
    ship_code(df.sparkSession)
    df = df.drop(out) if out != html else df
    schema = df.select("*", F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(b.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars (code points)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
