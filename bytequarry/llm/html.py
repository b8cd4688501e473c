"""Main text of web pages by a minimum cut.

A page is read into blocks of text, each with its place in the element tree. A classifier (a fixed linear rule on words,
links, the names of the elements and classes around the block) gives each block a score; its size becomes the capacity to
one terminal: to the source if the block looks like content, to the sink if it looks like boilerplate. Neighbouring blocks
are joined by edges that weigh more the nearer they are in the tree, and so are successive blocks of one parent. Maximum flow
separates the two sides at the least total cost: a short line among paragraphs stays with them, a long one in a menu goes.

Row by row and narrow; a page costs time in proportion to its length and blocks, and nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Element names by their part in a page, and words in classes and ids that tell what a part is for.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
CLOSES_P = BLOCKS - frozenset("option optgroup body html head td th tr tbody thead tfoot caption legend".split())
SCOPE = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset("tr table".split()), "th": frozenset("tr table".split()), "option": frozenset(["select"])}
ELEMENT_SCORE = {"article": 2.5, "main": 1.5, "nav": -6.0, "menu": -5.0, "footer": -6.0, "aside": -5.0, "header": -4.0, "form": -5.0, "fieldset": -3.0, "dialog": -5.0, "address": -1.0, "h1": 0.5, "h2": 0.3, "h3": 0.3, "p": 0.4, "li": -0.3}
ROLE_SCORE = {"main": 1.5, "article": 2.0, "navigation": -6.0, "banner": -4.0, "contentinfo": -6.0, "complementary": -5.0, "search": -5.0, "dialog": -5.0, "alertdialog": -5.0, "alert": -4.0, "menu": -5.0, "menubar": -5.0, "form": -5.0}
BOILERPLATE = -3.0  # names and roles of this score or less are boilerplate wherever they stand
BAD_WORDS = frozenset("ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer form hidden legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion promoted recommended related replies reply respond rail search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar tracking widget".split())
GOOD_WORDS = frozenset("article articlebody body content entry main post story text".split())

TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|[!?/][^>]*(?:>|\Z))""", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
CUT = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    tag: str
    parent: Element | None
    depth: int
    score: float  # of all elements from the root to this one; a boilerplate element takes away what it inherits
    in_article: bool
    silent: bool
    part: bool = False  # lies in a boilerplate part of an article, where nothing adds to the score


@dataclass
class Block:
    parent: Element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    score: float = 0.0


def _own_score(tag: str, attributes: str, in_article: bool) -> tuple[float, bool]:
    """Of an element itself, and whether it is boilerplate whatever it lies in.

    An article or main that one of its classes calls content ("post category-legal") is not, for a bad word among the others."""
    score = ELEMENT_SCORE.get(tag, 0.0)
    if tag == "header" and in_article:
        score = 0.0
    bad = score <= BOILERPLATE
    if not attributes or attributes.isspace():
        return score, bad
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    role = ROLE_SCORE.get(found.get("role", "").strip().lower(), 0.0)
    score += role
    bad |= role <= BOILERPLATE
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        score -= 8.0
        bad = True
    if tag in ("body", "html"):
        return score, bad
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in NAME.findall(names)}
    if words & BAD_WORDS and not (in_article and words & GOOD_WORDS and words & BAD_WORDS <= {"header"}):
        score -= 5.0
        bad |= tag not in ("article", "main") or not any(n.lower() in GOOD_WORDS for n in names.split())
    elif words & GOOD_WORDS:
        score += 1.5
    return score, bad


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks of text in order; comments, scripts, styles and form controls are left out."""
    top = Element("", None, 0, 0.0, False, False)
    here, links, at = top, 0, 0
    out: list[Block] = []
    block: Block | None = None

    def add(text: str) -> None:
        nonlocal block
        if here.silent or not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(here)
            out.append(block)
        block.pieces.append(text)
        if links:
            block.linked += len(text)

    opened: dict[str, list[Element]] = {}
    open_blocks: list[Element] = []

    def enter(e: Element) -> None:
        nonlocal here
        here = e
        opened.setdefault(e.tag, []).append(e)
        if e.tag in BLOCKS:
            open_blocks.append(e)

    def leave(tag: str, stop: frozenset[str] = frozenset()) -> None:
        """Closes the nearest open element of that name, and what is open in it, unless an element of stop is nearer.

        Each element is closed once, and nothing else is walked over."""
        nonlocal here
        of_name = opened.get(tag)
        if not of_name or any(opened.get(x) and opened[x][-1].depth > of_name[-1].depth for x in stop):
            return
        target = of_name[-1]
        while True:
            e, here = here, here.parent
            opened[e.tag].pop()
            if e.tag in BLOCKS:
                open_blocks.pop()
            if e is target:
                return

    size = len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(html.unescape(page[at:]))
            break
        if start > at:
            add(html.unescape(page[at:start]))
        m = TAG.match(page, start) or LOOSE.match(page, start)
        if m is None:
            if CUT.match(page, start):
                break  # a tag that the page's end cuts off
            add("<")
            at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS or tag in NO_TEXT:
                block = None
                leave(tag)
            elif tag == "a":
                links = max(0, links - 1)
            continue
        if tag in BLOCKS or tag in NO_TEXT:
            if tag in BLOCKS:
                block = None
            if tag in CLOSES_P and open_blocks and open_blocks[-1].tag == "p":
                leave("p")
            if tag in SCOPE:
                leave(tag, SCOPE[tag])
            if tag not in VOID:
                own, bad = _own_score(tag, m[3], here.in_article)
                score = (min(here.score, 0.0) if bad else here.score) + (min(own, 0.0) if here.part else own)
                # A form may be laid around a whole page, so what lies in it can still gain.
                part = here.part or (bad and here.in_article and tag != "form")
                enter(Element(tag, here, here.depth + 1, score, here.in_article or tag in ("article", "main"), here.silent or tag in NO_TEXT, part))
        elif tag == "br":
            add(" ")
        elif tag == "a":
            links += 1
        elif tag == "body":
            leave("head")
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
            if tag == "title" and not here.silent:
                continue
    for b in out:
        raw = "".join(b.pieces)
        b.text = " ".join(raw.split())
        b.score = _block_score(b, len(raw))
    return [b for b in out if b.text]


def _block_score(b: Block, raw: int) -> float:
    """Of a block: positive for content. The classifier's costs."""
    words = b.text.count(" ") + 1
    score = b.parent.score + min(2.0, 0.5 * math.log1p(words)) - 1.0
    score -= 3.0 * b.linked / max(1, raw)
    return score + (0.4 if b.text[-1:] in ".!?…" else 0.0)


def _distance(a: Element, b: Element) -> int:
    """Steps in the tree between two elements."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie on the source's side of a least cut. source and sink: capacities of the nodes' terminals; edges (i, j,
    capacity) hold both ways. Dinic's algorithm; ties fall to the sink."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(i: int, j: int, there: int, back: int) -> None:
        out[i].append(len(to))
        to.append(j)
        room.append(there)
        out[j].append(len(to))
        to.append(i)
        room.append(back)

    for i, (a, b) in enumerate(zip(source, sink, strict=True)):
        both = min(a, b)  # flows straight through
        if a > both:
            join(s, i, a - both, 0)
        if b > both:
            join(i, t, b - both, 0)
    for i, j, c in edges:
        if c > 0:
            join(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for e in out[i]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        i = s
        while True:
            if i == t:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                # back to before the first edge that is now full
                cut = next(k for k, e in enumerate(path) if not room[e])
                i = to[path[cut] ^ 1]
                del path[cut:]
                continue
            edges_of = out[i]
            while turn[i] < len(edges_of) and not (room[edges_of[turn[i]]] and level[to[edges_of[turn[i]]]] == level[i] + 1):
                turn[i] += 1
            if turn[i] < len(edges_of):
                path.append(edges_of[turn[i]])
                i = to[path[-1]]
            elif path:
                e = path.pop()
                i = to[e ^ 1]
                turn[i] += 1
            else:
                break


NEAR, SIBLING, UNIT = 0.8, 0.5, 1000


def extract(page: str | None) -> str:
    """The main text: blocks on the content side, in page order, joined by an empty line. Null and empty pages give none."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, round(UNIT * NEAR / (1 + _distance(blocks[i - 1].parent, b.parent)))))
        family = id(b.parent.parent)
        if last.get(family, i - 1) < i - 1:
            edges.append((last[family], i, round(UNIT * SIBLING)))
        last[family] = i
    score = [round(UNIT * b.score) for b in blocks]
    side = min_cut([max(0, x) for x in score], [max(0, -x) for x in score], edges)
    return "\n\n".join(b.text for b, content in zip(blocks, side, strict=True) if content)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])


def main_text(pages: DataFrame, columns: list[str], html_col: str = "html") -> DataFrame:
    """The named columns, text and n_chars (code points) for each row; columns of those two names give way to them. Rows and
    repeated ids stay as they are; null and empty pages have an empty text, pages of any length are read whole."""
    kept = pages.select(*[F.col(f"`{c}`") for c in columns if c.lower() not in ("text", "n_chars")], F.col(html_col).alias(common.fresh("content", columns)))
    return common.map_rows(kept, _extract, drop=1, text="string", n_chars="long")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"), ["page_id", "url"])
