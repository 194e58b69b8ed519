"""Main text of web pages by composite text density.

The page becomes a tree. Every node gets characters per tag, adjusted for links: a node whose
characters are mostly link text, or whose tags are mostly links, comes out lower. A node's sum is
that of its children's densities; the node with the largest sum is the heart of the article, or, where
that is a paragraph, what holds it. The smallest density on the way from the body to it is the threshold at which other subtrees beside
that way belong to the text as well.

Elements that say themselves what they are (navigation, forms, scripts; a class or id that names
an advert, a sidebar, a notice or comments by a whole token) are taken off before. A class or id
takes off no article element, and what holds most of the page's unlinked text only beside an
article with a title (a form that holds so much stays too); else the densities in it count less.
Inside an article, words that name many things take off no paragraph, heading, list or table. Bare
text beside the way, with the inline elements in it, is tested like a subtree. Beside the part of
the way that lies in an article element, only pieces that are mostly links have to reach the
threshold: titles and short paragraphs there are few characters, and belong to it all the same.

One map over pages, each by itself.

Defined cases: null or empty html has empty text; broken markup is read as browsers do (a paragraph
ends where the next block begins; a declaration of any kind goes up to its `>`, an unfinished comment,
tag or script up to the page's end); a page with no text has none; of
subtrees with equal sums the first in the page's order is the heart; repeated rows each come out; very long and very
deep pages need time in proportion to their length (times the depth at which text lies beside the way); an empty table
gives an empty one; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is never text of the article.
DROPPED = frozenset("head script style noscript template nav aside form button select textarea input iframe object svg canvas audio video dialog menu footer".split())
#: Elements whose content isn't shown as text at all; it counts for nothing.
UNSEEN = frozenset("head script style noscript template iframe object svg canvas audio video".split())
#: A class or id names no part of the article where a whole token of it is one of these words, or is made of them and of QUALIFIERS alone.
NOISE = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|gdpr|popup|modal|newsletter|subscribe|sidebar|side|aside|widgets?|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|header|masthead|topbar|toolbar|comments?|replies|disqus|discussion|social|share|sharing|related|recommended|login|search|pagination|pager|tags?")
QUALIFIERS = frozenset("area bar block box bottom buttons center col column container content footer form global group icons inner items left links list main meta nav outer panel posts primary right row secondary section signup site slot sticky stories sub text title top unit wrap wrapper".split())
#: Words that also name the head of an article: no noise inside one, nor around its title.
HEADS = frozenset("banner header masthead".split())
#: Words that name many things: they take off none of TEXTUAL inside an article.
WEAK = frozenset("side aside foot header banner alert discussion related login search tag tags share".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption li ul ol dl dt dd table tbody tr td th section b i em strong span a".split())
#: What the density of an element counts that is noise by its class but holds most of the page's text.
DOUBT = 0.25
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())


#: Elements whose content is no markup: up to their own end tag, or the page's end.
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
_NAME, _ATTR, _BARE, _GAP = re.compile(r"[^\s/>]*+"), re.compile(r"[^\s/>][^\s/>=]*+"), re.compile(r"[^\s>]*+"), re.compile(r"[\s/]*+")
_SPACE, _COMMENT = re.compile(r"\s*+"), re.compile("--!?>")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | RCDATA}
KEPT = frozenset(("class", "id", "role", "hidden", "aria-hidden"))


def tokens(html: str):
    """("text", text), ("start", tag, attributes, closes itself) and ("end", tag) in the page's order.

    One pass forwards, without looking back: what a browser skips (comments, declarations of any kind,
    a tag that the page's end cuts off) is skipped up to where the browser would stop."""
    at, n = 0, len(html)
    text: list[str] = []
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        text.append(html[at:lt])
        if lt == n:
            break
        nxt = html[lt + 1 : lt + 2]
        after = html[lt + 2 : lt + 3]
        if nxt in ("!", "?") or nxt == "/" and after and not (after.isascii() and after.isalpha()):
            if html.startswith("<!--", lt):
                if html.startswith((">", "->"), lt + 4):
                    at = html.index(">", lt + 4) + 1
                    continue
                end = _COMMENT.search(html, lt + 4)
                at = end.end() if end else n
            else:
                end = html.find(">", lt + 1)
                at = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        begin = lt + 2 if closing else lt + 1
        if not (html[begin : begin + 1].isalpha() and html[begin : begin + 1].isascii()):
            text.append("<")
            at = lt + 1
            continue
        name = _NAME.match(html, begin)
        tag, at, attrs, itself = name[0].lower(), name.end(), {}, False
        while True:
            gap = _GAP.match(html, at)
            at, itself = gap.end(), gap[0].endswith("/")
            if at >= n:
                break  # cut off: no tag
            if html[at] == ">":
                break
            key = _ATTR.match(html, at)
            at = _SPACE.match(html, key.end()).end()
            value = ""
            if html.startswith("=", at):
                at = _SPACE.match(html, at + 1).end()
                quote = html[at : at + 1]
                if quote and quote in "\"'":
                    end = html.find(quote, at + 1)
                    value, at = (html[at + 1 : end], end + 1) if end >= 0 else ("", n)
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare[0], bare.end()
            if (k := key[0].lower()) in KEPT:
                attrs.setdefault(k, unescape(value))
        if at >= n:
            break
        at += 1
        if joined := "".join(text):
            yield "text", unescape(joined)
        text = []
        if closing:
            yield "end", tag
            continue
        yield "start", tag, attrs, itself
        if tag in _ENDS:
            end = _ENDS[tag].search(html, at)
            stop = end.start() if end else n
            if stop > at:
                yield "text", unescape(html[at:stop]) if tag in RCDATA else html[at:stop]
            at = stop
    if joined := "".join(text):
        yield "text", unescape(joined)


class Node:
    __slots__ = ("attrs", "block", "chars", "density", "doubt", "in_article", "in_main", "kids", "link_chars", "link_tags", "parent", "tag", "tags", "titled", "titled_above", "titles", "total")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str]):
        self.tag, self.parent, self.attrs, self.doubt = tag, parent, attrs, False
        self.in_article = self.in_main = False
        self.titled_above = self.titles = 0
        self.kids: list[Node | str] = []


class _Builder:
    """A tree from tokens. Open elements are on a stack, with the places of each name's and of blocks': ending one takes no search."""

    def __init__(self):
        self.root = Node("#", None, {})
        self.open: list[Node] = [self.root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of blocks but p

    def read(self, html: str) -> Node:
        for token in tokens(html):
            if token[0] == "text":
                self.open[-1].kids.append(token[1])
            elif token[0] == "start":
                self._start(*token[1:])
            elif token[1] not in VOID:
                self._end(token[1], -1 if token[1] in BLOCK else max(self.blocks[-1] if self.blocks else -1, self._last("p")))
        return self.root

    def _last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else -1

    def _start(self, tag: str, attrs: dict[str, str], itself: bool) -> None:
        if tag in BLOCK:  # an open paragraph ends here, and what stands open inside it
            self._end("p", self.blocks[-1] if self.blocks else -1)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._end(tag, max(map(self._last, ("ul", "ol", "dl", "table", "tr" if tag in ("td", "th") else "table"))))
        node = Node(tag, self.open[-1], attrs)
        self.open[-1].kids.append(node)
        if tag not in VOID and not (itself and tag not in BLOCK):
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK and tag != "p":
                self.blocks.append(len(self.open))
            self.open.append(node)

    def _end(self, tag: str, stop: int) -> None:
        """End the last open element of this name, unless something that it may not reach through (at place stop) is inside it."""
        at = self._last(tag)
        if at < 0 or at < stop:
            return
        while len(self.open) > at:
            node = self.open.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK and node.tag != "p":
                self.blocks.pop()


def _named_noise(n: Node) -> set[str]:
    """The noise words of whole tokens of an element's class and id."""
    out: set[str] = set()
    for token in f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower().split():
        words = [w for w in re.split("[_-]+", token) if w]
        noise = [w for w in words if NOISE.fullmatch(w)]
        if noise and (len(noise) == len(words) or all(w in QUALIFIERS or w.isdigit() or w in noise for w in words)):
            out.update(noise)
    return out


def _is_noise(n: Node, most: float, titled: int) -> bool:
    """Whether an element is taken off; where it is noise by name but has more than `most` unlinked characters, it stays in doubt, unless one of the titled articles stands beside it."""
    if n.tag in DROPPED - {"form"} or n.attrs.get("role", "").lower() in ROLES or "hidden" in n.attrs or n.attrs.get("aria-hidden", "").lower() == "true":
        return True
    if n.tag == "header":
        return not n.in_main
    if n.tag in ("html", "body", "main", "article"):
        return False
    named = _named_noise(n)
    if named and named <= HEADS:
        named = named if not (n.titled or n.in_main) else set()
    if n.tag in TEXTUAL and n.in_article:
        named -= WEAK
    if n.tag != "form" and not named:
        return False
    if n.chars - n.link_chars <= most:
        return True
    n.doubt = n.tag != "form"
    return n.doubt and titled > n.titled_above + n.titles


def _placed(nodes: list[Node]) -> int:
    """Which elements lie in articles, and how many titled articles lie above and in each; children come first. How many there are in all."""
    own = lambda n: n.tag in ("article", "main") and n.titled
    for n in nodes:
        n.titles = own(n) + sum(k.titles for k in n.kids if not isinstance(k, str))
    for n in reversed(nodes):
        for k in n.kids:
            if not isinstance(k, str):
                k.in_article, k.in_main = n.in_article or n.tag == "article", n.in_main or n.tag in ("article", "main")
                k.titled_above = n.titled_above + own(n)
    return nodes[-1].titles


def _up(n: Node):
    while (n := n.parent) is not None:
        yield n


def _postorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [k for k in n.kids if not isinstance(k, str)]
    return out[::-1]


def _count(nodes: list[Node]) -> None:
    """Characters, tags, and those of links; which elements hold a block or a title. Children come first."""
    for n in nodes:
        kids = [k for k in n.kids if not isinstance(k, str)]
        n.chars = sum(len("".join(k.split())) for k in n.kids if isinstance(k, str)) + sum(k.chars for k in kids)
        n.tags = len(kids) + sum(k.tags for k in kids)
        n.link_chars = n.chars if n.tag == "a" else sum(k.link_chars for k in kids)
        n.link_tags = sum(k.link_tags + (k.tag == "a") for k in kids)
        n.block = n.tag in BLOCK or any(k.block for k in kids)
        n.titled = n.tag == "h1" or any(k.titled for k in kids)


def _density(n: Node, share: float) -> float:
    if not n.chars:
        return 0.0
    base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + share * n.chars + math.e)
    ratio = n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.link_tags)
    return n.chars / max(1, n.tags) * max(0.0, math.log(max(1.0, ratio)) / max(1.0, math.log(max(math.e, base))) + 1.0)


def _measure(nodes: list[Node]) -> float:
    """Counts, then densities with the body's share of link text, which is returned."""
    _count(nodes)
    body = nodes[-1]
    share = body.link_chars / body.chars if body.chars else 0.0
    weight: dict[int, float] = {}
    for n in reversed(nodes):  # parents first: doubt holds for all below it
        weight[id(n)] = (DOUBT if n.doubt else 1.0) * (weight[id(n.parent)] if n is not body else 1.0)
        n.density = _density(n, share)
    for n in nodes:
        n.total = sum(k.density * weight[id(k)] for k in n.kids if not isinstance(k, str))
    return share


def _pieces(kids: list[Node | str], share: float) -> list[Node]:
    """Children as candidates: blocks by themselves, text and the inline elements beside it as one."""
    out: list[Node] = []
    run = False
    for k in kids:
        if not isinstance(k, str) and k.block:
            out.append(k)
            run = False
            continue
        if not run:
            out.append(Node("#", None, {}))
            run = True
        out[-1].kids.append(k)
    for n in out:
        if n.tag == "#":
            _count([n])
            n.density = _density(n, share)
    return out


def _blocks(chosen: list[Node]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def close():
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    for root in chosen:
        close()
        stack: list[Node | str | None] = [root]
        while stack:
            k = stack.pop()
            if k is None:
                close()
            elif isinstance(k, str):
                line.append(k)
            elif k.tag == "br":
                line.append(" ")
            elif k.tag in BLOCK or k is root:
                close()
                stack += [None, *reversed(k.kids)]
            else:
                stack += reversed(k.kids)
    close()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = _Builder().read(html)
    body = next((n for n in reversed(_postorder(root)) if n.tag == "body"), root)
    for n in reversed(_postorder(body)):
        n.kids = [k for k in n.kids if isinstance(k, str) or k.tag not in UNSEEN]
    _count(nodes := _postorder(body))
    most = (body.chars - body.link_chars) / 2
    for up in _up(body):
        body.in_article, body.in_main = body.in_article or up.tag == "article", body.in_main or up.tag in ("article", "main")
    titled = _placed(nodes)
    for n in reversed(nodes):  # parents first: what is off is off with all below it
        n.kids = [k for k in n.kids if isinstance(k, str) or not _is_noise(k, most, titled)]
    nodes = _postorder(body)
    share = _measure(nodes)
    if not body.chars:
        return ""
    heart = max(reversed(nodes), key=lambda n: n.total)
    if not heart.total:
        return "\n".join(_blocks([body]))
    while heart is not body and heart.parent is not body and not any(not isinstance(k, str) and k.block for k in heart.kids):
        heart = heart.parent  # a paragraph is no article: what holds it stands for it
    way = [heart, *_up(heart)]
    way = way[: way.index(body) + 1]
    threshold = min(n.density for n in way)
    inner = max((i for i, n in enumerate(way) if n.tag == "article"), default=-1)  # the way up to here lies in an article

    def belongs(k: Node, in_article: bool) -> bool:
        return in_article and 2 * k.link_chars <= k.chars or k.density * (DOUBT if k.doubt else 1.0) >= threshold

    first: list[list[Node]] = []
    last: list[Node] = []
    for i, (below, n) in enumerate(zip(way, way[1:]), 1):
        at = next(j for j, k in enumerate(n.kids) if k is below)
        first.append([k for k in _pieces(n.kids[:at], share) if belongs(k, i <= inner)])
        last += [k for k in _pieces(n.kids[at + 1 :], share) if belongs(k, i <= inner)]
    return "\n".join(_blocks([*[k for part in reversed(first) for k in part], heart, *last]))


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """pages -> page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
