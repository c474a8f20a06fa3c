"""Main text of web pages by composite text density.

Method: the page becomes a tree of elements. Elements that never hold article text (menus, headers and footers of the
page, sidebars, notices, adverts, forms, scripts, styles, reader comments, hidden parts) are left out. Where only the
words of a class or id say so, an element stays if it holds the main or largest article element or, on pages
that mark neither elsewhere, most of the text outside links: it is a wrapper, and the densities decide. Text of formulas belongs to their sentence. Every other
node gets its composite text density: characters per tag, adjusted by the share of characters and tags in links. The
node whose children's densities have the largest sum is the start of the content; an article or main element around
it stands for it. The least density on the way from the body to it is the threshold: next to that way, subtrees
at or above the threshold belong to the content too.

Text: character references decoded, white space inside a block as one space, blocks in page order joined by an empty
line, nothing else cut.

Defined cases: null or empty pages, and pages without text, give an empty text. Broken markup never fails: open
elements, also left-out ones, end where a block, list item or table cell must end them. Pages are read whole. Equal
rows each give a row. Only the columns page_id, url and html are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm.common import per_text, utf8

# Element names of the markup language, by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noscript noembed noframes xmp template svg".split())
LEFT_OUT = RAW | set(
    """head nav footer aside form button select option dialog menu object embed canvas audio video map datalist input label
    annotation annotation-xml""".split()
)
# formula markup: its text is part of the sentence, its elements count for no density
MATH = set(
    """math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms
    mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics""".split()
)
BLOCKS = set(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th
    thead tr ul caption""".split()
)
# start tag -> open elements that it ends, up to the enclosing scope
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}}
# the same for left-out elements: also parts of tables, whose end tags can be omitted too
_CELLS, _PARTS = {"tr", "td", "th", "caption"}, {"tbody", "thead", "tfoot", "colgroup"}
LEFT_ENDS = ENDS | {"tr": _CELLS | {"colgroup"}} | dict.fromkeys(_PARTS, _CELLS | _PARTS)
LEFT_SCOPES = {t: SCOPES[t] | LEFT_OUT for t in ("li", "dt", "dd")} | dict.fromkeys(("td", "th"), {"tr", "table"}) | dict.fromkeys(_PARTS | {"tr"}, {"table"})
# no block inside these ends a paragraph around them: they hold blocks, or are opened anew in the block
P_SCOPES = BLOCKS | LEFT_OUT | set("a b big code em font i nobr s small strike strong tt u".split())
HEAD = set("base basefont bgsound link meta noframes noscript script style template title head".split())
LEFT_OUT_WORDS = set(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments
    commentlist consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice
    notices pager pagination popup promo promotion promoted recommended related replies respond share sharing sidebar
    skip social sponsor sponsored subscribe subscription toolbar widget""".split()
)
LEFT_OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)|<[!?][^>]*>?|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|[\"'][^>]*>?|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _left_out(tag: str, attributes: str, in_article: bool) -> tuple[bool, set[str]]:
    """Whether the element is left out whatever it holds, and the words of its class and id that speak against it."""
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True, set()
    if not attributes or tag in ("html", "body", "main"):
        return False, set()
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return True, set()
    if "display:none" in values.get("style", "").replace(" ", "").lower():
        return True, set()
    if values.get("role", "").lower() in LEFT_OUT_ROLES:
        return True, set()
    names = f"{values.get('class', '')} {values.get('id', '')}".split()
    parts = {p.lower() for name in names if not name.startswith(("has-", "no-", "with-")) for p in _NAME_PART.findall(name)}
    found = parts & LEFT_OUT_WORDS
    return False, found & {"comment", "comments", "commentlist"} if tag == "article" else found


class _Node:
    __slots__ = ("tag", "parent", "children", "chars", "link_chars", "tags", "link_tags", "start", "end", "density", "total", "words")

    def __init__(self, tag: str, parent: _Node | None, start: int) -> None:
        self.tag, self.parent, self.children, self.start, self.end = tag, parent, [], start, start
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.words: set[str] = set()  # words of class and id that speak against it


class _Open:
    """Open elements: their tags from the outside in, and for each tag the places where it stands."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = defaultdict(list)

    def __len__(self) -> int:
        return len(self.tags)

    def push(self, tag: str) -> None:
        self.places[tag].append(len(self.tags))
        self.tags.append(tag)

    def cut(self, upto: int) -> None:
        """Ends all elements from the place ``upto`` on."""
        while len(self.tags) > upto:
            self.places[self.tags.pop()].pop()

    def innermost(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of ``tags``, -1 if there is none. As long as the set, not the page."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=-1)

    def outermost(self, tags: Iterable[str], inside: int) -> int:
        """The place of the outermost open element of ``tags`` inside of the place ``inside``, or the number of elements."""
        found = [places[bisect_right(places, inside)] for tag in tags if (places := self.places.get(tag)) and places[-1] > inside]
        return min(found, default=len(self.tags))


def _parse(html: str) -> tuple[_Node, list[str | None]]:
    """The tree without elements that are always left out, and the text runs in page order (None between blocks)."""
    root = _Node("#root", None, 0)
    runs: list[str | None] = []
    stack, standing = [root], _Open()  # open nodes, and their tags
    standing.push(root.tag)
    skipping = _Open()  # open left-out elements
    links = articles = position = 0

    def close(upto: int) -> None:
        nonlocal links, articles
        while len(stack) > upto:
            node = stack.pop()
            if node.tag in BLOCKS:
                runs.append(None)
            node.end = len(runs)
            links -= node.tag == "a"
            articles -= node.tag in ("article", "main")
        standing.cut(upto)

    def implied(ends: set[str], scopes: set[str]) -> bool:
        """Ends the outermost open left-out element of ``ends`` in the innermost scope; whether no scope was met."""
        scope = skipping.innermost(scopes - ends)
        skipping.cut(skipping.outermost(ends, scope))
        return scope < 0

    def start_in_left_out(tag: str) -> None:
        """Ends the open left-out elements that the start of ``tag`` ends, alone or with an element around them."""
        if skipping.tags[-1] == "head" and tag not in HEAD:
            skipping.cut(len(skipping) - 1)
        for ends, scopes, kept_scopes in (
            ({"p"}, P_SCOPES, BLOCKS) if tag in BLOCKS else (set(), set(), set()),
            (LEFT_ENDS.get(tag, set()), LEFT_SCOPES.get(tag, set()), SCOPES.get(tag, {"table"})),
        ):
            if ends and skipping and implied(ends, scopes) and skipping:
                around = standing.innermost({*ends, *kept_scopes})
                if around >= 0 and standing.tags[around] in ends:
                    skipping.cut(0)  # that element is closed below

    def text(value: str) -> None:
        if skipping.tags == ["head"] and value.strip():
            skipping.cut(0)
        if value and not skipping:
            value = unescape(value)
            runs.append(value)
            size = len("".join(value.split()))
            stack[-1].chars += size
            if links:
                stack[-1].link_chars += size

    while position < len(html):
        token = _TOKEN.search(html, position)
        if token is None:
            break
        text(html[position : token.start()])
        position = token.end()
        if token["end"]:
            tag = token["end"].lower()
            if skipping.places.get(tag):
                skipping.cut(skipping.places[tag][-1])
                continue
            place = standing.innermost([tag])
            if skipping and not (tag in BLOCKS and place >= 0):
                continue
            skipping.cut(0)  # the end of a block around the left-out element ends that too
            if place > 0 and (tag in BLOCKS or standing.innermost(BLOCKS) < place):
                close(place)  # an inline end tag does not end the block it stands in
        elif token["start"]:
            tag, attributes = token["start"].lower(), token["attributes"]
            if tag in RAW and not attributes.endswith("/"):
                ending = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, position)
                close_at = html.find(">", ending.start()) if ending else -1
                position = close_at + 1 if close_at >= 0 else len(html)
                continue
            if skipping:
                start_in_left_out(tag)
            if skipping:
                if tag not in VOID and not attributes.endswith("/"):
                    skipping.push(tag)
                continue
            if tag in BLOCKS:
                paragraph = standing.innermost(["p"])
                if paragraph > 0 and paragraph >= standing.innermost(BLOCKS):
                    close(paragraph)
            if tag in ENDS:
                ended = standing.innermost(ENDS[tag] - SCOPES[tag])
                if ended > 0 and ended > standing.innermost(SCOPES[tag]):
                    close(ended)
            always, words = _left_out(tag, attributes, articles > 0)
            if always or (words and (tag in VOID or attributes.endswith("/"))):
                if tag in BLOCKS:
                    runs.append(None)
                if tag not in VOID and not attributes.endswith("/"):
                    skipping.push(tag)
                continue
            if tag in MATH and not words:
                continue
            if tag in VOID:
                stack[-1].tags += 1
                runs.append(None if tag == "hr" else " " if tag == "br" else "")
                continue
            if tag in BLOCKS:
                runs.append(None)
            node = _Node(tag, stack[-1], len(runs))
            node.words = words
            stack[-1].children.append(node)
            stack.append(node)
            standing.push(tag)
            links += tag == "a"
            articles += tag in ("article", "main")
    if position < len(html):
        text(html[position:])
    close(0)
    return root, runs


def _prune(root: _Node, runs: list[str | None]) -> None:
    """Leaves out the elements whose class or id speaks against them, unless they are wrappers of the content.

    Wrappers hold the main element or the article element with most text. On a page where no such element stands
    outside of the elements in question, what holds over half of the text outside links is a wrapper too; elsewhere
    an advert or the readers' comments can be longer than the article.
    """
    nodes, named = [root], False
    for node in nodes:
        nodes += node.children
        named = named or bool(node.words)
    if not named:
        return
    plain = {node: node.chars - node.link_chars for node in nodes}
    for node in reversed(nodes[1:]):
        plain[node.parent] += plain[node]
    articles = [n for n in nodes if n.tag in ("article", "main") and not n.words and plain[n] > 0]
    marked = {node for node in nodes if node.words}
    for node in nodes[1:]:
        if node.parent in marked:
            marked.add(node)
    free = any(node not in marked for node in articles)
    wrappers = {root}
    for node in [n for n in articles if n.tag == "main"] + sorted(articles, key=plain.__getitem__)[-1:]:
        while node is not None and node not in wrappers:
            wrappers.add(node)
            node = node.parent
    open_nodes = [root]
    for node in open_nodes:
        kept = []
        for child in node.children:
            most = 2 * plain[child] > plain[root] and not free
            if child.words and child not in wrappers and not most:
                runs[child.start : child.end] = [None if child.tag in BLOCKS else ""] * (child.end - child.start)
            else:
                kept.append(child)
        node.children = kept
        open_nodes += kept


def _measure(root: _Node) -> list[_Node]:
    """Subtree counts, densities and sums of the children's densities; the nodes, parents first."""
    nodes = [root]
    for node in nodes:
        nodes += node.children
    for node in reversed(nodes):
        node.tags += len(node.children)
        node.link_tags += sum(c.tag == "a" for c in node.children)
        for child in node.children:
            node.chars += child.chars
            node.link_chars += child.link_chars
            node.tags += child.tags
            node.link_tags += child.link_tags
    body_share = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        if node.chars:
            chars, tags = node.chars, max(node.tags, 1)
            link_chars, link_tags = max(node.link_chars, 1), max(node.link_tags, 1)
            plain = max(chars - node.link_chars, 1)
            base = math.log(chars / plain * link_chars + body_share * chars + math.e)
            adjusted = math.log(max(chars / link_chars * tags / link_tags, 1.0)) / math.log(base)
            node.density = chars / tags * adjusted
        node.total = sum(child.density for child in node.children)
    return nodes


def main_text(html: str) -> str:
    """The article's text of one page."""
    root, runs = _parse(html)
    _prune(root, runs)
    nodes = _measure(root)
    if not root.chars:
        return ""
    best = max(nodes, key=lambda n: n.total)
    if best.total <= 0:
        best = max(nodes, key=lambda n: n.chars)
    way = [best]
    while way[-1].parent is not None:
        way.append(way[-1].parent)
    threshold = min(node.density for node in way if node.tag != "#root" or len(way) == 1)
    around = [k for k, node in enumerate(way) if node.tag in ("article", "main")]
    chosen = way[around[-1]] if around else best
    spans = [(chosen.start, chosen.end)]
    for inner, outer in zip(way[way.index(chosen) :], way[way.index(chosen) + 1 :], strict=False):
        spans += [(c.start, c.end) for c in outer.children if c is not inner and c.density >= threshold > 0]
    blocks = []
    for start, end in sorted(spans):
        held: list[str] = []
        for run in [*runs[start:end], None]:
            if run is not None:
                held.append(run)
            elif held:
                blocks.append(" ".join("".join(held).split()))
                held = []
    return "\n\n".join(b for b in blocks if b)


def _row(raw: bytes) -> tuple[str, int]:
    text = main_text(raw.decode())
    return text, len(text)


_udf = per_text(_row, pa.struct([("text", pa.string()), ("n_chars", pa.int64())]))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return pages.select("page_id", "url", _udf(utf8("html")).alias("found")).select("page_id", "url", "found.*")
