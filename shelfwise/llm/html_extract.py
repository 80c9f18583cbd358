"""Main text of web pages by tree scoring.

A page is read into a tree. Every block with text of its own (a paragraph, a list item, a cell) earns
points for its length and its commas, discounted by the share of its text that stands in links, and
passes them to the containers around it, half as many for each step up. The container with the most
points, discounted by its own links, and those of its siblings that look like part of the same article
are the main text.

Forms, asides and page headers weigh a fifth and are left out, unless they hold most of the page's weighted points
all the same. So are elements that by role or name look like adverts or sidebars, but they come back only where
nothing else on the page has text to speak of: names alone never decide against the score. Reader comments,
notices and what is hidden count nothing and never come back; menus, footers and what is never shown neither.
Comments are told by their names or by their shape: after the article's text, three or more siblings alike, each with
an author or a date beside a block of text, and without headings of their own.

A list or table of links is a menu, unless it stands in an article (or main) element or between paragraphs.
Formulas and the lettering of drawings are text. A page whose only text is headings gives the headings. Character references are
decoded in each run of text by itself.

A page is read in time and memory in proportion to its length, however deep it is nested; nothing is cut.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, or is never shown.
RAW = frozenset("script style noscript template iframe object textarea title select canvas audio video".split())
#: Parts of drawings and formulas: inside the first only text in the second is shown.
QUIET, LOUD = frozenset("svg annotation annotation-xml".split()), frozenset(("text", "foreignobject"))
BLOCKS = frozenset("#root address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that points are passed to.
CONTAINERS = frozenset("#root article aside body center details dialog div fieldset form header html main section td".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements and roles that are never article text, and those that seldom are.
NEVER = frozenset("nav footer menu dialog button head".split())
SELDOM = frozenset("aside form fieldset".split())
NEVER_ROLES = frozenset("navigation banner contentinfo search menu menubar toolbar tablist dialog alertdialog".split())
SELDOM_ROLES = frozenset("complementary alert form".split())
#: Names of adverts, notices, sidebars, menus and reader comments. A class or id is one if all its parts stand here or among the neutral ones.
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense adslot sponsor sponsored promo promotion banner nav navbar navigation navi menu menubar submenu breadcrumb breadcrumbs "
    "header masthead topbar footer colophon copyright sidebar aside rail widget widgets cookie cookies consent gdpr notice notices notification alert popup popover modal overlay lightbox "
    "newsletter subscribe subscription signup signin login register share sharing social related recommend recommended recommendations comment comments commentlist disqus reply replies respond discussion "
    "feedback pagination pager paging skip skiplink toolbar tags taglist search searchbox hidden paywall".split()
)
NEUTRAL = frozenset("site page main global top bottom left right upper lower primary secondary box bar block area section list container wrapper wrap inner outer slot unit item items link links button buttons icons media reader user form more posts stories text message policy".split())
#: Of these, the names of reader comments, notices and hidden parts.
HARD = frozenset("comment comments commentlist disqus reply replies respond responses discussion kommentare commentaires comentarios cookie cookies consent gdpr notice notices notification alert hidden".split())
#: Names, and a tag, of an author or a date.
SIGN = re.compile(r"(?:^|[-_\s])(?:author|user|username|avatar|byline|nick|nickname|commenter|poster|date|time|timestamp|posted|published|ago)(?:$|[-_\s])")
#: Siblings alike, share of them that is signed, characters of paragraphs before them, and characters beside them and their heading, of comments.
ALIKE, SIGNED, TOLD, LEFT_OVER = 3, 0.8, 80, 60
#: Why an element is unwanted: by its tag, by its role or name, and for good.
TAGGED, NAMED, BARRED = 1, 2, 3
#: What an element start closes if it is still open; the search ends at the list, table or choice around it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FRAMES = frozenset("ul ol menu dl table".split())
PARTS = frozenset("li dt dd tr td th thead tbody tfoot".split()) | FRAMES
#: Weight of what looks unwanted; share of the page's points, and characters, that keep it; bonus of an article; steps that points climb; share of the best's points that a sibling needs.
UNWANTED, MOST, LEAST_CHARS, ARTICLE, STEPS, SIBLING_SHARE = 0.2, 0.5, 250, 1.5, 5, 0.2


class Node:
    __slots__ = ("tag", "name", "parent", "block", "up", "part", "items", "drop", "why", "path", "quiet", "sign", "gone", "inside", "in_link", "weight", "own", "own_linked", "commas", "points", "score", "length", "linked", "total", "heads", "titles", "headed", "plain")

    def __init__(self, tag: str, name: str, parent: Node | None):
        self.tag, self.name, self.parent = tag, name, parent
        self.items: list[Node | str] = []
        self.gone = self.quiet = self.sign = False
        self.why = self.path = 0
        #: own text of a block; sums over all that is inside
        self.own = self.own_linked = self.commas = self.length = self.linked = self.heads = self.titles = self.headed = self.plain = 0
        self.points = self.score = self.total = 0.0
        if parent is None:
            self.block, self.up, self.part, self.drop, self.inside, self.in_link, self.weight = self, None, None, False, False, False, 1.0
            return
        self.block = self if tag in BLOCKS else parent.block
        self.up = parent if parent.tag in CONTAINERS else parent.up
        self.part = self if tag in PARTS else parent.part
        self.drop, self.weight, self.path = parent.drop, parent.weight, parent.path
        self.quiet = tag not in LOUD and (parent.quiet or tag in QUIET)
        self.inside = parent.inside or tag in ("article", "main")
        self.in_link = tag == "a" or (parent.in_link and self.block is parent.block)


def _unlikely(names: str) -> int:
    """Why an element of these names is unwanted, 0 if it is not."""
    why = 0
    for name in names.split():
        parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=[0-9])", name) if p and not p.isdigit()]
        if any(p in UNLIKELY or p in HARD for p in parts) and all(p in UNLIKELY or p in HARD or p in NEUTRAL for p in parts):
            why = max(why, BARRED if any(p in HARD for p in parts) else NAMED)
    return why


def _looks(tag: str, attrs: str, inside: bool) -> tuple[bool, int, str, bool]:
    """(never article text, why it is unwanted, class, sign of an author or a date). inside: within an article or main element."""
    never, why, found, sign = tag in NEVER, TAGGED * (tag in SELDOM or (tag == "header" and not inside)), "", tag == "time"
    if not attrs.strip("/ \t\r\n") or tag in ("html", "body"):
        return never, why, found, sign
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role":
            never, why = never or value in NEVER_ROLES, max(why, NAMED * (value in SELDOM_ROLES))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            why = BARRED
        elif name in ("rel", "itemprop"):
            sign = sign or bool(SIGN.search(value))
        elif name in ("class", "id"):
            found = value if name == "class" else found
            sign = sign or bool(SIGN.search(value))
            if tag == "header" and re.search(r"\b(?:article|entry|post|story)\b", value):
                why = 0 if why == TAGGED else why
            elif tag != "main" and tag not in HEADINGS:
                why = max(why, _unlikely(value))
    return never, why, found, sign


class _Tree:
    """Nodes in page order while the page is read. Unclosed and stray tags are mended as browsers do where it matters for text."""

    def __init__(self):
        self.root = self.at = Node("#root", "", None)
        self.nodes = [self.root]
        self.open: dict[str, list[Node]] = {}

    def text(self, data: str, decode: bool = True) -> None:
        at = self.at
        if at.quiet:
            return
        data = html.unescape(data) if decode and "&" in data else data
        at.items.append(data)
        block = at.block
        if not at.drop and at.weight == block.weight and (n := len(data.strip())):
            block.own += n
            block.commas += data.count(",") + data.count("，") + data.count("、") + data.count("،")
            if at.in_link:
                block.own_linked += n

    def leave(self, node: Node) -> None:
        """Close node and all that is open inside it."""
        while self.at is not node.parent:
            self.open[self.at.tag].pop()
            self.at = self.at.parent

    def start(self, tag: str, attrs: str) -> None:
        at = self.at
        if tag in BLOCKS:  # a block ends an open paragraph, a heading an open heading
            block = at.block
            if block.tag == "p" or (block.tag in HEADINGS and tag in HEADINGS):
                self.leave(block)
        if tag in CLOSES:
            node, last = self.at.part, None
            while node is not None and node.tag not in FRAMES:
                last = node if node.tag in CLOSES[tag] else last
                node = node.parent.part
            if last is not None:
                self.leave(last)
        at = self.at
        never, why, name, sign = _looks(tag, attrs, at.inside)
        node = Node(tag, name, at)
        node.drop, node.why, node.path, node.sign = node.drop or never, why, max(node.path, why), sign
        if why:
            node.weight *= 0 if why == BARRED else UNWANTED
        at.items.append(node)
        self.nodes.append(node)
        if tag != "hr" and (not attrs.endswith("/") or tag in BLOCKS):
            self.at = node
            self.open.setdefault(tag, []).append(node)

    def end(self, tag: str) -> None:
        if (found := self.open.get(tag)) and (tag in BLOCKS or found[-1].block is self.at.block):
            self.leave(found[-1])


def parse(page: str) -> list[Node]:
    """The page's nodes in page order, the root first."""
    tree = _Tree()
    place, length = 0, len(page)
    unclosed: set[str] = set()
    while place < length:
        found = TOKEN.search(page, place)
        if found is None:
            tree.text(page[place:])
            break
        if found.start() > place:
            tree.text(page[place : found.start()])
        place = found.end()
        tag = found[2] or found[5]
        if tag is None:
            if found[0].startswith("<![CDATA["):
                tree.text(found[0][9:].removesuffix("]]>"), decode=False)
            continue
        tag, attrs = tag.lower(), found[3] or found[6] or ""
        if found[1] or found[4]:
            tree.end(tag)
        elif tag in RAW:
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, place)
            if end:
                place = end.end()
            else:
                unclosed.add(tag)
                place = length if tag in ("script", "style", "textarea", "title") else place
        elif tag == "br":
            tree.at.items.append(" ")
        elif tag not in VOID or tag == "hr":
            tree.start(tag, attrs)
    return tree.nodes


def _best(nodes: list[Node], named: bool) -> Node | None:
    """The best container; named: whether what is unwanted by name may come back."""
    whole, best, most = nodes[0].total, None, 0.0
    for node in nodes:
        kept = node.why < (BARRED if named else NAMED) and node.total > MOST * whole and node.length >= LEAST_CHARS
        node.gone = node.drop or (node.why > 0 and not kept) or (node.parent is not None and node.parent.gone)
        node.plain = 0 if node.gone or node.tag in HEADINGS else node.own - node.own_linked
        if not node.gone and node.score:
            value = node.score * (1 - node.linked / max(1, node.length)) * (ARTICLE if node.tag in ("article", "main") else 1)
            if value > most:
                best, most = node, value
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.plain += node.plain
    return best


def _bar_remarks(nodes: list[Node]) -> None:
    """Bars what has the shape of reader comments (see above), with the heading over them."""
    told: dict[int, int] = {}  # characters of paragraphs before a node
    count = 0
    for node in nodes:
        told[id(node)] = count
        if node.tag == "p" and not node.drop and node.path < BARRED and not node.sign:
            count += node.own - node.own_linked
    for node in nodes:
        runs: dict[tuple[str, str], list[Node]] = {}
        for item in node.items:
            if not isinstance(item, str) and item.sign and item.tag in BLOCKS:
                runs.setdefault((item.tag, item.name), []).append(item)
        for (tag, name), run in runs.items():
            alike = [n for n in node.items if not isinstance(n, str) and (n.tag, n.name) == (tag, name) and n.length]
            signed = sum(n.sign and not n.titles and n.own < n.length for n in alike)
            if len(alike) >= ALIKE and signed >= SIGNED * len(alike) and told[id(run[0])] >= TOLD:
                for item in alike:
                    item.why = BARRED
                around, lost = node, sum(n.length for n in alike)
                while around.tag not in ("#root", "body", "main", "article") and around.length - lost - around.headed <= LEFT_OVER:
                    around.why = BARRED
                    around = around.parent
    for node in nodes:
        if node.why == BARRED or (node.parent is not None and node.parent.weight == 0):
            node.weight = 0.0


def score(nodes: list[Node], headings: bool = False) -> Node | None:
    """Points of all nodes, from headings only where asked for; gives the best container. Children come after their parents in nodes."""
    for node in reversed(nodes):
        node.length, node.linked = node.length + node.own, node.linked + node.own_linked
        is_heading = node.tag in HEADINGS
        node.heads, node.titles, node.headed = node.heads + (node.tag == "h1"), node.titles + is_heading, node.headed + node.own * is_heading
        if (up := node.parent) is not None:
            up.length, up.linked, up.sign = up.length + node.length, up.linked + node.linked, up.sign or node.sign
            up.heads, up.titles, up.headed = up.heads + node.heads, up.titles + node.titles, up.headed + node.headed
    if any(node.sign for node in nodes):
        _bar_remarks(nodes)
    for node in nodes:
        if node.own and (headings or node.tag not in HEADINGS) and not node.drop:
            node.points = node.weight * (min(1, node.own / 25) + node.commas + min(node.own / 100, 3)) * (1 - node.own_linked / node.own)
            up, share = (node if node.tag in CONTAINERS and node.tag != "td" else node.up), 1.0
            for _ in range(STEPS):
                if up is None:
                    break
                up.score += node.points * share
                up, share = up.up, share / 2
    for node in reversed(nodes):
        node.total += node.points
        if node.parent is not None:
            node.parent.total += node.total
    best = _best(nodes, named=False)
    return best if best is not None and best.plain >= LEAST_CHARS else _best(nodes, named=True)


def _menu(node: Node, told: bool, more: bool) -> bool:
    """A list or table that is nearly all links, outside articles and not between paragraphs. told, more: whether text comes before and after it."""
    links = node.tag in ("ul", "ol", "dl", "table") and node.length > 0 and node.linked / node.length > 0.8 and sum(not isinstance(i, str) for i in node.items) > 1
    return links and not node.inside and not (told and more)


def _belongs(item: Node, best: Node) -> bool:
    """Whether a sibling of the best container is part of the same article."""
    if item is best:
        return True
    if item.gone or not item.length or item.linked / item.length >= 0.5:
        return False
    alike = item.tag in ("section", "div") and (item.tag, item.name) == (best.tag, best.name) and (item.name or item.tag == "section")
    text = item.tag in HEADINGS or item.tag in ("p", "pre", "blockquote", "ul", "ol", "dl", "table", "figure")
    return alike or text or item.heads > 0 or item.score >= SIBLING_SHARE * best.score


def _blocks(tops: list[Node]) -> list[str]:
    """Texts of the blocks below tops, in page order."""
    held: list[str] = []
    out: list[str] = []
    left = sum(n.plain for n in tops)  # characters to come

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    told = 0
    stack: list[object] = list(reversed(tops))
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            held.append(item)
        elif not item.gone:
            own = item.own - item.own_linked if item.tag not in HEADINGS else 0
            if _menu(item, told > 0, left - told > 0):
                continue
            told += own
            block = item.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(item.items))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by newlines; '' for a null or empty page, or one without article text."""
    if not page:
        return ""
    nodes = parse(page)
    best = score(nodes)
    if best is None:
        nodes = parse(page)
        best = score(nodes, headings=True)
    if best is None:
        return ""
    alone = best.parent is None or best.tag in ("body", "html")
    tops = [best] if alone else [item for item in best.parent.items if not isinstance(item, str) and _belongs(item, best)]
    return "\n".join(_blocks(tops))


def extract(pages: DataFrame) -> DataFrame:
    """pages with the column text (replacing one of that name); html may be null. Every row stays."""
    columns = [c for c in pages.columns if c != "text"]

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None).astype(object)

    return pages.select(*columns, text(F.coalesce(F.col("html"), F.lit(""))).alias("text"))
