"""Main text of web pages by composite text density.

Each node's density is its characters per tag, lowered by the share of link characters and link tags. The sum of its
children's densities finds the subtree that holds the article, and the densities from there to the body set the threshold
that blocks beside it must reach. Elements that by tag, role or name are no article have no density.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas".split())
#: Elements that never hold article text, by the HTML standard's meaning of them.
APART = RAW | frozenset("head nav footer aside button select option dialog menu object audio video label".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SLASHED = BLOCK | {"a", "b", "i", "em", "strong", "span"}
LISTS = frozenset("ul ol dl table".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure".split())
#: An open element of the second kind ends when a start tag of the first kind comes.
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
FENCE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
#: Names of boilerplate in a class or id. A whole token counts, or one whose parts are all such names or words of PLACES.
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored promo promos promotion promotions nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside rail footer foot header masthead topbar"
    " cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe subscription signup login form search share sharing social related recommended recommendations comment comments commentlist respond replies reply disqus discussion"
    " copyright legal pagination pager widget toolbar hidden".split()
)
PLACES = frozenset("site page main top bottom left right primary secondary global sub post posts article articles entry links link list items item box area bar block section container wrapper wrap inner outer row col column the and".split())
#: Inside an article, or with a word for it, such a block holds the title.
HEADS = frozenset("header masthead".split())
#: Names that layouts and scripts give to wrappers of a whole page too; the others name what stands beside an article.
WRAPPERS = HEADS | frozenset("form hidden modal overlay popup search login signup toolbar".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The usual form of a tag; others are read attribute by attribute.
PLAIN, PLAIN_ATTR = re.compile(r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z-]+="[^"<>]*")*)>'), re.compile(r'([a-zA-Z-]+)="([^"]*)"')
RAW_END = {t: re.compile(rf"</{t}(?=[ \t\n\f\r/>])", re.I) for t in RAW}
GAP, ATTR, EQUALS, BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "up", "kids", "apart", "chars", "tags", "link_chars", "link_tags", "density", "total", "chosen", "doubt", "in_text")

    def __init__(self, tag: str, up: Node | None, apart: bool, doubt: str = ""):
        self.tag, self.up, self.apart, self.doubt = tag, up, apart, doubt
        self.kids: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.chosen = False
        self.in_text = tag in ("article", "main", "section") or (up is not None and up.in_text)


def _named(value: str, up: Node) -> str:
    """The kind of doubt that a class or id raises, by its tokens."""
    for token in value.lower().split():
        parts = [x for x in re.split(r"[_-]+", token) if x]
        names = APART_NAMES.intersection(parts)
        if not names or not APART_NAMES.union(PLACES).issuperset(parts):
            continue
        if names <= HEADS and (not {"page", "post", "posts", "article", "articles", "entry", "section"}.isdisjoint(parts) or up.in_text):
            continue
        return "named" if names <= WRAPPERS else "beside"
    return ""


def _doubt(tag: str, attrs: dict[str, str], up: Node) -> str:
    """Why an element may be boilerplate unless it turns out to hold the article: "", "named" or "beside".

    Class, id and role of inline elements within prose say nothing: they mark words of a sentence.
    """
    if tag in ("html", "body", "article", "main"):
        return ""
    found = "named" if tag == "form" else ""
    if not attrs:
        return found
    words = tag not in BLOCK and (up.tag in PROSE or up.tag not in BLOCK)
    for name in () if words else ("class", "id"):
        found = found or _named(attrs.get(name, ""), up)
    role = attrs.get("role", "").strip().lower()
    if role in APART_ROLES and not words:
        found = "named" if role in ("form", "search", "dialog") else "beside"
    if "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        found = found or "named"
    return found


def _settle(root: Node) -> None:
    """Sets doubtful elements apart, unless they hold the page's ``main``, an article or most text outside links.

    What stands beside an article must hold every article of the page, or most text of a page without any.
    """
    nodes, held = _walk(root), {}
    for node in reversed(nodes):
        prose, articles, main = 0, int(node.tag == "article"), node.tag == "main"
        for kid in node.kids:
            if isinstance(kid, str):
                prose += len(SPACE.sub("", kid))
            elif not kid.apart:
                p, n, m = held[id(kid)]
                prose, articles, main = prose + (p if kid.tag != "a" else 0), articles + n, main or m
        held[id(node)] = prose, articles, main
    text, every, _ = held[id(root)]
    for node in nodes:
        prose, articles, main = held[id(node)]
        most = 2 * prose > text
        spared = main or (articles == every and (articles > 0 or most) if node.doubt == "beside" else articles > 0 or most)
        node.apart = (node.up is not None and node.up.apart) or (node.doubt != "" and not spared)


NONE: dict[str, str] = {}


class Scanner:
    """Texts and tags of a page in order, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        #: Marks known not to come any more, which are never searched for again.
        self.gone: set[str] = set()

    def find(self, mark: str, start: int) -> int:
        if mark in self.gone:
            return -1
        at = self.page.find(mark, start)
        if at < 0:
            self.gone.add(mark)
        return at

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Attributes from ``at`` on by the rules of HTML, the first of a name, and the place after ``>``; -1 without one."""
        page, end, found = self.page, len(self.page), {}
        while True:
            at = GAP.match(page, at).end()
            if at >= end:
                return found, -1
            if page[at] == ">":
                return found, at + 1
            m = ATTR.match(page, at)
            name, value, at = m.group().lower(), "", m.end()
            if m := EQUALS.match(page, at):
                at = m.end()
                if page[at : at + 1] in ("'", '"') and (close := self.find(page[at], at + 1)) >= 0:
                    value, at = page[at + 1 : close], close + 1
                else:
                    m = BARE.match(page, at)
                    value, at = m.group(), m.end()
            found.setdefault(name, html.unescape(value) if "&" in value else value)

    def raw_end(self, tag: str, at: int) -> int:
        """The place after the end tag of a raw element, the page's end without one."""
        m = RAW_END[tag].search(self.page, at)
        close = self.find(">", m.end()) if m else -1
        return len(self.page) if close < 0 else close + 1

    def tokens(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        """(kind, tag or text, attributes) with kind "text", "open", "void" (a tag that ends in a slash) or "close"."""
        page, end = self.page, len(self.page)
        while self.at < end:
            start = self.find("<", self.at)
            if start < 0:
                yield "text", page[self.at :], NONE
                return
            if start > self.at:
                yield "text", page[self.at : start], NONE
            if m := PLAIN.match(page, start):
                close, tag, rest = m.groups()
                self.at = m.end()
                attrs = {k.lower(): html.unescape(v) for k, v in reversed(PLAIN_ATTR.findall(rest))} if rest else NONE
                yield "close" if close else "open", tag.lower(), attrs
                continue
            mark, closes = page[start + 1 : start + 2], page.startswith("</", start)
            if m := NAME.match(page, start + 1 + closes):
                tag, at = m.group().lower(), m.end()
                attrs, at = ({}, at + 1) if page[at : at + 1] == ">" else self.attributes(at)
                if at < 0:  # the page ends inside a tag
                    return
                self.at = at
                yield "close" if closes else "void" if page[at - 2] == "/" else "open", tag, attrs
            elif mark and mark in "!?/":
                if page.startswith("<!--", start):
                    close = self.find("-->", start + 4)
                    # <!--> and <!---> are whole comments
                    self.at = start + (5 if page.startswith("<!-->", start) else 6) if page.startswith(("<!-->", "<!--->"), start) else end if close < 0 else close + 3
                elif page.startswith("<![CDATA[", start) and (close := self.find("]]>", start)) >= 0:
                    yield "data", page[start + 9 : close], NONE
                    self.at = close + 3
                else:
                    close = self.find(">", start)
                    self.at = end if close < 0 else close + 1
            else:
                yield "text", "<", NONE
                self.at = start + 1


def parse(page: str) -> Node:
    """A tree of nodes and texts; unclosed and stray tags are repaired, character references decoded."""
    root = top = Node("html", None, False)
    open_tags: Counter[str] = Counter()  # so that nothing is looked for that isn't there
    scan = Scanner(page)

    def leave(node: Node) -> None:
        nonlocal top
        while top is not node:
            open_tags[top.tag] -= 1
            top = top.up

    for kind, tag, attrs in scan.tokens():
        if kind in ("text", "data"):
            top.kids.append(html.unescape(tag) if "&" in tag and kind == "text" else tag)
            continue
        if tag == "html":
            continue
        if kind == "close":
            if open_tags[tag]:
                node = top
                while node.tag != tag:
                    node = node.up
                leave(node.up)
            continue
        if tag in ENDS_P and open_tags["p"]:
            node = top
            while node.up is not None and node.tag != "p" and node.tag not in ENDS_P and node.tag not in ("td", "th", "body"):
                node = node.up
            if node.tag == "p":
                leave(node.up)
        if tag in ENDS and any(open_tags[t] for t in ENDS[tag]):
            node, fence = top, FENCE.get(tag, ())
            while node.up is not None and node.tag not in ENDS[tag] and node.tag not in fence:
                node = node.up
            if node.tag in ENDS[tag]:
                leave(node.up)
                if tag == "tr" and top.tag == "tr":
                    leave(top.up)
        hard = top.apart or tag in APART or (tag == "header" and not top.in_text)
        node = Node(tag, top, hard, "" if hard else _doubt(tag, attrs, top))
        top.kids.append(node)
        if tag in RAW:
            scan.at = scan.raw_end(tag, scan.at)
        elif tag not in VOID and (kind == "open" or tag in SLASHED):  # HTML ignores the slash of a tag that isn't void
            open_tags[tag] += 1
            top = node
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes that may hold article text, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.apart)
    return out


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        for kid in node.kids:
            if isinstance(kid, str):
                node.chars += len(SPACE.sub("", kid))
            elif not kid.apart:
                node.chars += kid.chars
                node.tags += kid.tags + 1
                node.link_chars += kid.chars if kid.tag == "a" else kid.link_chars
                node.link_tags += kid.link_tags + (kid.tag == "a")
    body = nodes[0]
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        if not node.chars:
            continue
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        node.density = c / t * math.log(c / max(lc, 1) * t / max(lt, 1) + 1) / max(math.log(base + 1), 1e-9)
    for node in reversed(nodes):
        # inline markup is part of its block: only blocks count as children
        node.total = sum(k.density if k.tag in BLOCK else k.total for k in node.kids if isinstance(k, Node) and not k.apart)


def _drop_menus(top: Node) -> None:
    """Sets blocks of two links or more apart whose text is mostly link text; paragraphs and headings stay."""
    stack = [top]
    while stack:
        node = stack.pop()
        inner = [k for k in node.kids if isinstance(k, Node) and not k.apart]
        if node.tag in LISTS or not any(k.tag in BLOCK for k in inner):
            node.apart = node.tag in BLOCK and node.tag not in PROSE and node.link_tags > 1 and 2 * node.link_chars > node.chars
        else:
            stack += inner


def _densest(nodes: list[Node]) -> Node:
    """The block whose children's densities have the largest sum; of equal sums the outer one."""
    best: dict[int, Node] = {}
    for node in reversed(nodes):
        top = node
        for kid in node.kids:
            if isinstance(kid, Node) and not kid.apart and best[id(kid)].tag in BLOCK and best[id(kid)].total > top.total:
                top = best[id(kid)]
        best[id(node)] = top
    return best[id(nodes[0])]


#: Share of the least density between article and body that a block beside the article must reach.
BESIDE = 0.2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _choose(nodes: list[Node]) -> None:
    """Marks what holds the article: the maximum-sum subtree, or the ``article`` or else ``main`` around it, whole but for
    boilerplate, and on the way up to the body every block beside it that is as dense as the threshold that this way sets.

    The threshold is the least density of the nodes from the subtree to the body, times BESIDE; menus don't reach it. A heading
    with the paragraphs after it, if any, goes with the kept block that follows them.
    """
    path = [_densest(nodes)]
    while path[-1].up is not None:
        path.append(path[-1].up)
    kept = max((i for i, n in enumerate(path) if n.tag == "article"), default=max((i for i, n in enumerate(path) if n.tag == "main"), default=0))
    least = BESIDE * min(n.density for n in path)
    path[kept].chosen = True
    for below, node in zip(path[kept:], path[kept + 1 :], strict=False):
        before: list[Node] | None = None  # prose between here and the kept block that follows it directly
        for kid in reversed(node.kids):
            if isinstance(kid, str):
                before = None if kid.strip() else before
                continue
            if kid is below:
                before = []
                continue
            if kid.apart or not kid.chars:
                continue
            _drop_menus(kid)
            kid.chosen = not kid.apart and kid.density > 0 and kid.density >= least
            if before is not None and kid.tag in HEADINGS:
                for head in [kid, *before]:
                    head.chosen = True
                before = []
            elif kid.chosen:
                before = []
            elif before is not None:
                before = [*before, kid] if kid.tag in PROSE else None


def _blocks(root: Node) -> list[str]:
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        line = SPACE.sub(" ", "".join(buffer)).strip()
        buffer.clear()
        if line:
            out.append(line)

    stack: list[tuple[Node | str | None, bool]] = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if inside:
                buffer.append(node)
        elif not node.apart:
            inside = inside or node.chosen
            if node.tag == "br":
                buffer.append(" ")
                continue
            if node.tag in BLOCK:
                flush()
                stack.append((None, inside))
            stack.extend((k, inside) for k in reversed(node.kids))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by newlines; empty for null or empty pages and pages without text."""
    if not page:
        return ""
    root = parse(page)
    _settle(root)
    nodes = _walk(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    if body is not root:
        body.up = None
        # text after a stray </body> stays in reach
        body.kids += [k for k in root.kids if k is not body and not (isinstance(k, Node) and k.tag == "head")] if body in root.kids else []
    nodes = _walk(body)
    _measure(nodes)
    if not body.chars:
        return ""
    _choose(nodes)
    return "\n".join(_blocks(body))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each page from its whole html.

    One row per row of ``pages``, repeated rows included, without a shuffle. Null, empty and textless html give an empty
    text; null ids and urls stay null; an empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_batches, "page_id bigint, url string, text string, n_chars bigint")
