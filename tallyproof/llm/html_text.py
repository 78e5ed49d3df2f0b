"""Main text of web pages by composite text density.

The page is parsed into a tree that closes unclosed elements as browsers do. For every node are
counted characters, link characters, tags and link tags of its subtree, and its composite density

    C/T * log_b((C * T') / (L * T_l)),   b = ln(C/N * L + L_body/C_body * C + e)

where C are characters, T tags, L link characters, N the characters outside links, T_l link tags
(1 for none of any of these; T' = T): long runs of text with few tags and few links are dense. A
node's density sum adds up its children's densities, each string of its own taken for a child that
has the part of the node's density that it has of its characters. The node of the largest sum is
the core; the least density on its path to body is the threshold. On every page the text is read
off that path:

* where an article lies on the path, the outermost one is taken whole, or where the core's text is
  mostly in articles, these are; then other articles stay too that have the same parent or reach
  the threshold, unless they are half links. Failing articles, the same holds for main;
* else the core is taken whole (body never is), and what stands beside the path stays if it reaches
  half the threshold or is a heading, below body also paragraphs, lists, quotes, tables and strings;
  what is half links doesn't stay.

Nodes that can't be article text are taken out before counting: navigation, asides, footers, forms,
scripts, hidden parts, headers without an article's heading. So are nodes whose class, id or role
names an advert, a menu, sharing, a subscription, recommendations or comments; outside articles
also such as name a notice, a search, a legal note or a widget. What wraps the heading or the main
part and holds most of the page's text is never taken out.

All passes are linear in the page: open elements are found by their tag's own stack.

Defined results: null and blank pages give the empty text; repeated rows get equal results; markup
of any kind is read, since the parser refuses nothing; very deep and very long pages are read
whole; nothing of the text taken is cut; an empty table gives an empty result; other columns are
never read. Memory follows the largest page.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyproof.llm.common import map_rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text, whatever they hold.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea input label fieldset iframe object embed svg canvas audio video map dialog menu datalist math".split()
)
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header hgroup address details summary hr center".split()
)
#: An open element of the value is closed where an element of the key begins (p is closed by any block).
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"},
}
#: Elements that an end tag, or closing by CLOSES, doesn't reach over.
SCOPES = frozenset("html body table td th article section div aside nav footer header main ul ol dl".split())
#: Classes and ids, each a whole token, maybe with a number at its end: what is never part of an article.
FOREIGN = (
    "ads? adverts? advertisement advertising adsense adslot ad-(?:box|slot|unit|container|wrapper|banner) sponsor(?:ed)? "
    "cookies? cookie-(?:banner|notice|consent|bar) consent gdpr newsletter(?:-signup)? subscribe subscription signup paywall "
    "nav navbar navigation (?:main|site|top)-(?:nav|menu) menu breadcrumbs? sidebar pagination pager skip(?:-link)? "
    "related related-(?:posts|articles|stories|links) recommend(?:ed|ations?)? share share-(?:bar|buttons|links) social social-(?:bar|buttons|links|share) sharing "
    "comments comment-(?:list|form|section) commentlist disqus replies respond hidden sr-only"
)
#: What may be a part of an article, and is foreign only outside of one.
DOUBTFUL = (
    "banner promo(?:tion)? notice alert popup modal overlay side rail widget footer masthead topbar site-header site-footer page-header page-footer "
    "toolbar trending popular comment login search tags tagcloud copyright legal disclaimer"
)
IN_ARTICLE, OUTSIDE = (re.compile(f"(?:{'|'.join(x.split())})(?:[-_]?\\d+)?", re.I) for x in (FOREIGN, f"{FOREIGN} {DOUBTFUL}"))
#: Elements that a hint never takes out.
INLINE = frozenset("p h1 span a b i em strong".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
SPACE = re.compile(r"[\s ]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "chars", "link_chars", "tags", "link_tags", "density", "sum")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TAG_BEGIN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: "<" that begins no tag, with all that follow it at once.
NO_TAG = re.compile(r"<(?:<+(?![A-Za-z/!?]))?")
#: Elements whose content isn't markup, and where it ends.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
TAG_END = re.compile(r"[\s/]*>")
UNQUOTED = re.compile(r"[^\s>]*")


def attributes(page: str, at: int) -> tuple[dict[str, str] | None, int]:
    """A tag's attributes, the first of equal names, and where the tag ends; None if the page ends in it."""
    found: dict[str, str] = {}
    while True:
        end = TAG_END.match(page, at)
        if end:
            return found, end.end()
        name = ATTRIBUTE.match(page, at)
        if not name:
            return None, len(page)
        at, value = name.end(), ""
        if name[2]:
            quote = page[at : at + 1]
            if quote in ("'", '"'):
                stop = page.find(quote, at + 1)
                if stop < 0:
                    return None, len(page)
                value, at = page[at + 1 : stop], stop + 1
            else:
                value = UNQUOTED.match(page, at)[0]
                at += len(value)
        found.setdefault(name[1].lower(), unescape(value) if "&" in value else value)


LIST_ENDS, TABLE_ENDS = ("ul", "ol", "dl", "table"), ("table",)


class Tree:
    """The page as nodes and strings; every reference decoded."""

    def __init__(self):
        self.root = Node("html", {}, None)
        self.open = [self.root]
        #: Depths of the open elements of each tag, and of those that end tags don't reach over.
        self.depths: dict[str, list[int]] = defaultdict(list, html=[0])
        self.scopes = [0]

    def feed(self, page: str) -> None:
        """One pass over the page: each step goes on from where the last one ended, an open end runs to the page's end."""
        at, size = 0, len(page)
        while at < size:
            lt = page.find("<", at)
            lt = size if lt < 0 else lt
            if lt > at:
                self.text(page[at:lt])
            at = lt
            found = TAG_BEGIN.match(page, at)
            if found:
                end, tag = bool(found[1]), found[2].lower()
                attrs, at = attributes(page, found.end())
                if attrs is None:
                    return
                if end:
                    self.end(tag)
                    continue
                self.start(tag, attrs)
                if tag in RAW:
                    close = RAW[tag].search(page, at)
                    stop = close.start() if close else size
                    self.text(page[at:stop])
                    at = stop
            elif page.startswith("<!--", at):
                close = page.find("-->", at + 2 if page.startswith(("<!-->", "<!--->"), at) else at + 4)
                at = size if close < 0 else close + 3
            elif page.startswith(("<!", "<?", "</"), at):
                close = page.find(">", at)
                at = size if close < 0 else close + 1
            elif at < size:
                run = NO_TAG.match(page, at)
                self.text(run[0])
                at = run.end()

    def depth(self, tag: str) -> int:
        """Of the innermost open element of this tag; -1 for none."""
        found = self.depths.get(tag)
        return found[-1] if found else -1

    def close_from(self, depth: int) -> None:
        while len(self.open) > depth:
            tag = self.open.pop().tag
            self.depths[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            return
        if tag == "body" or tag in BLOCKS:
            at = self.depth("head")
            if at > 0:
                self.close_from(at)
        if tag in BLOCKS and self.depth("p") > self.scopes[-1]:
            self.close_from(self.depth("p"))
        closed = CLOSES.get(tag)
        if closed:
            until = max(map(self.depth, TABLE_ENDS if "td" in closed else LIST_ENDS))
            at = [d for t in closed for d in [self.depth(t)] if d > until]
            if at:
                self.close_from(min(at))
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.close_from(len(self.open) - 1)
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.depths[tag].append(len(self.open))
            if tag in SCOPES:
                self.scopes.append(len(self.open))
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].kids.append(Node("br", {}, self.open[-1]))
            return
        at = self.depth(tag)
        if at > 0 and (tag in SCOPES or at > self.scopes[-1]):
            self.close_from(at)

    def text(self, data: str) -> None:
        self.open[-1].kids.append(unescape(data) if "&" in data else data)


def foreign(node: Node, in_article: bool, has_title: bool, wraps: bool) -> bool:
    """Can't this node be text of an article?"""
    tag, attrs = node.tag, node.attrs
    if tag in ("body", "html", "article", "main"):
        return False
    if tag in DROPPED:
        return True
    if tag == "header":
        return not (in_article and has_title)
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if "style" in attrs and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs["style"]):
        return True
    if wraps or tag in INLINE:
        return False
    hints = IN_ARTICLE if in_article else OUTSIDE
    return any(hints.fullmatch(x.replace("_", "-")) for k in ("class", "id") for x in attrs.get(k, "").split())


def order(root: Node) -> list[Node]:
    """Parents before children."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return found


def prune(root: Node) -> None:
    """Take foreign nodes out. Nodes round the main part or the heading (round an article where there is neither) that hold more than half of the page's text are no foreign ones."""
    nodes = order(root)
    marks = {"main", "h1"} if any(x.tag in ("main", "h1") for x in nodes) else {"article"}
    size: dict[Node, int] = {}
    marked: set[Node] = set()
    titled: set[Node] = set()
    for x in reversed(nodes):
        size[x] = 0 if x.tag in DROPPED else sum(len(k.strip()) if isinstance(k, str) else size[k] for k in x.kids)
        if x.parent is not None:
            if x.tag in marks or x in marked:
                marked.add(x.parent)
            if x.tag in ("h1", "h2") or x in titled:
                titled.add(x.parent)
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag == "article"
        node.kids = [k for k in node.kids if isinstance(k, str) or not foreign(k, inside, k in titled, k in marked and 2 * size[k] > size[root])]
        stack.extend((k, inside) for k in node.kids if isinstance(k, Node))


def measure(body: Node) -> None:
    nodes = order(body)
    for node in reversed(nodes):
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len(SPACE.sub(" ", k).strip())
            else:
                node.chars += k.chars
                node.link_chars += k.link_chars
                node.tags += k.tags + 1
                node.link_tags += k.link_tags + (k.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        c, t, link, link_tags = max(node.chars, 1), max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        base = math.log(c / max(node.chars - node.link_chars, 1) * node.link_chars + share * node.chars + math.e)
        node.density = node.chars / t * math.log(max(c / link * t / link_tags, 1.0) + 1e-9) / max(base, 1e-9) if node.chars else 0.0
        own = sum(len(SPACE.sub(" ", k).strip()) for k in node.kids if isinstance(k, str))
        node.sum = sum(k.density for k in node.kids if isinstance(k, Node)) + own / c * node.density


#: Kinds of blocks that are taken beside the core, whatever their density, if they aren't links.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table".split())


def links(node: Node) -> bool:
    return 2 * node.link_chars > node.chars


def outermost(top: Node, tag: str) -> list[Node]:
    """In page order, the elements of this tag that lie in no other of them."""
    found, stack = [], [top]
    while stack:
        x = stack.pop()
        if x.tag == tag:
            found.append(x)
        else:
            stack.extend(k for k in reversed(x.kids) if isinstance(k, Node))
    return found


def chosen(body: Node) -> list[Node | str]:
    """The parts of main text, in page order."""
    nodes = order(body)
    core = max(nodes, key=lambda x: x.sum)
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    for tag in ("article", "main"):
        round_core = [x for x in path if x.tag == tag][-1:]
        bounds = round_core or [x for x in outermost(core, tag) if not links(x)]
        if round_core or 2 * sum(x.chars for x in bounds) > core.chars:
            parents = {x.parent for x in bounds}
            keep = {*bounds, *(x for x in outermost(body, tag) if not links(x) and (x.parent in parents or x.density >= threshold))}
            return [x for x in outermost(body, tag) if x in keep]
    on_path = set(path)
    found: list[Node | str] = []

    def stays(k: Node | str, parent: Node) -> bool:
        """Does what stands beside the path belong to it?"""
        free = parent is not body or core is body
        if isinstance(k, str):
            return free or 2 * len(k.strip()) >= threshold
        return not links(k) and (k.tag in HEADINGS or 2 * k.density >= threshold or free and k.tag in PLAIN)

    stack: list[tuple[Node | str, bool]] = [(body, True)]
    while stack:
        x, way = stack.pop()
        if not way or x is core and core is not body:
            found.append(x)
        else:
            stack.extend((k, k in on_path) for k in reversed(x.kids) if k in on_path or stays(k, x))
    return found


def blocks(tops: list[Node | str]) -> list[str]:
    """Text of each block in page order, white space inside as one space."""
    found: list[str] = []
    parts: list[str] = []

    def close():
        text = SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            found.append(text)

    stack: list = tops[::-1]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            parts.append(x)
        else:
            if x.tag == "br":
                parts.append(" ")
            if x.tag in BLOCKS:
                close()
                stack.append(None)
            stack.extend(reversed(x.kids))
    close()
    return found


def main_text(html: str | None) -> str:
    if not html or not html.strip():
        return ""
    tree = Tree()
    tree.feed(html)
    body = next((x for x in order(tree.root) if x.tag == "body"), tree.root)
    body.parent = None
    prune(body)
    measure(body)
    if not body.chars:
        return ""
    return "\n\n".join(blocks(chosen(body)))


def extract(df: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """page_id, url and text of each page."""

    def start():
        return lambda ids, urls, pages: (ids, urls, list(map(main_text, pages)))

    rows = df.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return map_rows(rows, start, "page_id bigint, url string, text string")
