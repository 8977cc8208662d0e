"""Main-text extraction by composite text density.

Every page becomes a small DOM, in one pass. Scripts, styles and other parts that hold no text of the page are cut at once; menus, page headers and footers, forms, and
containers whose class, id or role names an advert, a notice, reader comments or the like are cut unless they hold most of the page's text. For each node that is left the composite text
density is the characters per tag, adjusted by the links below it; a node's density sum adds its children's densities. The node of the largest density sum is the
heart of the article, and the threshold is the least density on the path from it to the body. An article element around the heart is taken whole. Without one, what stands beside
the path counts where its density reaches the threshold (a further section), where it is of the same kind as the path's node beside it, or where it is a heading right before what counts.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

#: The rest of a tag after its name, with quoted values; it never goes back.
_TAG_REST = re.compile(r"""(?>[^"'>]+|"[^"]*"|'[^']*')*+>""")
_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")

# Names of the HTML standard, and words of class, id and role that mark what isn't article text.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body html caption legend option optgroup tbody td tfoot th thead tr".split())
_P_SCOPE = ("td", "th", "button", "caption", "table", "div", "article", "section", "blockquote", "main")
#: A start tag of the first kind ends an open element of the second, within the third.
_SIBLING_ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
_CUT_TAGS = frozenset("head script style noscript template iframe object embed svg canvas audio video textarea title button select input xmp noembed noframes".split())
_SOFT_TAGS = frozenset("nav footer aside form dialog menu search header".split())
#: Of these only what holds the article itself is ever kept.
_OUTER_TAGS = frozenset("nav footer aside dialog menu search".split())
_CUT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices alert popup modal comment comments commentlist respond disqus share sharing social related recommended newsletter subscribe signup login pagination pager complementary contentinfo dialog search".split())
_HEADER_WORDS = frozenset("header masthead banner widget overlay".split())
_COMMENT_WORDS = frozenset("comment comments commentlist respond disqus".split())
_ARTICLE_WORDS = frozenset("article post story entry content main body text title headline page".split())
#: A class that begins so tells what else is on the page.
_MODIFIERS = ("has-", "with-", "no-", "without-", "is-", "has_", "with_", "no_")
#: Names count on containers only, not on a paragraph or a quotation.
_CONTAINERS = frozenset("div section ul ol dl table center fieldset figure details article span".split()) - {"article"}
_ARTICLE = ("article", "main")
_MARKERS = frozenset("article main h1".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Share of the page's text from which an article element is believed to be the page's article.
_ARTICLE_SHARE = 0.2


class Node:
    __slots__ = ("children", "cut", "density", "density_sum", "kind", "link_chars", "link_tags", "marked", "n_chars", "n_tags", "parent", "soft", "tag")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, soft: str = "", kind: str = ""):
        self.tag, self.parent, self.cut, self.soft, self.kind, self.children = tag, parent, cut, soft, kind, []


def _kept(node: Node) -> list[Node]:
    return [c for c in node.children if type(c) is Node and not c.cut]


class _Open:
    """The open elements, and for each tag the depths at which it is open, so that no look-up walks up."""

    def __init__(self):
        self.stack = [Node("#document", None)]
        self.depths: dict[str, list[int]] = {}
        self.block_depths: list[int] = []

    def last(self, tags) -> int:
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def push(self, node: Node) -> None:
        depth = len(self.stack)
        self.stack.append(node)
        self.depths.setdefault(node.tag, []).append(depth)
        if node.tag in _BLOCK:
            self.block_depths.append(depth)

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.depths[node.tag].pop()
            if node.tag in _BLOCK:
                self.block_depths.pop()

    def end_tag(self, tag: str) -> None:
        depth = self.last((tag,))
        # An inline end tag doesn't reach out of its block.
        if depth and (tag in _BLOCK or not self.block_depths or depth > self.block_depths[-1]):
            self.close(depth)

    def start_tag(self, tag: str) -> None:
        if tag in _CLOSES_P and (depth := self.last(("p",))) > self.last(_P_SCOPE):
            self.close(depth)
        if tag in _SIBLING_ENDS:
            ends, within = _SIBLING_ENDS[tag]
            bound = self.last(within)
            if (depth := self.last(ends)) > bound:
                # The outermost of them below the bound: a row ends its cell too.
                self.close(min(next(d for d in self.depths[t] if d > bound) for t in ends if self.depths.get(t) and self.depths[t][-1] > bound) if tag == "tr" else depth)


def parse(page: str) -> Node:
    """The page's DOM in one pass; text is kept as str children, as it stands in the page. Whatever is cut has no children. A tag that the page's end cuts off is left out with all that follows."""
    opened = _Open()
    root, place, end, strict = opened.stack[0], 0, len(page), True
    while place < end:
        at = opened.stack[-1]
        start = page.find("<", place)
        while start >= 0 and not (page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] in ("/", "!", "?")):
            start = page.find("<", start + 1)
        stop = start if start >= 0 else end
        if stop > place and not at.cut:
            at.children.append(page[place:stop])
        if start < 0:
            break
        if page[start + 1] in "!?":
            if page.startswith("<!--", start):
                close = page.find("-->", start + 2)
                place = close + 3 if close >= 0 else end
            elif page.startswith("<![CDATA[", start):
                close = page.find("]]>", start)
                if not at.cut:
                    at.children.append(html.escape(page[start + 9 : close if close >= 0 else end]))
                place = close + 3 if close >= 0 else end
            else:
                close = page.find(">", start)
                place = close + 1 if close >= 0 else end
            continue
        name = _TAG_NAME.match(page, start + 2 if page[start + 1] == "/" else start + 1)
        if not name:
            close = page.find(">", start)
            place = close + 1 if close >= 0 else end
            continue
        rest = _TAG_REST.match(page, name.end()) if strict else None
        if rest is None:  # a quote that never ends: from here on quotes count for nothing
            strict = False
        place = rest.end() if rest else page.find(">", name.end()) + 1
        if not place:
            break
        tag = name[0].lower()
        if page[start + 1] == "/":
            opened.end_tag(tag)
            continue
        opened.start_tag(tag)
        at = opened.stack[-1]
        soft, kind = _named(tag, page[name.end() : place - 1], bool(opened.last(_ARTICLE)))
        node = Node(tag, at, at.cut or tag in _CUT_TAGS or soft == "hidden", soft, kind)
        at.children.append(node)
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, place)
            node.cut, place = True, close.end() if close else end
        elif tag not in _VOID:
            opened.push(node)
    return root


def _named(tag: str, attributes: str, in_article: bool) -> tuple[str, str]:
    """Why a node may be cut (hidden, comments, outer, named, or nothing), and its kind (tag and class)."""
    soft, kind = "", tag
    if tag in _SOFT_TAGS and not (tag == "header" and in_article):
        soft = "outer" if tag in _OUTER_TAGS else "named"
    if not attributes or tag in ("html", "body"):
        return soft, kind
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden", kind
        if name not in ("class", "id", "role"):
            continue
        if name == "class":
            kind = f"{tag}.{value}"
        if tag not in _CONTAINERS:
            continue
        for word in value.split():
            parts = set(_NAME.findall(word)) if not word.startswith(_MODIFIERS) else set()
            if parts & _COMMENT_WORDS:
                soft = "comments"
            elif parts & _CUT_WORDS or parts & _HEADER_WORDS and not in_article and not parts & _ARTICLE_WORDS:
                soft = soft or "named"
    return soft, kind


def _ordered(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += reversed(_kept(node))
    return order


def _count(order: list[Node]) -> None:
    """Characters, tags, links and markers below each node, from the leaves up."""
    for node in reversed(order):
        node.n_chars = node.n_tags = node.link_chars = node.link_tags = node.marked = 0
        for c in node.children:
            if type(c) is str:
                node.n_chars += len(c) if not c.isspace() else 0
            elif not c.cut:
                node.n_chars += c.n_chars
                node.n_tags += c.n_tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
                node.marked += c.marked + (c.tag in _MARKERS)
        if node.tag == "a":
            node.link_chars = node.n_chars


def _cut_named(root: Node) -> list[Node]:
    """Cuts what tags and names mark, but for nodes that hold most of the text and the article itself; the nodes that are left, in page order."""
    order = _ordered(root)
    _count(order)
    for node in order:
        if not node.soft:
            continue
        most = 2 * node.n_chars > root.n_chars and 2 * node.link_chars < node.n_chars
        own = node.marked and most
        alone = most and node.soft == "named" and not root.marked
        node.cut = not (own or alone)
    order = _ordered(root)
    _count(order)
    return order


def _weigh(order: list[Node], body: Node) -> None:
    """Composite text densities and their sums."""
    share = body.link_chars / max(body.n_chars, 1)
    for node in reversed(order):
        c, t, lc, lt = node.n_chars, max(node.n_tags, 1), node.link_chars, node.link_tags
        # The 1 inside both logarithms keeps a page without links, whose base would be log(e) = 1, finite.
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        node.density = c / t * math.log1p(c / max(lc, 1) * t / max(lt, 1)) / math.log1p(base)
        node.density_sum = sum(x.density for x in _kept(node))


def main_nodes(root: Node) -> list[Node]:
    """The nodes that hold the article, in page order."""
    order = _cut_named(root)
    body = next((n for n in order if n.tag == "body"), root)
    _weigh(order, body)
    scope = body
    for tag in _ARTICLE:
        largest = max((n for n in order if n.tag == tag), key=lambda n: n.n_chars, default=None)
        if largest is not None and largest.n_chars >= _ARTICLE_SHARE * body.n_chars:
            scope = largest
            break
    heart = max(_ordered(scope), key=lambda n: n.density_sum)
    path = [heart]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    if around := [n for n in path if n.tag == "article"]:
        return around[:1]
    if heart is not body and (heart.tag not in _BLOCK or heart.tag in ("p", "li", "td", *_HEADINGS)):
        path = path[1:]
    return _beside_path(path, scope, threshold)


def _beside_path(path: list[Node], scope: Node, threshold: float) -> list[Node]:
    """The lowest node of the path and what counts beside the path, up to scope; in page order. Of the body itself, all but lists of links."""
    if path[0] is scope:
        parts = _kept(scope)
        gone = [c for c in parts if c.tag in _BLOCK and 2 * c.link_chars > c.n_chars and c.density < threshold] if scope.tag == "body" else []
        for c in gone:
            c.cut = True
        return [scope]
    kept = [path[0]]
    for node, above in zip(path, path[1:]):
        inner, siblings = kept, _kept(above)
        at = siblings.index(node)
        counts = [k == at or 2 * c.link_chars <= c.n_chars and c.n_chars > 0 and (c.density >= threshold or c.kind == node.kind) for k, c in enumerate(siblings)]
        for k in range(len(siblings) - 2, -1, -1):
            counts[k] = counts[k] or counts[k + 1] and siblings[k].tag in _HEADINGS
        kept = [x for k, c in enumerate(siblings) if counts[k] for x in (inner if k == at else [c])]
        if above is scope:
            break
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order, character references decoded, white space made one space."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
            line.clear()
            if text:
                out.append(text)

    stack: list = [None]
    for node in reversed(nodes):
        stack += [node, None]
    while stack:
        x = stack.pop()
        if type(x) is str:
            line.append(x)
        elif x is None:
            end()
        elif x.cut:
            if x.tag in _BLOCK:
                end()
        elif x.tag == "br":
            line.append(" ")
        else:
            if x.tag in _BLOCK:
                end()
                stack.append(None)
            stack += reversed(x.children)
    end()
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(blocks(main_nodes(parse(page))))


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with a column text_col: the main text of the whole page, blocks joined by a line feed.

    Null or empty html, and pages without an article, give an empty text. A column of the name text_col is replaced; all others stay.
    """
    schema = T.StructType([*(f for f in pages.schema.fields if f.name != text_col), T.StructField(text_col, T.StringType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keep = [c for c in part.schema.names if c != text_col]
                texts = pa.array([extract(x) for x in part[html_col].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), texts], [*keep, text_col])

    return pages.mapInArrow(tidy(run), schema)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text and n_chars (code points)."""
    found = extract_text(pages.select(F.col(id_col), F.col(url_col), F.col(html_col)), html_col, "text")
    return found.select(id_col, url_col, "text", F.length("text").cast("long").alias("n_chars"))
