"""Main text of web pages by composite text density.

A page becomes a tree of elements (implied end tags and unclosed elements as browsers treat them, in time
linear in the page). For every node the characters and tags below it, and those of links, give a
link-adjusted density of characters per tag (Sun, Song and Liao, 2011); a node's sum is that of the
densities of its children. The node of the greatest sum is the core of the content; inline markup and
single paragraphs, which have no blocks to sum over, are not candidates. The least density on the core's
path to the body is the threshold: outside the core, a block is kept where its density reaches it, with the
headings before it. Where the page marks an element as the article (<article>, <main>) around the core, its
other parts need no density, and nothing outside it is kept. Elements that are boilerplate by what they are
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) take part in
no density and no text; a header inside an article is the article's own. Outside marked articles, a block
of links below the threshold is a menu too.

Defined results: null and empty pages, and pages without content, give an empty text; repeated rows give
equal texts; of equal sums the first node in page order wins. Broken or cut markup never fails: text
after an open '<' that never closes is kept as text.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
RAW = {n: re.compile(rf"</{n}\s*[^>]*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that are never article text.
DROP = frozenset("head title script style noscript template iframe svg nav menu header footer aside dialog form button select option input textarea".split())
#: Words of a class, id or role that name boilerplate.
BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|side-?bar\w*|footer|header|masthead|cookie\w*|consent|gdpr|notice\w*|alert|popup|newsletter|subscribe|signup|login|comments?|comment-?list|disqus|replies|related|recommend\w*|share|sharing|social|pagination|pager|complementary|contentinfo|navigation)(?:[\s_-]|$)",
    re.I,
)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
CLOSES = {n: frozenset(["p"]) for n in BLOCK - {"html", "body"}} | {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
SCOPE = frozenset("table ul ol dl article section div main td th body html blockquote aside nav header footer form".split())


CLOSED = frozenset(x for xs in CLOSES.values() for x in xs)


class Node:
    __slots__ = ("name", "parts", "parent", "bad", "own", "blocks", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, bad: bool):
        self.name, self.parent, self.bad, self.parts = name, parent, bad, []
        self.own = name in ("article", "main") or parent is not None and parent.own  # in a marked article


def boilerplate(name: str, attrs: str, own: bool = False) -> bool:
    """own: whether the element stands in a marked article."""
    if name in DROP:
        return not (own and name == "header")
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    names = " ".join(v.strip("\"'") for _, v in NAMED.findall(attrs)).split()
    return any((m := BAD.search(x)) and not x.lower().startswith(("has-", "with-", "no-")) and not (own and "header" in m[0].lower()) for x in names)


class _Open:
    """The open elements while a page is read. Counts of their names, by the block and the scope they stand in, tell
    whether a tag closes any, so that every step upwards closes an element."""

    def __init__(self):
        self.root = self.here = Node("#root", None, False)
        self.names: dict[str, int] = {}
        self.inline: list[dict[str, int]] = [{}]  # names since each open block
        self.scopes: list[tuple[str, dict[str, int]]] = [("", {})]  # closable names since each open scope, itself included

    def open(self, node: Node) -> None:
        name = node.name
        self.here = node
        self.names[name] = self.names.get(name, 0) + 1
        if name in BLOCK:
            self.inline.append({})
        else:
            self.inline[-1][name] = self.inline[-1].get(name, 0) + 1
        if name in SCOPE:
            self.scopes.append((name, {}))
        if name in CLOSED:
            kin = self.scopes[-1][1]
            kin[name] = kin.get(name, 0) + 1

    def close(self, node: Node) -> None:
        """Closes the open elements up to the node."""
        while True:
            x = self.here
            self.here = x.parent
            self.names[x.name] -= 1
            if x.name in BLOCK:
                self.inline.pop()
            else:
                self.inline[-1][x.name] -= 1
            if x.name in CLOSED:
                self.scopes[-1][1][x.name] -= 1
            if x.name in SCOPE:
                self.scopes.pop()
            if x is node:
                return

    def end(self, name: str) -> None:
        """An end tag; that of an inline element closes nothing beyond its block."""
        if (self.names if name in BLOCK else self.inline[-1]).get(name):
            up = self.here
            while up.name != name:
                up = up.parent
            self.close(up)

    def before(self, shuts: frozenset[str]) -> None:
        """What a start tag closes: the outermost of the given names in its scope."""
        up, last = self.here, None
        for name, kin in reversed(self.scopes):
            n = sum(kin.get(x, 0) for x in shuts)
            if not n:
                break
            while n:
                if up.name in shuts:
                    last, n = up, n - 1
                up = up.parent
            if name not in shuts:
                break
        if last is not None:
            self.close(last)


def parse(page: str) -> Node:
    tree = _Open()
    at, n = 0, len(page)
    while at < n:
        here = tree.here
        m = TOKEN.search(page, at)
        if not m:
            here.parts.append(page[at:])
            break
        if m.start() > at:
            here.parts.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            tree.end(name)
            continue
        if name in ("html", "body", "head") and (name == "html" or here.name != "#root" and here.name != "html" and here.name != "head"):
            continue
        if name == "body" and here.name == "head":
            tree.close(here)
        if name in CLOSES:
            tree.before(CLOSES[name])
        here = tree.here
        node = Node(name, here, here.bad or boilerplate(name, m[3], here.own))
        here.parts.append(node)
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = RAW[name].search(page, at)
            at = end.end() if end else n
            continue
        tree.open(node)
    return tree.root


def _ordered(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(y for y in reversed(x.parts) if isinstance(y, Node))
    return out


def core(root: Node) -> tuple[Node, float]:
    """The node of the greatest sum of its children's densities, and the threshold of its path to the body."""
    nodes = [x for x in _ordered(root) if not x.bad]
    for x in reversed(nodes):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        x.blocks = x.name in BLOCK  # or holds a block
        for y in x.parts:
            if isinstance(y, str):
                x.chars += len(y.strip())
            elif not y.bad:
                x.chars += y.chars
                x.tags += y.tags + 1
                x.link_chars += y.link_chars
                x.link_tags += y.link_tags + (y.name == "a")
                x.blocks |= y.blocks
        if x.name == "a":
            x.link_chars = x.chars
    body = next((x for x in nodes if x.name == "body"), root)
    ratio = body.link_chars / max(1, body.chars)
    for x in nodes:
        c, t, lc, lt = x.chars, max(1, x.tags), x.link_chars, max(1, x.link_tags)
        if not c:
            x.density = 0.0
            continue
        base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
        x.density = max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base)) if base > 1 else c / t
    for x in nodes:
        x.total = sum(y.density for y in x.parts if isinstance(y, Node) and not y.bad and y.blocks)
    best = max(nodes, key=lambda x: x.total)  # the first of equals
    if not best.total:
        best = body
    least, up = best.density, best
    while up is not None and up is not body.parent:
        least = min(least, up.density)
        up = up.parent
    return best, least


def _marked(node: Node) -> Node:
    """The element that the page marks as the article around the node, or the node itself."""
    found, up = None, node
    while up is not None and (found is None or found.name != "article"):
        if up.name in ("article", "main"):
            found = up
        up = up.parent
    return found or node


def _headings(node: Node) -> list[Node]:
    """Headings that stand before the node in its parent, unless it has its own."""
    if node.parent is None or node.name in ("body", "html", "article", "main"):
        return []
    before = node.parent.parts[: next(i for i, y in enumerate(node.parent.parts) if y is node)]
    return [y for y in before if isinstance(y, Node) and not y.bad and y.name in ("h1", "h2")]


def _kept(root: Node, best: Node, least: float) -> list[Node | str]:
    """What the text is made of, in page order: the core, and outside it each part that reaches the threshold."""
    top = _marked(best)
    if top.name in ("article", "main") or top is root:
        return [*_headings(top), top]
    path, up = set(), top.parent
    while up is not None:
        path.add(id(up))
        up = up.parent
    own = {id(y) for y in _headings(top)}
    out: list[Node | str] = []
    todo: list = [(root, False)]
    waiting: list[Node] = []  # headings, until a kept block follows
    while todo:
        x, inside = todo.pop()  # inside: x stands in a node that reaches the threshold, directly
        if isinstance(x, str):
            if inside:
                out.append(x)
        elif x is None:  # the end of a block: headings count for what follows within it
            waiting.clear()
        elif x.bad:
            continue
        elif x is top or id(x) in own:
            out += [*(y for y in waiting if x is top and id(y) not in own), x]
            waiting.clear()
        elif id(x) in path:
            todo.append((None, False))
            todo.extend((y, x.density >= least) for y in reversed(x.parts))
        elif x.name not in BLOCK:
            if inside and (not x.link_chars or x.density >= least):
                out.append(x)
        elif x.name in HEADS:
            waiting.append(x)
        elif x.chars and x.density >= least:
            out += [*waiting, x]
            waiting.clear()
        elif any(isinstance(y, Node) for y in x.parts):  # parts of a thin node may reach the threshold
            todo.append((None, False))
            todo.extend((y, False) for y in reversed(x.parts))
    return out


HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACE = re.compile(r"\s+")


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    best, least = core(root)
    kept = _kept(root, best, least)
    tops = {id(x) for x in kept}
    lines: list[str] = []
    held: list[str] = []

    def flush() -> None:
        line = SPACE.sub(" ", "".join(held)).strip()
        if line:
            lines.append(line)
        held.clear()

    todo: list = kept[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            held.append(html.unescape(x) if "&" in x else x)
        elif x is None:
            flush()
        elif x.bad and id(x) not in tops:
            if x.name in BLOCK:
                flush()
        elif x.name == "br":
            held.append(" ")
        else:
            block = x.name in BLOCK or x.name == "#root"
            if block:
                flush()
            if block and not x.own and x.link_tags > 2 and x.link_chars > 0.8 * x.chars and x.density < least:
                continue  # a menu that bears no name
            if block:
                todo.append(None)
            todo.extend(reversed(x.parts))
    flush()
    return "\n".join(lines)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of pages (page_id, url, html)."""

    def of(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(of, "page_id long, url string, text string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
