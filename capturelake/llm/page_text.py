"""Main text of web pages by wrapper induction over the pages of a host.

The DOM trees of all pages of a host are aligned. The wrapper is their merged tree: siblings with the
same tag and first mark are one node, and a node that any page has is in it. A text that a node has in
nearly all pages that have the node is template; so is one that it has in nearly all such pages of one
layout (the sections at the top of the body). Pages count once per text outside the elements that are
never content, so copies of an article do not make it template. Every page is then aligned with the
wrapper by simple tree matching: what meets a template node with a text of that node goes, what lies in
a slot stays. Slots that hold menus, adverts, forms, comments and the like by their element or class are
no content either, and where a page has an article (or else a main) element, only slots inside it are.

Texts of nodes are counted over all pages in a Spark aggregation by (host, layout, path, text); nothing
is sampled. What is kept of a host are the nodes with template text, which is what comes to a page. Pages
of a hot host stay where they are read: its wrapper is broadcast, which at most HOT_KEYS hosts can be.

Defined results: null or empty html has empty text; a page without host is read with an empty wrapper;
a node is template only with LEAST different page texts; repeated rows give a row each; other columns are
ignored; an empty table gives an empty result. Paths and texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import join_groups, working_table

#: Different page texts below which no node is template.
LEAST = 5
#: Share of the aligned pages in which a template node has the same text.
CONSTANT = 0.8
#: Layout under which the pages of all layouts are counted together.
ALL = 0
#: Elements nested deeper than this lie side by side in the tree; their text stays in place.
DEPTH = 200
#: Rows of counts that a task hands over at once.
ROWS = 1 << 16
SCHEMA = "page_id long, url string, text string, n_chars long"

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|"""
                   r"""<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)""", re.S)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "img", "wbr"}
#: Elements that a start tag of the kind closes, up to the nearest container.
CLOSED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
CONTAINER = {"html", "body", "article", "main", "section", "div", "ul", "ol", "dl", "table", "tbody", "thead", "nav",
             "aside", "header", "footer", "form", "blockquote", "td", "th", "figure"}
OUT = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "button", "select",
       "textarea", "svg", "canvas", "object", "dialog", "menu", "title"}
OUT_MARKS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "contentinfo", "cookie", "cookies", "disqus", "footer", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "recommended", "related", "replies",
    "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Elements of the first two levels of the body that tell layouts apart.
SECTIONS = {"div", "section", "main", "article", "header"}
HEADER_MARKS = {"header", "masthead", "site-header", "topbar"}


class Node:
    __slots__ = ("tag", "marks", "items", "many")

    def __init__(self, tag: str, marks: tuple[str, ...] = ()):
        #: items: text and child nodes in page order.
        self.tag, self.marks, self.items, self.many = tag, marks, [], False

    @property
    def children(self) -> list[Node]:
        return [x for x in self.items if type(x) is not str]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if type(x) is str:
                out.append(x)
            else:
                stack.extend(reversed(x.items))
        return " ".join("".join(out).split())


def parse(page: str) -> Node:
    """DOM tree of a page; tags left open are closed by what must end them."""
    root = Node("#root")
    stack, at, size = [root], 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[7]:
                stack[-1].items.append(html.unescape(m[7]))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in CONTAINER and tag not in CONTAINER:
                    break
            continue
        ends = CLOSED.get(tag, () if tag in INLINE or tag in VOID else ("p",))
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in CONTAINER:
                    break
        attributes = m[3] or m[6] or ""
        marks = tuple(t for a, b, c in MARKS.findall(attributes) for t in (a or b or c).lower().split()) if "=" in attributes else ()
        node = Node(tag, marks)
        stack[-1].items.append(node)
        if tag in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            node.items.append(page[at:end.start()] if end else page[at:])
            at = end.end() if end else size
        elif tag not in VOID and len(stack) < DEPTH:
            stack.append(node)
    return root


def alike(a: Node, b: Node) -> bool:
    return a.tag == b.tag and a.marks[:1] == b.marks[:1]


def tree_match(page: Node, wrapper: Node, pairs: list[tuple[Node, Node]] | None = None) -> int:
    """Simple tree matching: size of the largest top-down, ordered matching; pairs gets the matched nodes.

    A repeated node of the wrapper may meet several siblings of the page.
    """
    if not alike(page, wrapper):
        return 0
    if pairs is not None:
        pairs.append((page, wrapper))
    a, b = page.children, wrapper.children
    if not a or not b:
        return 1
    weight = [[tree_match(x, y) if x.tag == y.tag else 0 for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, row in enumerate(weight):
        above, here = best[i], best[i + 1]
        for j, w in enumerate(row):
            here[j + 1] = max(above[j + 1], here[j], (max(above[j], above[j + 1]) if b[j].many else above[j]) + w if w else 0)
    if pairs is not None:
        i, j = len(a), len(b)
        while i and j:
            w, score = weight[i - 1][j - 1], best[i][j]
            if w and b[j - 1].many and score == best[i - 1][j] + w:
                tree_match(a[i - 1], b[j - 1], pairs)
                i -= 1
            elif w and score == best[i - 1][j - 1] + w:
                tree_match(a[i - 1], b[j - 1], pairs)
                i, j = i - 1, j - 1
            elif score == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return 1 + best[len(a)][len(b)]


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(x.children)


class Slot(Node):
    """Alike nodes of a page whose ancestors are alike too; slots below it are sorted, one per kind."""

    __slots__ = ("nodes",)


def aligned(nodes: list[Node]) -> Slot:
    """Tree of the slots of a page; trees of this form match in one order of siblings only."""
    slot = Slot(nodes[0].tag, nodes[0].marks[:1])
    slot.nodes = nodes
    kinds: dict[tuple, list[Node]] = {}
    for node in nodes:
        for child in node.children:
            kinds.setdefault((child.tag, child.marks[:1]), []).append(child)
    slot.items = [aligned(kinds[kind]) for kind in sorted(kinds)]
    return slot


def digest(text: str) -> int:
    """64-bit hash that is never ALL."""
    data = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(data, "little", signed=True) or 1


def never(node: Node) -> bool:
    return node.tag in OUT or not OUT_MARKS.isdisjoint(node.marks)


def main_element(root: Node) -> str | None:
    tags = {n.tag for n in _walk(root)}
    return next((t for t in ("article", "main") if t in tags), None)


def layout_of(root: Node) -> int:
    body = next((n for n in _walk(root) if n.tag == "body"), root)
    found = set()
    for x in body.children:
        if x.tag in SECTIONS and not never(x):
            found.add((x.tag, x.marks[:1]))
            found.update((x.tag, x.marks[:1], y.tag, y.marks[:1]) for y in x.children if y.tag in SECTIONS and not never(y))
    return digest(repr(sorted(found)))


def node_texts(root: Node) -> Iterator[tuple[str, set[int]]]:
    """(path, hashes of its texts) of the nodes that may hold content; the main element and what holds it are not template."""
    inside = main_element(root)
    stack = [(aligned([root]), "", inside is None)]
    while stack:
        slot, path, taken = stack.pop()
        if taken and slot.tag not in ("#root", "html", "body", inside):
            texts = {x.text() for x in slot.nodes if not never(x)} - {""}
            if texts:
                yield path, {digest(t) for t in texts}
        for child in slot.items:
            if child.tag not in OUT and OUT_MARKS.isdisjoint(child.marks):
                step = f"{path}\x02{child.tag}\x01{''.join(child.marks)}"
                stack.append((child, step, taken or slot.tag == inside))


def merged(rows: list[tuple[str, int, int]]) -> list:
    """Wrapper of the template nodes (path, layout, text): [tag, marks, [[layout, text], ...], children]."""
    root = ["#root", [], [], []]
    nodes = {"": root}
    for path, layout, text in sorted(rows):
        at = ""
        for step in path.split("\x02")[1:]:
            above, at = nodes[at], f"{at}\x02{step}"
            if at not in nodes:
                tag, _, mark = step.partition("\x01")
                nodes[at] = [tag, [mark] if mark else [], [], []]
                above[3].append(nodes[at])
        nodes[at][2].append([layout, text])
    return root if rows else []


def induce(pages: list[str]) -> list:
    """Wrapper of the pages of one host, as ``wrappers`` finds it for many hosts."""
    have: dict[tuple, set[int]] = {}
    for page in pages:
        root = parse(page)
        body, layout = digest(content(root)), layout_of(root)
        for path, texts in node_texts(root):
            for text in (None, *texts):
                for where in (ALL, layout):
                    have.setdefault((path, where, text), set()).add(body)
    return merged([key for key, found in have.items() if key[2] is not None and len(found) >= LEAST
                   and len(found) >= CONSTANT * len(have[(*key[:2], None)])])


def unpacked(form: list, template: dict[int, set[tuple[int, int]]]) -> Node | None:
    """Tree of a wrapper; template gets the (layout, text) pairs of its template nodes."""
    if not form:
        return None
    tag, marks, constant, children = form
    node = Node(tag, tuple(marks))
    node.items = sorted((unpacked(c, template) for c in children), key=lambda c: (c.tag, c.marks))
    if constant:
        template[id(node)] = {(layout, text) for layout, text in constant}
    return node


def main_text(page: str, wrapper: Node | None, template: dict[int, set[tuple[int, int]]]) -> str:
    """Blocks of the page's content slots, joined by an empty line."""
    root = parse(page)
    gone = set()
    if wrapper is not None and template:
        layout = layout_of(root)
        pairs: list[tuple[Node, Node]] = []
        tree_match(aligned([root]), wrapper, pairs)
        for slot, theirs in pairs:
            known = template.get(id(theirs))
            if known:
                for mine in slot.nodes:
                    text = digest(mine.text())
                    if (ALL, text) in known or (layout, text) in known:
                        gone.add(id(mine))
    return content(root, gone)


def content(root: Node, gone: set[int] = frozenset()) -> str:
    """Text of a page without the nodes in ``gone``."""
    inside = main_element(root)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        words = " ".join("".join(line).split())
        line.clear()
        if words:
            blocks.append(words)

    # (node or text, whether content is taken here); None ends a block.
    stack: list = [(root, inside is None, False)]
    while stack:
        x, taken, header = stack.pop()
        if x is None:
            flush()
        elif type(x) is str:
            if taken:
                line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif never(x) or id(x) in gone:
            continue
        elif not taken and inside is None or (x.tag == "header" or not HEADER_MARKS.isdisjoint(x.marks)) and not header:
            continue
        else:
            main = x.tag == inside
            block = x.tag not in INLINE
            if block:
                flush()
                stack.append((None, taken, header))
            stack.extend((y, taken or main, header or main) for y in reversed(x.items))
    flush()
    return "\n\n".join(blocks)


def host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1))


def counted(pages: DataFrame) -> DataFrame:
    """(host, layout, path, name, text, body): texts of the nodes of every page; null text: the page has the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("path", pa.int64()), ("name", pa.string()),
                            ("text", pa.int64()), ("body", pa.int64())])
        for batch in batches:
            rows: list[tuple] = []
            for where, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(page)
                body, layout = digest(content(root)), layout_of(root)
                for name, texts in node_texts(root):
                    path = digest(name)
                    rows.append((where, layout, path, name, None, body))
                    rows += [(where, layout, path, None, text, body) for text in texts]
                if len(rows) > ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return (pages.select(host().alias("host"), "html").where("host <> '' and html <> ''")
            .mapInArrow(run, "host string, layout long, path long, name string, text long, body long"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON, pages of the host)."""
    uses = pages.groupBy(host().alias("host")).agg(F.count("*").alias("uses"))
    node = ["host", "layout", "path"]
    # A page text counts once, whatever stands around it and however many pages have it.
    once = (counted(pages).withColumn("layout", F.explode(F.array(F.lit(ALL).cast("long"), F.col("layout"))))
            .groupBy(*node, "text", "body").agg(F.min("name").alias("name")))
    counts = working_table(once.groupBy(*node, "text").agg(F.count("*").alias("found"), F.min("name").alias("name"))
                           .where(F.col("found") >= LEAST))
    whole = counts.where("text is null").select(*node, "name", F.col("found").alias("pages"))
    constant = (counts.where("text is not null").drop("name").join(whole, node)
                .where(F.col("found") >= CONSTANT * F.col("pages")))
    # What holds for all layouts is not said again for each.
    where = (constant.groupBy("host", "path", "text").agg(F.collect_set("layout").alias("layouts"), F.min("name").alias("name"))
             .select("host", "name", "text", F.explode(
                 F.when(F.array_contains("layouts", ALL), F.array(F.lit(ALL).cast("long"))).otherwise(F.col("layouts"))).alias("layout")))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(group["name"], map(int, group["layout"]), map(int, group["text"]), strict=True))
        return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [json.dumps(merged(rows))]})

    learned = where.groupBy("host").applyInPandas(pack, "host string, wrapper string")
    return uses.join(learned, "host", "left").select("host", F.coalesce("wrapper", F.lit("[]")).alias("wrapper"), "uses")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    learned = working_table(wrappers(pages))
    rows = join_groups(pages.withColumn("host", host()), learned, ["host"], "uses").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        for batch in batches:
            texts = []
            for page, form in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if form not in held:
                    if len(held) > 1000:
                        held.clear()
                    template: dict[int, str] = {}
                    held[form] = (unpacked(json.loads(form), template), template)
                texts.append(main_text(page, *held[form]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, SCHEMA)
