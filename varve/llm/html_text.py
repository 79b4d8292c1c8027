"""Main text of web pages by wrapper induction.

The pages of a host are grouped by layout, the tag paths to their blocks of text: a layout
joins the group with whose most common layout it shares most paths, ``SAME_LAYOUT`` of both
at least.  The pages of a group are aligned with one of them, its exemplar (smallest hash of
the most common layout), by simple tree matching of their DOM trees: two trees match if
their roots have the same tag, and then as many nodes as an order-preserving matching of
their children allows.  What the aligned pages say of the exemplar's nodes is the wrapper:

- a node whose text is the same in ``constant_share`` or more of all different pages of the group
  (``least_pages`` or more) is template;
- a node that most pages have and whose text is nearly all links (``MENU_SHARE``) is a menu, whatever its words;
- the *main slot* is found from the root down: while one child holds ``MAIN_SHARE`` of the text that
  varies and is no link, it is entered.  Beside it, only headings of the first rank are content.

Counts cover every page; pages with the same tree and texts are one, so that copies of a page cannot
make a template of its article.  Pages of smaller groups are not counted, but lose what is the template of the
group most like theirs; if a host has only such groups, all its pages are one group.

What stands in marked places (navigation, header, footer, sidebar, form, script, or
a class, id or role that says so: see ``BOILERPLATE``) is never content.  If a
page marks its article or main part, only that is taken, without its template; else its body, where
menus and the main slot decide as well.

Pages are parsed once, where they are read; trees, digests and texts of their blocks go
to the shared folder.  Only trees, digests and lengths are joined with the exemplars by host and layout,
a join whose large side Spark splits; then wrappers, a few numbers for each layout that has
one, are joined to the blocks.  Equal subtrees match each other whole, so only different kinds of
subtrees are ever compared; sibling lists are matched a row at a time, of which the root of their number is held,
and nothing recurses, so that neither long lists nor deep nesting changes what is done.

Defined results: null html gives an empty text; pages whose url is null or names no host are each
a host of their own and have no wrapper;
broken markup and cut-off pages are read as far as they go; repeated rows all stay and
count once; an empty table gives an empty result; other columns are ignored.  Pages are read whole, at any length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm._shared import stash

# Elements of the HTML standard, and names that mark parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
SKIPPED = frozenset("nav header footer aside form script style button select option menu dialog head title noscript template iframe svg math object audio video canvas textarea input fieldset".split())
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside "
    "widget notice cookie cookies consent gdpr popup modal overlay comment comments respond disqus share sharing social related recommended newsletter subscribe signup login "
    "search pagination pager toolbar skip copyright legal disclaimer alert complementary contentinfo".split()
)
#: A class of which one part says that it holds or lacks something else names no boilerplate.
RELATING = frozenset("no not without with has main content article body page post wrapper container text".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}

#: Share of links in the text of a menu, and of the varying text in the main slot.
MENU_SHARE, MAIN_SHARE = 0.8, 0.85
#: Cells of a matching table that is made at once instead of by rows; both give the same matches.
SMALL = 400
#: Paths that two layouts share, of all that either has, from which on they are one group.
SAME_LAYOUT = 0.5
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
NAME = re.compile(r"[^\W_]+")
WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "inside", "marked", "number", "parent", "tag", "texts")

    def __init__(self, tag: str, parent: Node | None, marked: bool = False):
        self.tag, self.parent, self.marked = tag, parent, marked
        self.children: list[Node] = []
        self.texts: list[tuple[int, str, bool]] = []  # each with the number of children before it, and whether it is a link's
        self.number = -1
        self.inside = 0  # of a marked inline element: open ones of its tag in it


def parse(source: str) -> Node:
    """The DOM tree of a page; inline elements are only text of the element around them, and no part of it if they are marked."""
    root = at = Node("#root", None)
    link: Node | None = None  # where a link is open
    place, end = 0, len(source)
    while place < end:
        found = TOKEN.search(source, place)
        stop = found.start() if found else end
        if stop > place:
            at.texts.append((len(at.children), entities.unescape(source[place:stop]), link is not None))
        if not found:
            break
        place = max(found.end(), stop + 1)
        if found[2] is None:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag in INLINE:
            if tag in VOID:
                at.texts.append((len(at.children), " " if tag == "br" else "", False))
                continue
            if tag == "a":
                link = None if closing else at
            around = _inline(at, tag)
            if closing:
                if around is not None and around.inside:
                    around.inside -= 1
                elif around is not None:
                    at = around.parent
            elif not found[3].endswith("/"):
                if found[3] and ATTRIBUTE.search(found[3]) and _says_boilerplate(found[3]):
                    at = Node(tag, at, True)  # outside the tree: the text around it stays one block
                elif around is not None:
                    around.inside += 1
            continue
        if closing:
            node = at
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                while at is not node.parent:  # a link ends with the block it began in
                    link = None if at is link else link
                    at = at.parent
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, place)
            place = close.end() if close else end
            continue
        at = _open(at, tag)
        child = Node(tag, at, bool(found[3]) and tag not in ("html", "body", "article", "main") and _says_boilerplate(found[3]))
        at.children.append(child)
        if tag not in VOID and not found[3].endswith("/"):
            at = child
    return root


def _inline(at: Node, tag: str) -> Node | None:
    """The nearest open marked inline element of a tag; none is open beyond a block."""
    while at.tag in INLINE:
        if at.tag == tag:
            return at
        at = at.parent
    return None


def _says_boilerplate(attributes: str) -> bool:
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        for name in (a or b or c).lower().split():
            parts = set(NAME.findall(name))
            if parts & BOILERPLATE and not parts & RELATING:
                return True
    return False


def _open(at: Node, tag: str) -> Node:
    """Where an element goes, after what its start tag closes."""
    if tag in CLOSES:
        node = at
        while node.parent is not None and node.tag not in SCOPE[tag]:
            if node.tag in CLOSES[tag]:
                return node.parent
            node = node.parent
        while at.tag in INLINE:
            at = at.parent
        return at
    node = at
    while node.parent is not None and (node.tag == "p" or node.tag in INLINE):
        node = node.parent
        if node.tag != "p" and node.tag not in INLINE:
            return node
    return node if at.tag == "p" else at


class _Kinds:
    """Subtrees numbered by their shape: equal ones have one number."""

    def __init__(self) -> None:
        self.of_shape: dict[tuple, int] = {}
        self.tag: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.size: list[int] = []

    def of(self, root: Node) -> dict[int, int]:
        """The kind of every node of a tree, by the node's id."""
        order, todo = [], [root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node.children
        found: dict[int, int] = {}
        for node in reversed(order):
            shape = node.tag, tuple(found[id(c)] for c in node.children)
            k = self.of_shape.get(shape)
            if k is None:
                k = self.of_shape[shape] = len(self.tag)
                self.tag.append(shape[0])
                self.children.append(shape[1])
                self.size.append(1 + sum(self.size[c] for c in shape[1]))
            found[id(node)] = k
        return found


class _Matching:
    """Simple tree matching by kinds: the weight of two, and which of their children are matched."""

    def __init__(self, kinds: _Kinds):
        self.kinds = kinds
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def _simple(self, x: int, y: int) -> int | None:
        """The weight of two kinds, where no children need matching; None where they do and have not been."""
        k = self.kinds
        if x == y:
            return k.size[x]  # no matching has more nodes than a tree itself
        if k.tag[x] != k.tag[y]:
            return 0
        if not k.children[x] or not k.children[y]:
            return 1
        done = self.known.get((x, y))
        return None if done is None else done[0]

    def weight(self, x: int, y: int) -> int:
        todo = [(x, y)]
        while todo:
            pair = todo[-1]
            if self._simple(*pair) is not None:
                todo.pop()
                continue
            xs, ys = self.kinds.children[pair[0]], self.kinds.children[pair[1]]
            lacking = [(a, b) for a in dict.fromkeys(xs) for b in dict.fromkeys(ys) if self._simple(a, b) is None]
            if lacking:
                todo += lacking
            else:
                matched = self._align(xs, ys)
                self.known[pair] = 1 + sum(self._simple(xs[i], ys[j]) for i, j in matched), matched
                todo.pop()
        return self._simple(x, y)

    def _align(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """The order-preserving matching of greatest weight of two lists of kinds.

        Equal kinds at both beginnings, or both ends, belong together in some best matching.
        """
        begin, stop = 0, 0
        while begin < min(len(xs), len(ys)) and xs[begin] == ys[begin]:
            begin += 1
        while stop < min(len(xs), len(ys)) - begin and xs[-1 - stop] == ys[-1 - stop]:
            stop += 1
        inner = self._best(xs[begin : len(xs) - stop], ys[begin : len(ys) - stop])
        ends = [(len(xs) - k, len(ys) - k) for k in range(stop, 0, -1)]
        return [(k, k) for k in range(begin)] + [(i + begin, j + begin) for i, j in inner] + ends

    def _best(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """The same by rows of best weights, of which every ``step``-th is held and those between are made again on the way back."""
        if not xs or not ys:
            return []
        if len(xs) * len(ys) <= SMALL:
            return self._best_small(xs, ys)
        different = sorted(set(ys))
        column = np.searchsorted(different, ys)
        rows: dict[int, np.ndarray] = {}

        def following(row: np.ndarray, i: int) -> np.ndarray:
            if xs[i] not in rows:
                rows[xs[i]] = np.array([self._simple(xs[i], y) for y in different], np.int64)
            out = np.zeros_like(row)
            out[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + rows[xs[i]][column]))
            return out

        step = int(len(xs) ** 0.5) + 1
        row = np.zeros(len(ys) + 1, np.int64)
        held = [row]
        for i in range(len(xs)):
            row = following(row, i)
            if (i + 1) % step == 0:
                held.append(row)
        matched, i, j = [], len(xs), len(ys)
        while i and j:
            start = (i - 1) // step * step
            block = [held[start // step]]
            for k in range(start, i):
                block.append(following(block[-1], k))
            while i > start and j:
                row, above = block[i - start], block[i - start - 1]
                if row[j] == above[j]:
                    i -= 1
                elif row[j] == row[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    matched.append((i, j))
        matched.reverse()
        return matched


    def _best_small(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """The same by the whole table, which for short lists is the quicker way to the same matches."""
        table = [[0] * (len(ys) + 1)]
        for x in xs:
            above, row = table[-1], [0]
            for j, y in enumerate(ys):
                row.append(max(above[j] + self._simple(x, y), above[j + 1], row[j]))
            table.append(row)
        matched, i, j = [], len(xs), len(ys)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                matched.append((i, j))
        matched.reverse()
        return matched


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of matched nodes of two trees, by simple tree matching."""
    if a.tag != b.tag:
        return []
    kinds = _Kinds()
    of_a, of_b = kinds.of(a), kinds.of(b)
    matching = _Matching(kinds)
    matching.weight(of_a[id(a)], of_b[id(b)])
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        kx, ky = of_a[id(x)], of_b[id(y)]
        if kx == ky:
            todo += zip(x.children, y.children, strict=True)
        elif x.children and y.children:
            todo += [(x.children[i], y.children[j]) for i, j in matching.known[kx, ky][1]]
    return pairs


def _number(root: Node) -> None:
    todo, n = [root], 0
    while todo:
        node = todo.pop()
        node.number, n = n, n + 1
        todo += reversed(node.children)


def _roots(root: Node) -> list[Node]:
    """The marked articles of a page, else its main part, else all of it."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.marked or node.tag in SKIPPED and node.tag != "header":
            continue
        if node.tag in found:
            found[node.tag].append(node)
            if node.tag == "article":
                continue
        todo += reversed(node.children)
    return found["article"] or found["main"][:1] or [root]


def blocks(root: Node) -> list[tuple[Node, str]]:
    """The blocks of text in the content of a page, in order, each with the node that holds it."""
    return [(node, text) for node, text, _ in linked_blocks(_roots(root))]


def linked_blocks(roots: list[Node]) -> list[tuple[Node, str, int]]:
    """The same for given roots, with the characters of each block that are a link's."""
    out: list[tuple[Node, str, int]] = []
    for top in roots:
        todo: list[tuple[Node, int]] = [(top, 0)]
        while todo:
            node, k = todo.pop()
            mine = [(t, link) for at, t, link in node.texts if at == k]
            text = WHITE.sub(" ", "".join(t for t, _ in mine)).strip()
            if text:
                linked = WHITE.sub(" ", "".join(t for t, link in mine if link)).strip()
                out.append((node, text, min(len(linked), len(text))))
            if k < len(node.children):
                todo.append((node, k + 1))
                child = node.children[k]
                if not child.marked and child.tag not in SKIPPED:
                    todo.append((child, 0))
    return out


def skeleton(root: Node) -> str:
    """The tags of a tree: each element's, its children's, and a closing slash."""
    out: list[str] = []
    todo: list[Node | None] = [root]
    while todo:
        node = todo.pop()
        if node is None:
            out.append("/")
        else:
            out.append(node.tag)
            todo.append(None)
            todo += reversed(node.children)
    return " ".join(out)


def from_skeleton(text: str) -> Node:
    """A numbered tree without texts."""
    root = at = Node("", None)
    n = 0
    for tag in text.split(" "):
        if tag == "/":
            at = at.parent
        else:
            child = Node(tag, at)
            child.number, n = n, n + 1
            at.children.append(child)
            at = child
    return root.children[0]


def _digest(texts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(texts)) - (1 << 63)


def layout(nodes: list[Node]) -> str:
    """The different tag paths to nodes, as digests in order; that of a path is made of its parent's, so deep trees cost no more."""
    known: dict[int, str] = {}

    def digest(node: Node) -> str:
        chain = []
        while node is not None and id(node) not in known:
            chain.append(node)
            node = node.parent
        for n in reversed(chain):
            above = "" if n.parent is None else known[id(n.parent)]
            known[id(n)] = above if n.tag in ("#root", "html", "body") else xxhash.xxh3_64_hexdigest(f"{above}/{n.tag}")
        return known[id(chain[0])] if chain else known[id(node)]

    return " ".join(sorted({digest(n) or "." for n in nodes}))


_PAGE = "page_id long, url string, host string, own long, layout string, marked boolean, tree string, nodes array<int>, digests array<long>, sizes array<int>, links array<int>, texts array<string>"


def read_pages(pages: DataFrame) -> DataFrame:
    """Every page as rows of _PAGE: its tree, and its blocks, each with the number and digest of the node that holds it and its characters, all and of links.

    ``own`` is a hash of the tree and the digests: the same for pages of the same content, and the least is the exemplar.
    """
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rows = pages.select("page_id", "url", F.nullif(host, F.lit("")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                out: list[list] = [[] for _ in range(9)]
                for source in b.column(3).to_pylist():
                    tree = parse(source)
                    _number(tree)
                    roots = _roots(tree)
                    mine = linked_blocks(roots)
                    by_node: dict[int, list[str]] = {}
                    for node, text, _ in mine:
                        by_node.setdefault(node.number, []).append(text)
                    digest = {n: _digest(texts) for n, texts in by_node.items()}
                    shape, at = skeleton(tree), [n.number for n, _, _ in mine]
                    digests = [digest[n] for n in at]
                    own = _digest([shape, *map(str, at), *map(str, digests)])
                    texts, links = [t for _, t, _ in mine], [n for _, _, n in mine]
                    row = own, layout([n for n, _, _ in mine]), roots[0] is not tree, shape, at, digests, [len(t) for t in texts], links, texts
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                ints = pa.list_(pa.int32())
                kinds = pa.int64(), pa.string(), pa.bool_(), pa.string(), ints, pa.list_(pa.int64()), ints, ints, pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=_names(_PAGE))

    return rows.mapInArrow(run, _PAGE)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class _Alignment:
    """Page nodes to exemplar nodes; pages of one tree are matched with one exemplar once."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], tuple[dict[int, int], list[int]]] = {}

    def of(self, tree: str, example: str) -> tuple[dict[int, int], list[int]]:
        """The exemplar's node of each matched node of the page; and of every node of the page the exemplar's node of it or the nearest above it."""
        key = tree, example
        if key not in self.known:
            if len(self.known) >= 200:
                self.known.clear()
            page = from_skeleton(tree)
            of = {x.number: y.number for x, y in match(page, from_skeleton(example))}
            above, todo = [0] * len(_walk(page)), [(page, 0)]
            while todo:
                node, up = todo.pop()
                above[node.number] = up = of.get(node.number, up)
                todo += [(c, up) for c in node.children]
            self.known[key] = of, above
        return self.known[key]


def _walk(root: Node) -> list[Node]:
    """The nodes of a tree by number."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.children)
    return out


def group_layouts(layouts: list[tuple[str, int, int]], least_pages: int) -> list[tuple[str, int, bool, int]]:
    """Layouts of a host (layout, pages, own), most pages first, to (layout, own of its group's exemplar, counted, counted pages of the group)."""
    groups: list[list] = []  # the paths of the first layout, its own, pages, members
    shared = lambda a, b: len(a & b) / len(a | b)
    for name, pages, own in layouts:
        paths = frozenset(name.split(" "))
        best = max(groups, key=lambda g: shared(g[0], paths), default=None)
        if best is None or shared(best[0], paths) < SAME_LAYOUT:
            groups.append(best := [paths, own, 0, []])
        best[2] += pages
        best[3].append((name, paths))
    large = [g for g in groups if g[2] >= least_pages]
    if not large:
        total = sum(g[2] for g in groups)
        return [(name, layouts[0][2], True, total) for name, _, _ in layouts] if total >= least_pages else []
    out = []
    for g in groups:
        for name, paths in g[3]:
            at = g if g[2] >= least_pages else max(large, key=lambda x: shared(x[0], paths))
            out.append((name, at[1], at is g, at[2]))
    return out


def _group(batches: Iterator[pa.RecordBatch], least_pages: int) -> Iterator[pa.RecordBatch]:
    """Rows (host, layout, pages, own), sorted by host and then most pages first, to rows of _GROUPED."""

    def grouped(host: str, held: list) -> pa.RecordBatch:
        columns = list(zip(*group_layouts(held, least_pages), strict=True)) or [[]] * 4
        kinds = pa.string(), pa.int64(), pa.bool_(), pa.int64()
        arrays = [pa.array([host] * len(columns[0]), pa.string()), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(arrays, names=_names(_GROUPED))

    at, held = None, []
    for b in batches:
        for host, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if host != at and held:
                yield grouped(at, held)
                held = []
            at = host
            held.append(tuple(rest))
    if held:
        yield grouped(at, held)


_GROUPED = "host string, layout string, example long, counted boolean, pages long"
_SEEN = "host string, example long, node int, same long, seen long, size long, linked long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, example, marked, tree, nodes, digests, sizes, links, ex_tree, ex_nodes, ex_digests) to rows of _SEEN.

    For nodes of the exemplar: the different pages whose text there is the same, those that have text there or below
    without a node of their own, and its characters where they vary, all and of links.  Marked pages count for the first alone.
    """
    alignment = _Alignment()
    for b in batches:
        sums: dict[tuple, list[int]] = {}
        for host, example, marked, tree, nodes, digests, sizes, links, ex_tree, ex_nodes, ex_digests in zip(*(c.to_pylist() for c in b.columns), strict=True):
            there = dict(zip(ex_nodes, ex_digests, strict=True))
            of, above = alignment.of(tree, ex_tree)
            once: set[tuple[int, int]] = set()
            for n, d, size, linked in zip(nodes, digests, sizes, links, strict=True):
                at = sums.setdefault((host, example, above[n]), [0, 0, 0, 0])
                same = n in of and there.get(of[n]) == d
                for k, counts in ((0, same), (1, not marked)):
                    if counts and (above[n], k) not in once:
                        once.add((above[n], k))
                        at[k] += 1
                if not marked and not same:
                    at[2] += size
                    at[3] += linked
        rows = [(*key, *x) for key, x in sums.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=_names(_SEEN))


def induce(tree: str, pages: int, seen: list[tuple[int, int, int, int, int]], constant_share: float) -> tuple[list[int], list[int], int]:
    """The wrapper of an exemplar: its constant nodes, its menus, and its main slot, of rows (node, same, seen, size, linked)."""
    nodes = _walk(from_skeleton(tree))
    constant = [n for n, same, _, _, _ in seen if same >= constant_share * pages]
    size, linked, often = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for n, _, k, chars, links in seen:
        size[n], linked[n], often[n] = chars, links, k
    for node in reversed(nodes):  # children come after their parents
        if node.parent.tag:
            up = node.parent.number
            size[up], linked[up], often[up] = size[up] + size[node.number], linked[up] + linked[node.number], max(often[up], often[node.number])
    menus = [n.number for n in nodes if size[n.number] and linked[n.number] >= MENU_SHARE * size[n.number] and often[n.number] >= constant_share * pages]
    plain = [s - k for s, k in zip(size, linked, strict=True)]
    if not plain[0]:
        menus = []  # pages of nothing but links are lists, and these their content
    main = nodes[0]
    while best := max(main.children, key=lambda c: plain[c.number], default=None):
        if not plain[best.number] or plain[best.number] < MAIN_SHARE * plain[main.number] or not best.children:
            break
        main = best
    return sorted(constant), menus, main.number


def _induce(batches: Iterator[pa.RecordBatch], constant_share: float) -> Iterator[pa.RecordBatch]:
    """Rows (host, example, ex_tree, ex_nodes, ex_digests, pages, seen) to rows of _WRAPPER."""
    for b in batches:
        rows = []
        for host, example, tree, ex_nodes, ex_digests, pages, seen in zip(*(c.to_pylist() for c in b.columns), strict=True):
            constant, menus, main = induce(tree, pages, [tuple(x.values()) for x in seen], constant_share)
            there = dict(zip(ex_nodes, ex_digests, strict=True))
            rows.append((host, example, tree, constant, [there[n] for n in constant], menus, main))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        ints = pa.list_(pa.int32())
        kinds = pa.string(), pa.int64(), pa.string(), ints, pa.list_(pa.int64()), ints, pa.int32()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=_names(_WRAPPER))


_WRAPPER = "host string, example long, ex_tree string, constant array<int>, constant_digests array<long>, menus array<int>, main int"


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, marked, tree, nodes, digests, texts, ex_tree, constant, constant_digests, menus, main) to (page_id, url, text)."""
    alignment = _Alignment()
    inside: dict[tuple[str, int, tuple[int, ...]], set[int]] = {}
    for b in batches:
        found = []
        for marked, tree, nodes, digests, texts, ex_tree, constant, values, menus, main in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
            if ex_tree is not None:
                (of, above), template = alignment.of(tree, ex_tree), dict(zip(constant, values, strict=True))
                varies = [n not in of or template.get(of[n]) != d for n, d in zip(nodes, digests, strict=True)]
                if not marked:
                    key = ex_tree, main, tuple(menus)
                    if key not in inside:
                        if len(inside) >= 200:
                            inside.clear()
                        inside[key] = _slot(ex_tree, main, menus)
                    slot, tags = inside[key], tree_tags(tree)
                    if any(above[n] in slot for n in nodes):  # a page that has nothing in the slot keeps the rest
                        varies = [v and (above[n] in slot or tags[n] == "h1") for v, n in zip(varies, nodes, strict=True)]
                texts = [t for t, v in zip(texts, varies, strict=True) if v]
            found.append("\n\n".join(texts))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])


def _slot(tree: str, main: int, menus: list[int]) -> set[int]:
    """The nodes of an exemplar in its main slot and in none of its menus."""
    nodes, out = _walk(from_skeleton(tree)), set()
    hidden, todo = set(menus), [nodes[main]]
    while todo:
        node = todo.pop()
        if node.number not in hidden or node.number == main:
            out.add(node.number)
            todo += node.children
    return out


def tree_tags(text: str) -> list[str]:
    """The tags of a skeleton's nodes by number."""
    return [t for t in text.split(" ") if t != "/"]


def wrappers(read: DataFrame, constant_share: float = 0.8, least_pages: int = 5) -> DataFrame:
    """(host, layout, ex_tree, constant, constant_digests, menus, main) of the layouts whose group has ``least_pages``, from the rows of ``read_pages``."""
    page = "tree", "nodes", "digests", "sizes", "links"
    narrow, _ = stash(read.where(F.col("host").isNotNull()).select("host", "own", "layout", "marked", *page).dropDuplicates(["host", "own"]), "contents")
    kinds = narrow.groupBy("host", "layout").agg(F.count("*").alias("pages"), F.min("own").alias("own"))
    dealt = kinds.repartition("host").sortWithinPartitions("host", F.desc("pages"), "layout").select("host", "layout", "pages", "own")
    layouts, _ = stash(dealt.mapInArrow(lambda batches: _group(batches, least_pages), _GROUPED), "layouts")
    groups = layouts.select("host", "example", "pages").distinct()
    example = narrow.withColumnRenamed("own", "example").join(groups, ["host", "example"])
    examples, _ = stash(example.select("host", "example", "pages", F.col("tree").alias("ex_tree"), F.col("nodes").alias("ex_nodes"), F.col("digests").alias("ex_digests")), "exemplars")
    counted = narrow.join(layouts.where("counted").select("host", "layout", "example"), ["host", "layout"]).join(examples, ["host", "example"])
    seen = counted.select("host", "example", "marked", *page, "ex_tree", "ex_nodes", "ex_digests").mapInArrow(_count, _SEEN)
    by_node = seen.groupBy("host", "example", "node").agg(*[F.sum(c).alias(c) for c in ("same", "seen", "size", "linked")])
    # One exemplar's nodes, of which there are no more than one page has.
    listed = by_node.groupBy("host", "example").agg(F.collect_list(F.struct("node", "same", "seen", "size", "linked")).alias("seen"))
    whole = examples.join(listed, ["host", "example"]).select("host", "example", "ex_tree", "ex_nodes", "ex_digests", "pages", "seen")
    found = whole.mapInArrow(lambda batches: _induce(batches, constant_share), _WRAPPER)
    # Layouts that were not counted have no part in menus and main slot, only in constant texts.
    menus, main = F.when(F.col("counted"), F.col("menus")).otherwise(F.array().cast("array<int>")), F.when(F.col("counted"), F.col("main")).otherwise(0)
    joined = layouts.select("host", "layout", "example", "counted").join(found, ["host", "example"])
    return joined.withColumns({"menus": menus, "main": main}).drop("example", "counted")


def extract(pages: DataFrame, constant_share: float = 0.8, least_pages: int = 5) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    read, _ = stash(read_pages(pages), "pages")
    wrapper, _ = stash(wrappers(read, constant_share, least_pages), "wrappers")
    names = "page_id", "url", "marked", "tree", "nodes", "digests", "texts", "ex_tree", "constant", "constant_digests", "menus", "main"
    joined = read.join(wrapper, ["host", "layout"], "left").select(*names)
    return joined.mapInArrow(_content, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
