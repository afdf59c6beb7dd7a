"""A small forgiving HTML parser, simple tree matching, and text blocks of a subtree."""

from __future__ import annotations

import html
import re

import numpy as np

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag that ends an open element of the listed kinds, unless one of the walls stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr"}, {"table"}), "option": ({"option"}, {"select"}),
}
P_WALLS = frozenset({"button", "td", "th", "caption", "object", "table"})


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def get(self, name: str) -> str:
        for k, a, b, c in ATTR.findall(self.attrs):
            if k.lower() == name:
                return html.unescape(a or b or c)
        return ""

    def has(self, name: str) -> bool:
        return any(k.lower() == name for k, *_ in ATTR.findall(self.attrs))

    def sign(self) -> str:
        """What two nodes must share to be the same place of a template: the tag and the class names."""
        return ".".join([self.tag, *sorted(self.get("class").split())]) if self.attrs else self.tag


def parse(source: str) -> Node:
    root = Node("#")
    at, top, n = 0, root, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        text = source[at : m.start() if m else n]
        if text:
            top.children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["close"] or m["close2"]:
            node = top
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                top = node.parent
            continue
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        ends, walls = CLOSES.get(tag, (None, None))
        if tag in BLOCK and ends is None:
            ends, walls = {"p"}, P_WALLS
            if tag[0] == "h" and tag[1:].isdigit() and top.tag[:1] == "h" and top.tag[1:].isdigit():
                top = top.parent
        if ends:
            node, found = top, None
            while node is not root and node.tag not in walls:
                if node.tag in ends:
                    found = node
                node = node.parent
            if found is not None:
                top = found.parent
        node = Node(tag, attrs.rstrip("/").strip(), top)
        top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not attrs.endswith("/"):
            top = node
        elif attrs.endswith("/") and tag not in VOID:
            top = node  # a slash does not close an HTML element
    return root


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


class Shapes:
    """Shapes of subtrees, a number for each sign with the shapes of its elements in order, and the sizes of matches of two shapes."""

    def __init__(self, first: Node):
        self.known: dict[tuple, int] = {}
        self.sign, self.below, self.whole = [], [], []  # by shape; ``whole``: how many elements it has
        self.sizes: dict[tuple[int, int], int] = {}
        self.first = self.of(first)

    def of(self, root: Node) -> dict[int, int]:
        """Of each element its shape, by ``id``."""
        out: dict[int, int] = {}
        order, todo = [], [root]
        while todo:
            x = todo.pop()
            order.append((x, below := elements(x)))
            todo.extend(below)
        for x, below in reversed(order):
            below = tuple([out[id(c)] for c in below])
            key = (x.sign(), below)
            n = self.known.get(key)
            if n is None:
                n = self.known[key] = len(self.sign)
                self.sign.append(key[0])
                self.below.append(below)
                self.whole.append(1 + sum(self.whole[c] for c in below))
            out[id(x)] = n
        return out


#: Rows of a table of sizes that are kept; those between are made again where the pairs are traced.
ROWS = 128


def match(a: Node, b: Node, shapes: Shapes | None = None) -> list[tuple[Node, Node]]:
    """Simple tree matching (Yang 1991): the largest order-keeping match of two trees with equal signs, as pairs.

    A match's size hangs on the shapes of two subtrees alone, so each two shapes are matched once, and two subtrees of one shape
    match node by node. A level's table is made row by row; every ``ROWS``-th row is kept to trace the pairs back, and the rows between are
    made again, so long lists take memory with their number and not with its square. Depth is bounded by an explicit stack.
    ``shapes`` of ``a`` keeps what is known of matches with it for the next one.
    """
    shapes = shapes or Shapes(a)
    of_a, of_b = shapes.first, shapes.of(b)
    sign, below, whole, sizes = shapes.sign, shapes.below, shapes.whole, shapes.sizes

    def size(p: int, q: int) -> int | None:
        """The size of the match of two shapes; None: not known yet."""
        if p == q:
            return whole[p]
        if sign[p] != sign[q]:
            return 0
        return sizes.get((p, q)) if below[p] and below[q] else 1

    def rows(xs, ys, start):
        """Rows of a level's table after ``start``, one for each of ``xs``."""
        row = start
        if len(ys) <= 40:
            for p in xs:
                new, most = [0], 0
                for j, q in enumerate(ys):
                    one = row[j] + size(p, q)
                    most = max(most, one, row[j + 1])
                    new.append(most)
                row = new
                yield row
            return
        names, at = np.unique(ys, return_inverse=True)
        met: dict[int, np.ndarray] = {}
        for p in xs:
            if p not in met:
                met[p] = np.array([size(p, int(q)) for q in names], np.int64)[at]
            row, before = np.zeros(len(ys) + 1, np.int64), np.asarray(row)
            np.maximum.accumulate(np.maximum(before[1:], before[:-1] + met[p]), out=row[1:])
            yield row

    stack = [(of_a[id(a)], of_b[id(b)])]
    while stack:
        p, q = stack[-1]
        if size(p, q) is not None:
            stack.pop()
            continue
        waiting = [(c, d) for c in set(below[p]) for d in set(below[q]) if size(c, d) is None]
        if waiting:
            stack.extend(waiting)
            continue
        last = None
        for last in rows(below[p], below[q], [0] * (len(below[q]) + 1)):
            pass
        sizes[p, q] = int(last[-1]) + 1
        stack.pop()

    pairs, todo = [], [(a, b)] if size(of_a[id(a)], of_b[id(b)]) else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        xs, ys = elements(x), elements(y)
        if of_a[id(x)] == of_b[id(y)]:
            todo.extend(zip(reversed(xs), reversed(ys)))
            continue
        p, q = below[of_a[id(x)]], below[of_b[id(y)]]
        if not p or not q:
            continue
        kept = [[0] * (len(q) + 1)]
        for k, row in enumerate(rows(p, q, kept[0]), 1):
            if k % ROWS == 0:
                kept.append(row)
        i, j, top, t = len(p), len(q), len(p), []
        while i and j:
            if i <= top:
                top = (i - 1) // ROWS * ROWS
                t = [kept[top // ROWS], *rows(p[top:i], q, kept[top // ROWS])]
            s = size(p[i - 1], q[j - 1])
            if s and t[i - top][j] == t[i - top - 1][j - 1] + s:
                todo.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
            elif t[i - top][j] == t[i - top - 1][j]:
                i -= 1
            else:
                j -= 1
    return pairs


def blocks(node: Node, skip) -> list[str]:
    """Text blocks below ``node`` in page order, white space made single and trimmed; ``skip(node)`` leaves one out."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run and (s := " ".join("".join(run).split())):
            out.append(s)
        run.clear()

    stack: list = [iter([node])]
    ends: list[bool] = [False]
    while stack:
        for c in stack[-1]:
            if isinstance(c, str):
                run.append(c)
            elif c is not node and skip(c):
                continue
            else:
                if c.tag in BLOCK:
                    end()
                elif c.tag == "br":
                    run.append(" ")
                stack.append(iter(c.children))
                ends.append(c.tag in BLOCK)
                break
        else:
            stack.pop()
            if ends.pop():
                end()
    end()
    return out
