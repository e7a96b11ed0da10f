"""A small DOM for wrapper induction: parsing, folding and simple tree matching; nothing recurses, so depth is not limited."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never page text.
SILENT = frozenset("script style noscript template svg math iframe object canvas head title select option textarea button datalist audio video map".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these closes an open <p>.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre "
    "section table ul".split()
)
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}


class Node:
    __slots__ = ("tag", "label", "kids")

    def __init__(self, tag: str, label: str):
        self.tag, self.label = tag, label
        self.kids: list = []  # nodes and strings in page order


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", "")
        self.open = [self.root]
        self.count: dict[str, int] = {}  # open elements by tag

    def _cut(self, i: int):
        for node in self.open[i:]:
            self.count[node.tag] -= 1
        del self.open[i:]

    def _close(self, tags: tuple[str, ...], stops: tuple[str, ...]):
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self._cut(i)
                return
            if self.open[i].tag in stops:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close(("p",), ("table", "td", "th", "li", "button", "article", "section", "div", "blockquote"))
        if tag in SAME_LEVEL:
            self._close(SAME_LEVEL[tag], STOPS[tag])
        label = " ".join(str(v) for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style") and v is not None)
        if any(k == "hidden" for k, _ in attrs):
            label += " hidden"
        node = Node(tag, label)
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        if not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._cut(i)
                return
            # a stray end tag does not close its containers
            if self.open[i].tag in ("article", "main", "body", "table") and tag not in ("html", "body", "main", "article", "table"):
                return

    def handle_data(self, data):
        if data:
            self.open[-1].kids.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def parse(html: str) -> Node:
    """The tree of a page; never fails on broken markup."""
    b = _Builder()
    try:
        b.feed(html)
        b.close()
    except (AssertionError, ValueError):
        b.root.kids.append(unescape(re.sub(r"<[^>]*>", " ", html)))
    return b.root


def squeeze(text: str) -> str:
    return " ".join(text.split())


class Slot:
    """A node of the folded tree: siblings of one tag and label are one slot."""

    __slots__ = ("key", "nodes", "kids", "id")

    def __init__(self, key: str):
        self.key = key
        self.nodes: list[Node] = []
        self.kids: list[Slot] = []
        self.id = 0


def _words(label: str) -> str:
    return " ".join(sorted(set(re.findall(r"[a-z]+", label.lower()))))


def fold(root: Node) -> list[Slot]:
    """Slots of the block structure, parents first; slot 0 is the root. The keys of a slot's children differ."""
    top = Slot("#root")
    top.nodes.append(root)
    out = [top]
    for slot in out:
        kids: dict[str, Slot] = {}
        for node in slot.nodes:
            for kid in node.kids:
                if isinstance(kid, str) or kid.tag not in BLOCKS:
                    continue
                key = f"{kid.tag}|{_words(kid.label)}" if kid.label else kid.tag
                if key not in kids:
                    kids[key] = Slot(key)
                kids[key].nodes.append(kid)
        slot.kids = list(kids.values())
        for k in slot.kids:
            k.id = len(out)
            out.append(k)
    return out


def _common(x: Slot, y: Slot) -> list[tuple[Slot, Slot]]:
    """Children of two slots with equal keys, in the order of y."""
    theirs = {k.key: k for k in x.kids}
    return [(theirs[k.key], k) for k in y.kids if k.key in theirs]


def match(a: Slot, b: Slot) -> dict[int, int]:
    """Simple tree matching: the largest order-preserving mapping of slots of b to slots of a with equal keys and mapped parents."""
    pairs = [(a, b)]
    common: list[list[tuple[Slot, Slot]]] = []
    for x, y in pairs:  # grows
        common.append(_common(x, y) if x.kids and y.kids else [])
        pairs.extend(common[-1])
    size: dict[int, int] = {}
    chosen: dict[int, list[tuple[Slot, Slot]]] = {}
    for (_, y), both in zip(reversed(pairs), reversed(common)):
        if any(p[0].id > q[0].id for p, q in zip(both, both[1:])):
            both = _in_order(both, size)
        chosen[y.id] = both
        size[y.id] = 1 + sum(size[k.id] for _, k in both)
    out: dict[int, int] = {}
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        out[y.id] = x.id
        todo.extend(chosen[y.id])
    return out


def _in_order(both: list[tuple[Slot, Slot]], size: dict[int, int]) -> list[tuple[Slot, Slot]]:
    """The heaviest part of pairs, given in the order of the second, that is in the order of the first too."""
    best: list[tuple[int, int]] = []  # weight of the best chain that ends here, and its last but one pair
    for j, (x, y) in enumerate(both):
        before = max(((best[i][0], i) for i in range(j) if both[i][0].id < x.id), default=(0, -1))
        best.append((before[0] + size[y.id], before[1]))
    out, at = [], max(range(len(both)), key=lambda i: best[i][0])
    while at >= 0:
        out.append(both[at])
        at = best[at][1]
    return out[::-1]
