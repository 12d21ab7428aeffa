"""A lenient reading of one HTML page; a small helper that the page operators run on Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# an opening tag of the first kind ends an open one of the second
ENDS = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}, "div": {"p"}, "ul": {"p"}, "table": {"p"}, "article": {"p"}, "footer": {"p"}}
INLINE = frozenset("a b i u em strong span font small".split())
NOISE = frozenset("header footer nav script style noscript iframe".split())
CONTAINERS = ("id=contents", "id=content", "class=contents", "class=content", "class=sub_contents", "class=sub_content", "class=sub_con")


class Node:
    __slots__ = ("tag", "attrs", "items", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []

    def walk(self):
        """All elements below, in the order of the page."""
        stack = [x for x in reversed(self.items) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.items) if isinstance(x, Node))

    def strings(self, skip: frozenset[str] = NOISE):
        """Stripped texts that are not empty, without those inside the skipped elements."""
        stack = list(reversed(self.items))
        while stack:
            item = stack.pop()
            if isinstance(item, Node):
                if item.tag not in skip:
                    stack.extend(reversed(item.items))
            elif item.strip():
                yield item.strip()

    def text(self, glue: str = "\n") -> str:
        return glue.join(self.strings())

    def first(self, test) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        ends, node = ENDS.get(tag, ()), self.at
        while ends and (node.tag in INLINE or node.tag in ends):
            if node.tag in ends:
                self.at = node.parent
            node = node.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.items.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.items.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


class Sizes:
    """What an element holds: characters and number of its texts (not those inside NOISE), characters of the links below, and headings below."""

    __slots__ = ("chars", "texts", "linked", "h2", "h3")

    def __init__(self):
        self.chars = self.texts = self.linked = self.h2 = self.h3 = 0

    @property
    def length(self) -> int:
        """Characters of the element's text, its parts glued by one character."""
        return self.chars + max(0, self.texts - 1)


def measure(nodes: list[Node]) -> dict[int, Sizes]:
    """Sizes of elements by id(); nodes are a root and all below in the order of the page, so that the last come first and each is added to its parent once."""
    found = {id(n): Sizes() for n in nodes}
    for node in reversed(nodes):
        own = found[id(node)]
        for item in node.items:
            if not isinstance(item, Node):
                said = len(item.strip())
                own.chars += said
                own.texts += said > 0
                continue
            below = found[id(item)]
            if item.tag not in NOISE:
                own.chars += below.chars
                own.texts += below.texts
            own.linked += below.linked + (below.length if item.tag == "a" else 0)
            own.h2 += below.h2 + (item.tag == "h2")
            own.h3 += below.h3 + (item.tag == "h3")
    return found


def container(root: Node, wanted: tuple[str, ...] = CONTAINERS) -> tuple[str, Node]:
    """The first wanted id or class of the page, else main, article, body or all of it; with its name."""
    for name in wanted:
        kind, value = name.split("=")
        found = root.first(lambda n: value in (n.attrs.get(kind) or "").split())
        if found is not None:
            return name, found
    for tag in ("main", "article", "body"):
        found = root.first(lambda n: n.tag == tag)
        if found is not None:
            return tag, found
    return "", root


def sections(box: Node) -> list[tuple[str, str]]:
    """(path, text) of the parts under h2 headings, cut again at h3; all of it as `body` without an h2."""
    heads = [n for n in box.walk() if n.tag == "h2"]
    if not heads:
        whole = box.text()
        return [("body", whole)] if whole else []
    out = []
    for head in heads:
        parts: dict[str, list[str]] = {}
        under, after = "", False
        for item in head.parent.items:
            if item is head:
                after = True
            elif not after:
                continue
            elif isinstance(item, Node) and item.tag == "h2":
                break
            elif isinstance(item, Node) and item.tag == "h3":
                under = item.text(" ")
            else:
                said = (item.text() if item.tag not in NOISE else "") if isinstance(item, Node) else item.strip()
                if said:
                    parts.setdefault(under, []).append(said)
        for name, texts in parts.items():
            out.append((f"h2:{head.text(' ')}" + (f" > h3:{name}" if name else ""), "\n".join(texts)))
    return out


def table_rows(root: Node, most_rows: int = 8, most_columns: int = 6) -> list[list[str]]:
    """The first rows of the first table of three rows or more; else the items of the first list of a listing class."""
    for table in (n for n in root.walk() if n.tag == "table"):
        rows = [[c.text(" ") for c in r.walk() if c.tag in ("td", "th")][:most_columns] for r in table.walk() if r.tag == "tr"]
        if len(rows) >= 3:
            return rows[:most_rows]
    listing = root.first(lambda n: n.tag in ("ul", "ol") and re.search("board|list|article", n.attrs.get("class", "")) is not None)
    return [[n.text(" ")] for n in listing.walk() if n.tag == "li"][:most_rows] if listing else []
