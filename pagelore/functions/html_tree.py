"""A small tolerant HTML tree on the standard parser: implied end tags, void and raw elements."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key ends an open element of the values that has no scope boundary above it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li".split())
SCOPE = frozenset("html body table td th ul ol dl select button div section article main".split())
BREAKS = ENDS_P | {"td", "th", "tr", "br", "dt", "dd", "option", "title"}
NO_TEXT = frozenset(("script", "style"))
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "order")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, order: int) -> None:
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.children: list[Node | str] = []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def above(self):
        node = self
        while node is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        """Text of all descendants but scripts and styles, white space collapsed, block edges counted as white space."""
        parts, stack = [], [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item)
            elif item.tag not in NO_TEXT:
                edge = " " if item.tag in BREAKS else ""
                parts.append(edge)
                stack.append(edge)
                stack.extend(reversed(item.children))
        return SPACES.sub(" ", "".join(parts)).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None, 0)
        self.at, self.count = self.root, 0

    def _close(self, tags: tuple[str, ...]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in tags:
            if node.tag in SCOPE:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_P:
            self._close(("p",))
        if tag in ENDS:
            self._close(ENDS[tag])
        self.count += 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, self.count)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
