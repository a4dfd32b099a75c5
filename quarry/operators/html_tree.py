"""A small tree of an HTML page on the standard library's parser, tolerant of markup that is never closed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag closes an open one of the same group that stands directly around it.
SIBLINGS = {t: frozenset(g.split()) for g in ("p", "li", "dt dd", "tr", "td th", "option") for t in g.split()}
#: Elements before which an open paragraph ends.
BREAKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """An element: its tag, attributes and children, which are nodes and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in page order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find_all(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if n is not self and test(n)]

    def find(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if n is not self and test(n)), None)

    def strings(self, skip: Callable[[Node], bool] = lambda n: False) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x is self or not skip(x):
                stack += reversed(x.children)

    def text(self, joint: str = "", skip: Callable[[Node], bool] = lambda n: False) -> str:
        if not joint:
            return "".join(self.strings(skip))
        return joint.join(s for s in (x.strip() for x in self.strings(skip)) if s)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BREAKS_P and self.at.tag == "p":
            self.at = self.at.parent
        elif self.at.tag in SIBLINGS.get(tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(page: str | None) -> Node:
    """The tree of a page; a page that can't be parsed ends where the parser did."""
    b = _Builder()
    try:
        b.feed(page or "")
        b.close()
    except (AssertionError, ValueError):
        pass
    return b.root


def has_class(*names: str) -> Callable[[Node], bool]:
    return lambda n: any(c in names for c in n.classes)


def is_tag(*tags: str) -> Callable[[Node], bool]:
    return lambda n: n.tag in tags
