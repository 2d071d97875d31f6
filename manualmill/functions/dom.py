"""A small lenient DOM for the few operators that must edit HTML as a tree.

Unclosed elements end with their parent, stray end tags are ignored, scripts and
styles are raw text.  Selectors: lists of simple selectors (tag, #id, .class, [attr],
[attr=v], [attr^=v], [attr*=v]) without combinators, which is all that the profiles need.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {"li": {"ul", "ol"}, "p": set(), "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: list[tuple[str, str | None]] | None = None, parent: Node | None = None) -> None:
        self.name, self.attrs, self.parent = name, {k: v or "" for k, v in attrs or []}, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        return "".join(part for part in self._pieces(False))

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace(self, other: Node) -> None:
        """Put other, wherever it stood, in the place of this node."""
        home = self.parent
        if home is None:
            return
        other.remove()
        home.children = [other if c is self else c for c in home.children]
        self.parent, other.parent = None, home

    def _pieces(self, markup: bool, shell: bool = False) -> Iterator[str]:
        """The parts of the text, or of the markup, of what the node holds (with shell: and of itself), in order.

        Without recursion, so the depth of a page does not matter.
        """
        stack: list[Node | str | tuple[str]] = [self] if shell else list(reversed(self.children))
        raw = not shell and self.name in ("script", "style")
        if not markup and self.name in ("script", "style", "#comment"):
            return
        while stack:
            item = stack.pop()
            if isinstance(item, tuple):  # an end tag
                yield item[0]
            elif isinstance(item, str):
                yield html.escape(item, quote=False) if markup and not raw else item
            elif not markup:
                if item.name not in ("script", "style", "#comment"):
                    stack += reversed(item.children)
            elif item.name in ("#comment", "#decl"):
                body = "".join(c for c in item.children if isinstance(c, str))
                yield f"<!--{body}-->" if item.name == "#comment" else f"<!{body}>"
            elif item.name == "#document":
                stack += reversed(item.children)
            else:
                attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in item.attrs.items())
                if item.name in VOID:
                    yield f"<{item.name}{attrs}/>"
                    continue
                yield f"<{item.name}{attrs}>"
                stack.append((f"</{item.name}>",))
                if item.name in ("script", "style"):
                    stack += [(c,) for c in reversed(item.children) if isinstance(c, str)]
                else:
                    stack += reversed(item.children)

    def inner(self) -> str:
        return "".join(self._pieces(True))

    def outer(self) -> str:
        return "".join(self._pieces(True, shell=True))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#document")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSED_BY and self._open(tag, _CLOSED_BY[tag]):
            self.handle_endtag(tag)
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, attrs, self.at))

    def _open(self, tag: str, stop: set[str]) -> bool:
        """Is such an element open, with nothing between that may hold another?"""
        node = self.at
        while node.parent is not None and node.name not in stop and (tag != "p" or node.name in ("p", "b", "i", "em", "strong", "a", "span")):
            if node.name == tag:
                return True
            node = node.parent
        return False

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def _leaf(self, name: str, data: str) -> None:
        node = Node(name, None, self.at)
        node.children.append(data)
        self.at.children.append(node)

    def handle_comment(self, data: str) -> None:
        self._leaf("#comment", data)

    def handle_decl(self, decl: str) -> None:
        self._leaf("#decl", decl)


def parse(text: str) -> Node:
    builder = _Builder()
    builder.feed(text)
    builder.close()
    return builder.root


_PART = re.compile(r"""(\*|[A-Za-z][A-Za-z0-9]*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([\^*]?=)["']?([^"'\]]*)["']?)?\]""")


def matcher(selector: str) -> Callable[[Node], bool]:
    """Test of an element against a comma-separated list of simple selectors."""
    options = []
    for one in selector.split(","):
        tests = []
        for tag, ident, cls, attr, op, value in _PART.findall(one.strip()):
            if tag and tag != "*":
                tests.append(lambda n, t=tag.lower(): n.name == t)
            elif ident:
                tests.append(lambda n, i=ident: n.attrs.get("id") == i)
            elif cls:
                tests.append(lambda n, c=cls: c in n.attrs.get("class", "").split())
            elif attr and not op:
                tests.append(lambda n, a=attr: a in n.attrs)
            elif op == "=":
                tests.append(lambda n, a=attr, v=value: n.attrs.get(a) == v)
            elif op == "^=":
                tests.append(lambda n, a=attr, v=value: n.attrs.get(a, "").startswith(v))
            elif op == "*=":
                tests.append(lambda n, a=attr, v=value: v in n.attrs.get(a, ""))
        options.append(tests)
    return lambda n: any(all(t(n) for t in tests) for tests in options)


def select(root: Node, selector: str) -> list[Node]:
    test = matcher(selector)
    return [n for n in root.walk() if test(n)]


def select_one(root: Node, selector: str) -> Node | None:
    test = matcher(selector)
    return next((n for n in root.walk() if test(n)), None)


def drop(root: Node, selector: str) -> None:
    for n in select(root, selector):
        n.remove()
