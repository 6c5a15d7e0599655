"""A light element tree of one HTML document, built by the standard tokenizer: the only per-row parser here.

No scripts run. Elements that end themselves (void ones), paragraphs, list items, options, table cells and definition
terms are closed as browsers do; an end tag without a start is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
#: A start tag closes an open paragraph, and the elements of its own kind up to a container.
BLOCKS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "option": ({"option"}, {"select", "datalist"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
SPACES = re.compile("[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")


def clean(text: str | None, most: int = 2000) -> str:
    return SPACES.sub(" ", text or "").strip(" ")[:most]


def blank(text: str | None) -> bool:
    """Whether ``clean`` leaves nothing of a text."""
    return not text or SPACES.fullmatch(text) is not None


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below this one, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, skip=None) -> str:
        """Text below this element, without elements for which ``skip`` holds."""
        out: list[str] = []
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif skip is None or not skip(n):
                todo += reversed(n.children)
        return "".join(out)

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.html = Node("html", {}, None)
        self.head = Node("head", {}, self.html)
        self.body = Node("body", {}, self.html)
        self.html.children = [self.head, self.body]
        self.open = [self.head]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            node = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in own.items():
                node.attrs.setdefault(k, v)
            if tag == "body" and self.open[0] is self.head:
                self.open = [self.body]
            return
        if self.open[0] is self.head and len(self.open) == 1 and tag not in HEAD_ONLY:
            self.open = [self.body]
        if tag in BLOCKS:
            self._close({"p"}, {"button", "table", "td", "th", "caption", "object", "template"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        node = Node(tag, own, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def _close(self, tags: set[str], within: set[str]) -> None:
        """End the innermost open element of ``tags`` unless a container of ``within`` is nearer."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                if tags & {"tr", "td", "th"}:
                    self._close(tags, within)
                return
            if self.open[i].tag in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "head" and self.open[0] is self.head:
            self.open = [self.body]
        elif tag not in ("html", "body", "head"):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    del self.open[i:]
                    return

    def handle_data(self, data: str) -> None:
        if self.open[0] is self.head and len(self.open) == 1:
            if not data.strip():
                return
            self.open = [self.body]
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    b = Builder()
    b.feed(html)
    b.close()
    return b.html


_SIMPLE = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:=\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*)?\]""")


class Selector:
    """Tags, #id, .class, [attr], [attr=value], descendants, children and commas; anything else is a ValueError."""

    def __init__(self, text: str):
        self.choices = [self._chain(part) for part in text.split(",")]

    def _chain(self, text: str) -> list[tuple[str, list[tuple[str, str, str | None]]]]:
        out, child = [], " "
        for token in re.findall(r">|(?:[^\s>\[]|\[[^\]]*\])+", text.strip()):
            if token == ">":
                if not out or child == ">":
                    raise ValueError("selector")
                child = ">"
                continue
            tests, at = [], 0
            while at < len(token):
                m = _SIMPLE.match(token, at) if at else _SIMPLE.match(token)
                if not m or m.end() == at:
                    raise ValueError("selector")
                g = m.groupdict()
                if g["tag"]:
                    tests.append(("tag", g["tag"].lower(), None))
                elif g["id"]:
                    tests.append(("attr", "id", g["id"]))
                elif g["cls"]:
                    tests.append(("class", g["cls"], None))
                else:
                    tests.append(("attr", g["attr"].lower(), next((g[k] for k in ("dq", "sq", "bare") if g[k] is not None), None)))
                at = m.end()
            out.append((child, tests))
            child = " "
        if not out or child == ">":
            raise ValueError("selector")
        return out

    @staticmethod
    def _fits(n: Node, tests: list[tuple[str, str, str | None]]) -> bool:
        for kind, name, value in tests:
            if kind == "tag" and name not in ("*", n.tag):
                return False
            if kind == "class" and name not in (n.get("class") or "").split():
                return False
            if kind == "attr" and (name not in n.attrs or (value is not None and n.attrs[name] != value)):
                return False
        return True

    def matches(self, n: Node) -> bool:
        def up(node: Node | None, chain: list, k: int) -> bool:
            if node is None or not self._fits(node, chain[k][1]):
                return False
            if k == 0:
                return True
            above = node.parent
            if chain[k][0] == ">":
                return up(above, chain, k - 1)
            while above is not None:
                if up(above, chain, k - 1):
                    return True
                above = above.parent
            return False

        return any(up(n, chain, len(chain) - 1) for chain in self.choices)
