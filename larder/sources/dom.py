"""A small page tree with the selector forms the site tables use.

Used inside tasks only, one page at a time; Spark partitions the pages.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
BLOCK = {"p", "div", "li", "ul", "ol", "tr", "table", "article", "section", "h1", "h2", "h3", "h4", "br", "nav", "footer"}
HIDDEN = {"script", "style"}


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []

    def walk(self):
        stack = list(reversed(self.parts))
        while stack:
            part = stack.pop()
            if isinstance(part, Node):
                yield part
                stack.extend(reversed(part.parts))

    def raw_text(self):
        out, stack = [], list(reversed(self.parts))
        while stack:
            part = stack.pop()
            if isinstance(part, Node):
                stack.extend(reversed(part.parts))
            else:
                out.append(part)
        return "".join(out)

    def text(self):
        """Visible text; block elements start a new line."""
        out, stack = [], list(reversed(self.parts))
        while stack:
            part = stack.pop()
            if not isinstance(part, Node):
                out.append(part)
            elif part.tag not in HIDDEN:
                if part.tag in BLOCK:
                    out.append("\n")
                    stack.append("\n")
                stack.extend(reversed(part.parts))
        return re.sub(r"\n\s*\n+", "\n", "".join(out)).strip()

    def all(self, selector):
        groups = compile_selector(selector)
        return [n for n in self.walk() if any(matches(n, g) for g in groups)]

    def first(self, selector):
        groups = compile_selector(selector)
        return next((n for n in self.walk() if any(matches(n, g) for g in groups)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.parts.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.parts.append(Node(tag, {k: v or "" for k, v in attrs}, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        self.here.parts.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


STEP = re.compile(r":not\((?P<no>[^)]*)\)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^]?=)[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]|\.(?P<cls>[\w-]+)|(?P<tag>[\w-]+)")


@lru_cache(maxsize=512)
def compile_selector(selector: str):
    """Comma-separated groups of (direct child?, tests) steps."""
    groups = []
    for group in re.split(r",(?![^\[]*\])", selector):
        tokens = re.findall(r">|(?:\[[^\]]*\]|:not\([^)]*\)|[^\s>])+", group.strip())
        steps, direct = [], False
        for token in tokens:
            if token == ">":
                direct = True
                continue
            steps.append((direct, [m.groupdict() for m in STEP.finditer(token)]))
            direct = False
        groups.append(steps)
    return groups


def _fits(node, tests):
    for t in tests:
        if t["no"] is not None:
            ok = not any(matches(node, g) for g in compile_selector(t["no"]))
        elif t["attr"]:
            value = node.attrs.get(t["attr"])
            ok = value is not None and (
                t["op"] is None
                or (t["op"] == "*=" and t["val"] in value)
                or (t["op"] == "^=" and value.startswith(t["val"]))
                or (t["op"] == "=" and value == t["val"])
            )
        elif t["cls"]:
            ok = t["cls"] in node.attrs.get("class", "").split()
        else:
            ok = node.tag == t["tag"]
        if not ok:
            return False
    return True


def matches(node, steps) -> bool:
    direct, tests = steps[-1]
    if not _fits(node, tests):
        return False
    rest = steps[:-1]
    if not rest:
        return True
    if direct:
        return node.parent is not None and matches(node.parent, rest)
    up = node.parent
    while up is not None:
        if matches(up, rest):
            return True
        up = up.parent
    return False


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            # of an attribute given twice the first counts
            self.found += [v or "" for k, v in attrs if k == "href"][:1]


def links(html: str) -> list[str]:
    """The href of every link in order, whatever its quoting; text inside scripts and comments is no link."""
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    return parser.found


class Selectors:
    """Many selectors matched in one walk of a page.

    Every step of every selector stands in one table under the most telling thing it asks of a node: a class, an
    attribute's value, a tag, an attribute. A node looks up only the steps under its own classes, attributes and tag. What
    its ancestors have matched comes down the walk as a set of steps that may follow, so nothing climbs back up.
    """

    def __init__(self, selectors: dict):
        self.table, self.any = {}, []
        number = 0
        for key, text in selectors.items():
            for steps in compile_selector(text):
                for k, (_, tests) in enumerate(steps):
                    follows = None
                    if k + 1 < len(steps):
                        follows = (number + 1, steps[k + 1][0])
                    entry = (number if k else None, tests, key, follows)
                    place = self._place(tests)
                    (self.any if place is None else self.table.setdefault(place, [])).append(entry)
                    number += 1

    @staticmethod
    def _place(tests):
        for wanted in (
            lambda t: ("class", t["cls"]) if t["cls"] else None,
            lambda t: ("value", t["attr"], t["val"]) if t["attr"] and t["op"] == "=" else None,
            lambda t: ("tag", t["tag"]) if t["tag"] else None,
            lambda t: ("attribute", t["attr"]) if t["attr"] else None,
        ):
            for t in tests:
                if t["no"] is None and wanted(t):
                    return wanted(t)
        return None

    def _candidates(self, node):
        get = self.table.get
        yield from get(("tag", node.tag), ())
        for name, value in node.attrs.items():
            yield from get(("attribute", name), ())
            yield from get(("value", name, value), ())
        for name in set(node.attrs.get("class", "").split()):
            yield from get(("class", name), ())
        yield from self.any

    def walk(self, root: Node):
        """The page's nodes in document order, the end of each one's subtree and the places of each key's matches."""
        nodes, ends, found = [], [], {}
        below, inside = frozenset(), frozenset()
        stack = [(part, -1, below, inside) for part in reversed(root.parts) if isinstance(part, Node)]
        parents = []
        while stack:
            node, parent, below, inside = stack.pop()
            place = len(nodes)
            nodes.append(node)
            parents.append(parent)
            ends.append(place + 1)
            deeper, direct, seen = below, frozenset(), set()
            for number, tests, key, follows in self._candidates(node):
                if (number is None or number in below or number in inside) and (follows is not None or key not in seen) and _fits(node, tests):
                    if follows is None:
                        seen.add(key)
                        found.setdefault(key, []).append(place)
                    elif follows[1]:
                        direct |= {follows[0]}
                    else:
                        deeper |= {follows[0]}
            stack.extend((part, place, deeper, direct) for part in reversed(node.parts) if isinstance(part, Node))
        for place in range(len(nodes) - 1, -1, -1):
            if parents[place] >= 0:
                ends[parents[place]] = max(ends[parents[place]], ends[place])
        return Page(nodes, parents, ends, found)


class Page:
    """A walked page: its nodes in document order and where each key matched."""

    def __init__(self, nodes, parents, ends, found):
        self.nodes, self.parents, self.ends, self.found = nodes, parents, ends, found

    def all(self, key, place: int | None = None) -> list[int]:
        """Places of a key's matches, below one node if given."""
        own = self.found.get(key, [])
        return own if place is None else own[bisect_right(own, place) : bisect_left(own, self.ends[place])]

    def first(self, key, place: int | None = None) -> Node | None:
        own = self.found.get(key, [])
        k = 0 if place is None else bisect_right(own, place)
        return self.nodes[own[k]] if k < len(own) and (place is None or own[k] < self.ends[place]) else None

    def lifted(self, key, wrapper) -> list[int]:
        """The nearest node that matches ``wrapper`` from each match of ``key`` upwards, else the node three above; each once."""
        wrappers, out = set(self.found.get(wrapper, [])), {}
        for place in self.found.get(key, []):
            up = place
            while up >= 0 and up not in wrappers:
                up = self.parents[up]
            if up < 0:
                up = place
                for _ in range(3):
                    up = self.parents[up] if up >= 0 else up
            if up >= 0:
                out[up] = None
        return list(out)
