"""Text of DOT documents: an accumulator of indented lines with the graph's attributes.

Attributes are a dict: a vertex id, an edge pair, a graph name, "node" or "edge" to a list of (key, value).
The key "alias" gives the name under which a vertex is written.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

ALIAS, FILETYPE = "alias", "dot"
#: Fixed values of the format.
RANKDIRS = ("TB", "BT", "LR", "RL")
RANKS = ("same", "min", "max", "source", "sink")
DIRECTIONS = ("none", "both", "forward", "back")
_NAME = re.compile(r"[A-Za-z0-9_.]+\Z|[A-Za-z_][A-Za-z0-9_\-.]*\Z")
_PLAIN = re.compile(r"-?(\d+(\.\d+)?|\.\d+)\Z")

Attributes = dict[Any, list[tuple[str, Any]]]


class Word(str):
    """A value written without quotes."""


def value(v: Any) -> str:
    """The text of an attribute value: words and numbers plain, strings and colours in quotes."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float, Word)):
        return str(v)
    if isinstance(v, tuple) and len(v) == 3 and all(isinstance(x, int) for x in v):
        return '"#%02X%02X%02X"' % v
    if isinstance(v, tuple):
        return '"' + ",".join(str(x) for x in v) + '"'
    return quoted(str(v))


def quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + '"'


def bracketed(attributes: list[tuple[str, Any]]) -> str:
    return " [" + ", ".join(f"{k}={quoted(str(v)) if k == 'label' else value(v)}" for k, v in attributes) + "]" if attributes else ""


def pairs(attributes: Any) -> list[tuple[str, Any]]:
    return list(attributes.items()) if isinstance(attributes, dict) else list(attributes or [])


def identity(i: Any, attributes: Attributes | None) -> tuple[str, list[tuple[str, Any]]]:
    """The name under which a vertex is written, and its attributes without the alias."""
    own = pairs((attributes or {}).get(i))
    name = str(next((v for k, v in own if k == ALIAS), i))
    if not _NAME.match(name):
        raise ValueError(f"not an identifier: {name!r}")
    return name, [x for x in own if x[0] != ALIAS]


class Dot:
    """Every method returns the document, so calls can be chained."""

    def __init__(self, name: str = "mydot"):
        self.lines: list[str] = []
        self.depth = 0
        self.open_graph(name)

    def put(self, text: str) -> Dot:
        self.lines.append("  " * self.depth + text)
        return self

    def _open(self, text: str) -> Dot:
        self.put(text)
        self.depth += 1
        return self

    def open_graph(self, name: str) -> Dot:
        return self._open(f"digraph {name} {{")

    def close_graph(self) -> Dot:
        self.depth -= 1
        return self.put("}")

    def open_subgraph(self, name: str | None = None) -> Dot:
        return self._open(f"subgraph {name} {{" if name else "{")

    close_subgraph = close_graph

    def text(self) -> str:
        """Closes the document."""
        self.close_graph()
        return "\n".join(self.lines) + "\n"

    def reduce(self, xs: Iterable, f: Callable[[Any, Dot], Dot]) -> Dot:
        out = self
        for x in xs:
            out = f(x, out)
        return out

    def attribute(self, k: str, v: Any) -> Dot:
        return self.put(f"{k}={quoted(str(v)) if k == 'label' else value(v)};")

    def rankdir(self, v: str) -> Dot:
        return self._word("rankdir", v, RANKDIRS)

    def rank(self, v: str) -> Dot:
        return self._word("rank", v, RANKS)

    def _word(self, k: str, v: str, known: tuple[str, ...]) -> Dot:
        if v not in known:
            raise ValueError(f"no such {k}: {v}")
        return self.attribute(k, Word(v))

    def size(self, w: float, h: float) -> Dot:
        return self.attribute("size", (w, h))

    def fixedsize(self, yes: bool) -> Dot:
        return self.attribute("fixedsize", yes)

    def fontname(self, font: str) -> Dot:
        return self.attribute("fontname", font)

    def common(self, kind: str, attributes: Any) -> Dot:
        """Attributes of all nodes or all edges: a list of pairs, or the graph's attributes."""
        if kind not in ("node", "edge"):
            raise ValueError(f"not node or edge: {kind}")
        own = pairs(attributes.get(kind) if isinstance(attributes, dict) else attributes)
        return self.put(f"{kind}{bracketed(own)};") if own else self

    def globals(self, name: str, attributes: Attributes) -> Dot:
        for kind in ("node", "edge"):
            own = pairs(attributes.get(kind) or attributes.get(f"{name}_{kind}"))
            if own:
                self.put(f"{kind}{bracketed(own)};")
        for k, v in pairs(attributes.get(name)):
            self.attribute(k, v)
        return self

    def node(self, i: Any, attributes: Attributes | None = None) -> Dot:
        name, own = identity(i, attributes)
        return self.put(f"{name}{bracketed(own)};")

    def nodes(self, ids: Iterable, attributes: Attributes | None = None) -> Dot:
        for i in ids:
            self.node(i, attributes)
        return self

    def nodes1(self, ids: Iterable, attributes: Attributes | None = None) -> Dot:
        """All on one line."""
        return self.put("".join(f"{n}{bracketed(a)}; " for n, a in (identity(i, attributes) for i in ids)))

    def _edge(self, i: Any, j: Any, attributes: Attributes | None, own: list) -> str:
        return f"{identity(i, attributes)[0]} -> {identity(j, attributes)[0]}{bracketed(own)}"

    def edge(self, e: tuple, attributes: Attributes | None = None, more: Any = ()) -> Dot:
        """more: attributes of this edge only, before those in attributes."""
        return self.put(self._edge(*e, attributes, pairs(more) + pairs((attributes or {}).get(e))) + ";")

    def edges(self, es: Iterable[tuple], attributes: Attributes | None = None, pair: str = "forward", single: str = "forward") -> Dot:
        """pair, single: the direction drawn for opposite pairs (none and both: as one edge) and for other edges."""
        if pair not in ("none", "both", "forward") or single not in ("none", "forward"):
            raise ValueError("no such direction")
        es = list(es)
        if pair == single == "forward":
            for e in es:
                self.edge(e, attributes)
            return self
        there, done = set(es), set()
        for e in es:
            back = (e[1], e[0])
            if e in done:
                continue
            if back in there and back != e:
                if pair != "forward":
                    done.add(back)
                self.edge(e, attributes, [("dir", Word(pair))])
            else:
                self.edge(e, attributes, [("dir", Word(single))])
        return self

    def edges1(self, es: Iterable[tuple], attributes: Attributes | None = None) -> Dot:
        return self.put("".join(f"{self._edge(*e, attributes, pairs((attributes or {}).get(e)))}; " for e in es))

    def chain(self, ids: Iterable, attributes: Attributes | None = None) -> Dot:
        ids = list(ids)
        if len(ids) < 2:
            raise ValueError("a chain has two vertices at least")
        return self.put(" -> ".join(identity(i, attributes)[0] for i in ids) + ";")
