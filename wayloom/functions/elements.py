"""Graph elements as plain values: vertices, ranges, edges, chains, adjacency lists and nested lists of these."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Parts:
    """What an element stands for. `lone` are vertices given as such, `edges` pairs, `heads` sources of empty adjacency lists."""

    lone: list[int] = field(default_factory=list)
    ranges: list[range] = field(default_factory=list)
    edges: list[tuple[int, int]] = field(default_factory=list)
    heads: list[int] = field(default_factory=list)


def vertex(x: Any) -> int:
    if isinstance(x, bool) or not isinstance(x, int) or x < 1:
        raise ValueError(f"not a vertex id: {x!r}")
    return x


def parse(element: Any, into: Parts | None = None) -> Parts:
    """An int is a vertex, a range its ids, a pair an edge, a longer tuple a chain, (id, list) an adjacency list, a list or set all its elements."""
    out = Parts() if into is None else into
    if isinstance(element, range):
        if len(element):
            vertex(min(element))
            out.ranges.append(element)
    elif isinstance(element, (list, set, frozenset)):
        for x in element:
            parse(x, out)
    elif isinstance(element, tuple) and len(element) == 2 and isinstance(element[1], (list, set, frozenset)):
        head = vertex(element[0])
        out.edges += [(head, vertex(x)) for x in element[1]]
        if not element[1]:
            out.heads.append(head)
    elif isinstance(element, tuple) and len(element) >= 2:
        ids = [vertex(x) for x in element]
        out.edges += zip(ids, ids[1:], strict=False)
    elif isinstance(element, tuple):
        raise ValueError(f"not a graph element: {element!r}")
    else:
        out.lone.append(vertex(element))
    return out


def clean_name(name: str) -> str:
    """White space becomes '_', other punctuation goes."""
    if not isinstance(name, str) or not name:
        raise ValueError("a graph needs a name")
    return re.sub(r"\W", "", re.sub(r"\s+", "_", name.strip())) or "graph"
