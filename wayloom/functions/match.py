"""Isomorphism of two small graphs in memory: joint colour refinement, then backtracking within colours."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

Edges = Iterable[tuple[int, int]]
DIFFERENT, UNDECIDED, SAME = "not_isomorphic", "undecided", "isomorphic"


def neighbours(vertices: Iterable[int], edges: Edges) -> tuple[dict[int, set[int]], dict[int, set[int]]]:
    ins: dict[int, set[int]] = {i: set() for i in vertices}
    outs: dict[int, set[int]] = {i: set() for i in ins}
    for s, d in edges:
        outs[s].add(d)
        ins[d].add(s)
    return ins, outs


def refine(graphs: list[tuple[dict, dict]]) -> list[dict[int, int]]:
    """Colours of the vertices of all graphs, shared between them, split by neighbours' colours until they settle."""
    colours = [{i: (len(ins[i]), i in outs[i], len(outs[i])) for i in ins} for ins, outs in graphs]
    n = -1
    while True:
        names: dict = {}
        colours = [{i: names.setdefault(c, len(names)) for i, c in own.items()} for own in colours]
        if len(names) == n:
            return colours
        n = len(names)
        colours = [{i: (own[i], tuple(sorted(own[x] for x in ins[i])), tuple(sorted(own[x] for x in outs[i]))) for i in ins} for own, (ins, outs) in zip(colours, graphs, strict=True)]


def isomorphism(v1: Iterable[int], e1: Edges, v2: Iterable[int], e2: Edges, budget: int = 1_000_000) -> tuple[str, dict[int, int] | None]:
    """The verdict and, if isomorphic, a mapping. budget: vertex pairs tried before giving up."""
    a, b = neighbours(v1, e1), neighbours(v2, e2)
    if len(a[0]) != len(b[0]) or sum(map(len, a[1].values())) != sum(map(len, b[1].values())):
        return DIFFERENT, None
    ca, cb = refine([a, b])
    if Counter(ca.values()) != Counter(cb.values()):
        return DIFFERENT, None
    pool = defaultdict(list)
    for i in sorted(cb):
        pool[cb[i]].append(i)
    # the smallest colours first; among equals those next to vertices already placed
    order: list[int] = []
    waiting = set(ca)
    while waiting:
        i = min(waiting, key=lambda i: (len(pool[ca[i]]), -len((a[0][i] | a[1][i]) & set(order)), i)) if not order else min(waiting, key=lambda i: (len(pool[ca[i]]) > 1 and not (a[0][i] | a[1][i]) & set(order), len(pool[ca[i]]), i))
        order.append(i)
        waiting.discard(i)
    to: dict[int, int] = {}
    used: set[int] = set()
    spent = 0

    def fits(i: int, j: int) -> bool:
        return all((x not in to or to[x] in b[1][j]) for x in a[1][i]) and all((x not in to or to[x] in b[0][j]) for x in a[0][i]) and sum(x in to for x in a[1][i]) == sum(x in used for x in b[1][j]) and sum(x in to for x in a[0][i]) == sum(x in used for x in b[0][j])

    choices = [iter(pool[ca[order[0]]])] if order else []
    while choices:
        i = order[len(choices) - 1]
        if i in to:
            used.discard(to.pop(i))
        for j in choices[-1]:
            if j in used:
                continue
            spent += 1
            if spent > budget:
                return UNDECIDED, None
            if fits(i, j):
                to[i] = j
                used.add(j)
                break
        else:
            choices.pop()
            continue
        if len(choices) == len(order):
            return SAME, dict(to)
        choices.append(iter(pool[ca[order[len(choices)]]]))
    return (SAME, {}) if not order else (DIFFERENT, None)
