"""Contraction of edges, sets of vertices and linear vertices."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions.storage import stored
from wayloom.graph import Graph
from wayloom.operators.components import weak


def nodes(g: Graph, ids: Iterable[int]) -> Graph:
    """Merges vertices into the smallest. Edges among them go; the loop of one that isn't the smallest stays as a loop."""
    wanted = sorted(set(ids))
    there = sorted(r[0] for r in g.vertices.filter(F.col("id").isin(wanted)).collect()) if wanted else []
    if len(there) < 2:
        return g
    keep, gone = there[0], there[1:]
    to = lambda c: F.when(F.col(c).isin(gone), keep).otherwise(F.col(c))
    inside = F.col("src").isin(there) & F.col("dst").isin(there) & (F.col("src") != F.col("dst"))
    edges = g.edges.filter(~inside).select(to("src").cast("long").alias("src"), to("dst").cast("long").alias("dst")).distinct()
    return Graph(g.vertices.filter(~F.col("id").isin(gone)), edges, g.name)


def edge(g: Graph, s: int, d: int) -> Graph:
    """Merges the ends of an edge into the smaller. A missing edge changes nothing; a loop is deleted.

    The contracted edge and its opposite leave no loop; a loop of the larger end moves to the smaller.
    """
    if not g.has_edge(s, d):
        return g
    if s == d:
        return g.delete((s, d))
    return nodes(g, [s, d])


class Linking:
    """In-memory neighbours of a component, for contractions one after another."""

    def __init__(self, vertices: Iterable[int], edges: Iterable[tuple[int, int]]):
        self.ins: dict[int, set[int]] = {i: set() for i in vertices}
        self.outs: dict[int, set[int]] = {i: set() for i in self.ins}
        for s, d in edges:
            self.outs[s].add(d)
            self.ins[d].add(s)

    def refusal(self, i: int) -> str | None:
        """Why vertex i can't be contracted; None if it can."""
        a, b = self.ins[i], self.outs[i]
        if i in a:
            return "the vertex has a loop"
        if len(a) == 1 and len(b) == 1:
            (j,), (k,) = a, b
            if j == k:
                return "its neighbours are one vertex"
            return "its neighbours are linked already" if k in self.outs[j] else None
        if len(a) == 2 and a == b:
            j, k = a
            return "its neighbours are linked already" if k in self.outs[j] or j in self.outs[k] else None
        return "not one way in and one out"

    def remove(self, i: int) -> None:
        a, b = self.ins.pop(i), self.outs.pop(i)
        for j in a:
            self.outs[j].discard(i)
        for k in b:
            self.ins[k].discard(i)
        for j in a:
            for k in b:
                if j != k:
                    self.outs[j].add(k)
                    self.ins[k].add(j)

    def sweep(self) -> bool:
        """One pass over the vertices, ascending. True if something changed."""
        changed = False
        for i in sorted(self.ins):
            if self.refusal(i) is None:
                self.remove(i)
                changed = True
        return changed

    def rows(self) -> list[tuple[int, int | None]]:
        return [(s, d) for s, ds in self.outs.items() for d in sorted(ds)] + [(i, None) for i in self.outs]


def linear(g: Graph, i: int) -> Graph:
    """Takes out one linear vertex (one way in, one out, or two neighbours linked both ways); ValueError says why not."""
    g.check_vertex(i)
    pairs = [(r[0], r[1]) for r in g.edges.filter((F.col("src") == i) | (F.col("dst") == i)).limit(6).collect()]
    near = sorted({x for p in pairs for x in p} - {i})
    among = [(r[0], r[1]) for r in g.edges.filter(F.col("src").isin(near) & F.col("dst").isin(near)).collect()] if 0 < len(near) <= 2 else []
    held = Linking({i, *near}, {*pairs, *among})
    why = held.refusal(i) if len(pairs) < 6 else "not one way in and one out"
    if why:
        raise ValueError(why)
    held.remove(i)
    made = [(s, d) for s, d in held.rows() if d is not None]
    return g.delete(i).add(made)


def sweep_groups(edges: DataFrame, vertices: DataFrame, key: str, fixpoint: bool = False) -> DataFrame:
    """(key, src, dst) after contraction of the linear vertices of every group; dst is null in a row for each vertex left."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = Linking((int(x) for x in rows.loc[rows["dst"].isna(), "src"]), ((int(s), int(d)) for s, d in rows.loc[rows["dst"].notna(), ["src", "dst"]].itertuples(index=False)))
        while held.sweep() and fixpoint:
            pass
        out = pd.DataFrame(held.rows(), columns=["src", "dst"], dtype=object)
        out["dst"] = out["dst"].astype("Int64")
        out["src"] = out["src"].astype("int64")
        out.insert(0, key, rows[key].iloc[0])
        return out

    kind = dict(edges.dtypes)[key]
    rows = edges.select(key, "src", "dst").union(vertices.select(key, "id", F.lit(None).cast("long")))
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, src long, dst long")


def linears(g: Graph, fixpoint: bool = False) -> Graph:
    """One pass over the vertices by ascending id that takes out every linear one (or passes until nothing changes).

    The result depends on the order, so a weak component is one task's work.
    """
    comps = stored(weak(g), "linears-comps")
    edges = g.edges.join(comps.withColumnRenamed("id", "src"), "src").select("comp", "src", "dst")
    rows = stored(sweep_groups(edges, comps, "comp", fixpoint), "linears")
    left = rows.filter("dst is null").select(F.col("src").alias("id"))
    name = f"{g.name}_con" if left.count() != g.n_vertices() else g.name
    return Graph(left, rows.filter("dst is not null").select("src", "dst"), name)
