"""Depth-first and breadth-first walks with visitors, and spanning forests as tables.

A walk is sequential, so its unit is a weak component, which one worker must hold; components run side by side. A walk
with a visitor of one's own is of the whole graph, in one task: its result may depend on all that went before.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions.ranges import running
from wayloom.functions.storage import ship, stored
from wayloom.functions.walk import CONTROLS, Control, Given, Tree, Visitor, walk
from wayloom.graph import Graph
from wayloom.operators.components import weak

FOREST = "root long, id long, parent long, depth int, pre long, post long, child_idx int"


def adjacency(g: Graph, kind: str) -> DataFrame:
    """id, near: ascending neighbours, both ways for weak. A row for every vertex."""
    if kind not in ("weak", "strong"):
        raise ValueError(f"no such connectivity: {kind}")
    steps = g.edges if kind == "strong" else g.edges.union(g.edges.select("dst", "src"))
    rows = steps.union(g.vertices.select("id", F.lit(None)))
    return rows.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("near"))


def _held(rows: pd.DataFrame) -> dict[int, list[int]]:
    return {int(i): [int(x) for x in near] for i, near in zip(rows["id"], rows["near"], strict=True)}


def traverse(g: Graph, visitor: Callable[[dict], Visitor], schema: str, kind: str = "weak", control: str | Control = "dfs", root: int | None = None) -> DataFrame:
    """The rows of visitor(neighbours).result() after a walk of the whole graph, in one task."""
    if root is not None:
        g.check_vertex(root)
    ship(g.spark)
    order = CONTROLS[control]() if isinstance(control, str) else control
    names = [x.split()[0] for x in schema.split(",")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near = _held(rows)
        return pd.DataFrame(walk(near, visitor(near), order, root), columns=names)

    return adjacency(g, kind).withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, schema)


def forest(g: Graph, kind: str = "weak", root: int | None = None, control: str = "dfs") -> DataFrame:
    """FOREST: a spanning forest; each tree starts at its smallest vertex left, the given root first.

    pre and post count through the whole forest, trees in the order of their roots. Children ascend.
    """
    if root is not None:
        g.check_vertex(root)
    comps = stored(weak(g), "forest-comps")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near = _held(rows)
        found = walk(near, Tree(), CONTROLS[control](), root if root in near else None)
        out = pd.DataFrame(found, columns=["root", "id", "parent", "depth", "pre", "post", "child_idx"])
        out["parent"] = out["parent"].astype("Int64")
        return out

    trees = stored(adjacency(g, kind).join(comps, "id").groupBy("comp").applyInPandas(run, FOREST), "forest")
    first = F.when(F.col("root") == root, 0).otherwise(1) if root is not None else F.lit(1)
    sizes = trees.groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("late", first)
    before = running(sizes, ["late", "root"], "n").select("root", (F.col("total") - F.col("n")).alias("before"))
    return trees.join(before, "root").select("root", "id", "parent", "depth", (F.col("pre") + F.col("before")).alias("pre"), (F.col("post") + F.col("before")).alias("post"), "child_idx")


def preorder(f: DataFrame) -> DataFrame:
    return f.select("pre", "id").orderBy("pre")


def postorder(f: DataFrame) -> DataFrame:
    return f.select("post", "id").orderBy("post")


def to_partition(f: DataFrame) -> DataFrame:
    """id, part: the root of the vertex's tree."""
    return f.select("id", F.col("root").alias("part"))


def to_graph(f: DataFrame, name: str = "forest") -> Graph:
    """The forest's own edges, parent to child."""
    return Graph(f.select("id"), f.filter("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst")), name)


def dump(f: DataFrame) -> DataFrame:
    """pre, line: ids indented by depth."""
    return f.select("pre", F.concat(F.expr("repeat('  ', depth)"), F.col("id").cast("string")).alias("line")).orderBy("pre")


def walk_forest(f: DataFrame, visitor: Callable[[dict], Visitor], schema: str) -> DataFrame:
    """Walks a forest that is there already, children by child_idx, with a visitor."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pre")
        near: dict[int, list[int]] = {int(i): [] for i in rows["id"]}
        for i, parent in zip(rows["id"], rows["parent"], strict=True):
            if not pd.isna(parent):
                near[int(parent)].append(int(i))
        roots = [int(i) for i, p in zip(rows["id"], rows["parent"], strict=True) if pd.isna(p)]
        return pd.DataFrame(walk(near, visitor(near), Given(roots)), columns=names)

    return f.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, schema)
