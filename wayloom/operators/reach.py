"""Reachability and hop frontiers: breadth-first search, a join for each level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions.storage import counted, stored
from wayloom.graph import Graph
from wayloom.operators.degree import check

#: A frontier of at most so many vertices is broadcast to the edges; a larger one is joined by a shuffle.
BROADCAST = 200_000


def oriented(g: Graph, selector: str) -> DataFrame:
    """Steps (src, dst) in the direction of the selector; both directions for in_out."""
    back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": g.edges, "in": back}.get(selector, g.edges.union(back))


def levels(steps: DataFrame, start: DataFrame, nhop: int | None = None) -> DataFrame:
    """hop, id of all vertices within nhop steps of those in start (id). A level is written before the next begins."""
    spark = steps.sparkSession
    steps = stored(steps.select("src", "dst"), "steps")
    front, size, path = counted(start.select(F.lit(0).alias("hop"), "id").distinct(), "level")
    seen, paths, hop = front, [path], 0
    while size and (nhop is None or hop < nhop):
        hop += 1
        at = front.select(F.col("id").alias("src"))
        met = steps.join(F.broadcast(at) if size <= BROADCAST else at, "src").select(F.col("dst").alias("id")).distinct()
        front, size, path = counted(met.join(seen, "id", "left_anti").select(F.lit(hop).alias("hop"), "id"), "level")
        if size:
            paths.append(path)
            seen = spark.read.schema(front.schema).parquet(*paths)
    return seen


def frontiers(g: Graph, i: int, selector: str = "out", nhop: int | None = None) -> DataFrame:
    """hop, id. in_out walks edges in both directions."""
    check(selector)
    g.check_vertex(i)
    return levels(oriented(g, selector), g.vertices.filter(F.col("id") == i), nhop)


def reachable(g: Graph, i: int, selector: str = "out", nhop: int | None = None) -> DataFrame:
    """id of all vertices within nhop hops, i included. in_out is the union of both directed searches."""
    check(selector)
    g.check_vertex(i)
    start = g.vertices.filter(F.col("id") == i)
    if selector in ("in", "out"):
        return levels(oriented(g, selector), start, nhop).select("id")
    return levels(oriented(g, "out"), start, nhop).union(levels(oriented(g, "in"), start, nhop)).select("id").distinct()
