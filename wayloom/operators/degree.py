"""Degrees, neighbourhoods, vertex classes and histograms."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.graph import Graph

SELECTORS = ("in", "out", "in_out", "in_self_out")


def check(selector: str) -> None:
    if selector not in SELECTORS:
        raise ValueError(f"no such selector: {selector}")


def triples(g: Graph) -> DataFrame:
    """id, n_in, n_self, n_out (loops apart), in one shuffle whose sums are made before it."""
    n = lambda c, i, s, o: F.struct(c.alias("id"), F.lit(i).alias("i"), F.lit(s).alias("s"), F.lit(o).alias("o"))
    src, dst = F.col("src"), F.col("dst")
    ends = g.edges.select(F.explode(F.when(src == dst, F.array(n(src, 0, 1, 0))).otherwise(F.array(n(src, 0, 0, 1), n(dst, 1, 0, 0)))).alias("x")).select("x.*")
    rows = ends.union(g.vertices.select("id", F.lit(0), F.lit(0), F.lit(0)))
    return rows.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("s").alias("n_self"), F.sum("o").alias("n_out"))


def degrees(g: Graph, selector: str = "in_self_out") -> DataFrame:
    """The degree of every vertex: n (in, out), n_in and n_out with loops in both, or the triple."""
    check(selector)
    t = triples(g)
    if selector == "in_self_out":
        return t
    both = t.select("id", (F.col("n_in") + F.col("n_self")).alias("n_in"), (F.col("n_out") + F.col("n_self")).alias("n_out"))
    return both if selector == "in_out" else both.select("id", F.col(f"n_{selector}").alias("n"))


def degree(g: Graph, i: int, selector: str = "out") -> Any:
    """The degree of one vertex: a number, a pair or a triple."""
    check(selector)
    g.check_vertex(i)
    src, dst = F.col("src"), F.col("dst")
    near = g.edges.filter((src == i) | (dst == i))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
    a, s, b = near.agg(n((dst == i) & (src != i)), n(src == dst), n((src == i) & (dst != i))).first()
    return {"in": a + s, "out": b + s, "in_out": (a + s, b + s), "in_self_out": (a, s, b)}[selector]


def neighbourhoods(g: Graph) -> DataFrame:
    """id, ins, loop, outs: sorted neighbours of every vertex, the vertex itself apart. A row is as large as a vertex's degree."""
    src, dst = F.col("src"), F.col("dst")
    ends = g.edges.select(F.explode(F.array(F.struct(src.alias("id"), dst.alias("o"), F.lit(None).cast("long").alias("i")), F.struct(dst.alias("id"), F.lit(None).cast("long").alias("o"), src.alias("i")))).alias("x")).select("x.*")
    rows = ends.union(g.vertices.select("id", F.lit(None), F.lit(None)))
    got = rows.groupBy("id").agg(F.array_sort(F.collect_set("i")).alias("a"), F.array_sort(F.collect_set("o")).alias("b"))
    return got.select("id", F.array_remove("a", F.col("id")).alias("ins"), F.array_contains("b", F.col("id")).alias("loop"), F.array_remove("b", F.col("id")).alias("outs"))


def neighbours(g: Graph, i: int, selector: str = "out") -> Any:
    """The neighbours of one vertex: a set, a pair or a triple of sets, loops as for degrees."""
    check(selector)
    g.check_vertex(i)
    pairs = [(r[0], r[1]) for r in g.edges.filter((F.col("src") == i) | (F.col("dst") == i)).collect()]
    ins, outs = {s for s, d in pairs if d == i}, {d for s, d in pairs if s == i}
    return {"in": ins, "out": outs, "in_out": (ins, outs), "in_self_out": (ins - {i}, ins & {i}, outs - {i})}[selector]


def vclass() -> Column:
    """The class of a vertex by its triple; the first rule that fits counts."""
    i, s, o = F.col("n_in"), F.col("n_self"), F.col("n_out")
    rules = [
        ((i == 0) & (s == 0) & (o == 0), "isolated"),
        ((s == 0) & (o == 0), "sink"),
        ((i == 0) & (s == 0), "source"),
        ((i == 1) & (s == 0) & (o == 1), "linear"),
        ((i == 0) & (s == 1) & (o == 0), "self_isolated"),
        ((s == 1) & (o == 0), "self_sink"),
        ((i == 0) & (s == 1), "self_source"),
        ((i == 1) & (s == 1) & (o == 1), "self_linear"),
    ]
    out = F.lit("complex")
    for test, name in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def classes(g: Graph) -> DataFrame:
    return triples(g).select("id", "n_in", "n_self", "n_out", vclass().alias("vclass"))


def classify(g: Graph, i: int) -> str:
    return g.spark.createDataFrame([degree(g, i, "in_self_out")], "n_in long, n_self long, n_out long").select(vclass()).first()[0]


def isolated(g: Graph) -> DataFrame:
    return triples(g).filter("n_in + n_self + n_out = 0").select("id")


def is_isolated(g: Graph, i: int) -> bool:
    """True also for a vertex that has only a loop."""
    return classify(g, i) in ("isolated", "self_isolated")


def sources(g: Graph) -> DataFrame:
    return classes(g).filter("vclass in ('source', 'self_source')").select("id")


def sinks(g: Graph) -> DataFrame:
    return classes(g).filter("vclass in ('sink', 'self_sink')").select("id")


def histogram1(g: Graph, selector: str = "out") -> DataFrame:
    """deg, n. in_out counts a loop twice, in_self_out not at all."""
    check(selector)
    deg = {"in": "n_in + n_self", "out": "n_out + n_self", "in_out": "n_in + n_out + 2 * n_self", "in_self_out": "n_in + n_out"}[selector]
    return triples(g).groupBy(F.expr(deg).alias("deg")).agg(F.count(F.lit(1)).alias("n"))


def histogram2(g: Graph, loops: bool = True) -> DataFrame:
    add = "n_self" if loops else "0"
    return triples(g).groupBy(F.expr(f"n_in + {add}").alias("n_in"), F.expr(f"n_out + {add}").alias("n_out")).agg(F.count(F.lit(1)).alias("n"))


def histogram3(g: Graph) -> DataFrame:
    return triples(g).groupBy("n_in", "n_self", "n_out").agg(F.count(F.lit(1)).alias("n"))


def frontier_sizes(fronts: DataFrame) -> DataFrame:
    return fronts.groupBy("hop").agg(F.count(F.lit(1)).alias("n"))


def dense(histogram: DataFrame) -> list[int]:
    """Counts by degree from 0 to the largest, zeros filled in."""
    got = {r["deg"]: r["n"] for r in histogram.collect()}
    return [got.get(k, 0) for k in range(max(got, default=-1) + 1)]


def homogeneous(histogram: DataFrame) -> Any:
    """The one degree (or tuple of degrees) that all vertices have; None if there are several or none."""
    rows = histogram.drop("n").distinct().limit(2).collect()
    return None if len(rows) != 1 else rows[0][0] if len(rows[0]) == 1 else tuple(rows[0])
