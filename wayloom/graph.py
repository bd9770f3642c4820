"""Graph: an immutable simple directed graph over two DataFrames, vertices(id) and edges(src, dst)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.functions.elements import Parts, clean_name, parse
from wayloom.functions.ranges import ranged
from wayloom.functions.storage import stored

VERTICES, EDGES = "id long", "src long, dst long"


class Graph:
    """Edges are distinct, loops allowed, and every end of an edge is a vertex. Every operation gives a new graph."""

    def __init__(self, vertices: DataFrame, edges: DataFrame, name: str = "graph"):
        self.vertices, self.edges, self.name = vertices, edges, clean_name(name)
        self._counts: dict[str, int] = {}
        self._held: dict[str, DataFrame] = {}

    # --- construction

    @staticmethod
    def new(spark: SparkSession, name: str = "graph") -> Graph:
        return Graph(spark.createDataFrame([], VERTICES), spark.createDataFrame([], EDGES), name)

    @staticmethod
    def from_frames(edges: DataFrame, vertices: DataFrame | None = None, name: str = "graph") -> Graph:
        """Any edge table (src, dst), with repeats, and further vertices (id)."""
        e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
        v = e.select(F.explode(F.array("src", "dst")).alias("id"))
        if vertices is not None:
            v = v.union(vertices.select(F.col("id").cast("long")))
        return Graph(v.distinct(), e, name)

    @staticmethod
    def build(spark: SparkSession, elements: Any, name: str = "graph") -> Graph:
        return Graph.new(spark, name).add(elements)

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    def _like(self, vertices: DataFrame, edges: DataFrame, name: str | None = None) -> Graph:
        return Graph(vertices, edges, name or self.name)

    def stored(self) -> Graph:
        """The same graph, written to the shared folder."""
        return self._like(stored(self.vertices, "vertices"), stored(self.edges, "edges"))

    def persist(self) -> Graph:
        self.vertices.persist()
        self.edges.persist()
        return self

    def release(self) -> bool:
        self.vertices.unpersist()
        self.edges.unpersist()
        return True

    def held(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A stored table that belongs to this graph, made once."""
        if name not in self._held:
            self._held[name] = make()
        return self._held[name]

    def rename(self, name: str) -> Graph:
        return self._like(self.vertices, self.edges, name)

    def _frames(self, p: Parts) -> tuple[DataFrame, DataFrame]:
        spark = self.spark
        v = spark.createDataFrame([(i,) for i in {*p.lone, *p.heads}], VERTICES)
        for r in p.ranges:
            v = v.union(spark.range(r.start, r.stop, r.step).select("id"))
        return v, spark.createDataFrame(list(dict.fromkeys(p.edges)), EDGES)

    # --- editing

    def add(self, elements: Any) -> Graph:
        """Adds elements; what is there already stays as it is."""
        return self.add_frames(*self._frames(parse(elements)))

    def add_frames(self, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
        e = self.edges if edges is None else self.edges.union(edges.select("src", "dst")).distinct()
        v = self.vertices if vertices is None else self.vertices.union(vertices.select("id"))
        if edges is not None:
            v = v.union(edges.select(F.explode(F.array("src", "dst"))))
        return self._like(v.distinct(), e)

    def delete(self, elements: Any) -> Graph:
        """Takes away vertices with their edges, and edges without their ends; what is missing is passed over."""
        p = parse(elements)
        p.heads.clear()  # an empty adjacency list deletes nothing
        return self.delete_frames(*self._frames(p))

    def delete_frames(self, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
        v, e = self.vertices, self.edges
        if edges is not None:
            e = e.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
        if vertices is not None:
            gone = vertices.select("id")
            v = v.join(gone, "id", "left_anti")
            e = e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        return self._like(v, e)

    # --- access

    def has_vertex(self, i: int) -> bool:
        return bool(self.vertices.filter(F.col("id") == i).head(1))

    def has_edge(self, s: int, d: int) -> bool:
        return bool(self.edges.filter((F.col("src") == s) & (F.col("dst") == d)).head(1))

    def check_vertex(self, i: int) -> None:
        if not self.has_vertex(i):
            raise ValueError(f"no vertex {i} in {self.name}")

    def n_vertices(self) -> int:
        if "v" not in self._counts:
            self._counts["v"] = self.vertices.count()
        return self._counts["v"]

    def n_edges(self) -> int:
        if "e" not in self._counts:
            self._counts["e"] = self.edges.count()
        return self._counts["e"]

    def counts(self) -> DataFrame:
        return self.vertices.agg(F.count(F.lit(1)).alias("nvert")).crossJoin(self.edges.agg(F.count(F.lit(1)).alias("nedge"), F.sum(F.when(F.col("src") == F.col("dst"), 1).otherwise(0)).cast("long").alias("nself")).fillna(0))

    def some_vertex(self) -> int | None:
        """The smallest vertex; None if there is none."""
        return self.vertices.agg(F.min("id")).first()[0]

    def span(self) -> tuple[int, int] | None:
        """The smallest and the largest vertex."""
        lo, hi = self.vertices.agg(F.min("id"), F.max("id")).first()
        return None if lo is None else (lo, hi)

    def leading_range(self) -> tuple[range, DataFrame]:
        """The longest run 1..k of vertices, and the others, ascending. k is found from counts in blocks of ids, without sorting all."""
        block = F.floor((F.col("id") - 1) / 65536)
        full = self.vertices.groupBy(block.alias("b")).agg(F.count(F.lit(1)).alias("n"))
        b = full.filter("n = 65536").withColumn("r", F.row_number().over(Window.orderBy("b")) - 1).filter("b = r").count()
        ids = {r[0] for r in self.vertices.filter((F.col("id") > b * 65536) & (F.col("id") <= (b + 1) * 65536)).collect()}
        k = b * 65536
        while k + 1 in ids:
            k += 1
        return range(1, k + 1), self.vertices.filter(F.col("id") > k).orderBy("id")

    def loops(self) -> DataFrame:
        """id of the vertices with a loop."""
        return self.edges.filter("src = dst").select(F.col("src").alias("id"))

    def n_loops(self) -> int:
        return self.loops().count()

    def has_loop(self) -> bool:
        return bool(self.loops().head(1))

    def opposite(self) -> DataFrame:
        """i < j of the pairs that are linked both ways."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return self.edges.filter("src < dst").join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("i"), F.col("dst").alias("j"))

    def equal(self, other: Graph) -> bool:
        """The same vertices and the same edges; names don't count."""
        if self.n_vertices() != other.n_vertices() or self.n_edges() != other.n_edges():
            return False
        return not self.edges.join(other.edges, ["src", "dst"], "left_anti").head(1) and not self.vertices.join(other.vertices, "id", "left_anti").head(1)

    # --- whole-graph rewriting

    def transpose(self) -> Graph:
        return self._like(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), f"{self.name}_transpose")

    def relabel(self, how: dict[int, int] | DataFrame | Callable[[Column], Column]) -> Graph:
        """New ids by a map, a table (old, new) or an expression of the old id. Ids that fall together merge; an id without a new one is an error."""
        if callable(how):
            v = self.vertices.select(how(F.col("id")).cast("long").alias("id")).distinct()
            return self._like(v, self.edges.select(how(F.col("src")).cast("long").alias("src"), how(F.col("dst")).cast("long").alias("dst")).distinct())
        table = self.spark.createDataFrame(list(how.items()), "old long, new long") if isinstance(how, dict) else how.select("old", "new")
        lost = self.vertices.join(table, self.vertices.id == table.old, "left_anti").head(1)
        if lost:
            raise ValueError(f"no new id for vertex {lost[0][0]}")
        v = self.vertices.join(table, self.vertices.id == table.old).select(F.col("new").alias("id")).distinct()
        a, b = table.select(F.col("old").alias("src"), F.col("new").alias("s")), table.select(F.col("old").alias("dst"), F.col("new").alias("d"))
        return self._like(v, self.edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct())

    def next_ids(self) -> DataFrame:
        """(old, new): each id's next higher one, the largest's the smallest. Ranges of ids are sorted apart; only their first ids meet in one task."""
        ids = ranged(self.vertices.select("id"), ["id"], "rotate")
        first = ids.groupBy("part").agg(F.min("id").alias("first"))
        after = first.select("part", F.lead("first").over(Window.orderBy("first")).alias("after"), F.min("first").over(Window.partitionBy()).alias("low"))
        rows = ids.select("part", "id", F.lead("id").over(Window.partitionBy("part").orderBy("id")).alias("next")).join(F.broadcast(after), "part")
        return rows.select(F.col("id").alias("old"), F.coalesce("next", "after", "low").alias("new"))

    def rotate(self) -> Graph:
        return self.relabel(stored(self.next_ids(), "next-ids"))

    def join(self, other: Graph, how: str = "merge") -> Graph:
        """merge: the union. disjoint: other's ids are shifted first, if the ranges of ids overlap."""
        if how == "disjoint":
            mine, theirs = self.span(), other.span()
            if mine and theirs and mine[0] <= theirs[1] and theirs[0] <= mine[1]:
                shift = mine[1] - theirs[0] + 1
                other = other.relabel(lambda i: i + shift)
        elif how != "merge":
            raise ValueError(f"no such join: {how}")
        return self._like(self.vertices.union(other.vertices).distinct(), self.edges.union(other.edges).distinct())

    # --- for small graphs and tests

    def to_sets(self) -> tuple[set[int], set[tuple[int, int]]]:
        return {r[0] for r in self.vertices.collect()}, {(r[0], r[1]) for r in self.edges.collect()}

    @staticmethod
    def from_pairs(spark: SparkSession, pairs: Iterable[tuple[int, int]], name: str = "graph") -> Graph:
        return Graph.build(spark, list(pairs), name)
