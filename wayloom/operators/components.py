"""Weak and strong components, condensation, partition index, and the tests that rest on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions.storage import counted, stored, summed
from wayloom.graph import Graph
from wayloom.operators.degree import triples
from wayloom.operators.reach import levels, oriented

ROUNDS = 100
SPLIT = 1_000_000


def stars(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component for every node of links (src, dst).

    Alternating large and small stars: a node hangs its larger neighbours on the smallest, then its smaller
    ones; logarithmically many rounds. Minima are taken before the shuffle, no neighbourhood is gathered.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    edges, n, _ = counted(links.select(high.alias("u"), low.alias("v")).filter("u <> v").distinct(), "stars")
    # of many links, minima are written first: then a node with very many links can be split in the join
    apart = (lambda x: stored(x, "minima")) if n > SPLIT else (lambda x: x)
    now = None
    for _ in range(ROUNDS):
        if not n:
            break
        both = edges.union(edges.select("v", "u"))
        least = apart(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = apart(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, after = summed(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        if after == now:
            break
        now = after
    else:
        raise RuntimeError(f"components not settled in {ROUNDS} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(found.select("root", "root")).distinct()


def weak(g: Graph) -> DataFrame:
    """id, comp: the smallest vertex of the weak component. The links' roots are written once for a graph."""
    roots = g.held("weak", lambda: stored(stars(g.edges), "roots"))
    return g.vertices.join(roots, g.vertices.id == roots.node, "left").select("id", F.coalesce("root", "id").alias("comp"))


class _Rest:
    """The vertices and edges that no strong component has taken yet, and the components found."""

    def __init__(self, g: Graph):
        self.edges, self.n_edges, _ = counted(g.edges.filter("src <> dst"), "scc-edges")
        self.ids, self.left, _ = counted(g.vertices.select("id"), "scc-ids")
        self.found = [g.vertices.limit(0).select("id", F.col("id").alias("comp"))]

    def take(self, comps: DataFrame, edges: bool = True) -> None:
        """comps: (id, comp), whole components of the rest. edges: whether their edges are still there."""
        got, n, _ = counted(comps, "scc-found")
        if n:
            self.found.append(got)
            gone = got.select("id")
            self.ids, self.left, _ = counted(self.ids.join(gone, "id", "left_anti"), "scc-ids")
            if edges:
                s, d = gone.withColumnRenamed("id", "src"), gone.withColumnRenamed("id", "dst")
                self.edges, self.n_edges, _ = counted(self.edges.join(s, "src", "left_anti").join(d, "dst", "left_anti").select("src", "dst"), "scc-edges")

    def trim(self) -> None:
        """Edges from vertices without a way in, or to vertices without a way out, go until none is left of these.

        The vertices that lose all their edges so are components of their own.
        """
        while self.n_edges:
            ahead, back = self.edges.select(F.col("dst").alias("src")).distinct(), self.edges.select(F.col("src").alias("dst")).distinct()
            edges, n, _ = counted(self.edges.join(ahead, "src", "left_semi").join(back, "dst", "left_semi").select("src", "dst"), "scc-edges")
            if n == self.n_edges:
                break
            self.edges, self.n_edges = edges, n
        inner = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        self.take(self.ids.join(inner, "id", "left_anti").select("id", F.col("id").alias("comp")), edges=False)

    def pivot(self) -> None:
        """The component of the vertex with most ways through it: the common part of its two reaches."""
        ways = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
        best = ways.groupBy("id").agg((F.sum("o") * F.sum("i")).alias("w")).orderBy(F.desc("w"), "id").limit(1).select("id")
        start = stored(best, "scc-pivot")
        ahead = levels(self.edges, start).select("id")
        behind = levels(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start).select("id")
        both = stored(ahead.intersect(behind), "scc-both")
        self.take(both.crossJoin(both.agg(F.min("id").alias("comp"))))

    def colour(self) -> None:
        """Each vertex gets the largest id that reaches it; the vertices of a colour that reach its owner back are one component."""
        colours = stored(self.ids.select("id", F.col("id").alias("c")), "scc-colour")
        while True:
            c = colours.withColumnRenamed("id", "src")
            met = self.edges.join(c, "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("m"))
            step = stored(colours.join(met, "id", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("up")), "scc-colour")
            colours = step.drop("up")
            if not step.filter("up").head(1):
                break
        a, b = colours.select(F.col("id").alias("src"), F.col("c").alias("cs")), colours.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        inside = stored(self.edges.join(a, "src").join(b, "dst").filter("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-inside")
        back = levels(inside, colours.filter("id = c").select("id")).select("id")
        own = colours.join(back, "id", "left_semi")
        low = own.groupBy("c").agg(F.min("id").alias("comp"))
        self.take(own.join(low, "c").select("id", "comp"))


def strong(g: Graph) -> DataFrame:
    """id, comp: the smallest vertex of the strong component. Trimming, one pivot, then colours, until nothing is left."""
    rest = _Rest(g)
    rest.trim()
    if rest.left:
        rest.pivot()
        rest.trim()
    while rest.left:
        rest.colour()
        rest.trim()
    out = rest.found[0]
    for x in rest.found[1:]:
        out = out.union(x)
    return stored(out, "scc")


def components(g: Graph, kind: str = "weak") -> DataFrame:
    if kind not in ("weak", "strong"):
        raise ValueError(f"no such connectivity: {kind}")
    return weak(g) if kind == "weak" else strong(g)


def n_components(g: Graph, kind: str = "weak") -> int:
    return components(g, kind).filter("id = comp").count()


def is_connected(g: Graph, kind: str = "weak") -> bool:
    n = g.n_vertices()
    if n < 2 or kind == "weak":
        return n == 1 or n > 1 and n_components(g, kind) == 1
    # every vertex has a way in and a way out, and one of them reaches all both ways
    t = triples(g)
    if t.filter("n_in = 0 or n_out = 0").head(1):
        return False
    start = g.vertices.filter(F.col("id") == g.some_vertex())
    return all(levels(oriented(g, way), start).count() == n for way in ("out", "in"))


def condensation(g: Graph) -> Graph:
    """A vertex for each strong component, by its smallest id, and the edges between components."""
    comps = strong(g)
    a, b = comps.select(F.col("id").alias("src"), F.col("comp").alias("s")), comps.select(F.col("id").alias("dst"), F.col("comp").alias("d"))
    edges = g.edges.join(a, "src").join(b, "dst").filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()
    return Graph(comps.filter("id = comp").select("id"), edges, f"{g.name}_condensation")


def partition_index(g: Graph, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parts (id, part) to (id, part) of every vertex and (src, dst, src_part, dst_part) of every edge, null where missing."""
    p = parts.select("id", "part")
    a, b = p.select(F.col("id").alias("src"), F.col("part").alias("src_part")), p.select(F.col("id").alias("dst"), F.col("part").alias("dst_part"))
    return g.vertices.join(p, "id", "left"), g.edges.join(a, "src", "left").join(b, "dst", "left").select("src", "dst", "src_part", "dst_part")


def _starts(g: Graph) -> list[int]:
    """Vertices without a way in, loops aside; two at most."""
    return [r[0] for r in triples(g).filter("n_in = 0").select("id").limit(2).collect()]


def is_tree(g: Graph, kind: str = "weak") -> bool:
    """One edge less than vertices and connected; strong: with a root as well."""
    if g.n_edges() != g.n_vertices() - 1 or not is_connected(g, "weak"):
        return False
    return kind == "weak" or len(_starts(g)) == 1


def root(g: Graph) -> int | None:
    """The one vertex without a way in, if it reaches all."""
    starts = _starts(g)
    if len(starts) != 1:
        return None
    met = levels(oriented(g, "out"), g.vertices.filter(F.col("id") == starts[0]))
    return starts[0] if met.count() == g.n_vertices() else None


def is_cyclic(g: Graph, kind: str = "weak") -> bool:
    """weak: an undirected cycle, for which a loop or a pair of opposite edges will do. strong: a directed cycle or a loop."""
    if kind == "weak":
        return g.n_edges() > g.n_vertices() - n_components(g, "weak")
    if g.has_loop():
        return True
    rest = _Rest(g)
    rest.trim()
    return rest.left > 0
