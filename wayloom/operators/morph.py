"""Structural hashes, isomorphism and homeomorphism.

Hashes are SHA-256 of canonical strings, the same in every run: equal for isomorphic graphs. All hashes
are computed for a corpus of graphs at once, tables (graph_id, id) and (graph_id, src, dst).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions import match
from wayloom.graph import Graph
from wayloom.operators.contract import linears
from wayloom.operators.degree import histogram3

#: isomorphism() brings both graphs to the driver after the hashes agree.
MAX_MATCH = 100_000


def as_corpus(g: Graph, graph_id: str = "g") -> tuple[DataFrame, DataFrame]:
    k = F.lit(graph_id).alias("graph_id")
    return g.vertices.select(k, "id"), g.edges.select(k, "src", "dst")


def corpus_triples(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, id, and the triple of loops-apart degrees as a string key."""
    n = lambda c, i, s, o: F.struct(c.alias("id"), F.lit(i).alias("i"), F.lit(s).alias("s"), F.lit(o).alias("o"))
    src, dst = F.col("src"), F.col("dst")
    ends = edges.select("graph_id", F.explode(F.when(src == dst, F.array(n(src, 0, 1, 0))).otherwise(F.array(n(src, 0, 0, 1), n(dst, 1, 0, 0)))).alias("x")).select("graph_id", "x.*")
    rows = ends.union(vertices.select("graph_id", "id", F.lit(0), F.lit(0), F.lit(0)))
    return rows.groupBy("graph_id", "id").agg(F.concat_ws(",", F.sum("i"), F.sum("s"), F.sum("o")).alias("k"))


def _histogram(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The counts of a value within keys as one string 'value:count|...', sorted by value."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct(value, "n"))), lambda x: F.concat(x[value], F.lit(":"), x["n"].cast("string")))).alias(name))


def corpus_keys(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, nvert, nedge, hop0, hop1: what isomorphic graphs have in common."""
    t = corpus_triples(vertices, edges)
    near = edges.filter("src <> dst")
    ins = near.join(t.select("graph_id", F.col("id").alias("src"), "k"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("id"), "k")
    outs = near.join(t.select("graph_id", F.col("id").alias("dst"), "k"), ["graph_id", "dst"]).select("graph_id", F.col("src").alias("id"), "k")
    a, b = _histogram(ins, ["graph_id", "id"], "k", "a"), _histogram(outs, ["graph_id", "id"], "k", "b")
    own = t.join(a, ["graph_id", "id"], "left").join(b, ["graph_id", "id"], "left")
    own = own.select("graph_id", "k", F.sha2(F.concat_ws(";", F.coalesce("a", F.lit("")), "k", F.coalesce("b", F.lit(""))), 256).alias("h"))
    h0 = _histogram(own, ["graph_id"], "k", "s0")
    # of the vertices' hashes the sums of their eight words: partial sums before the shuffle, no row holds them all
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string") for i in range(8)]
    h1 = own.groupBy("graph_id").agg(F.concat_ws(",", *words).alias("s1"))
    nv = vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nvert"))
    ne = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nedge"))
    all_of = nv.join(ne, "graph_id", "left").join(h0, "graph_id").join(h1, "graph_id")
    return all_of.select("graph_id", "nvert", F.coalesce("nedge", F.lit(0).cast("long")).alias("nedge"), F.sha2("s0", 256).alias("hop0"), F.sha2("s1", 256).alias("hop1"))


def gkey(g: Graph) -> DataFrame:
    return corpus_keys(*as_corpus(g)).drop("graph_id")


def graph_hash(g: Graph, hops: int = 0) -> str:
    """hops 0: of the degree histogram; hops 1: of the vertices with their neighbours' degrees. An empty graph hashes the empty string."""
    if hops not in (0, 1):
        raise ValueError("hops must be 0 or 1")
    row = gkey(g).first()
    return row[f"hop{hops}"] if row else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def isomorphism(g1: Graph, g2: Graph, budget: int = 1_000_000) -> tuple[str, dict[int, int] | None]:
    """not_isomorphic, undecided or isomorphic with a mapping. Counts and hashes reject first; budget bounds the search."""
    if g1.n_vertices() != g2.n_vertices() or g1.n_edges() != g2.n_edges():
        return match.DIFFERENT, None
    if gkey(g1).first() != gkey(g2).first():
        return match.DIFFERENT, None
    if g1.n_vertices() + g1.n_edges() > MAX_MATCH:
        return match.UNDECIDED, None
    (v1, e1), (v2, e2) = g1.to_sets(), g2.to_sets()
    return match.isomorphism(v1, e1, v2, e2, budget)


def homeomorphic(g1: Graph, g2: Graph, budget: int = 1_000_000) -> str:
    """Isomorphism of the graphs without their linear vertices; bins that contraction can empty don't reject."""
    rest = [set(map(tuple, histogram3(g).filter("not (n_self = 0 and n_in = n_out and n_in in (1, 2))").collect())) for g in (g1, g2)]
    if rest[0] != rest[1]:
        return match.DIFFERENT
    return isomorphism(linears(g1), linears(g2), budget)[0]
