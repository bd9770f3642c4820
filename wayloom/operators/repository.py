"""A repository of graphs, searched up to isomorphism and homeomorphism.

A graph is one row: its vertices and edges as arrays. A map over the rows gives each graph, and each graph without its
linear vertices, its key; only graphs of equal keys are compared, in the order of seq, with the exemplars of the
classes: the first member of each. A graph that no search decides joins as undecided. Many graphs of one key are first
compared in groups of about GROUP, then the groups' exemplars with each other.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import match
from wayloom.functions.storage import ship, stored
from wayloom.graph import Graph
from wayloom.operators.contract import Linking
from wayloom.operators.generate import mask_rows

KEY = ["nvert", "nedge", "hop0", "hop1"]
ROWS = "kind string, graph_id string, seq long, nvert long, nedge long, hop0 string, hop1 string, vs array<long>, es array<struct<src:bigint,dst:bigint>>"
CLASSES = "kind string, exemplar string, member string, undecided boolean"
GROUP = 20_000


def _edges(es) -> list[tuple[int, int]]:
    return [(int(x["src"]), int(x["dst"])) for x in es]


def _listed(values: Iterable[str]) -> str:
    return "|".join(f"{x}:{n}" for x, n in sorted(Counter(values).items()))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def key_of(vertices: list[int], edges: list[tuple[int, int]]) -> tuple[int, int, str, str]:
    """KEY of a graph in memory: the same hashes as morph.gkey's."""
    ins, outs = match.neighbours(vertices, edges)
    k = {i: f"{len(ins[i] - {i})},{int(i in ins[i])},{len(outs[i] - {i})}" for i in vertices}
    h = [_sha(";".join([_listed(k[x] for x in ins[i] if x != i), k[i], _listed(k[x] for x in outs[i] if x != i)])) for i in vertices]
    words = (str(sum(int(x[8 * i : 8 * i + 8], 16) for x in h)) for i in range(8))
    return len(vertices), len(edges), _sha(_listed(k.values())), _sha(",".join(words))


def described(graphs: DataFrame) -> DataFrame:
    """graphs (graph_id, seq, vs, es) to ROWS, stored: two rows for each, kind iso as it is, homeo without its linear vertices."""
    ship(graphs.sparkSession)

    def run(batches):
        for b in batches:
            out = []
            for gid, seq, vs, es in b[["graph_id", "seq", "vs", "es"]].itertuples(index=False):
                v, e = [int(x) for x in vs], _edges(es)
                held = Linking(v, e)
                held.sweep()
                left = held.rows()
                for kind, v1, e1 in (("iso", v, e), ("homeo", sorted(i for i, d in left if d is None), sorted(x for x in left if x[1] is not None))):
                    out.append((kind, gid, seq, *key_of(v1, e1), v1, [{"src": s, "dst": d} for s, d in e1]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ROWS.split(", ")])

    return stored(graphs.select("graph_id", "seq", "vs", "es").mapInPandas(run, ROWS), "graphs")


def packed(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices (graph_id, seq, id) and edges (graph_id, src, dst) to a row for each graph."""
    vs = vertices.groupBy("graph_id").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list("id")).alias("vs"))
    es = edges.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("es"))
    return vs.join(es, "graph_id", "left").withColumn("es", F.coalesce("es", F.expr("cast(array() as array<struct<src:bigint,dst:bigint>>)")))


def _matched(rows: DataFrame, by: list[str], budget: int) -> DataFrame:
    """CLASSES of the rows (ROWS, known) group by group. Known rows are exemplars of different classes already."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out, exemplars = [], []
        for kind, gid, known, vs, es in group.sort_values(["seq", "graph_id"])[["kind", "graph_id", "known", "vs", "es"]].itertuples(index=False):
            v, e, placed = [int(x) for x in vs], _edges(es), False
            for name, ev, ee in exemplars if not known else ():
                verdict, _ = match.isomorphism(ev, ee, v, e, budget)
                if verdict != match.DIFFERENT:
                    out.append((kind, name, gid, verdict == match.UNDECIDED))
                    placed = True
                    if verdict == match.SAME:
                        break
            if not placed:
                exemplars.append((gid, v, e))
                if not known:
                    out.append((kind, gid, gid, False))
        return pd.DataFrame(out, columns=["kind", "exemplar", "member", "undecided"])

    return rows.groupBy(*by).applyInPandas(run, CLASSES)


def _classes(rows: DataFrame, budget: int) -> DataFrame:
    """CLASSES of the rows that aren't known, stored."""
    sizes = rows.groupBy("kind", *KEY).agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    if sizes.agg(F.max("groups")).first()[0] in (None, 1):
        return stored(_matched(rows, ["kind", *KEY], budget), "classes")
    # exemplars of groups first; known ones wait for the second round
    dealt = rows.join(sizes, ["kind", *KEY]).withColumn("salt", F.pmod(F.xxhash64("graph_id"), F.col("groups")))
    local = stored(_matched(dealt.filter("not known"), ["kind", *KEY, "salt"], budget), "classes")
    first = rows.join(local.select("kind", F.col("exemplar").alias("graph_id")).distinct(), ["kind", "graph_id"], "left_semi")
    then = stored(_matched(first.unionByName(rows.filter("known")), ["kind", *KEY], budget), "classes")
    up = then.select("kind", F.col("member").alias("exemplar"), F.col("exemplar").alias("top"), F.col("undecided").alias("doubt"))
    return local.join(up, ["kind", "exemplar"]).select("kind", F.col("top").alias("exemplar"), "member", (F.col("undecided") | F.col("doubt")).alias("undecided"))


@dataclass(frozen=True)
class Repository:
    graphs: DataFrame  # ROWS
    classes: DataFrame  # CLASSES
    budget: int = 1_000_000

    @staticmethod
    def of(graphs: DataFrame, budget: int = 1_000_000) -> Repository:
        """graphs (graph_id, seq, vs, es), ids all different. Every graph has a vertex."""
        rows = described(graphs)
        return Repository(rows, _classes(rows.withColumn("known", F.lit(False)), budget), budget)

    @staticmethod
    def new(spark: SparkSession) -> Repository:
        return Repository(spark.createDataFrame([], ROWS), spark.createDataFrame([], CLASSES))

    def add(self, *graphs: Graph) -> Repository:
        """Adds graphs under their names, after those that are there. Only classes of the new graphs' keys are searched again."""
        if not graphs:
            return self
        names = [g.name for g in graphs]
        there = self.graphs.filter(F.col("graph_id").isin(names)).select("graph_id").first()
        if there or len(set(names)) < len(names):
            raise ValueError(f"a graph of that name is there already: {there[0] if there else names}")
        last = self.graphs.agg(F.max("seq")).first()[0]
        at = 0 if last is None else last + 1
        v = e = None
        for k, g in enumerate(graphs):
            own = g.vertices.select(F.lit(g.name).alias("graph_id"), F.lit(at + k).cast("long").alias("seq"), "id")
            links = g.edges.select(F.lit(g.name).alias("graph_id"), "src", "dst")
            v, e = (own, links) if v is None else (v.union(own), e.union(links))
        rows = described(packed(v, e))
        firsts = self.classes.select("kind", F.col("exemplar").alias("graph_id")).distinct()
        touched = self.graphs.join(F.broadcast(rows.select("kind", *KEY).distinct()), ["kind", *KEY], "left_semi").join(firsts, ["kind", "graph_id"], "left_semi")
        found = _classes(touched.withColumn("known", F.lit(True)).unionByName(rows.withColumn("known", F.lit(False))), self.budget)
        return Repository(self.graphs.unionByName(rows), self.classes.unionByName(found), self.budget)

    def n_graphs(self) -> int:
        return self.graphs.filter("kind = 'iso'").count()

    def exemplars(self, kind: str = "iso") -> DataFrame:
        return self.classes.filter(F.col("kind") == kind).select(F.col("exemplar").alias("graph_id")).distinct()

    def n_classes(self, kind: str = "iso") -> int:
        return self.exemplars(kind).count()

    def query(self, g: Graph, kind: str = "iso") -> DataFrame:
        """graph_id, undecided of the members of the classes whose exemplar matches g."""
        if kind not in ("iso", "homeo"):
            raise ValueError(f"no such kind: {kind}")
        own = packed(g.vertices.select(F.lit("?").alias("graph_id"), F.lit(0).cast("long").alias("seq"), "id"), g.edges.select(F.lit("?").alias("graph_id"), "src", "dst"))
        asked = described(own).filter(F.col("kind") == kind).select(*KEY, F.col("vs").alias("qv"), F.col("es").alias("qe"))
        pool = self.graphs.filter(F.col("kind") == kind).join(self.exemplars(kind), "graph_id")
        budget = self.budget

        def run(batches):
            for rows in batches:
                verdicts = [match.isomorphism([int(x) for x in a], _edges(b), [int(x) for x in c], _edges(d), budget)[0] for a, b, c, d in zip(rows["vs"], rows["es"], rows["qv"], rows["qe"], strict=True)]
                yield pd.DataFrame({"exemplar": rows["graph_id"], "verdict": verdicts})

        met = pool.join(F.broadcast(asked), KEY).mapInPandas(run, "exemplar string, verdict string").filter(F.col("verdict") != match.DIFFERENT)
        members = self.classes.filter(F.col("kind") == kind).join(met, "exemplar")
        return members.groupBy(F.col("member").alias("graph_id")).agg(F.min(F.col("undecided") | (F.col("verdict") == match.UNDECIDED)).alias("undecided"))


def all_graphs(spark: SparkSession, n: int, connected: bool = True) -> Repository:
    """Every undirected graph on n vertices."""
    return Repository.of(mask_rows(spark, n, connected))
