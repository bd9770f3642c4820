"""The named graph queries over the test tables, with their oracle SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.storage import new_path, put_text
from wayloom.functions.walk import DepthFirst, Order, Visitor
from wayloom.graph import Graph
from wayloom.operators import components, contract, degree, generate, morph, reach, repository, traverse
from wayloom.sources import adj, deps, dot, tables
from wayloom.sources.dot_text import ALIAS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def graph(name: str, sql: str | None = None, keep: bool = False):
    """Registers f(graph) as a query over a derived graph; sql may use e(src, dst), v(id) and t(id, n_in, n_self, n_out).

    keep: the graph is written first, for queries that read it again and again.
    """

    def add(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        register(f"q_{f.__name__}", name, f, sql, keep)
        return f

    return add


def register(q: str, name: str, f: Callable[[Graph], DataFrame], sql: str | None, keep: bool = False) -> None:
    QUERIES[q] = lambda spark, d: f(tables.GRAPHS[name](spark, d).stored() if keep else tables.GRAPHS[name](spark, d))
    if sql is not None:
        ORACLE[q] = with_graph(name, sql)


def with_graph(name: str, sql: str) -> str:
    """The SQL after the graph's relations; v of the event chain has events without a next one too."""
    lone = " UNION SELECT event_id + 1 FROM events" if name == "eventchain" else ""
    recursive = "WITH RECURSIVE" if sql.lstrip().startswith(", RECURSIVE") else "WITH"
    sql = sql.replace(", RECURSIVE", ",", 1)
    return f"""{recursive} e AS ({tables.SQL[name]}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e{lone}),
t AS (SELECT id, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(s) AS BIGINT) AS n_self, CAST(sum(o) AS BIGINT) AS n_out FROM
  (SELECT id, 0 AS i, 0 AS s, 0 AS o FROM v UNION ALL SELECT src, 0, 0, 1 FROM e WHERE src <> dst UNION ALL SELECT dst, 1, 0, 0 FROM e WHERE src <> dst UNION ALL SELECT src, 0, 1, 0 FROM e WHERE src = dst) GROUP BY id)
{sql}"""


CLASS = """CASE WHEN n_in = 0 AND n_self = 0 AND n_out = 0 THEN 'isolated' WHEN n_self = 0 AND n_out = 0 THEN 'sink' WHEN n_in = 0 AND n_self = 0 THEN 'source'
WHEN n_in = 1 AND n_self = 0 AND n_out = 1 THEN 'linear' WHEN n_in = 0 AND n_self = 1 AND n_out = 0 THEN 'self_isolated' WHEN n_self = 1 AND n_out = 0 THEN 'self_sink'
WHEN n_in = 0 AND n_self = 1 THEN 'self_source' WHEN n_in = 1 AND n_self = 1 AND n_out = 1 THEN 'self_linear' ELSE 'complex' END"""


def text_of(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",")


# --- elements, degrees, classes


@graph("partchain", "SELECT id FROM v")
def vertices(g):
    return g.vertices


@graph("partchain", "SELECT src, dst FROM e")
def edges(g):
    return g.edges


@graph("partchain", "SELECT (SELECT count(*) FROM v) AS nvert, (SELECT count(*) FROM e) AS nedge, (SELECT count(*) FROM e WHERE src = dst) AS nself")
def counts(g):
    return g.counts()


@graph("partchain", "SELECT min(id) AS low, max(id) AS high FROM v")
def minmax(g):
    return g.spark.createDataFrame([g.span()], "low long, high long")


@graph("nation", "SELECT max(id) AS k, (SELECT count(*) FROM v) - max(id) AS others FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM v) WHERE id = r", keep=True)
def rangelist(g):
    run, others = g.leading_range()
    return others.agg(F.lit(len(run)).cast("long").alias("k"), F.count(F.lit(1)).alias("others"))


@graph("userchain", "SELECT * FROM t")
def deg3(g):
    return degree.triples(g)


@graph("userchain", "SELECT id, n_in + n_self AS n_in, n_out + n_self AS n_out FROM t")
def degree_in_out(g):
    return degree.degrees(g, "in_out")


@graph("userchain", "SELECT id, n_in + n_self AS n FROM t")
def degree_in(g):
    return degree.degrees(g, "in")


@graph("userchain", "SELECT id, n_out + n_self AS n FROM t")
def degree_out(g):
    return degree.degrees(g, "out")


@graph("userchain", f"SELECT t.*, {CLASS} AS vclass FROM t")
def classes(g):
    return degree.classes(g)


@graph("partchain", f"SELECT {CLASS} AS vclass, count(*) AS n FROM t GROUP BY 1")
def class_histo(g):
    return degree.classes(g).groupBy("vclass").agg(F.count(F.lit(1)).alias("n"))


@graph("nation", "SELECT id, coalesce((SELECT string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) FROM e WHERE dst = id AND src <> id), '') AS ins, EXISTS (SELECT 1 FROM e WHERE src = id AND dst = id) AS loop, coalesce((SELECT string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) FROM e WHERE src = id AND dst <> id), '') AS outs FROM v")
def neighbourhood(g):
    return degree.neighbourhoods(g).select("id", text_of("ins").alias("ins"), "loop", text_of("outs").alias("outs"))


@graph("supply", "SELECT id FROM t WHERE n_in = 0 AND n_out > 0")
def sources(g):
    return degree.sources(g)


@graph("supply", "SELECT id FROM t WHERE n_out = 0 AND n_in > 0")
def sinks(g):
    return degree.sinks(g)


@graph("eventchain", "SELECT id FROM t WHERE n_in + n_self + n_out = 0")
def isolated(g):
    return degree.isolated(g)


@graph("nation", "SELECT src AS id FROM e WHERE src = dst")
def selfloops(g):
    return g.loops()


for _selector, _deg in {"in": "n_in + n_self", "out": "n_out + n_self", "in_out": "n_in + n_out + 2 * n_self", "in_self_out": "n_in + n_out"}.items():
    register(f"q_histo1_{_selector}", "partchain", lambda g, s=_selector: degree.histogram1(g, s), f"SELECT {_deg} AS deg, count(*) AS n FROM t GROUP BY 1")


@graph("partchain", "SELECT n_in + n_self AS n_in, n_out + n_self AS n_out, count(*) AS n FROM t GROUP BY 1, 2")
def histo2(g):
    return degree.histogram2(g)


@graph("partchain", "SELECT n_in, n_out, count(*) AS n FROM t GROUP BY 1, 2")
def histo2_no_loops(g):
    return degree.histogram2(g, loops=False)


@graph("partchain", "SELECT n_in, n_self, n_out, count(*) AS n FROM t GROUP BY 1, 2, 3")
def histo3(g):
    return degree.histogram3(g)


# --- editing


@graph("nation", "SELECT dst AS src, src AS dst FROM e")
def transpose(g):
    return g.transpose().edges


@graph("nation", "SELECT * FROM e WHERE src NOT IN (3, 7, 8, 9) AND dst NOT IN (3, 7, 8, 9)")
def delete_vertices(g):
    return g.delete([3, range(7, 10), 999]).edges


@graph("nation", "SELECT * FROM e WHERE NOT (src = 1 AND dst IN (2, 3, 4)) AND NOT (src = 2 AND dst = 5) AND NOT (src = 5 AND dst = 6)")
def delete_edges(g):
    return g.delete([(1, [2, 3, 4]), (2, 5, 6)]).edges


@graph("nation", "SELECT * FROM e UNION SELECT * FROM (VALUES (100, 101), (101, 102), (102, 1), (1, 1)) AS x(src, dst)")
def add_chain(g):
    return g.add((100, 101, 102, 1, 1)).edges


@graph("nation", "SELECT id FROM v UNION SELECT * FROM range(200, 211) UNION SELECT 300 UNION SELECT 301")
def add_vertices(g):
    return g.add([range(200, 211), 300, (301, [])]).vertices


@graph("nation", "SELECT DISTINCT (src + 1) // 2 AS src, (dst + 1) // 2 AS dst FROM e")
def relabel(g):
    return g.relabel(lambda i: F.floor((i + 1) / 2)).edges


@graph("nation", "SELECT src + 10 AS src, dst + 10 AS dst FROM e")
def relabel_table(g):
    return g.relabel(g.vertices.select(F.col("id").alias("old"), (F.col("id") + 10).alias("new"))).edges


@graph("userchain", ", r AS (SELECT id, coalesce(lead(id) OVER (ORDER BY id), min(id) OVER ()) AS n FROM v) SELECT a.n AS src, b.n AS dst FROM e JOIN r a ON src = a.id JOIN r b ON dst = b.id", keep=True)
def rotate(g):
    return g.rotate().edges


@graph("nation", "SELECT * FROM e UNION SELECT src + 5, dst + 5 FROM e")
def join_merge(g):
    return g.join(g.relabel(lambda i: i + 5)).edges


@graph("nation", "SELECT * FROM e UNION SELECT src + (SELECT max(id) - min(id) + 1 FROM v), dst + (SELECT max(id) - min(id) + 1 FROM v) FROM e", keep=True)
def join_disjoint(g):
    return g.join(g, "disjoint").edges


@graph("nation", "SELECT NOT EXISTS (SELECT src, dst FROM e EXCEPT SELECT dst, src FROM (SELECT dst AS src, src AS dst FROM e)) AS same, EXISTS (SELECT 1 FROM v WHERE id = 999) AS other", keep=True)
def equal(g):
    return g.spark.createDataFrame([(g.equal(g.transpose().transpose()), g.equal(g.delete((1, 2)).add(999)))], "same boolean, other boolean")


# --- reach

LOW = "(SELECT min(id) FROM v)"
STEP = {"out": ("src", "dst"), "in": ("dst", "src")}


def reach_sql(way: str, hops: int | None = None) -> str:
    a, b = STEP[way]
    if hops is None:
        return f"r(id) AS (SELECT {LOW} UNION SELECT {b} FROM e JOIN r ON {a} = r.id)"
    return f"r(id, hop) AS (SELECT {LOW}, 0 UNION SELECT {b}, hop + 1 FROM e JOIN r ON {a} = r.id WHERE hop < {hops})"


@graph("partchain", f", RECURSIVE {reach_sql('out')} SELECT id FROM r", keep=True)
def reach_out(g):
    return reach.reachable(g, g.some_vertex(), "out")


@graph("partchain", f", RECURSIVE {reach_sql('in')} SELECT id FROM r", keep=True)
def reach_in(g):
    return reach.reachable(g, g.some_vertex(), "in")


@graph("partchain", f", RECURSIVE {reach_sql('out')}, {reach_sql('in').replace('r(id)', 's(id)').replace('JOIN r ON', 'JOIN s ON').replace('r.id', 's.id')} SELECT id FROM r UNION SELECT id FROM s", keep=True)
def reach_in_out(g):
    return reach.reachable(g, g.some_vertex(), "in_out")


@graph("partchain", f", RECURSIVE {reach_sql('out', 3)} SELECT DISTINCT id FROM r", keep=True)
def reach_3hop(g):
    return reach.reachable(g, g.some_vertex(), "out", 3)


@graph("tree", f", RECURSIVE {reach_sql('out', 10)} SELECT min(hop) AS hop, id FROM r GROUP BY id", keep=True)
def frontiers(g):
    return reach.frontiers(g, 1)


@graph("partchain", f", RECURSIVE b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, hop) AS (SELECT {LOW}, 0 UNION SELECT dst, hop + 1 FROM b JOIN r ON src = r.id WHERE hop < 4) SELECT min(hop) AS hop, id FROM r GROUP BY id", keep=True)
def frontiers_weak(g):
    return reach.frontiers(g, g.some_vertex(), "in_out", 4)


@graph("partchain", f", RECURSIVE {reach_sql('out', 30)}, h AS (SELECT min(hop) AS hop, id FROM r GROUP BY id) SELECT hop, count(*) AS n FROM h GROUP BY hop", keep=True)
def frontier_histo(g):
    return degree.frontier_sizes(reach.frontiers(g, g.some_vertex()))


# --- components

WCC = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), c(id, x) AS (SELECT id, id FROM v UNION SELECT dst, x FROM c JOIN b ON src = c.id WHERE x <= dst), w AS (SELECT id, min(x) AS comp FROM c GROUP BY id)"
SCC = "c(id, x) AS (SELECT id, id FROM v UNION SELECT dst, x FROM c JOIN e ON src = c.id), k AS (SELECT a.id, min(a.x) AS comp FROM c a JOIN c b ON a.id = b.x AND a.x = b.id GROUP BY a.id)"


@graph("partchain", f", RECURSIVE {WCC} SELECT id, comp FROM w", keep=True)
def wcc(g):
    return components.weak(g)


@graph("partchain", f", RECURSIVE {WCC} SELECT comp, count(*) AS n FROM w GROUP BY comp", keep=True)
def wcc_sizes(g):
    return components.weak(g).groupBy("comp").agg(F.count(F.lit(1)).alias("n"))


@graph("partchain", f", RECURSIVE {SCC} SELECT id, comp FROM k", keep=True)
def scc(g):
    return components.strong(g)


@graph("partchain", f", RECURSIVE {SCC} SELECT DISTINCT p.comp AS src, q.comp AS dst FROM e JOIN k p ON e.src = p.id JOIN k q ON e.dst = q.id WHERE p.comp <> q.comp", keep=True)
def condensation(g):
    return components.condensation(g).edges


@graph("nation", f", RECURSIVE {SCC} SELECT src, dst, p.comp AS src_part, q.comp AS dst_part FROM e LEFT JOIN (SELECT * FROM k WHERE id % 2 = 1) p ON src = p.id LEFT JOIN (SELECT * FROM k WHERE id % 2 = 1) q ON dst = q.id", keep=True)
def partition_index(g):
    parts = components.strong(g).filter("id % 2 = 1").withColumnRenamed("comp", "part")
    return components.partition_index(g, parts)[1]


ROOTED = "r(id) AS (SELECT id FROM t WHERE n_in = 0 UNION SELECT dst FROM e JOIN r ON src = r.id)"
TREE = "(SELECT count(*) FROM e) = (SELECT count(*) FROM v) - 1 AND (SELECT count(*) FROM r) = (SELECT count(*) FROM v)"


@graph("tree", f", RECURSIVE {ROOTED} SELECT {TREE} AS weak_tree, {TREE} AND (SELECT count(*) FROM t WHERE n_in = 0) = 1 AS strong_tree, (SELECT min(id) FROM t WHERE n_in = 0) AS root", keep=True)
def tree_root(g):
    return g.spark.createDataFrame([(components.is_tree(g), components.is_tree(g, "strong"), components.root(g))], "weak_tree boolean, strong_tree boolean, root long")


CYCLES = "SELECT (SELECT count(*) FROM e) > (SELECT count(*) FROM v) - (SELECT count(DISTINCT comp) FROM w) AS weak_cycle, EXISTS (SELECT 1 FROM e JOIN c ON e.src = c.id AND e.dst = c.x) AS strong_cycle"
#: c as in SCC: x reaches id.
REACHES = "c(id, x) AS (SELECT id, id FROM v UNION SELECT dst, x FROM c JOIN e ON src = c.id)"
WEAKLY = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), d(id, x) AS (SELECT id, id FROM v UNION SELECT dst, x FROM d JOIN b ON src = d.id WHERE x <= dst), w AS (SELECT id, min(x) AS comp FROM d GROUP BY id)"


@graph("nation", f", RECURSIVE {REACHES}, {WEAKLY} {CYCLES}", keep=True)
def cyclic(g):
    return g.spark.createDataFrame([(components.is_cyclic(g), components.is_cyclic(g, "strong"))], "weak_cycle boolean, strong_cycle boolean")


@graph("tree", f", RECURSIVE {REACHES}, {ROOTED} SELECT NOT ({TREE}) AS weak_cycle, EXISTS (SELECT 1 FROM e JOIN c ON e.src = c.id AND e.dst = c.x) AS strong_cycle", keep=True)
def cyclic_tree(g):
    return g.spark.createDataFrame([(components.is_cyclic(g), components.is_cyclic(g, "strong"))], "weak_cycle boolean, strong_cycle boolean")


@graph("eventchain", "SELECT count(DISTINCT user_id) AS ncomp, count(DISTINCT user_id) = 1 AS weak, false AS strong FROM events", keep=True)
def connected(g):
    return g.spark.createDataFrame([(components.n_components(g), components.is_connected(g), components.is_connected(g, "strong"))], "ncomp long, weak boolean, strong boolean")


@graph("nation", f", RECURSIVE {SCC} SELECT count(DISTINCT comp) AS ncomp, count(DISTINCT comp) = 1 AS connected FROM k", keep=True)
def connected_strong(g):
    n = components.n_components(g, "strong")
    return g.spark.createDataFrame([(n, components.is_connected(g, "strong"))], "ncomp long, connected boolean")


# --- walks


@graph("tree", ", RECURSIVE r(id, p, depth) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)], 0 UNION ALL SELECT dst, list_append(p, dst), depth + 1 FROM r JOIN e ON src = r.id) SELECT id, row_number() OVER (ORDER BY p) AS pre, depth FROM r", keep=True)
def forest_preorder(g):
    return traverse.forest(g, "strong").select("id", "pre", "depth")


@graph("tree", "SELECT src, dst FROM e", keep=True)
def forest_edges(g):
    return traverse.to_graph(traverse.forest(g, "strong")).edges


@graph("partchain", f", RECURSIVE {WCC} SELECT id, comp AS part FROM w", keep=True)
def forest_partition(g):
    return traverse.to_partition(traverse.forest(g, "weak"))


PATHS = "r(id, p, depth) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)], 0 UNION ALL SELECT dst, list_append(p, dst), depth + 1 FROM r JOIN e ON src = r.id)"


@graph("tree", f", RECURSIVE {PATHS}, n AS (SELECT id, row_number() OVER (ORDER BY p) AS pre, depth FROM r), z AS (SELECT u AS id, count(*) AS size FROM r, unnest(p) AS x(u) GROUP BY u) SELECT id, pre + size - 1 - depth AS post FROM n JOIN z USING (id)", keep=True)
def forest_postorder(g):
    return traverse.postorder(traverse.forest(g, "strong"))


@graph("tree", ", RECURSIVE r(id, p, depth) AS (SELECT CAST(1 AS BIGINT), [CAST(1 AS BIGINT)], 0 UNION ALL SELECT dst, list_append(p, dst), depth + 1 FROM r JOIN e ON src = r.id) SELECT row_number() OVER (ORDER BY p) AS pre, repeat('  ', depth) || id AS line FROM r", keep=True)
def forest_dump(g):
    return traverse.dump(traverse.forest(g, "strong"))


@graph("tree", ", RECURSIVE r(id, depth, p) AS (SELECT CAST(1 AS BIGINT), 0, [CAST(1 AS BIGINT)] UNION ALL SELECT dst, depth + 1, list_append(p, dst) FROM r JOIN e ON src = r.id) SELECT row_number() OVER (ORDER BY depth, p) AS pos, id FROM r", keep=True)
def bfs_order(g):
    return traverse.traverse(g, lambda near: Order(), "pos long, id long", "strong", "bfs", 1)


# --- contraction


@graph("nation", "SELECT DISTINCT CASE WHEN src = 2 THEN 1 ELSE src END AS src, CASE WHEN dst = 2 THEN 1 ELSE dst END AS dst FROM e WHERE NOT (src IN (1, 2) AND dst IN (1, 2) AND src <> dst)", keep=True)
def contract_edge(g):
    return contract.edge(g.add((1, 2)), 1, 2).edges


@graph("nation", "SELECT DISTINCT CASE WHEN src IN (3, 4, 5) THEN 3 ELSE src END AS src, CASE WHEN dst IN (3, 4, 5) THEN 3 ELSE dst END AS dst FROM e WHERE NOT (src IN (3, 4, 5) AND dst IN (3, 4, 5) AND src <> dst)", keep=True)
def contract_nodes(g):
    return contract.nodes(g, [3, 4, 5, 999]).edges


@graph("eventchain", "SELECT min_by(event_id, (ts, event_id)) + 1 AS src, max_by(event_id, (ts, event_id)) + 1 AS dst FROM events GROUP BY user_id HAVING count(*) > 1", keep=True)
def linears(g):
    return contract.linears(g).edges


# --- hashes, repository, generators

KEYS = """, k AS (SELECT id, n_in || ',' || n_self || ',' || n_out AS k FROM t), n AS (SELECT src, dst FROM e WHERE src <> dst),
a AS (SELECT id, string_agg(k || ':' || c, '|' ORDER BY k) AS s FROM (SELECT dst AS id, k, count(*) AS c FROM n JOIN k ON n.src = k.id GROUP BY 1, 2) GROUP BY id),
b AS (SELECT id, string_agg(k || ':' || c, '|' ORDER BY k) AS s FROM (SELECT src AS id, k, count(*) AS c FROM n JOIN k ON n.dst = k.id GROUP BY 1, 2) GROUP BY id),
h AS (SELECT sha256(coalesce(a.s, '') || ';' || k.k || ';' || coalesce(b.s, '')) AS h FROM k LEFT JOIN a USING (id) LEFT JOIN b USING (id)),
h0 AS (SELECT sha256(string_agg(k || ':' || c, '|' ORDER BY k)) AS hop0 FROM (SELECT k, count(*) AS c FROM k GROUP BY k)),
h1 AS (SELECT sha256(sum(CAST('0x' || substr(h, 1, 8) AS BIGINT)) || ',' || sum(CAST('0x' || substr(h, 9, 8) AS BIGINT)) || ',' || sum(CAST('0x' || substr(h, 17, 8) AS BIGINT)) || ',' || sum(CAST('0x' || substr(h, 25, 8) AS BIGINT)) || ',' || sum(CAST('0x' || substr(h, 33, 8) AS BIGINT)) || ',' || sum(CAST('0x' || substr(h, 41, 8) AS BIGINT)) || ',' || sum(CAST('0x' || substr(h, 49, 8) AS BIGINT)) || ',' || sum(CAST('0x' || substr(h, 57, 8) AS BIGINT))) AS hop1 FROM h) """


@graph("partchain", KEYS + "SELECT (SELECT count(*) FROM v) AS nvert, (SELECT count(*) FROM e) AS nedge, hop0, hop1 FROM h0, h1", keep=True)
def gkey(g):
    return morph.gkey(g)


@graph("partchain", KEYS + "SELECT hop0 FROM h0", keep=True)
def hash0(g):
    return morph.gkey(g).select("hop0")


@graph("partchain", KEYS + "SELECT hop1 FROM h1", keep=True)
def hash1(g):
    return morph.gkey(g).select("hop1")


@graph("nation", "SELECT 'isomorphic' AS verdict, true AS maps", keep=True)
def isomorphism(g):
    other = g.rotate()
    verdict, to = morph.isomorphism(g, other)
    return g.spark.createDataFrame([(verdict, bool(to) and g.relabel(to).equal(other))], "verdict string, maps boolean")


@graph("nation", "SELECT least(src, dst) AS i, greatest(src, dst) AS j FROM e WHERE src < dst AND EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src)")
def edge_pairs(g):
    return g.opposite()


# --- single vertices, names, membership


@graph("nation", "SELECT EXISTS (SELECT 1 FROM v WHERE id = 3) AS vertex, EXISTS (SELECT 1 FROM v WHERE id = 999) AS no_vertex, EXISTS (SELECT 1 FROM e WHERE src = 1 AND dst = 2) AS edge, EXISTS (SELECT 1 FROM e WHERE src = 1 AND dst = 999) AS no_edge, NOT EXISTS (SELECT 1 FROM v WHERE id = 999) AS refused", keep=True)
def membership(g):
    try:
        g.check_vertex(3)
        g.check_vertex(999)
        refused = False
    except ValueError:
        refused = True
    return g.spark.createDataFrame([(g.has_vertex(3), g.has_vertex(999), g.has_edge(1, 2), g.has_edge(1, 999), refused)], "vertex boolean, no_vertex boolean, edge boolean, no_edge boolean, refused boolean")


@graph("nation", f"SELECT n_in + n_self AS ins, n_out + n_self AS outs, n_in, n_self, n_out, {CLASS} AS vclass, n_in + n_out = 0 AS alone, coalesce((SELECT string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) FROM e WHERE dst = 3), '') AS before, coalesce((SELECT string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) FROM e WHERE src = 3), '') AS after FROM t WHERE id = 3", keep=True)
def one_vertex(g):
    listed = lambda ids: ",".join(map(str, sorted(ids)))
    row = (degree.degree(g, 3, "in"), degree.degree(g, 3, "out"), *degree.degree(g, 3, "in_self_out"), degree.classify(g, 3), degree.is_isolated(g, 3), listed(degree.neighbours(g, 3, "in")), listed(degree.neighbours(g, 3, "out")))
    return g.spark.createDataFrame([row], "ins long, outs long, n_in long, n_self long, n_out long, vclass string, alone boolean, before string, after string")


@graph("nation", "SELECT 'trade_of_nations' AS name, count(*) AS nedge FROM e")
def rename(g):
    g = g.rename("trade of nations!")
    return g.edges.agg(F.lit(g.name).alias("name"), F.count(F.lit(1)).alias("nedge"))


@graph("nation", "SELECT true AS released, count(*) AS nedge FROM e", keep=True)
def release(g):
    released = g.persist().release()
    return g.edges.agg(F.lit(released).alias("released"), F.count(F.lit(1)).alias("nedge"))


@graph("nation", "SELECT src, dst FROM e", keep=True)
def convert(g):
    return Graph.from_pairs(g.spark, g.to_sets()[1]).edges


@graph("nation", ", h AS (SELECT n_in + n_self AS deg, count(*) AS n FROM t GROUP BY 1) SELECT range AS deg, coalesce(n, 0) AS n FROM range(0, (SELECT max(deg) + 1 FROM h)) LEFT JOIN h ON deg = range", keep=True)
def dense(g):
    return g.spark.createDataFrame(list(enumerate(degree.dense(degree.histogram1(g, "in")))), "deg long, n long")


@graph("eventchain", "SELECT src, dst FROM e WHERE src <> (SELECT min(id) FROM t WHERE n_in = 1 AND n_self = 0 AND n_out = 1) AND dst <> (SELECT min(id) FROM t WHERE n_in = 1 AND n_self = 0 AND n_out = 1) UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.dst = (SELECT min(id) FROM t WHERE n_in = 1 AND n_self = 0 AND n_out = 1)", keep=True)
def linear(g):
    first = degree.classes(g).filter("vclass = 'linear'").agg(F.min("id")).first()[0]
    return contract.linear(g, first).edges


@graph("nation", "SELECT 'isomorphic' AS split, 'not_isomorphic' AS cut FROM e LIMIT 1", keep=True)
def homeomorphic(g):
    s, d = g.edges.filter("src <> dst").agg(F.min(F.struct("src", "dst"))).first()[0]
    split, cut = g.delete((s, d)).add((s, 10_000, d)), g.delete((s, d))
    return g.spark.createDataFrame([(morph.homeomorphic(g, split), morph.homeomorphic(g, cut))], "split string, cut string")


# --- walks with controls and visitors of one's own


class Descending(DepthFirst):
    """Children in descending order."""

    def push(self, vertex, vertices):
        return super().push(vertex, sorted(vertices, reverse=True))


class Leaves(Visitor):
    """id, depth and whether it is a leaf, for every vertex."""

    def start(self):
        self.rows = {}

    def enter(self, vertex, parent, depth):
        self.rows[vertex] = [vertex, depth, False]

    def leaf(self, vertex):
        self.rows[vertex][2] = True

    def result(self):
        return list(self.rows.values())


@graph("tree", f", RECURSIVE {PATHS} SELECT row_number() OVER (ORDER BY list_transform(p, lambda x: -x)) AS pos, id FROM r", keep=True)
def own_control(g):
    return traverse.traverse(g, lambda near: Order(), "pos long, id long", "strong", Descending(), 1)


@graph("tree", f", RECURSIVE {PATHS} SELECT id, depth, NOT EXISTS (SELECT 1 FROM e WHERE src = r.id) AS leaf FROM r", keep=True)
def own_visitor(g):
    return traverse.traverse(g, lambda near: Leaves(), "id long, depth int, leaf boolean", "strong", "dfs", 1)


@graph("tree", f", RECURSIVE {PATHS} SELECT row_number() OVER (ORDER BY p) AS pos, id FROM r", keep=True)
def walk_forest(g):
    return traverse.walk_forest(traverse.forest(g, "strong"), lambda near: Order(), "pos long, id long")


# --- texts


@graph("nation", "SELECT src, dst FROM e", keep=True)
def read_adj(g):
    return adj.read_adj(g.spark, adj.write_adj(g, new_path(g.spark, "texts"))).edges


@graph("nation", "SELECT src, dst FROM e", keep=True)
def read_dot(g):
    return dot.read_dot(g.spark, dot.write_dot(g, new_path(g.spark, "texts"))[0])[0].edges


@graph("nation", "SELECT 'vertex' AS key_kind, id, CAST(NULL AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst, k, val AS v FROM (SELECT id, unnest(['label', 'color']) AS k, unnest(['N ' || id, 'red']) AS val FROM v WHERE id <= 3) UNION ALL SELECT 'edge', NULL, src, dst, 'color', 'blue' FROM e WHERE src = 1 AND dst <= 3", keep=True)
def dot_attributes(g):
    ids = [r[0] for r in g.vertices.filter("id <= 3").collect()]
    at = {i: [("label", f"N {i}"), ("color", "red")] for i in ids} | {(r[0], r[1]): [("color", "blue")] for r in g.edges.filter("src = 1 and dst <= 3").collect()}
    path = dot.write_dot(g, new_path(g.spark, "texts"), at)[0]
    return dot.attribute_table(g.spark, dot.read_dot(g.spark, path)[1]).select("key_kind", "id", "src", "dst", "k", "v")


LINES = "SELECT row_number() OVER (ORDER BY kind, src, dst) AS n, line FROM (SELECT 0 AS kind, 0 AS src, 0 AS dst, 'digraph nation {{' AS line UNION ALL SELECT 1, id, 0, '  ' || id || ';' FROM v UNION ALL {edges} UNION ALL SELECT 3, 0, 0, '}}')"


@graph("nation", LINES.format(edges="SELECT 2, src, dst, '  ' || src || ' -> ' || dst || ';' FROM e"), keep=True)
def dot_lines(g):
    return dot.dot_lines(g)


@graph("nation", LINES.format(edges="SELECT 2, src, dst, '  ' || src || ' -> ' || dst || CASE WHEN back THEN ' [dir=both];' ELSE ' [dir=none];' END FROM (SELECT src, dst, src <> dst AND EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src) AS back FROM e) WHERE NOT (back AND src > dst)"), keep=True)
def dot_pairs(g):
    lines = dot.to_dot(g, edge_pair="both", edge_single="none").splitlines()
    return g.spark.createDataFrame(list(enumerate(lines, 1)), "n long, line string")


@graph("nation", "SELECT id, CASE id % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS color FROM v", keep=True)
def partition_colours(g):
    found = dot.partition_colours(g, g.vertices.select("id", (F.col("id") % 3).alias("part")))
    return g.spark.createDataFrame([(k, str(v[0][1])) for k, v in found.items() if isinstance(k, int)], "id long, color string")


def read_deps(spark: SparkSession, d: str) -> DataFrame:
    """A dependency tree of the world, its regions and their nations, written as text and read."""
    name = lambda c: F.translate(c, " ", "_")
    rows = tables.read(spark, d, "nation").join(tables.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(name("r_name"), name("n_name")).orderBy("r_regionkey", "n_nationkey").collect()
    lines, last = ["world"], None
    for region, nation in rows:
        if region != last:
            lines.append(f"|-- {region}")
            last = region
        lines.append(f"|   |-- {nation} ~> 1.0 (Hex package)")
    path = put_text(spark, f"{new_path(spark, 'texts')}/world.txt", "\n".join(lines) + "\n")
    g, at = deps.read_deps(spark, path)
    names = {i: dict(own)[ALIAS] for i, own in at.items() if isinstance(i, int)}
    pairs = g.to_sets()[1]
    return spark.createDataFrame([(names[i], names[j], dict(at[(i, j)])["color"]) for i, j in pairs], "parent string, child string, color string")


QUERIES["q_read_deps"] = read_deps
ORACLE["q_read_deps"] = "SELECT 'world' AS parent, replace(r_name, ' ', '_') AS child, 'black' AS color FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT replace(r_name, ' ', '_'), replace(n_name, ' ', '_'), 'lightgray' FROM nation JOIN region ON n_regionkey = r_regionkey"


def made(sql: str | None = None):
    def add(f):
        QUERIES[f"q_{f.__name__}"] = lambda spark, d: f(spark)
        if sql:
            ORACLE[f"q_{f.__name__}"] = sql
        return f

    return add


@made("SELECT CAST(0 AS BIGINT) AS nvert, CAST(0 AS BIGINT) AS nedge")
def new(spark):
    g = Graph.new(spark, "nothing")
    return spark.createDataFrame([(g.n_vertices(), g.n_edges())], "nvert long, nedge long")


@made("SELECT * FROM (VALUES (1, 2), (2, 3), (3, 1), (4, 5), (4, 6), (9, 9)) AS x(src, dst)")
def build(spark):
    return Graph.build(spark, [range(1, 10), (1, 2, 3, 1), (4, [5, 6]), [(9, 9), {7, 8}]]).edges.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))


@made("SELECT CAST(range AS BIGINT) AS k, true AS refused FROM range(0, 8)")
def bad_elements(spark):
    out = []
    for k, x in enumerate([0, -1, "a", True, (1,), (1, "x"), 2.5, [1, [None]]]):
        try:
            Graph.build(spark, x)
            out.append((k, False))
        except ValueError:
            out.append((k, True))
    return spark.createDataFrame(out, "k long, refused boolean")


@made("SELECT CAST(59 AS BIGINT) AS clique, true AS wheel")
def homogeneous(spark):
    one, other = (degree.homogeneous(degree.histogram1(g, "in")) for g in (generate.clique(spark, 60), generate.wheel(spark, 9)))
    return spark.createDataFrame([(one, other is None)], "clique long, wheel boolean")


def shelf(spark):
    """A repository with lines and rings, one of them under other ids, added in two steps."""
    ring, line = (lambda n: generate.ring(spark, n)), (lambda n: generate.line(spark, n))
    first = repository.Repository.new(spark).add(line(3), ring(4), ring(5))
    return first, first.add(ring(5).relabel(lambda i: i * 10).rename("turned"), line(5), generate.wheel(spark, 5))


@made("SELECT * FROM (VALUES (0, 3, 3, 2), (1, 6, 5, 3)) AS x(step, graphs, iso, homeo)")
def repository_add(spark):
    rows = [(k, r.n_graphs(), r.n_classes("iso"), r.n_classes("homeo")) for k, r in enumerate(shelf(spark))]
    return spark.createDataFrame(rows, "step int, graphs int, iso int, homeo int")


@made("SELECT * FROM (VALUES ('iso', 'ring_5'), ('iso', 'turned'), ('homeo ring', 'ring_4'), ('homeo ring', 'ring_5'), ('homeo ring', 'turned'), ('homeo line', 'line_3'), ('homeo line', 'line_5')) AS x(asked, graph_id)")
def repository_query(spark):
    r = shelf(spark)[1]
    asked = {"iso": ("iso", generate.ring(spark, 5).rotate()), "homeo ring": ("homeo", generate.ring(spark, 7)), "homeo line": ("homeo", generate.line(spark, 9))}
    found = [r.query(g, kind).select(F.lit(name).alias("asked"), "graph_id") for name, (kind, g) in asked.items()]
    return found[0].union(found[1]).union(found[2])


@made("SELECT CAST(26704 AS BIGINT) AS graphs, CAST(112 AS BIGINT) AS iso")
def classes_connected6(spark):
    r = repository.all_graphs(spark, 6)
    return spark.createDataFrame([(r.n_graphs(), r.n_classes("iso"))], "graphs long, iso long")


@made("SELECT CAST(728 AS BIGINT) AS graphs, CAST(21 AS BIGINT) AS iso, CAST(19 AS BIGINT) AS homeo")
def classes_connected5(spark):
    r = repository.all_graphs(spark, 5)
    return spark.createDataFrame([(r.n_graphs(), r.n_classes("iso"), r.n_classes("homeo"))], "graphs long, iso long, homeo long")


@made("SELECT CAST(1024 AS BIGINT) AS graphs, CAST(34 AS BIGINT) AS iso, CAST(32 AS BIGINT) AS homeo")
def classes_all5(spark):
    r = repository.all_graphs(spark, 5, connected=False)
    return spark.createDataFrame([(r.n_graphs(), r.n_classes("iso"), r.n_classes("homeo"))], "graphs long, iso long, homeo long")


N = 1000
GENERATED = {
    "dust": (lambda s: generate.dust(s, N).vertices, f"SELECT range AS id FROM range(1, {N} + 1)"),
    "line": (lambda s: generate.line(s, N).edges, f"SELECT range - 1 AS src, range AS dst FROM range(2, {N} + 1)"),
    "ring": (lambda s: generate.ring(s, N).edges, f"SELECT range AS src, range % {N} + 1 AS dst FROM range(1, {N} + 1)"),
    "fan_out": (lambda s: generate.fan_out(s, N).edges, f"SELECT 1 AS src, range AS dst FROM range(2, {N} + 1)"),
    "fan_in": (lambda s: generate.fan_in(s, N).edges, f"SELECT range AS src, 1 AS dst FROM range(2, {N} + 1)"),
    "wheel": (lambda s: generate.wheel(s, N).edges, f"SELECT 1 AS src, range AS dst FROM range(2, {N} + 1) UNION SELECT range - 1, range FROM range(3, {N} + 1) UNION SELECT {N}, 2"),
    "clique": (lambda s: generate.clique(s, 60).edges, "SELECT a.range AS src, b.range AS dst FROM range(1, 61) a, range(1, 61) b WHERE a.range <> b.range"),
    "grid2d": (lambda s: generate.grid2d(s, 40, 25).edges, "SELECT a.range AS src, b.range AS dst FROM range(1, 1001) a, range(1, 1001) b WHERE abs((a.range - 1) % 40 - (b.range - 1) % 40) + abs((a.range - 1) // 40 - (b.range - 1) // 40) = 1"),
    "random": (lambda s: generate.random(s, N, 3000, True).edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src", "dst").alias("different"), F.sum(F.when(F.col("src") == F.col("dst"), 1).otherwise(0)).alias("loops")), "SELECT CAST(3000 AS BIGINT) AS n, CAST(3000 AS BIGINT) AS different, CAST(0 AS BIGINT) AS loops"),
}
for _name, (_f, _sql) in GENERATED.items():
    QUERIES[f"q_gen_{_name}"] = lambda spark, d, f=_f: f(spark)
    ORACLE[f"q_gen_{_name}"] = _sql
