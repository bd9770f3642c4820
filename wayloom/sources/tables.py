"""Graphs derived from the test tables. Keys start at 0 there, vertex ids at 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.functions.ranges import ranged
from wayloom.graph import Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return lines.select((F.col("l_partkey") + 1).alias("src"), (F.lead("l_partkey").over(w) + 1).alias("dst")).filter("dst is not null")


def partchain(spark: SparkSession, d: str) -> Graph:
    """Consecutive parts of an order."""
    return Graph.from_frames(part_edges(read(spark, d, "lineitem")), name="partchain")


def userchain(spark: SparkSession, d: str) -> Graph:
    """From the user of each event to the user of the next one. All events are one sequence, so ranges of it are sorted apart."""
    e = ranged(read(spark, d, "events").select("ts", "event_id", "user_id"), ["ts", "event_id"], "events")
    inside = Window.partitionBy("part").orderBy("ts", "event_id")
    first = e.groupBy("part").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("u"))
    after = first.select("part", F.lead("u").over(Window.orderBy("part")).alias("after"))
    rows = e.withColumn("next", F.lead("user_id").over(inside)).join(F.broadcast(after), "part")
    return Graph.from_frames(rows.select((F.col("user_id") + 1).alias("src"), (F.coalesce("next", "after") + 1).alias("dst")).filter("dst is not null"), name="userchain")


def supply(spark: SparkSession, d: str) -> Graph:
    """From customers to the suppliers of their lines."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select((F.col("o_custkey") + 1).alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"))
    return Graph.from_frames(rows, name="supply")


def eventchain(spark: SparkSession, d: str) -> Graph:
    """From each event to the user's next one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").select((F.col("event_id") + 1).alias("src"), (F.lead("event_id").over(w) + 1).alias("dst"))
    return Graph.from_frames(e.filter("dst is not null"), e.select(F.col("src").alias("id")), "eventchain")


def tree(spark: SparkSession, d: str) -> Graph:
    """1, regions, nations, customers."""
    nation = read(spark, d, "nation")
    rows = (
        read(spark, d, "region").select(F.lit(1).cast("long").alias("src"), (F.col("r_regionkey") + 2).cast("long").alias("dst"))
        .union(nation.select((F.col("n_regionkey") + 2).cast("long"), (F.col("n_nationkey") + 100).cast("long")))
        .union(read(spark, d, "customer").select((F.col("c_nationkey") + 100).cast("long"), F.col("c_custkey") + 1000))
    )
    return Graph.from_frames(rows, name="tree")


def nation(spark: SparkSession, d: str) -> Graph:
    """From the supplier's nation to the customer's, for every line."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    rows = lines.join(s, lines.l_suppkey == s.s_suppkey).join(o, lines.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey)
    return Graph.from_frames(rows.select((F.col("s_nationkey") + 1).alias("src"), (F.col("c_nationkey") + 1).alias("dst")), name="nation")


#: The same edges in DuckDB's SQL, each as relations e(src, dst) and v(id).
SQL = {
    "partchain": "SELECT DISTINCT a + 1 AS src, b + 1 AS dst FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem) WHERE b IS NOT NULL",
    "userchain": "SELECT DISTINCT a + 1 AS src, b + 1 AS dst FROM (SELECT user_id AS a, lead(user_id) OVER (ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL",
    "supply": "SELECT DISTINCT o_custkey + 1 AS src, l_suppkey + 1000000 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "eventchain": "SELECT a + 1 AS src, b + 1 AS dst FROM (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL",
    "tree": "SELECT CAST(1 AS BIGINT) AS src, CAST(r_regionkey + 2 AS BIGINT) AS dst FROM region UNION SELECT n_regionkey + 2, n_nationkey + 100 FROM nation UNION SELECT c_nationkey + 100, c_custkey + 1000 FROM customer",
    "nation": "SELECT DISTINCT CAST(s_nationkey + 1 AS BIGINT) AS src, CAST(c_nationkey + 1 AS BIGINT) AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
}
GRAPHS = {"partchain": partchain, "userchain": userchain, "supply": supply, "eventchain": eventchain, "tree": tree, "nation": nation}
