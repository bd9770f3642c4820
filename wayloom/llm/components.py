"""Connected components of a link table: alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wayloom.llm.common import new_path, ship, stored


def stars(links: DataFrame, name: str, rounds: int = 64, split: int = 1_000_000) -> DataFrame:
    """links (a, b) of longs, a <> b, any order; returns (node, root) for every linked node, root the smallest of its component.

    A node's neighbours are never gathered: a round takes a minimum for each node (summed up before the
    shuffle) and joins them back. Beyond `split` links the minima are written first, so that Spark can split the join
    where a node has very many links.
    """
    spark = links.sparkSession

    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        """The stored edges, their number and a sum that tells whether they have changed."""
        ship(spark)
        path, seen = new_path(spark, name), Observation()
        e.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("s")).write.parquet(path)
        return spark.read.schema(e.schema).parquet(path), (seen.get["n"], seen.get["s"])

    edges, now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    # of many links, minima are written first: then a node with very many links can be split in the join
    apart = (lambda x: stored(x, name)) if now[0] > split else (lambda x: x)
    for _ in range(rounds):
        if not now[0]:
            break
        both = edges.union(edges.select("v", "u"))
        low = apart(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = apart(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges, after = written(small)
        if after == now:
            break
        now = after
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(found.select("root", "root")).distinct()
