"""Graph generators: ranges and expressions, no loops in the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.ranges import running
from wayloom.graph import EDGES, Graph


def _size(n: int, least: int = 1) -> int:
    if not isinstance(n, int) or n < least:
        raise ValueError(f"size must be {least} or more")
    return n


def _graph(spark: SparkSession, n: int, edges: DataFrame | None, name: str) -> Graph:
    e = spark.createDataFrame([], EDGES) if edges is None else edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))
    return Graph(spark.range(1, n + 1).select("id"), e, name)


def dust(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, _size(n), None, f"dust_{n}")


def empty(spark: SparkSession) -> Graph:
    return Graph.new(spark, "empty")


def _steps(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(2, n + 1).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))


def line(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, _size(n), _steps(spark, n), f"line_{n}")


def ring(spark: SparkSession, n: int) -> Graph:
    """A cycle; one vertex alone has no edge."""
    e = spark.range(1, n + 1).select(F.col("id").alias("src"), (F.col("id") % n + 1).alias("dst")) if _size(n) > 1 else None
    return _graph(spark, n, e, f"ring_{n}")


def fan_out(spark: SparkSession, n: int) -> Graph:
    e = spark.range(2, _size(n, 3) + 1).select(F.lit(1).alias("src"), F.col("id").alias("dst"))
    return _graph(spark, n, e, f"fan_out_{n}")


def fan_in(spark: SparkSession, n: int) -> Graph:
    e = spark.range(2, _size(n, 3) + 1).select(F.col("id").alias("src"), F.lit(1).alias("dst"))
    return _graph(spark, n, e, f"fan_in_{n}")


def wheel(spark: SparkSession, n: int) -> Graph:
    """Spokes from 1 to the rim 2..n, and the rim as a cycle."""
    rim = spark.range(2, _size(n, 4) + 1)
    e = rim.select(F.lit(1).alias("src"), F.col("id").alias("dst")).union(rim.select(F.col("id"), F.when(F.col("id") == n, 2).otherwise(F.col("id") + 1)))
    return _graph(spark, n, e, f"wheel_{n}")


def clique(spark: SparkSession, n: int) -> Graph:
    """All ordered pairs of different vertices."""
    size = _size(n)
    e = spark.range(0, size * (size - 1)).select(F.expr(f"id div {max(1, size - 1)} + 1").alias("src"), (F.col("id") % max(1, size - 1) + 1).alias("k"))
    return _graph(spark, n, e.select("src", F.when(F.col("k") >= F.col("src"), F.col("k") + 1).otherwise(F.col("k")).alias("dst")), f"clique_{n}")


def grid2d(spark: SparkSession, nx: int, ny: int) -> Graph:
    """nx by ny vertices, numbered along x first, each linked both ways with its right and its upper neighbour."""
    n = _size(nx) * _size(ny)
    ids = spark.range(1, n + 1)
    right = ids.filter((F.col("id") % nx != 0)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    up = ids.filter(F.col("id") <= n - nx).select(F.col("id").alias("src"), (F.col("id") + nx).alias("dst"))
    one = right.union(up)
    return _graph(spark, n, one.union(one.select("dst", "src")), f"grid_{nx}_{ny}")


def random(spark: SparkSession, n: int, m: int, connected: bool = False, seed: int = 42) -> Graph:
    """n vertices and m different edges without loops; connected: a random tree is among them.

    Pairs are numbered 0..n(n-1)-1; a keyed permutation of the numbers (four rounds on their halves, numbers
    outside passed over) picks m of them without repeats.
    """
    _size(n)
    if not 0 <= m <= n * (n - 1) or connected and m < n - 1:
        raise ValueError(f"{m} edges don't fit {n} vertices")
    pairs = n * (n - 1)
    tree = None
    if connected and n > 1:
        h = lambda salt: F.abs(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)))
        up = spark.range(2, n + 1).select(F.col("id"), (h(1) % (F.col("id") - 1) + 1).alias("p"), (h(2) % 2).alias("way"))
        tree = up.select(F.when(F.col("way") == 0, F.col("p")).otherwise(F.col("id")).alias("src"), F.when(F.col("way") == 0, F.col("id")).otherwise(F.col("p")).alias("dst"))
    half = max(1, (max(1, pairs - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mixed(x):
        a, b = F.shiftright(x, half), x.bitwiseAND(F.lit(mask))
        for k in range(4):
            a, b = b, a.bitwiseXOR(F.xxhash64(b, F.lit(seed), F.lit(100 + k)).bitwiseAND(F.lit(mask)))
        return F.shiftleft(a, half).bitwiseOR(b)

    # the images of 0, 1, 2, ... under the permutation of 2^(2 half) numbers that are numbers of pairs
    # at least a quarter of the images are; eight times as many as are needed, or all, suffice
    images = spark.range(0, min(1 << (2 * half), 8 * (m + n) + 1000)).select("id", mixed(F.col("id")).alias("x")).filter(F.col("x") < pairs)
    need = m if tree is None else m - (n - 1)
    e = images.select("id", (F.expr(f"x div {max(1, n - 1)}") + 1).alias("src"), (F.col("x") % max(1, n - 1) + 1).alias("k"))
    e = e.select("id", "src", F.when(F.col("k") >= F.col("src"), F.col("k") + 1).otherwise(F.col("k")).alias("dst"))
    if tree is not None:
        e = e.join(tree, ["src", "dst"], "left_anti")
    picked = running(e.withColumn("one", F.lit(1)), ["id"], "one").filter(F.col("total") <= need).select("src", "dst")
    return _graph(spark, n, picked if tree is None else picked.union(tree), f"random_{n}_{m}")


def mask_rows(spark: SparkSession, n: int, connected: bool = True) -> DataFrame:
    """graph_id, seq, vs, es of every undirected graph on n vertices, a row for each, edges both ways.

    A mask is a set of the n(n-1)/2 pairs; connected: those over which vertex 1 reaches all. n is 9 at most.
    """
    if not 1 <= n <= 9:
        raise ValueError("n must be 1 to 9")
    pairs = [(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)]
    rows = spark.range(0, 1 << len(pairs)).withColumnRenamed("id", "seq")
    if connected and n > 1:

        def covered(batches):
            for b in batches:
                seq = b["seq"].to_numpy()
                met = np.ones(len(seq), np.int64)
                for _ in range(n - 1):
                    for k, (i, j) in enumerate(pairs):
                        there = seq >> k & 1
                        met |= (met >> (i - 1) & there) << (j - 1) | (met >> (j - 1) & there) << (i - 1)
                yield b[met == (1 << n) - 1]

        rows = rows.mapInPandas(covered, "seq long")
    both = [F.when(F.expr(f"shiftright(seq, {k}) & 1") == 1, F.struct(F.lit(a).cast("long").alias("src"), F.lit(b).cast("long").alias("dst"))) for k, p in enumerate(pairs) for a, b in (p, p[::-1])]
    es = F.array_sort(F.array_compact(F.array(*both))) if pairs else F.expr("cast(array() as array<struct<src:bigint,dst:bigint>>)")
    return rows.select(F.format_string(f"n{n}_%d", "seq").alias("graph_id"), "seq", F.sequence(F.lit(1), F.lit(n)).cast("array<long>").alias("vs"), es.alias("es"))


def masks(spark: SparkSession, n: int, connected: bool = True) -> tuple[DataFrame, DataFrame]:
    """(graph_id, seq, id) and (graph_id, src, dst) of every undirected graph on n vertices."""
    rows = mask_rows(spark, n, connected)
    return rows.select("graph_id", "seq", F.explode("vs").alias("id")), rows.select("graph_id", F.inline("es"))
