"""Running totals and next values over a total order, range by range: no task sorts all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions.storage import counted

#: Rows of a range, in the mean.
RANGE = 1_000_000


def ranged(df: DataFrame, keys: list[str], name: str = "ranges") -> DataFrame:
    """df, stored, with part: the number of the range of keys a row is in, in their order."""
    df, n, _ = counted(df, name)
    parts = max(1, -(-n // RANGE))
    dealt = df.repartitionByRange(parts, *keys) if parts > 1 else df.coalesce(1)
    return counted(dealt.withColumn("part", F.spark_partition_id()), name)[0]


def running(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with total: the sum of value up to a row, in the order of keys, which differ from row to row."""
    rows = ranged(df, keys)
    sums = rows.groupBy("part").agg(F.sum(value).alias("s"))
    starts = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("start"))  # a row for each range
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("inside", F.sum(value).over(inside)).join(F.broadcast(starts), "part").withColumn("total", F.col("start") + F.col("inside")).drop("part", "inside", "start")
