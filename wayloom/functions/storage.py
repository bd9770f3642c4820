"""Tables written to the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and all runs in one JVM, a folder that is removed at exit."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_wayloom_dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="wayloom-")
        atexit.register(shutil.rmtree, made, True)
        found = sc._wayloom_dir = f"file://{made}"
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, for clusters on which it isn't installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_wayloom_shipped", False):
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        holder = tempfile.mkdtemp(prefix="wayloom-zip-")
        atexit.register(shutil.rmtree, holder, True)
        sc.addPyFile(shutil.make_archive(f"{holder}/wayloom", "zip", top, "wayloom"))
        sc._wayloom_shipped = True


_OPEN: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end: what is needed later is to be written elsewhere by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def put_text(spark: SparkSession, path: str, text: str) -> str:
    """Writes a text file where Spark reads, local or not; returns the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    ship(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str = "step") -> tuple[DataFrame, int, str]:
    """The stored table, its number of rows, counted as it is written, and its path."""
    ship(df.sparkSession)
    path = new_path(df.sparkSession, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"], path


def summed(df: DataFrame, name: str = "step") -> tuple[DataFrame, tuple]:
    """The stored table and, gathered as it is written, its number of rows and a sum that tells whether it has changed."""
    ship(df.sparkSession)
    path = new_path(df.sparkSession, name)
    seen = Observation()
    total = F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0))
    df.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("s")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), (seen.get["n"], seen.get["s"])
