"""What the training-data operators share: Arrow mapping, texts, and rows told apart by id and text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.functions.storage import counted, drop, new_path, scratch, ship, stored

__all__ = ["counted", "drop", "new_path", "scratch", "ship", "stored"]

#: ASCII white space as the contracts define it, for Java regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, one value at a time; null gives b''."""
    col = batch.column(name).cast(pa.binary())
    for x in col:
        yield x.as_py() or b""


_SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """The last steps of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes, block: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each word between ASCII white space: a polynomial of its bytes, mixed. For bringing words together."""
    a = np.frombuffer(text, np.uint8)
    s = np.empty(len(a) + 2, bool)
    s[0] = s[-1] = True
    s[1:-1] = _SPACES[a]
    edges = np.flatnonzero(s[1:] != s[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), block):
        lo, n = starts[i : i + block], (ends - starts)[i : i + block]
        # the bytes of the words alone, and each one's place in its word
        first = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(first, n)
        most = int(n.max())
        if len(_POWERS[0]) < most:
            _POWERS[0] = np.cumprod(np.r_[np.uint64(1), np.full(2 * most, _BASE, np.uint64)])
        byte = a[place + np.repeat(lo, n)].astype(np.uint64) + np.uint64(1)
        out[i : i + block] = np.add.reduceat(byte * _POWERS[0][place], first)
    return mixed(out)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, from the words' hashes."""
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = h * np.uint64(_BASE) + words[j : len(words) - n + 1 + j]
    return mixed(h)


def empty_text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def lowered(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, a stored table of short rows, marked for broadcast where it has no more than so many."""
    return F.broadcast(df) if df.count() <= rows else df


def text_hash() -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(empty_text("text"))


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame, small: int = 1_000_000) -> DataFrame:
    """docs, in their columns, without the rows of gone (doc_id, t), and with one row of each of repeated (doc_id, t).

    Both are stored tables without repeats; t is text_hash(). Of rows that agree in doc_id and text the first in the
    order of all their columns stays. Null ids are compared like values.
    """
    names = [unused(docs, "gone_id"), unused(docs, "gone_text"), unused(docs, "gone_place")]
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (text_hash() == F.col(names[1]))
    keys = lambda x: broadcast_if_small(x.select(F.col("doc_id").alias(names[0]), F.col("t").alias(names[1])), small)
    left = docs.join(keys(gone), same, "left_anti")
    if repeated.isEmpty():
        return left
    again = left.join(keys(repeated), same, "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", text_hash()).orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    return left.join(keys(repeated), same, "left_anti").union(again.withColumn(names[2], place).filter(F.col(names[2]) == 1).drop(names[2]))
