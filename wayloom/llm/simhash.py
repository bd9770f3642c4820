"""SimHash near-dedup: covering locality-sensitive hashing over 64-bit fingerprints.

A text's fingerprint is voted by the XXH64 of its word shingles, repeats included. Equal fingerprints
are one class. For radius r, bit i carries a non-zero vector m(i) of r + 1 bits, and each non-zero
vector v gives a table whose mask keeps the bits with odd <m(i), v>: for any r differing bits some v is
orthogonal to all their vectors, so every pair within the radius collides in some table, none is missed.

Buckets of two are compared at once, those of up to `bucket` classes are compared pair by pair. The
members of larger buckets go another exact way, without pairs: two fingerprints differ in at most r bits
if and only if their balls of radius r / 2 meet, and a ball's centre has a fixed number of fingerprints
around it (65 rows of 16 bytes for radius 2, as many as pairs with 65 others would be); links to the smallest of
these join the same components. So no group grows beyond a constant in any task. Components come from stars over
the links of classes; the id is the smallest doc_id.

Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and ties fall
into one class. A null doc_id gets its component's id but never names one, unless all are null. Columns
other than doc_id and text don't matter. Very long texts are read whole. An empty table gives an empty result.

`keepers`, for pipelines, groups texts by the similarity of their five-word shingles instead: see similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import similarity
from wayloom.llm.common import map_arrow, stored, table, texts, without
from wayloom.llm.components import stars

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """bytes.split() splits at exactly \\x20 and \\x09-\\x0D."""
    w = text.translate(_LOWER).split()
    if not w:
        return 0
    norm = b" ".join(w)
    n = max(1, len(w) - shingle + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(norm, 42)  # one shingle: its bits are the majority
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.r_[0, ends[:-1]][:n]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(norm[s:e], 42) for s, e in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = h[i : i + (1 << 15)]
        votes += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(votes * 2 > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(x, shingle) for x in texts(b)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f.view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, top)]


def links(classes: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Links (a, b) between classes' fingerprints that join all classes within the radius."""
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    keys = F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for v, m in enumerate(covering_masks(radius))])
    tables = classes.select("fp", F.explode(keys).alias("k")).select("fp", "k.v", "k.key")
    sizes = stored(tables.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "op4-buckets")
    two = sizes.filter("n = 2").select("a", "b").filter(near)
    members = tables.join(sizes.filter("n > 2").select("v", "key", "n"), ["v", "key"])
    few = members.filter(F.col("n") <= bucket).groupBy("v", "key").agg(F.array_sort(F.collect_list("fp")).alias("m"))
    few = few.select("m", F.posexplode("m").alias("i", "a")).select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b")).filter(near)
    # the members of large buckets: fingerprints that share a point of their balls
    flips = [0] + [signed(sum(1 << i for i in c)) for k in range(1, radius // 2 + 1) for c in combinations(range(64), k)]
    large = members.filter(F.col("n") > bucket).select("fp").distinct()
    balls = large.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: F.col("fp").bitwiseXOR(x))).alias("centre"))
    low = balls.groupBy("centre").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("m")).filter(F.size("m") > 1)
    many = low.select("a", F.explode("m").alias("b")).filter("a <> b")
    return two.union(few).union(many).distinct()


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, bucket: int = 64) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    if radius % 2 or radius > 4:
        raise ValueError("the radius must be 0, 2 or 4")
    prints = stored(fingerprints(docs, shingle), "op4-prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "op4-classes")
    roots = stored(stars(links(classes, radius, bucket), "op4-stars"), "op4-roots")
    linked = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = linked.join(least, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def keepers(docs: DataFrame, least: tuple[int, int] = (4, 5), shingle: int = 5) -> DataFrame:
    """docs, in their columns, with one row of each group of near copies: that of the smallest doc_id.

    Groups join texts of a Jaccard similarity of 0.8 or more on their sets of five-word shingles: candidates of the
    covering tables and of MinHash tables, all verified (see similarity). Texts without a word stay, all of them.
    """
    found = stored(similarity.near_groups(docs, covering_masks(2), least, shingle), "near-found")
    keep = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("t") == F.col("keep_t"))
    gone = stored(found.filter(~keep).select("doc_id", "t").distinct(), "near-gone")
    again = found.filter(keep).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "t")
    return without(docs, gone, stored(again, "near-again"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
