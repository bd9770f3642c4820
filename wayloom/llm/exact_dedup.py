"""Exact dedup: counting quotient filters built per partition, merged by sorted remainders.

1. One pass over the texts gives a narrow table: doc_id, a 64-bit fingerprint and the SHA-256 of the
   text after replacing each run of ASCII white space by one space (null counts as empty).
2. Every partition of the narrow table builds counting quotient filters of its fingerprints, one for
   each range of quotients, and hands them over as bytes; the filters of a range are merged by sorted
   remainders, counts added, nothing lost: a fingerprint is its quotient and its whole remainder.
   A range holds `range_rows` rows' fingerprints in the mean, so no merge grows with the input.
3. Rows whose fingerprint has a count above one go to byte verification: a second reading of the texts
   passes only them (by the hash of the whole text), normalises them and groups them as bytes (partial sums
   before the shuffle), which gives the keeper and the group's size. No other text is shuffled.

Empty texts are equal to each other. Rows of one doc_id repeated are members like any other, ties in doc_id go
by the text's hash. Very long texts are hashed and compared whole. Columns other than doc_id and text don't
matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import SPACE, broadcast_if_small, counted, empty_text, map_arrow, stored, table, text_hash, texts, without

_RUN = re.compile(rb"[\x20\x09-\x0D]+")


class CountingQuotientFilter:
    """Fingerprints of 64 bits with counts, lossless, in three bits, a remainder and sometimes a count a slot.

    The slot of a fingerprint is its canonical one (the quotient) or the first free after it, in the
    order of the fingerprints; `occupied` marks the quotients that have a run, `runend` each run's last
    slot. Counts above one stand beside, by slot. Built from sorted input in one pass of array work.
    """

    def __init__(self, q: int, occupied: np.ndarray, runend: np.ndarray, used: np.ndarray, remainders: np.ndarray, many: np.ndarray, counts: np.ndarray):
        self.q, self.occupied, self.runend, self.used, self.remainders, self.many, self.counts = q, occupied, runend, used, remainders, many, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        f = np.asarray(fingerprints, np.uint64)[order]
        c = np.ones(len(f), np.int64) if counts is None else np.asarray(counts, np.int64)[order]
        first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]]) if len(f) else np.zeros(0, np.int64)
        c = np.add.reduceat(c, first) if len(f) else c
        f = f[first]
        q = max(1, int(len(f) * 4 // 3 + 1).bit_length())
        quotient = (f >> np.uint64(64 - q)).astype(np.int64)
        i = np.arange(len(f))
        slot = np.maximum.accumulate(quotient - i) + i  # never before the canonical slot or the slot of the one before
        size = max(1 << q, int(slot[-1]) + 1 if len(f) else 0)
        bits = lambda at: np.packbits(np.bincount(at, minlength=size).astype(bool))
        last = np.r_[quotient[1:] != quotient[:-1], True] if len(f) else np.zeros(0, bool)
        many = np.flatnonzero(c > 1)
        return cls(q, bits(np.unique(quotient)), bits(slot[last]), bits(slot), f & np.uint64((1 << (64 - q)) - 1), many.astype(np.int32), c[many])

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, ascending, and their counts: the runs in slot order belong to the occupied quotients in order."""
        slots = np.flatnonzero(np.unpackbits(self.used))
        ends = np.unpackbits(self.runend)[slots].astype(np.int64)
        run = np.cumsum(ends) - ends
        quotient = np.flatnonzero(np.unpackbits(self.occupied))[run] if len(slots) else slots
        counts = np.ones(len(slots), np.int64)
        counts[self.many] = self.counts
        return (quotient.astype(np.uint64) << np.uint64(64 - self.q)) | self.remainders, counts

    def to_bytes(self) -> bytes:
        parts = [x.tobytes() for x in (self.occupied, self.runend, self.used, self.remainders, self.many, self.counts)]
        return struct.pack("<7q", self.q, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, blob: bytes) -> CountingQuotientFilter:
        q, *sizes = struct.unpack_from("<7q", blob)
        at, parts = 56, []
        for n, kind in zip(sizes, (np.uint8, np.uint8, np.uint8, np.uint64, np.int32, np.int64), strict=True):
            parts.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at))
            at += n
        return cls(q, *parts)


def merged(filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
    """Merges all filters at once: their sorted runs, one after the other, are merged run by run and counts added."""
    pairs = [x.items() for x in filters]
    if not pairs:
        return CountingQuotientFilter.build(np.zeros(0, np.uint64))
    return CountingQuotientFilter.build(np.concatenate([f for f, _ in pairs]), np.concatenate([c for _, c in pairs]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, t (the text's hash), fp long, sha binary of the normalised text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, sha = [], []
            for x in texts(b):
                x = _RUN.sub(b" ", x)
                fp.append(xxhash.xxh3_64_intdigest(x))
                sha.append(hashlib.sha256(x).digest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sha, pa.binary())], names=["doc_id", "t", "fp", "sha"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_hash().alias("t"), F.col("text").cast("string")), scan, "doc_id long, t long, fp long, sha binary")


def repeated(narrow: DataFrame, rows: int, range_rows: int = 4_000_000, block: int = 500_000) -> DataFrame:
    """fp, n of the fingerprints with a count above one, by merged counting quotient filters."""
    ranges = max(1, min(1 << 20, -(-rows // range_rows)))
    width = -(-(1 << 64) // ranges)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            f = np.sort(np.concatenate(held))
            held.clear()
            edges = np.searchsorted(f, np.array([i * width for i in range(ranges)], np.uint64))
            ids, blobs = [], []
            for i, (lo, hi) in enumerate(zip(edges, [*edges[1:], len(f)], strict=True)):
                if hi > lo:
                    ids.append(i)
                    blobs.append(CountingQuotientFilter.build(f[lo:hi]).to_bytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "filter"])

        for b in batches:
            held.append(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= block:
                yield from flush()
        yield from flush()

    def merge(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range: one range's filters are held at a time, and merged at once."""
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            f, c = merged(held).items()
            yield pa.RecordBatch.from_arrays([pa.array(f[c > 1].view(np.int64)), pa.array(c[c > 1])], names=["fp", "n"])

        for b in groups:
            for part, blob in zip(b.column("part").to_pylist(), b.column("filter"), strict=True):
                if part != now and held:
                    yield from out()
                    held = []
                now = part
                held.append(CountingQuotientFilter.from_bytes(blob.as_py()))
        if held:
            yield from out()

    parts = map_arrow(narrow.select("fp"), local, "part int, filter binary")
    return map_arrow(parts.repartition(ranges, "part").sortWithinPartitions("part"), merge, "fp long, n long")


def grouped(docs: DataFrame, small: int = 1_000_000) -> DataFrame:
    """doc_id, t, sha, keep (none, doc_id, t of the row that stays), group_size for every row; keep is null where the text is alone."""
    narrow, rows, _ = counted(fingerprints(docs), "op9-narrow")
    dup = stored(repeated(narrow, rows), "op9-repeated")
    # the texts that share a fingerprint, told by their hash as they are read: no other text is normalised again or shuffled
    wanted = stored(narrow.join(dup, "fp", "left_semi").select("t").distinct(), "op9-wanted")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", text_hash())
    some = some.join(broadcast_if_small(wanted, small), "t", "left_semi")
    norm = some.select("doc_id", "t", F.regexp_replace(empty_text("text"), SPACE, " ").alias("norm"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    verified = norm.groupBy("norm").agg(F.min(first).alias("keep"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = stored(verified.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep", "group_size"), "op9-groups")
    return narrow.drop("fp").join(groups, "sha", "left")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    keep = F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id"))
    return grouped(docs).select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keepers(docs: DataFrame) -> DataFrame:
    """docs, in their columns, with one row of each group of equal texts: that of the smallest doc_id.

    Rows of one doc_id and different texts are judged one by one. Rows without a doc_id come after all others; of
    several rows of the keeper's doc_id one stays, by text and columns.
    """
    found = stored(grouped(docs), "op9-found")
    keep = F.col("keep").isNull() | F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("t") == F.col("keep.t"))
    gone = stored(found.filter(~keep).select("doc_id", "t").distinct(), "op9-gone")
    again = found.filter(keep).groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "t")
    return without(docs, gone, stored(again, "op9-again"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM a
"""
