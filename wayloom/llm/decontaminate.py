"""Benchmark decontamination: token windows of the test items as a broadcast hash set, verified hits.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased: on UTF-8 bytes one
translation table and a split. An item gives all its windows of `window` words; an item of fewer words,
but not none, is one window. The windows' hashes are broadcast, built once on the driver; a document's words
become numbers of the items' words, its runs of known words are hashed and looked up, and every hit is verified
word by word.

The items are broadcast in blocks of at most `block_bytes` of text (about 30 bytes a word): a larger benchmark takes
a pass over the documents for each block, one block on the executors at a time, and only documents with hits are
merged after, by doc_id and a hash of the text, so that rows without an id or with one id and different texts keep
their own hits. The result doesn't depend on the blocks.

Null and empty texts have no words. Items with a null id hit words but are not listed; a repeated id counts once.
Repeated rows get the same answer each, very long texts are read whole. Columns other than doc_id and text, item_id
and text don't matter. An empty benchmark leaves all documents clean; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import map_arrow, stored, table, text_hash, texts, unused, without

#: Bytes outside words become spaces, A-Z become a-z; bytes of 0x80 and above belong to words.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


_ODD = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n word numbers. Equal hashes are verified, so it need only spread."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    v = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    for j in range(n):
        h = h * _ODD + v[j : len(v) - n + 1 + j]
    return h ^ (h >> np.uint64(29))


class Windows:
    """The windows of a block of items as arrays, built once: the items' words as numbers, and for each window length
    the sorted hashes of the windows with the place and the item of each. About 30 bytes a word of the block."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        flat, at, by = [], 0, defaultdict(list)
        for k, (_, text) in enumerate(items):
            w = words(text)
            n = min(window, len(w))
            if n:
                flat.append(np.fromiter((self.numbers.setdefault(x, len(self.numbers)) for x in w), np.int32, len(w)))
                by[n].append((k, at, len(w) - n + 1))
                at += len(w)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, found in by.items():
            place = np.concatenate([np.arange(lo, lo + m, dtype=np.int32) for _, lo, m in found])
            item = np.repeat(np.array([k for k, _, _ in found], np.int32), [m for _, _, m in found])
            h = run_hashes(self.flat, n)[place]
            order = np.argsort(h, kind="stable")
            self.tables[n] = h[order], place[order], item[order]

    def scan(self, w: list[bytes]) -> tuple[np.ndarray, set]:
        """A mark for each word that is hit, and the items with occurring windows."""
        get = self.numbers.get
        ids = np.fromiter((get(x, -1) for x in w), np.int32, len(w))
        edges, hit = np.zeros(len(w) + 1, np.int64), set()
        unknown = np.r_[0, np.cumsum(ids < 0)]
        for n, (hashes, place, item) in self.tables.items():
            at = np.flatnonzero(unknown[n:] == unknown[:-n]) if len(w) >= n else ()
            if not len(at):
                continue
            h = run_hashes(ids, n)[at]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            count = (hi - lo)[some]
            i = np.repeat(at[some], count)
            j = np.repeat(lo[some] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            same = np.ones(len(i), bool)
            for k in range(n):
                same &= ids[i + k] == self.flat[place[j] + k]
            first = np.unique(i[same])
            np.add.at(edges, first, 1)
            np.add.at(edges, first + n, -1)
            hit.update(np.unique(item[j[same]]).tolist())
        return np.cumsum(edges[:-1]) > 0, {self.names[k] for k in hit}


def spans_of(marks: np.ndarray) -> list[dict]:
    """The maximal spans [lo, hi) of marked words."""
    steps = np.flatnonzero(np.diff(np.r_[0, marks.view(np.int8), 0]))
    return [{"lo": lo, "hi": hi} for lo, hi in zip(steps[::2].tolist(), steps[1::2].tolist(), strict=True)]


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of at most block_bytes of text, an item alone in a block if it is longer; one block comes to the driver at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        x = (row["t"] or "").encode()
        if held and size + len(x) > block_bytes:
            yield held
            held, size = [], 0
        held.append((row["i"], x))
        size += len(x)
    yield held


SCHEMA = "doc_id long, t long, n_words long, spans array<struct<lo:int,hi:int>>, items array<string>"
_ARROW = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def hits(docs: DataFrame, held: Broadcast, only_hit: bool) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for b in batches:
            rows, n, spans, found = [], [], [], []
            for k, x in enumerate(texts(b)):
                w = words(x)
                marks, hit = index.scan(w)
                if not only_hit or marks.any():
                    rows.append(k)
                    n.append(len(w))
                    spans.append(spans_of(marks))
                    found.append(sorted(x for x in hit if x is not None))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("t").take(at), pa.array(n, pa.int64()), pa.array(spans, _ARROW), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "t", "n_words", "spans", "items"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_hash().alias("t"), F.col("text").cast("string")), scan, SCHEMA)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8_000_000) -> DataFrame:
    """doc_id, t (the text's hash), n_words, spans (merged word spans that are hit), items (sorted ids) for every document row."""
    sc = docs.sparkSession.sparkContext
    todo = blocks(benchmark, block_bytes)
    one, next_one = next(todo), next(todo, None)
    held = sc.broadcast(Windows(one, window))
    first = hits(docs, held, False)
    if next_one is None:
        return first
    # each block's hits are written and its windows taken off the executors before the next block is read
    first, more = stored(first, "op2-first"), []
    while next_one is not None:
        held.unpersist()
        held = sc.broadcast(Windows(next_one, window))
        more.append(stored(hits(docs, held, True), "op2-more"))
        next_one = next(todo, None)
    held.unpersist()
    rest = more[0]
    for x in more[1:]:
        rest = rest.unionByName(x)
    rest = rest.groupBy(F.col("doc_id").alias("id"), F.col("t").alias("k")).agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    joined = first.join(rest, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("k")), "left")
    spans = F.array_sort(F.concat("spans", F.coalesce("s", F.expr("array()").cast("array<struct<lo:int,hi:int>>"))))
    merge = F.reduce(
        spans,
        F.expr("cast(array() as array<struct<lo:int,hi:int>>)"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["lo"] <= F.element_at(acc, -1)["hi"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["lo"].alias("lo"), F.greatest(F.element_at(acc, -1)["hi"], x["hi"]).alias("hi"))))).otherwise(F.concat(acc, F.array(x))),
    )
    ids = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i", F.expr("cast(array() as array<string>)")))))
    return joined.select("doc_id", "t", "n_words", merge.alias("spans"), ids.alias("items"))


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.reduce("spans", F.lit(0).cast("long"), lambda a, x: a + (x["hi"] - x["lo"]).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def drop_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, share: float = 0.0, block_bytes: int = 8_000_000) -> DataFrame:
    """The rows of which no more than `share` of the words is hit, in docs' columns. Each row is judged by its own text."""
    n_hit = F.reduce("spans", F.lit(0).cast("long"), lambda a, x: a + (x["hi"] - x["lo"]).cast("long"))
    bad = find(docs, benchmark, window, block_bytes).filter(F.size("spans") > 0).filter(n_hit > F.col("n_words") * share)
    bad = stored(bad.select("doc_id", "t").distinct(), "op2-bad")
    return without(docs, bad, bad.limit(0))


def drop_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8_000_000) -> DataFrame:
    """docs with the hit words cut out of text, and the separators inside a span with them; untouched texts stay as they are.

    All blocks of items judge the input text; only rows that are hit are shuffled.
    """
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    name, i, t = unused(docs, "spans"), unused(docs, "hit_id"), unused(docs, "hit_text")
    bad = find(docs, benchmark, window, block_bytes).filter(F.size("spans") > 0).select("doc_id", "t", "spans")
    bad = stored(bad.dropDuplicates(["doc_id", "t"]), "op2-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, spans in zip(texts(b), b.column(name).to_pylist(), strict=True):
                at = [m.span() for m in word.finditer(x)]
                keep, last = [], 0
                for s in spans:
                    keep.append(x[last : at[s["lo"]][0]])
                    last = at[s["hi"] - 1][1]
                out.append(b"".join([*keep, x[last:]]).decode())
            k = b.schema.get_field_index("text")
            yield b.set_column(k, b.schema.field(k), pa.array(out, b.schema.field(k).type)).drop_columns([name])

    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (text_hash() == F.col(t))
    hit = docs.join(bad.select(F.col("doc_id").alias(i), F.col("t").alias(t), F.col("spans").alias(name)), same).drop(i, t)
    return without(docs, bad, bad.limit(0)).union(map_arrow(hit, cut, docs.schema))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_aggregate(w[i : i + least(10, len(w)) - 1], 'string_agg', ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS g FROM d, ns, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
k AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM h), unnest(range(i, i + n)) AS t(p) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""
