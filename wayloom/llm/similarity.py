"""Near copies by Jaccard similarity of word shingles: the candidates and their verification for SimHash dedup.

A text's words are lower-cased (A-Z) and split at ASCII white space; its set holds the runs of five words, as 64-bit
hashes; a shorter text is one run. Equal sets are one class. A class has 39 table keys: the seven covering masks of
radius 2 over a SimHash of its set, and 32 keys of four MinHash minima each. At a similarity of 0.8 most pairs differ
in 4 to 12 of 64 SimHash bits, beyond any covering code of bearable size, so the MinHash tables carry the recall: a
pair of exactly 0.8 shares none of them once in 20 million (0.5904^32), more similar ones less often.

Every candidate is compared: first by 128 minima of 8 bits (below 75 equal ones a pair of 0.8 falls once in a billion),
then by the shingle sets themselves, so no pair below the similarity is linked. Two rounds keep the comparisons few:

1. the members of a bucket are compared with its centre: the one that agrees in most minima with the bucket's
   commonest values, mostly the original of a group of copies;
2. pairs of a bucket whose members are not yet in one component are compared in the task that has the bucket, each in
   the first table alone in which it meets, so that only links leave it; buckets above `block` members are cut into
   cells of two blocks, so that no task holds a bucket. A pair that is left out joins what is joined already.

Texts without a word are near nothing. Columns other than doc_id and text don't matter; rows of one doc_id and
different texts are told apart by the text's hash. An empty table gives an empty result; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import broadcast_if_small, map_arrow, mixed, run_hashes, stored, text_hash, texts, word_hashes
from wayloom.llm.components import stars

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
TABLES, ROWS = 32, 4
SIGNS = TABLES * ROWS
_RNG = np.random.default_rng(42)
_A = _RNG.integers(0, 1 << 32, SIGNS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, SIGNS, dtype=np.uint32)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, shingle: int = 5) -> np.ndarray:
    """The sorted hashes of the different runs of words."""
    v = word_hashes(text.translate(_LOWER))
    if not len(v):
        return v
    h = np.sort(run_hashes(v, min(shingle, len(v))))
    return h[np.r_[True, h[1:] != h[:-1]]]


def simhash_of(h: np.ndarray) -> int:
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 13):
        votes += np.unpackbits(h[i : i + (1 << 13)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(votes * 2 > len(h)).tolist()))


def signs_of(h: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The keys of a set in every table, and the low bytes of its minima."""
    x, low = (h >> np.uint64(32)).astype(np.uint32), np.full(SIGNS, 0xFFFFFFFF, np.uint32)
    held = np.empty((min(len(x), 1024), SIGNS), np.uint32)
    for i in range(0, len(x), 1024):
        some = held[: len(x) - i]
        np.multiply(x[i : i + 1024, None], _A, out=some)
        some += _B
        np.minimum(low, some.min(0), out=low)
    key = np.arange(TABLES, dtype=np.uint64)
    for row in low.reshape(TABLES, ROWS).T.astype(np.uint64):
        key = mixed(key * _ODD + row)
    cover = mixed((masks & np.uint64(simhash_of(h))) * _ODD + np.arange(TABLES, TABLES + len(masks), dtype=np.uint64))
    return np.r_[key, cover].view(np.int64), mixed(low.astype(np.uint64)).astype(np.uint8).tobytes()


def node_of(h: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(h.tobytes(), 7)], np.uint64).view(np.int64)[0])


def prints(docs: DataFrame, shingle: int, masks: list[int]) -> DataFrame:
    """doc_id, t, node, keys, signs of every row with a word."""
    cover = np.array(masks, np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, nodes, keys, signs = [], [], [], []
            for i, x in enumerate(texts(b)):
                h = shingles(x, shingle)
                if len(h):
                    rows.append(i)
                    nodes.append(node_of(h))
                    k, s = signs_of(h, cover)
                    keys.append(k)
                    signs.append(s)
            at = pa.array(rows, pa.int64())
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (TABLES + len(cover)))
            flat = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("t").take(at), pa.array(nodes, pa.int64()), flat, pa.array(signs, pa.binary())], names=["doc_id", "t", "node", "keys", "signs"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_hash().alias("t"), F.col("text").cast("string")), scan, "doc_id long, t long, node long, keys array<long>, signs binary")


def _signs(c: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SIGNS)


def likely(pairs: DataFrame, classes: DataFrame, agree: int) -> DataFrame:
    """The pairs (a, b) of classes that agree in enough of their minima."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = (_signs(b.column("x")) == _signs(b.column("y"))).sum(1)
            yield b.select(["a", "b"]).filter(pa.array(same >= agree))

    both = pairs.join(classes.select(F.col("node").alias("a"), F.col("signs").alias("x")), "a").join(classes.select(F.col("node").alias("b"), F.col("signs").alias("y")), "b")
    return map_arrow(both.select("a", "b", "x", "y"), scan, "a long, b long")


def sets_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """node, s: the sorted shingle hashes of the classes in nodes, stored. Their texts are told by their hash as docs is read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(x, shingle) for x in texts(b)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(h) for h in sets], pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["node", "s"])

    one = stored(classes.join(nodes.distinct(), "node", "left_semi").select("t").distinct(), "near-wanted")
    some = docs.select(text_hash().alias("t"), F.col("text").cast("string")).join(broadcast_if_small(one, 1_000_000), "t", "left_semi")
    return stored(map_arrow(some.dropDuplicates(["t"]).select("text"), scan, "node long, s array<long>"), "near-sets")


def alike(x: np.ndarray, y: np.ndarray, least: tuple[int, int]) -> bool:
    p, q = least
    if max(len(x), len(y)) * p > min(len(x), len(y)) * q:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * q >= (len(x) + len(y) - both) * p


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, least: tuple[int, int], shingle: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets have a similarity of least[0] / least[1] or more, stored."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [alike(np.asarray(x.values), np.asarray(y.values), least) for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stored(pairs, "near-pairs")
    if pairs.isEmpty():
        return pairs
    sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs, classes, shingle)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return stored(map_arrow(both.select("a", "b", "x", "y"), compare, "a long, b long"), "near-links")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows of equal keys, of rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        rows = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k] != rows[start]:
                if rows[start] != now and held:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                now = rows[start]
                held.append(b.slice(start, k - start))
                start = k
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def centres(members: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """key, a: the member of each bucket that agrees in most minima with the bucket's commonest values, block by block the best."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["key", "part"]):
            signs = _signs(t.column("signs"))
            common = np.array([np.bincount(c).argmax() for c in signs.T], np.uint8) if len(signs) > 2 else signs[0]
            same = (signs == common).sum(1)
            best = int(same.argmax())
            yield pa.RecordBatch.from_arrays([t.column("key").combine_chunks()[:1], t.column("node").combine_chunks()[best : best + 1], pa.array([int(same[best])])], names=["key", "node", "same"])

    rows = members.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block))).join(classes.select("node", "signs"), "node")
    best = map_arrow(rows.select("key", "part", "node", "signs").repartition("key", "part").sortWithinPartitions("key", "part", "node"), scan, "key long, node long, same long")
    return best.groupBy("key").agg(F.max_by("node", F.struct("same", "node")).alias("a"))


def across(rooted: DataFrame, classes: DataFrame, sets: DataFrame, least: tuple[int, int], agree: int, block: int) -> DataFrame:
    """Links (a, b) of different components within the buckets of (key, at, node, root), cell by cell.

    A pair is compared in the first table alone in which its keys agree, and its sets at once, in the same task.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["key", "i", "j"]):
            node, root, part = (t.column(c).to_numpy() for c in ("node", "root", "part"))
            at, signs = t.column("at")[0].as_py(), _signs(t.column("signs"))
            keys = np.array(t.column("keys").to_pylist(), np.int64)
            held = t.column("s").combine_chunks()
            one = bool((part == part[0]).all())
            a, b = [], []
            for i in range(len(node)):
                others = np.flatnonzero(root != root[i])
                others = others[others > i] if one else others[part[others] > part[i]]
                others = others[(signs[others] == signs[i]).sum(1) >= agree]
                others = others[(keys[others] == keys[i]).argmax(1) == at]
                for j in others.tolist():
                    if alike(np.asarray(held[i].values), np.asarray(held[j].values), least):
                        a.append(int(min(node[i], node[j])))
                        b.append(int(max(node[i], node[j])))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sizes = rooted.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    rows = rooted.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    # a cell of a block with itself serves the pairs inside the block; of two blocks, those between them
    cells = cells.join(classes.select("node", "keys", "signs"), "node").join(sets, "node")
    dealt = cells.select("key", "at", "i", "j", "part", "node", "root", "keys", "signs", "s").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return map_arrow(dealt, scan, "a long, b long")


def near_groups(docs: DataFrame, masks: list[int], least: tuple[int, int] = (4, 5), shingle: int = 5, block: int = 1024, agree: int = 75) -> DataFrame:
    """doc_id, t (the text's hash), component_id, keep_t for every row with a word.

    component_id is the smallest doc_id of the component (null last), keep_t the smallest hash of that id's texts.
    """
    rows = stored(prints(docs, shingle, masks), "near-prints")
    classes = stored(rows.groupBy("node").agg(F.min("t").alias("t"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first"), F.first("keys").alias("keys"), F.first("signs").alias("signs")), "near-classes")
    tables = classes.select("node", F.posexplode("keys").alias("at", "key"))
    sizes = tables.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("a")).filter("n > 1")
    members = stored(tables.join(sizes, "key"), "near-members")
    middle = centres(members.filter("n > 2"), classes, block)
    star = members.filter("n > 2").drop("a").join(middle, "key").select("a", "node").union(members.filter("n = 2").select("a", "node"))
    star = star.filter("a <> node").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    links = verified(likely(star, classes, agree), docs, classes, least, shingle)
    roots = stored(stars(links, "near-stars"), "near-roots")
    rooted = members.filter("n > 2").join(roots, "node", "left").select("key", "at", "node", F.coalesce("root", "node").alias("root"))
    mixed_keys = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("key")
    apart = stored(rooted.join(mixed_keys, "key"), "near-apart")
    if not apart.isEmpty():
        sets = sets_of(apart.select("node"), docs, classes, shingle)
        rest = stored(across(apart, classes, sets, least, agree, block), "near-links")
        if not rest.isEmpty():
            roots = stored(stars(links.union(rest), "near-stars"), "near-roots")
    linked = classes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    ids = linked.join(linked.groupBy("root").agg(F.min("first").alias("keep")), "root").select("node", F.col("keep.doc_id").alias("component_id"), F.col("keep.t").alias("keep_t"))
    return rows.select("doc_id", "t", "node").join(ids, "node").select("doc_id", "t", "component_id", "keep_t")
