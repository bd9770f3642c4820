"""Substring dedup: words covered by a window of 50 words that also starts in a document of smaller doc_id go.

Suffix automata of the reference text do the matching, one for each shard of the corpus. To broadcast the
automata of all shards to all documents would cost shards times documents; here both sides of a shard are
brought together by anchors instead:

1. A window's anchor is the smallest hash of its 10-word runs. Equal windows have equal anchors, and neighbouring
   windows of one anchor form a segment (about 20 windows). Anchors of a single document are done with.
2. Equal pieces (segments' words) of an anchor are one, grouped by their words with the smallest doc_id; later
   documents lose all of such a piece.
3. The differing pieces of an anchor are a shard. In the order of doc_id, each streams through the suffix automaton of
   those of smaller doc_id (matching statistics), then extends it. Where the statistic reaches the length of a window,
   the window is a repeat.
4. An anchor of more than `large` differing pieces would outgrow a task and is parted first: its windows' hashes are
   counted, those of one document are dropped, and the rest of a piece is cut where the set of documents changes (told
   by its first, its last and the number of pieces). So a passage that many documents share loses what stands around it,
   and stays in one part; the parts are shards.
5. The spans of a document are united, and its kept words are written once more.

Hashes only bring pieces together: whether words are equal is decided by the words alone, here and in the automata.

The spans are judged on the input. Null and empty texts have no words, very long ones are read whole. Rows without
doc_id are kept whole and serve as no reference. Rows of one doc_id don't remove each other's words; if their texts
differ each loses its own spans. Of several documents with a window that of the smallest doc_id keeps it, ties don't
arise beyond that. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.llm.common import map_arrow, run_hashes, stored, table, text_hash, texts, word_hashes

def segments(text: bytes, window: int, run: int = 10) -> tuple[int, tuple[np.ndarray, ...] | None]:
    """The number of words, and anchor, first window, number of windows: arrays with an element a segment."""
    h = word_hashes(text)
    if len(h) < window:
        return len(h), None
    low, have, need = run_hashes(h, min(run, window)), 1, window - min(run, window) + 1
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    return len(h), (low[first], first, np.diff(np.r_[first, len(low)]))


class SuffixAutomaton:
    """Suffix automaton of several word sequences, extended online."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _state(self, length: int, link: int, follow: dict) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, w, q: int) -> int:
        copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, p: int, w) -> int:
        q = self.next[p].get(w)
        if q is not None:
            return q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        new = self._state(self.len[p] + 1, 0, {})
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, w, q)
        return new

    def statistics(self, words: list) -> Iterator[int]:
        """For each word the length of the longest suffix up to it that occurs in the sequences."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            to = self.next[state].get(w)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            yield length

    def spans(self, words: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans [from, to) covered by matches of at least `least` words."""
        out: list[list[int]] = []
        for end, length in enumerate(self.statistics(words), 1):
            if length >= least:
                if out and end - least <= out[-1][1]:
                    out[-1][1] = end
                else:
                    out.append([end - least, end])
        return [(lo, hi) for lo, hi in out]


_SEGS = pa.list_(pa.struct([("anchor", pa.int64()), ("first", pa.int32()), ("count", pa.int32())]))
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def segment_table(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, t (the text's hash), n_words, sha of all words, segments."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, sizes, parts = [], [], [0], []
            for x in texts(b):
                words, got = segments(x, window)
                n.append(words)
                digests.append(sha(x.split()))
                sizes.append(sizes[-1] + (len(got[0]) if got else 0))
                if got:
                    parts.append(got)
            anchor, first, count = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in range(3))
            struct = pa.StructArray.from_arrays([pa.array(anchor.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], fields=list(_SEGS.value_type))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), struct)], names=["doc_id", "t", "n_words", "sha", "segs"])

    return map_arrow(docs.select("doc_id", "t", "text"), scan, "doc_id long, t long, n_words long, sha binary, segs array<struct<anchor:long,first:int,count:int>>")


def pieces_of(docs: DataFrame) -> DataFrame:
    """anchor, doc_id, t, first, n, words of the ranges (anchor, first, n) in docs' column ranges."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, t, x, ranges in zip(b.column("doc_id").to_pylist(), b.column("t").to_pylist(), texts(b), b.column("ranges").to_pylist(), strict=True):
                w = x.split()
                rows += [(r["anchor"], doc_id, t, r["first"], r["n"], b" ".join(w[r["first"] : r["first"] + r["n"]])) for r in ranges]
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=False)), pa.array(cols[5], pa.binary()).cast(pa.string())], names=["anchor", "doc_id", "t", "first", "n", "words"])

    return map_arrow(docs.select("doc_id", "t", "text", "ranges"), scan, "anchor long, doc_id long, t long, first int, n int, words string")


def windows_of(distinct: DataFrame, window: int) -> DataFrame:
    """anchor, words, d0, d1, at, key: the hash of each window of the pieces."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for x in texts(b, "words"):
                w = x.split(b" ")
                keys.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(w[i : i + window])) for i in range(len(w) - window + 1)], np.uint64).view(np.int64))
            yield b.append_column("keys", pa.array(keys, pa.list_(pa.int64())))

    found = map_arrow(distinct.select("anchor", "words", "d0", "d1"), scan, "anchor long, words string, d0 long, d1 long, keys array<long>")
    return found.select("anchor", "words", "d0", "d1", F.posexplode("keys").alias("at", "key"))


def parted(distinct: DataFrame, window: int) -> DataFrame:
    """anchor, words, lo, n, part, piece, d0, d1: the pieces of large anchors, cut where the windows' documents change.

    A window that only one document has is dropped. The others' part is made of the first and the last document and the
    number of pieces that have the window: equal windows are in equal parts.
    """
    wins = stored(windows_of(distinct, window), "op8-windows")
    seen = wins.groupBy("anchor", "key").agg(F.min("d0").alias("x"), F.max("d1").alias("y"), F.count(F.lit(1)).alias("m")).filter("x <> y")
    parts = stored(seen.select("anchor", "key", F.xxhash64("x", "y", "m").alias("part")), "op8-parts")
    inside = wins.join(parts, ["anchor", "key"])
    # a run of neighbouring windows of one piece and part: their place less their number in the piece and part is the same
    number = F.row_number().over(Window.partitionBy("anchor", "words", "part").orderBy("at"))
    runs = inside.select("anchor", "words", "d0", "d1", "part", "at", (F.col("at") - number).alias("run"))
    runs = runs.groupBy("anchor", "words", "d0", "d1", "part", "run").agg(F.min("at").alias("lo"), (F.count(F.lit(1)) + (window - 1)).cast("int").alias("n"))
    piece = F.array_join(F.slice(F.split("words", " ", -1), F.col("lo") + 1, F.col("n")), " ")
    return runs.select("anchor", "words", "lo", "n", "part", piece.alias("piece"), "d0", "d1")


def shard_spans(distinct: DataFrame, window: int) -> DataFrame:
    """distinct (anchor, part, words, d0) with spans: in the order of d0 each streams through the automaton of those of smaller d0."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = doc = None
        automaton, waiting = SuffixAutomaton(), []
        for b in batches:
            found = []
            for a, p, d, words in zip(b.column("anchor").to_pylist(), b.column("part").to_pylist(), b.column("d0").to_pylist(), b.column("words").to_pylist(), strict=True):
                if (a, p) != shard:
                    shard, doc, automaton, waiting = (a, p), d, SuffixAutomaton(), []
                elif d != doc:
                    for x in waiting:
                        automaton.add(x)
                    doc, waiting = d, []
                w = words.split(" ")
                found.append([{"lo": lo, "hi": hi} for lo, hi in automaton.spans(w, window)])
                waiting.append(w)
            yield b.append_column("spans", pa.array(found, _SPANS))

    dealt = distinct.select("anchor", "part", "words", "d0").repartition("anchor", "part").sortWithinPartitions("anchor", "part", "d0", "words")
    return map_arrow(dealt, match, "anchor long, part long, words string, d0 long, spans array<struct<lo:int,hi:int>>")


def matched(distinct: DataFrame, window: int) -> DataFrame:
    """distinct (anchor, part, words, d0, d1) with spans: those of its windows that occur in documents before d0."""
    key = ["anchor", "part"]
    shards = stored(distinct.groupBy(*key).agg(F.min("d0").alias("x"), F.max("d0").alias("y")).filter("x <> y").select(*key), "op8-shards")
    alone = distinct.join(shards, key, "left_anti").filter("d0 <> d1").select(*key, "words", "d0", F.expr("cast(array() as array<struct<lo:int,hi:int>>)").alias("spans"))
    return alone.union(shard_spans(distinct.join(shards, key, "left_semi"), window))


def kept_table(docs: DataFrame) -> DataFrame:
    """docs with spans: doc_id, t, n_removed, sha and text of the kept words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digests, out = [], [], []
            for x, spans in zip(texts(b), b.column("spans").to_pylist(), strict=True):
                w = x.split()
                drop = np.zeros(len(w), bool)
                for s in spans:
                    drop[s["lo"] : s["hi"]] = True
                keep = [w[i] for i in np.flatnonzero(~drop).tolist()]
                n.append(len(w) - len(keep))
                digests.append(sha(keep))
                out.append(b" ".join(keep).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(out, pa.string())], names=["doc_id", "t", "n_removed", "kept_sha", "kept_text"])

    return map_arrow(docs.select("doc_id", "t", "text", "spans"), scan, "doc_id long, t long, n_removed long, kept_sha binary, kept_text string")


def dedup(docs: DataFrame, window: int = 50, large: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, n_words, sha) of every row, and (doc_id, t, n_removed, kept_sha, kept_text) of the texts that lose words.

    large: differing pieces of an anchor that one automaton takes whole (about 28 KB each); anchors of more are parted.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("t", text_hash())
    base = stored(segment_table(docs, window), "op8-segments")
    segs = base.filter("doc_id is not null").select("doc_id", "t", F.inline("segs"))
    shared = stored(segs.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x <> y").select("anchor"), "op8-shared")
    found = segs.join(shared, "anchor").select("doc_id", "t", F.struct("anchor", "first", (F.col("count") + (window - 1)).cast("int").alias("n")).alias("r"))
    wanted = stored(found.groupBy("doc_id", "t").agg(F.collect_set("r").alias("ranges")), "op8-wanted")
    texts_of = stored(docs.dropDuplicates(["doc_id", "t"]).join(wanted, ["doc_id", "t"]), "op8-texts")
    pieces = stored(pieces_of(texts_of), "op8-pieces")
    whole = F.lit(0).cast("long").alias("part")
    distinct = stored(pieces.groupBy("anchor", "words").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")), "op8-distinct")
    crowded = stored(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > large).select("anchor"), "op8-crowded")
    one = lambda lo, d0: F.array(F.struct(lo.alias("lo"), d0.alias("d0"), F.col("spans"), F.col("n")))
    some = distinct.withColumn("n", F.size(F.split("words", " ", -1)))
    found = matched((some if crowded.isEmpty() else some.join(crowded, "anchor", "left_anti")).select("anchor", whole, "words", "d0", "d1"), window)
    found = found.withColumn("n", F.size(F.split("words", " ", -1))).select("anchor", "words", one(F.lit(0), F.col("d0")).alias("parts"))
    if not crowded.isEmpty():
        cut = stored(parted(distinct.join(crowded, "anchor", "left_semi"), window), "op8-cut")
        small = cut.groupBy("anchor", "part", F.col("piece").alias("words")).agg(F.min("d0").alias("d0"), F.max("d1").alias("d1"))
        own = stored(matched(stored(small, "op8-parted"), window), "op8-own")
        back = cut.drop("d0", "d1").join(own.withColumnRenamed("words", "piece"), ["anchor", "part", "piece"])
        found = found.union(back.groupBy("anchor", "words").agg(F.collect_list(F.struct("lo", "d0", "spans", "n")).alias("parts")))
    # written, so that the join below has an exchange on both sides and Spark can split a very common piece
    found = stored(found, "op8-matched")
    hit = pieces.join(found, ["anchor", "words"]).select("doc_id", "t", "first", F.inline("parts"))
    all_of = F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi")))
    hit = hit.select("doc_id", "t", (F.col("first") + F.col("lo")).alias("at"), F.inline(F.when(F.col("doc_id") > F.col("d0"), all_of).otherwise(F.col("spans"))).alias("from", "to"))
    spans = hit.groupBy("doc_id", "t").agg(F.collect_list(F.struct((F.col("at") + F.col("from")).alias("lo"), (F.col("at") + F.col("to")).alias("hi"))).alias("spans"))
    lost = texts_of.select("doc_id", "t", "text").join(stored(spans, "op8-spans"), ["doc_id", "t"])
    return base.drop("segs"), stored(kept_table(lost), "op8-kept")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(*dedup(table(spark, sf_dir, "documents")))


def digest(base: DataFrame, cut: DataFrame) -> DataFrame:
    out = base.join(cut.drop("kept_text").withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")) & (base.t == cut.t), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.lower(F.hex(F.coalesce("kept_sha", "sha"))).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(list_aggregate(w[i : i + 49], 'string_agg', ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
f AS (SELECT doc_id, i FROM g JOIN (SELECT h, min(doc_id) AS d0 FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)) USING (h) WHERE doc_id > d0),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM f, unnest(range(i, i + 50)) AS t(p) GROUP BY doc_id),
k AS (SELECT d.doc_id, w, CASE WHEN gone IS NULL THEN w ELSE [w[p] for p in range(1, len(w) + 1) if NOT list_contains(gone, p)] END AS kept FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(kept) AS BIGINT) AS n_removed, sha256(coalesce(list_aggregate(kept, 'string_agg', ' '), '')) AS kept_sha256 FROM k
"""
