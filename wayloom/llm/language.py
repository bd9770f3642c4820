"""Language ID by prediction by partial matching: byte context trees of up to four bytes, one for each language.

Learned from rows with a language: documents are drawn by a hash of doc_id, about `sample_docs` a language (a documented
bound; all rows where there are fewer), their lower-cased bytes counted in runs of five on the executors. The tree of a
language holds the counts of each byte after each context of 4, 3, 2, 1 and 0 bytes, all of them. An escape from a context
with total t and q different bytes costs -log2(q / (t + q)), a byte seen c times there -log2(c / (t + q)), and an unknown
byte 8 bits at last: PPM with method C, without exclusions, under frozen statistics. A context that a language has not
seen is left without cost, so the order varies from byte to byte.

The code lengths of every learned run are tabulated once, exactly, for `block` languages at a time, and broadcast: about
12 + 4 * block bytes for each different run of these languages' samples. A byte's length is looked up by its longest run
that any of the languages has; escapes on the way down are added for those that know the context. Beyond `block`
languages each block is a pass over the documents, one on the driver and the executors at a time, and the blocks' least
lengths are merged by the text's hash. The least length wins, ties go to the first language by code point; the score is
the winner's probability among all languages, all equally likely before. No language, context or count is left out.

Null and empty texts, and texts without a letter, are `und` with score 0; so is all if nothing can be learned. Very long
texts are read whole. lang, source and doc_id are no inputs of a prediction. A null doc_id is not learned from and not held
out. Repeated rows get the same answer each. No rows give no rows. Columns other than doc_id, text and lang don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import broadcast_if_small, map_arrow, stored, table, text_hash, without

_LETTER = re.compile(r"[^\W\d_]")
ORDER = 4


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def has_letter(text: str) -> bool:
    m = _LETTER.search(text)
    return m is not None and (m.group().isalpha() or any(map(str.isalpha, text)))


def lowered_bytes(text: str) -> np.ndarray:
    """The bytes of a text after as many zeros as a context has bytes."""
    return np.frombuffer(bytes(ORDER) + text.lower().encode(), np.uint8)


def runs_at(x: np.ndarray) -> np.ndarray:
    """The run of ORDER + 1 bytes that ends at each byte but the first ORDER."""
    y = x.astype(np.uint64)
    g = y[: len(y) - ORDER].copy()
    for k in range(1, ORDER + 1):
        g = g << np.uint64(8) | y[k : len(y) - ORDER + k]
    return g


def runs(texts: list[str]) -> np.ndarray:
    """The runs that end at each byte of each text."""
    joined = np.concatenate([lowered_bytes(t) for t in texts] or [np.zeros(0, np.uint8)])
    if len(joined) <= ORDER:
        return np.zeros(0, np.uint64)
    g = runs_at(joined)
    return g[g & np.uint64(0xFF) != 0]


def counts(docs: DataFrame, sample_docs: int) -> DataFrame:
    """lang, gram, n, stored: the distinct runs of every language's sample with their counts."""
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    share = stored(learn.groupBy("lang").agg((sample_docs / F.count(F.lit(1))).alias("p")), "op6-languages")
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)
    drawn = learn.join(broadcast_if_small(share, 100_000), "lang").filter(place < F.col("p")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                by.setdefault(lang, []).append(text.as_py())
            for lang, held in by.items():
                for i in range(0, len(held), 256):
                    g, n = np.unique(runs(held[i : i + 256]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return stored(map_arrow(drawn, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "op6-grams")


class Index:
    """Places of keys: open addressing in arrays, at most half full."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(2 * len(keys) + 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several the last one stays
            put = self.slots[at] == left
            left, at = left[~put], (at[~put] + 1) & (len(self.slots) - 1)

    def _home(self, q: np.ndarray) -> np.ndarray:
        return ((q + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, q: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it isn't there."""
        if not len(self.keys):
            return np.full(len(q), -1, np.int32)
        at = self._home(q)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != q))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
            out[todo] = got = self.slots[at[todo]]
            todo = todo[(got >= 0) & (self.keys[got] != q[todo])]
        return out


class Model:
    """Code lengths of all learned runs of a block of languages: an index and a matrix (runs x languages) for each order,
    and the escapes' lengths (contexts x languages)."""

    def __init__(self, langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.lengths: list[tuple[Index, np.ndarray]] = []
        self.escapes: list[tuple[Index, np.ndarray]] = []
        k = len(langs)
        for order in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            cut = [g & mask for g, _ in grams]
            keys = np.unique(np.concatenate(cut)) if cut else np.zeros(0, np.uint64)
            c = np.zeros((len(keys), k))
            for j, (x, (_, n)) in enumerate(zip(cut, grams, strict=True)):
                c[:, j] = np.bincount(np.searchsorted(keys, x), weights=n, minlength=len(keys))
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            t, q = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            for j in range(k):
                t[:, j] = np.bincount(of, weights=c[:, j], minlength=len(contexts))
                q[:, j] = np.bincount(of, weights=c[:, j] > 0, minlength=len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                own = -np.log2(c / (t + q)[of])
                escape = np.where(q > 0, -np.log2(q / (t + q)), 0.0)
            if order:
                index, lower = self.lengths[-1]
                below = lower[index.find(keys & (mask >> np.uint64(8)))].astype(np.float64)
            else:
                below = np.full((len(keys), k), 8.0)
            self.lengths.append((Index(keys), np.where(c > 0, own, escape[of] + below).astype(np.float32)))
            self.escapes.append((Index(contexts), escape.astype(np.float32)))

    def costs(self, g: np.ndarray) -> np.ndarray:
        """Code lengths of the last bytes of runs, runs x languages."""
        out = np.zeros((len(g), len(self.langs)), np.float32)
        left = np.arange(len(g))
        for order in range(ORDER, -1, -1):
            g = g & np.uint64((1 << 8 * (order + 1)) - 1)
            index, lengths = self.lengths[order]
            at = index.find(g)
            known = at >= 0
            if known.all():
                out[left] += lengths[at]
                return out
            out[left[known]] += lengths[at[known]]
            left, g = left[~known], g[~known]
            index, escape = self.escapes[order]
            at = index.find(g >> np.uint64(8))
            some = at >= 0
            out[left[some]] += escape[at[some]]
        out[left] += 8.0
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code lengths in bits, texts x languages. Long texts are read in pieces, many short ones together."""
        out = np.zeros((len(texts), len(self.langs)))
        held, size, first = [], 0, 0

        def flush() -> None:
            x = np.concatenate(held)
            costs, at = self.costs(runs_at(x)), 0
            for i, h in enumerate(held):
                out[first + i] = costs[at : at + len(h) - ORDER].sum(0, dtype=np.float64)
                at += len(h)

        for i, text in enumerate(texts):
            x = lowered_bytes(text)
            if len(x) > 1 << 18:
                for lo in range(0, len(x) - ORDER, 1 << 18):
                    out[i] += self.costs(runs_at(x[lo : lo + (1 << 18) + ORDER])).sum(0, dtype=np.float64)
                x = x[:0]
            if held and (size + len(x) > 1 << 18 or not len(x)):
                flush()
                held, size = [], 0
            if len(x):
                first = first if held else i
                held.append(x)
                size += len(x)
        if held:
            flush()
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language, its code length, and the sum of all languages' probabilities over its own."""
        b = self.bits(texts)
        best, least = b.argmin(1), b.min(1)
        return [self.langs[i] for i in best], least, np.exp2(least[:, None] - b).sum(1)


class Trained:
    """The stored counts and the learned languages in blocks; a block's model is made when it is asked for."""

    def __init__(self, grams: DataFrame, langs: list[str], block: int):
        self.grams, self.blocks = grams, [langs[i : i + block] for i in range(0, len(langs), block)]

    def models(self) -> Iterator[Model]:
        for langs in self.blocks:
            got = self.grams.filter(F.col("lang").isin(langs)).toArrow()
            lang, g, n = got.column("lang"), got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
            of = np.searchsorted(np.array(langs, object), np.array(lang.to_pylist(), object))
            yield Model(langs, [(g[of == k], n[of == k]) for k in range(len(langs))])


def train(docs: DataFrame, sample_docs: int = 2000, block: int = 16) -> Trained | None:
    """None if no row has a language to learn."""
    grams = counts(docs, sample_docs)
    langs = sorted(r[0] for r in grams.select("lang").distinct().collect())
    return Trained(grams, langs, block) if langs else None


def guessed(docs: DataFrame, held: Broadcast) -> DataFrame:
    """doc_id, t, lang, bits, mass of every row, by one block of languages; lang is null without a letter."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            langs, bits, mass = [None] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
            column = b.column("text")
            rows = [i for i, t in enumerate(column) if t.is_valid and has_letter(t.as_py())]
            for k in range(0, len(rows), 512):
                some = rows[k : k + 512]
                got, bits[some], mass[some] = m.predict([column[i].as_py() for i in some])
                for i, x in zip(some, got, strict=True):
                    langs[i] = x
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(langs, pa.string()), pa.array(bits), pa.array(mass)], names=["doc_id", "t", "lang", "bits", "mass"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text_hash().alias("t"), F.col("text").cast("string")), scan, "doc_id long, t long, lang string, bits double, mass double")


def identify(docs: DataFrame, trained: Trained | None) -> DataFrame:
    """doc_id, t (the text's hash), lang_pred, score of every row."""
    sc = docs.sparkSession.sparkContext
    if trained is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("t"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    found, one = None, len(trained.blocks) == 1
    for model in trained.models():
        held = sc.broadcast(model)
        got = guessed(docs, held)
        if not one:
            got = stored(got, "op6-block")
            held.unpersist()
        if found is not None:
            more = got.select("t", *[F.col(c).alias(f"{c}2") for c in ("lang", "bits", "mass")]).dropDuplicates(["t"])
            low = F.least("bits", "bits2")
            high = F.col("mass") * F.pow(F.lit(2.0), low - F.col("bits")) + F.col("mass2") * F.pow(F.lit(2.0), low - F.col("bits2"))
            got = found.join(more, "t").select("doc_id", "t", F.when(F.col("bits2") < F.col("bits"), F.col("lang2")).otherwise(F.col("lang")).alias("lang"), low.alias("bits"), high.alias("mass"))
            got = stored(got, "op6-merged")
        found = got
    return found.select("doc_id", "t", F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.when(F.col("lang").isNull(), 0.0).otherwise(1 / F.col("mass")).alias("score"))


def accepted(docs: DataFrame, trained: Trained | None, least: float = 0.5) -> DataFrame:
    """docs, in their columns, without those that are `und` or less likely than `least` in their language.

    Where nothing was learned (no row has a language) all documents stay.
    """
    if trained is None:
        return docs
    found = identify(docs, trained)
    bad = stored(found.filter((F.col("lang_pred") == "und") | (F.col("score") < least)).select("doc_id", "t").distinct(), "op6-bad")
    return without(docs, bad, bad.limit(0))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
