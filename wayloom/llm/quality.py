"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration.

1. One pass over the whole texts gives each document's statistics (STATS), stored in the shared folder.
2. Labelled rows train: their statistics are standardised; cos(W z + b) with fixed random W approximates a
   Gaussian kernel. Every partition sums the normal equations of its rows, a few tasks add the sums up, the
   driver solves one system of `features` + 1 unknowns.
3. A fifth of the labelled rows, chosen by a hash and left out of step 2, gives the calibration: counts by
   bins of the ridge score, pooled to a rising step function.

Labels are drawn by a hash down to about `max_rows` rows (a documented bound). labels, lang, source and
doc_id are no inputs of a score. Null text counts as empty; empty texts get the score of their statistics,
all zero. Without labels, or with one class only, every score is the share of label 1 (0.5 without rows).
A null doc_id is not learned from. Repeated labels count as often as they stand there, also where they differ; rows of
equal text get equal scores. Very long texts are read whole. No documents give no rows. The document's other columns
don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import map_arrow, stored, table, texts
from wayloom.llm.language import held_out

_CLASS = np.zeros(256, np.int64)  # 0 other bytes of letters, 1 lower, 2 upper, 3 digit, 4 space, 5 line, 6 , 7 . 8 ! ? 9 symbols 10 quotes, brackets, dashes
for _i, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b",;:", b".", b"!?", b"#$%&*+/<=>@\\^_`|~", b"\"'()-[]{}"], 1):
    _CLASS[list(_chars)] = _i
STATS = ["bytes", "words", "word_length", "other", "lower", "upper", "digit", "space", "line", "comma", "stop", "shout", "symbol", "mark", "distinct", "pairs", "triples", "echo", "commonest", "lines", "longest_line", "distinct_lines", "longest_word", "line_end"]


def statistics(text: bytes) -> list[float]:
    """STATS of a text; counts as logarithms, shares as square roots; an empty text has zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(STATS)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=11) / n
    w = text.split()
    m = max(1, len(w))
    lines = [x for x in text.split(b"\n") if x]
    k = max(1, len(lines))
    shares = [
        *kinds,
        len(set(w)) / m,
        len(set(zip(w, w[1:]))) / m,
        len(set(zip(w, w[1:], w[2:]))) / m,
        sum(map(eq, w, w[1:])) / m,
        max(Counter(w).values(), default=0) / m,
    ]
    return [np.log1p(n), np.log1p(len(w)), np.log1p(n / m), *np.sqrt(shares), np.log1p(len(lines)), np.log1p(max(map(len, lines), default=0)), np.sqrt(len(set(lines)) / k), np.log1p(max(map(len, w), default=0)), np.sqrt(sum(x[-1:] in b".!?" for x in lines) / k)]


def statistics_table(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in texts(b)], np.float32).reshape(-1, len(STATS))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATS)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows], names=["doc_id", "x"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, "doc_id long, x array<float>")


def matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS)).astype(np.float64)


class Kernel:
    """Standardised statistics to random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, 1 / width, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.c_[np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(z))]


def sums(rows: DataFrame, f, size: int, groups: int = 16) -> np.ndarray:
    """The sum over all rows of what f gives for batches (arrays of `size` numbers): by partition, then by group, then here."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += f(b)
        yield pa.RecordBatch.from_arrays([pa.array([int(np.abs(total).sum() * 1e3) % groups]), pa.array([total.tobytes()], pa.binary())], names=["g", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for v in b.column("v"):
                total += np.frombuffer(v.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["g", "v"])

    parts = map_arrow(map_arrow(rows, local, "g long, v binary").repartition(groups, "g"), add, "g long, v binary")
    return sum((np.frombuffer(bytes(r["v"])) for r in parts.select("v").toLocalIterator()), np.zeros(size))


def pooled(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Pools adjacent violators: the rising step function nearest to ones / n, for bins in order; bins without rows take their neighbours'."""
    blocks: list[list[float]] = []
    for i in range(len(n)):
        if n[i]:
            blocks.append([ones[i], n[i], i])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                o, m, i = blocks.pop()
                blocks[-1] = [blocks[-1][0] + o, blocks[-1][1] + m, i]
    at, value = [b[2] for b in blocks], [(b[0] + 0.5) / (b[1] + 1) for b in blocks]
    return np.clip(np.maximum.accumulate([value[min(np.searchsorted(at, i), len(at) - 1)] for i in range(len(n))]), 0, 1)


class Classifier:
    def __init__(self, kernel: Kernel | None, beta: np.ndarray | None, steps: np.ndarray):
        self.kernel, self.beta, self.steps = kernel, beta, steps

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The bin of the ridge score, 0 to len(steps) - 1; scores lie about 0 to 1."""
        if self.kernel is None:
            return np.zeros(len(x), np.int64)
        return np.clip(np.floor((self.kernel(x) @ self.beta + 0.5) / 2 * len(self.steps)), 0, len(self.steps) - 1).astype(np.int64)


def train(stats: DataFrame, labels: DataFrame, features: int = 256, width: float = 6.0, penalty: float = 1e-3, bins: int = 1000, max_rows: int = 500_000, seed: int = 42) -> Classifier:
    """stats (doc_id, x), labels (doc_id, y in 0, 1), both without rows that must not be learned from."""
    n_labels = labels.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    known = labels.filter(draw < min(1.0, max_rows / max(1, n_labels)) * 1_000_000)
    rows = stored(stats.join(known, "doc_id").select("x", F.col("y").cast("double").alias("y"), (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)) == 0).alias("tuning")), "op7-train")
    d = len(STATS)
    total = sums(rows, lambda b: np.r_[b.num_rows, b.column("y").to_numpy().sum(), (x := matrix(b)).sum(0), (x * x).sum(0)], 2 + 2 * d)
    n, ones = total[:2]
    if n == 0 or ones in (0, n):
        return Classifier(None, None, np.array([ones / n if n else 0.5]))
    mean = total[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(total[2 + d :] / n - mean * mean, 0))
    kernel, m = Kernel(mean, np.where(scale > 1e-6, scale, 1.0), features, width, seed), features + 1

    def equations(b: pa.RecordBatch) -> np.ndarray:
        p = kernel(matrix(b))
        return np.r_[(p.T @ p).ravel(), p.T @ b.column("y").to_numpy()]

    a = sums(rows.filter("not tuning").select("x", "y"), equations, m * m + m)
    beta = np.linalg.solve(a[: m * m].reshape(m, m) + penalty * max(1.0, n) * np.diag(np.r_[np.full(features, 1 / features), 1e-9]), a[m * m :])
    model = Classifier(kernel, beta, np.zeros(bins))

    def histogram(b: pa.RecordBatch) -> np.ndarray:
        at = model.bins(matrix(b))
        return np.r_[np.bincount(at, minlength=bins), np.bincount(at, weights=b.column("y").to_numpy(), minlength=bins)]

    h = sums(rows.filter("tuning").select("x", "y"), histogram, 2 * bins)
    if not h[:bins].any():
        h = sums(rows.select("x", "y"), histogram, 2 * bins)
    return Classifier(kernel, beta, pooled(h[:bins], h[bins:]))


def score(stats: DataFrame, model: Classifier) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(m.steps[m.bins(matrix(b))])], names=["doc_id", "score"])

    return map_arrow(stats.select("doc_id", "x"), scan, "doc_id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(statistics_table(table(spark, sf_dir, "documents")), "op7-stats")
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null and quality in (0, 1)").filter(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y"))
    scored = score(stats, train(stats, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
