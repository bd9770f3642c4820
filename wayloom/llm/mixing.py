"""Mixing sources to target weights by a time-varying curriculum.

A schedule gives the weight of each class of sources at knots of training time 0..1, linear between them. Its
integral, scaled to a source's target, is the source's cumulative demand D(t); a source's documents, in an order
fixed by a hash of doc_id, text and the seed, form a stream that is read in laps until the demand ends. A copy that
stands at word c of the stream is due at the t with D(t) = c: its training position. A document is taken as often as
it has positions before the end, each time with the words that the source still owes at that position; so the last
copy of a source may be taken in part, and its words meet the target. Positions sort the mix by range.

Targets: the sources by code point (null last) have the classes' integrals as weights (5, 2, 1, repeating) and share
all words; a target stops at `cap` times its source's size, the excess goes to the others by weight.

No task holds a source: the hash order is cut into buckets, whose sums give each bucket's place in the stream. Null
and empty texts have size 0 and no position; very long ones are taken whole, but for a source's last copy; an empty
table gives an empty mix; repeated rows are mixed one by one and stand side by side (ties in the hash go by doc_id,
size and text). A null doc_id hashes like any value, with the text. Columns other than doc_id, text and source are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.llm.common import WORD, empty_text, stored, table, unused

#: Knots of training time with the weight of each class of sources; linear between them. The classes' integrals are 5, 2
#: and 1: the first class leads at the start, the others come up towards the end.
CURRICULUM = ((0.0, (6.0, 1.5, 0.5)), (0.5, (5.0, 2.0, 1.0)), (1.0, (4.0, 2.5, 1.5)))
BIG = "decimal(38,0)"


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """The narrow table that all else reads: doc_id, source, size, text_hash, h."""
    size = F.regexp_count(empty_text("text"), F.lit(WORD)).cast("long")
    hashed = F.xxhash64(empty_text("text"))
    return stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), hashed.alias("text_hash")).withColumn("h", F.xxhash64("doc_id", "text_hash", F.lit(seed))), "op3-sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """A row for each source: source, rank, source_size, target. A source count is small; one task ranks them."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("most", F.col("source_size") * cap)
    by_limit = Window.orderBy((F.col("most") / F.col("w")).asc(), "rank")
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("ws", F.sum("w").over(by_limit.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("at", F.row_number().over(by_limit))
    fits = F.col("left").cast(BIG) * F.col("w").cast("decimal(10,0)") <= F.col("most").cast(BIG) * F.col("ws").cast("decimal(10,0)")
    s = s.withColumn("level", F.min_by(F.when(fits, F.struct("left", "ws")), F.when(fits, F.col("at"))).over(everything))
    level = F.col("level.left").cast("double") / F.col("level.ws").cast("double")
    return s.select("source", "rank", "source_size", F.least(F.col("most").cast("double"), level * F.col("w")).alias("target"))


class Demand:
    """Cumulative demand of the classes of sources as a share of the target, and its inverse, in column expressions.

    A class's share at a knot is its weight over all classes' there, linear in between; its integral, a piece of a
    parabola between two knots, is scaled to end at one.
    """

    def __init__(self, schedule: tuple, rank: Column):
        self.times = [t for t, _ in schedule]
        self.kinds, self.rank = len(schedule[0][1]), rank
        self.shares = [[w[k] / sum(w) for _, w in schedule] for k in range(self.kinds)]

    def _pieces(self, kind: int) -> list[tuple[float, float, float, float, float]]:
        """Start, width, share at the start, slope, integral before it."""
        out, done, s = [], 0.0, self.shares[kind]
        for i, (t, u) in enumerate(zip(self.times, self.times[1:], strict=False)):
            out.append((t, u - t, s[i], (s[i + 1] - s[i]) / (u - t), done))
            done += (u - t) * (s[i] + s[i + 1]) / 2
        return [*out, (self.times[-1], 0.0, 0.0, 0.0, done)]

    def _by_kind(self, f: Callable[[list], Column]) -> Column:
        out = F.lit(None).cast("double")
        for kind in range(self.kinds):
            out = F.when(self.rank % self.kinds == kind, f(self._pieces(kind))).otherwise(out)
        return out

    def time(self, share: Column) -> Column:
        """The training time at which so large a share of the target is due; null from the end on."""

        def inverse(pieces: list) -> Column:
            total, found = pieces[-1][4], F.lit(None).cast("double")
            y = share * total
            for (t, _, a, slope, done), after in reversed(list(zip(pieces, pieces[1:], strict=False))):
                z = F.greatest(y - done, F.lit(0.0))
                root = a + F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * z, F.lit(0.0)))
                found = F.when(y < after[4], t + F.when(root > 0, 2 * z / root).otherwise(0.0)).otherwise(found)
            return found

        return self._by_kind(inverse)

    def share(self, time: Column) -> Column:
        """The share of the target that is due by a time."""

        def forward(pieces: list) -> Column:
            found = F.lit(1.0)
            for t, width, a, slope, done in reversed(pieces[:-1]):
                x = F.greatest(time - t, F.lit(0.0))
                found = F.when(time < t + width, (done + a * x + slope / 2 * x * x) / pieces[-1][4]).otherwise(found)
            return found

        return self._by_kind(forward)


def integrals(schedule: tuple) -> tuple[int, ...]:
    """The classes' weights over the whole training, in thousandths."""
    pieces = list(zip(schedule, schedule[1:], strict=False))
    return tuple(round(1000 * sum((u - t) * (v[k] + w[k]) / 2 for (t, v), (u, w) in pieces)) for k in range(len(schedule[0][1])))


def mix(docs: DataFrame, schedule: tuple = CURRICULUM, cap: int = 3, seed: int = 42, broadcast_sources: int = 100_000) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, taken, positions: a row for each document, also those not taken.

    positions has the training time of each lap's copy, in order; the last copy may be taken in part.
    """
    sizes = sized(docs, seed)
    rows = sizes.count()
    aims = stored(targets(sizes, integrals(schedule), cap), "op3-targets")
    small = aims.count() <= broadcast_sources
    buckets = max(1, int(rows / max(500, math.isqrt(rows))))
    parts = sizes.join(F.broadcast(aims) if small else aims, sizes.source.eqNullSafe(aims.source)).drop(aims.source)
    parts = parts.withColumn("bucket", F.pmod(F.shiftright("h", 12), F.lit(buckets)))
    # the order within a source is by bucket, then hash; equal rows of one document stand side by side
    sums = parts.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    starts = sums.select("rank", "bucket", (F.sum("words").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("words")).alias("start"))
    inside = Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("before", F.sum("size").over(inside) - F.col("size")).join(starts, ["rank", "bucket"])
    c = F.col("start") + F.col("before")
    demand, goal = Demand(schedule, F.col("rank")), F.floor(F.col("target") + 0.5)
    due = [demand.time((c + F.col("source_size") * k).cast("double") / F.greatest(goal, F.lit(1))) for k in range(cap)]
    placed = placed.withColumn("positions", F.when(F.col("size") > 0, F.array_compact(F.array(*due))).otherwise(F.array().cast("array<double>")))
    # a copy's words end where the demand does: what the source still owes at the copy's position is the most it gives
    owed = F.transform("positions", lambda p: F.least(F.col("size"), goal - F.round(demand.share(p) * goal).cast("long")))
    taken = F.aggregate(owed, F.lit(0).cast("long"), lambda total, x: total + F.greatest(x, F.lit(0)).cast("long"))
    return placed.select("doc_id", "source", "text_hash", "size", "source_size", "target", taken.alias("taken"), "positions")


def in_order(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents that a mix takes, in docs' columns and size, target, taken and positions, sorted by range of the first position.

    Where docs has a column of such a name, the mix's gets an underscore before it. A row finds its place by doc_id,
    source and the text's hash. Rows that agree in all three have the place, and the words taken, of the first of
    them: no row comes out twice.
    """
    names = [unused(docs, x) for x in ("mixed_id", "mixed_source", "mixed_hash")]
    own = {c: unused(docs, c) for c in ("size", "target", "taken", "positions")}
    got = mixed.filter("taken > 0").groupBy(*[F.col(c).alias(n) for c, n in zip(("doc_id", "source", "text_hash"), names, strict=True)])
    got = got.agg(F.min_by(F.struct(*own), F.struct(F.element_at("positions", 1), -F.col("taken"))).alias("place"))
    got = got.select(*names, *[F.col(f"place.{c}").alias(n) for c, n in own.items()])
    on = F.col("doc_id").eqNullSafe(F.col(names[0])) & F.col("source").cast("string").eqNullSafe(F.col(names[1])) & (F.xxhash64(empty_text("text")) == F.col(names[2]))
    return docs.join(got, on).drop(*names).sort(F.element_at(own["positions"], 1), "doc_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in training order; documents that aren't taken come last."""
    return mix(table(spark, sf_dir, "documents")).drop("source", "text_hash").sort(F.element_at(F.when(F.size("positions") > 0, F.col("positions")), 1).asc_nulls_last(), "doc_id")
