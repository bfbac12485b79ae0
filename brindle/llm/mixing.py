"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight (which sets how many words it gives) and a schedule (which sets
when it gives them).  The schedule is a piecewise-linear density over training time 0..1.
Its integral, scaled to the source's target, is the source's cumulative token demand; the
inverse of that gives each pass over each document a training position, and documents are
range-sorted by position.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Knots (time, density) in turn for the sources in order: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
_HEX = 3  # digits of a document's digest that name its bucket: 4096 to a source


def _inverse(u: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the share u of the density's integral is reached."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, before, out = sum(areas), 0.0, None
    parts = []
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        slope = (w1 - w0) / (t1 - t0)
        a = u * total - before
        parts.append((before + area, t0 + 2 * a / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * a, F.lit(0.0))))))
        before += area
    for end, t in reversed(parts):
        out = t if out is None else F.when(u * total < end, t).otherwise(out)
    return out


def targets(per_source: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Adds rank and target to (source, source_size), one row a source.

    Sources in code point order, null last, have `weights` in turn and share all words by
    them; none gets more than `cap` times its size, and the excess goes to the others by
    weight until none is above.  Filling the sources in the order of cap to weight gives
    that fixed point in one pass.
    """
    whole = Window.orderBy("_ratio", "rank")
    upto = whole.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = (
        per_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1))
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
    )
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
    filled = ranked.withColumn("_level", level)
    first_free = F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True)
    filled = filled.withColumn("_level", first_free.over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return filled.select("source", "source_size", "rank", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, schedules=SCHEDULES) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, first_position, passes.

    A source's documents are laid end to end in the order of their ids' digests, again and
    again; the mix takes the first `target` words of that, so that the last document of the
    last pass may be cut.  passes lists (pass, words, position in training time 0..1).
    first_position is null for a document that isn't taken.

    Null text counts 0 words and is not taken; null sources are one source, the last; a null
    id counts as an empty one; repeated rows are documents of their own; rows of the same id
    and size are alike, so ties don't matter.  Other columns are left aside.  An empty table
    gives an empty result.
    """
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("_key")
    )
    sized = cut(sized.withColumn("_bucket", F.substring("_key", 1, _HEX)))
    per_bucket = cut(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")))
    per_source = targets(per_bucket.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, cap)
    in_source = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_before", F.coalesce(F.sum("_sum").over(in_source), F.lit(0)))
    buckets = per_bucket.join(per_source, per_bucket["source"].eqNullSafe(per_source["source"])).select(
        per_bucket["source"].alias("_source"), F.col("_bucket").alias("_b"), "_before", "source_size", "target", "rank"
    )
    in_bucket = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_inner", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    placed = placed.join(buckets, placed["source"].eqNullSafe(buckets["_source"]) & (F.col("_bucket") == F.col("_b")))
    goal = F.round("target").cast("long")
    start = F.col("_before") + F.col("_inner")

    def one_pass(p: Column) -> Column:
        at = p * F.col("source_size") + start
        words = F.greatest(F.lit(0), F.least(F.col("size"), goal - at))
        u = at / goal
        t = None
        for k, knots in reversed(list(enumerate(schedules))):
            own = _inverse(u, knots)
            t = own if t is None else F.when(F.pmod(F.col("rank") - 1, F.lit(len(schedules))) == k, own).otherwise(t)
        return F.struct(p.alias("pass"), words.alias("words"), F.when(words > 0, t).alias("position"))

    passes = F.filter(F.transform(F.array(*[F.lit(p).cast("long") for p in range(math.ceil(cap))]), one_pass), lambda x: x["words"] > 0)
    mixed = placed.withColumn("passes", passes)
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"),
        F.try_element_at("passes", F.lit(1))["position"].alias("first_position"), "passes",
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """The passes of mix_sources, one row each, range-sorted by training position."""
    rows = mixed.select("doc_id", "source", F.explode("passes").alias("p")).select("doc_id", "source", "p.*")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
