"""Joins in time. None is a nested loop: every band becomes an equi-join on time buckets and a filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.windows import halo


def band_join(left: DataFrame, right: DataFrame, width: float, keep: Sequence[str], bucket: float | None = None) -> DataFrame:
    """Pairs of one entity at most `width` seconds apart: left's columns, right's `keep` as r_<name>, and dt."""
    span = bucket or 2 * width
    spread = halo(right, width, span).select(F.col("entity").alias("r_entity"), F.col("bucket").alias("r_bucket"), F.col("t").alias("r_t"), *[F.col(x).alias(f"r_{x}") for x in keep if x != "t"])
    own = left.withColumn("bucket", F.floor(F.col("t") / span))
    near = (F.col("entity") == F.col("r_entity")) & (F.col("bucket") == F.col("r_bucket")) & (F.abs(F.col("r_t") - F.col("t")) <= width)
    return own.join(spread, near).withColumn("dt", F.abs(F.col("r_t") - F.col("t"))).drop("bucket", "r_bucket", "r_entity")


def nearest(left: DataFrame, right: DataFrame, width: float, k: int, keep: Sequence[str] = ("pos",)) -> DataFrame:
    """The k rows of `right` nearest in time to each row of `left`, itself excepted; ties to smaller pos."""
    pairs = band_join(left, right, width, keep).where("pos <> r_pos")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("entity", "pos").orderBy("dt", "r_pos"))).where(F.col("rank") <= k)


def outside_steal_zone(pairs: DataFrame, winners: DataFrame, separation: float) -> DataFrame:
    """Pairs (entity, pos, r_pos, r_t, dt) whose candidate has no other winner within `separation` that is
    nearer to it than its own."""
    other = winners.select(F.col("entity").alias("o_entity"), F.col("pos").alias("o_pos"), F.col("t").alias("o_t"))
    span = max(separation, 1e-9)
    spread = other.withColumn("o_bucket", F.explode(F.sequence(F.floor((F.col("o_t") - separation) / span), F.floor((F.col("o_t") + separation) / span))))
    own = pairs.withColumn("__b", F.floor(F.col("r_t") / span))
    off = F.abs(F.col("r_t") - F.col("o_t"))
    stolen = (F.col("entity") == F.col("o_entity")) & (F.col("__b") == F.col("o_bucket")) & (F.col("o_pos") != F.col("pos")) & (off < F.col("dt")) & (off <= separation)
    return own.join(spread, stolen, "left_anti").drop("__b")


def brackets(points: DataFrame, rows: DataFrame, chosen: Column) -> DataFrame:
    """For each point (entity, t, pos) the last chosen row at or before it and the first at or after.

    One pass over the union of both in time order instead of an inequality join.
    """
    p = points.select("entity", "t", "pos", F.lit(None).cast("double").alias("s"), F.lit(None).cast("long").alias("q"), F.lit(True).alias("is_point"))
    r = rows.where(chosen).select("entity", "t", F.lit(0).cast("long").alias("pos"), F.col("t").alias("s"), F.col("pos").alias("q"), F.lit(False).alias("is_point"))
    w = Window.partitionBy("entity").orderBy("t")
    both = p.union(r)
    row = F.when(~F.col("is_point"), F.struct("s", "q"))
    before = F.max(row).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(row).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    out = both.withColumn("b", before).withColumn("a", after).where("is_point")
    return out.select("entity", "pos", "t", F.col("b.q").alias("before_pos"), F.col("a.q").alias("after_pos"))


def complete(timeline: DataFrame, rows: DataFrame, on: Sequence[str], defaults: dict[str, float]) -> DataFrame:
    """Every place of the timeline once, with the row's values or the defaults."""
    joined = timeline.join(rows.withColumn("found", F.lit(True)), list(on), "left")
    return joined.withColumns({x: F.coalesce(F.col(x), F.lit(v)) for x, v in defaults.items()} | {"found": F.coalesce("found", F.lit(False))})


def in_gaps(rows: DataFrame, gaps: DataFrame, width: float) -> DataFrame:
    """Rows within a gap (entity, start, stop) of their entity, ends included, with the gap; a range join on
    buckets of `width` seconds."""
    g = gaps.select(F.col("entity").alias("g_entity"), "start", "stop").withColumn("g_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    own = rows.withColumn("__b", F.floor(F.col("t") / width))
    inside = (F.col("entity") == F.col("g_entity")) & (F.col("__b") == F.col("g_bucket")) & (F.col("t") >= F.col("start")) & (F.col("t") <= F.col("stop"))
    return own.join(g, inside).drop("g_entity", "g_bucket", "__b")
