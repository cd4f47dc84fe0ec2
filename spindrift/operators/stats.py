"""Robust statistics per entity.

Percentiles are exact. Groups of at most `BUFFERED` rows are aggregated in one buffer each; larger ones are
bracketed by approximate percentiles, whose rank error is bounded, and only the rows inside of a bracket
are sorted. So no buffer grows with a group, and both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.scores import clip
from spindrift.params import DEFAULTS, Params


def finite(x: Column) -> Column:
    """The value as double, null if it is NaN or infinite."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


BUFFERED = 100_000
#: Ranks of approximate percentiles are off by at most the group's size over this.
ACCURACY = 10_000


def _large_points(rows: DataFrame, by: Sequence[str], points: Sequence[float], least: int) -> DataFrame:
    """`by` and p, as in `percentiles`, for groups of more than `least` rows with a value v."""
    # At least twice the error, and some ranks.
    slack = max(2.0 / ACCURACY, 8.0 / max(1, least))
    ends = [min(1.0, max(0.0, q + d)) for q in points for d in (-slack, slack)]
    bounds = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("e"))
    v, found = rows.join(bounds, list(by)), None
    for k, q in enumerate(points):
        low, high = F.col("e")[2 * k], F.col("e")[2 * k + 1]
        # The bracket holds ranks q (n - 1) and the next; at the ends it is open.
        below = v.groupBy(*by).agg(F.count_if(F.col("v") < low).alias("before")) if q > slack else bounds.select(*by, F.lit(0).cast("long").alias("before"))
        inside = v.where(((F.col("v") >= low) if q > slack else F.lit(True)) & ((F.col("v") <= high) if q < 1 - slack else F.lit(True)))
        ranked = inside.join(below, list(by)).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy(*by).orderBy("v")) - 1)
        at = (F.col("n") - 1) * F.lit(float(q))
        one = ranked.where((F.col("rank") == F.floor(at)) | (F.col("rank") == F.ceil(at))).groupBy(*by)
        share = at - F.floor(at)
        one = one.agg((F.min_by("v", "rank") * (1 - F.first(share)) + F.max_by("v", "rank") * F.first(share)).alias(f"p{k}"))
        found = one if found is None else found.join(one, list(by))
    return found.select(*by, F.array(*[F.col(f"p{k}") for k in range(len(points))]).alias("p"))


def percentiles(rows: DataFrame, columns: Sequence[str], by: Sequence[str], points: Sequence[float], buffered: int = BUFFERED) -> DataFrame:
    """`by`, and for each column an array __<column> of its interpolated percentiles over finite values."""
    wanted = F.array(*[F.lit(float(q)) for q in points])
    sizes = rows.groupBy(*by).count().where(F.col("count") > buffered).select(*by)
    if sizes.isEmpty():
        return rows.groupBy(*by).agg(*[F.percentile(finite(F.col(x)), wanted).alias(f"__{x}") for x in columns])
    small = rows.join(sizes, list(by), "left_anti")
    out = small.groupBy(*by).agg(*[F.percentile(finite(F.col(x)), wanted).alias(f"__{x}") for x in columns])
    large = None
    for x in columns:
        v = rows.join(sizes, list(by), "left_semi").select(*by, finite(F.col(x)).alias("v")).where("v is not null")
        one = sizes.join(_large_points(v, by, points, buffered), list(by), "left").withColumnRenamed("p", f"__{x}")
        large = one if large is None else large.join(one, list(by))
    return out.unionByName(large)


def robust_norm(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ("entity",), lower: Sequence[str] = ()) -> DataFrame:
    """Adds norm_<column>: clipped position between the 10th and 90th percentile of its entity.

    0.5 where both are equal (also for `lower` columns, whose direction is reversed), 0 for values that
    are null or not finite.
    """
    out = rows.join(percentiles(rows, columns, by, (0.1, 0.9)), list(by))
    for x in columns:
        v, lo, hi = finite(F.col(x)), F.col(f"__{x}")[0], F.col(f"__{x}")[1]
        up = clip((v - lo) / (hi - lo), 0.0, 1.0)
        scaled = F.when(F.abs(hi - lo) < 1e-6, F.lit(0.5)).otherwise(1.0 - up if x in lower else up)
        out = out.withColumn(f"norm_{x}", F.coalesce(F.when(v.isNull(), F.lit(0.0)).otherwise(scaled), F.lit(0.0)))
    return out.drop(*[f"__{x}" for x in columns])


def five_numbers(rows: DataFrame, column: str, by: Sequence[str], buffered: int = BUFFERED) -> DataFrame:
    """n, p10, p25, p50, p75, p90 and mad (median absolute deviation) of the finite values."""
    v = rows.select(*by, finite(F.col(column)).alias("v")).where("v is not null")
    points = percentiles(v, ["v"], by, (0.1, 0.25, 0.5, 0.75, 0.9), buffered).withColumnRenamed("__v", "p")
    off = v.join(points, list(by)).select(*by, F.abs(F.col("v") - F.col("p")[2]).alias("off"))
    mad = percentiles(off, ["off"], by, (0.5,), buffered).select(*by, F.col("__off")[0].alias("mad"))
    named = [F.col("p")[i].alias(x) for i, x in enumerate(("p10", "p25", "p50", "p75", "p90"))]
    sizes = v.groupBy(*by).agg(F.count("*").alias("n"))
    return points.join(mad, list(by)).join(sizes, list(by)).select(*by, "n", *named, "mad")


def post_calibration(rows: DataFrame, norm: str = "norm", by: Sequence[str] = ("entity",), p: Params = DEFAULTS) -> DataFrame:
    """Per entity the floor of norm scores: one step of 0.02 down or up where the distribution is far off."""
    s = five_numbers(rows, norm, by)
    base = p.min_norm_score
    moved = F.when(F.col("p25") < base - 0.10, base - 0.02).when((F.col("p25") > base + 0.20) & (F.col("p50") > base + 0.25), base + 0.02).otherwise(base)
    after = F.when(F.col("n") < 8, base).otherwise(clip(moved, max(0.22, base - 0.02), min(0.34, base + 0.02)))
    return s.select(*by, "n", "p25", "p50", "p75", after.alias("min_norm"), (F.abs(after - base) >= 0.005).alias("applied"))


def calibration(samples: DataFrame, blur: str, skin: str, text: str | None = None, by: Sequence[str] = ("entity",), p: Params = DEFAULTS) -> DataFrame:
    """Per entity min_norm, sim_merge, hash_merge and high_hand, from its samples: guarded overrides of the defaults.

    Skin in many samples lowers the merge threshold, in most it means high-hand mode, which lowers it and
    the floor further. With `text` (the full calibration, not that from prefilter metrics) the floor also follows
    the spread of blur, and little text widens the hash threshold. Fewer than six samples change nothing."""
    s = five_numbers(samples, skin, by).select(*by, "n", F.col("p50").alias("s50"), F.col("p75").alias("s75"))
    high = (F.col("n") >= 6) & ((F.col("s50") > 0.45) | (F.col("s75") > 0.55))
    keep = lambda x, base: F.when(F.abs(x - base) < 0.005, F.lit(base)).otherwise(x)
    floor, ham = F.lit(p.min_norm_score), F.lit(p.hash_merge)
    if text:
        b = five_numbers(samples, blur, by).select(*by, F.col("p10").alias("b10"), F.col("p90").alias("b90"))
        s = s.join(b, list(by)).join(five_numbers(samples, text, by).select(*by, F.col("p50").alias("t50")), list(by))
        spread = (F.col("b90") - F.col("b10")) / F.greatest(F.col("b90"), F.lit(1.0))
        moved = F.when(spread < 0.20, p.min_norm_score - 0.02).when(spread > 0.92, p.min_norm_score + 0.02).otherwise(p.min_norm_score)
        floor = F.when((F.col("n") >= 6) & (F.col("b90") > 1e-3), keep(clip(moved, 0.20, 0.36), p.min_norm_score)).otherwise(floor)
        ham = F.when((F.col("n") >= 6) & (F.col("t50") < 0.015), F.lit(min(13, max(9, p.hash_merge + 1)))).otherwise(ham)
    floor = F.when(high, keep(clip(F.lit(p.min_norm_score - 0.02), 0.20, 0.36), p.min_norm_score)).otherwise(floor)
    drop = F.when(high, F.lit(0.02)).when((F.col("n") >= 6) & (F.col("s75") > 0.30), F.lit(0.01)).otherwise(F.lit(0.0))
    sim = keep(clip(F.lit(p.sim_merge) - drop, 0.86, 0.92), p.sim_merge)
    return s.select(*by, "n", floor.alias("min_norm"), sim.alias("sim_merge"), ham.cast("int").alias("hash_merge"), high.alias("high_hand"))


def argmax(rows: DataFrame, by: Sequence[str], keys: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The row of each group with the greatest key tuple."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*keep), F.struct(*keys)).alias("r")).select(*by, "r.*")


def reason_histogram(rows: DataFrame, reason: str, by: Sequence[str] = ()) -> DataFrame:
    """summary: `reason=count` pairs in order of reason."""
    counts = rows.where(F.col(reason).isNotNull()).groupBy(*by, reason).count()
    pair = F.struct(F.col(reason).alias("reason"), F.col("count"))
    listed = counts.groupBy(*by).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    return listed.select(*by, F.array_join(F.transform("pairs", lambda x: F.concat_ws("=", x["reason"], x["count"].cast("string"))), ",").alias("summary"))
