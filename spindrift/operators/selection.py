"""Which sampled rows deserve full processing: the union of four retained sets and their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.windows import in_order, peaks_by_rows, positions, slot_by_position, smooth3, top_per
from spindrift.params import DEFAULTS, Params


def global_top(rows: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The best max(min_keep, round(keep_ratio x n)) rows of a series; equal scores go to the earlier row."""
    k = F.least(F.greatest(F.lit(p.min_keep), F.rint(F.col("n") * p.keep_ratio).cast("int")), F.col("n"))
    order = Window.partitionBy("entity").orderBy(F.desc("smooth"), "p")
    return rows.withColumn("k", k).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= F.col("k")).drop("__r")


def edge_cover(rows: DataFrame, top: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row of a long unselected head or tail, if it holds a row far sharper than the nearest selected."""
    ends = top.groupBy("entity").agg(F.min("p").alias("first"), F.max("p").alias("last"), F.max("k").alias("k"), F.min_by("blur", "p").alias("first_blur"), F.max_by("blur", "p").alias("last_blur"))
    r = rows.join(ends, "entity").where("n >= 4")
    least = F.greatest(F.lit(2), F.rint(F.col("n") / F.greatest(F.lit(1), F.col("k") * 2)).cast("int"))
    head = r.where((F.col("p") < F.col("first")) & (F.col("first") >= least)).select("entity", "p", "smooth", "blur", F.col("first_blur").alias("anchor"), F.lit("head").alias("edge"), F.col("p").alias("far"))
    tail = r.where((F.col("p") > F.col("last")) & (F.col("n") - 1 - F.col("last") >= least)).select("entity", "p", "smooth", "blur", F.col("last_blur").alias("anchor"), F.lit("tail").alias("edge"), (F.col("n") - 1 - F.col("p")).alias("far"))
    both = head.union(tail)
    best = both.groupBy("entity", "edge").agg(F.max("blur").alias("sharpest"), F.max("anchor").alias("anchor"), F.max("smooth").alias("top"))
    ratio = F.when(F.col("anchor") > 1.0, F.col("sharpest") / F.col("anchor")).otherwise(F.col("sharpest"))
    good = best.where(ratio >= p.edge_blur_ratio).select("entity", "edge", "top")
    return both.join(good, ["entity", "edge"]).where(F.col("smooth") >= F.col("top") - 1e-6).groupBy("entity", "edge").agg(F.min_by("p", "far").alias("p")).select("entity", "p")


def prefilter(rows: DataFrame, score: str = "composite", p: Params = DEFAULTS) -> DataFrame:
    """entity, p, pos of the rows kept; `rows` has entity, pos, t, blur and the score."""
    s = smooth3(positions(rows), score).select("entity", "pos", "t", "p", "n", "blur", "smooth")
    top = global_top(s, p)
    kept = top.select("entity", "p")
    if not p.expected:
        kept = kept.union(edge_cover(s, top, p))
    else:
        slots = slot_by_position(s, max(p.expected, p.expected * p.slot_factor))
        kept = kept.union(top_per(slots, ["entity", "slot"], [F.desc("smooth"), F.asc("p")], p.per_slot).select("entity", "p"))
    kept = kept.union(peaks_by_rows(s.where("n >= 3"), "smooth", p).select("entity", "p"))
    spread = kept.select("entity", F.explode(F.sequence(F.col("p") - p.neighborhood, F.col("p") + p.neighborhood)).alias("p")).distinct()
    return s.select("entity", "p", "pos").join(spread, ["entity", "p"])


def sampled(frames: DataFrame, fps: float, p: Params = DEFAULTS) -> DataFrame:
    """Every step-th frame, step = max(1, round-half-even(fps / sample_fps)); all if sample_fps <= 0."""
    step = max(1, round(fps / p.sample_fps)) if p.sample_fps > 0 else 1
    return frames.where(F.col("frame_idx") % step == 0).withColumn("t", F.col("frame_idx") / F.lit(float(fps)))


def calibration_indices(count: int, step: int, most: int) -> list[int]:
    """Evenly spaced frames for a calibration scan."""
    budget = max(8, min(most, count // max(1, step)))
    return sorted({round(i * (count - 1) / (budget - 1)) for i in range(budget)}) if count > 0 else []


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """entity, pos, change (added or removed) between two selections."""
    a, b = before.select("entity", "pos"), after.select("entity", "pos")
    return b.exceptAll(a).withColumn("change", F.lit("added")).union(a.exceptAll(b).withColumn("change", F.lit("removed")))


__all__ = ["calibration_indices", "changed", "edge_cover", "global_top", "in_order", "prefilter", "sampled"]
