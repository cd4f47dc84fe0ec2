"""Rows added after the main selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.scores import is_blank, is_leading
from spindrift.operators.joins import in_gaps
from spindrift.operators.windows import gaps, in_order
from spindrift.params import DEFAULTS, Params


def blank_rescue(rows: DataFrame, p: Params = DEFAULTS, bucket: float = 60.0) -> DataFrame:
    """entity, start, stop, pos: for each gap between chosen rows (ends excluded) of at least blank_gap_sec the
    sharpest blank row inside, then the stillest, then the first. `rows` has chosen and prefilter metrics."""
    wide = gaps(rows, anchors=False).where(F.col("gap") >= p.blank_gap_sec)
    inside = in_gaps(rows.where(~F.col("chosen") & is_blank(p)), wide, bucket).where((F.col("t") > F.col("start") + 0.05) & (F.col("t") < F.col("stop") - 0.05))
    best = inside.groupBy("entity", "start", "stop").agg(F.max_by("pos", F.struct("blur", -F.col("motion"), -F.col("pos"))).alias("pos"))
    return best.select("entity", "start", "stop", "pos")


def leading_rescue(rows: DataFrame, ham: Column, sim: Column, p: Params = DEFAULTS) -> DataFrame:
    """entity, pos: of the rows before the first chosen one that are still, readable and unlike it, the
    sharpest, then the stillest, the least turned, the earliest.

    ham and sim compare each row with the entity's first chosen row.
    """
    first = rows.where("chosen").groupBy("entity").agg(F.min("t").alias("first_t"))
    early = rows.join(first, "entity").where(F.col("t") < F.col("first_t") - 0.05)
    good = early.where(is_leading(F.col("first_t") - F.col("t"), ham, sim, p))
    order = F.struct("blur", -F.col("edge_motion"), -F.col("turn"), -F.col("t"), -F.col("pos"))
    return good.groupBy("entity").agg(F.max_by("pos", order).alias("pos"))


def extra_rows(rows: DataFrame, wide: DataFrame, most: int = 24, bucket: float = 60.0) -> DataFrame:
    """entity, pos of at most `most` unchosen rows inside wide gaps of each entity, in time order."""
    inside = in_gaps(rows.where(~F.col("chosen")), wide.select("entity", "start", "stop"), bucket).select("entity", "pos", "t").distinct()
    return inside.withColumn("k", F.row_number().over(in_order())).where(F.col("k") <= most).select("entity", "pos")


def cap(rows: DataFrame, score: str, most: int) -> DataFrame:
    """At most `most` rows of each entity by score, in time order again by `numbered`."""
    from spindrift.operators.windows import top_per

    return top_per(rows, ["entity"], [F.desc(score), F.asc("pos")], most, "__k").drop("__k")


def rescored(rows: DataFrame, late: Column, score_a: Column, score_b: Column, switch: bool = True) -> DataFrame:
    """Adds raw: form A, or, in series with late rows and with `switch`, form B for all of its rows; without
    `switch` late rows alone take form B."""
    from pyspark.sql import Window

    any_late = F.max(F.when(late, 1).otherwise(0)).over(Window.partitionBy("entity")) == 1
    return rows.withColumn("raw", F.when(any_late if switch else late, score_b).otherwise(score_a))
