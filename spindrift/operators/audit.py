"""Why each row was chosen: diagnostics joined onto winners, summaries, and fixed-decimal tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimals of the columns of the three debug tables (fixed values); other columns are written as they are.
DECIMALS = {
    "t_sec": 3, "paper_ratio": 4, "bright_mean": 2, "sat_mean": 2, "blur": 2, "edge_density": 4, "motion": 5,
    "skin": 5, "bottom_dark": 4, "composite": 4, "area": 4, "fill": 4, "contact": 4, "stability": 4, "text": 5,
    "hand": 5, "hand_text_overlap": 5, "edge_fg": 5, "bottom_hand": 5, "turn": 5, "edge_motion": 5,
    "raw_score": 5, "norm_score": 5, "peak_score": 5,
}


def fixed_decimals(rows: DataFrame, missing: str = "") -> DataFrame:
    """Known columns as text with fixed decimals; null and NaN as `missing`."""
    def shown(name: str) -> Column:
        if name not in DECIMALS:
            return F.col(name)
        x = F.col(name).cast("double")
        return F.when(x.isNull() | F.isnan(x), F.lit(missing)).otherwise(F.format_string(f"%.{DECIMALS[name]}f", x)).alias(name)

    return rows.select(*[shown(c) for c in rows.columns])


def with_diagnostics(winners: DataFrame, tables: dict[str, DataFrame], on: Sequence[str] = ("entity", "pos")) -> DataFrame:
    """Left-joins each table's columns as <name>_<column>; a flag <name>_applied says whether it had a row.

    Replaced winners are looked up under `original_pos` where the table asks for it (a column of that name).
    """
    out = winners
    for name, diagnostics in tables.items():
        keys = list(on)
        own = diagnostics.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in diagnostics.columns if c not in keys], F.lit(1).alias(f"{name}_applied"))
        out = out.join(own, keys, "left").withColumn(f"{name}_applied", F.coalesce(f"{name}_applied", F.lit(0)))
    return out


def traced(winners: DataFrame, replacements: DataFrame) -> DataFrame:
    """Adds original_pos: where a winner came from, following pos <- new_pos of `replacements`."""
    r = replacements.where("new_pos is not null").select("entity", F.col("new_pos").alias("pos"), F.col("pos").alias("original_pos"))
    return winners.join(r, ["entity", "pos"], "left").withColumn("original_pos", F.coalesce("original_pos", "pos"))


def stage_times(times: DataFrame) -> DataFrame:
    """stage, seconds and share of the total, of rows (stage, seconds)."""
    per = times.groupBy("stage").agg(F.sum("seconds").alias("seconds"))
    total = per.agg(F.sum("seconds").alias("total"))
    return per.join(total).select("stage", "seconds", F.when(F.col("total") > 0, 100.0 * F.col("seconds") / F.col("total")).otherwise(0.0).alias("percent"))


def counters(rows: DataFrame, flags: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.count_if(F.col(f)).alias(f"n_{f}") for f in flags])
