"""What a run writes: numbered pages, audit tables as CSV with fixed decimals, JSON summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.audit import fixed_decimals


def write_csv(rows: DataFrame, path: str, clean: bool = False) -> None:
    fixed_decimals(rows).write.mode("overwrite" if clean else "errorifexists").option("header", True).option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str, clean: bool = False) -> None:
    """One nested JSON document per row."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite" if clean else "errorifexists").text(path)


def write_pages(pages: DataFrame, path: str, clean: bool = False) -> None:
    """Rasters with their names `page_001`, ..., partitioned by entity; executors write them in parallel."""
    named = pages.withColumn("name", F.format_string("page_%03d", F.col("page")))
    named.write.mode("overwrite" if clean else "errorifexists").partitionBy("entity").parquet(path)


def contact_sheet(pages: DataFrame, columns: int = 5) -> DataFrame:
    """Adds row and column of each page in a grid of at most `columns`."""
    at = F.col("page") - 1
    return pages.withColumn("grid_row", F.floor(at / columns).cast("int")).withColumn("grid_column", (at % columns).cast("int"))
