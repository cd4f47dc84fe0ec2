"""Still images: list, decode and clean page by page; a map over files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.kernels import enhance, page_quad, skew_angle, trim_borders, warp

# Suffixes of still images.
SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of a file, or of the images of a folder (not below it), by suffix in any case."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*SUFFIXES)).select("path", "content").orderBy("path")


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Images that the JVM can decode, as path, height, width, data (BGR)."""
    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").where("nChannels = 3")
    return found.select(F.col("origin").alias("path"), "height", "width", "data")


def cleaned_pages(images: DataFrame, long_side: int = 1800) -> DataFrame:
    """Each image's page: found (else the whole image), made upright, trimmed, enhanced. Adds skew and found."""
    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for r in frame.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                quad = page_quad(image)
                page = warp(image, quad, long_side) if quad is not None else image
                page = enhance(trim_borders(page))
                out.append((r.path, quad is not None, skew_angle(page), page.shape[0], page.shape[1], page.tobytes()))
            yield pd.DataFrame(out, columns=["path", "found", "skew", "height", "width", "data"])

    return images.mapInPandas(clean, "path string, found boolean, skew double, height int, width int, data binary")
