"""From frames to numbered representatives: measure, prefilter, score, peaks, folds, numbering.

Measuring is two-phase: cheap metrics of every sampled frame, then a semi-join, so that costly features
are computed for the selected frames only. Everything is keyed by recording; rasters are dropped as soon
as their features exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import kernels, scores
from spindrift.functions.vectors import difference_hash
from spindrift.operators import greedy, selection, stats, windows
from spindrift.params import DEFAULTS, LOWER_IS_BETTER, Params

METRICS = ("paper_ratio", "bright_mean", "sat_mean", "blur", "edge_density", "motion", "skin", "bottom_dark")


def _image(r) -> np.ndarray:
    return np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)


def prefilter_metrics(frames: DataFrame) -> DataFrame:
    """entity, pos, t, the cheap metrics and the composite of each frame; motion against the frame before."""
    w = Window.partitionBy("video_id").orderBy("frame_idx")
    paired = frames.withColumn("before", F.lag("data").over(w))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for r in frame.itertuples():
                image = _image(r)
                before = np.frombuffer(r.before, np.uint8).reshape(image.shape) if r.before is not None and len(r.before) == len(r.data) else None
                out.append((r.video_id, r.frame_idx, r.t_sec, *kernels.frame_metrics(image, before).values()))
            yield pd.DataFrame(out, columns=["entity", "pos", "t", *METRICS])

    schema = "entity string, pos long, t double, " + ", ".join(f"{m} double" for m in METRICS)
    return paired.mapInPandas(measure, schema).withColumn("composite", scores.prefilter_composite())


def quad_area(q: np.ndarray) -> float:
    a, b = q[2] - q[0], q[3] - q[1]
    return float(abs(a[0] * b[1] - a[1] * b[0]) / 2)


def frame_features(frames: DataFrame) -> DataFrame:
    """Features and signatures of each frame's page."""
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for r in frame.itertuples():
                image = _image(r)
                quad = kernels.page_quad(image)
                page = image if quad is None else kernels.warp(image, quad, 96)
                g, skin, low = kernels.gray(page), kernels.skin_mask(page), int(0.7 * len(page))
                ink = g < np.median(g) - 20
                area = 1.0 if quad is None else quad_area(quad) / (image.shape[0] * image.shape[1])
                vec = (kernels.box_resize(g, 16, 16) / 255).ravel()
                v = kernels.visual_metrics(page)
                out.append((r.video_id, r.frame_idx, r.t_sec, quad is not None, float(area), float((kernels.hsv(page)[2] > 110).mean()), 1.0, kernels.laplacian_variance(g), float(ink.mean()), float(skin.mean()), float((skin & ink).sum() / max(1, ink.sum())), float(skin[:, :2].mean()), float(skin[low:].mean()), float(1 - min(1.0, v["v_mean"] / 200)), kernels.skew_angle(page), v["paper_ratio"], v["v_mean"], v["bottom_v"], v["skin"], v["bottom_skin"], v["blotch"], v["text_edge"], vec.tolist(), kernels.row_profile(page).tolist(), kernels.thumbnail(page).ravel().tolist()))
            yield pd.DataFrame(out, columns=FEATURES)

    return frames.mapInPandas(extract, SCHEMA)


FEATURES = ["entity", "pos", "t", "found", "area", "fill", "contact", "blur", "text", "hand", "hand_text", "edge_fg", "bottom_hand", "turn", "skew", "paper_ratio", "v_mean", "bottom_v", "skin", "bottom_skin", "blotch", "text_edge", "vec", "profile", "thumb"]
SCHEMA = "entity string, pos long, t double, found boolean, " + ", ".join(f"{x} double" for x in FEATURES[4:22]) + ", vec array<double>, profile array<double>, thumb array<int>"


def scored(features: DataFrame, p: Params = DEFAULTS, radius: int = 0) -> DataFrame:
    """Adds stability, edge_motion, raw, norm, smooth, peak, clean_visual and finger."""
    lagged = windows.lags(features, ["area", "turn"], F.col("found"))
    rows = lagged.withColumn("stability", F.coalesce(1.0 - F.least(F.lit(1.0), F.abs(F.col("area") - F.col("seen_area")) * 4), F.lit(0.5)))
    rows = rows.withColumn("edge_motion", F.coalesce(F.least(F.lit(1.0), F.abs(F.col("turn") - F.col("prev_turn"))), F.lit(0.0)))
    rows = stats.robust_norm(rows.where("found"), list(p.weights_a), lower=LOWER_IS_BETTER).withColumn("raw", scores.raw_score_a(p))
    rows = stats.robust_norm(rows, ["raw"]).withColumnRenamed("norm_raw", "norm").drop(*[f"norm_{x}" for x in p.weights_a])
    rows = windows.moving_average(rows, "norm", radius).withColumn("peak", scores.peak_score(F.col("norm"), F.col("smooth"), p=p))
    return rows.withColumn("clean_visual", scores.clean_visual_score()).withColumn("finger", scores.finger_penalty())


def chosen_items(s: greedy.Series, p: Params) -> list[dict]:
    """From the peaks of a series to what is shown: clusters, their winners, and either the expected count with its
    repairs or, without one, duplicates dropped; then better pictures, and a first page that the peaks missed."""
    clusters = [m for m, _ in greedy.first_fit(s, p, members=np.flatnonzero(s["is_peak"] > 0).tolist())]
    if p.expected > 0 and clusters:
        clusters = greedy.force_reduce(s, p.expected, clusters=clusters)
    sizes = {greedy.cluster_winner(s, m, p): len(m) for m in clusters}
    kept = sorted(sizes)
    kept = greedy.expected_count(s, kept, p.expected, p) if p.expected > 0 else greedy.dedup_recent(s, kept, p)[0]
    number = {int(pos): i for i, pos in enumerate(s.pos)}
    for better in (greedy.refinements, greedy.finger_reliefs):
        moved = {number[r["pos"]]: number[r["new_pos"]] for r in better(s, kept, p) if r["new_pos"] is not None}
        sizes |= {new: sizes.get(old, 1) for old, new in moved.items()}
        kept = sorted(moved.get(x, x) for x in kept)
    if p.expected > 0:
        kept = sorted(sorted(kept, key=lambda x: -s["peak"][x])[: p.expected])
    else:
        kept, _ = greedy.dedup_adjacent(s, kept, p)
        first = greedy.leading(s, kept, p)
        kept = kept if first is None else [first, *kept]
    return [{"pos": int(s.pos[x]), "t": float(s.t[x]), "peak": float(s["peak"][x]), "cluster_size": sizes.get(x, 1)} for x in kept]


def representatives(frames: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """entity, pos, t, page, peak and cluster_size of the chosen frames of each recording.

    Metrics, features and scores are each read several times and costly to make, so they are persisted
    (spilling to disk; a lost block is made again). The caller may unpersist them by `clearCache`.
    """
    metrics = prefilter_metrics(frames).persist()
    wanted = selection.prefilter(metrics, "composite", p).select(F.col("entity").alias("video_id"), F.col("pos").alias("frame_idx"))
    rows = scored(frame_features(frames.join(wanted, ["video_id", "frame_idx"], "left_semi")).persist(), p).persist()
    floors = stats.post_calibration(rows, p=p).select("entity", "min_norm")
    rows = rows.join(floors, "entity")
    peaks = windows.peaks_with_blur(rows, "peak", "norm", "blur", p.min_peak_distance_sec, 0.0, p.peak_tie_eps, p.peak_tie_blur, p.peak_tie_factor, bucket=60.0)
    peaks = peaks.where(F.col("norm") >= F.col("min_norm"))

    thinned = greedy.thin(peaks.withColumn("clean", scores.cleanliness()).withColumn("bits", difference_hash(F.col("vec"), 256)), p.min_peak_distance_sec, p)
    marked = rows.join(thinned.select("entity", "pos", F.lit(1.0).alias("is_peak")), ["entity", "pos"], "left").withColumn("gray", scores.gray_penalty())
    chosen = greedy.per_entity(marked.drop("found"), lambda s: chosen_items(s, p), "pos long, t double, peak double, cluster_size int")
    return windows.numbered(chosen)
