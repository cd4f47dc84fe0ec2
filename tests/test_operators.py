"""Operators beside the catalogue: folds, kernels, runs over synthetic recordings, streams, sources, sinks."""

from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import kernels, scores, vectors
from spindrift.operators import audit, greedy, selection, stats, windows
from spindrift.params import DEFAULTS
from spindrift.plans.representatives import prefilter_metrics, representatives
from spindrift.sources import sinks
from spindrift.sources.frames import FrameSource, synthetic
from spindrift.sources.images import cleaned_pages, image_files
from spindrift.streaming.lags import lag_features


def test_composite_of_measured_frames(spark):
    # Three measured frames and their composite.
    rows = [(0.7364, 205.19, 1527.04, 0.1921, 0.00000, 0.19424, 2.9126), (0.7585, 202.68, 534.96, 0.1547, 0.08139, 0.12131, 1.6350), (0.7125, 197.19, 1988.95, 0.2452, 0.10413, 0.17844, 1.8500)]
    df = spark.createDataFrame(rows, "paper_ratio double, bright_mean double, blur double, edge_density double, motion double, skin double, expected double")
    assert all(abs(r.got - r.expected) < 4e-4 for r in df.select(scores.prefilter_composite().alias("got"), "expected").collect())


def test_robust_norm_rules(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 2.0), (2, 3.0), (2, 10.0), (2, None), (2, float("nan"))], "entity long, v double")
    got = [(r.entity, r.v, r.norm_v) for r in stats.robust_norm(df, ["v"]).collect()]
    assert {n for e, _, n in got if e == 1} == {0.5}
    by = {v: n for e, v, n in got if e == 2 and v == v}
    assert by[None] == 0.0 and by[1.0] == 0.0 and by[10.0] == 1.0 and abs(by[3.0] - (3 - 1.3) / (7.9 - 1.3)) < 1e-12
    low = {r.v: r.norm_v for r in stats.robust_norm(df.where("entity = 2 and v = v"), ["v"], lower=["v"]).collect()}
    assert low[1.0] == 1.0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 14))
def test_folds_hold_their_promises(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.random((3, 64))
    s = greedy.Series.of({"pos": i, "t": float(i) * 0.7, "vec": base[rng.integers(0, 3)] + rng.random(64) * 0.05, "text": 0.1, "peak": float(rng.random()), "norm": float(rng.random())} for i in range(n))
    clusters = greedy.first_fit(s)
    assert sorted(m for c, _ in clusters for m in c) == list(range(n))
    same = lambda a, b: s.relaxed(a, b, DEFAULTS)
    kept, merges = greedy.dedup_adjacent(s, same=same)
    assert len(kept) + len(merges) == n
    again, none = greedy.dedup_adjacent(s, kept, same=same)
    assert not none and len(again) == len(kept)
    assert len(greedy.force_reduce(s, 2)) == min(2, n)
    chosen = greedy.expected_count(s, greedy.chronological(s, 3), 3)
    assert len(set(chosen)) == len(chosen) <= 3 and chosen == sorted(chosen)
    taken, dropped = greedy.dedup_recent(s)
    assert len(taken) + len(dropped) == n


def test_likeness_rows_equal_the_expressions(spark):
    rng = np.random.default_rng(9)
    v = rng.random((6, 64))
    s = greedy.Series.of({"pos": i, "t": float(i), "vec": x, "profile": (x - x.mean()) / x.std(), "thumb": x > np.median(x), "text": float(i)} for i, x in enumerate(v))
    df = spark.createDataFrame([(i, j, v[i].tolist(), v[j].tolist()) for i in range(6) for j in range(6)], "i int, j int, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    sim, ham = vectors.similarity(a, b), vectors.hamming(vectors.difference_hash(a, 64), vectors.difference_hash(b, 64))
    profile, thumb = vectors.shift_correlation(vectors.z_scores(a), vectors.z_scores(b), 64, 14), vectors.bit_agreement(vectors.median_bits(a), vectors.median_bits(b), 52)
    for r in df.select("i", "j", sim.alias("sim"), ham.alias("ham"), profile.alias("profile"), thumb.alias("thumb")).collect():
        assert s.ham(r.i, r.j) == r.ham
        for mine, theirs in ((s.sim(r.i, r.j), r.sim), (s.profile(r.i, r.j), r.profile), (s.thumb(r.i, r.j), r.thumb)):
            assert abs(mine - theirs) < 1e-9


def unlike(n, **more):
    """Items that look like nothing else, one a second."""
    rng = np.random.default_rng(1)
    return [{"pos": i, "t": float(i), "vec": rng.random(64), "text": 0.2 + 0.6 * (i % 2), "peak": 0.5, "norm": 0.5, **{k: v[i] if isinstance(v, list) else v for k, v in more.items()}} for i in range(n)]


def test_expected_chain_on_small_cases():
    s = greedy.Series.of(unlike(12, peak=[0.1, 0.9] + [0.5] * 10))
    e = greedy.Expected(s, 4)
    assert e.rescue_first([6, 8, 10]) == [1, 6, 8, 10]  # a late first item: the best early one joins
    assert len(e.rescue_first([6, 7, 9, 11])) == 4 and 1 in e.rescue_first([6, 7, 9, 11])
    assert e.rescue_first([1, 6, 8]) == [1, 6, 8]
    assert e.trim([0, 1, 2, 3, 11]) in ([0, 1, 3, 11], [0, 1, 2, 11], [1, 2, 3, 11], [0, 2, 3, 11])
    filled = e.fill([0, 11])
    assert len(filled) == 4 and {0, 1, 11} < set(filled)
    assert len(greedy.expected_count(s, [], 4)) == 4
    same = np.linspace(0, 1, 64)
    made = unlike(6, clean_visual=[0.0, 0.0, 0.0, 0.5, 0.0, 0.0], hand=[0.0, 0.0, 0.6, 0.0, 0.0, 0.0], area=1.0)
    for i in (2, 3):
        made[i] |= {"vec": same, "profile": (same - same.mean()) / same.std(), "thumb": same > 0.5}
    for i in (0, 1, 4, 5):
        made[i] |= {"profile": np.zeros(64), "thumb": np.zeros(64, bool)}
    e = greedy.Expected(greedy.Series.of(made), 3)
    assert e.same_page(2) == [2, 3] and e.cleaner_equivalents([0, 2, 5]) == [0, 3, 5]
    # An early first item makes way for the earliest with as much text and area.
    made = unlike(6, text=0.2, area=1.0)
    assert greedy.Expected(greedy.Series.of(made), 3).cleaner_equivalents([1, 4]) == [0, 4]


def test_replacements_use_each_candidate_once():
    v = np.linspace(0, 1, 64)
    pool = [{"pos": i, "t": i * 0.2, "vec": v, "text": 0.1, "hand_text": 0.9 if i in (0, 4) else 0.0, "blur": 100.0, "raw": 1.0, "finger": 0.5 if i in (0, 4) else 0.0} for i in range(5)]
    s = greedy.Series.of(pool)
    # A candidate that looks like another winner is refused by finger relief, so it gets one winner.
    for how, winners in ((greedy.alternatives, [0, 4]), (greedy.finger_reliefs, [0])):
        rows = how(s, winners)
        new = [r["new_pos"] for r in rows if r["new_pos"] is not None]
        assert new and len(set(new)) == len(new) and not set(new) & {0, 4}
    assert greedy.finger_reliefs(s, [0, 4])[0]["reasons"] == "twin=2"


def test_prefilter_covers_global_top(spark):
    rng = np.random.default_rng(6)
    rows = [(1, i, i * 0.5, float(rng.random()), float(rng.random() * 300)) for i in range(50)]
    df = spark.createDataFrame(rows, "entity long, pos long, t double, composite double, blur double")
    s = windows.smooth3(windows.positions(df), "composite")
    top = {r.pos for r in selection.global_top(s).collect()}
    assert len(top) == 22 and top <= {r.pos for r in selection.prefilter(df).collect()}
    assert selection.calibration_indices(100, 15, 60) == sorted(set(selection.calibration_indices(100, 15, 60)))


def test_kernels_on_small_rasters():
    flat = np.full((20, 30, 3), 200, np.uint8)
    m = kernels.frame_metrics(flat)
    assert m["blur"] == 0 and m["edge_density"] == 0 and m["paper_ratio"] == 1 and m["motion"] == 0 and m["bright_mean"] == 200
    assert kernels.frame_metrics(flat, np.full_like(flat, 100))["motion"] == pytest.approx(100 / 255)
    assert np.allclose(kernels.box_resize(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    assert np.isclose(kernels.box_resize(np.arange(15.0).reshape(3, 5), 2, 2).mean(), 7)
    quad = np.array([[25, 5], [5, 15], [5, 5], [25, 15]])
    assert kernels.ordered_quad(quad).tolist() == [[5, 5], [25, 5], [25, 15], [5, 15]]
    ramp = np.repeat(np.arange(40, dtype=np.uint8)[None, :, None] * 5, 20, axis=0).repeat(3, axis=2)
    out = kernels.warp(ramp, quad, 21)
    assert out.shape[1] == 21 and abs(int(out[0, 0, 0]) - 25) <= 1 and abs(int(out[0, -1, 0]) - 125) <= 1
    assert kernels.image_hash(ramp).shape == (4,)
    page = next(i for _, _, i in synthetic("synthetic:1:1"))
    assert abs(kernels.skew_angle(page)) <= 1 and kernels.page_quad(page) is not None and kernels.enhance(page).shape == page.shape
    dark = np.zeros((100, 200, 3), np.uint8)
    assert kernels.blank_page(page, 64).shape[1] == 64 and kernels.blank_page(dark, 70).shape == (40, 70, 3)
    sig = kernels.footer_signature(page)
    assert 0 <= sig["ink"] <= 1 and len(sig["cols"])


@pytest.fixture(scope="module")
def frames(spark):
    spark.dataSource.register(FrameSource)
    return spark.read.format("frames").option("paths", "synthetic:1:360,synthetic:2:240").option("step", 15).load()


def test_frame_source(spark, frames):
    assert frames.count() == 40 and frames.where("frame_idx in (15, 30, 31)").count() == 4
    assert frames.where("video_id = 'synthetic:2:240'").count() == 16


def test_run_finds_the_pages(frames):
    got = representatives(frames).collect()
    pages = {(r.entity, r.pos // 60) for r in got}
    assert {(v, k) for v, n in (("synthetic:1:360", 6), ("synthetic:2:240", 4)) for k in range(n)} >= pages
    assert len(pages) >= 6 and all(r.pos % 60 < 45 for r in got)
    exactly = representatives(frames.where("video_id = 'synthetic:1:360'"), replace(DEFAULTS, expected=4)).collect()
    assert 1 <= len(exactly) <= 4
    numbers = sorted((r.t, r.page) for r in got if r.entity == "synthetic:1:360")
    assert [n for _, n in numbers] == list(range(1, len(numbers) + 1))


def test_images_and_sinks(spark, tmp_path, frames):
    header = b"BM" + (54 + 4 * 6 * 4).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (4).to_bytes(4, "little") + (4).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.BMP").write_bytes(header + bytes([200] * 48))
    (tmp_path / "in" / "b.txt").write_text("no image")
    assert [r.path.rsplit("/", 1)[1] for r in image_files(spark, str(tmp_path / "in")).collect()] == ["a.BMP"]
    some = frames.limit(2).select(F.concat("video_id", F.lit(":"), "frame_idx").alias("path"), "height", "width", "data")
    assert all(r.found for r in cleaned_pages(some, 64).collect())
    rows = prefilter_metrics(frames).drop("entity").withColumn("t_sec", F.col("t"))
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 40
    sinks.write_json(rows.limit(3), str(tmp_path / "json"), clean=True)
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    grid = sinks.contact_sheet(spark.range(7).select((F.col("id") + 1).alias("page"))).collect()
    assert (grid[6].grid_row, grid[6].grid_column) == (1, 1)


def test_audit(spark):
    w = spark.createDataFrame([(1, 10, 0.5, float("nan")), (1, 20, 1.25, 3.0)], "entity long, pos long, t_sec double, blur double")
    d = spark.createDataFrame([(1, 20, "hand")], "entity long, pos long, reason string")
    got = {r.pos: r for r in audit.with_diagnostics(w, {"qr": d}).collect()}
    assert got[20].qr_reason == "hand" and got[20].qr_applied == 1 and got[10].qr_applied == 0
    shown = {r.pos: r for r in audit.fixed_decimals(w).collect()}
    assert shown[10].t_sec == "0.500" and shown[10].blur == "" and shown[20].blur == "3.00"
    moved = spark.createDataFrame([(1, 5, 20)], "entity long, pos long, new_pos long")
    assert {r.pos: r.original_pos for r in audit.traced(w, moved).collect()} == {10: 10, 20: 5}


def test_streamed_lags_equal_batch(spark, tmp_path):
    rows = [(e, i, float(i), float(i * e % 7), i % 3 == 0) for e in (1, 2) for i in range(8)]
    schema = "entity long, pos long, t double, value double, found boolean"
    for k in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 4 == k], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = lag_features(stream).writeStream.format("memory").queryName("lagged").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    streamed = sorted((r.entity, r.pos, r.prev_value, r.seen_value) for r in spark.sql("select * from lagged").collect() if True)
    batch = windows.lags(spark.createDataFrame(rows, schema), ["value"], F.col("found")).collect()
    assert sorted(map(str, streamed)) == sorted(str((r.entity, r.pos, r.prev_value, r.seen_value)) for r in batch)


def test_percentiles_of_large_groups_are_exact(spark):
    rng = np.random.default_rng(3)
    values = {1: rng.integers(0, 50, 3000).astype(float), 2: rng.standard_normal(777), 3: np.array([4.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "entity long, v double")
    for buffered in (0, 1000, 10**6):
        for r in stats.five_numbers(df, "v", ["entity"], buffered).collect():
            v = values[r.entity]
            assert np.allclose([r.p10, r.p25, r.p50, r.p75, r.p90], np.percentile(v, [10, 25, 50, 75, 90])) and np.isclose(r.mad, np.median(np.abs(v - np.median(v)))) and r.n == len(v)
