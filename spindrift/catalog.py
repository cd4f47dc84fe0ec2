"""Every registered query of the selection operators, each with its SQL equivalent.

Series are the events of a user, similarity signatures the rows of `embeddings`, wide feature rows those
of `lineitem`. All values are rounded, as engines sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import same, scores
from spindrift.functions.vectors import bit_agreement, difference_hash, hamming, median_bits, shift_correlation, similarity, z_scores
from spindrift.operators import audit, joins, rescue, selection, stats, windows
from spindrift.params import LOWER_IS_BETTER, PENALTIES_A, WEIGHTS_A
from spindrift.session import event_series, table

HOUR = 3600.0
REACH = 6 * HOUR
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EV = "ev AS (SELECT user_id AS entity, event_id AS pos, epoch_us(ts) / 1e6 AS t, value, event_type AS kind FROM events)"
NORM = """lim AS (SELECT entity, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM ev GROUP BY entity),
    nv AS (SELECT ev.*, CASE WHEN abs(hi - lo) < 1e-6 THEN 0.5 ELSE greatest(0.0, least(1.0, (value - lo) / (hi - lo))) END AS norm
           FROM ev JOIN lim USING (entity))"""
W = "OVER (PARTITION BY entity ORDER BY t, pos)"
SMOOTH = f"""sm AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY entity) > 3 AND lag(value) {W} IS NOT NULL AND lead(value) {W} IS NOT NULL
    THEN (lag(value) {W} + value + lead(value) {W}) / 3.0 ELSE value END AS smooth, row_number() {W} - 1 AS p, count(*) OVER (PARTITION BY entity) AS n FROM ev)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(x, digits: int = 5, nudge: float = 0.0):
    """Rounded; a nudge keeps both engines off decimal ties where inputs lie on a decimal grid."""
    x = x if not isinstance(x, str) else F.col(x)
    return F.round(x + nudge if nudge else x, digits)


def normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.robust_norm(event_series(spark, sf_dir), ["value"]).withColumnRenamed("norm_value", "norm")


@query(f"WITH {EV}, {NORM} SELECT entity, pos, round(norm, 5) AS norm FROM nv")
def robust_norm_value(spark, sf_dir):
    return normed(spark, sf_dir).select("entity", "pos", r("norm").alias("norm"))


@query(f"""WITH {EV}, p AS (SELECT kind, count(*) AS n, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
    quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90 FROM ev GROUP BY kind),
    m AS (SELECT kind, quantile_cont(abs(value - p50), 0.5) AS mad FROM ev JOIN p USING (kind) GROUP BY kind)
    SELECT kind, n, round(p10, 4) AS p10, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(p90, 4) AS p90, round(mad, 4) AS mad FROM p JOIN m USING (kind)""")
def calibration_stats(spark, sf_dir):
    s = stats.five_numbers(event_series(spark, sf_dir), "value", ["kind"])
    return s.select("kind", "n", *[r(x, 4).alias(x) for x in ("p10", "p25", "p50", "p75", "p90", "mad")])


@query(f"""WITH {EV}, {NORM}, q AS (SELECT entity, count(*) AS n, quantile_cont(norm, 0.25) AS p25, quantile_cont(norm, 0.5) AS p50 FROM nv GROUP BY entity)
    SELECT entity, n, round(p25, 4) AS p25, round(p50, 4) AS p50,
      round(CASE WHEN n < 8 THEN 0.28 WHEN p25 < 0.18 THEN 0.26 WHEN p25 > 0.48 AND p50 > 0.53 THEN 0.30 ELSE 0.28 END, 4) AS min_norm,
      n >= 8 AND (p25 < 0.18 OR (p25 > 0.48 AND p50 > 0.53)) AS applied FROM q""")
def adaptive_threshold(spark, sf_dir):
    s = stats.post_calibration(normed(spark, sf_dir))
    return s.select("entity", "n", r("p25", 4).alias("p25"), r("p50", 4).alias("p50"), r("min_norm", 4).alias("min_norm"), "applied")


#: Samples of a recording, made from line items, in SQL of both engines.
_SAMPLES = "l_suppkey AS entity, l_quantity + l_suppkey % 4 * 100 AS blur, l_discount * (l_suppkey % 5) * 2.5e0 AS skin, l_tax * (l_suppkey % 3) AS text"
_CAL = f"""x AS (SELECT {_SAMPLES} FROM lineitem), q AS (SELECT entity, count(*) AS n, quantile_cont(blur, 0.1) AS b10, quantile_cont(blur, 0.9) AS b90, quantile_cont(skin, 0.5) AS s50, quantile_cont(skin, 0.75) AS s75,
    quantile_cont(text, 0.5) AS t50 FROM x GROUP BY entity), h AS (SELECT *, n >= 6 AND (s50 > 0.45 OR s75 > 0.55) AS high_hand, (b90 - b10) / greatest(b90, 1) AS spread FROM q)"""
_SIM_MERGE = "CASE WHEN high_hand THEN 0.87e0 WHEN n >= 6 AND s75 > 0.30 THEN 0.88e0 ELSE 0.89e0 END"


def _calibration(spark, sf_dir, full):
    x = table(spark, sf_dir, "lineitem").select(*[F.expr(e) for e in _SAMPLES.split(", ")])
    return stats.calibration(x, "blur", "skin", "text" if full else None).select("entity", r("min_norm", 4).alias("min_norm"), r("sim_merge", 4).alias("sim_merge"), "hash_merge", "high_hand")


@query(f"WITH {_CAL} SELECT entity, CASE WHEN high_hand THEN 0.26e0 ELSE 0.28e0 END AS min_norm, {_SIM_MERGE} AS sim_merge, 11 AS hash_merge, high_hand FROM h")
def calibration_overrides(spark, sf_dir):
    return _calibration(spark, sf_dir, False)


@query(f"""WITH {_CAL} SELECT entity, CASE WHEN high_hand THEN 0.26e0 WHEN n < 6 OR b90 <= 1e-3 THEN 0.28e0 WHEN spread < 0.20 THEN 0.26e0 WHEN spread > 0.92 THEN 0.30e0 ELSE 0.28e0 END AS min_norm,
    {_SIM_MERGE} AS sim_merge, CASE WHEN n >= 6 AND t50 < 0.015 THEN 12 ELSE 11 END AS hash_merge, high_hand FROM h""")
def full_calibration(spark, sf_dir):
    return _calibration(spark, sf_dir, True)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations: entity (part), pos, and the features that scores read."""
    li = table(spark, sf_dir, "lineitem")
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    made = {
        "paper_ratio": d * 8, "blur": q * 9, "edge_density": x * 3, "bright_mean": q * 3 + 60, "motion": x / 2, "skin": d,
        "area": q / 50, "fill": 1 - d, "contact": 1 - x, "stability": 1 - d / 2, "text": x / 4, "hand": d * 4, "hand_text": d * 6,
        "edge_fg": x * 2, "bottom_hand": x * 7, "turn": q / 80, "edge_motion": q / 55, "skew": q / 4 - 6, "bottom_dark": x * 5,
        "v_mean": 200 + q, "bottom_v": 180 + q, "bottom_skin": d / 2, "blotch": q / 3, "text_edge": q,
    }
    return li.select(F.col("l_partkey").alias("entity"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_extendedprice").alias("price"), *[v.alias(k) for k, v in made.items()])


FX = """fx AS (SELECT l_partkey AS entity, l_orderkey * 10 + l_linenumber AS pos, l_extendedprice AS price, l_discount * 8 AS paper_ratio, l_quantity * 9 AS blur, l_tax * 3 AS edge_density,
    l_quantity * 3 + 60 AS bright_mean, l_tax / 2 AS motion, l_discount AS skin, l_quantity / 50 AS area, 1 - l_discount AS fill, 1 - l_tax AS contact,
    1 - l_discount / 2 AS stability, l_tax / 4 AS text, l_discount * 4 AS hand, l_discount * 6 AS hand_text, l_tax * 2 AS edge_fg, l_tax * 7 AS bottom_hand,
    l_quantity / 80 AS turn, l_quantity / 55 AS edge_motion, l_quantity / 4 - 6 AS skew, l_tax * 5 AS bottom_dark, 200 + l_quantity AS v_mean, 180 + l_quantity AS bottom_v,
    l_discount / 2 AS bottom_skin, l_quantity / 3 AS blotch, l_quantity AS text_edge FROM lineitem)"""


@query(f"""WITH {FX} SELECT entity, pos, round(1.30 * least(paper_ratio / 0.55, 1) + 0.85 * least(blur / 200, 1) + 0.95 * least(edge_density / 0.20, 1)
    + 0.40 * greatest(0, least(1, (bright_mean - 90) / 100)) - 1.10 * least(motion / 0.04, 1) - 0.55 * least(skin / 0.12, 1), 5) AS composite FROM fx""")
def weighted_composite(spark, sf_dir):
    return features(spark, sf_dir).select("entity", "pos", r(scores.prefilter_composite()).alias("composite"))


_LIMITS = ", ".join(f"quantile_cont({f}, 0.1) AS {f}_lo, quantile_cont({f}, 0.9) AS {f}_hi" for f in WEIGHTS_A)


def _norm_sql(f: str) -> str:
    up = f"greatest(0.0, least(1.0, ({f} - {f}_lo) / ({f}_hi - {f}_lo)))"
    return f"(CASE WHEN abs({f}_hi - {f}_lo) < 1e-6 THEN 0.5 ELSE {('1.0 - ' if f in LOWER_IS_BETTER else '') + up} END)"


_PLAIN = " + ".join(f"{w} * {f}" for f, w in PENALTIES_A.items())


@query(f"""WITH {FX}, li AS (SELECT entity, {_LIMITS} FROM fx GROUP BY entity)
    SELECT entity, pos, round({' + '.join(f'{w} * {_norm_sql(f)}' for f, w in WEIGHTS_A.items())} - ({_PLAIN}) + 1e-9, 4) AS raw_a,
    round(1.40 * area + 0.85 * fill + 0.85 * contact + 0.95 * stability + 0.65 * (ln(1 + blur) / 8) + 0.50 * text - 0.85 * hand - 2.40 * hand_text - 1.55 * edge_fg - 0.75 * bottom_hand - 0.70 * turn + 1e-9, 4) AS raw_b FROM fx JOIN li USING (entity)""")
def raw_score_forms(spark, sf_dir):
    f = stats.robust_norm(features(spark, sf_dir), list(WEIGHTS_A), lower=LOWER_IS_BETTER)
    return f.select("entity", "pos", r(scores.raw_score_a(), 4, 1e-9).alias("raw_a"), r(scores.raw_score_b(), 4, 1e-9).alias("raw_b"))


@query(f"""WITH {FX}, x AS (SELECT *, 1.20 * paper_ratio + 0.014 * (v_mean - 240) + 0.005 * (bottom_v - 200) - 1.40 * skin - 1.10 * bottom_skin
      - 0.045 * greatest(0, blotch - 6) + 0.012 * least(text_edge, 30) AS clean, least(1, 1.6 * bottom_skin + 0.6 * skin) AS finger FROM fx)
    SELECT entity, pos, round(clean + 1e-9, 5) AS clean_visual, round(finger, 5) AS finger,
      round(least(1, 0.4 * greatest(0, (245 - v_mean) / 60) + 0.4 * greatest(0, (blotch - 6) / 12) + 0.2 * greatest(0, (0.92 - paper_ratio) / 0.30)) + 1e-9, 5) AS gray,
      round(0.55 * hand_text + 0.30 * bottom_hand + 0.15 * hand, 5) AS hands,
      hand_text >= 0.55 OR bottom_hand >= 0.85 OR (hand >= 0.20 AND hand_text >= 0.45) AS dirty,
      round(0.65 * clean - 0.80 * finger + 0.10 * least(blur / 400, 1) - 0.2 * (hand_text + bottom_hand + hand) - 0.04 * abs(skew) - 0.15 * turn - 0.10 * edge_motion + 1e-9, 5) AS refine,
      round(-(2.4 * hand_text + 2.2 * bottom_hand + 1.7 * hand + 1.2 * edge_fg), 5) AS cleanliness FROM x""")
def visual_scores(spark, sf_dir):
    f = features(spark, sf_dir).withColumn("clean_visual", scores.clean_visual_score()).withColumn("finger", scores.finger_penalty())
    return f.select("entity", "pos", r("clean_visual", 5, 1e-9).alias("clean_visual"), r("finger").alias("finger"), r(scores.gray_penalty(), 5, 1e-9).alias("gray"), r(scores.hand_score()).alias("hands"), scores.is_dirty().alias("dirty"), r(scores.refine_score(), 5, 1e-9).alias("refine"), r(scores.cleanliness()).alias("cleanliness"))


@query(f"""WITH {FX}, x AS (SELECT *, area AS peak, fill AS norm, 1.20 * paper_ratio + 0.014 * (v_mean - 240) + 0.005 * (bottom_v - 200) - 1.40 * skin - 1.10 * bottom_skin
      - 0.045 * greatest(0, blotch - 6) + 0.012 * least(text_edge, 30) AS clean, least(1, 1.6 * bottom_skin + 0.6 * skin) AS finger FROM fx)
    SELECT entity, pos,
      round(0.55 * peak + 0.45 * norm - 0.05 * greatest(0, abs(skew) - 8) - (0.55 * hand_text + 0.40 * bottom_hand + 0.40 * hand) + 1e-9, 5) AS select_normal,
      round(0.55 * peak + 0.45 * norm - 0.05 * 1.7 * greatest(0, abs(skew) - 8) - (0.55 * 1.6 * hand_text + 0.40 * 1.7 * bottom_hand + 0.40 * 1.5 * hand) + 1e-9, 5) AS select_high,
      round((0.64 * norm + 0.36 * peak) * (0.84 + 0.16 * (1 - least(1, 0.55 * hand + 0.55 * hand_text + 0.30 * edge_fg + 0.35 * bottom_hand))) + 1e-9, 5) AS peak_normal,
      round((0.64 * norm + 0.36 * peak) * (0.78 + 0.22 * (1 - least(1, 0.75 * hand + 0.85 * hand_text + 0.30 * edge_fg + 0.55 * bottom_hand))) - 1.8 * 0.03 * greatest(0, abs(skew) - 8) + 1e-9, 5) AS peak_high,
      round(0.5 * peak + 0.2 * norm + 0.3 * clean + 0.1 * stability + 0.08 * least(blur / 400, 1) - 0.85 * finger - 0.22 * hand_text - 0.20 * bottom_hand - 0.18 * hand - 0.2 * turn
        - 0.1 * edge_motion - CASE WHEN abs(skew) <= 3 THEN 0.05 * abs(skew) ELSE 0.15 + 0.3 * (abs(skew) - 3) END + 1e-9, 5) AS quality FROM x""")
def cluster_scores(spark, sf_dir):
    f = features(spark, sf_dir).withColumn("peak", F.col("area")).withColumn("norm", F.col("fill"))
    f = f.withColumn("clean_visual", scores.clean_visual_score()).withColumn("finger", scores.finger_penalty())
    n, k = F.col("norm"), F.col("peak")
    return f.select("entity", "pos", r(scores.cluster_select_score(), 5, 1e-9).alias("select_normal"), r(scores.cluster_select_score(True), 5, 1e-9).alias("select_high"), r(scores.peak_score(n, k), 5, 1e-9).alias("peak_normal"), r(scores.peak_score(n, k, True), 5, 1e-9).alias("peak_high"), r(scores.dedup_quality(), 5, 1e-9).alias("quality"))


_VISUAL = """vx AS (SELECT *, 1.20 * paper_ratio + 0.014 * (v_mean - 240) + 0.005 * (bottom_v - 200) - 1.40 * skin - 1.10 * bottom_skin - 0.045 * greatest(0, blotch - 6) + 0.012 * least(text_edge, 30) AS cvs,
    6 * skin AS finger FROM fx)"""


def _tag(name: str, test: str, *values: str) -> str:
    shown = " || '/' || ".join(f"'{n}=' || printf('%.2f', {v} + 1e-9)" for n, v in zip(name.split("/"), values))
    return f"CASE WHEN {test} THEN {shown} END"


_TAGS = [
    _tag("hand", "hand >= 0.40", "hand"), _tag("hand_text", "hand_text >= 0.35", "hand_text"), _tag("bottom_hand", "bottom_hand >= 0.55", "bottom_hand"), _tag("skew", "abs(skew) >= 4", "abs(skew)"),
    _tag("turn", "turn >= 0.55", "turn"), _tag("edge_motion", "edge_motion >= 0.85", "edge_motion"), _tag("cvs/finger", "cvs < -0.10 AND finger >= 0.30", "cvs", "finger"),
]
_TAG = f"list_filter([{', '.join(_TAGS)}], lambda x: x IS NOT NULL)"


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with suspicious_reasons; values are nudged off decimal ties, as in the SQL."""
    f = features(spark, sf_dir).withColumn("clean_visual", scores.clean_visual_score()).withColumn("finger", 6 * F.col("skin"))
    return f.select("entity", "pos", scores.suspicious_reasons(nudge=1e-9).alias("tags"))


@query(f"WITH {FX}, {_VISUAL} SELECT entity, pos, array_to_string({_TAG}, ',') AS tags FROM vx")
def reason_tags(spark, sf_dir):
    return tagged(spark, sf_dir)


@query(f"""WITH {FX}, {_VISUAL}, t AS (SELECT entity, split_part(unnest({_TAG}), '=', 1) AS tag FROM vx), k AS (SELECT entity, tag, count(*) AS n FROM t GROUP BY entity, tag)
    SELECT entity, string_agg(tag || '=' || n, ',' ORDER BY tag) AS summary FROM k GROUP BY entity""")
def reject_histogram(spark, sf_dir):
    tags = tagged(spark, sf_dir).select("entity", F.explode(F.split("tags", ",")).alias("tag")).where("tag <> ''")
    return stats.reason_histogram(tags.withColumn("tag", F.split("tag", "=")[0]), "tag", ["entity"])


@query(f"WITH {EV}, {SMOOTH} SELECT entity, pos, round(smooth, 4) AS smooth FROM sm")
def smooth3_edge_raw(spark, sf_dir):
    return windows.smooth3(event_series(spark, sf_dir), "value").select("entity", "pos", r("smooth", 4).alias("smooth"))


_ALL = "OVER (PARTITION BY entity ORDER BY t, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_MA = " + ".join(f"coalesce(lag(value, {k}) {W}, first_value(value) {_ALL}) + coalesce(lead(value, {k}) {W}, last_value(value) {_ALL})" for k in (1, 2))


@query(f"WITH {EV} SELECT entity, pos, round((value + {_MA}) / 5.0, 4) AS smooth FROM ev")
def moving_avg_edge(spark, sf_dir):
    return windows.moving_average(event_series(spark, sf_dir), "value", 2).select("entity", "pos", r("smooth", 4).alias("smooth"))


_PEAKS = f"""pk AS (SELECT * FROM (SELECT *, max(smooth) OVER (PARTITION BY entity ORDER BY t, pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top,
    lag(smooth) {W} AS a, lead(smooth) {W} AS b FROM sm) WHERE smooth >= top - 1e-6 AND (smooth > a + 1e-6 OR smooth > b + 1e-6 OR (a IS NULL AND b IS NULL)))"""


@query(f"WITH {EV}, {SMOOTH}, {_PEAKS} SELECT entity, pos, round(smooth, 4) AS smooth FROM pk")
def local_peaks_rows(spark, sf_dir):
    s = windows.smooth3(event_series(spark, sf_dir), "value")
    return windows.peaks_by_rows(s, "smooth").select("entity", "pos", r("smooth", 4).alias("smooth"))


_TIMED = f"""tp AS (SELECT * FROM (SELECT *, max(norm) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING) AS top FROM nv)
    WHERE norm >= top AND norm >= 0.28)"""


@query(f"WITH {EV}, {NORM}, {_TIMED} SELECT entity, pos, round(norm, 5) AS norm, row_number() OVER (PARTITION BY entity ORDER BY t, pos)::int AS page FROM tp")
def local_peaks_range(spark, sf_dir):
    peaks = windows.peaks_by_time(normed(spark, sf_dir), "norm", "norm", REACH, 0.28)
    return windows.numbered(peaks).select("entity", "pos", r("norm").alias("norm"), "page")


@query(f"""WITH {EV}, {NORM}, b AS (SELECT *, (pos * 37) % 1000 AS blur FROM nv)
    SELECT x.entity, x.pos FROM b x WHERE x.norm >= 0.28 AND NOT EXISTS (SELECT 1 FROM b y WHERE y.entity = x.entity AND y.pos <> x.pos AND abs(y.t - x.t) <= {REACH}
      AND ((y.norm > x.norm AND NOT (y.norm - x.norm <= 0.05 AND x.blur >= 200 AND x.blur > y.blur * 2))
        OR (y.norm < x.norm AND x.norm - y.norm <= 0.05 AND y.blur >= 200 AND y.blur > x.blur * 2)))""")
def peak_blur_tiebreak(spark, sf_dir):
    rows = normed(spark, sf_dir).withColumn("blur", F.col("pos") * 37 % 1000)
    return windows.peaks_with_blur(rows, "norm", "norm", "blur", REACH, 0.28, 0.05, 200.0, 2.0).select("entity", "pos")


@query(f"""WITH {EV}, {SMOOTH}, s AS (SELECT *, least(9, floor(p / (n / 10.0)))::int AS slot FROM sm)
    SELECT entity, slot, pos, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity, slot ORDER BY smooth DESC, p)::int AS k FROM s) WHERE k <= 2""")
def slot_topk_position(spark, sf_dir):
    s = windows.slot_by_position(windows.smooth3(windows.positions(event_series(spark, sf_dir)), "value"), 10)
    return windows.top_per(s, ["entity", "slot"], [F.desc("smooth"), F.asc("p")], 2).select("entity", "slot", "pos", "rank")


@query(f"""WITH {EV}, e AS (SELECT entity, min(t) AS t0, max(t) AS t1 FROM ev GROUP BY entity HAVING max(t) > min(t)),
    s AS (SELECT ev.*, k AS slot FROM ev JOIN e USING (entity) JOIN range(8) g(k) ON (t - t0) / ((t1 - t0) / 8.0) >= k AND (t - t0) / ((t1 - t0) / 8.0) <= k + 1)
    SELECT entity, slot::int AS slot, pos, round(value, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY entity, slot ORDER BY value DESC, pos) AS k FROM s) WHERE k = 1""")
def slot_best_time(spark, sf_dir):
    return windows.best_per_time_slot(event_series(spark, sf_dir), "value", 8).select("entity", "slot", "pos", r("score", 4).alias("score"))


_SELECT = """tk AS (SELECT *, least(greatest(12, round_even(n * 0.45, 0))::bigint, n) AS k FROM sm),
    tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY smooth DESC, p) AS rk FROM tk) WHERE rk <= k)"""


@query(f"""WITH {EV}, {SMOOTH}, {_PEAKS}, {_SELECT}, bl AS (SELECT *, (pos * 37) % 1000 AS blur FROM tk),
    en AS (SELECT entity, min(p) AS f, max(p) AS l, max(k) AS kk FROM tp GROUP BY entity),
    ea AS (SELECT en.*, a.blur AS fb, b.blur AS lb FROM en JOIN bl a ON a.entity = en.entity AND a.p = f JOIN bl b ON b.entity = en.entity AND b.p = l),
    sd AS (SELECT bl.entity, bl.p, smooth, blur, 'head' AS edge, fb AS anchor, p AS far FROM bl JOIN ea USING (entity) WHERE n >= 4 AND p < f AND f >= greatest(2, round_even(n / greatest(1, kk * 2), 0))
      UNION ALL SELECT bl.entity, bl.p, smooth, blur, 'tail', lb, n - 1 - p FROM bl JOIN ea USING (entity) WHERE n >= 4 AND p > l AND n - 1 - l >= greatest(2, round_even(n / greatest(1, kk * 2), 0))),
    ok AS (SELECT entity, edge, max(smooth) AS top FROM sd GROUP BY entity, edge HAVING CASE WHEN max(anchor) > 1 THEN max(blur) / max(anchor) ELSE max(blur) END >= 2.5),
    eg AS (SELECT sd.entity, arg_min(p, far) AS p FROM sd JOIN ok USING (entity, edge) WHERE smooth >= top - 1e-6 GROUP BY sd.entity, edge),
    un AS (SELECT entity, p FROM tp UNION SELECT entity, p FROM pk WHERE n >= 3 UNION SELECT entity, p FROM eg),
    sp AS (SELECT DISTINCT entity, p + d AS p FROM un, range(-1, 2) g(d))
    SELECT sm.entity, sm.p::int AS p, sm.pos FROM sm JOIN sp ON sp.entity = sm.entity AND sp.p = sm.p""")
def prefilter_select_union(spark, sf_dir):
    rows = event_series(spark, sf_dir).withColumn("blur", F.col("pos") * 37 % 1000)
    return selection.prefilter(rows, "value").select("entity", F.col("p").cast("int").alias("p"), "pos")


_CHOSEN = "kind = 'purchase'"


@query(f"""WITH {EV}, c AS (SELECT entity, t, pos FROM ev WHERE {_CHOSEN} UNION ALL SELECT entity, min(t), -1 FROM ev GROUP BY entity UNION ALL SELECT entity, max(t), 4611686018427387904 FROM ev GROUP BY entity)
    SELECT entity, round(t, 3) AS start, round(stop, 3) AS stop, round(stop - t, 3) AS gap FROM (SELECT *, lead(t) {W} AS stop FROM c) WHERE stop IS NOT NULL""")
def gap_intervals(spark, sf_dir):
    g = windows.gaps(event_series(spark, sf_dir).withColumn("chosen", F.expr(_CHOSEN)))
    return g.select("entity", r("start", 3).alias("start"), r("stop", 3).alias("stop"), r("gap", 3).alias("gap"))


_TYPICAL = f"""g AS (SELECT entity, lead(t) {W} - t AS gap FROM ev WHERE {_CHOSEN}),
    md AS (SELECT entity, list_sort(list(gap))[1 + count(*) // 2] AS typical FROM g WHERE gap IS NOT NULL GROUP BY entity)"""


@query(f"WITH {EV}, {_TYPICAL} SELECT entity, round(typical, 3) AS typical FROM md")
def upper_median_gap(spark, sf_dir):
    g = windows.upper_median_gap(event_series(spark, sf_dir).withColumn("chosen", F.expr(_CHOSEN)))
    return g.select("entity", r("typical", 3).alias("typical"))


@query(f"""WITH {EV}, {_TYPICAL}, c AS (SELECT entity, t, pos FROM ev WHERE {_CHOSEN} UNION ALL SELECT entity, min(t), -1 FROM ev GROUP BY entity UNION ALL SELECT entity, max(t), 4611686018427387904 FROM ev GROUP BY entity),
    w AS (SELECT entity, t AS start, lead(t) {W} AS stop FROM c), sp AS (SELECT entity, max(t) - min(t) AS span FROM ev GROUP BY entity HAVING count(*) FILTER ({_CHOSEN}) > 0),
    over AS (SELECT w.* FROM w JOIN sp USING (entity) LEFT JOIN md USING (entity) WHERE stop - start > 1.8 * greatest(0.5, coalesce(typical, span))),
    wide AS (SELECT * FROM over WHERE entity IN (SELECT entity FROM over GROUP BY entity HAVING max(stop - start) >= 4)),
    x AS (SELECT DISTINCT ev.entity, ev.pos, ev.t FROM ev JOIN wide ON wide.entity = ev.entity AND ev.t >= start AND ev.t <= stop WHERE NOT ({_CHOSEN}))
    SELECT entity, pos FROM (SELECT *, row_number() {W} AS k FROM x) WHERE k <= 24""")
def gap_extra_rows(spark, sf_dir):
    rows = event_series(spark, sf_dir).withColumn("chosen", F.expr(_CHOSEN))
    return rescue.extra_rows(rows, windows.wide_gaps(rows), 24, 24 * HOUR)


@query(f"""WITH {EV} SELECT entity, pos, r_pos, round(dt, 3) AS dt, rank FROM (SELECT a.entity, a.pos, b.pos AS r_pos, abs(b.t - a.t) AS dt,
      row_number() OVER (PARTITION BY a.entity, a.pos ORDER BY abs(b.t - a.t), b.pos)::int AS rank
    FROM ev a JOIN ev b ON a.entity = b.entity AND a.pos <> b.pos AND abs(b.t - a.t) <= {2 * REACH} WHERE a.kind = 'purchase') WHERE rank <= 3""")
def band_join_nearest_k(spark, sf_dir):
    ev = event_series(spark, sf_dir)
    return joins.nearest(ev.where(_CHOSEN), ev, 2 * REACH, 3).select("entity", "pos", "r_pos", r("dt", 3).alias("dt"), "rank")


@query(f"""WITH {EV}, w AS (SELECT * FROM ev WHERE {_CHOSEN}), p AS (SELECT a.entity, a.pos, b.pos AS r_pos, b.t AS r_t, abs(b.t - a.t) AS dt
      FROM w a JOIN ev b ON a.entity = b.entity AND a.pos <> b.pos AND abs(b.t - a.t) <= {2 * REACH} WHERE b.kind <> 'purchase')
    SELECT entity, pos, r_pos FROM p WHERE NOT EXISTS (SELECT 1 FROM w o WHERE o.entity = p.entity AND o.pos <> p.pos AND abs(p.r_t - o.t) < p.dt AND abs(p.r_t - o.t) <= {REACH})""")
def steal_zone_anti(spark, sf_dir):
    ev = event_series(spark, sf_dir)
    winners = ev.where(_CHOSEN)
    pairs = joins.band_join(winners, ev.where("kind <> 'purchase'"), 2 * REACH, ["pos"]).where("pos <> r_pos")
    return joins.outside_steal_zone(pairs, winners, REACH).select("entity", "pos", "r_pos")


@query(f"""WITH {EV}, c AS (SELECT * FROM ev WHERE {_CHOSEN})
    SELECT e.entity, e.pos, b.pos AS before_pos, a.pos AS after_pos FROM (SELECT * FROM ev WHERE kind = 'error') e
    ASOF LEFT JOIN c b ON e.entity = b.entity AND e.t >= b.t ASOF LEFT JOIN c a ON e.entity = a.entity AND e.t <= a.t""")
def bracket_neighbors(spark, sf_dir):
    ev = event_series(spark, sf_dir)
    return joins.brackets(ev.where("kind = 'error'"), ev, F.expr(_CHOSEN)).select("entity", "pos", "before_pos", "after_pos")


@query(f"""WITH {EV}, d AS (SELECT entity, floor(t / 86400)::bigint AS day, sum(value) AS total FROM ev WHERE {_CHOSEN} GROUP BY ALL),
    l AS (SELECT DISTINCT entity FROM ev), s AS (SELECT min(floor(t / 86400)::bigint) AS a, max(floor(t / 86400)::bigint) AS b FROM ev),
    tl AS (SELECT entity, unnest(range(a, b + 1)) AS day FROM l, s)
    SELECT entity, day, round(coalesce(total, 0), 4) AS total, total IS NOT NULL AS found FROM tl LEFT JOIN d USING (entity, day)""")
def complete_timeline(spark, sf_dir):
    ev = event_series(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400))
    span = ev.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    timeline = ev.select("entity").distinct().join(span).select("entity", F.explode(F.sequence("a", "b")).alias("day"))
    daily = ev.where(_CHOSEN).groupBy("entity", "day").agg(F.sum("value").alias("total"))
    return joins.complete(timeline, daily, ["entity", "day"], {"total": 0.0}).select("entity", "day", r("total", 4).alias("total"), "found")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1""")
def argmax_tiebreak(spark, sf_dir):
    return stats.argmax(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice"), -F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


#: Prefilter metrics of events, made from their ids and values, in SQL of both engines.
METRICS = {
    "paper_ratio": "0.60e0 + pos % 5 / 10e0", "motion": "pos % 7 / 70e0", "blur": "value + pos % 50", "bottom_dark": "pos % 11 / 15e0",
    "edge_density": "pos % 13 / 100e0", "skin": "pos % 6 / 10e0", "bright_mean": "100e0 + pos % 90",
    "area": "0.40e0 + pos % 7 / 10e0", "fill": "0.80e0 + pos % 4 / 20e0", "edge_motion": "pos % 10 / 12e0", "turn": "pos % 9 / 12e0", "text": "pos % 4 / 400e0",
    "ham": "pos % 64", "sim": "pos % 30 / 30e0",
}
_METRICS = f"mt AS (SELECT ev.*, {_CHOSEN} AS chosen, {', '.join(f'{x} AS {k}' for k, x in METRICS.items())} FROM ev)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_series(spark, sf_dir).select("*", F.expr(_CHOSEN).alias("chosen"), *[F.expr(x).alias(k) for k, x in METRICS.items()])


@query(f"""WITH {EV}, {_METRICS}, w AS (SELECT entity, t AS start, lead(t) {W} AS stop FROM mt WHERE chosen),
    i AS (SELECT w.entity, start, pos, blur, motion FROM w JOIN mt ON mt.entity = w.entity AND t > start + 0.05 AND t < stop - 0.05 WHERE stop - start >= 1.5 AND NOT chosen AND paper_ratio >= 0.75 AND motion <= 0.05
      AND blur >= 80 AND bottom_dark <= 0.60 AND edge_density <= 0.10 AND skin <= 0.40 AND bright_mean >= 120)
    SELECT entity, round(start, 3) AS start, pos FROM (SELECT *, row_number() OVER (PARTITION BY entity, start ORDER BY blur DESC, motion, pos) AS k FROM i) WHERE k = 1""")
def blank_rescue(spark, sf_dir):
    return rescue.blank_rescue(metrics(spark, sf_dir), bucket=24 * HOUR).select("entity", r("start", 3).alias("start"), "pos")


@query(f"""WITH {EV}, {_METRICS}, f AS (SELECT entity, min(t) AS ft FROM mt WHERE chosen GROUP BY entity),
    x AS (SELECT mt.* FROM mt JOIN f USING (entity) WHERE t < ft - 0.05 AND ft - t >= 1.5 AND area >= 0.55 AND fill >= 0.85 AND edge_motion <= 0.50 AND turn <= 0.50 AND blur >= 50 AND text >= 0.005 AND (ham >= 22 OR sim <= 0.55))
    SELECT entity, pos FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY blur DESC, edge_motion, turn, t, pos) AS k FROM x) WHERE k = 1""")
def leading_rescue(spark, sf_dir):
    return rescue.leading_rescue(metrics(spark, sf_dir), F.col("ham"), F.col("sim"))


@query(f"""WITH {FX}, z AS (SELECT *, pos % 97 = 0 AS late, fill + area AS a, fill - area AS b FROM fx)
    SELECT entity, pos, round(CASE WHEN max(late::int) OVER (PARTITION BY entity) = 1 THEN b ELSE a END, 5) AS raw FROM z""")
def late_rescore(spark, sf_dir):
    f = features(spark, sf_dir)
    return rescue.rescored(f, F.col("pos") % 97 == 0, F.col("fill") + F.col("area"), F.col("fill") - F.col("area")).select("entity", "pos", r("raw").alias("raw"))


@query(f"SELECT * FROM (WITH {FX} SELECT entity, pos, price FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY price DESC, pos) AS k FROM fx) WHERE k <= 5)")
def cap_to_count(spark, sf_dir):
    return rescue.cap(features(spark, sf_dir), "price", 5).select("entity", "pos", "price")


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("entity"), F.col("vec_id").alias("pos"), e.alias("v"), (20 + F.col("vec_id") % 9 * 5).cast("double").alias("text"))


def signature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by id within a label: each row with the next four. No pair table of a whole label."""
    s = signatures(spark, sf_dir)
    w = Window.partitionBy("entity").orderBy("pos")
    item = F.struct("pos", "v", "text")
    ahead = s.withColumn("next", F.array_compact(F.array(*[F.lead(item, k).over(w) for k in range(1, 5)])))
    return ahead.select("entity", "pos", "v", "text", F.explode("next").alias("o")).select("entity", F.col("pos").alias("a"), F.col("o.pos").alias("b"), F.col("v").alias("va"), F.col("o.v").alias("vb"), F.col("text").alias("ta"), F.col("o.text").alias("tb"))


SIG = """sg AS (SELECT label AS entity, vec_id AS pos, list_transform(embedding, lambda x: x::double) AS v, (20 + vec_id % 9 * 5)::double AS text,
      row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
    pr AS (SELECT x.entity, x.pos AS a, y.pos AS b, x.v AS va, y.v AS vb, x.text AS ta, y.text AS tb FROM sg x JOIN sg y ON x.entity = y.entity AND y.i BETWEEN x.i + 1 AND x.i + 4)"""
_HAM = "list_sum(list_transform(range(1, len(va)), lambda i: CASE WHEN (va[i + 1] > va[i]) <> (vb[i + 1] > vb[i]) THEN 1 ELSE 0 END))"


def _z(v: str) -> str:
    return f"list_transform({v}, lambda x: (x - list_avg({v})) / list_stddev_pop({v}))"


_SIM = f"(0.85 * list_dot_product({_z('va')}, {_z('vb')}) / len(va) + 0.15 * (1 - list_distance(va, vb) * list_distance(va, vb) / len(va)))"
_REL = "abs(ta - tb) / greatest(ta, tb)"


@query(f"WITH {SIG} SELECT a, b, round({_SIM}, 4) AS sim FROM pr")
def zscore_similarity(spark, sf_dir):
    return signature_pairs(spark, sf_dir).select("a", "b", r(similarity(F.col("va"), F.col("vb")), 4).alias("sim"))


@query(f"""WITH {SIG}, zz AS (SELECT a, b, {_z('va')} AS x, {_z('vb')} AS y FROM pr)
    SELECT a, b, round(greatest(-1, list_max(list_transform(range(-6, 7), lambda s: CASE WHEN s >= 0 THEN list_dot_product(x[s + 1:64], y[1:64 - s]) / (64 - s)
      ELSE list_dot_product(x[1:64 + s], y[1 - s:64]) / (64 + s) END))), 4) AS corr FROM zz""")
def shift_corr(spark, sf_dir):
    p = signature_pairs(spark, sf_dir).withColumn("x", z_scores(F.col("va"))).withColumn("y", z_scores(F.col("vb")))
    return p.select("a", "b", r(shift_correlation(F.col("x"), F.col("y"), 64, 6), 4).alias("corr"))


@query(f"""WITH {SIG} SELECT a, b, round(list_sum(list_transform(range(1, 53), lambda i: CASE WHEN (va[i] > list_median(va)) = (vb[i] > list_median(vb)) THEN 1 ELSE 0 END)) / 52.0, 4) AS thumb FROM pr""")
def thumbnail_match(spark, sf_dir):
    p = signature_pairs(spark, sf_dir)
    return p.select("a", "b", r(bit_agreement(median_bits(F.col("va")), median_bits(F.col("vb")), 52), 4).alias("thumb"))


def measured_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = signature_pairs(spark, sf_dir)
    ham = hamming(difference_hash(F.col("va"), 64), difference_hash(F.col("vb"), 64))
    profile = shift_correlation(z_scores(F.col("va")), z_scores(F.col("vb")), 64, 6)
    thumb = bit_agreement(median_bits(F.col("va")), median_bits(F.col("vb")), 52)
    return p.select("a", "b", ham.alias("ham"), r(similarity(F.col("va"), F.col("vb")), 6).alias("sim"), scores.text_difference(F.col("ta"), F.col("tb")).alias("text_rel"), r(profile, 6).alias("profile"), r(thumb, 6).alias("thumb"))


_SHIFTED = """greatest(-1, list_max(list_transform(range(-6, 7), lambda s: CASE WHEN s >= 0 THEN list_dot_product(x[s + 1:64], y[1:64 - s]) / (64 - s) ELSE list_dot_product(x[1:64 + s], y[1 - s:64]) / (64 + s) END)))"""
_THUMB = "list_sum(list_transform(range(1, 53), lambda i: CASE WHEN (va[i] > list_median(va)) = (vb[i] > list_median(vb)) THEN 1 ELSE 0 END)) / 52.0"


@query(f"""WITH {SIG}, z AS (SELECT *, {_z('va')} AS x, {_z('vb')} AS y FROM pr), m AS (SELECT a, b, {_HAM} AS ham, round({_SIM}, 6) AS sim, {_REL} AS rel, round({_SHIFTED}, 6) AS prof, round({_THUMB}, 6) AS thumb FROM z)
    SELECT a, b, (rel <= 0.35 AND (sim >= 0.62 OR ham <= 22 OR prof >= 0.45)) OR (rel <= 0.45 AND thumb >= 0.78) OR (sim >= 0.89 AND ham <= 11) AS relaxed,
      (sim >= 0.55 AND ham <= 18) OR ((sim >= 0.35 OR ham <= 28) AND rel <= 0.25) OR (rel <= 0.15 AND ham <= 34) AS alternative, sim >= 0.89 AND ham <= 11 AS strict FROM m""")
def relaxed_same_pairs(spark, sf_dir):
    return measured_pairs(spark, sf_dir).select("a", "b", same.relaxed().alias("relaxed"), same.alternative().alias("alternative"), same.strict().alias("strict"))


@query(f"""WITH {SIG}, m AS (SELECT a, b, {_HAM} AS ham, round({_SIM}, 6) AS sim, {_REL} AS rel, (a % 50) / 10.0 AS dt, (a % 90) / 100.0 AS ta, (b % 90) / 100.0 AS tb, 1.0 + a % 40 AS ba, 1.0 + b % 40 AS bb,
      (a % 7) / 10.0 AS thumb, (b % 7) / 10.0 AS prof, (a % 11) = 0 AS dis, (a % 30) / 100.0 AS ia, (b % 30) / 100.0 AS ib, (a + b) % 30 AS fh FROM pr),
    c AS (SELECT *, least(ba, bb) / greatest(ba, bb) AS ratio, greatest(ta, tb) AS turn FROM m),
    d AS (SELECT *, dt <= 1.5 AND ratio <= 0.25 AND turn <= CASE WHEN ratio <= 0.15 AND dt <= 1 THEN 0.90 WHEN ratio <= 0.25 AND dt <= 1.5 THEN 0.75 ELSE 0.65 END AS uneven FROM c),
    e AS (SELECT *, CASE WHEN dt > 3 THEN 'far' WHEN rel > 0.30 AND NOT uneven THEN 'text' WHEN sim >= 0.89 AND ham <= 11 THEN 'A'
      WHEN (sim >= 0.62 OR ham <= 22) AND (prof >= 0.65 OR thumb >= 0.78) THEN 'B'
      WHEN dt <= 1.5 AND rel <= 0.25 AND turn <= 0.65 AND thumb >= 0.50 AND prof >= 0.10 AND sim >= 0.05 THEN 'C'
      WHEN uneven AND (thumb >= 0.40 OR prof >= 0.05 OR sim >= 0.03) THEN 'D' ELSE 'none' END AS path FROM d)
    SELECT a, b, path, CASE path WHEN 'A' THEN true WHEN 'B' THEN NOT dis WHEN 'C' THEN NOT dis WHEN 'D' THEN NOT dis OR (ratio <= 0.15 AND abs(ia - ib) <= 0.05 AND fh <= 16) ELSE false END AS same FROM e""")
def adjacent_paths(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    p = measured_pairs(spark, sf_dir).withColumns({
        "dt": (a % 50) / 10.0, "turn_a": (a % 90) / 100.0, "turn_b": (b % 90) / 100.0, "blur_a": 1.0 + a % 40, "blur_b": 1.0 + b % 40,
        "thumb": (a % 7) / 10.0, "profile": (b % 7) / 10.0, "footer_distinct": a % 11 == 0, "ink_a": (a % 30) / 100.0, "ink_b": (b % 30) / 100.0, "footer_ham": (a + b) % 30,
    })
    return p.withColumn("v", same.adjacent()).select("a", "b", "v.path", "v.same")


@query(f"""WITH {SIG}, m AS (SELECT a, b, (a % 30) / 100.0 AS ia, (b % 30) / 100.0 AS ib, (a % 10) / 10.0 AS cc, (b % 10) / 10.0 AS rc, (a + b) % 40 AS fh FROM pr)
    SELECT a, b, least(ia, ib) >= 0.012 AND NOT (greatest(ia, ib) > 0 AND least(ia, ib) / greatest(ia, ib) < 0.35) AND ((cc < 0.70 AND fh >= 22) OR
      (cc < 0.40 AND (cc < 0.70)::int + (rc < 0.70)::int + (abs(ia - ib) >= 0.12)::int + (fh >= 14)::int >= 2)) AS distinct_footer FROM m""")
def footer_guard(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    p = signature_pairs(spark, sf_dir).withColumns({"ink_a": (a % 30) / 100.0, "ink_b": (b % 30) / 100.0, "col_corr": (a % 10) / 10.0, "row_corr": (b % 10) / 10.0, "footer_ham": (a + b) % 40})
    return p.select("a", "b", F.coalesce(same.footer_distinct(), F.lit(False)).alias("distinct_footer"))


@query("""WITH d AS (SELECT doc_id, source, length(text) AS n, lead(doc_id) OVER w AS next, lead(length(text)) OVER w AS m, lead(text) OVER w = text AS equal FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
    SELECT doc_id, next, round(abs(n - m) / greatest(n, m, 1), 4) AS text_rel, coalesce(equal, false) OR abs(n - m) / greatest(n, m, 1) <= 0.01 AS same FROM d WHERE next IS NOT NULL""")
def doc_near_dup_adjacent(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"), F.xxhash64("text").alias("h"))
    d = d.withColumns({"next": F.lead("doc_id").over(w), "m": F.lead("n").over(w), "equal": F.lead("h").over(w) == F.col("h")}).where("next is not null")
    rel = F.abs(F.col("n") - F.col("m")) / F.greatest("n", "m", F.lit(1))
    return d.select("doc_id", "next", r(rel, 4).alias("text_rel"), (F.coalesce("equal", F.lit(False)) | (rel <= 0.01)).alias("same"))


@query(f"""WITH {EV}, x AS (SELECT kind AS stage, sum(value) AS seconds FROM ev GROUP BY kind)
    SELECT stage, round(seconds, 3) AS seconds, round(100 * seconds / (SELECT sum(seconds) FROM x), 4) AS percent FROM x""")
def stage_times(spark, sf_dir):
    t = audit.stage_times(event_series(spark, sf_dir).select(F.col("kind").alias("stage"), F.col("value").alias("seconds")))
    return t.select("stage", r("seconds", 3).alias("seconds"), r("percent", 4).alias("percent"))


@query(f"""WITH {EV} SELECT entity, pos, round(lag(value) {W}, 4) AS prev_value, round(last_value(CASE WHEN kind = 'view' THEN value END IGNORE NULLS)
    OVER (PARTITION BY entity ORDER BY t, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS seen_value FROM ev""")
def lag_features(spark, sf_dir):
    rows = windows.lags(event_series(spark, sf_dir), ["value"], F.expr("kind = 'view'"))
    return rows.select("entity", "pos", r("prev_value", 4).alias("prev_value"), r("seen_value", 4).alias("seen_value"))


@query(f"""WITH {EV}, {NORM}, {_TIMED}, o AS (SELECT entity, pos FROM tp), n AS (SELECT entity, pos FROM ev WHERE value > 200)
    SELECT entity, pos, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT entity, pos, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def selection_changes(spark, sf_dir):
    rows = normed(spark, sf_dir)
    return selection.changed(windows.peaks_by_time(rows, "norm", "norm", REACH, 0.28), rows.where("value > 200"))


from spindrift import fold_queries  # noqa: E402, F401 (registers its queries here)
