"""Scores, penalties and predicates of one observation, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.params import DEFAULTS, PENALTIES_A, Params

c = F.col


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def weighted(**terms: float) -> Column:
    """Sum of columns times weights."""
    out: Column | None = None
    for name, weight in terms.items():
        term = c(name) * F.lit(float(weight))
        out = term if out is None else out + term
    return out


def prefilter_composite() -> Column:
    """Cheap worth of a sampled frame from paper_ratio, blur, edge_density, bright_mean, motion, skin."""
    up = lambda name, full: F.least(c(name) / full, F.lit(1.0))
    return (
        1.30 * up("paper_ratio", 0.55)
        + 0.85 * up("blur", 200.0)
        + 0.95 * up("edge_density", 0.20)
        + 0.40 * clip((c("bright_mean") - 90.0) / 100.0, 0.0, 1.0)
        - 1.10 * up("motion", 0.04)
        - 0.55 * up("skin", 0.12)
    )


def raw_score_a(p: Params = DEFAULTS) -> Column:
    """From norm_<feature> columns and the plain penalties."""
    good = sum((c(f"norm_{f}") * w for f, w in p.weights_a.items()), F.lit(0.0))
    return good - sum((c(f) * w for f, w in PENALTIES_A.items()), F.lit(0.0))


def raw_score_b() -> Column:
    """Without normalised features: used for all rows once frames were added late."""
    good = weighted(area=1.40, fill=0.85, contact=0.85, stability=0.95) + 0.65 * (F.log1p("blur") / 8.0) + weighted(text=0.50)
    return good - weighted(hand=0.85, hand_text=2.40, edge_fg=1.55, bottom_hand=0.75, turn=0.70)


def deskew_penalty(angle: Column, threshold: float, weight: float) -> Column:
    return F.greatest(F.lit(0.0), F.abs(angle) - threshold) * weight


def peak_score(norm: Column, smooth: Column, high_hand: bool = False, p: Params = DEFAULTS) -> Column:
    h, ht, fg, bh, low, span = (0.75, 0.85, 0.30, 0.55, 0.78, 0.22) if high_hand else (0.55, 0.55, 0.30, 0.35, 0.84, 0.16)
    clean = 1.0 - F.least(F.lit(1.0), weighted(hand=h, hand_text=ht, edge_fg=fg, bottom_hand=bh))
    score = (0.64 * norm + 0.36 * smooth) * (low + span * clean)
    return score - deskew_penalty(c("skew"), p.deskew_soft, 1.8 * p.peak_deskew) if high_hand else score


def cleanliness() -> Column:
    return -weighted(hand_text=2.4, bottom_hand=2.2, hand=1.7, edge_fg=1.2)


def cluster_select_score(high_hand: bool = False, p: Params = DEFAULTS) -> Column:
    a, b, g, d = (1.7, 1.6, 1.7, 1.5) if high_hand else (1.0, 1.0, 1.0, 1.0)
    hands = weighted(hand_text=b * p.cluster_hand_text, bottom_hand=g * p.cluster_bottom_hand, hand=d * p.cluster_hand)
    return 0.55 * c("peak") + 0.45 * c("norm") - deskew_penalty(c("skew"), p.deskew_soft, a * p.cluster_deskew) - hands


def clean_visual_score() -> Column:
    """From paper_ratio, v_mean, bottom_v, skin, bottom_skin, blotch, text_edge."""
    return (
        1.20 * c("paper_ratio")
        + 0.014 * (c("v_mean") - 240.0)
        + 0.005 * (c("bottom_v") - 200.0)
        - 1.40 * c("skin")
        - 1.10 * c("bottom_skin")
        - 0.045 * F.greatest(F.lit(0.0), c("blotch") - 6.0)
        + 0.012 * F.least(c("text_edge"), F.lit(30.0))
    )


def gray_penalty() -> Column:
    over = lambda x, full: F.greatest(F.lit(0.0), x / full)
    return F.least(F.lit(1.0), 0.40 * over(245.0 - c("v_mean"), 60.0) + 0.40 * over(c("blotch") - 6.0, 12.0) + 0.20 * over(0.92 - c("paper_ratio"), 0.30))


def finger_penalty() -> Column:
    return F.least(F.lit(1.0), 1.6 * c("bottom_skin") + 0.6 * c("skin"))


def hand_score() -> Column:
    return weighted(hand_text=0.55, bottom_hand=0.30, hand=0.15)


def is_dirty(p: Params = DEFAULTS) -> Column:
    return (c("hand_text") >= p.dirty_hand_text) | (c("bottom_hand") >= p.dirty_bottom) | ((c("hand") >= p.dirty_hand) & (c("hand_text") >= 0.45))


def suspicious_reasons(p: Params = DEFAULTS, nudge: float = 0.0) -> Column:
    """Comma-joined tags with values (shown with `nudge` added); empty for an unsuspicious observation."""
    two = lambda x: F.format_string("%.2f", x + nudge if nudge else x)
    tests = [
        ("hand", c("hand"), p.refine_hand),
        ("hand_text", c("hand_text"), p.refine_hand_text),
        ("bottom_hand", c("bottom_hand"), p.refine_bottom),
        ("skew", F.abs("skew"), p.refine_skew),
        ("turn", c("turn"), p.refine_turn),
        ("edge_motion", c("edge_motion"), 0.85),
    ]
    tags = [F.when(x >= least, F.concat(F.lit(f"{name}="), two(x))) for name, x, least in tests]
    visual = (c("clean_visual") < p.refine_clean_low) & (c("finger") >= 0.30)
    tags.append(F.when(visual, F.concat(F.lit("cvs="), two(c("clean_visual")), F.lit("/finger="), two(c("finger")))))
    return F.concat_ws(",", F.array_compact(F.array(*tags)))


def refine_score() -> Column:
    good = 0.65 * c("clean_visual") - 0.80 * c("finger") + 0.10 * F.least(c("blur") / 400.0, F.lit(1.0))
    return good - weighted(hand_text=0.20, bottom_hand=0.20, hand=0.20, turn=0.15, edge_motion=0.10) - 0.04 * F.abs("skew")


def has_finger_pressure(reasons: Column, p: Params = DEFAULTS) -> Column:
    return (c("finger") >= p.finger_floor) | reasons.contains("cvs=") | reasons.contains("finger=")


def dedup_quality() -> Column:
    """Null peak falls back to norm, null norm to 0."""
    skew = F.abs("skew")
    skewed = F.when(skew <= 3.0, 0.05 * skew).otherwise(0.15 + 0.30 * (skew - 3.0))
    good = 0.50 * F.coalesce("peak", "norm", F.lit(0.0)) + 0.20 * F.coalesce("norm", F.lit(0.0)) + 0.30 * c("clean_visual") + 0.10 * c("stability")
    good = good + 0.08 * F.least(c("blur") / 400.0, F.lit(1.0)) - 0.85 * c("finger")
    return good - weighted(hand_text=0.22, bottom_hand=0.20, hand=0.18, turn=0.20, edge_motion=0.10) - skewed


def is_blank(p: Params = DEFAULTS) -> Column:
    return (
        (c("paper_ratio") >= p.blank_paper) & (c("motion") <= p.blank_motion) & (c("blur") >= p.blank_blur)
        & (c("bottom_dark") <= p.blank_bottom_dark) & (c("edge_density") <= p.blank_edge)
        & (c("skin") <= p.blank_skin) & (c("bright_mean") >= p.blank_bright)
    )


def is_leading(gap: Column, ham: Column, sim: Column, p: Params = DEFAULTS) -> Column:
    still = (c("area") >= p.leading_area) & (c("fill") >= p.leading_fill) & (c("edge_motion") <= p.leading_motion) & (c("turn") <= p.leading_turn)
    readable = (c("blur") >= p.leading_blur) & (c("text") >= p.leading_text) & (gap >= p.leading_gap_sec)
    return still & readable & ((ham >= p.leading_ham) | (sim <= p.leading_sim))


def text_difference(a: Column, b: Column) -> Column:
    a, b = F.greatest(a, F.lit(1e-6)), F.greatest(b, F.lit(1e-6))
    return F.abs(a - b) / F.greatest(a, b)


