"""Do two observations show the same thing? Predicates over pair columns.

Pairs carry sim (structural similarity), ham (hash distance), profile and thumb (agreement of profiles
and thumbnails), text_rel (relative difference of text density), dt (seconds apart) and, with _a and
_b, features of either side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.params import DEFAULTS, Params

c = F.col


def strict(p: Params = DEFAULTS) -> Column:
    return (c("ham") <= p.hash_merge) & (c("sim") >= p.sim_merge)


def relaxed(p: Params = DEFAULTS) -> Column:
    alike = (c("sim") >= p.relaxed_sim) | (c("ham") <= p.relaxed_ham) | (c("profile") >= p.relaxed_profile)
    return ((c("text_rel") <= p.relaxed_text) & alike) | ((c("text_rel") <= p.relaxed_text + 0.10) & (c("thumb") >= p.relaxed_thumb)) | strict(p)


def alternative(p: Params = DEFAULTS) -> Column:
    close = (c("sim") >= p.alt_sim) & (c("ham") <= p.alt_ham)
    loose = ((c("sim") >= p.alt_sim_loose) | (c("ham") <= p.alt_ham_loose)) & (c("text_rel") <= p.alt_text)
    return close | loose | ((c("text_rel") <= p.alt_text_tight) & (c("ham") <= p.alt_ham_loose + 6))


def gate(p: Params = DEFAULTS) -> Column:
    """For replacing an observation by another: either test above, or very near in time and alike in text."""
    buddy = (c("dt") <= p.refine_buddy_sec) & (c("text_rel") <= 0.30) & (c("turn_a") < 0.7) & (c("turn_b") < 0.7)
    return relaxed(p) | alternative(p) | buddy


def twin(p: Params = DEFAULTS) -> Column:
    return ((c("sim") >= p.twin_sim) & (c("ham") <= p.twin_ham)) | gate(p) | (c("thumb") >= p.twin_thumb)


def novelty(best_sim: Column, least_ham: Column) -> Column:
    """1 if nothing was selected (both null)."""
    sim, ham = 1.0 - F.greatest(F.lit(0.0), best_sim), F.least(F.lit(1.0), least_ham / 96.0)
    return F.coalesce(0.55 * sim + 0.45 * ham, F.lit(1.0))


def footer_distinct(p: Params = DEFAULTS) -> Column:
    """From ink_a, ink_b, col_corr, row_corr, footer_ham; false where the bands cannot tell."""
    low, high = F.least("ink_a", "ink_b"), F.greatest("ink_a", "ink_b")
    usable = (low >= p.footer_ink) & ~((high > 0) & (low / high < p.footer_ink_ratio))
    signs = [c("col_corr") < p.footer_col, c("row_corr") < p.footer_row, F.abs(c("ink_a") - c("ink_b")) >= p.footer_ink_delta, c("footer_ham") >= p.footer_ham]
    count = sum((F.when(s, 1).otherwise(0) for s in signs), F.lit(0))
    return usable & ((signs[0] & (c("footer_ham") >= p.footer_ham_strict)) | ((c("col_corr") < p.footer_col_strict) & (count >= 2)))


def adjacent(p: Params = DEFAULTS) -> Column:
    """struct(same, path) for neighbours in time: A strict, B corroborated, C rescan, D unequal sharpness.

    B, C and D yield to `footer_distinct` (a boolean column of the pair), D only where severe blur does
    not explain the difference.
    """
    low, high = F.least("blur_a", "blur_b"), F.greatest("blur_a", "blur_b")
    ratio = F.when(high > 0, low / high).otherwise(1.0)
    turn = F.greatest("turn_a", "turn_b")
    ceiling = (
        F.when((ratio <= p.severe_ratio) & (c("dt") <= p.severe_sec), p.severe_turn)
        .when((ratio <= p.moderate_ratio) & (c("dt") <= p.moderate_sec), p.moderate_turn)
        .otherwise(p.blur_turn)
    )
    uneven = (c("dt") <= p.rescan_sec) & (ratio <= p.blur_ratio) & (turn <= ceiling)
    b = ((c("sim") >= p.adjacent_sim) | (c("ham") <= p.adjacent_ham)) & ((c("profile") >= p.adjacent_profile) | (c("thumb") >= p.adjacent_thumb))
    rescan = (c("dt") <= p.rescan_sec) & (c("text_rel") <= p.rescan_text) & (turn <= p.rescan_turn)
    rescan = rescan & (c("thumb") >= p.rescan_thumb) & (c("profile") >= p.rescan_profile) & (c("sim") >= p.rescan_sim)
    d = uneven & ((c("thumb") >= p.blur_thumb) | (c("profile") >= p.blur_profile) | (c("sim") >= p.blur_sim))
    bypass = (ratio <= p.severe_ratio) & (F.abs(c("ink_a") - c("ink_b")) <= p.bypass_ink) & (c("footer_ham") <= p.bypass_ham)
    verdict = lambda same, path: F.struct(same.alias("same"), F.lit(path).alias("path"))
    distinct, yes = c("footer_distinct"), F.lit(True)
    return (
        F.when(c("dt") > p.adjacent_window_sec, verdict(~yes, "far"))
        .when((c("text_rel") > p.adjacent_text) & ~uneven, verdict(~yes, "text"))
        .when(strict(p), verdict(yes, "A"))
        .when(b, verdict(~distinct, "B"))
        .when(rescan, verdict(~distinct, "C"))
        .when(d, verdict(~distinct | bypass, "D"))
        .otherwise(verdict(~yes, "none"))
    )
