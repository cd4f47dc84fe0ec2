"""All thresholds and weights, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # Defaults of the public settings that results depend on.
    sample_fps: float = 2.0
    expected: int = 0
    peak_window_sec: float = 0.2
    min_peak_distance_sec: float = 0.9
    min_norm_score: float = 0.28
    hash_merge: int = 11
    sim_merge: float = 0.89
    same_gap_sec: float = 1.3
    deskew_soft: float = 8.0
    cluster_deskew: float = 0.05
    peak_deskew: float = 0.03
    cluster_hand_text: float = 0.55
    cluster_bottom_hand: float = 0.40
    cluster_hand: float = 0.40
    cluster_eps: float = 0.02
    sim_secondary: float = 0.50
    hash_secondary_extra: int = 8
    cluster_text_rel: float = 0.30
    cluster_time: float = 1.5
    cluster_text_tight: float = 0.25
    cluster_time_tight: float = 1.25
    cluster_span: float = 1.6
    peak_tie_eps: float = 0.01
    peak_tie_blur: float = 200.0
    peak_tie_factor: float = 2.0
    keep_ratio: float = 0.45
    min_keep: int = 12
    neighborhood: int = 1
    slot_factor: int = 2
    per_slot: int = 2
    peak_radius: int = 2
    edge_blur_ratio: float = 2.5
    relaxed_sim: float = 0.62
    relaxed_ham: int = 22
    relaxed_text: float = 0.35
    relaxed_profile: float = 0.45
    relaxed_thumb: float = 0.78
    alt_sim: float = 0.55
    alt_ham: int = 18
    alt_sim_loose: float = 0.35
    alt_ham_loose: int = 28
    alt_text: float = 0.25
    alt_text_tight: float = 0.15
    alt_window_sec: float = 4.0
    alt_most: int = 8
    alt_gain: float = 0.18
    alt_skew: float = 5.0
    alt_blur_share: float = 0.55
    alt_raw_drop: float = 1.5
    dirty_hand_text: float = 0.55
    dirty_bottom: float = 0.85
    dirty_hand: float = 0.20
    refine_window_sec: float = 2.5
    refine_most: int = 6
    refine_gain: float = 0.12
    refine_hand: float = 0.40
    refine_skew: float = 4.0
    refine_bottom: float = 0.55
    refine_hand_text: float = 0.35
    refine_turn: float = 0.55
    refine_clean_low: float = -0.10
    refine_stability: float = 0.55
    refine_motion: float = 0.55
    refine_raw_drop: float = 1.5
    refine_finger_worse: float = 0.08
    refine_skew_most: float = 7.5
    refine_buddy_sec: float = 1.2
    finger_floor: float = 0.30
    finger_gain: float = 0.20
    finger_overall: float = -0.10
    finger_blur_share: float = 0.30
    finger_raw_drop: float = 2.5
    twin_sim: float = 0.85
    twin_ham: int = 8
    twin_thumb: float = 0.78
    adjacent_window_sec: float = 3.0
    adjacent_sim: float = 0.62
    adjacent_ham: int = 22
    adjacent_thumb: float = 0.78
    adjacent_profile: float = 0.65
    adjacent_text: float = 0.30
    rescan_sec: float = 1.5
    rescan_text: float = 0.25
    rescan_thumb: float = 0.50
    rescan_profile: float = 0.10
    rescan_sim: float = 0.05
    rescan_turn: float = 0.65
    blur_ratio: float = 0.25
    blur_turn: float = 0.65
    blur_thumb: float = 0.40
    blur_profile: float = 0.05
    blur_sim: float = 0.03
    severe_ratio: float = 0.15
    severe_sec: float = 1.0
    severe_turn: float = 0.90
    moderate_ratio: float = 0.25
    moderate_sec: float = 1.5
    moderate_turn: float = 0.75
    bypass_ink: float = 0.05
    bypass_ham: float = 16.0
    sharp_ratio: float = 4.0
    sharp_skew: float = 1.5
    sharp_turn: float = 0.90
    sharp_bonus: float = 0.25
    blank_gap_sec: float = 1.5
    blank_paper: float = 0.75
    blank_motion: float = 0.05
    blank_blur: float = 80.0
    blank_bottom_dark: float = 0.60
    blank_edge: float = 0.10
    blank_skin: float = 0.40
    blank_bright: float = 120.0
    leading_gap_sec: float = 1.5
    leading_ham: int = 22
    leading_sim: float = 0.55
    leading_area: float = 0.55
    leading_fill: float = 0.85
    leading_motion: float = 0.50
    leading_turn: float = 0.50
    leading_blur: float = 50.0
    leading_text: float = 0.005
    footer_col: float = 0.70
    footer_row: float = 0.70
    footer_ink_delta: float = 0.12
    footer_ham: int = 14
    footer_ink: float = 0.012
    footer_ink_ratio: float = 0.35
    footer_col_strict: float = 0.40
    footer_ham_strict: int = 22
    gap_min_sec: float = 4.0
    gap_multiple: float = 1.8
    dedup_neighbors: int = 2
    fill_top: int = 6
    fill_sim: float = 0.70
    fill_ham: int = 18
    fill_novelty: float = 0.18
    fill_gap: float = 0.60
    weights_a: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS_A))


# Weights of the twelve normalised features, and of the five plain penalties, of score A.
WEIGHTS_A = {
    "area": 1.45, "fill": 1.00, "contact": 1.00, "stability": 1.25, "blur": 2.10, "text": 1.10,
    "hand": 1.35, "hand_text": 1.55, "edge_fg": 1.25, "bottom_hand": 0.65, "turn": 1.20, "edge_motion": 1.10,
}
LOWER_IS_BETTER = ("hand", "hand_text", "edge_fg", "bottom_hand", "turn", "edge_motion")
PENALTIES_A = {"hand": 2.15, "hand_text": 2.40, "edge_fg": 1.55, "bottom_hand": 0.75, "turn": 0.70}

DEFAULTS = Params()
