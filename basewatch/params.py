"""The detector's parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # fixed values that must equal the published ones for right results
    min_bars: int = 60
    min_years: float = 10.0
    pivot_left: int = 3
    pivot_right: int = 3
    minor_prominence_pct: float = 5.0
    major_prominence_pct: float = 15.0
    major_separation: int = 9
    equal_tolerance_pct: float = 1.0
    plateau_gap: int = 4  # quarters
    plateau_tolerance_pct: float = 8.0
    plateau_upgrade_gap: int = 2
    zone_similarity_pct: float = 5.0
    zone_separation: int = 4
    zone_prominence_pct: float = 18.5
    era_low_pct: float = 50.0
    era_high_pct: float = 400.0
    band_min_pct: float = 2.5
    band_max_pct: float = 5.0
    band_quarters: int = 8
    band_fraction: float = 0.5
    confirm_closes: int = 2
    expansion_pct: float = 10.0
    post_slope_pct: float = 15.0
    retest_tolerance_pct: float = 3.0
    break_tolerance_pct: float = 2.5
    touch_tolerance_pct: float = 3.5
    touch_cluster: int = 6
    anchor_span: int = 24  # months, as the next two
    stale_months: int = 48
    tolerated_tail: int = 12
    pair_touches: int = 2
    wick_overshoots: int = 2
    pair_slope_pct: tuple[float, float] = (-3.0, 30.0)
    pullback_bars: int = 3
    single_pullback_pct: float = 30.0
    last_depth_ratio: float = 0.65
    pressed_pct: float = 90.0
    proximity_gate_pct: float = 70.0
    lid_band_pct: tuple[float, float] = (80.0, 120.0)
    trend_r2: float = 0.85
    sloped_touches: int = 3
    sloped_establish: int = 8  # quarters, as the next three
    sloped_confirm_gap: int = 4
    sloped_total: int = 20
    sloped_cluster: int = 2
    sloped_change_pct: float = 5.1
    sloped_slope_pct: tuple[float, float] = (0.75, 20.0)
    sloped_touch_tolerance_pct: float = 7.0
    sloped_fit_error_pct: float = 4.5
    sloped_efficiency: float = 0.62
    sloped_pullback_pct: float = 8.0
    sloped_pullbacks: int = 2
    grade_floor: float = -3.0
    grade_a: tuple[float, float] = (-1.0, 5.0)
    grade_b: float = 6.5
    grade_c: float = 12.0


DEFAULT = Params()
LIFECYCLES = ("pre_breakout", "forming", "breaking_out", "post_breakout", "no_structure")
GRADES = ("A", "B", "C")
