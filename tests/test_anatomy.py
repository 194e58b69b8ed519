"""Anatomy and reviewed lids on constructed charts, against plain counting and lines that are known."""

import math
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from basewatch.operators import anatomy as A
from basewatch.operators import bars, lids
from tests.test_lids import DIPS, FLAT, SCHEMA, TOPS, chart

def as_of(day="2030-01-31"):
    return F.lit(day).cast("date")


POINTS = "symbol string, nth int, day date, price double, role string, lid_member boolean"


@pytest.fixture(scope="module")
def months(spark):
    rows = (
        chart("plain", FLAT, TOPS, DIPS)
        + chart("broken", [*FLAT, (120, 110.0), (125, 110.0)], TOPS, DIPS, months=126)
        + chart("escaping", [*FLAT[:-1], (116, 96.0), (117, 110.0), (119, 110.0)], TOPS, DIPS)
        + chart("young", [*FLAT[:-1], (118, 96.0)], TOPS, DIPS, months=119)
        + chart("rising", [(0, 60.0), (20, 99.0), (40, 53.3), (60, 112.2), (80, 72.0), (100, 125.4), (110, 91.0), (119, 126.7)], [(20, 100.0), (60, 113.33), (100, 126.67)], [(40, 53.3), (80, 72.0), (110, 91.0)])
        + chart("lone", [(0, 40.0), (60, 100.0), (119, 40.0)], [(60, 101.0)])
    )
    return bars.clean(spark.createDataFrame(rows, SCHEMA)).cache()


@pytest.fixture(scope="module")
def found(months):
    chart_, lid = lids.detected(months, as_of())
    x = lids.measured(chart_, lid).cache()
    return {r.symbol: r for r in x.collect()}, {r.symbol: r for r in A.anatomy(x).collect()}


def clamp(v):
    return max(0.0, min(1.0, v))


def plain_scores(m, base_end):
    """Congestion and compression of a measured row by loops over its months."""
    line = lambda i: m.p0 + m.per_month * (i - m.m0)
    base = [b for b in m.months if m.m0 <= b.idx <= base_end]
    logs = [math.log(b.close) for b in base]
    travel = sum(abs(b - a) for a, b in zip(logs, logs[1:]))
    efficiency = abs(logs[-1] - logs[0]) / travel
    signs = [s for a, b in zip(base, base[1:]) if (s := (b.close > a.close) - (b.close < a.close))]
    turns = sum(a != b for a, b in zip(signs, signs[1:]))
    under = sum(b.close <= line(b.idx) * 1.025 for b in base) / len(base)
    depths = [d.depth for d in m.dips if d.idx <= base_end]
    congestion = clamp(0.4 * (1 - efficiency) + 0.35 * clamp(len(depths) / 3) + 0.25 * under)
    ranges = [(b.high - b.low) / b.close * 100 for b in base]
    third = max(1, len(ranges) // 3)
    contraction = statistics.median(ranges[-third:]) / statistics.median(ranges[:third])
    improved = clamp((depths[0] - depths[-1]) / depths[0]) if len(depths) > 1 else 0.25 if len(depths) == 1 and m.depth_rule else 0.0
    compression = clamp(0.5 * improved + 0.3 * clamp(1 - contraction) + 0.2 * m.converging)
    shape = 100 * (0.3 * clamp(m.score) + 0.3 * congestion + 0.25 * compression + 0.15 * clamp((base_end - m.m0) / 120))
    return len(depths), turns, efficiency, under, congestion, contraction, compression, shape


@pytest.mark.parametrize("symbol, end", [("plain", 119), ("rising", 119), ("young", 118), ("broken", None), ("escaping", None)])
def test_scores_equal_plain_counts(found, symbol, end):
    m, a = found[0][symbol], found[1][symbol]
    if end is None:
        end = max(m.m0, next(b.idx for b in m.months if b.bar_date == a.breakout.first_escape) - 1)
    cycles, turns, efficiency, under, congestion, contraction, compression, shape = plain_scores(m, end)
    assert a.recognized and a.base.end == m.months[end].bar_date and a.base.start == m.months[m.m0].bar_date
    assert (a.congestion.cycle_count, a.congestion.direction_change_count) == (cycles, turns)
    assert a.congestion.present == (cycles >= 2 and efficiency <= 0.7)
    got = (a.congestion.directional_efficiency, a.congestion.time_under_boundary_pct, a.congestion.score, a.compression.range_contraction_ratio, a.compression.score, a.shape_score)
    assert got == pytest.approx((efficiency, under * 100, congestion * 100, contraction, compression * 100, shape), abs=0.051)


def test_a_coiled_chart_is_ready(found):
    a = found[1]["plain"]
    assert a.prior_trend.direction == "up" and a.boundary.direction == "flat" and a.compression.present and a.compression.passes_current_gate
    assert (a.actionability.state, a.actionability.eligible, a.breakout.state) == ("ready", True, "sealed") and a.base.duration_years == pytest.approx(99 / 12, abs=0.01)
    assert [str(d) for d in a.boundary.anchors] == ["2011-09-01", "2018-05-01"]


def test_breakouts_are_late_or_now(found):
    broken, now = found[1]["broken"], found[1]["escaping"]
    assert (broken.actionability.state, broken.breakout.state) == ("historical_or_late", "broken_out") and broken.actionability.score <= 35 and broken.breakout.band_violations == 2
    assert (now.actionability.state, now.breakout.state) == ("breakout_now", "breaking_out") and now.actionability.score >= 70


def test_a_young_chart_is_shaped_but_not_eligible(found):
    a = found[1]["young"].actionability
    assert (a.state, a.score, a.eligible, a.signal_state) == ("ineligible_history", 0.0, False, "ready") and "9.92y is below the 10.00y" in a.reasons[-1]


def test_no_lid_no_anatomy(found):
    a = found[1]["lone"]
    assert not a.recognized and a.base is None and a.congestion is None and a.shape_score == 0 and (a.actionability.state, a.actionability.reasons) == ("none", ["no qualified boundary"])


def point(symbol, nth, month, price=None, role=None, member=None, start=2010):
    return (symbol, nth, date(start + month // 12, month % 12 + 1, 17), price, role, member)


def reviewed(spark, months, points):
    return {r.symbol: r for r in lids.overridden(months, as_of(), spark.createDataFrame(points, POINTS)).collect()}


def test_a_reviewer_draws_the_lid(spark, months):
    points = [point("lone", 0, 20, 80.0), point("lone", 1, 100, 60.0), point("plain", 0, 20), point("plain", 1, 60), point("plain", 2, 80, 300.0, "breakout_peak"), point("rising", 0, 20, 90.0, member=True), point("rising", 1, 60, 500.0), point("rising", 2, 100, 110.0, member=True)]
    got = reviewed(spark, months, points)
    lone = got["lone"]
    assert (lone.effective, lone.family) == ("human", "human_review") and lone.lid_value == pytest.approx(80 - 20 * 99 / 80) and lone.lid_slope_pct_per_year == pytest.approx(-0.25 * 1200 / lone.lid_value, abs=0.01)
    assert got["plain"].lid_value == pytest.approx(100.0) and got["plain"].effective == "human" and got["plain"].grade == "A"  # prices are the months' highs; the peak doesn't fit
    assert got["rising"].lid_value == pytest.approx(110 + 20 * 19 / 80) and got["broken"].effective == "algorithm"


def test_three_points_are_fitted_by_least_squares(spark, months):
    points = [point("plain", 0, 20, 100.0), point("plain", 1, 60, 106.0), point("plain", 2, 100, 100.0)]
    got = reviewed(spark, months, points)["plain"]
    assert got.lid_value == pytest.approx(102.0) and got.lid_slope_pct_per_year == pytest.approx(0.0)
    # the walk begins after the last anchor: the close over 100 long before isn't a breakout
    assert got.breakout_state == "sealed"


@pytest.mark.parametrize("points", [[point("plain", 0, 20)], [point("plain", 0, 20), point("plain", 1, 21)], [point("plain", 0, 20), point("plain", 1, 400)], [point("plain", 0, 20, 100.0), point("plain", 1, 60, 1.0)], [point("plain", 0, 20), point("plain", 1, 60, role="breakout_peak")]])
def test_too_few_points_leave_the_detector_s_lid(spark, months, points):
    assert reviewed(spark, months, points)["plain"].effective == "algorithm"


def test_points_in_a_quarter_that_is_not_over_fall_away(spark, months):
    points = spark.createDataFrame([point("young", 0, 20, 100.0), point("young", 1, 60, 100.0), point("young", 2, 118, 140.0)], POINTS)
    charts = lids.charts(months, as_of("2019-11-30"))
    lid = lids.review_lids(charts, points).collect()
    assert [t.q_idx for t in lid[0].anchors] == [6, 20] and lid[0].slope == 0 and lid[0].start_q == 21
