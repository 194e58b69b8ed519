"""Charts with a lid that is known by construction."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from basewatch.operators import bars, lids

SCHEMA = "symbol string, bar_date date, open double, high double, low double, close double, volume double"


def chart(symbol, turns, peaks=(), dips=(), months=120, start=2010, volumes=None):
    """Monthly bars whose closes go straight from one turning point (month, close) to the next; peaks and dips are (month, price) of single highs and lows."""
    highs, lows, rows, leg = dict(peaks), dict(dips), [], 0
    for month in range(months):
        while month > turns[leg + 1][0]:
            leg += 1
        (m0, c0), (m1, c1) = turns[leg], turns[leg + 1]
        close = c0 + (c1 - c0) * (month - m0) / (m1 - m0)
        rows.append((symbol, date(start + month // 12, month % 12 + 1, 1), close, highs.get(month, close * 1.004), lows.get(month, close * 0.996), close, volumes(month) if volumes else 1e6))
    return rows


#: Three mountains at 100 in months 20, 60 and 100; what lies between differs.
TOPS = [(20, 100.0), (60, 100.0), (100, 100.0)]
FLAT = [(0, 66.0), (20, 99.0), (40, 50.0), (60, 99.0), (80, 60.0), (100, 99.0), (110, 70.0), (119, 96.0)]
DIPS = [(40, 50.0), (80, 60.0), (110, 70.0)]


@pytest.fixture(scope="module")
def found(spark):
    rows = (
        chart("plain", FLAT, TOPS, DIPS)
        + chart("basing", [(0, 66.0), (20, 99.0), (40, 75.0), (60, 99.0), (80, 65.0), (100, 99.0), (110, 55.0), (119, 82.0)], TOPS, [(40, 75.0), (80, 65.0), (110, 55.0)])
        + chart("pressed", [(0, 66.0), (20, 99.0), (40, 55.0), (60, 99.0), (80, 70.0), (100, 99.0), (110, 56.0), (119, 97.0)], TOPS, [(40, 55.0), (80, 70.0), (110, 56.0)])
        + chart("broken", [*FLAT, (120, 110.0), (125, 110.0)], TOPS, DIPS, months=126)
        + chart("young", [*FLAT[:-1], (118, 96.0)], TOPS, DIPS, months=119)
        + chart("rising", [(0, 60.0), (20, 99.0), (40, 53.3), (60, 112.2), (80, 72.0), (100, 125.4), (110, 91.0), (119, 126.7)], [(20, 100.0), (60, 113.33), (100, 126.67)], [(40, 53.3), (80, 72.0), (110, 91.0)])
        + chart("falling", [(0, 67.0), (20, 99.0), (40, 48.3), (60, 92.4), (80, 54.0), (100, 85.8), (110, 59.5), (119, 80.2)], [(20, 100.0), (60, 93.33), (100, 86.67)], [(40, 48.3), (80, 54.0), (110, 59.5)])
        + chart("quieter", FLAT, TOPS, DIPS, volumes=lambda m: 2e6 if m < 60 else 1e6)
        + chart("short", [(0, 66.0), (8, 99.0), (16, 50.0), (24, 99.0), (32, 60.0), (44, 96.0)], [(8, 100.0), (24, 100.0)], [(16, 50.0), (32, 60.0)], months=45)
        + chart("lone", [(0, 40.0), (60, 100.0), (119, 40.0)], [(60, 101.0)])
        + [("wave", date(1990 + i // 12, i % 12 + 1, 1), *[10 * 1.02**i] * 4, 1.0) for i in range(360)] + [("tiny", date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, None)]
    )
    months = bars.clean(spark.createDataFrame(rows, SCHEMA)).cache()
    return months, {r.symbol: r for r in lids.analysed(months, F.lit("2030-01-31").cast("date")).collect()}


def test_plain_chart(found):
    r = found[1]["plain"]
    assert (r.status, r.grade, r.touch_count, r.family, r.price_position, r.support_converging) == ("coiling", "A", 3, "same_price_zone", "within_lid_band", True)
    assert r.lid_value == pytest.approx(100) and r.lid_slope_pct_per_year == pytest.approx(0) and r.proximity_pct == pytest.approx(96) and r.coil_score > 60
    assert r.pullback_depths_pct == pytest.approx([50, 40, 30], abs=1)


def test_gates(found):
    assert (found[1]["basing"].status, found[1]["basing"].grade) == ("basing", None)
    assert (found[1]["pressed"].status, found[1]["pressed"].grade, found[1]["pressed"].pressed_at_lid) == ("coiling", "A", True)


def test_breakout_keeps_the_lids_grade(found):
    r = found[1]["broken"]
    assert (r.status, r.lifecycle, r.grade, r.lid_grade) == ("broken_out", "post_breakout", None, "A")


def test_maturity(found):
    assert found[1]["plain"].mature and not found[1]["young"].mature and found[1]["young"].grade is None


def test_volume_contraction(found):
    assert found[1]["quieter"].volume_contraction_ratio == pytest.approx(0.5, abs=0.01)


def test_trend_and_short_history_have_no_structure(found):
    assert {found[1][s].lifecycle for s in ("wave", "tiny", "short", "lone")} == {"no_structure"}


def test_sloped_lids(found):
    months, rows = found
    assert rows["rising"].family == "sloped_confirmed" and rows["rising"].lid_slope_pct_per_year > 2
    assert rows["falling"].lid_slope_pct_per_year < 0
    c = lids.mountains(lids.charts(months.filter("symbol = 'rising'"), F.lit("2030-01-31").cast("date")))
    best = lids.sloped_lids(c).filter("rank = 1").first()
    when = {r.idx: r.bar_date for r in months.filter("symbol = 'rising'").collect()}
    assert when[best.anchors[1].month] == date(2015, 1, 1)
    assert when[best.touches[-1].month] == date(2018, 5, 1)


def test_each_pair_is_ranked_or_turned_down(found):
    c = lids.mountains(lids.charts(found[0], F.lit("2030-01-31").cast("date")))
    rows = lids.sloped_lids(c).collect()
    assert rows and all((r.rank is None) == (r.reject_reason is not None) and r.reject_reason in (None, *lids.SLOPED_REASONS) for r in rows)
