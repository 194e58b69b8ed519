"""Roles of display points: charts with known answers, and random charts against a plain walk over bars."""

import datetime
import random
from dataclasses import replace

import pytest

from basewatch.operators.roles import DISPLAY, MAJOR, RETEST, window_roles

DAY = datetime.date(1980, 1, 1)


def plain(bars, d):
    """Points of one chart by walking its bars one at a time: idx -> (role, line error or None)."""
    n, tol = len(bars), d.equal_pct / 100
    if n < 2 or (d.most is not None and d.most <= 0):
        return {}
    high, low, close = zip(*bars, strict=True)
    start = max(0, min(n - max(1, d.lookback), n - 2))
    tops = []
    for i in range(max(start, d.pivot_left), n - d.pivot_right):
        if max(high[i - d.pivot_left : i]) < high[i] * (1 - tol) and max(high[i + 1 : i + 1 + d.pivot_right]) <= high[i] * (1 + tol):
            tops.append(i)
    reps = []
    for i in tops:
        if not reps or i - reps[-1] > d.plateau_gap or abs(high[i] - high[reps[-1]]) / max(high[i], high[reps[-1]]) > d.plateau_pct / 100:
            reps.append(i)
            continue
        ceiling = max((high[r] for r in reps[:-1]), default=None)
        if (i - reps[-1] <= d.upgrade_gap and high[i] > high[reps[-1]] * (1 + tol)) or (ceiling is not None and high[reps[-1]] < ceiling * (1 - tol) <= high[i]):
            reps[-1] = i

    def height(i, floor):
        valleys = []
        for way in (range(i - 1, -1, -1), range(i + 1, n)):
            seen = []
            for j in way:
                if high[j] > high[i] * (1 + tol) or (j in reps and high[j] >= high[i] * (1 - tol)):
                    break
                seen.append(floor[j])
            if not seen:
                return 0.0
            valleys.append(min(seen))
        return max(0.0, high[i] - max(valleys)) / high[i] * 100

    wick, body = {i: height(i, low) for i in reps}, {i: height(i, close) for i in reps}
    bottom, top = min(low[start:]), max(high[start:])
    place = {i: (high[i] - bottom) / (top - bottom) * 100 if top > bottom else 100.0 for i in reps}
    apart = lambda i, kept, least: all(abs(i - k) >= least for k in kept)
    separate, rising = [], []
    for i in sorted((i for i in reps if wick[i] >= d.major_pct), key=lambda i: (-wick[i], i)):
        if apart(i, separate, d.separation):
            separate.append(i)
    for i in sorted(separate):
        if not rising or high[i] >= high[rising[-1]] * (1 - d.level_pct / 100):
            rising.append(i)
    found = {i: (MAJOR, None) for i in (rising if d.most is None else rising[-d.most :]) if place[i] >= d.range_pct and body[i] >= d.body_pct}
    usable = [i for i in reps if place[i] >= d.range_pct and wick[i] >= d.second_wick_pct and body[i] >= d.second_body_pct]
    level = max((high[i] for i in found), default=top) * d.second_level_pct / 100
    for i in sorted((i for i in usable if i not in found and high[i] >= level), key=lambda i: (-high[i], -i)):
        if len(found) < min(d.anchors, d.most or d.anchors) and apart(i, found, d.separation):
            found[i] = (RETEST, None)
    if len(found) >= 2 and (d.most is None or len(found) < d.most):
        a, z = min(found), max(found)
        line = lambda i: high[a] + (high[z] - high[a]) * ((i - a) / (z - a))
        error = lambda i: abs(high[i] - line(i)) / line(i)
        middle = [i for i in usable if a < i < z and apart(i, found, d.middle_separation) and line(i) > 0 and error(i) <= d.middle_pct / 100]
        if middle:
            i = min(middle, key=lambda i: (-wick[i], error(i), i))
            found[i] = (RETEST, error(i))
    fast = lambda i: (high[i] - min(close[i + 1 : i + 1 + d.fast_bars])) / high[i] * 100 if i + 1 < n else 0.0
    order = sorted(found)
    gone = {b for a, b in zip(order, order[1:]) if b < max(start, n - d.edge_bars) and abs(high[b] - high[a]) / max(high[a], high[b]) <= d.retest_pct / 100 and fast(a) >= d.body_pct > fast(b)}
    left = [i for i in order if i not in gone]
    return {i: found[i] for i in (left if d.most is None else left[-d.most :])}


def frame(spark, charts):
    rows = [(s, i, DAY + datetime.timedelta(31 * i), *map(float, b)) for s, bars in charts.items() for i, b in enumerate(bars)]
    return spark.createDataFrame(rows, "symbol string, idx long, bar_date date, high double, low double, close double")


def peaks(*tops, n=100, base=50.0, fall=4):
    """A flat chart with a tent at each (place, height): price falls back within `fall` bars."""
    out = []
    for i in range(n):
        h = max([base] + [base + (t - base) * max(0.0, 1 - abs(i - at) / (f[0] if f else fall)) for at, t, *f in tops])
        out.append((h, h * 0.97, h * 0.98))
    return out


def test_known_roles(spark):
    charts = {
        "two": peaks((20, 100), (60, 101)),
        "lower": peaks((20, 100), (60, 80)),  # a lower shoulder isn't a major top; 80 is below 85 % of the ceiling
        "retest": peaks((20, 100), (60, 90)),
        "middle": peaks((20, 100), (50, 96), (80, 101)),
        "slower": peaks((20, 100), (60, 101, 25)),  # the second falls too slowly
        "flat": peaks(n=40), "one": [(1, 1, 1)], "none": [],
    }
    got = {}
    for r in window_roles(frame(spark, charts)).collect():
        got.setdefault(r.symbol, []).append((r.idx, r.role))
        assert r.bar_date == DAY + datetime.timedelta(31 * r.idx) and (r.body_prominence_pct is None) == (r.role == RETEST)
    assert {s: sorted(v) for s, v in got.items()} == {
        "two": [(20, MAJOR), (60, MAJOR)], "lower": [(20, MAJOR)], "retest": [(20, MAJOR), (60, RETEST)],
        "middle": [(20, MAJOR), (50, RETEST), (80, MAJOR)], "slower": [(20, MAJOR)],
    }


@pytest.mark.parametrize("d", [DISPLAY, replace(DISPLAY, most=None, major_pct=12.0, body_pct=9.0, second_wick_pct=6.0, second_body_pct=4.0, pivot_left=1, pivot_right=1, separation=4, middle_separation=6, plateau_gap=4, upgrade_gap=2), replace(DISPLAY, most=1)])
def test_random_charts(spark, d):
    r, charts = random.Random(11), {}
    for s in range(60):
        price, bars = 50.0, []
        for _ in range(r.choice([5, 40, 118, 200])):
            price = min(400.0, max(5.0, price * r.choice([0.8, 0.9, 0.97, 1.0, 1.0, 1.03, 1.1, 1.2])))
            h = price * r.choice([1.0, 1.0, 1.02, 1.05])
            bars.append((h, price * r.choice([0.9, 0.97]), price))
        charts[f"s{s}"] = bars
    got = {}
    for x in window_roles(frame(spark, charts), d).collect():
        got.setdefault(x.symbol, {})[x.idx] = (x.role, x.line_error_pct)
    want = {s: {i: (role, e and round(e * 100, 2)) for i, (role, e) in plain(b, d).items()} for s, b in charts.items()}
    want = {s: v for s, v in want.items() if v}
    assert {s: {i: role for i, (role, _) in v.items()} for s, v in got.items()} == {s: {i: role for i, (role, _) in v.items()} for s, v in want.items()}
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 0.011) for s in want for i in want[s] for a, b in [(got[s][i][1], want[s][i][1])])
    assert sum(len(v) for v in want.values()) > 20
