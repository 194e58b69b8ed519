"""Roles of a chart's display points: large two-sided mountains, and the retests that a line may lean on besides.

A symbol's bars are one row of arrays, gathered by one shuffle on the symbol; all else is folds over
its few pivots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAJOR, RETEST = "major_top", "structural_retest"


@dataclass(frozen=True)
class Display:
    # fixed values that must equal the published ones for right results
    lookback: int = 120
    pivot_left: int = 3
    pivot_right: int = 3
    equal_pct: float = 1.0
    plateau_gap: int = 12
    plateau_pct: float = 8.0
    upgrade_gap: int = 6
    major_pct: float = 28.0
    body_pct: float = 21.0
    fast_bars: int = 6
    retest_pct: float = 5.0
    range_pct: float = 35.0
    separation: int = 9
    level_pct: float = 1.0
    anchors: int = 2
    second_level_pct: float = 85.0
    second_wick_pct: float = 14.0
    second_body_pct: float = 10.0
    middle_pct: float = 7.2
    middle_separation: int = 18
    most: int | None = 3
    edge_bars: int = 3


DISPLAY = Display()
_POINT = "struct<idx: int, price: double, wick: double, body: double, range: double, role: string, line_error: double>"


def _last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def _but_last(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def _tail(a: Column, n: int | None) -> Column:
    """The last n elements; all, if n is None."""
    return a if n is None else F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def _in_order(a: Column, *keys) -> Column:
    """a sorted by keys, each a function of an element."""
    keyed = F.array_sort(F.transform(a, lambda x: F.struct(*[k(x).alias(f"k{i}") for i, k in enumerate(keys)], x.alias("x"))))
    return F.transform(keyed, lambda s: s["x"])


def _plateaus(pivots: Column, d: Display) -> Column:
    """A near pivot of the same level joins the last one, or takes its place if it stands clearly higher or regains an older ceiling."""
    tol = d.equal_pct / 100

    def step(a, x):
        rest, last = _but_last(a), _last(a)
        older = F.array_max(F.transform(rest, lambda r: r["high"]))
        gap = x["idx"] - last["idx"]
        near = (gap <= d.plateau_gap) & (F.abs(x["high"] - last["high"]) / F.greatest(x["high"], last["high"]) <= d.plateau_pct / 100)
        higher = (gap <= d.upgrade_gap) & (x["high"] > last["high"] * (1 + tol))
        regained = F.coalesce((last["high"] < older * (1 - tol)) & (x["high"] >= older * (1 - tol)), F.lit(False))
        return F.when((F.size(a) == 0) | ~near, F.concat(a, F.array(x))).when(higher | regained, F.concat(rest, F.array(x))).otherwise(a)

    return F.aggregate(pivots, F.slice(pivots, 1, 0), step)


def _measured(t: Column, d: Display) -> Column:
    """A pivot with its height over the higher of its two valleys, by lows and by closes, and its place in the window's range."""
    tol, at = d.equal_pct / 100, t["idx"]
    wall = lambda b: (b["high"] > t["high"] * (1 + tol)) | ((b["high"] >= t["high"] * (1 - tol)) & F.array_contains("rep_at", b["idx"]))
    walls = F.transform(F.filter("bars", lambda b: (b["idx"] != at) & wall(b)), lambda b: b["idx"])
    left = F.coalesce(F.array_max(F.filter(walls, lambda w: w < at)), F.lit(-1))
    right = F.coalesce(F.array_min(F.filter(walls, lambda w: w > at)), F.col("n"))

    def height(field):
        lowest = lambda start, n: F.array_min(F.transform(F.slice("bars", start, n), lambda b: b[field]))
        a, b = lowest(left + 2, at - left - 1), lowest(at + 2, right - at - 1)
        return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), t["high"] - F.greatest(a, b)) / t["high"] * 100).otherwise(0.0)

    place = F.when(F.col("top") > F.col("bottom"), (t["high"] - F.col("bottom")) / (F.col("top") - F.col("bottom")) * 100).otherwise(100.0)
    return F.struct(at.alias("idx"), t["high"].alias("price"), height("low").alias("wick"), height("close").alias("body"), place.alias("range"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("double").alias("line_error")).cast(_POINT)


def _apart(kept: Column, x: Column, least: int) -> Column:
    return ~F.exists(kept, lambda k: F.abs(k["idx"] - x["idx"]) < least)


def _as(x: Column, role: str, line_error: Column | None = None) -> Column:
    return x.withField("role", F.lit(role)).withField("line_error", F.lit(None).cast("double") if line_error is None else line_error)


def window_roles(bars: DataFrame, d: Display = DISPLAY) -> DataFrame:
    """bars(symbol, idx from 0 without gaps, bar_date, high, low, close) -> symbol, idx, bar_date, price, prominence_pct, role, body_prominence_pct, range_position_pct, line_error_pct.

    Mountains of the last `lookback` bars that lie apart and don't fall below the one before are major
    tops, if their bodies stand out too. Where they are fewer than `anchors`, the highest retests near their
    level join; between the first and the last point one retest near their line may. A later point of about
    the level of the one before it goes, if price fell from it more slowly than a major top asks for and the
    earlier one was fast; the newest bars are exempt. Fewer than two bars have no points; prices are positive."""
    w, tol = Window.partitionBy("symbol").orderBy("idx"), d.equal_pct / 100
    before, after = w.rowsBetween(-d.pivot_left, -1), w.rowsBetween(1, d.pivot_right)
    high = F.col("high")
    pivot = (F.count("high").over(before) == d.pivot_left) & (F.count("high").over(after) == d.pivot_right) & F.coalesce(F.max("high").over(before) < high * (1 - tol), F.lit(True)) & F.coalesce(F.max("high").over(after) <= high * (1 + tol), F.lit(True))
    c = bars.select("symbol", F.col("idx").cast("int").alias("idx"), "bar_date", *[F.col(x).cast("double").alias(x) for x in ("high", "low", "close")]).withColumn("pivot", pivot)
    c = c.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("idx", "bar_date", "high", "low", "close", "pivot"))).alias("bars")).withColumn("n", F.size("bars")).filter("n >= 2")
    c = c.withColumn("start", F.greatest(F.lit(0), F.least(F.col("n") - max(1, d.lookback), F.col("n") - 2)))
    shown = F.slice("bars", F.col("start") + 1, F.col("n"))
    c = c.withColumns({"bottom": F.array_min(F.transform(shown, lambda b: b["low"])), "top": F.array_max(F.transform(shown, lambda b: b["high"])), "edge": F.greatest("start", F.col("n") - max(1, d.edge_bars))})
    c = c.withColumn("reps", _plateaus(F.filter("bars", lambda b: b["pivot"] & (b["idx"] >= F.col("start"))), d))
    c = c.withColumn("rep_at", F.transform("reps", lambda r: r["idx"]))
    c = c.withColumn("points", F.transform("reps", lambda r: _measured(r, d)))

    none = F.slice("points", 1, 0)
    strongest = _in_order(F.filter("points", lambda t: t["wick"] >= d.major_pct), lambda t: -t["wick"], lambda t: t["idx"])
    separate = F.aggregate(strongest, none, lambda a, x: F.when(_apart(a, x, d.separation), F.concat(a, F.array(x))).otherwise(a))
    rising = F.aggregate(F.array_sort(separate), none, lambda a, x: F.when((F.size(a) == 0) | (x["price"] >= _last(a)["price"] * (1 - d.level_pct / 100)), F.concat(a, F.array(x))).otherwise(a))
    stands = F.filter(_tail(rising, d.most), lambda t: (t["range"] >= d.range_pct) & (t["body"] >= d.body_pct))
    c = c.withColumn("majors", F.transform(stands, lambda t: _as(t, MAJOR)))

    usable = lambda t: (t["range"] >= d.range_pct) & (t["wick"] >= d.second_wick_pct) & (t["body"] >= d.second_body_pct)
    wanted = max(0, d.anchors) if d.most is None else min(d.most, max(0, d.anchors))
    ceiling = F.coalesce(F.array_max(F.transform("majors", lambda t: t["price"])), F.col("top")) * (max(0.0, d.second_level_pct) / 100)
    known = F.transform("majors", lambda t: t["idx"])
    spare = _in_order(F.filter("points", lambda t: ~F.array_contains(known, t["idx"]) & (t["price"] >= ceiling) & usable(t)), lambda t: -t["price"], lambda t: -t["idx"])
    joined = F.aggregate(spare, F.col("majors"), lambda a, x: F.when((F.size(a) < wanted) & _apart(a, x, d.separation), F.concat(a, F.array(_as(x, RETEST)))).otherwise(a))
    c = c.withColumn("anchors", F.array_sort(joined))

    first, last = F.get("anchors", F.lit(0)), _last(F.col("anchors"))
    line = lambda t: first["price"] + (last["price"] - first["price"]) * ((t["idx"] - first["idx"]) / F.nullif(last["idx"] - first["idx"], F.lit(0)))
    error = lambda t: F.abs(t["price"] - line(t)) / line(t)
    between = F.filter("points", lambda t: (t["idx"] > first["idx"]) & (t["idx"] < last["idx"]) & _apart(F.col("anchors"), t, d.middle_separation) & (line(t) > 0) & (error(t) <= d.middle_pct / 100) & usable(t))
    best = F.get(_in_order(between, lambda t: -t["wick"], error, lambda t: t["idx"]), F.lit(0))
    room = F.size("anchors") >= 2 if d.most is None else F.size("anchors").between(2, d.most - 1)
    c = c.withColumn("middle", F.when(room, best))
    c = c.withColumn("all", F.when(F.col("middle").isNotNull(), F.array_sort(F.concat("anchors", F.array(_as(F.col("middle"), RETEST, error(F.col("middle"))))))).otherwise(F.col("anchors")))

    def fast(t):
        fell = F.array_min(F.transform(F.slice("bars", t["idx"] + 2, F.lit(max(1, d.fast_bars))), lambda b: b["close"]))
        return F.coalesce((t["price"] - fell) / t["price"] * 100, F.lit(0.0))

    def slower(t, i):
        earlier = F.get(F.col("all"), i - 1)
        alike = F.abs(t["price"] - earlier["price"]) / F.greatest(t["price"], earlier["price"]) <= d.retest_pct / 100
        return (i > 0) & F.coalesce((t["idx"] < F.col("edge")) & alike & (fast(earlier) >= d.body_pct) & (fast(t) < d.body_pct), F.lit(False))

    rows = c.select("symbol", "bars", F.explode(_tail(F.filter("all", lambda t, i: ~slower(t, i)), d.most)).alias("p"))
    strict = F.col("p.role") == MAJOR
    return rows.select(
        "symbol", "p.idx", F.get("bars", F.col("p.idx"))["bar_date"].alias("bar_date"), "p.price", F.col("p.wick").alias("prominence_pct"), "p.role",
        F.when(strict, F.round("p.body", 2)).alias("body_prominence_pct"), F.when(strict, F.round("p.range", 2)).alias("range_position_pct"), F.round(F.col("p.line_error") * 100, 2).alias("line_error_pct"),
    )
