"""Lids: zones of repeated mountains, confirmed sloped lines, the choice between them and what follows from it.

A symbol's chart is one row: its months and quarters as arrays, gathered by one shuffle on the
symbol (a few hundred bars each, however many symbols there are). Everything up to the choice of
a lid is expressions over these arrays, so no join and no further shuffle is needed for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewatch.functions.scalars import clamp01, grade_for_slope
from basewatch.operators import bars, breakout, peaks
from basewatch.params import DEFAULT, Params
from basewatch.sources.tables import written

#: Reasons for which a sloped candidate is turned down, in the order in which they are looked for. Fixed values.
SLOPED_REASONS = (
    "establishment_too_short", "same_price_zone_candidate", "non_positive_projection", "slope_outside_family_band", "no_independent_confirmation",
    "too_few_independent_touches", "total_span_too_short", "fit_error_too_large", "pre_confirmation_close_escape", "insufficient_congestion_cycles",
    "steady_compounding_trend", "too_directionally_efficient", "different_price_era_below_boundary", "obsolete_boundary_long_since_escaped",
)
#: The family of a reviewed lid, and the role of points that don't fit it. Fixed values.
HUMAN, PEAK = "human_review", "breakout_peak"
_LID = ("family", "anchors", "touches", "slope", "value_at_last", "slope_pct_per_year", "fit_error_pct", "score", "established_q", "confirmed_q", "start_q", "reject_reason", "rank")


def charts(months: DataFrame, as_of: Column) -> DataFrame:
    """months: cleaned and numbered -> one row for each symbol: months, quarters, n_done (quarters over by as_of), n_all, last_close."""
    q = F.struct("q_idx", "bar_date", "high", "low", "close", "high_src_idx", "close_src_idx", "last_month")
    quarters = bars.quarterly(months).groupBy("symbol").agg(F.array_sort(F.collect_list(q)).alias("quarters"))
    m = F.struct("idx", "bar_date", "high", "low", "close", "volume")
    both = quarters.join(months.groupBy("symbol").agg(F.array_sort(F.collect_list(m)).alias("months")), "symbol")
    last = F.element_at("quarters", -1)
    closed = (last["last_month"] % 3 == 0) & (F.last_day(last["bar_date"]) <= as_of)
    return both.withColumns({"n_all": F.size("quarters"), "n_done": F.size("quarters") - F.when(closed, 0).otherwise(1), "last_close": last["close"]})


def mountains(chart: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """chart with tops: its mountains as an array of q_idx, price, prominence_pct, month. They fall away on both sides."""
    tol = p.equal_tolerance_pct / 100
    done = F.slice("quarters", F.lit(1), F.col("n_done"))
    high = lambda i: F.get(F.col("done"), i)["high"]
    is_pivot = lambda x: (x["q_idx"] >= 1) & (x["q_idx"] < F.col("n_done") - 1) & (high(x["q_idx"] - 1) < x["high"] * (1 - tol)) & (high(x["q_idx"] + 1) <= x["high"] * (1 + tol))

    def plateau(a, x):
        """A near pivot of the same level joins the last one, or takes its place if it stands clearly higher or regains an older ceiling."""
        rest = F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
        last = F.try_element_at(a, F.lit(-1))
        older = F.array_max(F.transform(rest, lambda r: r["high"]))
        near = (x["q_idx"] - last["q_idx"] <= p.plateau_gap) & (F.abs(x["high"] - last["high"]) / F.greatest(x["high"], last["high"]) <= p.plateau_tolerance_pct / 100)
        higher = (x["q_idx"] - last["q_idx"] <= p.plateau_upgrade_gap) & (x["high"] > last["high"] * (1 + tol))
        regained = F.coalesce((last["high"] < older * (1 - tol)) & (x["high"] >= older * (1 - tol)), F.lit(False))
        return F.when((F.size(a) == 0) | ~near, F.concat(a, F.array(x))).when(higher | regained, F.concat(rest, F.array(x))).otherwise(a)

    def measured(t):
        at = t["q_idx"]
        rival = lambda b: (b["high"] > t["high"] * (1 + tol)) | ((b["high"] >= t["high"] * (1 - tol)) & (b["q_idx"] != at) & F.array_contains("rep_at", b["q_idx"]))
        walls = F.transform(F.filter("done", rival), lambda b: b["q_idx"])
        left = F.coalesce(F.array_max(F.filter(walls, lambda w: w < at)), F.lit(-1))
        right = F.coalesce(F.array_min(F.filter(walls, lambda w: w > at)), F.col("n_done"))
        lowest = lambda start, n: F.array_min(F.transform(F.slice("done", start, n), lambda b: b["low"]))
        a, b = lowest(left + 2, at - left - 1), lowest(at + 2, right - at - 1)
        height = F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), (t["high"] - F.greatest(a, b)) / t["high"] * 100)).otherwise(0.0)
        return F.struct(at.alias("q_idx"), t["high"].alias("price"), height.alias("prominence_pct"), t["high_src_idx"].alias("month"))

    c = chart.withColumn("done", done)
    c = c.withColumn("reps", F.aggregate(F.filter("done", is_pivot), F.slice("done", 1, 0), plateau))
    c = c.withColumn("rep_at", F.transform("reps", lambda r: r["q_idx"]))
    return c.withColumn("tops", F.filter(F.transform("reps", measured), lambda t: t["prominence_pct"] >= p.zone_prominence_pct)).drop("reps", "rep_at")


def zone_lids(tops: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row for each price zone, as a lid through its first and last member; rank orders those that qualify."""
    falling = F.array_sort(F.transform("tops", lambda t: F.struct((-t["price"]).alias("o"), t["q_idx"].alias("q_idx"), t.alias("top"))))
    kind = "array<struct<seed:double,top:struct<q_idx:int,price:double,prominence_pct:double,month:int>>>"

    def assign(a, x):
        seed, price = F.try_element_at(a, F.lit(-1))["seed"], x["top"]["price"]
        own = F.when((seed - price) / seed <= p.zone_similarity_pct / 100, seed).otherwise(price)
        return F.concat(a, F.array(F.struct(own.alias("seed"), x["top"].alias("top")))).cast(kind)

    z = tops.withColumn("seeded", F.aggregate(falling, F.array().cast(kind), assign))
    z = z.withColumn("seed", F.explode(F.array_distinct(F.transform("seeded", lambda s: s["seed"]))))
    z = z.withColumn("touches", F.array_sort(F.transform(F.filter("seeded", lambda s: s["seed"] == F.col("seed")), lambda s: s["top"]))).drop("seeded", "seed")
    n, first, last = F.size("touches"), F.get("touches", F.lit(0)), F.element_at("touches", -1)
    total = lambda field: F.aggregate("touches", F.lit(0.0), lambda a, t: a + t[field])
    z = z.withColumns({"n": n, "first": first, "last": last, "level": total("price") / n, "mean_prominence": total("prominence_pct") / n})
    z = z.withColumn("span", F.col("last.q_idx") - F.col("first.q_idx"))
    z = z.withColumn("slope", F.coalesce((F.col("last.price") - F.col("first.price")) / F.nullif(F.col("span"), F.lit(0)), F.lit(0.0)))
    z = z.withColumn("value_at_last", F.col("first.price") + F.col("slope") * (F.col("n_all") - 1 - F.col("first.q_idx")))
    era = F.col("last_close") / F.col("level") * 100
    reason = (
        F.when(F.col("n") < 2, "too_few_members").when(F.col("span") < p.zone_separation, "too_short").when(F.col("level") <= 0, "no_level")
        .when(era < p.era_low_pct, "different_price_era").when(era > p.era_high_pct, "long_since_escaped")
    )
    score = 0.45 * clamp01(F.col("n") / 4) + 0.35 * clamp01(F.col("span") / 40) + 0.20 * clamp01(F.col("mean_prominence") / 40)
    z = z.withColumn("reject_reason", reason)
    rank = F.row_number().over(Window.partitionBy("symbol", F.col("reject_reason").isNull()).orderBy(F.desc("last.q_idx"), F.desc("n"), F.desc("span"), "first.q_idx"))
    return z.withColumns({
        "family": F.lit("same_price_zone"), "anchors": F.array("first", "last"), "slope_pct_per_year": F.col("slope") * 400 / F.nullif("value_at_last", F.lit(0.0)), "fit_error_pct": F.lit(0.0), "score": score,
        "established_q": F.col("last.q_idx"), "confirmed_q": F.col("last.q_idx"), "start_q": F.col("first.q_idx"), "rank": F.when(F.col("reject_reason").isNull(), rank),
    }).select("symbol", "level", *_LID)


def _clustered(points: Column, gap: int, at: str = "q_idx") -> Column:
    """Points in order of time; those within gap of the last kept one are one touch, its highest."""

    def step(a, x):
        last = F.try_element_at(a, F.lit(-1))
        swapped = F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(x))
        return F.when((F.size(a) == 0) | (x[at] - last[at] > gap), F.concat(a, F.array(x))).when(x["price"] > last["price"], swapped).otherwise(a)

    return F.aggregate(points, F.slice(points, 1, 0), step)


def _log_r2(closes: Column) -> Column:
    """How straight the logarithms of closes are; null below three, 0 if they don't move."""
    n = F.size(closes)
    pairs = F.transform(closes, lambda c, i: F.struct((i - (n - 1) / 2).alias("x"), F.ln(c).alias("y")))
    add = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, v: a + f(v))
    mean = add(lambda v: v["y"]) / n
    xy, yy, xx = add(lambda v: v["x"] * v["y"]), add(lambda v: v["y"] * v["y"]) - n * mean * mean, add(lambda v: v["x"] * v["x"])
    return F.when(n < 3, None).when(yy <= 1e-12, 0.0).otherwise(xy * xy / (xx * yy))


def _efficiency(closes: Column) -> Column:
    """Net travel of the logarithms as a part of all travel."""
    steps = F.transform(F.slice(closes, F.lit(2), F.greatest(F.size(closes) - 1, F.lit(0))), lambda c, i: F.ln(c / F.get(closes, i)))
    travel = F.aggregate(steps, F.lit(0.0), lambda a, s: a + F.abs(s))
    net = F.abs(F.aggregate(steps, F.lit(0.0), lambda a, s: a + s))
    return F.when(F.size(closes) < 2, 1.0).when(travel <= 0, 0.0).otherwise(net / travel)


def _turned_down(c: DataFrame, name: str, reasons, tests) -> DataFrame:
    """Column name: the reason of the first test that a row meets."""
    return c.withColumn(name, F.coalesce(*[F.when(test, F.lit(reason)) for test, reason in zip(tests, reasons, strict=True)]))


def sloped_lids(tops: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row for each pair of mountains: a line that a later mountain has to confirm; rank orders those that qualify.

    The first two touches fix the line, so that the newest high can't make a lid by being its end.
    """
    after = lambda a: F.transform(F.filter("tops", lambda b: b["q_idx"] > a["q_idx"]), lambda b: F.struct(a.alias("a"), b.alias("b")))
    c = tops.filter(F.size("tops") >= p.sloped_touches).withColumn("pair", F.explode(F.flatten(F.transform("tops", after))))
    c = c.withColumns({"a": F.col("pair.a"), "b": F.col("pair.b")}).drop("pair")
    c = c.withColumn("span", F.col("b.q_idx") - F.col("a.q_idx")).withColumn("slope", (F.col("b.price") - F.col("a.price")) / F.col("span"))
    line = lambda i: F.col("a.price") + F.col("slope") * (i - F.col("a.q_idx"))
    off = lambda t: F.abs(t["price"] - line(t["q_idx"])) / line(t["q_idx"])
    later = F.filter("tops", lambda t: (t["q_idx"] - F.col("b.q_idx") >= p.sloped_confirm_gap) & (line(t["q_idx"]) > 0) & (off(t) <= p.sloped_touch_tolerance_pct / 100))
    c = c.withColumns({"later": later, "at_done": line(F.col("n_done") - 1), "value_at_last": line(F.col("n_all") - 1)})
    c = c.withColumn("touches", _clustered(F.concat(F.array("a", "b"), F.col("later")), p.sloped_cluster))
    c = c.withColumn("confirmed_q", F.element_at("touches", -1)["q_idx"])
    change = F.abs(F.col("b.price") - F.col("a.price")) / F.greatest("a.price", "b.price") * 100
    steep = F.abs(F.col("slope") * 400 / F.nullif("at_done", F.lit(0.0)))
    # most pairs fall to a test that costs nothing: what the later ones look at is worked out for the others only
    c = _turned_down(c, "early", SLOPED_REASONS[:6], (
        F.col("span") < p.sloped_establish, change < p.sloped_change_pct, (F.col("at_done") <= 0) | (F.col("value_at_last") <= 0), ~steep.between(*p.sloped_slope_pct),
        F.size("later") == 0, F.size("touches") < p.sloped_touches,
    ))
    within = F.when(F.col("early").isNull(), F.slice("done", F.col("a.q_idx") + 1, F.col("confirmed_q") - F.col("a.q_idx") + 1))

    def depth(t, i):
        before = F.get(F.col("touches"), i)
        low = F.array_min(F.transform(F.slice("done", before["q_idx"] + 2, F.greatest(t["q_idx"] - before["q_idx"] - 1, F.lit(0))), lambda b: F.struct(b["low"], b["q_idx"])))
        return F.when(line(low["q_idx"]) > 0, (line(low["q_idx"]) - low["low"]) / line(low["q_idx"]) * 100)

    c = c.withColumns({"within": within, "total": F.col("confirmed_q") - F.col("a.q_idx")})
    c = c.withColumn("hits", F.when(F.col("early").isNull(), F.col("touches")))
    c = c.withColumns({
        "fit_error_pct": F.sqrt(F.aggregate("hits", F.lit(0.0), lambda s, t: s + off(t) * off(t)) / F.size("hits")) * 100,
        "escapes": F.size(F.filter("within", lambda q: (line(q["q_idx"]) <= 0) | (q["close"] > line(q["q_idx"]) * (1 + p.break_tolerance_pct / 100)))),
        "dips": F.size(F.filter(F.transform(F.slice("hits", F.lit(2), F.size("hits")), depth), lambda d: d >= p.sloped_pullback_pct)),
    })
    c = _turned_down(c, "middle", ("", *SLOPED_REASONS[6:10]), (F.col("early").isNotNull(), F.col("total") < p.sloped_total, F.col("fit_error_pct") > p.sloped_fit_error_pct, F.col("escapes") > 0, F.col("dips") < p.sloped_pullbacks))
    c = c.withColumn("closes", F.when(F.col("middle").isNull(), F.transform("within", lambda q: q["close"])))
    c = c.withColumns({"r2": _log_r2(F.col("closes")), "efficiency": _efficiency(F.col("closes")), "era": F.col("last_close") / F.nullif("value_at_last", F.lit(0.0)) * 100})
    c = _turned_down(c, "late", ("", *SLOPED_REASONS[10:]), (F.col("middle").isNotNull(), F.col("r2") >= p.trend_r2, F.col("efficiency") > p.sloped_efficiency, F.col("era") < p.era_low_pct, F.col("era") > p.era_high_pct))
    c = c.withColumn("reject_reason", F.coalesce("early", F.nullif("middle", F.lit("")), F.nullif("late", F.lit(""))))
    score = (
        0.25 * clamp01((F.size("touches") - 1) / 4) + 0.20 * clamp01(F.col("total") / (2.0 * p.sloped_total)) + 0.20 * clamp01(1 - F.col("fit_error_pct") / p.sloped_fit_error_pct)
        + 0.20 * clamp01(1 - F.col("efficiency") / p.sloped_efficiency) + 0.15 * clamp01(F.col("dips") / (p.sloped_pullbacks + 1.0))
    )
    c = c.withColumn("score", F.when(F.col("reject_reason").isNull(), score))
    rank = F.row_number().over(Window.partitionBy("symbol", F.col("reject_reason").isNull()).orderBy(F.desc("score"), F.desc("confirmed_q"), F.desc("span"), "a.q_idx"))
    return c.withColumns({
        "family": F.lit("sloped_confirmed"), "anchors": F.array("a", "b"), "slope_pct_per_year": F.col("slope") * 400 / F.nullif("value_at_last", F.lit(0.0)),
        "established_q": F.col("b.q_idx"), "start_q": F.col("confirmed_q") + 1, "rank": F.when(F.col("reject_reason").isNull(), rank),
    }).select("symbol", *_LID)


def sloped_rejections(lids: DataFrame) -> DataFrame:
    # a filter on the reason would be pushed below, and would work it out twice
    return lids.groupBy("symbol", "reject_reason").agg(F.count("reject_reason").alias("n")).filter("n > 0")


def chosen(zones: DataFrame, sloped: DataFrame) -> DataFrame:
    """The lid of each symbol: the best zone, and where none qualifies the best sloped line."""
    both = zones.drop("level").filter("rank = 1 AND value_at_last > 0").unionByName(sloped.filter("rank = 1"))
    first = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("family") != "same_price_zone"))
    return both.withColumn("nth", first).filter("nth = 1").drop("nth")


def lid_quarters(chart: DataFrame, lid: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Quarters from start_q on with the lid's value, the close before and the band; complete says whether as_of has closed them."""
    both = chart.select("symbol", "quarters", "n_done", "n_all").join(lid.select("symbol", "family", "anchors", "slope", "value_at_last", "start_q"), "symbol")
    rows = both.select("symbol", "n_done", "n_all", "family", "slope", "value_at_last", "start_q", F.get("anchors", F.lit(0)).alias("a"), F.explode("quarters").alias("q"))
    # a fitted line need not go through its first anchor
    at = F.when(F.col("family") == HUMAN, F.col("value_at_last") + F.col("slope") * (F.col("q.q_idx") - (F.col("n_all") - 1))).otherwise(F.col("a.price") + F.col("slope") * (F.col("q.q_idx") - F.col("a.q_idx")))
    rows = rows.select("symbol", "n_done", "slope", "start_q", "q.q_idx", "q.high", "q.low", "q.close", at.alias("lid"))
    rows = rows.withColumn("before", F.lag("close").over(Window.partitionBy("symbol").orderBy("q_idx")))
    return peaks.escape_band(rows, p=p).filter("q_idx >= start_q AND lid > 0").withColumn("complete", F.col("q_idx") < F.col("n_done"))


def review_lids(chart: DataFrame, points: DataFrame) -> DataFrame:
    """points(symbol, day, price, role, lid_member), a reviewer's tops, nth orders those of one quarter -> each symbol's reviewed lid, as zone_lids() gives its own.

    Points carry authority: no gate and no zone is asked. Those outside the chart or in a quarter that
    isn't over fall away; a point without a price has its month's high. Breakout peaks are shown but
    don't fit the line; where any point says that it is a member of the lid, only such points do. A
    line needs two points in different quarters and a positive value at the end, else there is none."""
    kind = "array<struct<q_idx:int,nth:int,price:double,prominence_pct:double,month:int,role:string,lid_member:boolean>>"
    of = points.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("nth", "day", "price", "role", F.coalesce("lid_member", F.lit(False)).alias("lid_member")))).alias("points"))
    x = chart.select("symbol", "months", "quarters", "n_done", "n_all").join(of, "symbol")
    ym = lambda d: F.year(d) * 12 + F.month(d)

    def placed(t):
        month = F.try_element_at(F.filter("months", lambda m: ym(m["bar_date"]) == ym(t["day"])), F.lit(-1))
        quarter = F.get(F.filter("quarters", lambda q: (F.year(q["bar_date"]) == F.year(t["day"])) & (F.quarter(q["bar_date"]) == F.quarter(t["day"]))), F.lit(0))
        return F.struct(quarter["q_idx"].alias("q_idx"), t["nth"].alias("nth"), F.coalesce(t["price"], month["high"]).alias("price"), F.lit(0.0).alias("prominence_pct"), month["idx"].alias("month"), F.coalesce(t["role"], F.lit("major_top")).alias("role"), t["lid_member"].alias("lid_member"))

    x = x.withColumn("explicit", F.exists("points", lambda t: t["lid_member"]))
    x = x.withColumn("seen", F.array_sort(F.filter(F.transform("points", placed).cast(kind), lambda t: t["month"].isNotNull() & (t["q_idx"] < F.col("n_done")))))
    top = lambda t: F.struct(t["q_idx"].alias("q_idx"), t["price"].alias("price"), t["prominence_pct"].alias("prominence_pct"), t["month"].alias("month"))
    x = x.withColumns({"touches": F.transform(F.filter("seen", lambda t: t["role"] != PEAK), top), "anchors": F.transform(F.filter("seen", lambda t: (t["role"] != PEAK) & (~F.col("explicit") | t["lid_member"])), top)})
    x = x.filter("n_all >= 3 AND size(anchors) >= 2").withColumns(_fit("anchors", "q_idx", "slope", "centre", "level"))
    x = x.withColumn("value_at_last", F.col("level") + F.col("slope") * (F.col("n_all") - 1 - F.col("centre"))).filter("value_at_last > 0")
    at = lambda t: F.col("level") + F.col("slope") * (t["q_idx"] - F.col("centre"))
    square = F.aggregate("anchors", F.lit(0.0), lambda a, t: a + F.when(at(t) > 0, F.pow((t["price"] - at(t)) / at(t), F.lit(2))).otherwise(float("inf")))
    return x.select(
        "symbol", F.lit(HUMAN).alias("family"), "anchors", "touches", "slope", "value_at_last", (F.col("slope") * 400 / F.col("value_at_last")).alias("slope_pct_per_year"), (F.sqrt(square / F.size("anchors")) * 100).alias("fit_error_pct"), F.lit(0.0).alias("score"),
        F.get("anchors", F.lit(1))["q_idx"].alias("established_q"), F.try_element_at("anchors", F.lit(-1))["q_idx"].alias("confirmed_q"), (F.try_element_at("anchors", F.lit(-1))["q_idx"] + 1).alias("start_q"), F.lit(None).cast("string").alias("reject_reason"), F.lit(1).alias("rank"),
    )


def _fit(points: str, x: str, slope: str, centre: str, level: str) -> dict[str, Column]:
    """Columns of the least-squares line through an array of points: its slope, and a point on it. No slope where all points share one place."""
    mean = lambda field: F.aggregate(points, F.lit(0.0), lambda a, t: a + t[field]) / F.size(points)
    mx, my = mean(x), mean("price")
    spread = F.aggregate(points, F.lit(0.0), lambda a, t: a + (t[x] - mx) * (t[x] - mx))
    return {slope: F.aggregate(points, F.lit(0.0), lambda a, t: a + (t[x] - mx) * (t["price"] - my)) / F.nullif(spread, F.lit(0.0)), centre: mx, level: my}


def escape_details(walk: DataFrame, state: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """lid_quarters() and breakout.assess()'s rows -> symbol, violations (completed quarters that closed over the band), retest_q and retest_holds.

    A retest is the last quarter between lid and band while the escape that stands was under way."""
    over = F.col("close") > F.col("lid") * (1 + F.col("band_pct") / 100)
    x = walk.filter("complete").join(state.select("symbol", "state", "escape_q", "confirmed_q"), "symbol")
    cooled = (F.col("state") != "sealed") & (F.col("q_idx") > F.col("escape_q")) & (F.col("q_idx") <= F.coalesce("confirmed_q", F.lit(2**31 - 1))) & ~over & (F.col("close") >= F.col("lid"))
    holds = F.col("low") >= F.col("lid") * (1 - p.retest_tolerance_pct / 100)
    return x.groupBy("symbol").agg(F.count_if(over).alias("band_violations"), F.max(F.when(cooled, F.struct("q_idx", holds.alias("holds")))).alias("r")).select("symbol", "band_violations", F.col("r.q_idx").alias("retest_q"), F.col("r.holds").alias("retest_holds"))


def detected(months: DataFrame, as_of: Column, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Charts and the lids that the detector chooses."""
    chart = written(mountains(charts(months, as_of), p), "charts")  # the bars are read once
    return chart, written(chosen(zone_lids(chart, p), sloped_lids(chart, p)), "lids")


def analysed(months: DataFrame, as_of: Column, p: Params = DEFAULT) -> DataFrame:
    """The whole analysis, one row for each symbol: its lid in months, touches, pullbacks, gates, grade, lifecycle and score."""
    return summary(measured(*detected(months, as_of, p), p))


def reviewed(months: DataFrame, as_of: Column, points: DataFrame, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """detected(), where a symbol's reviewed lid takes the place of the detector's."""
    chart, own = detected(months, as_of, p)
    human = written(review_lids(chart, points), "review-lids")
    return chart, own.join(human.select("symbol"), "symbol", "left_anti").select("symbol", *_LID).unionByName(human)


def overridden(months: DataFrame, as_of: Column, points: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """analysed() with a reviewer's points (see review_lids()); effective says whose lid counts."""
    return summary(measured(*reviewed(months, as_of, points, p), p)).withColumn("effective", F.when(F.col("family") == HUMAN, "human").otherwise("algorithm"))


def measured(chart: DataFrame, lid: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Charts and one lid a symbol -> all that follows from the lid, one row for each symbol."""
    walk = lid_quarters(chart, lid, p)
    state = breakout.assess(walk.filter("complete"), p).select("symbol", "state", "escape_q", "confirmed_q", "via", "failed")
    state = state.join(escape_details(walk, state, p), "symbol")
    partial = walk.filter("NOT complete").select("symbol", (F.col("close") > F.col("lid") * (1 + F.col("band_pct") / 100)).alias("over"))
    minor = peaks.swings(chart.select("symbol", F.explode("months").alias("m")).select("symbol", "m.*"), p).filter(F.col("prominence_pct") >= p.minor_prominence_pct)
    minor = minor.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("idx", "price"))).alias("minor"))
    x = chart.select("symbol", "months", "quarters", "n_done", "n_all").join(lid.withColumnRenamed("confirmed_q", "lid_confirmed_q"), "symbol", "left")
    x = x.join(state, "symbol", "left").join(partial, "symbol", "left").join(minor, "symbol", "left")
    x = x.withColumns({"n": F.size("months"), "state": F.coalesce("state", F.lit("sealed")), "close_now": F.element_at("months", -1)["close"]})
    # the line in months: through the months that gave the anchors their highs
    point = lambda t: F.struct(t["month"].alias("idx"), t["price"].alias("price"))
    x = x.withColumns({"m0": F.get("anchors", F.lit(0))["month"], "p0": F.get("anchors", F.lit(0))["price"], "m1": F.get("anchors", F.lit(1))["month"], "p1": F.get("anchors", F.lit(1))["price"], "members": F.transform("touches", point), "fitted": F.transform("anchors", point)})
    x = x.withColumns(_fit("fitted", "idx", "fit_slope", "fit_centre", "fit_level"))
    human = F.col("family") == HUMAN
    x = x.withColumn("per_month", F.when(human, F.col("fit_slope")).otherwise((F.col("p1") - F.col("p0")) / F.nullif(F.col("m1") - F.col("m0"), F.lit(0))))
    x = x.withColumn("p0", F.when(human, F.col("fit_level") + F.col("fit_slope") * (F.col("m0") - F.col("fit_centre"))).otherwise(F.col("p0")))
    line = lambda i: F.col("p0") + F.col("per_month") * (i - F.col("m0"))
    x = x.withColumn("lid_now", line(F.col("n") - 1)).withColumn("lid_slope_pct", F.col("per_month") * 1200 / F.col("lid_now"))
    limit = F.when(F.col("n_done") == F.col("n_all"), F.col("n") - 1).otherwise(F.coalesce(F.get("quarters", F.col("n_done") - 1)["close_src_idx"], F.lit(-1)))
    near = F.filter(F.coalesce("minor", F.slice("members", 1, 0)), lambda s: (s["idx"] >= F.col("m0")) & (s["idx"] <= limit) & ~F.exists("members", lambda t: t["idx"] == s["idx"]) & (line(s["idx"]) > 0) & (F.abs(s["price"] - line(s["idx"])) / line(s["idx"]) <= p.touch_tolerance_pct / 100))
    x = x.withColumn("points", F.array_sort(F.concat("members", near))).withColumn("hits", _clustered(F.col("points"), p.touch_cluster, "idx"))

    def pullback(t, i):
        last = i == F.size("hits") - 1
        until = F.when(last, F.col("n") - 1).otherwise(F.get("hits", i + 1)["idx"] - 1)
        seg = F.slice("months", t["idx"] + 2, F.greatest(until - t["idx"], F.lit(0)))
        low = F.array_min(F.transform(seg, lambda b: F.struct(b["low"], b["idx"])))
        at = line(low["idx"])
        return F.when((F.size(seg) >= p.pullback_bars) & (at > 0), F.struct(low["idx"].alias("idx"), low["low"].alias("low"), F.round((at - low["low"]) / at * 100, 2).alias("depth")))

    x = x.withColumn("dips", F.array_compact(F.transform("hits", pullback)))
    x = x.withColumns({"depths": F.transform("dips", lambda d: d["depth"]), "base": F.filter("months", lambda b: b["idx"] >= F.col("m0")), "proximity_pct": F.col("close_now") / F.col("lid_now") * 100})
    ratio = F.when((F.size("depths") >= 2) & (F.array_max("depths") > 0), F.element_at("depths", -1) / F.array_max("depths"))
    x = x.withColumns({"depth_ratio": ratio, "base_r2": _log_r2(F.transform("base", lambda b: b["close"])), "pressed": F.col("proximity_pct") >= p.pressed_pct, "known": F.filter(F.transform("base", lambda b: b["volume"]), lambda v: v > 0)})
    shrinks = F.when(F.size("depths") >= 2, F.coalesce(F.col("depth_ratio") <= p.last_depth_ratio, F.lit(False))).when(F.size("depths") == 1, F.element_at("depths", -1) <= p.single_pullback_pct).otherwise(True)
    third = F.greatest(F.lit(1), F.floor(F.size("known") / 3)).cast("int")
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda a, v: a + v) / F.size(part)
    newest = F.slice(F.reverse("known"), 1, 12)
    early = mean(F.slice("known", F.lit(1), third))
    x = x.withColumns({
        "compressed": shrinks | F.col("pressed"), "lid_grade": grade_for_slope(F.col("lid_slope_pct"), p), "n_touches": F.size("hits"),
        "volume_ratio": F.when((F.size("known") >= F.greatest(F.lit(12), F.floor(F.size("base") * 0.6))) & (early > 0), mean(newest) / F.nullif(early, F.lit(0.0))),
        "span_years": (F.element_at("hits", -1)["idx"] - F.get("hits", F.lit(0))["idx"]) / 12.0, "mature": F.size(F.array_distinct(F.transform("months", lambda b: F.trunc(b["bar_date"], "MM")))) / 12.0 >= p.min_years,
        "violations": F.size(F.filter("base", lambda b: (line(b["idx"]) > 0) & (b["close"] > line(b["idx"]) * (1 + p.break_tolerance_pct / 100)))),
    })
    lo, hi = F.get("dips", F.lit(0)), F.try_element_at("dips", F.lit(-1))
    rise = (hi["low"] - lo["low"]) / F.nullif(hi["idx"] - lo["idx"], F.lit(0))
    support_now = hi["low"] + rise * (F.col("n") - 1 - hi["idx"])
    has = F.col("family").isNotNull() & (F.col("lid_now") > 0) & (F.col("n") >= p.min_bars)
    gate = F.col("lid_grade").isNull() | ~F.col("compressed") | ((F.col("proximity_pct") < p.proximity_gate_pct) & (F.col("state") == "sealed")) | F.coalesce(F.col("base_r2") >= p.trend_r2, F.lit(False))
    inside = F.col("proximity_pct").between(*p.lid_band_pct)
    lifecycle = (
        F.when(~has, "no_structure").when(F.col("proximity_pct") < p.lid_band_pct[0], "forming").when(F.col("proximity_pct") > p.lid_band_pct[1], "post_breakout")
        .when(F.col("state") == "broken_out", "post_breakout").when(F.col("state") == "breaking_out", "breaking_out").when(gate, "forming").otherwise("pre_breakout")
    )
    squeeze = F.when(F.col("depth_ratio").isNotNull(), clamp01(1 - F.col("depth_ratio"))).when(F.col("compressed"), 0.5).otherwise(0.0)
    score = 100 * (0.30 * clamp01(1 - F.abs("lid_slope_pct") / p.grade_c) + 0.20 * F.least(F.col("n_touches"), F.lit(5)) / 5 + 0.20 * squeeze + 0.15 * clamp01((F.col("proximity_pct") - 60) / 40) + 0.15 * clamp01(F.col("span_years") / 10))
    converging = F.coalesce((support_now > 0) & (rise * 1200 / support_now > F.col("lid_slope_pct")), F.lit(False))
    position = F.when(F.col("proximity_pct") < p.lid_band_pct[0], "below_lid_band").when(F.col("proximity_pct") > p.lid_band_pct[1], "above_lid_band").otherwise("within_lid_band")
    graded = F.when(inside & F.col("mature") & ~gate & (F.col("state") != "broken_out"), F.col("lid_grade"))
    return x.withColumns({"has": F.coalesce(has, F.lit(False)), "lifecycle": lifecycle, "converging": converging, "price_position": position, "graded": graded, "total": F.when(has, F.round(score, 1)).otherwise(0.0), "depth_rule": shrinks})


def summary(x: DataFrame) -> DataFrame:
    """measured() -> what an analysis shows."""
    shown = lambda c: F.when(F.col("has"), c)
    status = F.create_map(*[F.lit(v) for pair in (("no_structure", "no_structure"), ("forming", "basing"), ("pre_breakout", "coiling"), ("breaking_out", "breaking_out"), ("post_breakout", "broken_out")) for v in pair])
    return x.select(
        "symbol", "lifecycle", status[F.col("lifecycle")].alias("status"), shown(F.col("graded")).alias("grade"), shown(F.col("lid_grade")).alias("lid_grade"),
        shown(F.col("family")).alias("family"), shown(F.col("state")).alias("breakout_state"), shown(F.coalesce(F.col("over") & (F.col("state") == "sealed"), F.lit(False))).alias("provisional_escape"),
        shown(F.round("lid_now", 4)).alias("lid_value"), shown(F.round("lid_slope_pct", 2)).alias("lid_slope_pct_per_year"), shown(F.round("proximity_pct", 2)).alias("proximity_pct"),
        shown(F.col("price_position")).alias("price_position"),
        shown(F.col("n_touches")).alias("touch_count"), shown(F.round("span_years", 2)).alias("span_years"), shown(F.col("depths")).alias("pullback_depths_pct"), shown(F.round("depth_ratio", 3)).alias("last_depth_ratio"),
        shown(F.col("compressed")).alias("compression_ok"), shown(F.col("pressed")).alias("pressed_at_lid"), shown(F.col("converging")).alias("support_converging"),
        shown(F.round("base_r2", 3)).alias("base_trend_r2"), shown(F.round("volume_ratio", 3)).alias("volume_contraction_ratio"), shown(F.col("violations")).alias("violation_count"),
        "mature", F.col("total").alias("coil_score"),
    )
