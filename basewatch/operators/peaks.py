"""Pivots, prominence, plateaus and separation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewatch.functions.scalars import clamp01
from basewatch.params import DEFAULT, Params


def pivots(bars: DataFrame, left: int, right: int, value: str = "high") -> DataFrame:
    """Bars strictly above all `left` before and not below any of `right` after; both windows lie inside."""
    w = Window.partitionBy("symbol").orderBy("idx")
    before, after = w.rowsBetween(-left, -1), w.rowsBetween(1, right)
    ok = (F.count(value).over(before) == left) & (F.count(value).over(after) == right) & (F.col(value) > F.max(value).over(before)) & (F.col(value) >= F.max(value).over(after))
    return bars.withColumn("pivot", ok).filter("pivot").drop("pivot")


def mountain_pivots(quarters: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Quarters clearly above the one before and not clearly below the one after."""
    w, tol = Window.partitionBy("symbol").orderBy("q_idx"), p.equal_tolerance_pct / 100
    high = F.col("high")
    return quarters.withColumn("pivot", (F.lag("high").over(w) < high * (1 - tol)) & (F.lead("high").over(w) <= high * (1 + tol))).filter("pivot").drop("pivot")


def pair_lines(tops: DataFrame, gap: int) -> DataFrame:
    """Lines through two of a symbol's tops that lie at least gap bars apart: symbol, a, b, price_a, slope."""
    a, b = tops.alias("a"), tops.alias("b")
    pairs = a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("b.idx") - F.col("a.idx") >= gap))
    return pairs.select("a.symbol", F.col("a.idx").alias("a"), F.col("b.idx").alias("b"), F.col("a.price").alias("price_a"), F.try_divide(F.col("b.price") - F.col("a.price"), F.col("b.idx") - F.col("a.idx")).alias("slope"))


def best_pairs(swing_rows: DataFrame, bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """swings()'s rows and numbered bars -> the best line through two separated major tops of each symbol: symbol, a, b, touches, overshoots, violations, slope_pct, score.

    Touches are minor swings near the line, one for each cluster; lines with too few, too many
    swings above, a stale last touch far above the price, or a close above the line before the
    tolerated tail fall out. A symbol's swings and closes are arrays of one row: nothing is joined
    by line."""
    majors = separated(swing_rows, p.major_prominence_pct, p.major_separation).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("idx", "price"))).alias("majors"))
    minors = swing_rows.filter(F.col("prominence_pct") >= p.minor_prominence_pct).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("idx", "price"))).alias("minors"))
    closes = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("idx", "close"))).alias("closes"))
    # explode() of a filtered array keeps what was worked out as a column: filters over such columns aren't moved below it, where each would work them out again, for every close
    one_of = lambda value, test: F.explode(F.filter(F.array(value), test))
    x = majors.join(minors, "symbol").join(closes, "symbol").withColumn("last", F.size("closes") - 1).withColumn("one", F.explode("majors"))
    # a symbol's majors are dealt out: few symbols would otherwise be one task
    x = x.repartition(bars.sparkSession.sparkContext.defaultParallelism, "symbol", F.col("one.idx"))

    def line(two: Column) -> Column:
        slope = (two["price"] - F.col("one.price")) / (two["idx"] - F.col("one.idx"))
        return F.struct(two["idx"].alias("b"), slope.alias("slope"), (F.col("one.price") + slope * (F.col("last") - F.col("one.idx"))).alias("now"))

    lines = F.transform(F.filter("majors", lambda t: t["idx"] - F.col("one.idx") >= p.anchor_span), line)
    x = x.withColumn("line", F.explode(F.filter(lines, lambda n: (n["now"] > 0) & (n["slope"] * 1200 / F.nullif(n["now"], F.lit(0.0))).between(*p.pair_slope_pct))))
    x = x.select("symbol", "minors", "closes", "last", "one", "line.b", "line.slope", (F.col("line.slope") * 1200 / F.nullif("line.now", F.lit(0.0))).alias("slope_pct"))
    at = lambda i: F.col("one.price") + F.col("slope") * (i - F.col("one.idx"))
    off = lambda t: (t["price"] - at(t["idx"])) / at(t["idx"])
    tol = p.touch_tolerance_pct / 100
    last = lambda a: F.try_element_at(a, F.lit(-1))
    shape = "array<struct<idx:int,price:double>>"
    # the highest of a cluster stands for it, and the next one is measured from there
    cluster = lambda a, t: F.when((F.size(a) > 0) & (t["idx"] - last(a)["idx"] <= p.touch_cluster), F.when(t["price"] > last(a)["price"], F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(t))).otherwise(a)).otherwise(F.concat(a, F.array(t))).cast(shape)
    x = x.withColumn("overshoots", one_of(F.size(F.filter("minors", lambda t: (at(t["idx"]) > 0) & (off(t) > tol))), lambda n: n <= p.wick_overshoots))
    x = x.withColumn("near", one_of(F.filter("minors", lambda t: (at(t["idx"]) > 0) & (F.abs(off(t)) <= tol)), lambda a: F.size(a) >= p.pair_touches))
    x = x.withColumn("hits", one_of(F.aggregate(F.col("near").cast(shape), F.array().cast(shape), cluster), lambda a: F.size(a) >= p.pair_touches))
    x = x.withColumns({"span": last(F.col("hits"))["idx"] - F.get("hits", F.lit(0))["idx"], "quiet": F.col("last") - last(F.col("hits"))["idx"], "close_now": last(F.col("closes"))["close"]})
    x = x.filter((F.col("span") >= p.anchor_span) & ~((F.col("quiet") > p.stale_months) & (F.col("close_now") < 0.8 * at(F.col("last")))))
    over = F.filter("closes", lambda c: (c["idx"] >= F.get("hits", F.lit(0))["idx"]) & ((at(c["idx"]) <= 0) | (c["close"] > at(c["idx"]) * (1 + p.break_tolerance_pct / 100))))
    x = x.withColumn("over", one_of(over, lambda a: ~F.exists(a, lambda c: c["idx"] < F.col("last") - p.tolerated_tail + 1)))
    score = (
        0.40 * F.least(F.size("hits"), F.lit(5)) / 5 + 0.25 * F.least(F.col("span") / 120, F.lit(1.0)) + 0.20 * clamp01(1 - F.abs("slope_pct") / 15) + 0.15 * clamp01(1 - F.col("quiet") / 60)
        - 0.10 * F.col("overshoots") - 0.05 * F.size("over")
    )
    x = x.select("symbol", F.col("one.idx").alias("a"), "b", F.size("hits").alias("touches"), "overshoots", F.size("over").alias("violations"), "slope_pct", score.alias("score"), "span")
    # of lines alike in all three the pair that comes first
    best = F.max_by(F.struct("a", "b", "touches", "overshoots", "violations", "slope_pct", "score"), F.struct(F.round("score", 9).alias("score"), "span", "touches", -F.col("a"), -F.col("b")))
    return x.groupBy("symbol").agg(best.alias("best")).select("symbol", "best.*")


def line_at(idx: Column) -> Column:
    return F.col("price_a") + F.col("slope") * (idx - F.col("a"))


def swings(bars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Pivots with their prominence in percent: the drop to the higher of the two sides' lows, each up to the next bar that is higher, or pivot that is as high."""
    tops = pivots(bars, p.pivot_left, p.pivot_right).select("symbol", "idx", "bar_date", "high")
    at = F.col("b.idx")
    marks = bars.select("symbol", "idx", "high", "low").join(tops.select("symbol", "idx", F.lit(True).alias("top")), ["symbol", "idx"], "left")
    pairs = tops.alias("t").join(marks.alias("b"), (F.col("t.symbol") == F.col("b.symbol")) & (F.col("t.idx") != at))
    blocks = (F.col("b.high") > F.col("t.high")) | (F.col("b.top") & (F.col("b.high") >= F.col("t.high") * (1 - p.equal_tolerance_pct / 100)))
    walls = pairs.groupBy("t.symbol", "t.idx", "t.bar_date", "t.high").agg(F.max(F.when(blocks & (at < F.col("t.idx")), at)).alias("wall_left"), F.min(F.when(blocks & (at > F.col("t.idx")), at)).alias("wall_right"))
    inside = walls.alias("w").join(bars.select("symbol", F.col("idx").alias("at"), "low").alias("b"), "symbol")
    left = F.when((F.col("at") < F.col("idx")) & (F.col("at") > F.coalesce("wall_left", F.lit(-1))), F.col("low"))
    right = F.when((F.col("at") > F.col("idx")) & (F.col("at") < F.coalesce("wall_right", F.lit(2**31 - 1))), F.col("low"))
    base = inside.groupBy("symbol", "idx", "bar_date", "high").agg(F.min(left).alias("low_left"), F.min(right).alias("low_right"))
    floor = F.greatest("low_left", "low_right")
    return base.select("symbol", "idx", "bar_date", F.col("high").alias("price"), F.coalesce((F.col("high") - floor) / F.col("high") * 100, F.lit(0.0)).alias("prominence_pct"))


_POINTS = "array<struct<idx:int,price:double,prominence_pct:double>>"


def separated(points: DataFrame, least_pct: float, gap: int) -> DataFrame:
    """The most prominent points that lie at least gap apart, chosen greedily: a fold over a symbol's few points."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("prominence_pct")).alias("o"), "idx", "price", "prominence_pct")))
    per = points.filter(F.col("prominence_pct") >= least_pct).groupBy("symbol").agg(ordered.alias("all"))
    point = lambda x: F.struct(x["idx"].alias("idx"), x["price"].alias("price"), x["prominence_pct"].alias("prominence_pct"))
    kept = F.aggregate("all", F.array().cast(_POINTS), lambda a, x: F.when(F.exists(a, lambda k: F.abs(k["idx"] - x["idx"]) < gap), a).otherwise(F.concat(a, F.array(point(x)))))
    return per.select("symbol", F.explode(kept).alias("p")).select("symbol", "p.*")


def zones(points: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Price zones: the highest point left seeds one and takes all left within the tolerance of its price. One row for each zone."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("price")).alias("o"), "idx", "price")))
    per = points.groupBy("symbol").agg(ordered.alias("all"))
    within = F.lit(1 - p.zone_similarity_pct / 100)
    # prices fall, so a zone is a run: it ends where the price leaves the seed's tolerance
    state = "array<struct<seed:double,idx:int,price:double>>"

    def step(a, x):
        seed = F.try_element_at(a, F.lit(-1))["seed"]
        own = F.when(seed.isNotNull() & (x["price"] >= seed * within), seed).otherwise(x["price"])
        return F.concat(a, F.array(F.struct(own.alias("seed"), x["idx"].alias("idx"), x["price"].alias("price")))).cast(state)

    rows = per.select("symbol", F.explode(F.aggregate("all", F.array().cast(state), step)).alias("m")).select("symbol", "m.*")
    z = rows.groupBy("symbol", "seed").agg(F.avg("price").alias("level"), F.count("*").alias("members"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))
    reject = F.when(F.col("members") < 2, "too_few_members").when(F.col("last_idx") - F.col("first_idx") < p.zone_separation, "too_short").when(F.col("level") <= 0, "no_level")
    order = [F.desc("last_idx"), F.desc("members"), F.desc(F.col("last_idx") - F.col("first_idx")), F.col("first_idx")]
    z = z.withColumn("reject_reason", reject)
    rank = F.row_number().over(Window.partitionBy("symbol", F.col("reject_reason").isNull()).orderBy(*order))
    return z.withColumn("rank", F.when(F.col("reject_reason").isNull(), rank))


def escape_band(quarters: DataFrame, lid: str = "lid", p: Params = DEFAULT) -> DataFrame:
    """Half the mean true range of eight quarters in percent of the lid, between the least and the largest band."""
    w = Window.partitionBy("symbol").orderBy("q_idx")
    before = F.lag("close").over(w)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    mean = F.avg("true_range").over(w.rowsBetween(1 - p.band_quarters, 0))
    band = F.greatest(F.lit(p.band_min_pct), F.least(F.lit(p.band_max_pct), mean / F.col(lid) * 100 * p.band_fraction))
    return quarters.withColumn("true_range", true_range).withColumn("band_pct", band)
