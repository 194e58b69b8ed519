"""The anatomy of a chart's pattern: what its base, congestion and compression look like, and whether it can be acted on.

Shape and actionability are kept apart: a pattern that is old or whose price is far from its lid can
still have a good shape. Everything is expressions over the row of arrays that lids.measured() gives,
so that no join and no shuffle is added to the analysis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewatch.functions.scalars import clamp01
from basewatch.operators.gold import direction, prior_trend
from basewatch.operators.lids import _efficiency, _log_r2
from basewatch.params import DEFAULT, Params

#: Months of the trend before, the tolerance of a close under its lid, what counts as congested and as contracted.
PRIOR_MONTHS, UNDER_PCT, CONGESTED, CONTRACTED = 60, 2.5, 0.70, 0.80
ACTIONS = {"forming": "watch", "pre_breakout": "ready", "breaking_out": "breakout_now", "post_breakout": "historical_or_late"}


def _median(values: Column) -> Column:
    n, ordered = F.size(values), F.array_sort(values)
    middle = lambda i: F.get(ordered, F.floor(i).cast("int"))
    return F.when(n > 0, (middle((n - 1) / 2) + middle(n / 2)) / 2)


def anatomy(x: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """lids.measured() -> one row a symbol with structs: maturity, boundary, prior_trend, base, congestion, compression, breakout, actionability; all but the first and last null where no lid is recognised."""
    line = lambda i: F.col("p0") + F.col("per_month") * (i - F.col("m0"))
    escape = F.when(F.col("state") != "sealed", F.get("quarters", F.col("escape_q")))
    same_month = lambda m: (F.year(m["bar_date"]) == F.year(escape["bar_date"])) & (F.month(m["bar_date"]) == F.month(escape["bar_date"]))
    x = x.withColumn("escape_month", F.get(F.filter("months", same_month), F.lit(0))["idx"])
    x = x.withColumn("base_end", F.greatest(F.col("m0"), F.coalesce(F.col("escape_month") - 1, F.col("n") - 1)))
    months = lambda a, b: F.slice("months", a + 1, F.greatest(b - a + 1, F.lit(0)))
    x = x.withColumns({"base_bars": months(F.col("m0"), F.col("base_end")), "prior_from": F.greatest(F.col("m0") - PRIOR_MONTHS, F.lit(0)), "own_dips": F.filter("dips", lambda d: d["idx"] <= F.col("base_end"))})
    x = x.withColumn("prior_bars", months(F.col("prior_from"), F.col("m0")))
    closes = lambda bars: F.transform(bars, lambda b: b["close"])
    n = F.size("base_bars")
    under = F.size(F.filter("base_bars", lambda b: (line(b["idx"]) > 0) & (b["close"] <= line(b["idx"]) * (1 + UNDER_PCT / 100))))
    signs = F.filter(F.transform(F.slice("base_bars", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda b, i: F.sign(b["close"] - F.get("base_bars", i)["close"])), lambda s: s != 0)
    x = x.withColumns({"efficiency": _efficiency(closes(F.col("base_bars"))), "time_under": F.coalesce(under / F.nullif(n, F.lit(0)), F.lit(0.0)), "signs": signs, "cycles": F.size("own_dips"), "own_depths": F.transform("own_dips", lambda d: d["depth"])})
    turns = F.size(F.filter(F.transform("signs", lambda s, i: F.when(i > 0, s != F.get("signs", i - 1)).otherwise(False)), lambda t: t))
    congestion = clamp01(0.40 * (1 - F.col("efficiency")) + 0.35 * clamp01(F.col("cycles") / 3) + 0.25 * F.col("time_under"))
    first, last = F.get("own_depths", F.lit(0)), F.try_element_at("own_depths", F.lit(-1))
    improved = F.when((F.col("cycles") >= 2) & (first > 0), clamp01((first - last) / F.nullif(first, F.lit(0.0)))).when((F.col("cycles") == 1) & F.col("depth_rule"), 0.25).otherwise(0.0)
    ranges = F.transform(F.filter("base_bars", lambda b: b["close"] > 0), lambda b: (b["high"] - b["low"]) / b["close"] * 100)
    x = x.withColumns({"turns": turns, "congestion_score": congestion, "improved": improved, "ranges": ranges})
    third = F.greatest(F.lit(1), F.floor(F.size("ranges") / 3)).cast("int")
    early, late = _median(F.slice("ranges", F.lit(1), third)), _median(F.slice(F.reverse("ranges"), F.lit(1), third))
    x = x.withColumn("contraction", F.when(early > 0, late / F.nullif(early, F.lit(0.0))))
    compression = clamp01(0.50 * F.col("improved") + 0.30 * F.coalesce(clamp01(1 - F.col("contraction")), F.lit(0.0)) + 0.20 * F.col("converging").cast("double"))
    pressed_in = ((F.col("cycles") >= 2) & F.col("depth_rule")) | (F.coalesce(F.col("contraction") <= CONTRACTED, F.lit(False)) & F.col("converging"))
    start, end = F.get("prior_bars", F.lit(0)), F.try_element_at("prior_bars", F.lit(-1))
    stretch = F.col("m0") - F.col("prior_from")
    annual = F.when((stretch > 0) & (start["close"] > 0) & (end["close"] > 0), (F.pow(end["close"] / start["close"], 12 / F.nullif(stretch, F.lit(0))) - 1) * 100)
    quality = clamp01(F.coalesce("score", F.lit(0.0)))
    x = x.withColumns({"compression_score": compression, "annual": annual, "quality": quality})
    duration = clamp01((F.col("base_end") - F.col("m0")) / 120)
    score = 100 * (0.30 * F.col("quality") + 0.30 * F.col("congestion_score") + 0.25 * F.col("compression_score") + 0.15 * duration)
    signal = F.coalesce(F.create_map(*[F.lit(v) for pair in ACTIONS.items() for v in pair])[F.col("lifecycle")], F.lit("none"))
    raw = 100 * (0.45 * clamp01((F.col("proximity_pct") - 60) / 40) + 0.30 * F.col("compression_score") + 0.25 * F.col("quality"))
    at = F.col("lifecycle")
    strength = F.when(at == "breaking_out", F.greatest(F.lit(70.0), raw)).when(at == "post_breakout", F.least(F.lit(35.0), raw)).when(at == "forming", F.least(F.lit(55.0), raw)).otherwise(raw)
    in_percent = lambda v: F.round(clamp01(v / 100) * 100, 1)
    old, has = F.col("mature"), F.col("has")
    years = F.round(F.size(F.array_distinct(F.transform("months", lambda b: F.trunc(b["bar_date"], "MM")))) / 12.0, 2)
    why = F.when(F.col("depth_rule"), "compression measured from pullback/range evidence").when(F.col("pressed"), "proximity override supplies readiness, not compression evidence").otherwise("compression evidence is incomplete")
    young = F.format_string(f"observable history %.2fy is below the {p.min_years:.2f}y method minimum", years)
    reasons = F.array_compact(F.array(F.concat(F.lit("lifecycle="), at), F.concat(F.lit("price_position="), F.col("price_position")), why, F.when(~old, young)))
    shown = lambda c: F.when(has, c)
    date = lambda i: F.get("months", i)["bar_date"]
    top = lambda name, of: of(F.transform("base_bars", lambda b: b[name]))
    boundary = F.struct(
        "family", direction(F.col("lid_slope_pct")).alias("direction"), F.round("lid_slope_pct", 2).alias("slope_pct_per_year"), F.round(F.col("quality") * 100, 1).alias("score"), F.round("fit_error_pct", 3).alias("fit_error_pct"),
        F.transform("anchors", lambda t: date(t["month"])).alias("anchors"), F.transform("hits", lambda t: date(t["idx"])).alias("touches"),
    )
    prior = F.struct(start["bar_date"].alias("start"), end["bar_date"].alias("end"), prior_trend(F.col("annual")).alias("direction"), F.round("annual", 2).alias("annualized_return_pct"), F.round(_log_r2(closes(F.col("prior_bars"))), 3).alias("log_trend_r2"))
    base = F.struct(date(F.col("m0")).alias("start"), date(F.col("base_end")).alias("end"), F.round((F.col("base_end") - F.col("m0")) / 12, 2).alias("duration_years"), F.round(top("high", F.array_max), 4).alias("high"), F.round(top("low", F.array_min), 4).alias("low"), F.round("base_r2", 3).alias("log_trend_r2"))
    congested = F.struct(((F.col("cycles") >= 2) & (F.col("efficiency") <= CONGESTED)).alias("present"), F.round(F.col("congestion_score") * 100, 1).alias("score"), F.col("cycles").alias("cycle_count"), F.col("turns").alias("direction_change_count"), F.round("efficiency", 3).alias("directional_efficiency"), F.round(F.col("time_under") * 100, 1).alias("time_under_boundary_pct"))
    pressed = F.struct(
        pressed_in.alias("present"), F.col("compressed").alias("passes_current_gate"), (F.col("pressed") & ~F.col("depth_rule")).alias("qualified_by_proximity_override"), F.round(F.col("compression_score") * 100, 1).alias("score"), F.col("own_depths").alias("pullback_depths_pct"),
        F.round("depth_ratio", 3).alias("last_depth_ratio"), F.round("contraction", 3).alias("range_contraction_ratio"), F.col("converging").alias("support_converging"), F.round("volume_ratio", 3).alias("volume_contraction_ratio"),
    )
    escaped = F.struct("state", escape["bar_date"].alias("first_escape"), F.when(F.col("state") == "broken_out", F.get("quarters", F.col("confirmed_q"))["bar_date"]).alias("confirmed"), F.when(F.col("state") == "broken_out", F.col("via")).alias("via"), F.get("quarters", F.col("retest_q"))["bar_date"].alias("retest"), "retest_holds", F.coalesce("failed", F.lit(0)).alias("failed_breakouts"), F.coalesce("band_violations", F.lit(0).cast("long")).alias("band_violations"), F.coalesce(F.col("over") & (F.col("state") == "sealed"), F.lit(False)).alias("provisional_escape"))
    acts = F.struct(
        F.when(~has, "none").when(old, signal).otherwise("ineligible_history").alias("state"), F.when(has & old, in_percent(strength)).otherwise(0.0).alias("score"), (has & old).alias("eligible"), shown(signal).alias("signal_state"), shown(in_percent(strength)).alias("signal_score"),
        F.when(has, reasons).otherwise(F.array(F.lit("no qualified boundary"))).alias("reasons"),
    )
    lows = F.transform("dips", lambda d: date(d["idx"]))
    return x.select(
        "symbol", has.alias("recognized"), F.when(has, F.round(score, 1)).otherwise(0.0).alias("shape_score"), F.struct(years.alias("observable_history_years"), F.lit(float(p.min_years)).alias("minimum_observable_history_years"), old.alias("passes")).alias("maturity"),
        shown(boundary).alias("boundary"), shown(prior).alias("prior_trend"), shown(base).alias("base"), shown(congested).alias("congestion"), shown(pressed).alias("compression"), shown(escaped).alias("breakout"), acts.alias("actionability"), "lifecycle", shown(lows).alias("pullback_lows"),
    )


def phases(found: DataFrame) -> DataFrame:
    """anatomy() -> episode, kind, present, start, end: the phases that gold.phase_metrics() compares. Only a base has days of its own."""
    kinds = [("base", F.col("base").isNotNull(), F.col("base.start"), F.col("base.end"))] + [(k, F.coalesce(F.col(f"{k}.present"), F.lit(False)), F.lit(None).cast("date"), F.lit(None).cast("date")) for k in ("congestion", "compression")]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), present.alias("present"), start.alias("start"), end.alias("end")) for k, present, start, end in kinds])
    return found.select(F.col("symbol").alias("episode"), F.explode(rows).alias("x")).select("episode", "x.*")


def bottoms(found: DataFrame) -> DataFrame:
    """anatomy() -> episode, day: the lows of pullbacks, which structures.bottom_metrics() compares."""
    return found.select(F.col("symbol").alias("episode"), F.explode("pullback_lows").alias("day"))


def states(found: DataFrame) -> DataFrame:
    """anatomy() -> symbol and the columns that corpus.predicted_classes() reads."""
    return found.select("symbol", F.col("actionability.state").alias("state"), F.col("actionability.eligible").alias("eligible"), F.lit(None).cast("boolean").alias("abstained"), "recognized", F.col("maturity.passes").alias("mature"))
