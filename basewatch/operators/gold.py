"""Human labels: their quarters and geometry, and how far an analysis agrees with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PHASES = ("base", "congestion", "compression")
EVENTS = ("breakout", "failed_breakout", "retest", "continuation", "invalidation")
CLASSES = ("shape", "maturity", "lifecycle", "readiness", "action")


def _so(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def quarter_ordinal(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day) - 1


def checked_quarters(months: DataFrame) -> DataFrame:
    """months(symbol, bar_date) up to the cutoff -> each calendar quarter with its place, whether it counts, and its fault.

    A quarter counts with one bar for each of its three months. A fragment at the start is left out
    without a fault; any later one is a fault, and so is a step of more than one quarter."""
    q = months.groupBy("symbol", F.year("bar_date").alias("year"), F.quarter("bar_date").alias("qtr")).agg(F.count("*").alias("n"), F.count_distinct(F.month("bar_date")).alias("distinct"), F.max("bar_date").alias("bar_date"))
    w = Window.partitionBy("symbol").orderBy("year", "qtr")
    q = q.withColumns({"place": F.row_number().over(w) - 1, "last": F.max("bar_date").over(Window.partitionBy("symbol")), "whole": (F.col("n") == 3) & (F.col("distinct") == 3), "ordinal": F.col("year") * 4 + F.col("qtr") - 1})
    leading = (F.col("place") == 0) & ~F.col("whole") & ~((F.col("year") == F.year("last")) & (F.col("qtr") == F.quarter("last")))
    q = q.withColumn("leading", leading).withColumns({"prior": F.lag(F.when(~F.col("leading"), F.col("ordinal"))).over(w)})
    fault = F.when(~F.col("leading") & ~F.col("whole"), "incomplete_quarter").when(F.col("ordinal") != F.col("prior") + 1, "gap")
    return q.select("symbol", "year", "qtr", "place", "last", "leading", "bar_date", fault.alias("fault"))


def quarter_verdicts(months: DataFrame) -> DataFrame:
    """One row a symbol: how many quarters count, and the first fault, an unfinished cutoff before all others. A symbol with a fault has no geometry."""
    g = checked_quarters(months).groupBy("symbol").agg(F.count_if(~F.col("leading")).alias("quarters"), F.max("last").alias("cutoff"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("place"))).alias("first"))
    return g.select("symbol", "quarters", F.when(F.month("cutoff") % 3 != 0, "open_cutoff").otherwise(F.col("first")).alias("fault"))


def direction(slope_pct: Column) -> Column:
    return F.when(slope_pct > 0.5, "rising").when(slope_pct < -0.5, "falling").when(slope_pct.isNotNull(), "flat")


def prior_trend(annual_pct: Column) -> Column:
    return F.when(annual_pct.isNull(), "insufficient_history").when(annual_pct > 2, "up").when(annual_pct < -2, "down").otherwise("flat")


def fitted_lines(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """anchors(keys, idx, price, projected_idx), the clicks of a structure -> its least-squares line at the cutoff.

    Anchors on one candle only, or a line that isn't positive at the cutoff, give a fault and no line.
    The error is the mean of the anchors' distances from the line as shares of their prices."""
    g = anchors.groupBy(*keys).agg(F.regr_slope("price", "idx").alias("slope"), F.regr_intercept("price", "idx").alias("intercept"), F.max("projected_idx").alias("projected_idx"), F.collect_list(F.struct("idx", "price")).alias("points"), F.count_distinct("idx").alias("candles"))
    at = F.col("intercept") + F.col("slope") * F.col("projected_idx")
    off = F.aggregate("points", F.lit(0.0), lambda total, x: total + F.abs(x["price"] - (F.col("intercept") + F.col("slope") * x["idx"])) / F.greatest(x["price"], F.lit(1e-12)))
    fault = F.when(F.col("candles") < 2, "one_candle").when(at <= 0, "not_positive")
    g = g.withColumns({"fault": fault, "value_at_cutoff": at, "error": off / F.size("points") * 100}).withColumn("slope_pct", F.col("slope") * 400 / F.col("value_at_cutoff"))
    shown = lambda c, digits: F.when(F.col("fault").isNull(), F.round(c, digits))
    return g.select(*keys, "fault", shown("slope", 8).alias("slope_per_bar"), shown("intercept", 6).alias("intercept"), shown("value_at_cutoff", 6).alias("value_at_cutoff"), shown("slope_pct", 4).alias("slope_pct_per_year"), F.when(F.col("fault").isNull(), direction(F.col("slope_pct"))).alias("direction"), shown("error", 6).alias("fit_error_pct"))


def milestones(labels: DataFrame, phases: DataFrame, events: DataFrame) -> DataFrame:
    """labels(episode, active_id, recognition) with phases(episode, kind, present, structure_id, start) and events(episode, kind, action_signal, retest_state, structure_id, at) -> the days on which a label could first be recognised, watched and acted on.

    Only what belongs to the active structure, or to none, counts. To watch is the first compression;
    to act the first signal of a breakout, a continuation or a retest that held. Days out of order are a fault."""
    own = F.col("structure_id").isNull() | (F.col("structure_id") == F.col("active_id"))
    active = labels.select("episode", "active_id")
    acts = F.col("kind").isin("breakout", "continuation") | ((F.col("kind") == "retest") & F.col("retest_state").isin("shallow", "deep"))
    watch = phases.join(active, "episode").filter(own & F.col("present") & (F.col("kind") == "compression")).groupBy("episode").agg(F.min("start").alias("watch"))
    act = events.join(active, "episode").filter(own & F.col("action_signal") & acts).groupBy("episode").agg(F.min("at").alias("action"))
    x = labels.select("episode", F.when(F.col("active_id").isNotNull(), F.col("recognition")).alias("recognizable")).join(watch, "episode", "left").join(act, "episode", "left")
    late = (F.col("recognizable") > F.col("watch")) | (F.col("watch") > F.col("action")) | (F.col("recognizable") > F.col("action"))
    return x.withColumn("fault", F.when(late, "not_chronological"))


def phase_metrics(expected: DataFrame, predicted: DataFrame, tolerance: int = 1) -> DataFrame:
    """expected(episode, kind, present, start, end), any number of phases, against predicted(episode, kind, present, start, end), at most one: presence and timing in quarters."""
    e = expected.filter("present").groupBy("episode", "kind").agg(F.min("start").alias("e_start"), F.max("end").alias("e_end"), F.lit(True).alias("e"))
    p = predicted.select("episode", "kind", F.col("present").alias("p"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    x = e.join(p, ["episode", "kind"], "full_outer")
    gap = lambda a, b: F.abs(quarter_ordinal(F.col(a)) - quarter_ordinal(F.col(b)))
    x = x.withColumns({"start_error": gap("e_start", "p_start"), "end_error": gap("e_end", "p_end")})
    here, there = _so(F.col("e")), _so(F.col("p"))
    return x.select("episode", "kind", here.alias("expected_present"), there.alias("predicted_present"), (here == there).alias("presence_correct"), "start_error", "end_error", ((F.col("start_error") <= tolerance) & (F.col("end_error") <= tolerance)).alias("timing_correct"))


def event_states(events: DataFrame, predicted: DataFrame) -> DataFrame:
    """events(episode, kind, at, nth, retest_state, volume_label) against predicted(episode, retest_state, holds, volume): the last retest's state and the last volume label.

    A prediction that only says that a retest holds isn't precise enough to be supported."""
    known = F.col("volume_label").isNotNull() & (F.col("volume_label") != "unavailable")
    last = lambda value, test: F.max_by(value, F.when(test, F.struct("at", "nth")))
    e = events.groupBy("episode").agg(last("retest_state", F.col("kind") == "retest").alias("retest_expected"), last("volume_label", known).alias("volume_expected"))
    guess = F.coalesce("retest_state", F.when(~F.col("holds"), "failed").when(F.col("holds"), "holding_unspecified"))
    x = e.join(predicted.select("episode", guess.alias("retest_predicted"), F.col("volume").alias("volume_predicted")), "episode", "left")
    right = lambda n: F.when(F.col(f"{n}_expected").isNotNull(), F.col(f"{n}_expected").eqNullSafe(F.col(f"{n}_predicted"))).alias(f"{n}_correct")
    return x.select("*", right("retest"), right("volume"), _so(F.col("retest_predicted") != "holding_unspecified").alias("retest_supported"), F.col("volume_predicted").isNotNull().alias("volume_supported"))


def excluded_highs(excluded: DataFrame, selected: DataFrame) -> DataFrame:
    """excluded(episode, day) and selected(episode, day), highs that a reviewer ruled out and those that the lid rests on: how many of them fall into one quarter.

    Of several in a quarter as many count as there are on the side with fewer."""
    n = lambda df, name: df.distinct().groupBy("episode", quarter_ordinal(F.col("day")).alias("q")).agg(F.count("*").alias(name))
    both = n(excluded, "e").join(n(selected, "s"), ["episode", "q"], "left")
    hit = F.when(F.col("s").isNull(), 0).otherwise(F.least("e", "s"))
    g = both.groupBy("episode").agg(F.sum("e").alias("expected_count"), F.sum(hit).alias("incorrectly_selected"))
    return g.withColumn("rejected", F.col("expected_count") - F.col("incorrectly_selected"))


def edge_counts(expected: DataFrame, predicted: DataFrame, pairs: DataFrame) -> DataFrame:
    """Parent and child edges: expected(episode, id, parent), predicted likewise, pairs(episode, predicted_id, expected_id) -> tp, fp and fn by episode.

    A predicted edge is an expected one if both of its ends are paired with that one's ends."""
    e = expected.select("episode", "parent", "id").distinct()
    end = lambda side: pairs.select("episode", F.col("predicted_id").alias(side), F.col("expected_id").alias(f"e_{side}"))
    p = predicted.select("episode", "parent", "id").distinct().join(end("parent"), ["episode", "parent"], "left").join(end("id"), ["episode", "id"], "left")
    name = lambda side: F.coalesce(F.col(f"e_{side}").cast("string"), F.concat(F.lit("unmatched:"), F.col(side).cast("string")))
    p = p.select("episode", name("parent").alias("parent"), name("id").alias("id")).distinct().withColumn("p", F.lit(True))
    e = e.select("episode", F.col("parent").cast("string").alias("parent"), F.col("id").cast("string").alias("id"), F.lit(True).alias("e"))
    both = e.join(p, ["episode", "parent", "id"], "full_outer")
    return both.groupBy("episode").agg(F.count_if(_so(F.col("e") & F.col("p"))).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def intervention_checks(episodes: DataFrame) -> DataFrame:
    """One row an episode -> one row for each of its 31 named checks: applicable, supported, passed, included, and whether a person has to step in.

    Columns: a boolean or null for each check, named like it with underscores for dots; top_complete,
    top_supported, active_known, expects_undercut, expects_outlier, expects_<phase>, timed_<phase>,
    expects_retest_state, expects_relative_volume_confirmation and the same with knows_."""
    c, yes = F.col, F.lit(True)
    top, active = _so(c("top_supported")), _so(c("active_known"))
    # name, applicable, supported, included, judged: whether `passed` says anything
    rows = [(f"classification.{x}", yes, yes, yes, yes) for x in CLASSES]
    rows += [("general_top_detection", _so(c("top_complete")), top, top, top), ("selected_top_membership_proxy", _so(c("top_complete")), yes, yes, yes)]
    rows += [(x, yes, yes, yes, yes) for x in ("construction_anchors", "supporting_touches", "excluded_highs", "structure.geometry", "structure.primary_selection", "structure.alternate_selection", "structure.parent_child_topology")]
    rows += [("structure.active_boundary", active, yes, yes, active), ("bottom.major_bottom", yes, yes, yes, yes)]
    rows += [(f"bottom.{x}", _so(c(f"expects_{x}")), ~yes, ~yes, ~yes) for x in ("undercut", "outlier")]
    for x in PHASES:
        due = _so(c(f"expects_{x}"))
        rows += [(f"phase.{x}.presence", yes, yes, yes, yes), (f"phase.{x}.timing", due, _so(c(f"timed_{x}")), yes, due)]
    rows += [(f"event.{x}.timing", yes, yes, yes, yes) for x in EVENTS]
    rows += [(f"event.{x}", _so(c(f"expects_{x}")), _so(c(f"knows_{x}")), yes, _so(c(f"expects_{x}"))) for x in ("retest_state", "relative_volume_confirmation")]
    cell = [F.struct(F.lit(n).alias("name"), a.alias("applicable"), s.alias("supported"), F.when(j, c(n.replace(".", "_"))).alias("passed"), i.alias("included")) for n, a, s, i, j in rows]
    x = episodes.select("episode", F.explode(F.array(*cell)).alias("k")).select("episode", "k.*")
    return x.withColumn("requires_intervention", F.col("applicable") & F.col("included") & ~_so(F.col("passed")))
