"""The numeric screen: features, scores, order and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewatch.functions.scalars import clamp01
from basewatch.params import GRADES, LIFECYCLES

SPANS = (120, 60, 36, 24)


def features(bars: DataFrame) -> DataFrame:
    """One row for each symbol of at least 120 bars with a range: extremes of the last 10, 5, 3 and 2 years and what follows from them."""
    asc, desc = Window.partitionBy("symbol").orderBy("bar_date"), Window.partitionBy("symbol").orderBy(F.desc("bar_date"))
    roll = asc.rowsBetween(-11, 0)
    full = F.count("close").over(roll) == 12
    rows = bars.select("symbol", "bar_date", "high", "low", "close", F.row_number().over(desc).alias("back"), F.when(full, F.max("high").over(roll)).alias("top"), F.when(full, F.min("low").over(roll)).alias("bottom"))
    near = lambda n, c: F.when(F.col("back") <= n, F.col(c))
    x = -F.col("back").cast("double")
    aggs = [F.count("*").alias("n_bars"), F.max_by("close", "bar_date").alias("last_close")]
    aggs += [F.max(near(n, "high")).alias(f"high{n}") for n in SPANS] + [F.min(near(n, "low")).alias(f"low{n}") for n in SPANS]
    for c, name in (("top", "high"), ("bottom", "low")):
        y = near(60, c)
        aggs += [F.regr_slope(y, x).alias(f"raw_{name}"), F.stddev_pop(y).alias(f"sd_{name}")]
    aggs += [F.regr_r2(near(60, "close"), x).alias("raw_r2"), F.stddev_pop(near(60, "close")).alias("sd_close")]
    old = F.when(F.col("back") > 24, F.col("high"))
    aggs += [F.max(old).alias("old_high"), F.min(F.when(F.col("back") > 24, F.struct((-F.col("high")).alias("h"), "bar_date")))["bar_date"].alias("old_date"), F.max("bar_date").alias("last_date")]
    f = rows.groupBy("symbol").agg(*aggs)
    for n in SPANS:
        f = f.withColumn(f"range{n}", F.col(f"high{n}") - F.col(f"low{n}"))
    f = f.filter("n_bars >= 120 AND range120 > 0 AND range60 > 0")
    sim = F.col("old_high") / F.col("high120")
    months = (F.year("last_date") - F.year("old_date")) * 12 + F.month("last_date") - F.month("old_date")
    flat = lambda name: F.when(F.col(f"sd_{name}") > 0, F.col(f"raw_{name}") / F.col(f"sd_{name}")).otherwise(0.0)
    return f.select(
        "symbol", (F.col("n_bars") / 12.0).alias("age_years"), "last_close",
        ((F.col("last_close") - F.col("low120")) / F.col("range120")).alias("position"), ((F.col("high120") - F.col("last_close")) / F.col("high120")).alias("distance"),
        (F.col("range24") / F.col("range120")).alias("rr120"), (F.col("range24") / F.col("range60")).alias("rr60"), ((F.col("low36") - F.col("low120")) / F.col("low120")).alias("low_lift"),
        flat("high").alias("slope_high"), flat("low").alias("slope_low"), F.when(F.col("sd_close") > 0, F.col("raw_r2")).alias("trend_r2"),
        sim.alias("old_peak_similarity"), F.when(sim >= 0.8, months).otherwise(0).cast("int").alias("peak_age"),
    )


def _mean(*terms: Column) -> Column:
    return sum(terms[1:], terms[0]) / len(terms)


def scores(f: DataFrame) -> DataFrame:
    """The published formulas; a term that is null counts 0."""
    c = lambda x: F.coalesce(clamp01(x), F.lit(0.0))
    col = F.col
    squeeze = _mean(c((0.60 - col("rr120")) / 0.35), c((0.70 - col("rr60")) / 0.35))
    old_peak = _mean((col("old_peak_similarity") >= 0.8).cast("double"), c((col("peak_age") - 60) / 120.0), c((col("old_peak_similarity") - 0.80) / 0.20))
    anti = _mean(c((col("trend_r2") - 0.65) / 0.25), c((col("slope_high") - 0.04) / 0.05), c((col("rr120") - 0.65) / 0.25))
    long = _mean(c((col("age_years") - 10) / 15), c((col("position") - 0.70) / 0.25), squeeze, c(col("low_lift") / 1.5), old_peak)
    tight = _mean(c((0.15 - col("distance")) / 0.15), c((col("position") - 0.75) / 0.20), c((0.50 - col("rr120")) / 0.30), c((0.70 - col("rr60")) / 0.35))
    rising = _mean(c((col("slope_low") - 0.005) / 0.05), c((0.03 - F.abs("slope_high")) / 0.03), c((col("position") - 0.65) / 0.25), squeeze)
    f = f.withColumns({"score_long": long, "score_tight": tight, "score_ascending": rising, "score_anti": anti})
    return f.withColumn("score_total", clamp01(0.40 * col("score_long") + 0.35 * col("score_tight") + 0.25 * col("score_ascending") - 0.35 * col("score_anti")))


def screen_order() -> list[Column]:
    """Lifecycle first; grades only within pre_breakout; then score and ticker."""
    stage = F.coalesce(*[F.when(F.col("lifecycle") == name, i) for i, name in enumerate(LIFECYCLES)], F.lit(99))
    grade = F.coalesce(*[F.when(F.col("grade") == g, i) for i, g in enumerate(GRADES)], F.lit(3))
    return [stage, F.when(F.col("lifecycle") == "pre_breakout", grade).otherwise(0), F.desc("coil_score"), F.col("symbol")]


def bucket_counts(rows: DataFrame) -> DataFrame:
    """Rows of each lifecycle, zero where there is none."""
    names = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in LIFECYCLES])).alias("lifecycle"))
    counted = rows.groupBy("lifecycle").agg(F.count("*").alias("n"))
    return names.join(counted, "lifecycle", "left").select("lifecycle", F.coalesce("n", F.lit(0)).alias("n"))
