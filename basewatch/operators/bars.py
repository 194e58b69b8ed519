"""Cleaning, merging and resampling of bars; checks of their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_time():
    return Window.partitionBy("symbol").orderBy("bar_date")


def clean(bars: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Rows with a date and positive high, low and close, up to as_of (inclusive), numbered by date. The cut goes below the numbering."""
    ok = F.col("bar_date").isNotNull() & (F.col("high") > 0) & (F.col("low") > 0) & (F.col("close") > 0)
    kept = bars.filter(ok if as_of is None else ok & (F.col("bar_date") <= as_of))
    return kept.withColumn("idx", F.row_number().over(by_time()) - 1)


def quarterly(bars: DataFrame) -> DataFrame:
    """Calendar quarters of numbered bars: the high's first month is kept, volume only if all three months are known."""
    q = bars.withColumns({"year": F.year("bar_date"), "qtr": F.quarter("bar_date")})
    out = q.groupBy("symbol", "year", "qtr").agg(
        F.min_by(F.coalesce("open", "close"), "idx").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "idx").alias("close"),
        F.max("bar_date").alias("bar_date"), (-F.max(F.struct("high", (-F.col("idx")).alias("back")))["back"]).alias("high_src_idx"), F.max("idx").alias("close_src_idx"),
        F.max(F.month("bar_date")).alias("last_month"),
        F.when((F.count_distinct(F.month("bar_date")) == 3) & (F.count("volume") == F.count("*")), F.sum("volume")).alias("volume"),
    )
    return out.withColumn("q_idx", F.row_number().over(Window.partitionBy("symbol").orderBy("year", "qtr")) - 1)


def completed(quarters: DataFrame, as_of: Column) -> DataFrame:
    """Without a trailing quarter whose last month isn't a quarter's last, or isn't over by as_of. Gaps inside stay."""
    closed = (F.col("last_month") % 3 == 0) & (F.last_day("bar_date") <= as_of)
    last = F.max("q_idx").over(Window.partitionBy("symbol"))
    return quarters.withColumn("last_q", last).filter((F.col("q_idx") < F.col("last_q")) | closed).drop("last_q")


def merged(cached: DataFrame, live: DataFrame) -> DataFrame:
    """One bar for each calendar month; the live one wins, and of several the latest."""
    both = cached.withColumn("live", F.lit(0)).unionByName(live.withColumn("live", F.lit(1)))
    w = Window.partitionBy("symbol", F.trunc("bar_date", "MM")).orderBy(F.desc("live"), F.desc("bar_date"))
    one = both.withColumn("nth", F.row_number().over(w)).filter("nth = 1")
    return one.withColumn("bar_date", F.to_date(F.trunc("bar_date", "MM"))).drop("nth", "live")


def issues(bars: DataFrame) -> DataFrame:
    """One row for each bar and issue that quarantines it; bars are never repaired. bars may have nulls and any order of dates within pos."""
    seen = Window.partitionBy("symbol").orderBy("pos")
    before = F.lag("bar_date").over(seen)
    same_date = F.row_number().over(Window.partitionBy("symbol", "bar_date").orderBy("pos"))
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    any_of = lambda test: F.coalesce(sum((F.coalesce(test(p), F.lit(False)).cast("int") for p in prices), F.lit(0)) > 0, F.lit(False))
    named = {
        "invalid_date": F.col("bar_date").isNull(),
        "duplicate_date": F.col("bar_date").isNotNull() & (same_date > 1),
        "non_chronological": F.col("bar_date") < before,
        "invalid_field": any_of(lambda p: p.isNull() | F.isnan(p)),
        "nonpositive": any_of(lambda p: p <= 0),
        "impossible_range": (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")),
        "invalid_volume": F.isnan("volume") | (F.col("volume") < 0),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in named.items()]))
    return bars.withColumn("found", found).select("symbol", "pos", F.explode("found").alias("issue"))


def heuristics(bars: DataFrame) -> DataFrame:
    """Extreme wicks (the longer one half the body reference and six times the median range of up to 24 bars before, at least 12) and fourfold jumps.

    In the order of pos, or by date where bars have no pos; ranges are in body references as well."""
    seen = Window.partitionBy("symbol").orderBy("pos" if "pos" in bars.columns else "bar_date")
    trail = seen.rowsBetween(-24, -1)
    body = F.nullif((F.abs("open") + F.abs("close")) / 2, F.lit(0.0))
    longer = F.greatest(F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low"), F.lit(0.0)) / body
    range_ = (F.col("high") - F.col("low")) / body
    before = F.lag("close").over(seen)
    rows = bars.withColumns({"body": body, "wick": longer, "range": F.when(range_ >= 0, range_), "before": F.when(before > 0, before)})
    rows = rows.withColumn("trail", F.sort_array(F.collect_list("range").over(trail)))
    n = F.size("trail")
    middle = (F.try_element_at("trail", F.floor((n + 1) / 2).cast("int")) + F.try_element_at("trail", F.floor((n + 2) / 2).cast("int"))) / 2
    wick = F.when(n >= 12, (F.col("wick") >= 0.5) & (F.col("wick") >= 6 * middle)).otherwise(False)
    ratio = F.greatest(F.col("body") / F.col("before"), F.col("before") / F.col("body"))
    return rows.select("symbol", "bar_date", F.coalesce(wick, F.lit(False)).alias("extreme_wick"), F.coalesce(ratio >= 4, F.lit(False)).alias("discontinuity"))


def data_quality(bars: DataFrame) -> DataFrame:
    """One row for each symbol. Bars may have a pos, the order in which they came; else they are in order of their dates."""
    flags = heuristics(bars).groupBy("symbol").agg(F.sum(F.col("extreme_wick").cast("long")).alias("wicks"), F.sum(F.col("discontinuity").cast("long")).alias("jumps"))
    numbered = bars if "pos" in bars.columns else bars.withColumn("pos", F.row_number().over(by_time()))
    hard = issues(numbered).groupBy("symbol").agg(F.count("*").alias("hard"))
    all_ = flags.join(hard, "symbol", "left").na.fill({"hard": 0})
    return all_.withColumn("status", F.when(F.col("hard") > 0, "quarantined").when(F.col("wicks") + F.col("jumps") > 0, "flagged_for_review").otherwise("clear_by_defined_checks"))
