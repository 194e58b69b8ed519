"""Queries that run a stream to the end of what is there, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewatch.plans.registry import registry
from basewatch.sources.tables import DILATED_SQL, dilated_bars, folder
from basewatch.streaming import breakouts, corrections

query, QUERIES, SQL = registry()


def _delivered(bars: DataFrame, into: str) -> None:
    """Ten years of bars a delivery, the second one first, and at the end word that time has passed."""
    bars = bars.select("symbol", "bar_date", "high", "low", "close")
    decade = F.floor((F.year("bar_date") - 1985) / 10)
    for n, k in enumerate((1, 0)):
        bars.filter(decade == k).write.parquet(f"{into}/{n}")
    bars.filter(decade >= 2).write.parquet(f"{into}/2")
    bars.agg(F.add_months(F.max("bar_date"), 600).alias("bar_date")).select(F.lit("").alias("symbol"), "bar_date", *[F.lit(None).cast("double").alias(c) for c in ("high", "low", "close")]).write.parquet(f"{into}/3")


@query("stream_breakout_states")
def _(spark: SparkSession, d: str):
    into = folder(spark, "deliveries")
    _delivered(dilated_bars(spark, d), into)
    stream = spark.readStream.schema(breakouts.BARS).parquet(f"{into}/*")
    return breakouts.drain(stream, folder(spark, "breakouts"), delay="240 months")


def _versions(bars: DataFrame) -> list[DataFrame]:
    """Deliveries as they may come in: wrong closes and missing months, their corrections, late months, and a bar taken back."""
    m, y = F.month("bar_date"), F.year("bar_date")
    v, late = bars.select("symbol", "bar_date", "open", "high", "low", "close", "volume"), (F.month("bar_date") == 5) & (F.year("bar_date") % 4 == 1)
    first = v.filter(~late).withColumns({"close": F.when(m == 8, F.col("low")).otherwise(F.col("close")), "version": F.lit(1)})
    last = v.filter(late).withColumn("version", F.lit(1)).unionByName(v.filter((m == 2) & (y == 1999)).withColumns({"high": F.lit(-1.0), "version": F.lit(7)}))
    return [v.filter(m == 8).withColumn("version", F.lit(2)), first, last]


def _corrected(spark: SparkSession, d: str) -> corrections.Store:
    into, store = folder(spark, "deliveries"), folder(spark, "corrections")
    stream = spark.readStream.schema(corrections.BARS).parquet(f"{into}/*")
    for n, part in enumerate(_versions(dilated_bars(spark, d))):
        part.write.parquet(f"{into}/{n}")
        held = corrections.drain(stream, store)
    return held


@query("stream_corrected_quarters", f"""WITH {DILATED_SQL}, v AS (SELECT symbol, bar_date, open, high, low, CASE WHEN month(bar_date) = 8 THEN low ELSE close END AS close, volume, 1 AS version FROM bars WHERE NOT (month(bar_date) = 5 AND year(bar_date) % 4 = 1)
   UNION ALL SELECT symbol, bar_date, open, high, low, close, volume, 2 FROM bars WHERE month(bar_date) = 8 UNION ALL SELECT symbol, bar_date, open, high, low, close, volume, 1 FROM bars WHERE month(bar_date) = 5 AND year(bar_date) % 4 = 1
   UNION ALL SELECT symbol, bar_date, open, -1, low, close, volume, 7 FROM bars WHERE month(bar_date) = 2 AND year(bar_date) = 1999),
 s AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY symbol, bar_date ORDER BY version DESC) = 1)
 SELECT symbol, year(bar_date) AS year, quarter(bar_date) AS qtr, arg_min(open, bar_date) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_date) AS close, max(bar_date) AS bar_date, sum(volume) AS volume
 FROM s WHERE high > 0 AND low > 0 AND close > 0 GROUP BY ALL HAVING count(*) = 3""")
def _(spark, d):
    return corrections.corrected_quarters(_corrected(spark, d))


@query("stream_corrected_states")
def _(spark, d):
    return corrections.corrected_states(_corrected(spark, d))
