"""Bars and event-like rows from the given tables.

Prices are unit prices of shipped lines, by the supplier's nation. `monthly_bars` takes calendar
months; `dilated_bars` makes each week a month, so that the logic that asks for ten years of
months has enough of them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to such a folder, and read again: what several steps need is worked out once."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, day, price, quantity and a key that orders lines without ties."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").filter("l_quantity > 0")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rows.select(F.col("n_name").alias("symbol"), F.to_date("l_shipdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"), key.alias("key"))


def _bars(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol", "bar_date").agg(F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "key").alias("close"), F.sum("quantity").alias("volume"))


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(ticks(spark, sf_dir).withColumn("bar_date", F.to_date(F.trunc("day", "MM"))))


def dilated_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.floor(F.datediff("day", F.lit("1995-01-02").cast("date")) / 7).cast("int")
    return _bars(ticks(spark, sf_dir).withColumn("bar_date", F.add_months(F.lit("1985-01-01").cast("date"), week)))


#: DuckDB: the same as CTEs.
TICKS_SQL = """ticks AS (SELECT n_name AS symbol, l_shipdate::DATE AS day, l_extendedprice / l_quantity AS price, l_quantity AS quantity,
  row_number() OVER (PARTITION BY n_name ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS key
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 0)"""
_BARS_SQL = "SELECT symbol, bar_date, arg_min(price, key) AS open, max(price) AS high, min(price) AS low, arg_max(price, key) AS close, sum(quantity) AS volume FROM {} GROUP BY symbol, bar_date"
MONTHLY_SQL = TICKS_SQL + ", m AS (SELECT *, date_trunc('month', day)::DATE AS bar_date FROM ticks), bars AS (" + _BARS_SQL.format("m") + ")"
DILATED_SQL = TICKS_SQL + ", m AS (SELECT *, (DATE '1985-01-01' + to_months(((day - DATE '1995-01-02') // 7)::INT))::DATE AS bar_date FROM ticks), bars AS (" + _BARS_SQL.format("m") + ")"


def read_run_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved run; blank and NaN cells are null, and columns that older runs lack get their defaults."""
    rows = spark.read.option("header", True).option("nanValue", "NaN").schema(schema).csv(path)
    return clean_nonfinite(rows).na.fill({c: v for c, v in {"lifecycle": "pre_breakout", "status": "coiling"}.items() if c in rows.columns})


def clean_nonfinite(rows: DataFrame) -> DataFrame:
    """NaN and infinities become null in every double column."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return rows.withColumns({n: F.when(~bad(F.col(n)), F.col(n)) for n, t in rows.dtypes if t == "double"})


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Frozen review snapshots: one row for each bar. Files that aren't JSON or have no bars are left out."""
    bar = "struct<date: string, open: double, high: double, low: double, close: double, volume: double>"
    raw = spark.read.schema(f"ticker string, source string, monthly_bars array<{bar}>, _corrupt_record string").option("multiLine", True).json(path)
    bars = raw.filter("_corrupt_record IS NULL AND size(monthly_bars) > 0").select(F.col("ticker").alias("symbol"), F.explode("monthly_bars").alias("b"))
    return bars.select("symbol", F.to_date("b.date").alias("bar_date"), "b.open", "b.high", "b.low", "b.close", "b.volume")
