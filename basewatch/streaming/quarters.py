"""Quarters from a stream of ticks: a quarter comes out once the watermark has passed it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_from_ticks(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """stream(symbol, ts, price, quantity) -> bars by calendar month in event time, in append mode.

    Windows of months aren't to be had, so days are closed by the watermark and months are added
    up from closed days by the sink."""
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "symbol")
    return days.agg(F.max("price").alias("high"), F.min("price").alias("low"), F.sum("quantity").alias("volume"), F.count("*").alias("ticks")).select("symbol", F.to_date("window.start").alias("day"), "high", "low", "volume", "ticks")


def unique_events(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Idempotent intake: of events with the same key within the watermark one goes on."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
