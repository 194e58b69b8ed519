"""Detections in images mapped back to bars; lines through highs; runs compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapped(detections: DataFrame, candles: DataFrame, height: float, reach: int = 3) -> DataFrame:
    """detections(capture, det, x, y, price), candles(capture, pos, x, high, y_high): the candle nearest in x (of two the first), then the one with the least score within reach of it.

    The score adds steps from the nearest candle, ten times the distance in price as a share of the
    capture's price range, and four times that in pixels as a share of its height; of equal scores
    the first position wins. The nearest candle is found by one sort of both sides by x, and those
    in reach by their positions: a capture's detections never meet all its candles."""
    kind = lambda df, **more: df.select("capture", "x", *[c.alias(n) for n, c in more.items()])
    det = F.struct("det", "y", "price")
    both = kind(candles, pos=F.col("pos"), d=F.lit(None).cast(detections.select(det).schema[0].dataType)).unionByName(kind(detections, pos=F.lit(None).cast("int"), d=det))
    here = F.when(F.col("pos").isNotNull(), F.struct("x", "pos"))
    left = F.last(here, ignorenulls=True).over(Window.partitionBy("capture").orderBy("x", F.col("pos").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(here, ignorenulls=True).over(Window.partitionBy("capture").orderBy("x", F.col("pos").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"left": left, "right": right}).filter("d IS NOT NULL")
    at = F.array_min(F.array_compact(F.array(*[F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col("x") - F.col(s)["x"]).alias("gap"), F.col(s)["pos"].alias("pos"))) for s in ("left", "right")])))["pos"]
    near = near.select("capture", "d.*", at.alias("at")).filter("at IS NOT NULL").withColumn("pos", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)))
    spans = candles.groupBy("capture").agg(F.greatest(F.max("high") - F.min("high"), F.lit(1e-9)).alias("span"))
    around = near.join(candles.select("capture", "pos", "high", "y_high"), ["capture", "pos"]).join(spans, "capture")
    score = F.abs(F.col("pos") - F.col("at")) + 10 * F.abs(F.col("high") - F.col("price")) / F.col("span") + 4 * F.coalesce(F.abs(F.col("y_high") - F.col("y")), F.lit(0.0)) / max(height, 1.0)
    best = around.groupBy("capture", "det").agg(F.min(F.struct(score.alias("score"), "pos", "high")).alias("b"))
    return best.select("capture", "det", F.col("b.pos").alias("pos"), F.col("b.high").alias("high"), F.round("b.score", 6).alias("score"))


def trendlines(highs: DataFrame, tolerance_pct: float = 1.5, keep: int = 5) -> DataFrame:
    """Lines through two highs at least two bars apart, by how many highs they touch; the best of each symbol."""
    a, b, t = (highs.select("symbol", F.col("idx").alias(f"i{k}"), F.col("price").alias(f"p{k}"), F.col("confidence").alias(f"c{k}")) for k in "abt")
    lines = a.join(b, "symbol").filter("ib - ia >= 2").join(t, "symbol")
    at = F.col("pa") + (F.col("pb") - F.col("pa")) / (F.col("ib") - F.col("ia")) * (F.col("it") - F.col("ia"))
    near = lines.filter((at > 0) & (F.abs(F.col("pt") - at) / at * 100 <= tolerance_pct))
    scored = near.groupBy("symbol", "ia", "ib").agg(F.count("*").alias("touches"), F.avg("ct").alias("mean"))
    scored = scored.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("mean") * (1 + 0.1 * (F.col("touches") - 2))), 4)).drop("mean")
    w = Window.partitionBy("symbol").orderBy(F.desc("touches"), F.desc("confidence"), "ia", "ib")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two runs (symbol, grade, lifecycle) side by side: added, removed, changed or same."""
    b, a = (x.select("symbol", F.col("grade").alias(f"{n}_grade"), F.col("lifecycle").alias(f"{n}_lifecycle"), F.lit(True).alias(f"in_{n}")) for x, n in ((before, "before"), (after, "after")))
    both = b.join(a, "symbol", "full_outer")
    same = F.col("before_grade").eqNullSafe(F.col("after_grade")) & F.col("before_lifecycle").eqNullSafe(F.col("after_lifecycle"))
    change = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").when(same, "same").otherwise("changed")
    return both.withColumn("change", change).drop("in_before", "in_after")
