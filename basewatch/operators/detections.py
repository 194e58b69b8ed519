"""Detections of an image model in one form, and pixels as bars and prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds that suggest a high, and words in a class name that do. Fixed values.
HIGH_KINDS = ("major_high", "resistance_touch")
HIGH_WORDS = ("high", "resistance", "touch", "peak")


def kind_of(name: Column) -> Column:
    """A class name as one of the known kinds; without a name a major high."""
    n = F.translate(F.lower(F.trim(F.coalesce(name, F.lit("")))), "- ", "__")
    return F.when(n.isin(*HIGH_KINDS), n).when((n == "") | n.contains("high") | n.contains("peak"), "major_high").when(n.contains("resistance") | n.contains("touch"), "resistance_touch").otherwise(n)


def is_high(kind: Column) -> Column:
    return kind.isin(*HIGH_KINDS) | kind.rlike("|".join(HIGH_WORDS))


def normalized(detections: DataFrame) -> DataFrame:
    """detections(capture, det, class_name, confidence, x_min, y_min, x_max, y_max, x, y, width, height) -> kind, box and anchor.

    Corners are taken as they are, else made from the middle and the size; the anchor is the given
    middle, else the box's. Without either the row has no anchor."""
    c = F.col
    corners = c("x_min").isNotNull() & c("y_min").isNotNull() & c("x_max").isNotNull() & c("y_max").isNotNull()
    side = lambda given, at, size, sign: F.when(corners, c(given)).otherwise(c(at) + sign * c(size) / 2)
    box = {"x1": side("x_min", "x", "width", -1), "y1": side("y_min", "y", "height", -1), "x2": side("x_max", "x", "width", 1), "y2": side("y_max", "y", "height", 1)}
    whole = corners | (c("x").isNotNull() & c("y").isNotNull() & c("width").isNotNull() & c("height").isNotNull())
    middle = c("x").isNotNull() & c("y").isNotNull()
    d = detections.withColumns({n: F.when(whole, e) for n, e in box.items()})
    return d.select("capture", "det", kind_of(c("class_name")).alias("kind"), is_high(kind_of(c("class_name"))).alias("high"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "x1", "y1", "x2", "y2", F.when(middle, c("x")).otherwise((c("x1") + c("x2")) / 2).alias("at_x"), F.when(middle, c("y")).otherwise((c("y1") + c("y2")) / 2).alias("at_y"))


def price_at(y: Column, top: Column, height: Column, high: Column, low: Column) -> Column:
    """The price of a pixel row of a plot that shows prices from high (top) to low; beyond the plot its edge's."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - top) / F.greatest(height, F.lit(1.0))))
    return high - share * (high - low)


def price_between(y: Column, samples: Column, fallback: Column) -> Column:
    """The price on the line through the first and the last of samples array<struct<y, price>> by y; the fallback with fewer than two rows of pixels."""
    s = F.array_sort(F.filter(samples, lambda x: x["y"].isNotNull() & x["price"].isNotNull()))
    a, b = F.get(s, F.lit(0)), F.get(s, F.size(s) - 1)
    return F.when((F.size(s) >= 2) & (a["y"] != b["y"]), a["price"] + (y - a["y"]) / (b["y"] - a["y"]) * (b["price"] - a["price"])).otherwise(fallback)


def bar_at(x: Column, left: Column, width: Column, bars: Column) -> Column:
    """The place of a pixel column among so many evenly spaced bars; halves go to the even place."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - left) / F.greatest(width, F.lit(1.0))))
    return F.when(bars > 1, F.rint(share * (bars - 1)).cast("long")).otherwise(F.lit(0).cast("long"))


def end_lines(highs: DataFrame) -> DataFrame:
    """highs(capture, idx, price) -> a line from the first to the last high of each capture that has two."""
    g = highs.groupBy("capture").agg(F.min(F.struct("idx", "price")).alias("a"), F.max(F.struct("idx", "price")).alias("b"), F.count("*").alias("n")).filter("n >= 2")
    return g.select("capture", F.col("a.idx").alias("from_idx"), F.col("a.price").alias("from_price"), F.col("b.idx").alias("to_idx"), F.col("b.price").alias("to_price"))


def expectations(records: DataFrame, expected: dict[str, object]) -> DataFrame:
    """records(key, fields) against what is expected of them: a pair of numbers is an inclusive range, None a null, anything else equality."""

    def test(field: str, want: object) -> Column:
        c = F.col(field)
        if isinstance(want, list | tuple):
            return F.coalesce(c.between(*want), F.lit(False))
        return c.isNull() if want is None else F.coalesce(c == F.lit(want), F.lit(False))

    cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("actual"), test(f, want).alias("passed")) for f, want in expected.items()]
    return records.select("key", F.explode(F.array(*cells)).alias("c")).select("key", "c.*")


def universe(listed: DataFrame, explicit: DataFrame, limit: int) -> DataFrame:
    """listed(place, ticker), of which the first `limit` count, then all explicit(place, ticker); of equal tickers the first stays.

    Tickers are trimmed and upper-cased, blank ones left out, and a dot becomes a dash."""
    clean = lambda df: df.select("place", F.translate(F.upper(F.trim("ticker")), ".", "-").alias("ticker")).filter("ticker != ''")
    both = clean(listed.orderBy("place").limit(limit)).withColumn("part", F.lit(0)).unionByName(clean(explicit).withColumn("part", F.lit(1)))
    one = both.groupBy("ticker").agg(F.min(F.struct("part", "place")).alias("at"))
    return one.select("ticker", F.col("at.part").alias("part"), F.col("at.place").alias("place"))
