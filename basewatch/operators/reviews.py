"""The append-only review log: effective overrides, states, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basewatch.functions import canonical
from basewatch.operators.contracts import first_fault, iso_day

#: Roles that a reviewed point may have, and the interval that reviews hold for. Fixed values.
ROLES = ("major_top", "structural_retest", "provisional_top", "breakout_peak")
INTERVAL = "3M"


def latest(log: DataFrame, *keys: str) -> DataFrame:
    """The last event of each key by id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("id"))
    return log.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def effective(log: DataFrame) -> DataFrame:
    """log(id, ticker, decision, price) -> ticker, override (price of the last correction still standing), state (last decision; null after a revoke).

    A correction sets the override, an approval clears it, a revoke clears override and state;
    events that only capture change neither."""
    told = latest(log.filter("decision != 'capture'"), "ticker")
    gone = F.col("decision") == "revoke"
    return told.select("ticker", F.when(F.col("decision") == "corrected", F.col("price")).alias("override"), F.when(~gone, F.col("decision")).alias("state"), F.col("id").alias("event_id"))


def session_counts(items: DataFrame) -> DataFrame:
    """items(session_id, position, ticker, status) -> counts and the first pending ticker."""
    n = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    return items.groupBy("session_id").agg(n("pending"), n("reviewed"), n("skipped"), F.count("*").alias("total"), F.min_by(F.when(F.col("status") == "pending", F.col("ticker")), F.when(F.col("status") == "pending", F.col("position"))).alias("first_pending"))


def new_requests(requests: DataFrame, done: DataFrame) -> DataFrame:
    """requests(session_id, ticker, key, hash) against those done: new, replay (same hash) or conflict."""
    d = done.select("session_id", "ticker", "key", F.col("hash").alias("done_hash"))
    kind = F.when(F.col("done_hash").isNull(), "new").when(F.col("done_hash") == F.col("hash"), "replay").otherwise("conflict")
    return requests.join(d, ["session_id", "ticker", "key"], "left").withColumn("outcome", kind).drop("done_hash")


def grouped_samples(events: DataFrame) -> DataFrame:
    """events(event_id, sample, created_at) -> the last event of each sample, and the one it supersedes."""
    w = Window.partitionBy("sample").orderBy("created_at", "event_id")
    back = Window.partitionBy("sample").orderBy(F.desc("created_at"), F.desc("event_id"))
    rows = events.withColumns({"supersedes": F.lag("event_id").over(w), "nth": F.row_number().over(back), "n_events": F.count("*").over(Window.partitionBy("sample"))})
    return rows.filter("nth = 1").drop("nth")


def legacy_decisions(corrections: DataFrame) -> DataFrame:
    """Corrections of the first schema as decisions of the log: corrections(ticker, interval, created_at, points: array of date, price, role) ->
    ticker, interval, created_at, decision, points, event_id, fault.

    All are `corrected`, without the date of the data or the algorithm's version. A point without a role is a major top.
    Faulty ones stay with the first demand that they fail and without a decision; event_id comes from the content alone, so that the same one always has the same."""
    ticker, interval = F.upper(F.trim("ticker")), F.upper(F.trim(F.coalesce("interval", F.lit(INTERVAL))))
    points = F.transform("points", lambda p: F.struct(p["date"].alias("date"), p["price"].cast("double").alias("price"), F.coalesce(p["role"], F.lit(ROLES[0])).alias("role")))
    c = corrections.select(ticker.alias("ticker"), interval.alias("interval"), F.col("created_at").cast("string").alias("created_at"), points.alias("points"))
    finite = lambda x: F.coalesce(~F.isnan(x) & (x > 0) & (x < float("inf")), F.lit(False))
    tests = {
        "ticker": F.coalesce("ticker", F.lit("")) == "",
        "interval": F.col("interval") != INTERVAL,
        "created_at": F.col("created_at").isNotNull() & F.try_to_timestamp("created_at").isNull(),
        "no_points": F.col("points").isNull(),
        "date": F.exists("points", lambda p: iso_day(p["date"]).isNull()),
        "price": F.exists("points", lambda p: ~finite(p["price"])),
        "role": F.exists("points", lambda p: ~p["role"].isin(*ROLES)),
        "too_few_anchors": F.size(F.filter("points", lambda p: p["role"] != "breakout_peak")) < 2,
    }
    c = c.withColumn("fault", first_fault(tests))
    content = F.struct("ticker", "interval", "created_at", "points")
    said = canonical.canonical(content, c.select(content.alias("x")).schema["x"].dataType, ascii_only=True)
    return c.select("ticker", "interval", "created_at", F.when(F.col("fault").isNull(), "corrected").alias("decision"), "points", F.concat(F.lit("legacy-sha256:"), canonical.digest(said)).alias("event_id"), "fault")
