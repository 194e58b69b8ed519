"""The breakout state machine over a stream: one keyed state a symbol, quarters closed by event-time timers.

Months that come in are held until the watermark has passed their quarter's end; then a timer closes
the quarter, the lid and the escape band follow from the last 24 quarters, and the machine takes one
step. State is bounded: the months of open quarters, 24 quarters and one machine for each symbol. Files
may come in any order within the watermark's delay. What comes later than that Spark turns away (and
counts as numRowsDroppedByWatermark); corrections.py, which has no watermark, takes up such bars from
the same source. Rows of kind 'provisional' say where the machine would stand if its last open quarter
ended now.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from basewatch.operators.breakout import FIELDS, FIRST
from basewatch.params import DEFAULT, Params

#: The lid is the highest high of the quarters from 24 to 8 before.
LID = (24, 8)
BARS = "symbol string, bar_date date, high double, low double, close double"
OUTPUT = "symbol string, kind string, year int, qtr int, q_idx int, state string, escape_q int, confirmed_q int, via string, failed int, consecutive int"
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_MACHINE = ", ".join(f"{n} {t}" for n, t in FIELDS.items())


def quarter_end_ms(ordinal: int) -> int:
    """The first millisecond after a quarter, counted as 4 * year + quarter - 1."""
    after = ordinal + 1
    return int(datetime(after // 4, after % 4 * 3 + 1, 1, tzinfo=timezone.utc).timestamp() * 1000)


def step(a: dict, x: dict, p: Params = DEFAULT) -> dict:
    """operators.breakout's fold, one quarter at a time: machine a and a quarter x(q_idx, high, low, close, lid, band_pct, before) -> the machine after it."""
    if a["state"] == "broken_out":
        return a
    above = x["close"] > x["lid"] * (1 + x["band_pct"] / 100)
    if a["state"] == "sealed":
        if not above:
            return a
        pre = x["lid"] if x["before"] is None else x["before"]
        return a | {"state": "breaking_out", "pre": pre, "consecutive": 1, "since": x["q_idx"], "lid_at": x["lid"], "top": x["high"], "best": x["close"], "held_high": None, "escape_q": x["q_idx"]}
    if x["close"] < x["lid"]:
        return a | {"state": "sealed", "consecutive": 0, "failed": a["failed"] + 1, "held_high": None}
    run = a["consecutive"] + 1 if above else 0
    top, best = max(a["top"], x["high"]), max(a["best"], x["close"])
    holds = not above and x["low"] >= x["lid"] * (1 - p.retest_tolerance_pct / 100)
    slope = (x["close"] - a["pre"]) / a["pre"] / (x["q_idx"] - a["since"] + 1) * 400
    expansion = round((best / a["lid_at"] - 1) * 100, 2)
    lid_slope = 0.0 if a["lid_slope"] is None else a["lid_slope"]
    persists = run >= p.confirm_closes and expansion >= p.expansion_pct and slope >= max(p.post_slope_pct, 2 * abs(lid_slope))
    again = a["held_high"] is not None and above and x["high"] > a["held_high"]
    now = a | {"consecutive": run, "expansion": expansion, "post_slope": slope, "held_high": top if holds else a["held_high"], "top": top, "best": best, "lid_slope": lid_slope}
    if persists or again:
        return now | {"state": "broken_out", "confirmed_q": x["q_idx"], "via": "persistence" if persists else "retest_continuation"}
    return now


class Breakouts(StatefulProcessor):
    def __init__(self, p: Params = DEFAULT):
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.months = handle.getMapState("months", "month int", "high double, low double, close double")
        self.quarters = handle.getListState("quarters", "high double, true_range double")
        self.machine = handle.getValueState("machine", f"{_MACHINE}, n int, closed int, last_close double, before double")

    def _now(self) -> tuple[dict, list]:
        names = [*FIELDS, "n", "closed", "last_close", "before"]
        held = self.machine.get() if self.machine.exists() else None
        a = dict(zip(names, held, strict=True)) if held else dict.fromkeys(names) | FIRST | {"n": 0, "closed": -1}
        return a, [tuple(x) for x in self.quarters.get()] if held else []

    def _closed(self, a: dict, recent: list, ordinal: int, months: dict) -> tuple[dict, list]:
        """Machine and last quarters after the quarter of these months."""
        rows = [months[m] for m in sorted(months)]
        high, low, close = max(r[0] for r in rows), min(r[1] for r in rows), rows[-1][2]
        before = a["last_close"]
        true_range = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
        past = recent[: max(0, len(recent) - LID[1] + 1)]  # this one isn't in it yet
        after = a | {"n": a["n"] + 1, "closed": ordinal, "last_close": close}
        if past and (lid := max(r[0] for r in past)) > 0:
            ranges = [r[1] for r in recent[-(self.p.band_quarters - 1) :]] + [true_range]
            band = max(self.p.band_min_pct, min(self.p.band_max_pct, sum(ranges) / len(ranges) / lid * 100 * self.p.band_fraction))
            x = {"q_idx": a["n"], "high": high, "low": low, "close": close, "lid": lid, "band_pct": band, "before": a["before"]}
            after = step(after, x, self.p) | {"before": close}
        return after, [*recent, (high, true_range)][-LID[0] :]

    def _row(self, symbol: str, kind: str, ordinal: int, a: dict) -> Row:
        return Row(symbol=symbol, kind=kind, year=ordinal // 4, qtr=ordinal % 4 + 1, q_idx=a["n"] - 1, state=a["state"], escape_q=a["escape_q"], confirmed_q=a["confirmed_q"], via=a["via"], failed=a["failed"], consecutive=a["consecutive"])

    def _open(self) -> dict[int, dict]:
        """Months of open quarters, by quarter."""
        out: dict[int, dict] = {}
        for k, v in self.months.iterator():
            out.setdefault(k[0] // 3, {})[k[0]] = tuple(v)
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        a, recent = self._now()
        waiting, new = set(self._open()), set()
        for r in rows:
            if r.high is None or r.low is None or r.close is None or not min(r.high, r.low, r.close) > 0:
                continue  # a bar that isn't valid, or a mere sign that time has passed
            month = r.bar_date.year * 12 + r.bar_date.month - 1
            if month // 3 <= a["closed"]:
                continue  # its quarter has come out; the watermark lets none such through
            self.months.updateValue((month,), (r.high, r.low, r.close))
            new.add(month // 3)
        for q in new - waiting:
            self.handle.registerTimer(quarter_end_ms(q))
        if new:
            held = self._open()
            for q in sorted(held):
                a, recent = self._closed(a, recent, q, held[q])
            yield self._row(key[0], "provisional", max(held), a)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Close every quarter that the watermark has passed, in order: several may end with one batch."""
        watermark, held = timerValues.getCurrentWatermarkInMs(), self._open()
        due = sorted(q for q in held if quarter_end_ms(q) <= watermark)
        if not due:
            return
        a, recent = self._now()
        for q in due:
            a, recent = self._closed(a, recent, q, held[q])
            for month in held[q]:
                self.months.removeKey((month,))
            yield self._row(key[0], "closed", q, a)
        self.machine.update(tuple(a.values()))
        self.quarters.put(recent)

    def close(self) -> None:
        pass


def states(bars: DataFrame, delay: str = "24 months", p: Params = DEFAULT) -> DataFrame:
    """A stream of bars (BARS; a row without prices only says how far time has come) -> a stream of OUTPUT.

    Kinds: closed (a quarter is over and the machine has taken its step), provisional."""
    bars.sparkSession.conf.set(*_STORE)
    timed = bars.withColumn("ts", F.col("bar_date").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("symbol").transformWithState(Breakouts(p), OUTPUT, "Update", "EventTime")


def drain(bars: DataFrame, folder: str, delay: str = "24 months") -> DataFrame:
    """Run the stream over what has come in since the last call, in folder -> each symbol's last closed state.

    Each micro-batch writes its rows under its own number, so that one that runs again after a failure
    replaces its own."""
    spark, out = bars.sparkSession, f"{folder}/closed"
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n:08d}")
    states(bars, delay).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return last_states(spark.read.schema(OUTPUT + ", batch int").parquet(out))


def last_states(rows: DataFrame) -> DataFrame:
    shown = ("state", "escape_q", "confirmed_q", "via", "failed", "consecutive")
    return rows.filter("kind = 'closed'").groupBy("symbol").agg(F.max_by(F.struct("q_idx", *shown), "q_idx").alias("s")).select("symbol", *[f"s.{c}" for c in shown])
