"""The breakout state machine: one fold over a symbol's quarters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basewatch.params import DEFAULT, Params

#: What the fold carries: `top` and `best` are the highest high and close since the escape, `held_high` what `top` was at the last retest that held.
FIELDS = {
    "state": "string", "pre": "double", "consecutive": "int", "since": "int", "lid_at": "double", "top": "double", "best": "double", "held_high": "double", "escape_q": "int",
    "confirmed_q": "int", "via": "string", "failed": "int", "expansion": "double", "post_slope": "double", "lid_slope": "double",
}
STATE = "struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS.items()) + ">"
FIRST = {"state": "sealed", "consecutive": 0, "since": 0, "failed": 0}


def assess(quarters: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """quarters(symbol, q_idx, high, low, close, lid, band_pct), all complete -> symbol and the state that the last one leaves.

    Optional columns: before (the close of the quarter before, else taken from these rows) and
    slope (the lid's change in a quarter, else level).
    """
    if "before" not in quarters.columns:
        quarters = quarters.withColumn("before", F.lag("close").over(Window.partitionBy("symbol").orderBy("q_idx")))
    if "slope" not in quarters.columns:
        quarters = quarters.withColumn("slope", F.lit(0.0))
    q = F.struct("q_idx", "high", "low", "close", "lid", "band_pct", "before", "slope")
    per = quarters.filter("lid > 0").groupBy("symbol").agg(F.array_sort(F.collect_list(q)).alias("all"))
    none = {n: F.lit(None).cast(t) for n, t in FIELDS.items()}
    start = F.struct(*[(F.lit(FIRST[n]).cast(t) if n in FIRST else none[n]).alias(n) for n, t in FIELDS.items()])

    def step(a, x):
        put = lambda **new: F.struct(*[new.get(n, a[n]).cast(t).alias(n) for n, t in FIELDS.items()])
        above = x["close"] > x["lid"] * (1 + x["band_pct"] / 100)
        escaped = put(
            state=F.lit("breaking_out"), pre=F.coalesce(x["before"], x["lid"]), consecutive=F.lit(1), since=x["q_idx"], lid_at=x["lid"], top=x["high"], best=x["close"],
            held_high=none["held_high"], escape_q=x["q_idx"],
        )
        failed = put(state=F.lit("sealed"), consecutive=F.lit(0), failed=a["failed"] + 1, held_high=none["held_high"])
        run = F.when(above, a["consecutive"] + 1).otherwise(0)
        top, best = F.greatest(a["top"], x["high"]), F.greatest(a["best"], x["close"])
        holds = ~above & (x["low"] >= x["lid"] * (1 - p.retest_tolerance_pct / 100))
        held = F.when(holds, top).otherwise(a["held_high"])
        slope = (x["close"] - a["pre"]) / a["pre"] / (x["q_idx"] - a["since"] + 1) * 400
        expansion = F.round((best / a["lid_at"] - 1) * 100, 2)
        lid_slope = F.coalesce(a["lid_slope"], x["slope"] / x["lid"] * 400)
        persist = (run >= p.confirm_closes) & (expansion >= p.expansion_pct) & (slope >= F.greatest(F.lit(p.post_slope_pct), 2 * F.abs(lid_slope)))
        again = a["held_high"].isNotNull() & above & (x["high"] > a["held_high"])
        now = {"consecutive": run, "expansion": expansion, "post_slope": slope, "held_high": held, "top": top, "best": best, "lid_slope": lid_slope}
        confirmed = put(state=F.lit("broken_out"), confirmed_q=x["q_idx"], via=F.when(persist, "persistence").otherwise("retest_continuation"), **now)
        trying = F.when(x["close"] < x["lid"], failed).when(persist | again, confirmed).otherwise(put(**now))
        return F.when(a["state"] == "broken_out", a).when(a["state"] == "breaking_out", trying).when(above, escaped).otherwise(a)

    shown = ("state", "escape_q", "confirmed_q", "via", "failed", "consecutive")
    return per.select("symbol", F.aggregate("all", start, step).alias("s")).select("symbol", *[f"s.{n}" for n in shown])
