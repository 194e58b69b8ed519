"""The streamed breakout machine and the merge of corrected bars, against batch runs over the same bars."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewatch.operators import bars as B
from basewatch.operators import breakout
from basewatch.plans import price
from basewatch.sources.tables import dilated_bars
from basewatch.streaming import breakouts, corrections

SF = "/root/testdata/sf0.01"
SYMBOLS = ("NATION_0", "NATION_3", "NATION_7", "NATION_11", "NATION_12")


@pytest.fixture(scope="module")
def bars(spark):
    return dilated_bars(spark, SF).filter(F.col("symbol").isin(*SYMBOLS)).cache()


def chunk(bars, k, years=3):
    return bars.filter(F.floor((F.year("bar_date") - 1985) / years) == k)


#: Files in three orders, each within six years of time's course, and after which of them the stream stops and starts again.
ORDERS = [([*range(11)], ()), ([1, 0, 3, 2, 5, 4, 7, 6, 9, 8, 10], (4,)), ([0, 2, 1, 4, 3, 6, 5, 8, 7, 10, 9], (1, 2, 7))]


@pytest.mark.parametrize("order, stops", ORDERS)
def test_machine_gives_the_batch_fold_in_any_order(spark, bars, tmp_path, order, stops):
    want = {r.symbol: tuple(r)[1:] for r in breakout.assess(price._lids(spark, SF).filter("lid IS NOT NULL")).filter(F.col("symbol").isin(*SYMBOLS)).collect()}
    stream = spark.readStream.schema(breakouts.BARS).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in/*")
    for n, k in enumerate(order):
        chunk(bars, k).select("symbol", "bar_date", "high", "low", "close").coalesce(1).write.parquet(f"{tmp_path}/in/{n:02d}")
        if n in stops:
            breakouts.drain(stream, f"{tmp_path}/run", delay="96 months")
    spark.createDataFrame([("", date(2060, 1, 1), None, None, None)], breakouts.BARS).coalesce(1).write.parquet(f"{tmp_path}/in/99")
    got = breakouts.drain(stream, f"{tmp_path}/run", delay="96 months").collect()
    assert {r.symbol: tuple(r)[1:] for r in got} == want
    rows = spark.read.parquet(f"{tmp_path}/run/closed").cache()
    closed = rows.filter("kind = 'closed'")
    assert closed.count() == closed.select("symbol", "year", "qtr").distinct().count()
    assert closed.select("batch").distinct().count() > 1  # quarters close as time goes on, not all at the end
    assert rows.filter("kind = 'provisional'").count() > 0


def test_what_comes_too_late_leaves_closed_quarters_alone(spark, bars, tmp_path):
    one = bars.filter("symbol = 'NATION_3'").select("symbol", "bar_date", "high", "low", "close")
    stream = spark.readStream.schema(breakouts.BARS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    one.filter("bar_date BETWEEN '1990-01-01' AND '1995-12-31'").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    breakouts.drain(stream, f"{tmp_path}/run", delay="12 months")
    before = spark.read.parquet(f"{tmp_path}/run/closed").filter("kind = 'closed'").count()
    one.filter("bar_date BETWEEN '1994-11-01' AND '1995-02-28'").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    breakouts.drain(stream, f"{tmp_path}/run", delay="12 months")
    rows = spark.read.parquet(f"{tmp_path}/run/closed")
    assert before > 0 and rows.filter("kind = 'closed'").count() == before


def versions(bars):
    """Three deliveries: first bars without some months and with wrong closes, then corrections, then late months and one that is taken back."""
    m, y = F.month("bar_date"), F.year("bar_date")
    v = bars.select("symbol", "bar_date", "open", "high", "low", "close", "volume")
    late = (m == 5) & (y % 4 == 1)
    first = v.filter(~late).withColumn("close", F.when(m == 8, F.col("low")).otherwise(F.col("close"))).withColumn("version", F.lit(1))
    fixed = v.filter(m == 8).withColumn("version", F.lit(2))
    last = v.filter(late).withColumn("version", F.lit(1)).unionByName(v.filter((m == 2) & (y == 1999)).withColumn("high", F.lit(-1.0)).withColumn("version", F.lit(7)))
    return [first, fixed, last]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_corrections_equal_a_batch_run_over_the_corrected_bars(spark, bars, tmp_path, order):
    parts = versions(bars)
    stream = spark.readStream.schema(corrections.BARS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    store = None
    for n, k in enumerate(order):
        parts[k].coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        store = corrections.drain(stream, f"{tmp_path}/store")
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    stand = every.groupBy("symbol", "bar_date").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "version").alias("s")).select("symbol", "bar_date", "s.*")
    quarters = B.quarterly(B.clean(stand)).join(B.clean(stand).groupBy("symbol", F.year("bar_date").alias("year"), F.quarter("bar_date").alias("qtr")).count().filter("count = 3"), ["symbol", "year", "qtr"])
    shown = ["symbol", "year", "qtr", "open", "high", "low", "close", "volume"]
    assert sorted(map(tuple, corrections.corrected_quarters(store).select(shown).collect())) == sorted(map(tuple, quarters.select(shown).collect()))
    states = sorted(map(tuple, corrections.corrected_states(store).collect()), key=str)
    assert len(states) == len(SYMBOLS)
    assert states == sorted(map(tuple, corrections._assessed(quarters.drop("q_idx"), corrections.DEFAULT).select("symbol", "state", "escape_q", "confirmed_q", "via", "failed", "consecutive", "quarters").collect()), key=str)
    # a batch that runs again changes nothing, nor does one that brings nothing new, nor compaction
    corrections.merge(store, parts[order[-1]], len(order) - 1)
    corrections.merge(store, parts[order[0]], len(order))
    assert store.changes("quarters").filter(F.col("batch") == len(order)).count() == 0
    for name in ("bars", "quarters", "states"):
        store.compact(name)
    assert store.changes("bars").select("batch").distinct().count() == 1
    assert sorted(map(tuple, corrections.corrected_states(store).collect()), key=str) == states


def test_a_broken_bar_withdraws_its_quarter(spark, bars, tmp_path):
    one = bars.filter("symbol = 'NATION_7'").select("symbol", "bar_date", "open", "high", "low", "close", "volume", F.lit(1).alias("version"))
    store = corrections.Store(spark, f"{tmp_path}/store")
    corrections.merge(store, one, 0)
    n = corrections.corrected_quarters(store).count()
    day = one.filter("bar_date > '2000-01-01'").agg(F.min("bar_date")).first()[0]
    corrections.merge(store, one.filter(F.col("bar_date") == day).withColumn("close", F.lit(None).cast("double")).withColumn("version", F.lit(2)), 1)
    assert corrections.corrected_quarters(store).count() == n - 1
    assert [r.withdrawn for r in store.changes("quarters").filter("batch = 1").collect()] == [True]
    corrections.merge(store, one.filter(F.col("bar_date") == day).withColumn("version", F.lit(3)), 2)
    assert corrections.corrected_quarters(store).count() == n


def test_one_step_equals_the_fold(spark):
    """Random quarters around a level lid, enough of them that escapes fail, are held, and are confirmed both ways."""
    rng, rows, want = np.random.default_rng(8), [], {}
    for s in range(300):
        close, before, machine = 95.0, None, dict.fromkeys(breakout.FIELDS) | breakout.FIRST
        for q in range(40):
            close = max(50.0, close * (1 + rng.normal(0.005, 0.06)))
            x = {"q_idx": q, "high": close * (1 + abs(rng.normal(0, 0.02))), "low": close * (1 - abs(rng.normal(0, 0.02))), "close": close, "lid": 100.0, "band_pct": 3.0}
            rows.append((f"s{s}", *x.values()))
            machine, before = breakouts.step(machine, x | {"before": before}), close
        want[f"s{s}"] = tuple(machine[k] for k in ("state", "escape_q", "confirmed_q", "via", "failed", "consecutive"))
    got = breakout.assess(spark.createDataFrame(rows, "symbol string, q_idx int, high double, low double, close double, lid double, band_pct double")).collect()
    assert {r.symbol: tuple(r)[1:] for r in got} == want
    assert {w[3] for w in want.values()} == {None, "persistence", "retest_continuation"} and max(w[4] for w in want.values()) > 1
