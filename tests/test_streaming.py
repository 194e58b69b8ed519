"""Event-time intake, run to the end of files that are there."""

from datetime import datetime

from basewatch.streaming import quarters


def drained(spark, stream, name):
    stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    return spark.table(name).collect()


def test_days_close_with_the_watermark(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double, quantity double"
    rows = [("S", datetime(2020, 1, 1, 10), 2.0, 1.0), ("S", datetime(2020, 1, 1, 12), 5.0, 2.0), ("S", datetime(2020, 3, 1), 1.0, 1.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/ticks")
    got = drained(spark, quarters.monthly_from_ticks(spark.readStream.schema(schema).parquet(f"{tmp_path}/ticks")), "closed_days")
    assert [(str(r.day), r.high, r.low, r.volume, r.ticks) for r in got] == [("2020-01-01", 5.0, 2.0, 3.0, 2)]


def test_an_event_goes_on_once(spark, tmp_path):
    schema = "event_id long, ts timestamp"
    rows = [(1, datetime(2020, 1, 1, 10)), (1, datetime(2020, 1, 1, 10, 5)), (2, datetime(2020, 1, 1, 11))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events")
    got = drained(spark, quarters.unique_events(spark.readStream.schema(schema).parquet(f"{tmp_path}/events")), "single_events")
    assert sorted(r.event_id for r in got) == [1, 2]
