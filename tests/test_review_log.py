"""The review log: ids without gaps or repeats under concurrent writers, failed jobs and repeated deliveries."""

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from basewatch.operators import reviews
from basewatch.sources import review_log


def batch(spark, start, n):
    return spark.range(start, start + n, 1, 3).select(F.concat(F.lit("t"), F.col("id") % 7).alias("ticker"), F.col("id").alias("event"))


def test_ids_follow_one_another(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert review_log.append(batch(spark, 100, 50), path, ["event"]) == (1, 50)
    assert review_log.append(batch(spark, 0, 0), path, ["event"], "nothing") == (51, 0)
    assert review_log.append(batch(spark, 0, 20), path, ["event"], "late") == (51, 20)
    assert review_log.append(batch(spark, 0, 20), path, ["event"], "late") == (51, 20)  # delivered again
    got = sorted((r.id, r.event) for r in review_log.read(spark, path).collect())
    assert got == list(enumerate([*range(100, 150), *range(20)], 1))


def test_concurrent_writers_and_a_failed_one(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    review_log.append(batch(spark, 0, 5), path, ["event"])
    broken = batch(spark, 900, 30).withColumn("ticker", F.when(F.col("event") == 925, F.raise_error(F.lit("lost"))).otherwise(F.col("ticker")))
    with pytest.raises(Exception, match="lost"):
        review_log.append(broken, path, ["event"])
    # a batch whose writer was ended before it could publish
    batch(spark, 800, 5).withColumn("_seq", F.col("event") - 800).write.parquet(f"{path}/batches/batch=ended")
    with ThreadPoolExecutor(4) as pool:
        spans = list(pool.map(lambda i: review_log.append(batch(spark, 1000 * i, 10 + i), path, ["event"], "same" if i in (3, 4) else None), range(1, 5)))
    rows = review_log.read(spark, path).collect()
    assert sorted(r.id for r in rows) == list(range(1, len(rows) + 1))
    assert not [r for r in rows if 800 <= r.event < 1000] and spans[2] == spans[3]  # two that bear one name are one
    assert len(rows) == 5 + 11 + 12 + spans[2][1]
    for first, n in spans:
        assert [r.event % 1000 for r in sorted(rows, key=lambda r: r.id) if first <= r.id < first + n] == list(range(n))


def test_legacy_corrections(spark):
    two = [("2020-03-01", 10.0, None), ("2021-03-01", 1e-5, "structural_retest")]
    cases = [
        (" abc ", None, "2024-01-01T00:00:00Z", two, None), ("é", "3m", None, two, None), ("  ", None, None, two, "ticker"), ("a", "1M", None, two, "interval"), ("a", None, "soon", two, "created_at"),
        ("a", None, None, None, "no_points"), ("a", None, None, [("2020-3-1", 1.0, None)], "date"), ("a", None, None, [*two, ("2020-05-01", 0.0, None)], "price"), ("a", None, None, [*two, ("2020-05-01", float("nan"), None)], "price"),
        ("a", None, None, [*two, ("2020-05-01", 1.0, "peak")], "role"), ("a", None, None, [two[0], ("2020-05-01", 1.0, "breakout_peak")], "too_few_anchors"), ("a", None, None, [], "too_few_anchors"),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "ticker string, interval string, created_at string, points array<struct<date: string, price: double, role: string>>")
    got = reviews.legacy_decisions(df).collect()
    assert [r.fault for r in got] == [c[4] for c in cases] and [r.decision for r in got] == ["corrected"] * 2 + [None] * 10
    for r in got[:2]:
        said = {"ticker": r.ticker, "interval": "3M", "created_at": r.created_at, "points": [p.asDict() for p in r.points]}
        assert r.event_id == "legacy-sha256:" + hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got[0].ticker == "ABC" and got[0].points[0].role == "major_top"
