"""Contracts, labels and detections on small cases: nulls, blanks, empty tables, ties."""

from datetime import date

from pyspark.sql import functions as F

from basewatch.operators import contracts as C
from basewatch.operators import detections as D
from basewatch.operators import gold as G

BAR = "symbol string, pos int, date string, open double, high double, low double, close double, volume double"


def test_provider_rows_get_their_first_fault(spark):
    ok = (1.0, 2.0, 0.5, 1.5, 10.0)
    rows = [
        ("A", 0, "2001-01-31", *ok), ("A", 1, "2001-02-28", 1.0, 1.2, 0.5, 1.5, 10.0), ("A", 2, "2001-03-31", 1.0, float("inf"), 0.5, 1.5, -1.0), ("A", 3, "2001-03-31", *ok), ("A", 4, None, *ok),
        ("A", 5, "20010501", *ok), ("B", 0, "2001-01-01", *ok), ("B", 1, "2001-01-31", *ok), ("B", 2, "2030-01-01", *ok), ("C", 0, "2001-01-31", *ok[:4], None), ("D", 0, "2001-01-31", 0.0, *ok[1:]), ("D", 1, "2001-02-30", *ok),
    ]
    got = {(r.symbol, r.pos): r.fault for r in C.provider_faults(spark.createDataFrame(rows, BAR), "2000-01-01", "2010-12-31").collect()}
    assert got[("A", 0)] is None and got[("A", 1)] == "containment" and got[("A", 2)] == "bad_high" and got[("A", 3)] == "not_ascending" and got[("A", 4)] == got[("A", 5)] == got[("D", 1)] == "bad_date"
    assert got[("B", 1)] == "month_twice" and got[("B", 2)] == "outside_range" and got[("C", 0)] == "bad_volume" and got[("D", 0)] == "bad_open"
    assert C.provider_faults(spark.createDataFrame([], BAR), "2000-01-01", "2010-12-31").count() == 0


def test_frozen_bars_end_at_the_cutoff(spark):
    ok = (1.0, 2.0, 0.5, 1.5, None)
    rows = [("A", 0, "2001-01-31", *ok), ("A", 1, "2001-02-28", *ok), ("A", 2, "2001-03-31", -1.0, *ok[1:]), ("B", 0, "2001-01-31", *ok)]
    cutoff = spark.createDataFrame([("A", date(2001, 2, 28)), ("B", date(2001, 2, 28))], "symbol string, cutoff date")
    got = {r.symbol: (r.bars, r.fault) for r in C.frozen_faults(spark.createDataFrame(rows, BAR), cutoff).collect()}
    assert got == {"A": (2, None), "B": (1, "cutoff_not_last")}  # the bad bar lies behind the cutoff


def test_base_lock_and_capture(spark):
    why = "x" * 20
    rows = [(1, "base_pattern", [], why), (2, "base_pattern", ["other"], why), (3, "exception_territory", None, why), (4, "uncertain", [], "  " + "x" * 19), (5, None, ["other", "other"], why), (6, "uncertain", ["what"], why)]
    got = {r.k: r.f for r in spark.createDataFrame(rows, "k int, base_path string, failed_rules array<string>, rationale string").select("k", C.base_lock_faults().alias("f")).collect()}
    assert got == {1: None, 2: "base_with_rules", 3: "exception_without_rules", 4: "short_rationale", 5: "duplicate_rule", 6: "unknown_rule"}


def test_open_quarter_and_redaction(spark):
    x = spark.createDataFrame([(date(2001, 4, 1), date(2001, 5, 31)), (date(2001, 4, 1), date(2001, 6, 30)), (date(2001, 3, 1), date(2001, 5, 31)), (None, date(2001, 5, 31))], "p date, last date")
    assert [r.f for r in x.select(C.in_open_quarter(F.col("p"), F.col("last")).alias("f")).collect()] == [True, False, False, False]
    r = spark.createDataFrame([(1, True, "s"), (2, False, "s"), (3, None, "s")], "id int, locked boolean, score string")
    assert [x.score for x in C.redacted(r, "locked", ["id"]).orderBy("id").collect()] == ["s", None, None]


def test_cells_and_sessions(spark):
    x = spark.createDataFrame([(" 1.5 ",), ("x",), (" ",), (None,), ("TRUE",)], "t string")
    assert [r.v for r in x.select(C.typed_cell(F.col("t"), "double").alias("v")).collect()] == [1.5, None, None, None, None]
    assert [r.v for r in x.select(C.typed_cell(F.col("t"), "boolean").alias("v")).collect()] == [None, None, None, None, True]
    items = spark.createDataFrame([(1, "s", None, 1, "b"), (1, "s", None, 0, " a "), (2, "s", None, 5, "A"), (2, "s", None, 6, "B"), (3, "s", "v", 0, "A"), (3, "s", "v", 1, "B")], "session int, source string, algorithm_version string, position int, ticker string")
    import hashlib
    import json

    want = hashlib.sha256(json.dumps({"source": "s", "algorithm_version": None, "snapshot": {}, "items": [["A", {}], ["B", {}]]}, sort_keys=True).encode()).hexdigest()
    prints = {r.session: r.fingerprint for r in C.session_fingerprints(items).collect()}
    assert prints[1] == prints[2] == want != prints[3]
    assert {r.session: r.outcome for r in C.resumed(C.session_fingerprints(items)).collect()} == {1: "created", 2: "resumed", 3: "created"}


def test_quarters_of_a_label(spark):
    months = [("lead", 2001, m) for m in (3, 4, 5, 6)] + [("hole", 2001, m) for m in (1, 2, 3, 4, 6, 7, 8, 9)] + [("gap", 2001, m) for m in (1, 2, 3, 7, 8, 9)] + [("open", 2001, m) for m in (1, 2, 3, 4)]
    rows = spark.createDataFrame([(s, date(y, m, 1)) for s, y, m in months], "symbol string, bar_date date")
    got = {r.symbol: (r.quarters, r.fault) for r in G.quarter_verdicts(rows).collect()}
    assert got == {"lead": (1, None), "hole": (3, "incomplete_quarter"), "gap": (2, "gap"), "open": (2, "open_cutoff")}


def test_lines_of_a_label(spark):
    rows = [("a", 0, 10.0, 10), ("a", 4, 14.0, 10), ("b", 3, 5.0, 10), ("b", 3, 6.0, 10), ("c", 0, 10.0, 10), ("c", 1, 5.0, 10)]
    got = {r.k: r for r in G.fitted_lines(spark.createDataFrame(rows, "k string, idx int, price double, projected_idx int"), ["k"]).collect()}
    assert (got["a"].slope_per_bar, got["a"].value_at_cutoff, got["a"].slope_pct_per_year, got["a"].direction, got["a"].fit_error_pct) == (1.0, 20.0, 20.0, "rising", 0.0)
    assert got["b"].fault == "one_candle" and got["c"].fault == "not_positive" and got["c"].direction is None


def test_excluded_highs_and_edges(spark):
    day = lambda m, d=1: date(2001, m, d)
    pts = lambda rows: spark.createDataFrame(rows, "episode string, day date")
    got = G.excluded_highs(pts([("a", day(1)), ("a", day(2)), ("a", day(5)), ("b", day(1))]), pts([("a", day(3)), ("a", day(5)), ("a", day(5))])).collect()
    assert {r.episode: (r.expected_count, r.incorrectly_selected, r.rejected) for r in got} == {"a": (3, 2, 1), "b": (1, 0, 1)}
    e = spark.createDataFrame([("a", "r", "x"), ("a", "r", "y")], "episode string, parent string, id string")
    p = spark.createDataFrame([("a", "1", "2"), ("a", "1", "9")], "episode string, parent string, id string")
    pairs = spark.createDataFrame([("a", "1", "r"), ("a", "2", "x")], "episode string, predicted_id string, expected_id string")
    assert [tuple(r) for r in G.edge_counts(e, p, pairs).collect()] == [("a", 1, 1, 1)]


def test_pixels(spark):
    x = spark.range(1)
    price = lambda y: x.select(D.price_at(F.lit(y), F.lit(10.0), F.lit(100.0), F.lit(50.0), F.lit(0.0)).alias("p")).first().p
    assert (price(10.0), price(60.0), price(500.0), price(-5.0)) == (50.0, 25.0, 0.0, 50.0)
    assert x.select(D.kind_of(F.lit(None).cast("string")).alias("k")).first().k == "major_high"
    got = D.universe(spark.createDataFrame([(1, "a"), (2, " brk.b"), (3, "c")], "place int, ticker string"), spark.createDataFrame([(1, "A"), (2, "c"), (3, " ")], "place int, ticker string"), 2)
    assert [(r.ticker, r.part) for r in got.orderBy("part", "place").collect()] == [("A", 0), ("BRK-B", 0), ("C", 1)]
