"""Small charts with known answers."""

import re
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from basewatch.functions.scalars import grade_for_slope
from basewatch.operators import bars, breakout, evaluate, peaks, reviews


def months(values, start=2010):
    return [("S", date(start + i // 12, i % 12 + 1, 1), *[float(v)] * 4, 100.0 * (i % 3 + 1)) for i, v in enumerate(values)]


SCHEMA = "symbol string, bar_date date, open double, high double, low double, close double, volume double"


def test_pivot_on_a_plateau_is_its_first_bar(spark):
    b = bars.clean(spark.createDataFrame(months([1.0, 1, 5, 5, 1, 1, 1]), SCHEMA))
    assert [r.idx for r in peaks.pivots(b, 2, 2).collect()] == [2]


def test_majors_keep_their_distance(spark):
    p = spark.createDataFrame([("S", 50, 1.0, 20.0), ("S", 54, 1.0, 30.0), ("S", 80, 1.0, 25.0)], "symbol string, idx int, price double, prominence_pct double")
    assert sorted(r.idx for r in peaks.separated(p, 15.0, 9).collect()) == [54, 80]


def test_grades(spark):
    slopes = {-5.0: None, -2.0: "B", -0.5: "A", 0.0: "A", 4.9: "A", 5.0: "B", 6.4: "B", 6.5: "C", 11.9: "C", 12.0: None}
    rows = spark.createDataFrame([(s,) for s in slopes], "s double").select("s", grade_for_slope(F.col("s")).alias("g")).collect()
    assert {r.s: r.g for r in rows} == slopes


def test_a_quarters_volume_needs_all_months(spark):
    b = spark.createDataFrame(months([1.0, 2, 3, 4, 5])[:5], SCHEMA)
    q = {r.q_idx: r for r in bars.quarterly(bars.clean(b)).collect()}
    assert q[0].volume == 600.0 and q[1].volume is None and q[0].high_src_idx == 2


def test_breakout_by_persistence_and_failure(spark):
    def state(closes):
        rows = [("S", i, *[float(c)] * 3, 100.0, 5.0) for i, c in enumerate(closes)]
        return breakout.assess(spark.createDataFrame(rows, "symbol string, q_idx int, high double, low double, close double, lid double, band_pct double")).first()

    assert state([90.0, 95]).state == "sealed"
    assert state([90.0, 110]).state == "breaking_out"
    out = state([90.0, 110, 125])
    assert (out.state, out.via, out.confirmed_q) == ("broken_out", "persistence", 2)
    assert (state([90.0, 110, 95]).state, state([90.0, 110, 95]).failed) == ("sealed", 1)
    assert state([90.0, 110, 102, 112]).via == "retest_continuation"


def test_later_bars_change_nothing_before_them(spark):
    b = spark.createDataFrame(months([float(10 + (i * 7) % 13) for i in range(80)]), SCHEMA)
    cut = F.lit("2015-01-01").cast("date")
    early = bars.quarterly(bars.clean(b.filter(F.col("bar_date") <= cut)))
    assert early.exceptAll(bars.quarterly(bars.clean(b, cut))).count() == 0


def test_reviews_fold(spark):
    log = spark.createDataFrame([(1, "A", "corrected", 5.0), (2, "A", "approved", 0.0), (3, "B", "corrected", 7.0), (4, "B", "capture", 0.0), (5, "C", "revoke", 0.0)], "id long, ticker string, decision string, price double")
    got = {r.ticker: (r.override, r.state) for r in reviews.effective(log).collect()}
    assert got == {"A": (None, "approved"), "B": (7.0, "corrected"), "C": (None, None)}


def test_date_matching():
    assert evaluate.best_pairs([], [1], 1) == [] == evaluate.best_pairs([1], [], 1)
    assert evaluate.best_pairs([1, 2], [2, 3], 1) == [(0, 0, 1), (1, 1, 1)]  # the near pair alone would lose one


def test_date_matching_against_all_assignments():
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(60):
        e, p = (sorted(rng.sample(range(12), rng.randrange(5))) for _ in range(2))
        best = (0, 0)
        for n in range(min(len(e), len(p)) + 1):
            for some in itertools.combinations(range(len(e)), n):
                for others in itertools.permutations(range(len(p)), n):
                    off = [abs(e[i] - p[j]) for i, j in zip(some, others)]
                    if all(x <= 2 for x in off):
                        best = min(best, (-n, sum(off)))
        got = evaluate.best_pairs(e, p, 2)
        assert (-len(got), sum(x for _, _, x in got)) == best
        assert len({i for i, _, _ in got}) == len({j for _, j, _ in got}) == len(got)


def test_matched_pairs_are_days(spark):
    from datetime import date

    rows = [("a", "expected", date(2001, 1, 5)), ("a", "expected", date(2001, 1, 5)), ("a", "predicted", date(2001, 5, 1)), ("a", "predicted", date(2002, 5, 1)), ("b", "predicted", date(2001, 1, 1))]
    got = {r.episode: r for r in evaluate.matched_pairs(spark.createDataFrame(rows, "episode string, kind string, day date"), 1).collect()}
    assert (got["a"].tp, got["a"].fp, got["a"].fn, got["a"].error) == (1, 1, 0, 1) and tuple(got["a"].pairs[0]) == (date(2001, 1, 5), date(2001, 5, 1), 1)
    assert (got["b"].tp, got["b"].fp, got["b"].fn) == (0, 1, 0)


def test_data_quality_on_no_rows(spark):
    assert bars.data_quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bootstrap_sums_equal_draw_by_draw(spark):
    r = np.random.default_rng(1)
    k, n = r.integers(0, 9, 50), 7
    picked, ends = r.integers(n, size=int(k.sum())), np.cumsum(k)
    for big in (10, 2**60):
        own = r.integers(-big, big, (n, 3))
        want = [[int(own[picked[e - m : e], i].sum()) for e, m in zip(ends, k, strict=True)] for i in range(3)]
        assert evaluate.drawn_sums(own, picked, k).tolist() == want


def test_bootstrap_shuffles_sums_of_many_blocks(spark):
    counts = spark.range(20_000).select(F.lit("m").alias("metric"), F.col("id").alias("setup"), (F.col("id") % 3).alias("good"), F.lit(3).alias("n"))
    drawn = evaluate.replicates(counts, ["good", "n"], 10, 0)
    sizes = counts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    drawn = drawn.collect()
    assert len(drawn) == 10 and all(r.n == 60_000 for r in drawn)
    # 256 blocks in at most 4 tasks: one row of sums for 32 blocks, not for each
    into = [p for p in re.findall(r"FlatMapGroupsInPandas \[([^\]]*)\]", evaluate.replicates(counts, ["good", "n"], 10, 0)._jdf.queryExecution().optimizedPlan().toString())]
    assert int(sizes) <= 8 and into and all("part" in p for p in into)


def test_bootstrap_draws_whole_replicates_in_blocks(spark):
    import inspect

    import numpy as np

    assert inspect.signature(evaluate.bootstrap).parameters["samples"].default == 10_000
    rows = [("a", i, i % 3, 1 + i % 4) for i in range(900)] + [("one", 1, 1, 2), ("empty", 1, 0, 0), ("empty", 2, 1, 1)]
    counts = spark.createDataFrame(rows, "metric string, setup long, good long, n long")
    got = {r.metric: r for r in evaluate.bootstrap(counts).collect()}
    good, n = (np.array([r[k] for r in rows[:900]]) for k in (2, 3))
    at = np.random.default_rng(1).integers(900, size=(10_000, 900))
    want = np.quantile(good[at].sum(1) / n[at].sum(1), [0.025, 0.975])
    assert np.allclose([got["a"].low, got["a"].high], want, atol=0.003) and got["a"].point == good.sum() / n.sum() and got["a"].setups == 900
    assert (got["one"].point, got["one"].low, got["one"].high) == (0.5, None, None) and got["empty"].low is None and got["empty"].point == 1.0
    again = {r.metric: r for r in evaluate.bootstrap(counts.repartition(7)).collect()}
    assert again == got
