"""What made queries grow faster than their tables."""

import datetime

from basewatch.operators import peaks, structures


def test_best_pairs_work_out_a_lines_touches_once(spark):
    # a filter over touches that Spark moves below their column works them out again, for every close of the line
    bars = spark.createDataFrame([("a", i, 1.0) for i in range(3)], "symbol string, idx int, close double").repartition(2)
    swings = spark.createDataFrame([("a", 1, datetime.date(2020, 1, 1), 1.0, 20.0)], "symbol string, idx int, bar_date date, price double, prominence_pct double").repartition(2)
    plan = peaks.best_pairs(swings, bars)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("aggregate(") <= 3  # once each for majors and touches, and no more than once to see whether there are any


def test_a_labels_tree_is_dealt_once_however_deep(spark, monkeypatch):
    # each round of pointers was a join of all structures that dealt them anew, and a table of its own
    kept, keep = [], structures.written
    monkeypatch.setattr(structures, "written", lambda df, name: kept.append(df) or keep(df, name))
    day = datetime.date(2020, 1, 1)
    tree = [(1, i, f"n{i}", f"n{i - 1}" if i else None, "parent_child" if 0 < i < 39 else "child" if i else "parent", "primary", day) for i in range(40)]
    tree = spark.createDataFrame(tree, "episode int, nth int, id string, parent_id string, relationship string, selection string, recognition date")
    labels = spark.createDataFrame([(1, "coil", "n39", datetime.date(2021, 6, 1), datetime.date(2021, 6, 30), datetime.datetime(2021, 7, 1))], "episode int, shape string, active_id string, cutoff date, decision_as_of date, labeled_at timestamp")
    some = spark.createDataFrame([], "episode int, nth int, id string, structure_id string, kind string, trigger date, resolution date, retest_state string")
    assert [(r.fault, r.faults) for r in structures.label_contract(labels, tree, some, some, some).collect()] == [(None, None)]
    plan = kept[0]._jdf.queryExecution()
    assert len(kept) == 1 and "Join" not in plan.optimizedPlan().toString() and plan.executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert plan.optimizedPlan().toString().count("aggregate(") == 1  # a filter over what is worked out would do it twice
