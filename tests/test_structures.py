"""Structure assignment, state entries and the label contract, against plain versions and planted faults."""

import itertools
import random
from datetime import date, datetime

import pytest

from basewatch.operators import structures as S


def every_choice(pairs):
    cost = {(e, p): w for e, p, w in pairs}
    rows = sorted({e for e, _, _ in pairs})
    best = None
    for choice in itertools.product(*[[None, *sorted({p for x, p, _ in pairs if x == e})] for e in rows]):
        taken = [p for p in choice if p is not None]
        if len(taken) == len(set(taken)):
            chosen = tuple((e, p) for e, p in zip(rows, choice, strict=True) if p is not None)
            key = (-len(chosen), round(sum(cost[x] for x in chosen), 12), chosen)
            best = key if best is None or key < best else best
    return list(best[2])


def test_assignment_equals_all_choices():
    r = random.Random(3)
    for _ in range(250):
        n, m = r.randint(1, 6), r.randint(1, 6)
        pairs = [(e, p, r.choice([0.25, 0.5, 1.0, 1.5])) for e in range(n) for p in range(m) if r.random() < 0.55]
        if pairs:
            edges = {}
            for e, p, w in sorted(pairs):
                edges.setdefault(e, []).append((p, w))
            assert S.assigned(pairs) == S._by_paths(edges) == S._by_masks(edges) == every_choice(pairs)


def test_large_sides_are_exact():
    r = random.Random(5)
    pairs = [(e, p, float(r.randint(0, 40))) for e in range(30) for p in range(28) if r.random() < 0.3]
    got = S.assigned(pairs)
    assert len(got) == len({e for e, _ in got}) == len({p for _, p in got})
    cost = {(e, p): w for e, p, w in pairs}
    total = sum(cost[x] for x in got)
    # no exchange along a circle of pairs makes it cheaper, no path makes it longer (Berge, and the absence of negative circles)
    of_col, of_row = {p: e for e, p in got}, dict(got)
    edges = {e: [(p, w) for x, p, w in pairs if x == e] for e in range(30)}
    far = dict.fromkeys(range(30), 0.0)
    for round_ in range(40):
        changed = False
        for e in range(30):
            for p, w in edges[e]:
                if p in of_col and of_row.get(e) != p and e in of_row and far[e] + w - cost[of_col[p], p] < far[of_col[p]] - 1e-9:
                    far[of_col[p]], changed = far[e] + w - cost[of_col[p], p], True
        if not changed:
            break
    assert not changed and total > 0
    reach, todo = set(), [e for e in range(30) if e not in of_row]
    while todo:
        for p, _ in edges[todo.pop()]:
            assert p in of_col
            if of_col[p] not in reach:
                reach.add(of_col[p])
                todo.append(of_col[p])


def structure(episode, nth, id, value=100.0, slope=0.0, anchors=("2020-01-15", "2021-01-15"), role="primary_lid", direction="flat", selection="primary", relationship="standalone", parent=None):
    return (episode, nth, id, role, "line", direction, value, slope, [date.fromisoformat(a) for a in anchors], selection, relationship, parent)


SHAPE = "episode int, nth int, id string, role string, boundary_kind string, direction string, value double, slope_pct double, anchors array<date>, selection string, relationship string, parent_id string"


def test_pairs_take_the_nearest_line_that_leaves_most(spark):
    expected = [structure(1, 0, "a"), structure(1, 1, "b", value=103.0, selection="alternate"), structure(1, 2, "c", role="support", relationship="child", parent="a"), structure(2, 0, "x")]
    predicted = [
        structure(1, 0, "p", value=102.0), structure(1, 1, "q", value=99.0, selection="alternate"), structure(1, 2, "r", role="support", relationship="child", parent="q"), structure(1, 3, "far", value=120.0),
        structure(2, 0, "late", anchors=("2020-01-15", "2022-01-15")), structure(2, 1, "steep", slope=1.5), structure(2, 2, "nan", value=float("nan")), structure(2, 3, "spare", anchors=("2020-01-15",)),
    ]
    e, p = spark.createDataFrame(expected, SHAPE), spark.createDataFrame(predicted, SHAPE)
    assert sorted((r.episode, r.expected_id, r.predicted_id) for r in S.assignments(S.candidates(e, p)).collect()) == [(1, "a", "q"), (1, "b", "p"), (1, "c", "r")]
    labels = spark.createDataFrame([(1, "a"), (2, None)], "episode int, active_id string")
    one, two = S.structure_metrics(labels, e, p).orderBy("episode").collect()
    assert (one.matched_tp, one.matched_fp, one.matched_fn) == (3, 1, 0) and (one.primary_tp, one.primary_fp, one.primary_fn) == (1, 2, 1) and (one.edge_tp, one.edge_fp, one.edge_fn) == (1, 0, 0)
    assert one.active_matched and not one.active_selection_correct and one.active_direction_correct and one.active_error_pct == 1.0
    assert (two.matched_tp, two.matched_fp, two.matched_fn) == (0, 4, 1) and not two.active_matched and two.active_direction_correct is None


def test_states_entered_are_matched_state_by_state(spark):
    rows = [("s", date(2020, 3, 1), "forming", "forming"), ("s", date(2020, 6, 1), "ready", "forming"), ("s", date(2020, 9, 1), "ready", "ready"), ("t", date(2020, 3, 1), "a", "b"), ("u", date(2020, 3, 1), "a", None), ("u", date(2021, 3, 1), "a", "a")]
    got = {r.state: (r.tp, r.fp, r.fn, r.error) for r in S.transition_timing(spark.createDataFrame(rows, "setup string, cutoff date, expected string, predicted string")).collect()}
    assert got == {"ready": (1, 0, 0, 1), "a": (0, 1, 0, 0)}


L = "episode int, shape string, active_id string, cutoff date, decision_as_of date, labeled_at timestamp"
T = "episode int, nth int, id string, parent_id string, relationship string, selection string, recognition date"
E = "episode int, nth int, id string, structure_id string, kind string, trigger date, resolution date, retest_state string"
R = "episode int, id string, structure_id string"
D = date(2020, 1, 1)
TREE = [("a", None, "parent", "primary"), ("b", "a", "parent_child", "primary"), ("c", "a", "child", "alternate"), ("d", "b", "child", "primary")]


def label(episode=1, shape="coil", active="d", cutoff=date(2021, 6, 1), decided=date(2021, 6, 30), at=datetime(2021, 7, 1)):
    return (episode, shape, active, cutoff, decided, at)


def event(nth, kind, day, structure="a", state=None, resolution=None, id=None):
    return (1, nth, id or f"e{nth}", structure, kind, day, resolution, state)


def contract(spark, labels=None, tree=TREE, bottoms=(), events=(), phases=()):
    rows = [(1, n, *x, D) for n, x in enumerate(tree)]
    frames = [spark.createDataFrame(list(x), s) for x, s in ((labels or [label()], L), (rows, T), (bottoms, R), (events, E), (phases, R))]
    return [(r.fault, r.faults) for r in S.label_contract(*frames).collect()]


BROKEN = {
    "open_cutoff": {"labels": [label(cutoff=date(2021, 5, 1))]}, "early_decision": {"labels": [label(decided=date(2021, 6, 29))]}, "late_decision": {"labels": [label(decided=date(2021, 7, 2))]},
    "duplicate_structure": {"tree": [*TREE, ("d", "b", "child", "alternate")], "labels": [label(active="b")]}, "unknown_parent": {"tree": [*TREE, ("z", "nobody", "child", "primary")]},
    "cyclic_parents": {"tree": [*TREE, ("x", "z", "parent_child", "primary"), ("y", "x", "parent_child", "primary"), ("z", "y", "parent_child", "primary")]},
    "wrong_relationship": {"tree": [("a", None, "standalone", "primary"), *TREE[1:]]}, "primary_count": {"tree": [*TREE, ("e", None, "standalone", "primary")]}, "no_active": {"labels": [label(active=None)]},
    "unknown_active": {"labels": [label(active="nobody")]}, "active_not_primary": {"labels": [label(active="c")]}, "unknown_reference": {"bottoms": [(1, "b1", "nobody")]},
    "events_out_of_order": {"events": [event(0, "failed_breakout", date(2021, 1, 1), resolution=date(2021, 4, 1)), event(1, "breakout", date(2021, 3, 1))]},
    "event_before_recognition": {"events": [event(0, "breakout", date(2019, 12, 31))]}, "no_active_breakout": {"events": [event(0, "breakout", D), event(1, "retest", D, state="failed"), event(2, "continuation", D)]},
    "duplicate_bottom": {"bottoms": [(1, "b", None)] * 2}, "duplicate_event": {"events": [event(0, "breakout", D), event(1, "breakout", D, id="e0")]}, "duplicate_phase": {"phases": [(1, "p", "a")] * 2},
}


@pytest.mark.parametrize("fault", sorted(BROKEN))
def test_each_planted_fault_is_found_and_none_else(spark, fault):
    assert contract(spark, **BROKEN[fault]) == [(fault, fault)]


def test_whole_labels_and_first_faults(spark):
    good = [event(0, "breakout", D), event(1, "retest", D, state="deep"), event(2, "continuation", D), event(3, "invalidation", D), event(4, "breakout", date(2018, 1, 1), structure=None), event(5, "failed_breakout", D, resolution=D)]
    assert contract(spark, events=good, bottoms=[(1, "b", "d")], phases=[(1, "b", None)]) == [(None, None)]
    assert contract(spark, labels=[label(active=None)], tree=[]) == [("no_structure", "no_structure,no_active")]
    # of two faults that are looked for event by event the earlier event's comes first
    late = [event(0, "continuation", D), event(1, "breakout", date(2021, 1, 1)), event(2, "breakout", date(2020, 6, 1))]
    assert contract(spark, events=late) == [("no_active_breakout", "events_out_of_order,no_active_breakout")]
    deep = [("n0", None, "parent", "primary"), *[(f"n{i}", f"n{i - 1}", "parent_child" if i < 39 else "child", "primary") for i in range(1, 40)]]
    assert contract(spark, labels=[label(active="n39")], tree=deep) == [(None, None)]


def test_bottoms_are_matched_by_role(spark):
    rows = [(1, "major_bottom", date(2020, 1, 5)), (1, "major_bottom", date(2021, 1, 5)), (1, "undercut", date(2020, 5, 1)), (1, "undercut", date(2020, 5, 1)), (2, "outlier", date(2020, 5, 1)), (3, "major_bottom", None)]
    lows = [(1, date(2020, 4, 1)), (1, date(2022, 1, 1)), (2, date(2020, 5, 1))]
    got = S.bottom_metrics(spark.createDataFrame(rows, "episode int, role string, day date"), spark.createDataFrame(lows, "episode int, day date")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "major_bottom", True, 2, 1, 1, 1), (1, "undercut", False, 1, None, None, None), (2, "major_bottom", True, 0, 0, 1, 0), (2, "outlier", False, 1, None, None, None)], key=str)


def plain_faults(rows):
    """The faults of one episode's structures (id, parent, relationship, selection), and whether each id's chain is primary, one by one."""
    out, stands = set(), {x[0]: x for x in rows if x[0] is not None}
    parents = {x[1] for x in rows if x[1] is not None}
    primary = {}
    for id in stands:
        seen, up, ok = [], id, True
        while up in stands and up not in seen:
            seen.append(up)
            ok &= stands[up][3] == "primary"
            up = stands[up][1]
        primary[id] = ok
        if up in seen:
            out |= {("cyclic_parents", n) for n, x in enumerate(rows) if x[0] == id}
    groups = {}
    for n, (id, parent, relationship, selection) in enumerate(rows):
        if [x[0] for x in rows].count(id) > 1:
            out.add(("duplicate_structure", 0))
        if id is None:
            continue
        if parent is not None and parent not in stands:
            out.add(("unknown_parent", n))
        if relationship != ("parent_child" if parent is not None and id in parents else "child" if parent is not None else "parent" if id in parents else "standalone"):
            out.add(("wrong_relationship", n))
        groups.setdefault(parent, []).append((n, selection))
    return out | {("primary_count", g[0][0]) for g in groups.values() if [s for _, s in g].count("primary") != 1}, primary


def test_trees_equal_a_plain_walk(spark):
    r = random.Random(7)
    names = [*"abcdefgh", None]
    trees = {e: [(r.choice(names[: r.choice((3, 6, 9))]), r.choice(names), r.choice(["standalone", "parent", "child", "parent_child", None]), r.choice(["primary", "primary", "alternate", None])) for _ in range(r.randint(1, 9))] for e in range(150)}
    trees |= {150 + i: [(f"n{j:02}", f"n{j - 1:02}" if j else end, "child", "primary" if j != odd else "alternate") for j in range(45)] for i, (end, odd) in enumerate([(None, 99), ("n44", 99), ("nobody", 0), ("n07", 20)])}
    active = {e: r.choice([x[0] for x in t]) for e, t in trees.items()}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    none = [spark.createDataFrame([], s) for s in (R, E, R)]
    tree = frame([(e, n, *x, D) for e, t in trees.items() for n, x in enumerate(t)] + [(None, 0, "a", "a", "child", "primary", D)] * 2, T)
    got = {e: set() for e in trees}
    for row in S.label_faults(frame([label(episode=e, active=a) for e, a in active.items()], L), tree, *none).collect():
        assert (row.fault, row.nth) not in got[row.episode]
        got[row.episode].add((row.fault, row.nth))
    for e, t in trees.items():
        faults, primary = plain_faults(t)
        if active[e] is None:
            faults.add(("no_active", 0))
        elif not primary[active[e]]:
            faults.add(("active_not_primary", 0))
        assert got[e] == faults, (e, t)
