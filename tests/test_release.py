"""Gates from one set of resampled setups, and what a release may not show, against plain versions."""

import json
import random
import re

import numpy as np
import pytest

from basewatch.operators import evaluate as E
from basewatch.operators import release as R

ITEMS = "setup string, expected string, predicted string, tp int, fp int, fn int, expected_action string, predicted_action string, false_action boolean, correction boolean, critical boolean"


def items(n, rng, acts=True):
    state = lambda: rng.choice(["forming", "ready", "late"])
    return [(f"s{rng.randrange(n)}", state(), state(), rng.randrange(4), rng.randrange(3), rng.randrange(3), rng.choice(["actionable", "watch"]), rng.choice(["actionable", "avoid"]) if acts else "avoid", rng.random() < 0.3, rng.random() < 0.4, rng.random() < 0.1) for _ in range(3 * n)]


def plain_gates(rows, labels):
    f1 = lambda tp, fp, fn: 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else None
    acts = sum(r[7] == "actionable" for r in rows)
    macro = sum(f1(sum(r[1] == r[2] == x for r in rows), sum(r[1] != x == r[2] for r in rows), sum(r[1] == x != r[2] for r in rows)) or 0.0 for x in labels) / len(labels)
    return [f1(*(sum(r[i] for r in rows) for i in (3, 4, 5))), macro, sum(r[6] == r[7] == "actionable" for r in rows) / acts if acts else None, sum(r[8] for r in rows) / acts if acts else None, sum(r[9] for r in rows) / len(rows), sum(r[10] for r in rows) / len(rows)]


def got(spark, rows, **named):
    return {r.gate: r for r in E.gate_confidence(spark.createDataFrame(rows, ITEMS), **named).collect()}


def test_gates_equal_a_plain_bootstrap(spark):
    rows = items(120, random.Random(1))
    labels = sorted({x for r in rows for x in r[1:3]})
    mine, of = got(spark, rows, samples=4000), {}
    for r in rows:
        of.setdefault(r[0], []).append(r)
    rng, names = np.random.default_rng(7), sorted(of)
    drawn = np.array([plain_gates([r for k in rng.integers(len(names), size=len(names)) for r in of[names[k]]], labels) for _ in range(600)])
    for i, gate in enumerate(E.GATES):
        low, high = np.percentile(drawn[:, i], [2.5, 97.5])
        assert mine[gate].point == pytest.approx(plain_gates(rows, labels)[i]) and mine[gate].setups == len(names)
        assert (mine[gate].low, mine[gate].high) == pytest.approx((low, high), abs=0.25 * (high - low))


def test_gates_do_not_depend_on_order_and_know_when_they_cannot_tell(spark):
    rows = items(40, random.Random(2))
    assert got(spark, rows, samples=500) == got(spark, rows[::-1], samples=500)
    none = got(spark, items(40, random.Random(3), acts=False), samples=200)
    assert none["action_precision"].point is None and none["action_precision"].low is None and none["top_f1"].low is not None
    # most replicates leave out the one setup that acts: some replicate has no value, so there are no bounds
    rare = [(*r[:7], "actionable" if r[0] == "s1" else "avoid", *r[8:]) for r in rows] + [("s1", "forming", "forming", 1, 0, 0, "actionable", "actionable", False, False, False)]
    assert got(spark, rare, samples=500)["action_precision"].point is not None and got(spark, rare, samples=500)["action_precision"].low is None
    one = got(spark, [("s", *r[1:]) for r in rows], samples=100)
    assert one["top_f1"].point is not None and one["top_f1"].low is None
    assert got(spark, []) == {}


def plain_keys(value, path="$", depth=1):
    if isinstance(value, dict):
        for k, v in value.items():
            yield f"{path}.{k}", k, depth
            yield from plain_keys(v, f"{path}.{k}", depth + 1)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from plain_keys(v, f"{path}[{i}]", depth + 1)


def planted(depth, key):
    value = {key: {"ok": 1}}
    for d in range(1, depth):
        value = {"x": [value, 3]} if d % 2 else {"y": value, "z": None}
    return value


def test_keys_are_found_at_every_depth(spark):
    values = [planted(d, k) for d in range(1, 7) for k in ("coilScore", "lid-grade", "MAJOR_HIGHS", "harmless")] + [{}, [], 3, "grade", [[[]]], {"text": "lifecycle"}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "{broken"), (902, "")]
    df = spark.createDataFrame(rows, "id int, j string")
    want = sorted((i, *x) for i, v in enumerate(values) for x in plain_keys(v))
    assert sorted(map(tuple, R.key_paths(df, "id", "j").collect())) == want
    snake = lambda k: re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", k).replace("-", "_").lower()
    assert sorted(map(tuple, R.leaks(df, "id", "j").collect())) == sorted((i, p) for i, p, k, _ in want if snake(k) in R.FORBIDDEN)
    assert len({i for i, p, k, _ in want if snake(k) in R.FORBIDDEN}) == 18
    assert R.leaks(df.limit(0), "id", "j").count() == 0


def test_release_faults(spark):
    good = "ab" * 32
    item = lambda s, p, t="T", rev=True, h=good, sample="s1", payload="{}": (s, p, t, rev, h, sample, payload)
    items_ = [item(1, 1), item(1, 2, "B", False, sample=None), item(2, 1, "X"), item(2, 2, "B", True, "short", None, '{"a": [{"lifecycle": 1}]}'), item(3, 1), item(3, 2, "B", False), item(3, 3, "C", sample="s2")]
    manifest = [(s, p, t, rev) for s in (1, 2, 3, 4) for p, t, rev in ((1, "T", True), (2, "B", False))]
    got = {r.session: (r.n_items, r.n_reviewable, r.faults) for r in R.release_faults(spark.createDataFrame(items_, "session int, position int, ticker string, reviewable boolean, bars_hash string, sample_id string, payload string"), spark.createDataFrame(manifest, "session int, position int, ticker string, reviewable boolean")).collect()}
    assert got == {1: (2, 1, None), 2: (2, 2, "order,reviewability,bars_hash,sample_id,leak"), 3: (3, 2, "count,sample_id"), 4: (0, 0, "count")}
