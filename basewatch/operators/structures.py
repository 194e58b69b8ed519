"""Structures of a label against those of an analysis, and the contract that a label's structures and events keep.

A structure is a boundary with its role, kind, direction, line and anchors. Structures aren't ordered,
so their matching is an assignment on a graph: a pair is eligible where role, kind and direction agree,
the lines' values and slopes are near enough and the anchors are linked; of all one-to-one choices that
with the most pairs stands, of these the one of the least error, of these the first in the order of the
lists. Eligible pairs come from one join on the episode and what has to agree; an episode's pairs (a
label has sixteen structures at most) are then one row's array.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from basewatch.operators.evaluate import _pairing, matched_pairs
from basewatch.operators.gold import edge_counts
from basewatch.sources.tables import written

#: How far a line may be off in percent, in percent a year, and an anchor in quarters.
VALUE_PCT, SLOPE_PCT, QUARTERS = 5.0, 1.0, 1
#: Up to so many predicted structures, ties are told apart by the total rounded to twelve digits; beyond, by each pair's.
MASKED = 12


def _by_masks(edges: dict[int, list[tuple[int, float]]]) -> list[tuple[int, int]]:
    """The best choice by a table over the predicted structures that are taken."""
    rows, bit = sorted(edges), {p: 1 << i for i, p in enumerate(sorted({p for ps in edges.values() for p, _ in ps}))}

    @lru_cache(maxsize=None)
    def best(i: int, taken: int) -> tuple[int, float, tuple]:
        if i == len(rows):
            return 0, 0.0, ()
        ways = [best(i + 1, taken)]
        for p, cost in edges[rows[i]]:
            if not taken & bit[p]:
                missing, total, rest = best(i + 1, taken | bit[p])
                ways.append((missing - 1, total + cost, ((rows[i], p), *rest)))
        return min(ways, key=lambda w: (w[0], round(w[1], 12), w[2]))

    return list(best(0, 0)[2])


def _by_paths(edges: dict[int, list[tuple[int, float]]]) -> list[tuple[int, int]]:
    """The same by cheapest augmenting paths, for any size: a weight is a whole number with the order of the lists as its last digits."""
    rows, cols = sorted(edges), sorted({p for ps in edges.values() for p, _ in ps})
    base = len(cols) + 1
    place = {e: base ** (len(rows) - 1 - i) for i, e in enumerate(rows)}
    rank = {p: i for i, p in enumerate(cols)}
    weight = {(e, p): round(cost * 10**12) * base ** len(rows) + (rank[p] - len(cols)) * place[e] for e in rows for p, cost in edges[e]}
    of_row: dict[int, int] = {}
    of_col: dict[int, int] = {}
    while True:
        far = dict.fromkeys((e for e in rows if e not in of_row), 0)
        near: dict[int, tuple[int, int]] = {}  # cost of getting to a column, and the row before it
        changed = True
        while changed:
            changed = False
            for (e, p), w in weight.items():
                if e in far and of_row.get(e) != p and (p not in near or far[e] + w < near[p][0]):
                    near[p] = far[e] + w, e
                    changed = True
                    if p in of_col:
                        far[of_col[p]] = near[p][0] - weight[of_col[p], p]
        ends = [(near[p][0], p) for p in near if p not in of_col]
        if not ends:
            return sorted(of_row.items())
        p = min(ends)[1]
        while True:
            e = near[p][1]
            before = of_row.get(e)
            of_row[e], of_col[p] = p, e
            if before is None:
                break
            p = before


def assigned(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """pairs(expected, predicted, cost), places in two lists -> the choice that stands. Each connected part is solved by itself."""
    edges: dict[int, list[tuple[int, float]]] = {}
    for e, p, cost in sorted(pairs):
        edges.setdefault(e, []).append((p, cost))
    out, left = [], dict(edges)
    while left:
        part, todo = {}, [next(iter(left))]
        while todo:
            e = todo.pop()
            if e in left:
                part[e] = left.pop(e)
                reach = {p for p, _ in part[e]}
                todo += [x for x, ps in left.items() if any(p in reach for p, _ in ps)]
        out += (_by_masks if len({p for ps in part.values() for p, _ in ps}) <= MASKED else _by_paths)(part)
    return sorted(out)


def _assignment():
    @pandas_udf("array<struct<expected: int, predicted: int>>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([assigned([(r["e"], r["p"], r["cost"]) for r in some]) for some in rows], dtype=object)

    return run


def candidates(expected: DataFrame, predicted: DataFrame, value_pct: float = VALUE_PCT, slope_pct: float = SLOPE_PCT, quarters: int = QUARTERS) -> DataFrame:
    """Both (episode, nth, id, role, boundary_kind, direction, value, slope_pct, anchors array<date>, ...) -> eligible pairs with their errors.

    Anchors are linked if all predicted ones stand within quarters of one of the label's each, two of them at least (or all, if the label has fewer)."""
    e, p = expected.alias("e"), predicted.alias("p")
    alike = F.col("e.episode") == F.col("p.episode")
    for c in ("role", "boundary_kind", "direction"):
        alike = alike & F.col(f"e.{c}").eqNullSafe(F.col(f"p.{c}"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf)
    off = F.abs(F.col("p.value") - F.col("e.value")) / F.col("e.value") * 100
    slope = F.abs(F.col("p.slope_pct") - F.col("e.slope_pct"))
    near = (F.col("e.value") > 0) & finite(F.col("p.value")) & finite(F.col("p.slope_pct")) & finite(F.col("e.slope_pct")) & (off <= value_pct) & (slope <= slope_pct)
    days = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<date>")))))
    both = e.join(p, alike & near).select(
        "e.episode", F.col("e.nth").alias("e"), F.col("p.nth").alias("p"), F.col("e.id").alias("expected_id"), F.col("p.id").alias("predicted_id"), F.col("e.selection").alias("expected_selection"),
        F.col("p.selection").alias("predicted_selection"), off.alias("value_error_pct"), slope.alias("slope_error_pct"), days(F.col("e.anchors")).alias("ea"), days(F.col("p.anchors")).alias("pa"),
    )
    ordinals = lambda c: F.transform(c, lambda x: (F.year(x) * 4 + F.quarter(x)).cast("int"))
    both = both.withColumn("m", _pairing(quarters)(ordinals("ea"), ordinals("pa"))).filter((F.size("ea") > 0) & (F.size("m") >= F.least(F.lit(2), F.size("ea"))) & (F.size("m") == F.size("pa")))
    both = both.withColumn("anchor_error", F.aggregate("m", F.lit(0), lambda a, x: a + x["error"]))
    return both.withColumn("cost", F.col("value_error_pct") + F.col("slope_error_pct") + F.col("anchor_error") / 1000).drop("ea", "pa", "m")


def assignments(found: DataFrame) -> DataFrame:
    """candidates() -> the pairs that stand."""
    some = found.groupBy("episode").agg(F.collect_list(F.struct("e", "p", "cost")).alias("all"))
    chosen = some.select("episode", F.explode(_assignment()("all")).alias("c")).select("episode", F.col("c.expected").alias("e"), F.col("c.predicted").alias("p"))
    return found.join(chosen, ["episode", "e", "p"])


def structure_metrics(labels: DataFrame, expected: DataFrame, predicted: DataFrame, **tolerances: float) -> DataFrame:
    """labels(episode, active_id), structures as in candidates() with selection, relationship and parent_id -> one row an episode.

    Counts of pairs, primaries, alternates and parent-child edges, and how the active structure's own pair agrees."""
    pairs = written(assignments(candidates(expected, predicted, **tolerances)), "structure-pairs")
    so = lambda test: F.coalesce(test, F.lit(False))
    of = lambda df, name: df.groupBy("episode").agg(F.count("*").alias(name), *[F.count_if(so(F.col("selection") == s)).alias(f"{name}_{s}") for s in ("primary", "alternate")])
    both = lambda s: so((F.col("expected_selection") == s) & (F.col("predicted_selection") == s))
    hit = pairs.groupBy("episode").agg(F.count("*").alias("tp"), F.count_if(both("primary")).alias("tp_primary"), F.count_if(both("alternate")).alias("tp_alternate"))
    child = lambda df: df.filter("relationship = 'child'").select("episode", "id", F.col("parent_id").alias("parent"))
    edges = edge_counts(child(expected), child(predicted), pairs).select("episode", *[F.col(c).alias(f"edge_{c}") for c in ("tp", "fp", "fn")])
    own = labels.join(expected.select("episode", F.col("id").alias("active_id"), F.col("direction").alias("direction_expected")), ["episode", "active_id"], "left")
    active = own.join(pairs.select("episode", F.col("expected_id").alias("active_id"), "predicted_id", "predicted_selection", "value_error_pct"), ["episode", "active_id"], "left")
    x = active.join(of(expected, "n_e"), "episode", "left").join(of(predicted, "n_p"), "episode", "left").join(hit, "episode", "left").join(edges, "episode", "left")
    x = x.na.fill(0, [c for c in x.columns if c.startswith(("n_", "tp", "edge_"))])
    counts = []
    for name, part in (("matched", ""), ("primary", "_primary"), ("alternate", "_alternate")):
        tp = F.col(f"tp{part}")
        counts += [tp.alias(f"{name}_tp"), (F.col(f"n_p{part}") - tp).alias(f"{name}_fp"), (F.col(f"n_e{part}") - tp).alias(f"{name}_fn")]
    matched = F.col("predicted_id").isNotNull()
    return x.select("episode", *counts, "edge_tp", "edge_fp", "edge_fn", "active_id", matched.alias("active_matched"), so(F.col("predicted_selection") == "primary").alias("active_selection_correct"), F.when(F.col("direction_expected").isNotNull(), matched).alias("active_direction_correct"), F.round("value_error_pct", 6).alias("active_error_pct"))


def bottom_metrics(bottoms: DataFrame, lows: DataFrame) -> DataFrame:
    """bottoms(episode, role, day) and lows(episode, day), those of an analysis -> a row for each episode and role.

    Major bottoms are matched with the lows of pullbacks; an analysis gives no undercuts and outliers, so these are only counted."""
    major = bottoms.filter("role = 'major_bottom'").select("episode", F.lit("expected").alias("kind"), "day").unionByName(lows.select("episode", F.lit("predicted").alias("kind"), "day"))
    found = matched_pairs(major.filter("day IS NOT NULL"), QUARTERS).select("episode", F.lit("major_bottom").alias("role"), F.lit(True).alias("supported"), (F.col("tp") + F.col("fn")).alias("expected_count"), "tp", "fp", "fn")
    none = F.lit(None).cast("long")
    rest = bottoms.filter("role IN ('undercut', 'outlier')").groupBy("episode", "role").agg(F.count_distinct("day").alias("expected_count"))
    return found.unionByName(rest.select("episode", "role", F.lit(False).alias("supported"), "expected_count", none.alias("tp"), none.alias("fp"), none.alias("fn")))


def transition_timing(items: DataFrame, tolerance: int = QUARTERS) -> DataFrame:
    """items(setup, cutoff date, expected, predicted), checkpoints of setups -> a row for each state that is entered: tp, fp, fn and error of the days of entry.

    A setup enters a state at a checkpoint whose state isn't that of the one before; those with one checkpoint enter none.
    Days are matched state by state, over all setups: a state's distinct days of entry are one row's lists, as many as there are days."""
    w = Window.partitionBy("setup").orderBy("cutoff")
    seen = items.select("setup", "cutoff", F.row_number().over(w).alias("nth"), *[F.struct(F.col(k).alias("now"), F.lag(k).over(w).alias("before")).alias(k) for k in ("expected", "predicted")])
    entered = seen.filter("nth > 1").select("cutoff", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}.now").alias("state"), F.col(f"{k}.before").alias("before")) for k in ("expected", "predicted")])).alias("x"))
    entered = entered.filter(~F.col("x.state").eqNullSafe(F.col("x.before"))).select("x.kind", F.coalesce("x.state", F.lit("None")).alias("state"), F.col("cutoff").alias("day")).distinct()
    return matched_pairs(entered, tolerance, "state").select("state", "tp", "fp", "fn", "error")


# A label's contract. Faults in the order in which they are looked for.
FAULTS = (
    "open_cutoff", "early_decision", "late_decision", "duplicate_structure", "unknown_parent", "cyclic_parents", "wrong_relationship", "primary_count", "no_structure", "no_active", "unknown_active",
    "active_not_primary", "unknown_reference", "events_out_of_order", "event_before_recognition", "no_active_breakout", "duplicate_bottom", "duplicate_event", "duplicate_phase",
)
#: Faults that are looked for structure by structure, or event by event, before the next one is tried.
_TOGETHER = {"cyclic_parents": "unknown_parent", "event_before_recognition": "events_out_of_order", "no_active_breakout": "events_out_of_order"}


def trees(structures: DataFrame) -> DataFrame:
    """structures(episode, nth, id, parent_id, relationship, selection, recognition) -> episode, at (its place among the episode's), nth, id, recognition, stands (of rows that share an id the last stands for it), cyclic, all_primary (from it up to its root), faults.

    Rows are dealt by episode once. A structure asks for its parent by a second row under the parent's
    id, so that a window over rows of one name sees the structure, its children and whether it is
    there. An episode's pointers are then one array of places; each round doubles the stretch that a
    pointer spans, so that as many rounds do as the logarithm of an episode's structures. What still
    points somewhere then goes round in a circle."""
    asks, named, at, key = F.col("asks"), F.col("id").isNotNull(), F.col("at"), F.col("key")
    primary = F.coalesce(F.col("selection") == "primary", F.lit(False))
    rows = structures.filter("episode IS NOT NULL").withColumn("at", F.row_number().over(Window.partitionBy("episode").orderBy("id", "nth")))
    rows = rows.withColumn("asks", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("key", F.when(asks, F.col("parent_id")).otherwise(F.col("id")))
    w = Window.partitionBy("episode", "key")
    sibling = asks & named
    rows = rows.withColumns({"last": F.max(F.when(~asks, at)).over(w), "children": F.count_if(asks).over(w), "primaries": F.count_if(sibling & primary).over(w), "first": F.min(F.when(sibling, F.struct("nth", "at"))).over(w)})
    own = F.struct("at", "nth", "id", "parent_id", "relationship", "recognition", "last", (F.col("children") > 0).alias("has_children"), primary.alias("primary"))
    # no name is nobody's
    parent = F.struct("at", F.when(key.isNotNull(), F.col("last")).alias("up"), (sibling & (F.col("primaries") != 1) & (F.col("first.at") == at)).alias("miscounted"))
    listed = lambda test, row: F.sort_array(F.collect_list(F.when(test, row)))
    g = rows.groupBy("episode").agg(listed(~asks, own).alias("own"), listed(asks, parent).alias("parent"), F.count_if(asks).cast("int").alias("n"))

    def pointer(own: Column, parent: Column) -> Column:
        stands = own["at"] == own["last"]
        return F.struct(own.alias("own"), parent.alias("parent"), F.when(stands, parent["up"]).otherwise(own["last"]).alias("up"), (own["primary"] | ~stands).alias("primary"))

    def doubled(all_: Column) -> Column:
        above = lambda x: F.get(all_, x["up"] - 1)
        # an unknown parent ends the chain
        return F.transform(all_, lambda x: F.struct(x["own"].alias("own"), x["parent"].alias("parent"), above(x)["up"].alias("up"), (x["primary"] & F.coalesce(above(x)["primary"], F.lit(True))).alias("primary")))

    chained = F.aggregate(F.sequence(F.lit(1), F.length(F.bin("n"))), F.zip_with("own", "parent", pointer), lambda all_, _: doubled(all_))
    # explode_outer, as Spark works out what explode takes once more, to see whether there is any
    x = g.select("episode", F.explode_outer(chained).alias("x")).select("episode", "x.own.*", F.col("x.parent.up").alias("parent_at"), "x.parent.miscounted", F.col("x.up").isNotNull().alias("cyclic"), F.col("x.primary").alias("all_primary"))
    has_parent = F.col("parent_id").isNotNull()
    topology = F.when(has_parent & F.col("has_children"), "parent_child").when(has_parent, "child").when(F.col("has_children"), "parent").otherwise("standalone")
    broken = {"unknown_parent": has_parent & F.col("parent_at").isNull(), "cyclic_parents": F.col("cyclic"), "wrong_relationship": ~F.col("relationship").eqNullSafe(topology), "primary_count": F.col("miscounted")}
    return x.select("episode", "at", "nth", "id", "recognition", (at == F.col("last")).alias("stands"), "cyclic", "all_primary", _names({f: named & test for f, test in broken.items()}).alias("faults"))


def _names(broken: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, f) for f, test in broken.items()]))


def label_faults(labels: DataFrame, structures: DataFrame, bottoms: DataFrame, events: DataFrame, phases: DataFrame) -> DataFrame:
    """Every broken rule of a label, with its place: episode, fault, nth.

    labels(episode, shape, active_id, cutoff, decision_as_of, labeled_at), structures(episode, nth, id,
    parent_id, relationship, selection, recognition), bottoms, events and phases(episode, id,
    structure_id), events with nth, kind, trigger, resolution and retest_state."""
    none = F.lit(0)
    row = lambda df, fault, nth=none: df.select("episode", F.lit(fault).alias("fault"), nth.cast("int").alias("nth"))
    out = []
    ends = F.last_day(F.make_date(F.year("cutoff"), F.quarter("cutoff") * 3, F.lit(1)))
    out += [row(labels.filter(F.month("cutoff") % 3 != 0), "open_cutoff"), row(labels.filter(F.col("decision_as_of") < ends), "early_decision"), row(labels.filter(F.col("decision_as_of") > F.to_date("labeled_at")), "late_decision")]
    tree = written(trees(structures), "structures")
    out += [row(tree.filter("NOT stands").select("episode").distinct(), "duplicate_structure"), tree.select("episode", F.explode("faults").alias("fault"), F.col("nth").cast("int").alias("nth"))]
    ids = tree.filter("stands AND id IS NOT NULL").select("episode", "id", "recognition", "all_primary")
    coil, active = F.col("shape") == "coil", F.col("active_id").isNotNull()
    out += [row(labels.filter(coil).join(tree.filter("at = 1").select("episode"), "episode", "left_anti"), "no_structure"), row(labels.filter(coil & ~active), "no_active")]
    # what labels, bottoms and phases name is looked up together; events look up more, and keep what they find for their windows
    told = lambda df, fault: df.select("episode", F.col("structure_id").alias("id"), F.lit(fault).alias("unknown"))
    asked = told(bottoms, "unknown_reference").unionByName(told(phases, "unknown_reference")).filter("id IS NOT NULL").unionByName(labels.filter(active).select("episode", F.col("active_id").alias("id"), F.lit("unknown_active").alias("unknown")))
    asked = asked.join(ids.select("episode", "id", "all_primary"), ["episode", "id"], "left")
    answer = F.when(F.col("all_primary").isNull(), F.col("unknown")).when(~F.col("all_primary") & (F.col("unknown") == "unknown_active"), "active_not_primary")
    out.append(asked.select("episode", answer.alias("fault"), none.alias("nth")).filter("fault IS NOT NULL"))
    # events of one structure, or of none, are a stream in the label's order
    nth, named = F.col("nth"), F.col("structure_id").isNotNull()
    w = Window.partitionBy("episode", "structure_id").orderBy("nth")
    fails = (F.col("kind") == "invalidation") | (F.col("kind") == "failed_breakout") | ((F.col("kind") == "retest") & F.col("retest_state").eqNullSafe(F.lit("failed")))
    sets = F.when(F.col("kind") == "breakout", True).when(fails, False)
    e = events.join(ids.select("episode", F.col("id").alias("structure_id"), "recognition", F.lit(True).alias("there")), ["episode", "structure_id"], "left")
    e = e.withColumns({"over": F.lag(F.coalesce("resolution", "trigger")).over(w), "active": F.last(sets, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    needs = F.col("kind").isin("retest", "continuation", "invalidation")
    broken = {"events_out_of_order": F.col("trigger") < F.col("over"), "event_before_recognition": F.col("trigger") < F.col("recognition"), "no_active_breakout": needs & ~F.coalesce("active", F.lit(False)), "unknown_reference": named & F.col("there").isNull()}
    found = e.select("episode", "nth", F.explode(_names(broken)).alias("fault"))
    out.append(found.select("episode", "fault", F.when(F.col("fault") == "unknown_reference", none).otherwise(nth).cast("int").alias("nth")))
    twice = lambda df: df.groupBy("episode", "id").count().filter("count > 1").select("episode").distinct()
    out += [row(twice(df), f"duplicate_{name}") for df, name in ((bottoms, "bottom"), (events, "event"), (phases, "phase"))]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def _place(fault: Column) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in FAULTS]), fault)


def label_contract(labels: DataFrame, structures: DataFrame, bottoms: DataFrame, events: DataFrame, phases: DataFrame) -> DataFrame:
    """One row a label: the first fault (null if it keeps the contract) and all its faults, comma-joined in their order."""
    found = label_faults(labels, structures, bottoms, events, phases)
    group = F.coalesce(*[F.when(F.col("fault") == f, F.lit(FAULTS.index(first) + 1)) for f, first in _TOGETHER.items()], _place(F.col("fault")))
    g = found.groupBy("episode").agg(F.min_by("fault", F.struct(group.cast("int").alias("group"), "nth", _place(F.col("fault")).alias("place"))).alias("fault"), F.array_sort(F.collect_set(F.struct(_place(F.col("fault")).alias("place"), "fault"))).alias("all"))
    return labels.select("episode").join(g.select("episode", "fault", F.array_join(F.transform("all", lambda x: x["fault"]), ",").alias("faults")), "episode", "left")
