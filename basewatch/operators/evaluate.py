"""Detections against labels: counts, intervals, matching, bootstrap."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from basewatch.functions.scalars import f1, wilson


def confusion(items: DataFrame) -> DataFrame:
    return items.groupBy("expected", "predicted").agg(F.count("*").alias("n"))


def class_scores(items: DataFrame) -> DataFrame:
    """items(expected, predicted) -> each label's tp, fp, fn, precision, recall with Wilson bounds, F1."""
    one = items.select(F.explode(F.array(F.struct(F.col("expected").alias("label"), (F.col("expected") == F.col("predicted")).alias("tp"), F.lit(False).alias("fp"), (F.col("expected") != F.col("predicted")).alias("fn")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("tp"), (F.col("expected") != F.col("predicted")).alias("fp"), F.lit(False).alias("fn")))).alias("e")).select("e.*")
    n = one.groupBy("label").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("tp", "fp", "fn")])
    low, high = wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    rate = lambda d: F.round(F.col("tp") / F.nullif(d, F.lit(0)), 6)
    return n.select("label", "tp", "fp", "fn", rate(F.col("tp") + F.col("fp")).alias("precision"), low.alias("precision_low"), high.alias("precision_high"), rate(F.col("tp") + F.col("fn")).alias("recall"), f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def macro_f1(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean F1 over a fixed set of labels; those that don't occur count 0."""
    known = labels.select("label").distinct().join(class_scores(items).select("label", "f1"), "label", "left")
    return known.agg(F.round(F.avg(F.coalesce("f1", F.lit(0.0))), 6).alias("macro_f1"), F.count("*").alias("n_labels"))


def numeric_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """count, mean, median, nearest-rank 95th percentile and maximum of each key."""
    w = Window.partitionBy(key)
    r = rows.filter(F.col(value).isNotNull()).withColumns({"nth": F.row_number().over(w.orderBy(value)), "of": F.count("*").over(w)})
    pick = F.max(F.when(F.col("nth") == F.ceil(F.col("of") * 95 / 100), F.col(value)))
    return r.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"), pick.alias("p95"), F.max(value).alias("max"))


def transitions(points: DataFrame) -> DataFrame:
    """points(setup, at, state) -> the changes of state, with the state before."""
    before = F.lag("state").over(Window.partitionBy("setup").orderBy("at"))
    return points.withColumn("previous", before).filter("previous IS NULL OR previous != state")


def split_leaks(episodes: DataFrame) -> DataFrame:
    """Setups that stand in more than one split."""
    return episodes.groupBy("setup").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def best_pairs(expected: list[int], predicted: list[int], tolerance: int) -> list[tuple[int, int, int]]:
    """One-to-one pairs (place, place, distance) of two sorted lists, at most tolerance apart: as many as can be, of these the nearest, of these the earliest.

    Pairs of points on a line need not cross, so a table of the best for every two rests of the lists is
    filled from their ends: one number and one step a cell. Of ways that are equally good, one that
    pairs the first two points comes first, then one that pairs the first expected point at all."""
    step, big = [], (len(expected) + len(predicted) + 1) * (tolerance + 1)
    below = [0] * (len(predicted) + 1)
    for i in reversed(range(len(expected))):
        row, ways, used = [0] * (len(predicted) + 1), bytearray(len(predicted) + 1), False  # used: the best of the cell to the right pairs i
        for j in reversed(range(len(predicted))):
            off = abs(expected[i] - predicted[j])
            paired = below[j + 1] + off - big if off <= tolerance else 1
            row[j] = min(below[j], row[j + 1], paired)
            ways[j] = 2 if paired == row[j] else 1 if row[j + 1] == row[j] and used else 0
            if not ways[j] and below[j] != row[j]:
                ways[j] = 1
            used = ways[j] == 2 or ways[j] == 1 and used
        step.append(ways)
        below = row
    out, i, j = [], 0, 0
    while i < len(expected) and j < len(predicted):
        way = step[len(expected) - 1 - i][j]
        if way == 2:
            out.append((i, j, abs(expected[i] - predicted[j])))
        i, j = i + (way != 1), j + (way != 0)
    return out


def _pairing(tolerance: int):
    @pandas_udf("array<struct<expected: int, predicted: int, error: int>>")
    def run(expected: pd.Series, predicted: pd.Series) -> pd.Series:
        return pd.Series([best_pairs(list(e), list(p), tolerance) for e, p in zip(expected, predicted)], dtype=object)

    return run


def matched_pairs(points: DataFrame, tolerance: int, *keys: str) -> DataFrame:
    """points(keys, kind 'expected' or 'predicted', day), matched by quarter -> tp, fp, fn, error (the sum of quarters) and pairs of days, one row for each key ('episode' unless named).

    A key's lists hold its distinct days, one for each label of one chart; keys are spread by a shuffle."""
    keys = keys or ("episode",)
    days = lambda k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("day")))).alias(k)
    quarters = lambda c: F.transform(c, lambda x: (F.year(x) * 4 + F.quarter(x)).cast("int"))
    g = points.groupBy(*keys).agg(days("expected"), days("predicted")).withColumn("m", _pairing(tolerance)(quarters("expected"), quarters("predicted")))
    pairs = F.transform("m", lambda x: F.struct(F.get("expected", x["expected"]).alias("expected"), F.get("predicted", x["predicted"]).alias("predicted"), x["error"].alias("error")))
    n = F.size("m").cast("long")
    return g.select(*keys, n.alias("tp"), (F.size("predicted") - n).alias("fp"), (F.size("expected") - n).alias("fn"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["error"]).alias("error"), pairs.alias("pairs"))


def matched_dates(points: DataFrame, tolerance: int) -> DataFrame:
    """matched_pairs() by episode without the pairs."""
    return matched_pairs(points, tolerance).drop("pairs")



#: Setups in a block of the bootstrap, on average, and how many blocks are added up before their sums are shuffled.
BLOCK, TOGETHER = 128, 32


def drawn_sums(own: np.ndarray, picked: np.ndarray, k: np.ndarray) -> np.ndarray:
    """own: setups by values; picked: places of drawn setups, k[i] of them for replicate i -> values by replicates, the sums over the drawn.

    How often a replicate draws each setup is counted once for all values. Products are of whole numbers
    in doubles, which is exact below 2 ** 53; beyond, they are of integers."""
    n = len(own)
    times = np.bincount(picked + np.repeat(np.arange(len(k)) * n, k), minlength=len(k) * n).reshape(len(k), n)
    exact = float(np.abs(own.astype("float64")).max(initial=0)) * float(k.max(initial=0)) < 2.0**53
    return (times.astype("float64") @ own.astype("float64")).T.astype("int64") if exact else (times @ own).T


def replicates(counts: DataFrame, values: list[str], samples: int, seed: int) -> DataFrame:
    """counts(metric, setup, values), one row for each setup -> metric, replicate and the sums of the values over the setups that it draws.

    A replicate draws as many setups as there are, with replacement, and all values see the same draws.
    Setups are dealt into blocks by hash. How many of a replicate's draws fall to a block follows from
    binomial splits down a binary tree over the blocks, each seeded by its metric and node, so that
    every task works out its own blocks' shares; the replicates are then added up over blocks, first
    over neighbours in the tree."""
    counts = counts.select("metric", "setup", *[F.coalesce(F.col(v).cast("long"), F.lit(0)).alias(v) for v in values])
    most = counts.groupBy("metric").count().agg(F.max("count")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, most / BLOCK))))
    dealt = counts.withColumn("block", F.pmod(F.xxhash64("setup"), F.lit(1 << depth)))
    sizes = dealt.groupBy("metric", "block").agg(F.count("*").alias("size"))
    nodes = sizes.select("metric", "block", "size", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")).withColumn("node", F.expr(f"shiftright(block, {depth} - level)"))
    whole = nodes.groupBy(F.col("metric").alias("m"), F.col("level").alias("l"), F.col("node").alias("k")).agg(F.sum("size").alias("setups"))
    # each block's way from the root: the setups below each node on it
    way = nodes.join(whole, F.col("metric").eqNullSafe(F.col("m")) & (F.col("level") == F.col("l")) & (F.col("node") == F.col("k")))
    way = way.groupBy(F.col("metric").alias("m"), F.col("block").alias("b")).agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "setups"))), lambda x: x["setups"]).alias("way"))
    rows = dealt.join(way, F.col("metric").eqNullSafe(F.col("m")) & (F.col("block") == F.col("b"))).select("metric", "setup", *values, "block", "way")

    def block_sums(pdf: pd.DataFrame, seen: dict) -> np.ndarray:
        """seen: draws of nodes that blocks share."""
        pdf = pdf.sort_values("setup")
        metric, block, way = pdf["metric"].iloc[0], int(pdf["block"].iloc[0]), [int(x) for x in pdf["way"].iloc[0]]
        name = zlib.crc32(str(metric).encode())
        rng = lambda *at: np.random.default_rng([seed, name, *at])
        drawn = np.full(samples, way[0])
        for level in range(1, depth + 1):
            # the left child's share is drawn from the parent's seed, so that both children see the same split
            node, here, above = block >> (depth - level), way[level], way[level - 1]
            if (level, node) not in seen:
                left = here if node % 2 == 0 else above - here
                share = rng(0, level, node >> 1).binomial(drawn, left / above)
                seen[level, node] = share if node % 2 == 0 else drawn - share
            drawn = seen[level, node]
        own, r = pdf[values].to_numpy(dtype="int64"), rng(1, block)
        out = np.zeros((len(values), samples), dtype="int64")
        step = max(1, 2_000_000 // max(1, len(pdf)))
        for at in range(0, samples, step):
            k = drawn[at : at + step]
            out[:, at : at + step] = drawn_sums(own, r.integers(len(pdf), size=int(k.sum())), k)
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total, seen = np.zeros((len(values), samples), dtype="int64"), {}
        for _, one in pdf.groupby("block"):
            total += block_sums(one, seen)
        return pd.DataFrame({"metric": pdf["metric"].iloc[0], "replicate": np.arange(samples), **dict(zip(values, total))})

    kind = counts.schema["metric"].dataType.simpleString()
    # small rows, much work: as many tasks as a shuffle has, which adaptive execution doesn't merge
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # no fewer groups than tasks
    together = max(1, min(TOGETHER, (1 << depth) // tasks))
    rows = rows.withColumn("part", F.floor(F.col("block") / together))
    drawn = rows.repartition(tasks, "metric", "part").groupBy("metric", "part").applyInPandas(run, f"metric {kind}, replicate long, " + ", ".join(f"{v} long" for v in values))
    return drawn.groupBy("metric", "replicate").agg(*[F.sum(v).alias(v) for v in values])


def _bounds(values: DataFrame, confidence: float) -> DataFrame:
    """values(metric, value), a row a replicate -> m and b, the percentile interval; any replicate without a value leaves it null."""
    tails = F.array(F.lit((1 - confidence) / 2), F.lit((1 + confidence) / 2))
    return values.groupBy(F.col("metric").alias("m")).agg(F.when(F.count("value") == F.count("*"), F.percentile("value", tails)).alias("b"))


def bootstrap(counts: DataFrame, samples: int = 10_000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """counts(metric, setup, good, n), one row for each setup -> point and percentile interval of sum(good) / sum(n) under resampled setups.

    Any replicate without n leaves the bounds null. The draws (see replicates()) have the law of the
    published figures' but aren't the same."""
    drawn = replicates(counts, ["good", "n"], samples, seed).select("metric", (F.col("good") / F.nullif(F.col("n"), F.lit(0))).alias("value"))
    points = counts.groupBy("metric").agg((F.sum("good") / F.nullif(F.sum("n"), F.lit(0))).alias("point"), F.count("*").alias("setups"))
    bound = lambda i: F.when(F.col("setups") > 1, F.col("b")[i])
    return points.join(_bounds(drawn, confidence), F.col("metric").eqNullSafe(F.col("m")), "left").select("metric", "point", bound(0).alias("low"), bound(1).alias("high"), "setups")


#: The six gates, in order. Fixed values.
GATES = ("top_f1", "lifecycle_macro_f1", "action_precision", "false_action_rate", "estimated_human_intervention_rate", "critical_intervention_rate")


def gate_confidence(items: DataFrame, labels: tuple[str, ...] | None = None, samples: int = 10_000, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """items(setup, expected, predicted (lifecycles), tp, fp, fn (of tops), expected_action, predicted_action, false_action, correction, critical) -> gate, point, low, high, setups.

    All six gates are read off the same resampled setups. The universe of lifecycles is fixed before:
    the distinct ones of all items unless named, a vocabulary of a few; one that a replicate lacks
    counts as zero. A gate that any replicate leaves undefined, or a single setup, has no bounds."""
    if labels is None:
        both = items.select(F.explode(F.array("expected", "predicted")).alias("x")).filter("x IS NOT NULL").distinct()
        labels = tuple(sorted(r[0] for r in both.collect()))
    n = lambda test: F.coalesce(test, F.lit(False)).cast("long")
    e, p = F.col("expected"), F.col("predicted")
    own = {"tp": F.col("tp"), "fp": F.col("fp"), "fn": F.col("fn"), "acts": n(F.col("predicted_action") == "actionable"), "right": n((F.col("predicted_action") == "actionable") & (F.col("expected_action") == "actionable")), "false": n(F.col("false_action")), "fixed": n(F.col("correction")), "grave": n(F.col("critical")), "items": F.lit(1)}
    for i, x in enumerate(labels):
        hit, said = n(e == x), n(p == x)
        own |= {f"tp{i}": hit * said, f"fp{i}": said * (1 - hit), f"fn{i}": hit * (1 - said)}
    counts = items.groupBy("setup").agg(*[F.sum(v.cast("long")).alias(k) for k, v in own.items()]).withColumn("metric", F.lit("gates"))
    f1 = lambda i="": 2 * F.col(f"tp{i}") / F.nullif(2 * F.col(f"tp{i}") + F.col(f"fp{i}") + F.col(f"fn{i}"), F.lit(0))
    over = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    macro = sum((F.coalesce(f1(i), F.lit(0.0)) for i in range(len(labels))), F.lit(0.0)) / len(labels) if labels else F.lit(None).cast("double")
    values = dict(zip(GATES, (f1(), macro, over("right", "acts"), over("false", "acts"), over("fixed", "items"), over("grave", "items")), strict=True))
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()])).alias("x")
    points = counts.agg(*[F.sum(k).alias(k) for k in own], F.count("*").alias("setups")).filter("setups > 0").select("setups", spread).select("setups", "x.*")
    drawn = replicates(counts, list(own), samples, seed).select(spread).select("x.*")
    bound = lambda i: F.when(F.col("setups") > 1, F.col("b")[i])
    return points.join(_bounds(drawn, confidence), F.col("metric") == F.col("m"), "left").select(F.col("metric").alias("gate"), F.col("value").alias("point"), bound(0).alias("low"), bound(1).alias("high"), "setups")
