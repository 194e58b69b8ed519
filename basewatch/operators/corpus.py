"""Review records as a corpus: what is quarantined and why, reports and gates, checks of shape, freshness and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewatch.functions.scalars import wilson

#: Schema and label policy versions that belong together. Fixed values.
CONTRACTS = ((4, 1), (5, 2))
LABELS = ("coil", "not_coil", "uncertain")


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def quarantine_reasons() -> Column:
    """Of a record's columns: every reason for which it may not be learnt from, in a fixed order; empty for a candidate."""
    col, label = F.col, F.col("coil_label")
    known = lambda c: F.coalesce(c, F.lit(False))
    contract = sum((known((col("schema_version") == s) & (col("label_policy") == p)).cast("int") for s, p in CONTRACTS), F.lit(0)) > 0
    tests = {
        "unsupported_label_contract": ~contract,
        "missing_coil_label": ~known(label.isin(*LABELS)),
        "uncertain_label": known(label == "uncertain"),
        "low_confidence": known(col("confidence") == "low"),
        "missing_human_grade": known(label == "coil") & ~known(col("human_grade").isin("A", "B", "C")),
        "missing_as_of": _blank(col("as_of").cast("string")),
        "missing_algorithm_version": _blank(col("algorithm_version")),
        "missing_bar_data_hash": _blank(col("bars_hash")),
        "missing_rationale": (known(col("decision") == "corrected") | known(label == "not_coil")) & _blank(col("note")),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def samples(records: DataFrame) -> DataFrame:
    """The last record of each sample by creation and id, with its reasons and status."""
    last = F.max_by(F.struct(*records.columns), F.struct("created_at", "event_id"))
    one = records.groupBy(F.col("sample").alias("_sample")).agg(last.alias("r")).select("r.*").withColumn("reasons", quarantine_reasons())
    return one.withColumn("status", F.when(F.size("reasons") > 0, "quarantine").otherwise("candidate"))


def unique_events(events: DataFrame, key: str, payload: Column) -> DataFrame:
    """One row for each event: how often it came, and whether its payloads differ, which is an error of the corpus."""
    return events.groupBy(key).agg(F.count("*").alias("times"), (F.min(payload) != F.max(payload)).alias("conflict"))


def checked_unique(events: DataFrame, key: str, payload: Column) -> DataFrame:
    """unique_events(), failing the job at the first conflict."""
    bad = F.when(F.col("conflict"), F.raise_error(F.concat(F.lit("conflicting payloads for event "), F.col(key).cast("string"))))
    return unique_events(events, key, payload).withColumn("conflict", F.coalesce(bad.cast("boolean"), F.lit(False)))


def report(sampled: DataFrame) -> DataFrame:
    """samples() -> counts in long form: section, key, other (of the human grade: the model's), n."""
    cell = lambda section, key, other=None: F.struct(F.lit(section).alias("section"), key.alias("key"), (F.lit(None).cast("string") if other is None else other).alias("other"))
    cells = [cell("status", F.col("status")), cell("verdict", F.col("decision")), cell("label", F.col("coil_label")), cell("confidence", F.col("confidence")), cell("grade", F.col("human_grade"))]
    cells.append(cell("human_vs_model", F.when(F.col("model_grade").isNotNull(), F.col("human_grade")), F.col("model_grade")))
    return sampled.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("key IS NOT NULL").groupBy("section", "key", "other").agg(F.count("*").alias("n"))


def accuracy(sampled: DataFrame) -> DataFrame:
    """One row: how often candidates' tops were approved as they were, and how often a definite label was a coil."""
    trusted = F.col("status") == "candidate"
    n = lambda test: F.count_if(F.coalesce(trusted & test, F.lit(False)))
    counted = sampled.agg(n(F.col("decision").isin("approved", "corrected")).alias("top_decisions"), n(F.col("decision") == "approved").alias("top_exact_matches"), n(F.col("coil_label").isin("coil", "not_coil")).alias("definite_labels"), n(F.col("coil_label") == "coil").alias("coil_candidates"))
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 4)
    return counted.withColumns({"top_exact_match_rate": ratio("top_exact_matches", "top_decisions"), "coil_precision": ratio("coil_candidates", "definite_labels")})


def promotion_gate(scored: DataFrame, least_samples: int, least_top_rate: float, least_precision: float) -> DataFrame:
    """accuracy()'s row -> passed and failures, each a sentence."""
    low = lambda c, least: F.col(c).isNull() | (F.col(c) < least)
    said = lambda name, c, least: F.concat(F.lit(f"{name} "), F.coalesce(F.format_number(F.col(c), 4), F.lit("None")), F.lit(f" is below {least:.3f}"))
    tests = [
        F.when(F.col("top_decisions") < least_samples, F.concat(F.lit("only "), F.col("top_decisions").cast("string"), F.lit(f" labeled samples; requires {least_samples}"))),
        F.when(low("top_exact_match_rate", least_top_rate), said("top exact-match rate", "top_exact_match_rate", least_top_rate)),
        F.when(low("coil_precision", least_precision), said("coil candidate precision", "coil_precision", least_precision)),
    ]
    failures = F.array_compact(F.array(*tests))
    return scored.select((F.size(failures) == 0).alias("passed"), F.array_join(failures, "; ").alias("failures"))


def predicted_classes() -> dict[str, Column]:
    """Of an analysis's columns state, eligible, abstained, recognized, mature: what it predicts."""
    state, eligible, gone = F.coalesce("state", F.lit("none")), F.col("eligible"), F.coalesce("abstained", F.lit(False))
    barred = F.coalesce(~eligible, F.lit(False))
    ready = state.isin("ready", "breakout_now") & ~barred
    return {
        "shape": F.when(gone, "uncertain").when(F.coalesce("recognized", F.lit(False)), "coil").otherwise("not_coil"),
        "maturity": F.when(F.col("mature"), "mature").when(~F.col("mature"), "immature").otherwise("uncertain"),
        "readiness": F.when(gone, "uncertain").when(ready, "ready").otherwise("not_ready"),
        "action": F.when(gone, "abstain").when(ready, "actionable").when(state == "watch", "watch").otherwise("avoid"),
    }


def policy_checks(checks: DataFrame) -> DataFrame:
    """checks(name, applicable, supported, included, intervention) -> counts and the Wilson interval of the share that needs intervention."""
    n = lambda *tests: F.count_if(F.coalesce(sum((F.col(t).cast("int") for t in tests), F.lit(0)) == len(tests), F.lit(False)))
    g = checks.groupBy("name").agg(F.count("*").alias("episodes"), n("applicable").alias("applicable"), n("applicable", "supported").alias("supported"), n("applicable", "included").alias("included"), n("applicable", "included", "intervention").alias("interventions"))
    low, high = wilson(F.col("interventions"), F.col("included"))
    return g.withColumns({"rate": F.round(F.col("interventions") / F.nullif(F.col("included"), F.lit(0)), 6), "low": low, "high": high})


def capped(points: DataFrame, most: int = 3) -> DataFrame:
    """points(key, idx, member): all members of the lid, and the latest others up to `most` points in all."""
    w = Window.partitionBy("key")
    back = F.row_number().over(w.partitionBy("key", "member").orderBy(F.desc("idx")))
    rows = points.withColumns({"members": F.count_if("member").over(w), "back": back})
    return rows.filter(F.col("member") | (F.col("back") <= most - F.col("members"))).drop("members", "back")


def best_by_ends(candidates: DataFrame, ends: list[str], score: str, tie: str) -> DataFrame:
    """Of candidates with the same ends the best score; of equal ones the first by tie."""
    best = F.max_by(F.struct(*[c for c in candidates.columns if c not in ends]), F.struct(score, -F.col(tie)))
    return candidates.groupBy(*ends).agg(best.alias("_best")).select(*ends, "_best.*")


def is_stale(as_of: Column, algorithm: Column, now_as_of: Column, now_algorithm: Column) -> Column:
    """A decision is stale once newer data or another algorithm came; one that doesn't say what it rests on never is."""
    return F.coalesce(now_as_of > as_of, F.lit(False)) | F.coalesce(now_algorithm != algorithm, F.lit(False))


def is_fresh(fetched_at: Column, now: Column, hours: int = 24) -> Column:
    """Fetched before now, by less than so many hours."""
    age = F.unix_micros(now) - F.unix_micros(fetched_at)
    return F.coalesce((age >= 0) & (age < hours * 3_600_000_000), F.lit(False))


def first_known(writable: DataFrame, seed: DataFrame, key: str, value: str) -> DataFrame:
    """The writable store's value where it has one, else the seed's, with its origin."""
    w, s = writable.select(key, F.col(value).alias("w")), seed.select(key, F.col(value).alias("s"))
    origin = F.when(F.col("w").isNotNull(), "writable").when(F.col("s").isNotNull(), "seed").otherwise("missing")
    return w.join(s, key, "full_outer").select(key, F.coalesce("w", "s").alias(value), origin.alias("origin"))


def compared_releases(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Two ordered lists (position, ticker, hash) place by place."""
    e, a = (x.select("position", F.col("ticker").alias(f"{n}_ticker"), F.col("hash").alias(f"{n}_hash")) for x, n in ((expected, "expected"), (actual, "actual")))
    kind = F.when(F.col("actual_ticker").isNull(), "missing").when(F.col("expected_ticker").isNull(), "extra").when(F.col("expected_ticker") != F.col("actual_ticker"), "order").when(F.col("expected_hash").eqNullSafe(F.col("actual_hash")), "same").otherwise("hash")
    return e.join(a, "position", "full_outer").withColumn("outcome", kind)


def evidence_faults(points: DataFrame) -> DataFrame:
    """points(rule, sequence, id, date) -> for each rule which demands on its evidence's shape fail."""
    w = Window.partitionBy("rule").orderBy("sequence", "id")
    rows = points.withColumns({"nth": F.row_number().over(w), "before": F.lag("date").over(w)})
    g = rows.groupBy("rule").agg(
        F.max((F.col("sequence") != F.col("nth")).cast("int")).alias("gap"), (F.count_distinct("id") < F.count("*")).alias("same_id"), (F.count_distinct("date") < F.count("*")).alias("same_date"),
        F.max(F.coalesce(F.col("date") < F.col("before"), F.lit(False)).cast("int")).alias("back"),
    )
    named = {"sequence_not_contiguous": F.col("gap") == 1, "ids_not_unique": F.col("same_id"), "dates_not_distinct": F.col("same_date"), "not_chronological": F.col("back") == 1}
    return g.select("rule", F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in named.items()])), ",").alias("faults"))


def cohorts(members: DataFrame, controls: DataFrame, reviews: DataFrame, anchors: DataFrame) -> DataFrame:
    """members(ticker) -> cohort (calibration if it is a control, else prospective), and whether it was reviewed before or used for tuning."""
    flag = lambda df, name: df.select("ticker", F.lit(True).alias(name)).distinct()
    x = members.join(flag(controls, "control"), "ticker", "left").join(flag(reviews, "reviewed"), "ticker", "left").join(flag(anchors, "anchor"), "ticker", "left")
    known = lambda c: F.coalesce(c, F.lit(False))
    return x.select("ticker", F.when(F.col("control"), "calibration").otherwise("prospective").alias("cohort"), known("reviewed").alias("prior_reviewed"), known("anchor").alias("tuning_anchor"))


def composition(setups: DataFrame, targets: dict[str, float], least: int, tolerance: float = 1.0) -> DataFrame:
    """setups(setup, stratum) -> one row: distinct setups, those in several strata, and which demands fail."""
    one = setups.groupBy("setup").agg(F.min("stratum").alias("stratum"), (F.min("stratum") != F.max("stratum")).alias("conflict"))
    counts = one.agg(F.count("*").alias("setups"), F.count_if("conflict").alias("conflicts"), *[F.count_if(F.col("stratum") == s).alias(f"n{i}") for i, s in enumerate(targets)])
    off = sum(((F.abs(100 * F.col(f"n{i}") / F.nullif(F.col("setups"), F.lit(0)) - share) > tolerance).cast("int") for i, share in enumerate(targets.values())), F.lit(0))
    named = {"insufficient_unique_setups": F.col("setups") < least, "stratum_conflict": F.col("conflicts") > 0, "composition_out_of_range": F.coalesce(off > 0, F.lit(True))}
    return counts.select("setups", "conflicts", F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in named.items()])), ",").alias("failures"))


def image_name(*parts: Column) -> Column:
    """Segments of a file name: anything but letters, digits, dot, dash and underscore becomes one dash, ends trimmed."""
    safe = [F.regexp_replace(F.regexp_replace(p, "[^A-Za-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "") for p in parts]
    return F.concat(F.concat_ws("_", *safe), F.lit(".png"))
