"""What incoming rows, reviews and captures have to satisfy. Nothing is repaired: each row or record gets the first demand that it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Base rules that a review may name as failed. Fixed values.
BASE_RULES = ("repeated_ceiling", "long_duration", "compression", "near_lid", "not_broken_out", "trend_shape", "top_geometry", "data_quality", "other")
PRICES = ("open", "high", "low", "close")
LEAST_RATIONALE = 20


def _so(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def first_fault(tests: dict[str, Column]) -> Column:
    """The name of the first test that holds; null if none does. A test that is null doesn't hold."""
    return F.coalesce(*[F.when(_so(t), F.lit(name)) for name, t in tests.items()])


def iso_day(text: Column) -> Column:
    """A text of the exact form YYYY-MM-DD as a date, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def finite(x: Column) -> Column:
    return _so(~F.isnan(x) & (F.abs(x) < float("inf")))


def _bar_faults(day: Column, before: Column) -> dict[str, Column]:
    bad = {"not_ascending": day <= before, "month_twice": F.trunc(day, "MM") == F.trunc(before, "MM")}
    return bad | {f"bad_{c}": ~finite(F.col(c)) | (F.col(c) <= 0) for c in PRICES} | {"containment": (F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close"))}


def provider_faults(rows: DataFrame, start: str, end: str) -> DataFrame:
    """rows(symbol, pos, date text, open, high, low, close, volume) as a provider sent them -> the same with `fault`.

    Order is that of pos; a row is compared with the one before it, as reading stops at the first
    fault of a symbol. A date is the text YYYY-MM-DD inside the range; a volume is finite and not negative."""
    day = iso_day(F.col("date"))
    before = F.lag(day).over(Window.partitionBy("symbol").orderBy("pos"))
    r = rows.withColumns({"_day": day, "_before": before})
    tests = {"bad_date": F.col("_day").isNull(), "outside_range": ~F.col("_day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))}
    tests |= _bar_faults(F.col("_day"), F.col("_before")) | {"bad_volume": ~finite(F.col("volume")), "negative_volume": F.col("volume") < 0}
    return r.withColumn("fault", first_fault(tests)).drop("_day", "_before")


def frozen_faults(rows: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Frozen bars (rows as in provider_faults; volume may be null) and cutoff(symbol, cutoff) -> one row a symbol: bars up to the cutoff and the first fault.

    Bars after the cutoff aren't looked at, but for their date; the last one up to it has to be the cutoff's own."""
    r = rows.join(cutoff, "symbol").withColumn("_day", iso_day(F.col("date"))).filter("_day IS NULL OR _day <= cutoff")
    r = r.withColumn("_before", F.lag("_day").over(Window.partitionBy("symbol").orderBy("pos")))
    tests = {"bad_date": F.col("_day").isNull()} | _bar_faults(F.col("_day"), F.col("_before")) | {"bad_volume": F.col("volume").isNotNull() & (~finite(F.col("volume")) | (F.col("volume") < 0))}
    g = r.withColumn("fault", first_fault(tests)).groupBy("symbol", "cutoff").agg(F.count("*").alias("bars"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("pos"))).alias("fault"), F.max_by("_day", "pos").alias("last"))
    return g.select("symbol", "bars", F.coalesce("fault", F.when(~F.col("last").eqNullSafe(F.col("cutoff")), "cutoff_not_last")).alias("fault"))


def detector_bars(bars: DataFrame, cutoff: Column) -> DataFrame:
    """Nothing but prices and volume up to the cutoff: no label, review or model column gets to the detector."""
    return bars.filter(F.col("bar_date") <= cutoff).select("symbol", "bar_date", *PRICES, "volume")


def decision_is_late_enough(cutoff: Column, decision: Column) -> Column:
    """A decision may be taken once the cutoff's month is over."""
    return _so(decision >= F.last_day(cutoff))


def in_open_quarter(point: Column, last_bar: Column) -> Column:
    """Whether a point lies in the unfinished quarter that the data end in; with unknown dates or a finished quarter it doesn't."""
    same = (F.year(point) == F.year(last_bar)) & (F.quarter(point) == F.quarter(last_bar))
    return _so((F.month(last_bar) % 3 != 0) & same)


def point_counts(points: DataFrame, key: str) -> DataFrame:
    """points(key, date, role, lid_member) -> what the decision rules need to know of each record's points."""
    n = lambda test: F.count_if(_so(test))
    peak, member = F.col("role") == "breakout_peak", F.col("lid_member")
    return points.groupBy(key).agg(F.count("*").alias("points"), F.count_distinct("date").alias("dates"), n(member).alias("members"), n(member & peak).alias("member_peaks"), n(~_so(peak)).alias("anchors"))


def _correction_faults() -> dict[str, Column]:
    c = F.col
    some = c("members") > 0
    return {
        "duplicate_date": c("dates") < c("points"),
        "peak_is_member": some & (c("member_peaks") > 0),
        "too_few_members": some & (c("members") < 2),
        "too_few_anchors": ~some & (c("anchors") < 2),
    }


def decision_faults() -> Column:
    """Of a record's columns schema_version, label_policy, coil_label, human_grade, decision, note and its point_counts(): the first broken rule."""
    c = F.col
    four, coil = c("schema_version") == 4, c("coil_label") == "coil"
    corrected = c("decision") == "corrected"
    tests = {
        "label_policy": four & ~_so(c("label_policy") == 1),
        "no_label": four & c("coil_label").isNull(),
        "no_grade": four & coil & c("human_grade").isNull(),
        "grade_without_coil": four & ~_so(coil) & c("human_grade").isNotNull(),
        "no_rationale": four & (_so(corrected) | _so(c("coil_label") == "not_coil")) & c("note").isNull(),
        "approved_with_points": ~_so(corrected) & (c("points") > 0),
    }
    return first_fault(tests | {n: corrected & t for n, t in _correction_faults().items()})


def _short(text: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < LEAST_RATIONALE


def base_lock_faults() -> Column:
    """Of base_path, failed_rules (array), rationale: what keeps a first classification from being locked."""
    rules, path = F.col("failed_rules"), F.col("base_path")
    some = _so(F.size(rules) > 0)
    tests = {
        "unknown_rule": F.size(F.array_except(rules, F.array(*[F.lit(r) for r in BASE_RULES]))) > 0,
        "short_rationale": _short("rationale"),
        "duplicate_rule": F.size(rules) != F.size(F.array_distinct(rules)),
        "base_with_rules": (path == "base_pattern") & some,
        "exception_without_rules": (path == "exception_territory") & ~some,
    }
    return first_fault(tests)


def capture_faults() -> Column:
    """The sequential policy: the base path first and locked; only off it an exception may be judged, with reasons.

    Of locked, base_path, failed_rules, base_rationale, exception_verdict, exception_rationale, proposed."""
    rules, path, verdict = F.col("failed_rules"), F.col("base_path"), F.col("exception_verdict")
    some, base = _so(F.size(rules) > 0), _so(path == "base_pattern")
    applies, proposed = verdict == "applies", _so(F.col("proposed"))
    tests = {
        "not_locked": ~_so(F.col("locked")),
        "duplicate_rule": F.size(rules) != F.size(F.array_distinct(rules)),
        "base_with_rules": base & some,
        "exception_on_base": base & ((verdict != "not_evaluated") | proposed),
        "short_base_rationale": ~base & _short("base_rationale"),
        "exception_without_rules": (path == "exception_territory") & ~some,
        "no_verdict": ~base & (verdict == "not_evaluated"),
        "no_proposal": ~base & applies & ~proposed,
        "short_exception_rationale": ~base & ~applies & _short("exception_rationale"),
        "proposal_without_exception": ~base & ~applies & proposed,
    }
    return first_fault(tests)


def derived_label() -> Column:
    """The label that follows from base_path and exception_verdict."""
    path, verdict = F.col("base_path"), F.col("exception_verdict")
    return F.when((path == "base_pattern") | (verdict == "applies"), "coil").when((path == "exception_territory") & (verdict == "does_not_apply"), "not_coil").otherwise("uncertain")


def verdict_faults() -> Column:
    """Of coil_label, human_grade, decision, note, the derived label's columns and point_counts(): what contradicts the recorded review."""
    c = F.col
    coil, corrected = c("coil_label") == "coil", c("decision") == "corrected"
    tests = {
        "label_not_derived": ~_so(c("coil_label") == derived_label()),
        "no_grade": coil & c("human_grade").isNull(),
        "grade_without_coil": ~_so(coil) & c("human_grade").isNotNull(),
        "no_note": (_so(corrected) | _so(c("coil_label") == "not_coil")) & (F.trim(F.coalesce("note", F.lit(""))) == ""),
        "approved_with_points": (c("decision") == "approved") & (c("points") > 0),
    }
    return first_fault(tests | {n: corrected & t for n, t in _correction_faults().items()})


def draft_matches(draft: str, locked: str) -> Column:
    """Two structs (reviewer, base_path, failed_rules, rationale; the draft also has locked, policy): the draft still says what was locked."""
    d, k = F.col(draft), F.col(locked)
    same_text = lambda f: F.trim(F.coalesce(d[f], F.lit(""))) == F.trim(F.coalesce(k[f], F.lit("")))
    return _so(d["locked"]) & _so(d["policy"] == 1) & same_text("reviewer") & _so(d["base_path"].eqNullSafe(k["base_path"])) & _so(d["failed_rules"] == k["failed_rules"]) & same_text("rationale")


def redacted(rows: DataFrame, locked: str, open_columns: list[str]) -> DataFrame:
    """Until the base classification is locked, every column but the open ones is null."""
    return rows.select(*[F.col(c) if c in open_columns or c == locked else F.when(_so(F.col(locked)), F.col(c)).alias(c) for c in rows.columns])


def snapped_evidence(points: DataFrame, candles: DataFrame) -> DataFrame:
    """points(symbol, date, field, price) against candles(symbol, date, open.., open_quarter): the first reason why a point isn't evidence.

    A price is the candle's own up to a hundred-millionth of it."""
    p = points.join(candles, ["symbol", "date"], "left")
    own = F.coalesce(*[F.when(F.col("field") == f, F.col(f)) for f in PRICES])
    tests = {"no_candle": F.col("open_quarter").isNull(), "open_quarter": F.col("open_quarter"), "other_price": ~_so(F.abs(F.col("price") - own) <= F.greatest(F.lit(1e-8), F.abs(own) * 1e-8))}
    return p.select(*points.columns, first_fault(tests).alias("fault"))


def clicked(clicks: DataFrame, quarters: DataFrame) -> DataFrame:
    """clicks(symbol, date, field) -> idx and price of the completed quarter with that date; both null where there is none."""
    q = quarters.select("symbol", F.col("bar_date").alias("date"), F.col("q_idx").alias("idx"), *PRICES)
    price = F.coalesce(*[F.when(F.col("field") == f, F.col(f)) for f in PRICES])
    return clicks.join(q, ["symbol", "date"], "left").select(*clicks.columns, "idx", price.alias("price"))


def checked_clicks(clicks: DataFrame, quarters: DataFrame) -> DataFrame:
    """clicked(), failing the job at a click that hits no completed quarter."""
    bad = F.raise_error(F.concat(F.lit("click isn't a completed quarter: "), F.col("date").cast("string")))
    return clicked(clicks, quarters).withColumn("idx", F.when(F.col("idx").isNull(), bad.cast("int")).otherwise(F.col("idx")))


def reviewed_points(points: DataFrame, bars: DataFrame, quarters: DataFrame) -> DataFrame:
    """points(symbol, date text, price, role) placed on structural quarters: the month by its first seven letters, later points than the last quarter left out.

    bars(symbol, bar_date, idx, high) are numbered months, quarters(symbol, year, qtr, q_idx, bar_date) the structural ones.
    Without a price of its own a point has its month's high, without a role it is a major top."""
    month = bars.select("symbol", F.date_format("bar_date", "yyyy-MM").alias("month"), F.year("bar_date").alias("year"), F.quarter("bar_date").alias("qtr"), F.col("idx").alias("month_idx"), F.col("high").alias("month_high"))
    p = points.withColumn("month", F.substring("date", 1, 7)).join(month, ["symbol", "month"]).join(quarters.select("symbol", "year", "qtr", "q_idx", F.col("bar_date").alias("quarter_date")), ["symbol", "year", "qtr"])
    return p.select("symbol", "date", "month_idx", "q_idx", "quarter_date", F.coalesce("price", "month_high").alias("price"), F.coalesce("role", F.lit("major_top")).alias("role"))


def manifest_faults(items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """items(ticker, and the hashes that the manifest names) against snapshots(ticker, and their own): the first hash that differs."""
    hashes = [c for c in items.columns if c != "ticker"]
    s = snapshots.select("ticker", F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in hashes])
    tests = {"no_snapshot": F.col("_there").isNull()} | {c: ~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in hashes}
    return items.join(s, "ticker", "left").select("ticker", first_fault(tests).alias("fault"))


def frozen_corpus(rows: DataFrame, cache: DataFrame, facts: list[str]) -> DataFrame:
    """A saved screen's rows (ticker and facts) against the cache's: each row's first fact that doesn't agree, or that the cache lacks the ticker."""
    return manifest_faults(rows.select("ticker", *facts), cache.select("ticker", *facts)).withColumn("status", F.when(F.col("fault").isNull(), "frozen").otherwise("refused"))


def typed_cell(text: Column, kind: str) -> Column:
    """A cell of a text table: blank is null, True and False are booleans, numbers doubles; what can't be read is null."""
    t = F.trim(text)
    full = F.when(t != "", t)
    return full if kind == "string" else F.when(F.lower(full).isin("true", "false"), F.lower(full) == "true") if kind == "boolean" else full.try_cast(kind)


def session_fingerprints(items: DataFrame) -> DataFrame:
    """items(session, source, algorithm_version, position, ticker) -> one row a session: items and the identity of its cohort.

    The identity is the SHA-256 of sorted JSON with blanks after commas and colons; tickers are upper-cased and in queue order, snapshots empty."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    g = items.groupBy("session", "source", "algorithm_version").agg(F.sort_array(F.collect_list(F.struct("position", F.upper(F.trim("ticker")).alias("ticker")))).alias("queue"))
    listed = F.array_join(F.transform("queue", lambda x: F.concat(F.lit("["), quoted(x["ticker"]), F.lit(", {}]"))), ", ")
    version = F.coalesce(quoted(F.col("algorithm_version")), F.lit("null"))
    basis = F.concat(F.lit('{"algorithm_version": '), version, F.lit(', "items": ['), listed, F.lit('], "snapshot": {}, "source": '), quoted(F.col("source")), F.lit("}"))
    return g.select("session", F.size("queue").cast("long").alias("items"), F.sha2(basis, 256).alias("fingerprint"))


def resumed(sessions: DataFrame) -> DataFrame:
    """session_fingerprints() of requests in order of session -> the session that each one gets: the first with its fingerprint."""
    first = sessions.groupBy("fingerprint").agg(F.min("session").alias("opened"))
    return sessions.join(first, "fingerprint").select("session", "items", "opened", F.when(F.col("session") == F.col("opened"), "created").otherwise("resumed").alias("outcome"))


def exportable(sessions: DataFrame) -> DataFrame:
    """sessions(session, fresh, pending, finalised): a fresh one may be exported once it is finalised, an older one always."""
    return sessions.withColumn("export", F.when(F.col("fresh") & ~_so(F.col("finalised")), "blocked").otherwise("open"))
