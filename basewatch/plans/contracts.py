"""Queries over rows, reviews and captures that have to satisfy a contract, and the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from basewatch.operators import bars as B
from basewatch.operators import contracts as C
from basewatch.plans.price import _NUMBERED, _QUARTERS, _clean
from basewatch.plans.registry import registry
from basewatch.sources.tables import DILATED_SQL, dilated_bars, table

query, QUERIES, SQL = registry()


def _raw_sql(n: int) -> str:
    return f"""{DILATED_SQL}{_NUMBERED}, h AS (SELECT *, (idx + 211 * length(symbol)) % {n} AS h FROM c),
 raw AS (SELECT symbol, idx AS pos, CASE WHEN h = 5 THEN '2001-13-01' WHEN h = 17 THEN strftime(bar_date, '%Y/%m/%d') WHEN h = 29 THEN strftime(bar_date - INTERVAL 2 MONTHS, '%Y-%m-%d') WHEN h = 31 THEN strftime(bar_date - INTERVAL 10 DAYS, '%Y-%m-%d') ELSE strftime(bar_date, '%Y-%m-%d') END AS date,
  CASE WHEN h = 37 THEN -open ELSE open END AS open, CASE WHEN h = 41 THEN 'NaN'::DOUBLE ELSE high END AS high, CASE WHEN h = 43 THEN NULL ELSE low END AS low, CASE WHEN h = 47 THEN close * 1000 ELSE close END AS close, CASE WHEN h = 53 THEN -1 WHEN h = 59 THEN NULL ELSE volume END AS volume FROM h),
 d AS (SELECT *, CASE WHEN regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(date AS DATE) END AS day FROM raw)"""


def _raw(spark, d, n: int):
    h, day, at = F.col("h"), F.col("bar_date"), lambda c: F.date_format(c, "yyyy-MM-dd")
    text = F.when(h == 5, "2001-13-01").when(h == 17, F.date_format(day, "yyyy/MM/dd")).when(h == 29, at(F.add_months(day, -2))).when(h == 31, at(F.date_sub(day, 10))).otherwise(at(day))
    rows = _clean(spark, d).withColumn("h", (F.col("idx") + 211 * F.length("symbol")) % n)
    return rows.select(
        "symbol", F.col("idx").alias("pos"), text.alias("date"), F.when(h == 37, -F.col("open")).otherwise(F.col("open")).alias("open"), F.when(h == 41, float("nan")).otherwise(F.col("high")).alias("high"),
        F.when(h != 43, F.col("low")).alias("low"), F.when(h == 47, F.col("close") * 1000).otherwise(F.col("close")).alias("close"), F.when(h == 53, -1.0).when(h != 59, F.col("volume")).alias("volume"),
    )


_BAD_PRICES = " ".join(f"WHEN {c} IS NULL OR NOT isfinite({c}) OR {c} <= 0 THEN 'bad_{c}'" for c in ("open", "high", "low", "close"))
_BAR_CASES = f"WHEN day <= before THEN 'not_ascending' WHEN date_trunc('month', day) = date_trunc('month', before) THEN 'month_twice' {_BAD_PRICES} WHEN high < greatest(open, low, close) OR low > least(open, high, close) THEN 'containment'"


@query("validate_provider_rows", f"""WITH {_raw_sql(97)}, l AS (SELECT *, lag(day) OVER (PARTITION BY symbol ORDER BY pos) AS before FROM d)
 SELECT symbol, pos, CASE WHEN day IS NULL THEN 'bad_date' WHEN day NOT BETWEEN DATE '1986-01-01' AND DATE '2014-12-31' THEN 'outside_range' {_BAR_CASES} WHEN volume IS NULL OR NOT isfinite(volume) THEN 'bad_volume' WHEN volume < 0 THEN 'negative_volume' END AS fault FROM l""")
def _(spark, d):
    return C.provider_faults(_raw(spark, d, 97), "1986-01-01", "2014-12-31").select("symbol", "pos", "fault")


@query("validate_frozen_bars", f"""WITH {_raw_sql(1499)}, k AS (SELECT *, CASE WHEN length(symbol) % 2 = 0 THEN DATE '2009-06-01' ELSE DATE '2009-06-15' END AS cutoff FROM d), u AS (SELECT * FROM k WHERE day IS NULL OR day <= cutoff),
 l AS (SELECT *, lag(day) OVER (PARTITION BY symbol ORDER BY pos) AS before FROM u), f AS (SELECT *, CASE WHEN day IS NULL THEN 'bad_date' {_BAR_CASES} WHEN NOT isfinite(volume) OR volume < 0 THEN 'bad_volume' END AS fault FROM l)
 SELECT symbol, count(*) AS bars, coalesce(arg_min(fault, pos) FILTER (fault IS NOT NULL), CASE WHEN arg_max(day, pos) IS DISTINCT FROM any_value(cutoff) THEN 'cutoff_not_last' END) AS fault FROM f GROUP BY symbol""")
def _(spark, d):
    cutoff = table(spark, d, "nation").select(F.col("n_name").alias("symbol"), F.when(F.length("n_name") % 2 == 0, "2009-06-01").otherwise("2009-06-15").cast("date").alias("cutoff"))
    return C.frozen_faults(_raw(spark, d, 1499), cutoff)


@query("sanitize_ohlcv", f"WITH {DILATED_SQL} SELECT symbol, bar_date, open, high, low, close, volume FROM bars WHERE bar_date <= DATE '2007-03-31'")
def _(spark, d):
    labelled = dilated_bars(spark, d).withColumns({"label": F.lit("coil"), "grade": F.lit("A")})
    return C.detector_bars(labelled, F.lit("2007-03-31").cast("date"))


@query("decision_as_of", "SELECT o_orderkey, last_day(o_orderdate::DATE) <= o_orderdate::DATE + (o_orderkey % 40)::INT AS valid FROM orders")
def _(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", C.decision_is_late_enough(day, F.date_add(day, (F.col("o_orderkey") % 40).cast("int"))).alias("valid"))


@query("reject_open_quarter_points", "WITH l AS (SELECT o_custkey, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1) SELECT o_orderkey, month(last) % 3 != 0 AND date_trunc('quarter', last) = date_trunc('quarter', o_orderdate) AS rejected FROM orders JOIN l USING (o_custkey)")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    last = o.groupBy("o_custkey").agg(F.max("day").alias("last"))
    return o.join(last, "o_custkey").select("o_orderkey", C.in_open_quarter(F.col("day"), F.col("last")).alias("rejected"))


_REVIEWS = """p AS (SELECT event_id // 6 AS k, event_id AS e, DATE '2020-01-01' + (event_id % CASE WHEN event_id // 6 % 11 = 0 THEN 2 ELSE 1000 END)::INT AS date, event_id % 5 = 0 AS peak, event_id % 4 = 0 AS member FROM events WHERE event_id % 6 < event_id // 6 % 7),
 n AS (SELECT k, count(*) AS points, count(DISTINCT date) AS dates, count(*) FILTER (member) AS members, count(*) FILTER (member AND peak) AS member_peaks, count(*) FILTER (NOT peak) AS anchors FROM p GROUP BY k),
 r AS (SELECT k, CASE WHEN k % 3 = 0 THEN 3 ELSE 4 END AS schema_version, CASE WHEN k % 14 = 0 THEN 2 ELSE 1 END AS label_policy, CASE k % 5 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'not_coil' WHEN 4 THEN NULL ELSE 'coil' END AS coil_label, CASE WHEN k % 4 > 0 THEN 'A' END AS human_grade,
  CASE WHEN k % 2 = 0 THEN 'corrected' ELSE 'approved' END AS decision, CASE WHEN k % 7 > 0 THEN 'why' END AS note, CASE k % 3 WHEN 0 THEN 'base_pattern' WHEN 1 THEN 'exception_territory' ELSE 'uncertain' END AS base_path, CASE k % 4 WHEN 0 THEN 'not_evaluated' WHEN 1 THEN 'applies' WHEN 2 THEN 'does_not_apply' ELSE 'uncertain' END AS exception_verdict,
  coalesce(points, 0) AS points, coalesce(dates, 0) AS dates, coalesce(members, 0) AS members, coalesce(member_peaks, 0) AS member_peaks, coalesce(anchors, 0) AS anchors FROM (SELECT DISTINCT event_id // 6 AS k FROM events) LEFT JOIN n USING (k))"""
_CORRECTION = "WHEN corrected AND dates < points THEN 'duplicate_date' WHEN corrected AND members > 0 AND member_peaks > 0 THEN 'peak_is_member' WHEN corrected AND members = 1 THEN 'too_few_members' WHEN corrected AND members = 0 AND anchors < 2 THEN 'too_few_anchors'"


def _reviews(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(F.floor(i / 6).alias("k"), i)
    k = F.col("k")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (i % F.when(k % 11 == 0, 2).otherwise(1000)).cast("int"))
    points = e.filter(i % 6 < k % 7).select("k", day.alias("date"), F.when(i % 5 == 0, "breakout_peak").otherwise("major_top").alias("role"), (i % 4 == 0).alias("lid_member"))
    said = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    r = e.select("k").distinct().join(C.point_counts(points, "k"), "k", "left").na.fill(0)
    return r.withColumns({
        "schema_version": F.when(k % 3 == 0, 3).otherwise(4), "label_policy": F.when(k % 14 == 0, 2).otherwise(1), "coil_label": said(5, "uncertain", "not_coil", "coil", "coil", None), "human_grade": F.when(k % 4 > 0, "A"),
        "decision": said(2, "corrected", "approved"), "note": F.when(k % 7 > 0, "why"), "base_path": said(3, "base_pattern", "exception_territory", "uncertain"), "exception_verdict": said(4, "not_evaluated", "applies", "does_not_apply", "uncertain"),
    })


@query("decision_contract", f"""WITH {_REVIEWS}, s AS (SELECT *, schema_version = 4 AS four, decision = 'corrected' AS corrected FROM r)
 SELECT k, CASE WHEN four AND label_policy != 1 THEN 'label_policy' WHEN four AND coil_label IS NULL THEN 'no_label' WHEN four AND coil_label = 'coil' AND human_grade IS NULL THEN 'no_grade' WHEN four AND coil_label != 'coil' AND human_grade IS NOT NULL THEN 'grade_without_coil'
  WHEN four AND (corrected OR coil_label = 'not_coil') AND note IS NULL THEN 'no_rationale' WHEN NOT corrected AND points > 0 THEN 'approved_with_points' {_CORRECTION} END AS fault FROM s""")
def _(spark, d):
    return _reviews(spark, d).select("k", C.decision_faults().alias("fault"))


@query("capture_verdict", f"""WITH {_REVIEWS}, s AS (SELECT *, decision = 'corrected' AS corrected, CASE WHEN base_path = 'base_pattern' OR exception_verdict = 'applies' THEN 'coil' WHEN base_path = 'exception_territory' AND exception_verdict = 'does_not_apply' THEN 'not_coil' ELSE 'uncertain' END AS derived FROM r)
 SELECT k, derived, CASE WHEN coil_label IS DISTINCT FROM derived THEN 'label_not_derived' WHEN coil_label = 'coil' AND human_grade IS NULL THEN 'no_grade' WHEN coil_label != 'coil' AND human_grade IS NOT NULL THEN 'grade_without_coil'
  WHEN (corrected OR coil_label = 'not_coil') AND note IS NULL THEN 'no_note' WHEN NOT corrected AND points > 0 THEN 'approved_with_points' {_CORRECTION} END AS fault FROM s""")
def _(spark, d):
    return _reviews(spark, d).select("k", C.derived_label().alias("derived"), C.verdict_faults().alias("fault"))


_CAPTURES = """x AS (SELECT o_orderkey AS k, o_orderkey % 13 != 0 AS locked, CASE o_custkey % 3 WHEN 0 THEN 'base_pattern' WHEN 1 THEN 'exception_territory' ELSE 'uncertain' END AS base_path,
  CASE o_orderkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['compression'] WHEN 2 THEN ['near_lid', 'other'] WHEN 3 THEN ['near_lid', 'near_lid'] ELSE ['compression', 'moon_phase'] END AS rules, CASE WHEN o_orderkey % 7 = 0 THEN '   short   ' || o_orderstatus ELSE 'the price stays far from it ' || o_orderstatus END AS rationale,
  CASE o_custkey % 4 WHEN 0 THEN 'not_evaluated' WHEN 1 THEN 'applies' WHEN 2 THEN 'does_not_apply' ELSE 'uncertain' END AS verdict, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'nothing like it was seen before' END AS other_rationale, o_orderkey % 3 = 0 AS proposed, o_orderstatus AS reviewer FROM orders)"""


def _captures(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = lambda x, n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (x % n + 1).cast("int"))
    rules = F.element_at(F.array(*[F.array(*[F.lit(r) for r in rs]).cast("array<string>") for rs in ([], ["compression"], ["near_lid", "other"], ["near_lid", "near_lid"], ["compression", "moon_phase"])]), (k % 5 + 1).cast("int"))
    rationale = F.concat(F.when(k % 7 == 0, "   short   ").otherwise("the price stays far from it "), F.col("o_orderstatus"))
    return table(spark, d, "orders").select(
        k.alias("k"), (k % 13 != 0).alias("locked"), said(c, 3, "base_pattern", "exception_territory", "uncertain").alias("base_path"), rules.alias("failed_rules"), rationale.alias("rationale"), rationale.alias("base_rationale"),
        said(c, 4, "not_evaluated", "applies", "does_not_apply", "uncertain").alias("exception_verdict"), F.when(k % 11 != 0, "nothing like it was seen before").alias("exception_rationale"), (k % 3 == 0).alias("proposed"), F.col("o_orderstatus").alias("reviewer"),
    )


_KNOWN = "[" + ", ".join(f"'{r}'" for r in C.BASE_RULES) + "]"


@query("base_lock_rules", f"""WITH {_CAPTURES} SELECT k, CASE WHEN NOT list_has_all({_KNOWN}, rules) THEN 'unknown_rule' WHEN length(trim(rationale)) < 20 THEN 'short_rationale' WHEN len(rules) != len(list_distinct(rules)) THEN 'duplicate_rule' WHEN base_path = 'base_pattern' AND len(rules) > 0 THEN 'base_with_rules'
 WHEN base_path = 'exception_territory' AND len(rules) = 0 THEN 'exception_without_rules' END AS fault FROM x""")
def _(spark, d):
    return _captures(spark, d).select("k", C.base_lock_faults().alias("fault"))


@query("capture_contract_v5", f"""WITH {_CAPTURES} SELECT k, CASE WHEN NOT locked THEN 'not_locked' WHEN len(rules) != len(list_distinct(rules)) THEN 'duplicate_rule' WHEN base_path = 'base_pattern' THEN CASE WHEN len(rules) > 0 THEN 'base_with_rules' WHEN verdict != 'not_evaluated' OR proposed THEN 'exception_on_base' END
  WHEN length(trim(rationale)) < 20 THEN 'short_base_rationale' WHEN base_path = 'exception_territory' AND len(rules) = 0 THEN 'exception_without_rules' WHEN verdict = 'not_evaluated' THEN 'no_verdict' WHEN verdict = 'applies' THEN CASE WHEN NOT proposed THEN 'no_proposal' END
  WHEN other_rationale IS NULL THEN 'short_exception_rationale' WHEN proposed THEN 'proposal_without_exception' END AS fault, CASE WHEN base_path = 'base_pattern' OR verdict = 'applies' THEN 'coil' WHEN base_path = 'exception_territory' AND verdict = 'does_not_apply' THEN 'not_coil' ELSE 'uncertain' END AS label FROM x""")
def _(spark, d):
    return _captures(spark, d).select("k", C.capture_faults().alias("fault"), C.derived_label().alias("label"))


@query("draft_match", f"""WITH {_CAPTURES} SELECT k, locked AND k % 17 != 0 AND k % 4 != 1 AND k % 19 != 0 AS matches FROM x""")
def _(spark, d):
    k = F.col("k")
    both = _captures(spark, d).select(
        "k", F.struct("reviewer", "base_path", "failed_rules", "rationale").alias("kept"),
        F.struct(F.concat(F.lit(" "), F.col("reviewer")).alias("reviewer"), F.when(k % 17 == 0, F.lit("other")).otherwise(F.col("base_path")).alias("base_path"), F.when(k % 4 == 1, F.array(F.lit("top_geometry"))).otherwise(F.col("failed_rules")).alias("failed_rules"),
                 F.concat(F.when(k % 19 == 0, "x").otherwise(""), F.col("rationale"), F.lit("  ")).alias("rationale"), "locked", F.lit(1).alias("policy")).alias("draft"),
    )
    return both.select("k", C.draft_matches("draft", "kept").alias("matches"))


@query("redact_prelock", "SELECT o_orderkey, o_custkey, o_orderstatus = 'F' AS locked, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS score, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS grade FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") == "F").alias("locked"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("grade"))
    return C.redacted(o, "locked", ["o_orderkey", "o_custkey"])


_CANDLES = f"{DILATED_SQL}{_QUARTERS}, lq AS (SELECT symbol, max(q_idx) AS last_q FROM qq GROUP BY symbol), ca AS (SELECT qq.*, q_idx = last_q AND last_month % 3 != 0 AS open_quarter FROM qq JOIN lq USING (symbol))"
_CLICKS = "k AS (SELECT symbol, CASE WHEN idx % 10 = 0 THEN bar_date + 1 ELSE bar_date END AS date, CASE idx % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'close' ELSE 'high' END AS field, CASE idx % 4 WHEN 0 THEN low WHEN 1 THEN close ELSE high END AS price, idx FROM c WHERE idx % 5 != 1)"


def _clicks(spark, d):
    i = F.col("idx")
    field = F.when(i % 4 == 0, "low").when(i % 4 == 1, "close").otherwise("high")
    price = F.when(i % 4 == 0, F.col("low")).when(i % 4 == 1, F.col("close")).otherwise(F.col("high"))
    return _clean(spark, d).filter(i % 5 != 1).select("symbol", F.when(i % 10 == 0, F.date_add("bar_date", 1)).otherwise(F.col("bar_date")).alias("date"), field.alias("field"), price.alias("price"))


def _quarters(spark, d):
    return B.quarterly(_clean(spark, d))


@query("evidence_snap", f"WITH {_CANDLES}, {_CLICKS} SELECT k.symbol, k.date, CASE WHEN open_quarter IS NULL THEN 'no_candle' WHEN open_quarter THEN 'open_quarter' WHEN abs(price - CASE field WHEN 'low' THEN low WHEN 'close' THEN close ELSE high END) > greatest(1e-8, abs(CASE field WHEN 'low' THEN low WHEN 'close' THEN close ELSE high END) * 1e-8) THEN 'other_price' END AS fault FROM k LEFT JOIN ca ON k.symbol = ca.symbol AND k.date = ca.bar_date")
def _(spark, d):
    q = _quarters(spark, d)
    last = q.groupBy("symbol").agg(F.max("q_idx").alias("last_q"))
    candles = q.join(last, "symbol").select("symbol", F.col("bar_date").alias("date"), *C.PRICES, ((F.col("q_idx") == F.col("last_q")) & (F.col("last_month") % 3 != 0)).alias("open_quarter"))
    return C.snapped_evidence(_clicks(spark, d), candles).select("symbol", "date", "fault")


@query("join_clicks_to_quarters", f"WITH {DILATED_SQL}{_QUARTERS}, {_CLICKS} SELECT k.symbol, k.date, field, q_idx AS idx, CASE field WHEN 'low' THEN qq.low WHEN 'close' THEN qq.close ELSE qq.high END AS price FROM k LEFT JOIN qq ON k.symbol = qq.symbol AND k.date = qq.bar_date")
def _(spark, d):
    return C.clicked(_clicks(spark, d).drop("price"), _quarters(spark, d))


@query("join_override_points", f"""WITH {DILATED_SQL}{_QUARTERS}, p AS (SELECT symbol, strftime(bar_date + 3, '%Y-%m-%d') AS date, CASE WHEN idx % 3 = 0 THEN high * 1.01 END AS price, CASE WHEN idx % 2 = 0 THEN 'structural_retest' END AS role, idx FROM c WHERE idx % 7 = 2),
 s AS (SELECT * FROM qq z WHERE q_idx < (SELECT max(q_idx) FROM qq y WHERE y.symbol = z.symbol) OR last_month % 3 = 0)
 SELECT p.symbol, date, c.idx AS month_idx, q_idx, s.bar_date AS quarter_date, coalesce(price, c.high) AS price, coalesce(role, 'major_top') AS role FROM p JOIN c ON c.symbol = p.symbol AND strftime(c.bar_date, '%Y-%m') = date[:7] JOIN s ON s.symbol = p.symbol AND s.year = year(c.bar_date) AND s.qtr = quarter(c.bar_date)""")
def _(spark, d):
    months = _clean(spark, d)
    i = F.col("idx")
    points = months.filter(i % 7 == 2).select("symbol", F.date_format(F.date_add("bar_date", 3), "yyyy-MM-dd").alias("date"), F.when(i % 3 == 0, F.col("high") * 1.01).alias("price"), F.when(i % 2 == 0, "structural_retest").alias("role"))
    structural = B.completed(B.quarterly(months), F.lit("9999-12-31").cast("date"))
    return C.reviewed_points(points, months, structural)


@query("join_manifest_identity", "WITH a AS (SELECT c_custkey AS t, c_mktsegment AS bars_hash, c_nationkey::VARCHAR AS snapshot_hash FROM customer WHERE c_custkey % 11 != 0) SELECT c_custkey AS ticker, CASE WHEN t IS NULL THEN 'no_snapshot' WHEN c_custkey % 5 = 0 THEN 'bars_hash' WHEN c_custkey % 7 = 0 THEN 'snapshot_hash' END AS fault FROM customer LEFT JOIN a ON t = c_custkey")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_mktsegment").alias("bars_hash"), F.col("c_nationkey").cast("string").alias("snapshot_hash"))
    t = F.col("ticker")
    named = c.withColumns({"bars_hash": F.when(t % 5 != 0, F.col("bars_hash")), "snapshot_hash": F.when(t % 7 == 0, F.concat("snapshot_hash", F.lit("!"))).otherwise(F.col("snapshot_hash"))})
    return C.manifest_faults(named, c.filter(t % 11 != 0))


@query("corpus_freeze", "WITH k AS (SELECT o_custkey AS t, max(o_orderdate)::DATE AS data_date, arg_max(o_totalprice, o_orderkey) AS last_close FROM orders GROUP BY 1), f AS (SELECT c_custkey AS ticker, CASE WHEN t IS NULL THEN 'no_snapshot' WHEN c_custkey % 6 = 0 THEN 'data_date' WHEN c_custkey % 10 = 1 THEN 'last_close' END AS fault FROM customer LEFT JOIN k ON t = c_custkey) SELECT CASE WHEN fault IS NULL THEN 'frozen' ELSE 'refused' END AS status, fault, count(*) AS n FROM f GROUP BY ALL")
def _(spark, d):
    cache = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ticker")).agg(F.to_date(F.max("o_orderdate")).alias("data_date"), F.max_by("o_totalprice", "o_orderkey").alias("last_close"))
    t = F.col("ticker")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("ticker")).join(cache, "ticker", "left").withColumns({"data_date": F.when(t % 6 == 0, F.date_add("data_date", 1)).otherwise(F.col("data_date")), "last_close": F.when(t % 10 == 1, F.col("last_close") + 1).otherwise(F.col("last_close"))})
    return C.frozen_corpus(rows, cache, ["data_date", "last_close"]).groupBy("status", "fault").agg(F.count("*").alias("n"))


@query("release_typed_row", "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '  ' WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE ' ' || o_totalprice END AS a, CASE o_orderkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN '' ELSE 'maybe' END AS b, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority || ' ' END AS c FROM orders) SELECT o_orderkey, try_cast(trim(a) AS DOUBLE) AS number, CASE b WHEN 'True' THEN true WHEN 'False' THEN false END AS flag, nullif(trim(c), '') AS word FROM t")
def _(spark, d):
    k = F.col("o_orderkey")
    a = F.when(k % 5 == 0, "  ").when(k % 7 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
    b = F.element_at(F.array(*[F.lit(x) for x in ("True", "False", "", "maybe")]), (k % 4 + 1).cast("int"))
    c = F.when(k % 3 == 0, "").otherwise(F.concat("o_orderpriority", F.lit(" ")))
    return table(spark, d, "orders").select("o_orderkey", C.typed_cell(a, "double").alias("number"), C.typed_cell(b, "boolean").alias("flag"), C.typed_cell(c, "string").alias("word"))


@query("rev_session_create", """WITH g AS (SELECT o_custkey AS session, string_agg('["' || upper(o_orderstatus) || '", {}]', ', ' ORDER BY o_orderkey) AS queue, count(*) AS items FROM orders GROUP BY 1),
 f AS (SELECT session, items, sha256('{"algorithm_version": "2.5.0", "items": [' || queue || '], "snapshot": {}, "source": "screen"}') AS fingerprint FROM g), o AS (SELECT fingerprint, min(session) AS opened FROM f GROUP BY 1)
 SELECT session, items, opened, CASE WHEN session = opened THEN 'created' ELSE 'resumed' END AS outcome FROM f JOIN o USING (fingerprint)""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), F.lit("screen").alias("source"), F.lit("2.5.0").alias("algorithm_version"), F.col("o_orderkey").alias("position"), F.lower("o_orderstatus").alias("ticker"))
    return C.resumed(C.session_fingerprints(o))


@query("rev_export", "SELECT o_custkey AS session, bool_or(o_orderkey % 2 = 0) AS fresh, count(*) FILTER (o_orderstatus = 'P') AS pending, CASE WHEN bool_or(o_orderkey % 2 = 0) AND count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'blocked' ELSE 'open' END AS export FROM orders GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("session")).agg(F.bool_or(F.col("o_orderkey") % 2 == 0).alias("fresh"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
    return C.exportable(g.withColumn("finalised", F.col("pending") == 0)).drop("finalised")
