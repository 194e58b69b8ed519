"""Queries over review records, releases and cohorts, and the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basewatch.operators import corpus as C
from basewatch.plans.registry import registry
from basewatch.sources.tables import table

query, QUERIES, SQL = registry()

_RECORDS = """r AS (SELECT event_id, user_id AS sample, ts AS created_at, CASE event_type WHEN 'click' THEN 'approved' WHEN 'view' THEN 'corrected' WHEN 'error' THEN 'revoked' END AS decision,
  CASE event_id % 5 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'not_coil' WHEN 4 THEN NULL ELSE 'coil' END AS coil_label, CASE WHEN event_id % 6 = 0 THEN 'low' ELSE 'high' END AS confidence,
  CASE (value * 100)::BIGINT % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS human_grade, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS model_grade, CASE WHEN event_id % 11 != 0 THEN ts::DATE END AS as_of,
  CASE WHEN event_id % 13 != 0 THEN 'v' || (event_id % 2) END AS algorithm_version, CASE WHEN event_id % 17 != 0 THEN md5(event_id::VARCHAR) ELSE '' END AS bars_hash, CASE event_id % 3 WHEN 0 THEN 'seen' WHEN 1 THEN '  ' END AS note,
  CASE WHEN event_id % 7 = 0 THEN 5 ELSE 4 END AS schema_version, CASE WHEN event_id % 14 = 0 THEN 2 ELSE 1 END AS label_policy FROM events),
 q AS (SELECT *, concat_ws(',', CASE WHEN NOT ((schema_version = 4 AND label_policy = 1) OR (schema_version = 5 AND label_policy = 2)) THEN 'unsupported_label_contract' END, CASE WHEN coil_label IS NULL THEN 'missing_coil_label' END,
   CASE WHEN coil_label = 'uncertain' THEN 'uncertain_label' END, CASE WHEN confidence = 'low' THEN 'low_confidence' END, CASE WHEN coil_label = 'coil' AND human_grade IS NULL THEN 'missing_human_grade' END, CASE WHEN as_of IS NULL THEN 'missing_as_of' END,
   CASE WHEN algorithm_version IS NULL THEN 'missing_algorithm_version' END, CASE WHEN bars_hash = '' THEN 'missing_bar_data_hash' END,
   CASE WHEN (coalesce(decision, '') = 'corrected' OR coalesce(coil_label, '') = 'not_coil') AND trim(coalesce(note, '')) = '' THEN 'missing_rationale' END) AS reasons FROM r),
 s AS (SELECT *, CASE WHEN reasons = '' THEN 'candidate' ELSE 'quarantine' END AS status FROM q QUALIFY row_number() OVER (PARTITION BY sample ORDER BY created_at DESC, event_id DESC) = 1)"""


def _case(value, of: dict):
    return F.coalesce(*[F.when(value == k, v) for k, v in of.items()])


def _records(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("sample"), F.col("ts").alias("created_at"), _case(F.col("event_type"), {"click": "approved", "view": "corrected", "error": "revoked"}).alias("decision"),
        F.when(i % 5 == 0, "uncertain").when(i % 5 == 1, "not_coil").when(i % 5 != 4, "coil").alias("coil_label"), F.when(i % 6 == 0, "low").otherwise("high").alias("confidence"),
        _case(F.round(F.col("value") * 100).cast("long") % 4, {0: "A", 1: "B", 2: "C"}).alias("human_grade"), _case(i % 3, {0: "A", 1: "B"}).alias("model_grade"), F.when(i % 11 != 0, F.to_date("ts")).alias("as_of"),
        F.when(i % 13 != 0, F.concat(F.lit("v"), (i % 2).cast("string"))).alias("algorithm_version"), F.when(i % 17 != 0, F.md5(i.cast("string"))).otherwise("").alias("bars_hash"), _case(i % 3, {0: "seen", 1: "  "}).alias("note"),
        F.when(i % 7 == 0, 5).otherwise(4).alias("schema_version"), F.when(i % 14 == 0, 2).otherwise(1).alias("label_policy"),
    )


@query("quarantine_reasons", f"WITH {_RECORDS} SELECT event_id, reasons FROM q")
def _(spark, d):
    return _records(spark, d).select("event_id", F.array_join(C.quarantine_reasons(), ",").alias("reasons"))


@query("corpus_build", f"WITH {_RECORDS} SELECT sample, event_id, status, reasons FROM s")
def _(spark, d):
    return C.samples(_records(spark, d)).select("sample", "event_id", "status", F.array_join("reasons", ",").alias("reasons"))


@query("agg_corpus_report", f"""WITH {_RECORDS}, c AS (SELECT 'status' AS section, status AS key, NULL AS other FROM s UNION ALL SELECT 'verdict', decision, NULL FROM s UNION ALL SELECT 'label', coil_label, NULL FROM s UNION ALL SELECT 'confidence', confidence, NULL FROM s
 UNION ALL SELECT 'grade', human_grade, NULL FROM s UNION ALL SELECT 'human_vs_model', human_grade, model_grade FROM s WHERE model_grade IS NOT NULL) SELECT section, key, other, count(*) AS n FROM c WHERE key IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    return C.report(C.samples(_records(spark, d)))


_ACCURACY = f"""WITH {_RECORDS}, a AS (SELECT count(*) FILTER (decision IN ('approved', 'corrected')) AS top_decisions, count(*) FILTER (decision = 'approved') AS top_exact_matches, count(*) FILTER (coil_label IN ('coil', 'not_coil')) AS definite_labels, count(*) FILTER (coil_label = 'coil') AS coil_candidates FROM s WHERE status = 'candidate'),
 b AS (SELECT *, round(top_exact_matches / nullif(top_decisions, 0), 4) AS top_exact_match_rate, round(coil_candidates / nullif(definite_labels, 0), 4) AS coil_precision FROM a)"""


@query("agg_corpus_accuracy", _ACCURACY + " SELECT * FROM b")
def _(spark, d):
    return C.accuracy(C.samples(_records(spark, d)))


@query("agg_promotion_gate", _ACCURACY + """ SELECT top_decisions >= 1000 AND coalesce(top_exact_match_rate >= 0.9, false) AND coalesce(coil_precision >= 0.1, false) AS passed,
 concat_ws('; ', CASE WHEN top_decisions < 1000 THEN 'only ' || top_decisions || ' labeled samples; requires 1000' END, CASE WHEN coalesce(top_exact_match_rate < 0.9, true) THEN 'top exact-match rate ' || coalesce(format('{:.4f}', top_exact_match_rate), 'None') || ' is below 0.900' END,
  CASE WHEN coalesce(coil_precision < 0.1, true) THEN 'coil candidate precision ' || coalesce(format('{:.4f}', coil_precision), 'None') || ' is below 0.100' END) AS failures FROM b""")
def _(spark, d):
    return C.promotion_gate(C.accuracy(C.samples(_records(spark, d))), 1000, 0.9, 0.1)


@query("set_dedupe_events", "SELECT event_id // 2 AS event, count(*) AS times, min(event_type) != max(event_type) AS conflict FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("event"), "event_type")
    return C.unique_events(e, "event", F.col("event_type"))


@query("eval_classification", """WITH a AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'ready' WHEN '2-HIGH' THEN 'breakout_now' WHEN '3-MEDIUM' THEN 'watch' WHEN '5-LOW' THEN 'historical_or_late' END AS state, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS eligible,
  CASE WHEN o_orderkey % 7 = 0 THEN true WHEN o_orderkey % 7 = 1 THEN false END AS abstained, o_orderstatus = 'F' AS recognized, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS mature FROM orders)
 SELECT o_orderkey, CASE WHEN abstained THEN 'uncertain' WHEN recognized THEN 'coil' ELSE 'not_coil' END AS shape, CASE WHEN mature THEN 'mature' WHEN NOT mature THEN 'immature' ELSE 'uncertain' END AS maturity,
  CASE WHEN abstained THEN 'uncertain' WHEN state IN ('ready', 'breakout_now') AND eligible IS DISTINCT FROM false THEN 'ready' ELSE 'not_ready' END AS readiness,
  CASE WHEN abstained THEN 'abstain' WHEN state IN ('ready', 'breakout_now') AND eligible IS DISTINCT FROM false THEN 'actionable' WHEN state = 'watch' THEN 'watch' ELSE 'avoid' END AS action FROM a""")
def _(spark, d):
    k = F.col("o_orderkey")
    yes = lambda n: F.when(k % n == 0, True).when(k % n == 1, False)
    state = _case(F.col("o_orderpriority"), {"1-URGENT": "ready", "2-HIGH": "breakout_now", "3-MEDIUM": "watch", "5-LOW": "historical_or_late"})
    a = table(spark, d, "orders").select("o_orderkey", state.alias("state"), yes(3).alias("eligible"), yes(7).alias("abstained"), (F.col("o_orderstatus") == "F").alias("recognized"), yes(5).alias("mature"))
    return a.select("o_orderkey", *[c.alias(n) for n, c in C.predicted_classes().items()])


@query("agg_policy_checks", """WITH c AS (SELECT o_orderpriority AS name, count(*) AS episodes, count(*) FILTER (o_orderkey % 2 = 0) AS applicable, count(*) FILTER (o_orderkey % 2 = 0 AND o_orderstatus != 'P') AS supported, count(*) FILTER (o_orderkey % 2 = 0 AND o_custkey % 3 != 0) AS included, count(*) FILTER (o_orderkey % 2 = 0 AND o_custkey % 3 != 0 AND o_totalprice > 150000) AS interventions FROM orders GROUP BY 1),
 z AS (SELECT *, interventions::DOUBLE / nullif(included, 0) AS p, 1.959963984540054 AS z, included::DOUBLE AS m FROM c)
 SELECT name, episodes, applicable, supported, included, interventions, round(p, 6) AS rate, round(greatest(0, (p + z * z / (2 * m)) / (1 + z * z / m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)), 6) AS low, round(least(1, (p + z * z / (2 * m)) / (1 + z * z / m) + z * sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)), 6) AS high FROM z""")
def _(spark, d):
    k = F.col("o_orderkey")
    return C.policy_checks(table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), (k % 2 == 0).alias("applicable"), (F.col("o_orderstatus") != "P").alias("supported"), (F.col("o_custkey") % 3 != 0).alias("included"), (F.col("o_totalprice") > 150000).alias("intervention")))


@query("topk_cap_majors", "WITH p AS (SELECT user_id AS key, event_id AS idx, event_type = 'purchase' AND event_id % 5 = 0 AS member FROM events), r AS (SELECT *, count(*) FILTER (member) OVER (PARTITION BY key) AS members, row_number() OVER (PARTITION BY key, member ORDER BY idx DESC) AS back FROM p) SELECT key, idx, member FROM r WHERE member OR back <= 3 - members")
def _(spark, d):
    return C.capped(table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("idx"), ((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0)).alias("member")))


@query("set_dedupe_pairs", "SELECT o_custkey AS a, o_orderpriority AS b, o_totalprice AS score, o_orderkey AS nth FROM orders QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY score DESC, nth) = 1")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("b"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("nth"))
    return C.best_by_ends(o, ["a", "b"], "score", "nth")


@query("join_event_links", "SELECT o_orderkey AS item, event_id AS review, event_type FROM orders LEFT JOIN events ON event_id = CASE WHEN o_orderstatus = 'F' THEN o_orderkey END")
def _(spark, d):
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("link"))
    log = table(spark, d, "events").select(F.col("event_id").alias("review"), "event_type")
    return items.join(log, F.col("link") == F.col("review"), "left").drop("link")


@query("join_release_diff", """WITH e AS (SELECT o_custkey AS ticker, o_orderstatus AS hash, o_orderkey AS position FROM orders WHERE o_orderkey % 9 != 0), a AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS ticker, CASE WHEN o_orderkey % 4 = 0 THEN 'P' ELSE o_orderstatus END AS hash, o_orderkey AS position FROM orders WHERE o_orderkey % 8 != 0)
 SELECT position, e.ticker AS expected_ticker, e.hash AS expected_hash, a.ticker AS actual_ticker, a.hash AS actual_hash, CASE WHEN a.ticker IS NULL THEN 'missing' WHEN e.ticker IS NULL THEN 'extra' WHEN e.ticker != a.ticker THEN 'order' WHEN e.hash IS NOT DISTINCT FROM a.hash THEN 'same' ELSE 'hash' END AS outcome FROM e FULL JOIN a USING (position)""")
def _(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    e = o.filter(k % 9 != 0).select(k.alias("position"), F.col("o_custkey").alias("ticker"), F.col("o_orderstatus").alias("hash"))
    a = o.filter(k % 8 != 0).select(k.alias("position"), F.when(k % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("ticker"), F.when(k % 4 == 0, "P").otherwise(F.col("o_orderstatus")).alias("hash"))
    return C.compared_releases(e, a)


@query("rev_staleness", "SELECT event_id, coalesce(DATE '2024-01-15' > CASE WHEN event_id % 4 != 0 THEN ts::DATE END, false) OR coalesce('v1' != CASE WHEN event_id % 6 != 0 THEN 'v' || (event_id % 2) END, false) AS stale FROM events")
def _(spark, d):
    i = F.col("event_id")
    stale = C.is_stale(F.when(i % 4 != 0, F.to_date("ts")), F.when(i % 6 != 0, F.concat(F.lit("v"), (i % 2).cast("string"))), F.lit("2024-01-15").cast("date"), F.lit("v1"))
    return table(spark, d, "events").select("event_id", stale.alias("stale"))


@query("ttl_freshness", "SELECT event_id, coalesce(ts <= TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' - ts < INTERVAL 24 HOURS, false) AS fresh FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", C.is_fresh(F.col("ts").cast("timestamp"), F.to_timestamp(F.lit("2024-01-15 00:00:00"))).alias("fresh"))


@query("src_cache_fallback", "WITH w AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 != 0 THEN c_acctbal END AS v FROM customer) SELECT k, coalesce(w.v, s.v) AS v, CASE WHEN w.v IS NOT NULL THEN 'writable' WHEN s.v IS NOT NULL THEN 'seed' ELSE 'missing' END AS origin FROM w FULL JOIN s USING (k)")
def _(spark, d):
    w = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("v"))
    return C.first_known(w, s, "k", "v")


@query("evidence_rule_shape", """WITH p AS (SELECT user_id * 1000 + event_id // 40 AS rule, row_number() OVER (PARTITION BY user_id, event_id // 40 ORDER BY event_id) + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS sequence, event_id AS nth, event_id - CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS id, CASE WHEN event_id % 23 = 0 THEN ts - INTERVAL 90 DAYS ELSE ts END::DATE AS date FROM events),
 o AS (SELECT *, row_number() OVER w AS n, lag(date) OVER w AS before FROM p WINDOW w AS (PARTITION BY rule ORDER BY sequence, id))
 SELECT rule, concat_ws(',', CASE WHEN max((sequence != n)::INT) = 1 THEN 'sequence_not_contiguous' END, CASE WHEN count(DISTINCT id) < count(*) THEN 'ids_not_unique' END, CASE WHEN count(DISTINCT date) < count(*) THEN 'dates_not_distinct' END, CASE WHEN max(coalesce(date < before, false)::INT) = 1 THEN 'not_chronological' END) AS faults FROM o GROUP BY rule""")
def _(spark, d):
    i = F.col("event_id")
    block = F.floor(i / 40)
    w = Window.partitionBy("user_id", "block").orderBy("event_id")
    e = table(spark, d, "events").withColumn("block", block)
    return C.evidence_faults(e.select((F.col("user_id") * 1000 + F.col("block")).alias("rule"), (F.row_number().over(w) + F.when(i % 50 == 0, 1).otherwise(0)).alias("sequence"), (i - F.when(i % 31 == 0, 1).otherwise(0)).alias("id"), F.when(i % 23 == 0, F.date_sub(F.to_date("ts"), 90)).otherwise(F.to_date("ts")).alias("date")))


@query("cohort_label", "SELECT c_custkey AS ticker, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'calibration' ELSE 'prospective' END AS cohort, c_custkey IN (SELECT user_id FROM events) AS prior_reviewed, c_custkey IN (SELECT s_suppkey FROM supplier) AS tuning_anchor FROM customer")
def _(spark, d):
    named = lambda t, c: table(spark, d, t).select(F.col(c).cast("long").alias("ticker"))
    return C.cohorts(named("customer", "c_custkey"), table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").cast("long").alias("ticker")), named("events", "user_id"), named("supplier", "s_suppkey"))


@query("agg_holdout_eligibility", """WITH o AS (SELECT o_custkey AS setup, min(o_orderpriority) AS stratum, min(o_orderpriority) != max(o_orderpriority) AS conflict FROM orders GROUP BY 1), n AS (SELECT count(*) AS setups, count(*) FILTER (conflict) AS conflicts, count(*) FILTER (stratum = '1-URGENT') AS a, count(*) FILTER (stratum = '2-HIGH') AS b, count(*) FILTER (stratum = '3-MEDIUM') AS c, count(*) FILTER (stratum = '5-LOW') AS e FROM o)
 SELECT setups, conflicts, concat_ws(',', CASE WHEN setups < 400 THEN 'insufficient_unique_setups' END, CASE WHEN conflicts > 0 THEN 'stratum_conflict' END, CASE WHEN greatest(abs(100 * a / setups - 30), abs(100 * b / setups - 30), abs(100 * c / setups - 20), abs(100 * e / setups - 20)) > 1 THEN 'composition_out_of_range' END) AS failures FROM n""")
def _(spark, d):
    return C.composition(table(spark, d, "orders").select(F.col("o_custkey").alias("setup"), F.col("o_orderpriority").alias("stratum")), {"1-URGENT": 30, "2-HIGH": 30, "3-MEDIUM": 20, "5-LOW": 20}, 400)


@query("agg_composition_counts", "SELECT o_orderstatus AS lifecycle, o_orderpriority AS grade, count(*) AS n, count(DISTINCT o_custkey) AS tickers FROM orders GROUP BY CUBE (1, 2)")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("lifecycle"), F.col("o_orderpriority").alias("grade"), "o_custkey").cube("lifecycle", "grade").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("tickers"))


@query("image_name", r"SELECT o_orderkey, concat_ws('_', upper(o_orderstatus), trim(regexp_replace(o_orderpriority || ' /' || o_custkey, '[^A-Za-z0-9._-]+', '-', 'g'), '-._'), trim(regexp_replace('(1 mo)', '[^A-Za-z0-9._-]+', '-', 'g'), '-._')) || '.png' AS name FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.image_name(F.upper("o_orderstatus"), F.concat(F.col("o_orderpriority"), F.lit(" /"), F.col("o_custkey").cast("string")), F.lit("(1 mo)")).alias("name"))


@query("math_annualized", "SELECT o_custkey, round(pow(arg_max(o_totalprice, o_orderkey) / arg_min(o_totalprice, o_orderkey), 365.25 / (max(o_orderdate)::DATE - min(o_orderdate)::DATE)) - 1, 6) AS annual FROM orders GROUP BY 1 HAVING max(o_orderdate)::DATE - min(o_orderdate)::DATE > 365")
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", "o_orderkey").alias("last"), F.min_by("o_totalprice", "o_orderkey").alias("first"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days")).filter("days > 365")
    return g.select("o_custkey", F.round(F.pow(F.col("last") / F.col("first"), 365.25 / F.col("days")) - 1, 6).alias("annual"))
