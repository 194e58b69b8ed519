"""Queries over labels, their agreement with an analysis, and detections in images, and the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basewatch.operators import bars as B
from basewatch.operators import detections as D
from basewatch.operators import evaluate as E
from basewatch.operators import gold as G
from basewatch.plans.price import _NUMBERED, _QUARTERS, _clean
from basewatch.plans.registry import registry
from basewatch.sources.tables import DILATED_SQL, table

query, QUERIES, SQL = registry()


@query("gold_completed_quarters", f"""WITH {DILATED_SQL}{_NUMBERED}, k AS (SELECT symbol, bar_date FROM c WHERE bar_date <= CASE WHEN length(symbol) % 4 = 0 THEN DATE '2009-05-01' ELSE DATE '2009-06-01' END AND (idx + 211 * length(symbol)) % 1499 != 7),
 qs AS (SELECT symbol, year(bar_date) AS y, quarter(bar_date) AS qt, count(*) = 3 AND count(DISTINCT month(bar_date)) = 3 AS whole FROM k GROUP BY ALL), mx AS (SELECT symbol, max(bar_date) AS last FROM k GROUP BY 1),
 n AS (SELECT qs.*, last, row_number() OVER (PARTITION BY symbol ORDER BY y, qt) - 1 AS place, 4 * y + qt AS ordinal FROM qs JOIN mx USING (symbol)), o AS (SELECT *, place = 0 AND NOT whole AND NOT (y = year(last) AND qt = quarter(last)) AS fragment FROM n),
 p AS (SELECT *, lag(CASE WHEN NOT fragment THEN ordinal END) OVER (PARTITION BY symbol ORDER BY place) AS prior FROM o), f AS (SELECT *, CASE WHEN NOT fragment AND NOT whole THEN 'incomplete_quarter' WHEN ordinal != prior + 1 THEN 'gap' END AS fault FROM p)
 SELECT symbol, count(*) FILTER (NOT fragment) AS quarters, CASE WHEN month(max(last)) % 3 != 0 THEN 'open_cutoff' ELSE arg_min(fault, place) FILTER (fault IS NOT NULL) END AS fault FROM f GROUP BY symbol""")
def _(spark, d):
    cut = F.when(F.length("symbol") % 4 == 0, "2009-05-01").otherwise("2009-06-01").cast("date")
    return G.quarter_verdicts(_clean(spark, d).filter((F.col("bar_date") <= cut) & ((F.col("idx") + 211 * F.length("symbol")) % 1499 != 7)).select("symbol", "bar_date"))


@query("gold_materialize", f"""WITH {DILATED_SQL}{_QUARTERS}, l AS (SELECT symbol, max(q_idx) AS last FROM qq GROUP BY 1), a AS (SELECT symbol, q_idx // 24 AS structure, q_idx AS idx, high AS price, last FROM qq JOIN l USING (symbol) WHERE q_idx % 5 = 1),
 f AS (SELECT symbol, structure, max(last) AS last, regr_slope(price, idx) AS s, regr_intercept(price, idx) AS i, count(*) AS n FROM a GROUP BY 1, 2), e AS (SELECT symbol, structure, avg(abs(price - (i + s * idx)) / price) * 100 AS err FROM a JOIN f USING (symbol, structure) GROUP BY 1, 2),
 v AS (SELECT *, i + s * last AS here, CASE WHEN n < 2 THEN 'one_candle' WHEN i + s * last <= 0 THEN 'not_positive' END AS fault FROM f JOIN e USING (symbol, structure))
 SELECT symbol, structure, fault, CASE WHEN fault IS NULL THEN round(s, 8) END AS slope_per_bar, CASE WHEN fault IS NULL THEN round(i, 6) END AS intercept, CASE WHEN fault IS NULL THEN round(here, 6) END AS value_at_cutoff, CASE WHEN fault IS NULL THEN round(s * 400 / here, 4) END AS slope_pct_per_year,
  CASE WHEN fault IS NULL THEN CASE WHEN s * 400 / here > 0.5 THEN 'rising' WHEN s * 400 / here < -0.5 THEN 'falling' ELSE 'flat' END END AS direction, CASE WHEN fault IS NULL THEN round(err, 6) END AS fit_error_pct FROM v""")
def _(spark, d):
    q = B.quarterly(_clean(spark, d))
    last = q.groupBy("symbol").agg(F.max("q_idx").alias("projected_idx"))
    i = F.col("q_idx")
    return G.fitted_lines(q.join(last, "symbol").filter(i % 5 == 1).select("symbol", F.floor(i / 24).alias("structure"), i.alias("idx"), F.col("high").alias("price"), "projected_idx"), ["symbol", "structure"])


@query("gold_milestones", """WITH l AS (SELECT c_custkey AS episode, CASE WHEN c_custkey % 9 > 0 THEN c_nationkey % 3 END AS a, DATE '1995-06-01' + (c_custkey % 900)::INT AS r FROM customer),
 o AS (SELECT o_custkey AS episode, CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE o_orderkey % 4 - 1 END AS s, o_orderdate::DATE AS day, o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS t FROM orders),
 w AS (SELECT episode, min(day) AS watch FROM o JOIN l USING (episode) WHERE t = 'P' AND k % 3 > 0 AND (s IS NULL OR s = a) GROUP BY 1), x AS (SELECT episode, min(day) AS action FROM o JOIN l USING (episode) WHERE k % 2 = 0 AND (p IN ('1-URGENT', '2-HIGH') OR (p = '3-MEDIUM' AND t IN ('F', 'O'))) AND (s IS NULL OR s = a) GROUP BY 1)
 SELECT episode, CASE WHEN a IS NOT NULL THEN r END AS recognizable, watch, action, CASE WHEN (a IS NOT NULL AND (r > watch OR r > action)) OR watch > action THEN 'not_chronological' END AS fault FROM l LEFT JOIN w USING (episode) LEFT JOIN x USING (episode)""")
def _(spark, d):
    k, c, t, p = F.col("o_orderkey"), F.col("c_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    labels = table(spark, d, "customer").select(c.alias("episode"), F.when(c % 9 > 0, F.col("c_nationkey") % 3).alias("active_id"), F.date_add(F.lit("1995-06-01").cast("date"), (c % 900).cast("int")).alias("recognition"))
    o = table(spark, d, "orders").withColumns({"episode": F.col("o_custkey"), "structure_id": F.when(k % 4 > 0, k % 4 - 1), "day": F.to_date("o_orderdate")})
    phases = o.select("episode", F.when(t == "P", "compression").otherwise("base").alias("kind"), (k % 3 > 0).alias("present"), "structure_id", F.col("day").alias("start"))
    kind = F.when(p == "1-URGENT", "breakout").when(p == "2-HIGH", "continuation").when(p == "3-MEDIUM", "retest").otherwise("invalidation")
    return G.milestones(labels, phases, o.select("episode", kind.alias("kind"), (k % 2 == 0).alias("action_signal"), F.when(t == "F", "shallow").when(t == "O", "deep").otherwise("failed").alias("retest_state"), "structure_id", F.col("day").alias("at")))


@query("classify_direction", "SELECT o_orderkey, CASE WHEN x > 0.5 THEN 'rising' WHEN x < -0.5 THEN 'falling' ELSE 'flat' END AS boundary, CASE WHEN o_orderkey % 9 = 0 THEN 'insufficient_history' WHEN x > 2 THEN 'up' WHEN x < -2 THEN 'down' ELSE 'flat' END AS trend FROM (SELECT o_orderkey, o_totalprice / 50000 - 4 AS x FROM orders)")
def _(spark, d):
    x = F.col("o_totalprice") / 50000 - 4
    return table(spark, d, "orders").select("o_orderkey", G.direction(x).alias("boundary"), G.prior_trend(F.when(F.col("o_orderkey") % 9 != 0, x)).alias("trend"))


@query("eval_phases", """WITH e AS (SELECT o_custkey AS episode, o_orderpriority AS kind, min(o_orderdate)::DATE AS s, (max(o_orderdate) + INTERVAL 200 DAYS)::DATE AS t FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus != 'P' GROUP BY 1, 2), p AS (SELECT o_custkey AS episode, o_orderpriority AS kind, max(o_totalprice) > 100000 AS present, CASE WHEN count(*) > 1 THEN min(o_orderdate)::DATE END AS s, max(o_orderdate)::DATE AS t FROM orders WHERE o_orderkey % 3 != 1 GROUP BY 1, 2),
 x AS (SELECT coalesce(e.episode, p.episode) AS episode, coalesce(e.kind, p.kind) AS kind, e.s IS NOT NULL AS ex, coalesce(present, false) AS pr, abs(year(e.s) * 4 + quarter(e.s) - year(p.s) * 4 - quarter(p.s)) AS a, abs(year(e.t) * 4 + quarter(e.t) - year(p.t) * 4 - quarter(p.t)) AS b FROM e FULL JOIN p ON e.episode = p.episode AND e.kind = p.kind)
 SELECT episode, kind, ex AS expected_present, pr AS predicted_present, ex = pr AS presence_correct, a AS start_error, b AS end_error, a <= 1 AND b <= 1 AS timing_correct FROM x""")
def _(spark, d):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("episode"), F.col("o_orderpriority").alias("kind"), "o_orderstatus", "o_totalprice", day.alias("day"))
    e = o.filter(k % 3 == 0).select("episode", "kind", (F.col("o_orderstatus") != "P").alias("present"), F.col("day").alias("start"), F.date_add("day", 200).alias("end"))
    p = o.filter(k % 3 != 1).groupBy("episode", "kind").agg((F.max("o_totalprice") > 100000).alias("present"), F.when(F.count("*") > 1, F.min("day")).alias("start"), F.max("day").alias("end"))
    return G.phase_metrics(e, p)


@query("eval_events", """WITH e AS (SELECT o_custkey AS episode, o_orderkey AS nth, o_orderdate AS day, o_orderpriority = '1-URGENT' AS retest, CASE WHEN o_orderkey % 2 = 0 THEN 'held' ELSE 'failed' END AS st, CASE o_orderkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'not_confirmed' WHEN 2 THEN 'unavailable' END AS vol FROM orders),
 g AS (SELECT episode, arg_max(st, (day, nth)) FILTER (retest) AS retest_expected, arg_max(vol, (day, nth)) FILTER (vol IS NOT NULL AND vol != 'unavailable') AS volume_expected FROM e GROUP BY 1),
 p AS (SELECT c_custkey AS episode, CASE WHEN c_custkey % 3 = 0 THEN 'held' WHEN c_nationkey % 2 = 0 THEN 'failed' WHEN c_nationkey % 5 > 0 THEN 'holding_unspecified' END AS r, CASE WHEN c_acctbal > 3000 THEN 'confirmed' WHEN c_acctbal > 0 THEN 'not_confirmed' END AS v FROM customer)
 SELECT episode, retest_expected, volume_expected, r AS retest_predicted, v AS volume_predicted, CASE WHEN retest_expected IS NOT NULL THEN retest_expected IS NOT DISTINCT FROM r END AS retest_correct, CASE WHEN volume_expected IS NOT NULL THEN volume_expected IS NOT DISTINCT FROM v END AS volume_correct,
  coalesce(r != 'holding_unspecified', false) AS retest_supported, v IS NOT NULL AS volume_supported FROM g LEFT JOIN p USING (episode)""")
def _(spark, d):
    k, n = F.col("o_orderkey"), F.col("c_nationkey")
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("episode"), k.alias("nth"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderpriority") == "1-URGENT", "retest").otherwise("breakout").alias("kind"), F.when(k % 2 == 0, "held").otherwise("failed").alias("retest_state"), F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "not_confirmed").when(k % 4 == 2, "unavailable").alias("volume_label"))
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("episode"), F.when(F.col("c_custkey") % 3 == 0, "held").alias("retest_state"), F.when(n % 2 == 0, False).when(n % 5 > 0, True).alias("holds"), F.when(F.col("c_acctbal") > 3000, "confirmed").when(F.col("c_acctbal") > 0, "not_confirmed").alias("volume"))
    return G.event_states(e, p)


@query("eval_excluded", """WITH e AS (SELECT o_custkey AS episode, year(o_orderdate) * 4 + quarter(o_orderdate) AS q, count(DISTINCT o_orderdate::DATE) AS e FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), s AS (SELECT o_custkey AS episode, year(o_orderdate) * 4 + quarter(o_orderdate) AS q, count(DISTINCT o_orderdate::DATE) AS s FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)
 SELECT episode, sum(e)::BIGINT AS expected_count, sum(CASE WHEN s IS NULL THEN 0 WHEN s < e THEN s ELSE e END)::BIGINT AS incorrectly_selected, sum(e)::BIGINT - sum(CASE WHEN s IS NULL THEN 0 WHEN s < e THEN s ELSE e END)::BIGINT AS rejected FROM e LEFT JOIN s USING (episode, q) GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("episode"), F.to_date("o_orderdate").alias("day"))
    part = lambda n: o.filter(F.col("o_orderkey") % n == 0).select("episode", "day")
    return G.excluded_highs(part(2), part(3))


@query("set_intersect_edges", """WITH o AS (SELECT o_custkey AS episode, o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders), e AS (SELECT episode, parent::VARCHAR AS parent, id::VARCHAR AS id FROM o WHERE parent IS NOT NULL),
 p AS (SELECT episode, CASE WHEN parent % 5 != 0 THEN parent::VARCHAR ELSE 'unmatched:' || (parent + 1000000) END AS parent, CASE WHEN id % 5 != 0 THEN id::VARCHAR ELSE 'unmatched:' || (id + 1000000) END AS id FROM o WHERE parent IS NOT NULL AND id % 7 != 0)
 SELECT coalesce(e.episode, p.episode) AS episode, count(*) FILTER (e.id IS NOT NULL AND p.id IS NOT NULL) AS tp, count(*) FILTER (e.id IS NULL) AS fp, count(*) FILTER (p.id IS NULL) AS fn FROM e FULL JOIN p ON e.episode = p.episode AND e.parent = p.parent AND e.id = p.id GROUP BY 1""")
def _(spark, d):
    w = Window.partitionBy("episode").orderBy("id")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("episode"), F.col("o_orderkey").alias("id")).withColumn("parent", F.lag("id").over(w))
    edges = o.filter("parent IS NOT NULL")
    far = edges.filter("id % 7 != 0").select("episode", (F.col("id") + 1000000).alias("id"), (F.col("parent") + 1000000).alias("parent"))
    pairs = o.filter("id % 5 != 0").select("episode", (F.col("id") + 1000000).alias("predicted_id"), F.col("id").alias("expected_id"))
    return G.edge_counts(edges, far, pairs)


_CHECKS = [f"classification.{x}" for x in G.CLASSES] + ["general_top_detection", "selected_top_membership_proxy", "construction_anchors", "supporting_touches", "excluded_highs", "structure.geometry", "structure.primary_selection", "structure.alternate_selection", "structure.parent_child_topology", "structure.active_boundary", "bottom.major_bottom", "bottom.undercut", "bottom.outlier"]
_CHECKS += [f"phase.{x}.{y}" for x in G.PHASES for y in ("presence", "timing")] + [f"event.{x}.timing" for x in G.EVENTS] + ["event.retest_state", "event.relative_volume_confirmation"]
_FLAGS = ["top_complete", "top_supported", "active_known", "expects_undercut", "expects_outlier", *[f"{v}_{x}" for x in G.PHASES for v in ("expects", "timed")], *[f"{v}_{x}" for x in ("retest_state", "relative_volume_confirmation") for v in ("expects", "knows")]]


def _check_sql(n: int, name: str) -> str:
    flag = lambda f: f"((k + {3 * _FLAGS.index(f)}) % 4 != 0)"
    passed, part = f"((k + {n}) % 5 != 0)", name.split(".")
    ap, su, inc, judged = "true", "true", "true", "true"
    if name == "general_top_detection":
        ap, su, inc, judged = flag("top_complete"), flag("top_supported"), flag("top_supported"), flag("top_supported")
    elif name == "selected_top_membership_proxy":
        ap = flag("top_complete")
    elif name == "structure.active_boundary":
        ap = judged = flag("active_known")
    elif name in ("bottom.undercut", "bottom.outlier"):
        ap, su, inc, judged = flag(f"expects_{part[1]}"), "false", "false", "false"
    elif part[0] == "phase" and part[2] == "timing":
        ap = judged = flag(f"expects_{part[1]}")
        su = flag(f"timed_{part[1]}")
    elif name in ("event.retest_state", "event.relative_volume_confirmation"):
        ap = judged = flag(f"expects_{part[1]}")
        su = flag(f"knows_{part[1]}")
    return f"SELECT k AS episode, '{name}' AS name, {ap} AS applicable, {su} AS supported, CASE WHEN {judged} THEN {passed} END AS passed, {inc} AS included, {ap} AND {inc} AND NOT coalesce(CASE WHEN {judged} THEN {passed} END, false) AS requires_intervention FROM o"


@query("eval_intervention", "WITH o AS (SELECT o_orderkey AS k FROM orders) " + " UNION ALL ".join(_check_sql(n, name) for n, name in enumerate(_CHECKS)))
def _(spark, d):
    k = F.col("o_orderkey")
    told = {name.replace(".", "_"): (k + n) % 5 != 0 for n, name in enumerate(_CHECKS)} | {f: (k + 3 * n) % 4 != 0 for n, f in enumerate(_FLAGS)}
    return G.intervention_checks(table(spark, d, "orders").select(k.alias("episode"), *[v.alias(n) for n, v in told.items()]))


def _dated(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k, F.col("o_custkey").alias("episode"), F.to_date("o_orderdate").alias("day"))
    return o.select("episode", F.when(k % 2 == 0, "expected").otherwise("predicted").alias("kind"), "day")


@query("join_match_dates")
def _(spark, d):
    return E.matched_pairs(_dated(spark, d), 1).select("episode", F.explode("pairs").alias("p")).select("episode", "p.*")


_SEEN = """s AS (SELECT event_id AS det, user_id AS capture, CASE event_id % 9 WHEN 0 THEN 'Major-High' WHEN 1 THEN ' resistance touch ' WHEN 2 THEN 'Peak 3' WHEN 3 THEN 'second touch' WHEN 4 THEN 'candle' WHEN 5 THEN NULL WHEN 6 THEN 'Volume Bar' WHEN 7 THEN 'swing high' ELSE 'RESISTANCE' END AS name, CASE WHEN event_id % 4 > 0 THEN value END AS conf, event_id % 3 AS form, (event_id % 640)::DOUBLE AS x, (event_id % 480)::DOUBLE AS y FROM events)"""


@query("normalize_detections", f"""WITH {_SEEN}, n AS (SELECT *, lower(replace(replace(trim(coalesce(name, '')), '-', '_'), ' ', '_')) AS w FROM s), k AS (SELECT *, CASE WHEN w IN ('major_high', 'resistance_touch') THEN w WHEN w = '' OR contains(w, 'high') OR contains(w, 'peak') THEN 'major_high' WHEN contains(w, 'resistance') OR contains(w, 'touch') THEN 'resistance_touch' ELSE w END AS kind FROM n)
 SELECT capture, det, kind, kind IN ('major_high', 'resistance_touch') OR regexp_matches(kind, 'high|resistance|touch|peak') AS high, coalesce(conf, 0.0) AS confidence, CASE form WHEN 0 THEN x - 4.0 WHEN 1 THEN x - 5.0 END AS x1, CASE form WHEN 0 THEN y - 6.0 WHEN 1 THEN y - 2.5 END AS y1, CASE form WHEN 0 THEN x + 8.0 WHEN 1 THEN x + 5.0 END AS x2, CASE form WHEN 0 THEN y + 2.0 WHEN 1 THEN y + 2.5 END AS y2,
  CASE form WHEN 0 THEN x + 2.0 WHEN 1 THEN x::DOUBLE END AS at_x, CASE form WHEN 0 THEN y - 2.0 WHEN 1 THEN y::DOUBLE END AS at_y FROM k""")
def _(spark, d):
    i = F.col("event_id")
    names = ["Major-High", " resistance touch ", "Peak 3", "second touch", "candle", None, "Volume Bar", "swing high", "RESISTANCE"]
    x, y = (i % 640).cast("double"), (i % 480).cast("double")
    of = lambda form, v: F.when(i % 3 == form, v)
    given = {"x_min": of(0, x - 4), "y_min": of(0, y - 6), "x_max": of(0, x + 8), "y_max": of(0, y + 2), "x": of(1, x), "y": of(1, y), "width": of(1, 10.0), "height": of(1, 5.0)}
    return D.normalized(table(spark, d, "events").select(F.col("user_id").alias("capture"), i.alias("det"), F.element_at(F.array(*[F.lit(n) for n in names]), (i % 9 + 1).cast("int")).alias("class_name"), F.when(i % 4 > 0, F.col("value")).alias("confidence"), *[v.alias(n) for n, v in given.items()]))


@query("pixel_to_price", "WITH p AS (SELECT event_id, (event_id % 700)::DOUBLE AS y FROM events) SELECT event_id, round(90.0 - greatest(0, least(1, (y - 40) / 500)) * 80, 6) AS price, round(CASE WHEN event_id % 5 = 0 THEN -1.0 WHEN event_id % 5 = 1 THEN -1.0 ELSE 95 + (y - 20) / 480 * (15 - 95) END, 6) AS sampled FROM p")
def _(spark, d):
    i = F.col("event_id")
    y = (i % 700).cast("double")
    point = lambda a, b: F.struct(F.lit(a).cast("double").alias("y"), F.lit(b).cast("double").alias("price"))
    samples = F.when(i % 5 == 0, F.array(point(20, 95))).when(i % 5 == 1, F.array(point(20, 95), point(20, 15))).otherwise(F.array(point(500, 15), point(None, 3), point(20, 95), point(200, 60)))
    return table(spark, d, "events").select(i, F.round(D.price_at(y, F.lit(40.0), F.lit(500.0), F.lit(90.0), F.lit(10.0)), 6).alias("price"), F.round(D.price_between(y, samples, F.lit(-1.0)), 6).alias("sampled"))


@query("pixel_to_idx", "SELECT event_id, CASE WHEN event_id % 120 > 1 THEN round_even(greatest(0, least(1, ((event_id % 900)::DOUBLE - 60) / 720)) * (event_id % 120 - 1), 0)::BIGINT ELSE 0 END AS idx FROM events")
def _(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(i, D.bar_at((i % 900).cast("double"), F.lit(60.0), F.lit(720.0), i % 120).alias("idx"))


@query("build_trendline", "SELECT user_id AS capture, min(event_id) AS from_idx, arg_min(value, event_id) AS from_price, max(event_id) AS to_idx, arg_max(value, event_id) AS to_price FROM events WHERE value > 20 GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    return D.end_lines(table(spark, d, "events").filter("value > 20").select(F.col("user_id").alias("capture"), F.col("event_id").alias("idx"), F.col("value").alias("price")))


@query("evaluate_expectation", """WITH r AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS grade, CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS slope, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS failed FROM orders)
 SELECT key, 'grade' AS field, grade AS actual, coalesce(grade = 'F', false) AS passed FROM r UNION ALL SELECT key, 'slope', slope::VARCHAR, coalesce(slope BETWEEN 100 AND 900, false) FROM r UNION ALL SELECT key, 'failed', failed, failed IS NULL FROM r""")
def _(spark, d):
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select(k.alias("key"), F.when(k % 5 > 0, F.col("o_orderstatus")).alias("grade"), F.when(k % 7 > 0, F.col("o_custkey")).alias("slope"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("failed"))
    return D.expectations(r, {"grade": "F", "slope": [100, 900], "failed": None})


@query("src_universe", """WITH l AS (SELECT s_suppkey AS place, replace(upper(trim(s_name)), '.', '-') AS ticker, 0 AS part FROM (SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 15)), x AS (SELECT c_custkey AS place, replace(upper(c_mktsegment || '.' || c_nationkey), '.', '-') AS ticker, 1 AS part FROM customer UNION ALL SELECT s_suppkey + 10000000, upper(s_name), 1 FROM supplier WHERE s_suppkey % 2 = 0)
 SELECT ticker, part, place FROM (SELECT * FROM l UNION ALL SELECT * FROM x) WHERE ticker != '' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY part, place) = 1""")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("place"), F.col("s_name").alias("ticker"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("place"), F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("."), F.col("c_nationkey").cast("string")).alias("ticker"))
    return D.universe(s, c.unionByName(s.filter("place % 2 = 0").withColumn("place", F.col("place") + 10000000)), 15)
