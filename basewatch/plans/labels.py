"""Queries over structures of labels and analyses and over a label's contract, and the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basewatch.operators import evaluate as E
from basewatch.operators import release as R
from basewatch.operators import structures as S
from basewatch.plans.registry import registry
from basewatch.sources.tables import table

query, QUERIES, SQL = registry()

# A customer's orders as structures: even ones are the label's, odd ones the analysis's.
_STRUCTURES = """o AS (SELECT o_custkey AS episode, o_orderkey AS k, o_orderkey % 2 = 0 AS e, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) - 1 AS nth FROM orders),
 s AS (SELECT episode, e, nth, k AS id, k % 3 AS role, CASE WHEN k % 5 < 3 THEN 'flat' ELSE 'rising' END AS direction, 100 + k % 11 AS value, (k % 4) * 0.5 AS slope, DATE '1995-01-15' + ((k % 5) * 50)::INT AS a1, DATE '1996-01-15' + ((k % 7) * 40)::INT AS a2,
   CASE WHEN nth = 0 THEN 'primary' ELSE 'alternate' END AS selection, CASE WHEN nth > 0 THEN min(k) OVER (PARTITION BY episode, e) END AS parent FROM o),
 c AS (SELECT e.episode, e.nth AS en, p.nth AS pn, e.id AS expected_id, p.id AS predicted_id, e.selection AS es, p.selection AS ps, e.role, e.direction, abs(p.value - e.value)::DOUBLE / e.value * 100 AS ve, abs(p.slope - e.slope)::DOUBLE AS se,
   abs(year(e.a1) * 4 + quarter(e.a1) - year(p.a1) * 4 - quarter(p.a1)) AS d1, abs(year(e.a2) * 4 + quarter(e.a2) - year(p.a2) * 4 - quarter(p.a2)) AS d2 FROM s e JOIN s p ON e.episode = p.episode AND e.role = p.role AND e.direction = p.direction AND e.e AND NOT p.e),
 f AS (SELECT *, ve + se + (d1 + d2) / 1000.0::DOUBLE AS cost FROM c WHERE ve <= 5 AND se <= 1 AND d1 <= 1 AND d2 <= 1),
 g AS (SELECT episode, role, direction, en, row_number() OVER (PARTITION BY episode, role, direction ORDER BY en) AS place FROM (SELECT DISTINCT episode, role, direction, en FROM f)),
 w AS (SELECT g.*, f.pn, f.cost FROM g JOIN f USING (episode, role, direction, en) UNION ALL SELECT *, NULL, 0 FROM g),
 a AS (SELECT DISTINCT episode, role, direction, 1 AS place, [-1::BIGINT] AS taken, 0 AS n, 0::DOUBLE AS total, []::STRUCT(en BIGINT, pn BIGINT)[] AS path FROM g
   UNION ALL SELECT a.episode, a.role, a.direction, a.place + 1, CASE WHEN w.pn IS NULL THEN a.taken ELSE list_append(a.taken, w.pn) END, a.n + (w.pn IS NOT NULL)::INT, a.total + w.cost, CASE WHEN w.pn IS NULL THEN a.path ELSE list_append(a.path, {'en': w.en, 'pn': w.pn}) END
   FROM a JOIN w USING (episode, role, direction, place) WHERE w.pn IS NULL OR NOT list_contains(a.taken, w.pn)),
 m AS (SELECT episode, role, direction, max(place) + 1 AS last FROM g GROUP BY ALL),
 b AS (SELECT episode, unnest(path) AS x FROM (SELECT a.* FROM a JOIN m ON a.episode = m.episode AND a.role = m.role AND a.direction = m.direction AND a.place = m.last QUALIFY row_number() OVER (PARTITION BY a.episode, a.role, a.direction ORDER BY n DESC, round(total, 12), path) = 1)),
 pr AS (SELECT f.* FROM f JOIN b ON f.episode = b.episode AND f.en = b.x.en AND f.pn = b.x.pn)"""


def _structures(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("episode"), k, (k % 2 == 0).alias("e"))
    own = Window.partitionBy("episode", "e")
    o = o.withColumns({"nth": F.row_number().over(own.orderBy("o_orderkey")) - 1, "first": F.min("o_orderkey").over(own)})
    day = lambda start, step, n: F.date_add(F.lit(start).cast("date"), (k % n * step).cast("int"))
    s = o.select(
        "episode", "e", "nth", k.alias("id"), (k % 3).cast("string").alias("role"), F.lit("line").alias("boundary_kind"), F.when(k % 5 < 3, "flat").otherwise("rising").alias("direction"), (100 + k % 11).cast("double").alias("value"),
        (k % 4 * 0.5).alias("slope_pct"), F.array(day("1995-01-15", 50, 5), day("1996-01-15", 40, 7)).alias("anchors"), F.when(F.col("nth") == 0, "primary").otherwise("alternate").alias("selection"),
        F.when(F.col("nth") == 0, "parent").otherwise("child").alias("relationship"), F.when(F.col("nth") > 0, F.col("first")).alias("parent_id"),
    )
    return s.filter("e").drop("e"), s.filter("NOT e").drop("e")


@query("join_structure_assign", f"WITH RECURSIVE {_STRUCTURES} SELECT episode, expected_id, predicted_id, round(ve, 6) AS value_error_pct, round(se, 6) AS slope_error_pct, (d1 + d2)::INT AS anchor_error FROM pr")
def _(spark, d):
    pairs = S.assignments(S.candidates(*_structures(spark, d)))
    return pairs.select("episode", "expected_id", "predicted_id", F.round("value_error_pct", 6).alias("value_error_pct"), F.round("slope_error_pct", 6).alias("slope_error_pct"), "anchor_error")


@query("eval_structures", f"""WITH RECURSIVE {_STRUCTURES}, l AS (SELECT episode, max(id) FILTER (e) AS active FROM s GROUP BY 1),
 n AS (SELECT episode, count(*) FILTER (e) AS ne, count(*) FILTER (NOT e) AS np, count(*) FILTER (e AND nth = 0) AS ne1, count(*) FILTER (NOT e AND nth = 0) AS np1 FROM s GROUP BY 1),
 t AS (SELECT episode, count(*) AS tp, count(*) FILTER (es = 'primary' AND ps = 'primary') AS tp1, count(*) FILTER (es = 'alternate' AND ps = 'alternate') AS tp2 FROM pr GROUP BY 1),
 ee AS (SELECT episode, parent::VARCHAR AS parent, id::VARCHAR AS id FROM s WHERE e AND parent IS NOT NULL), pe AS (SELECT DISTINCT s.episode, coalesce(x.expected_id::VARCHAR, 'unmatched:' || s.parent) AS parent, coalesce(y.expected_id::VARCHAR, 'unmatched:' || s.id) AS id FROM s LEFT JOIN pr x ON x.episode = s.episode AND x.predicted_id = s.parent LEFT JOIN pr y ON y.episode = s.episode AND y.predicted_id = s.id WHERE NOT e AND parent IS NOT NULL),
 ed AS (SELECT coalesce(ee.episode, pe.episode) AS episode, count(*) FILTER (ee.id IS NOT NULL AND pe.id IS NOT NULL) AS edge_tp, count(*) FILTER (ee.id IS NULL) AS edge_fp, count(*) FILTER (pe.id IS NULL) AS edge_fn FROM ee FULL JOIN pe ON ee.episode = pe.episode AND ee.parent = pe.parent AND ee.id = pe.id GROUP BY 1)
 SELECT l.episode, coalesce(tp, 0) AS matched_tp, np - coalesce(tp, 0) AS matched_fp, ne - coalesce(tp, 0) AS matched_fn, coalesce(tp1, 0) AS primary_tp, np1 - coalesce(tp1, 0) AS primary_fp, ne1 - coalesce(tp1, 0) AS primary_fn,
  coalesce(tp2, 0) AS alternate_tp, np - np1 - coalesce(tp2, 0) AS alternate_fp, ne - ne1 - coalesce(tp2, 0) AS alternate_fn, coalesce(edge_tp, 0) AS edge_tp, coalesce(edge_fp, 0) AS edge_fp, coalesce(edge_fn, 0) AS edge_fn,
  active AS active_id, pr.predicted_id IS NOT NULL AS active_matched, coalesce(pr.ps = 'primary', false) AS active_selection_correct, CASE WHEN active IS NOT NULL THEN pr.predicted_id IS NOT NULL END AS active_direction_correct, round(pr.ve, 6) AS active_error_pct
  FROM l JOIN n USING (episode) LEFT JOIN t USING (episode) LEFT JOIN ed USING (episode) LEFT JOIN pr ON pr.episode = l.episode AND pr.expected_id = l.active""")
def _(spark, d):
    e, p = _structures(spark, d)
    labels = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("episode")).agg(F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey"))).alias("active_id"))
    return S.structure_metrics(labels, e, p)


@query("eval_bottoms")
def _(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k, F.col("o_custkey").alias("episode"), F.to_date("o_orderdate").alias("day"))
    role = F.when(k % 5 == 0, "undercut").when(k % 7 == 0, "outlier").otherwise("major_bottom")
    return S.bottom_metrics(o.filter(k % 2 == 0).select("episode", role.alias("role"), "day"), o.filter(k % 2 == 1).select("episode", F.date_add("day", 20).alias("day")))


@query("agg_transition_timing")
def _(spark, d):
    o = table(spark, d, "orders")
    state = lambda c: F.element_at(F.array(*[F.lit(x) for x in ("forming", "pre_breakout", "breaking_out", "post_breakout")]), (c % 4 + 1).cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return S.transition_timing(o.select(c.alias("setup"), F.to_date("o_orderdate").alias("cutoff"), "o_orderkey", state(k).alias("expected"), state(k + F.when(k % 5 == 0, 1).otherwise(0)).alias("predicted")).filter(c % 3 > 0))


# A customer's orders as a tree of structures and as events, with faults planted by remainders.
_LABELS = """o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderdate::DATE AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
 s AS (SELECT c, rn AS nth, CASE WHEN rn = 5 AND c % 17 = 0 THEN 's4' ELSE 's' || rn END AS id, CASE WHEN k % 97 = 0 THEN 's999' WHEN rn = 1 AND c % 13 = 0 THEN 's3' WHEN rn > 1 THEN 's' || (rn // 2) END AS parent,
   CASE WHEN k % 89 = 0 THEN 'standalone' WHEN rn > 1 AND 2 * rn <= n THEN 'parent_child' WHEN rn > 1 THEN 'child' WHEN n > 1 THEN 'parent' ELSE 'standalone' END AS rel, (rn % 2 = 0 OR rn = 1) != (k % 83 = 0) AS prim, DATE '1992-06-01' + (c % 400)::INT AS rec FROM o),
 l AS (SELECT c_custkey AS c, c_custkey % 5 > 0 AS coil, CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 's77' WHEN c_custkey % 19 = 0 THEN 's5' WHEN c_custkey % 3 = 0 THEN 's4' ELSE 's1' END AS active,
   (DATE '2001-03-01' + to_months((CASE WHEN c_custkey % 31 = 0 THEN 1 ELSE 0 END)::INT))::DATE AS cutoff, DATE '2001-03-31' - (CASE WHEN c_custkey % 37 = 0 THEN 1 ELSE 0 END)::INT + (CASE WHEN c_custkey % 31 = 0 THEN 95 ELSE 0 END)::INT AS decided, DATE '2001-08-01' - (CASE WHEN c_custkey % 41 = 0 THEN 300 ELSE 0 END)::INT AS labeled FROM customer),
 e AS (SELECT c, rn AS nth, CASE WHEN k % 101 = 0 THEN 'e1' ELSE 'e' || rn END AS id, CASE WHEN rn % 3 > 0 THEN CASE WHEN k % 103 = 0 THEN 's555' ELSE 's1' END END AS sid, CASE k % 7 WHEN 3 THEN 'retest' WHEN 4 THEN 'continuation' WHEN 5 THEN 'invalidation' WHEN 6 THEN 'failed_breakout' ELSE 'breakout' END AS kind,
   day AS trig, CASE WHEN k % 7 = 6 THEN day + 10 END AS res, k % 7 = 3 AND k % 2 = 0 AS failed FROM o)"""


def _labels(spark, d):
    """labels, structures, bottoms, events, phases."""
    k, c, rn, n = F.col("o_orderkey"), F.col("c"), F.col("rn"), F.col("n")
    every = Window.partitionBy("c")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), k, F.to_date("o_orderdate").alias("day"))
    o = o.withColumns({"rn": F.row_number().over(every.orderBy("day", "o_orderkey")), "n": F.count("*").over(every)})
    s = lambda x: F.concat(F.lit("s"), x.cast("string"))
    tree = o.select(
        c.alias("episode"), rn.alias("nth"), F.when((rn == 5) & (c % 17 == 0), "s4").otherwise(s(rn)).alias("id"), F.when(k % 97 == 0, "s999").when((rn == 1) & (c % 13 == 0), "s3").when(rn > 1, s(F.floor(rn / 2))).alias("parent_id"),
        F.when(k % 89 == 0, "standalone").when((rn > 1) & (2 * rn <= n), "parent_child").when(rn > 1, "child").when(n > 1, "parent").otherwise("standalone").alias("relationship"),
        F.when(((rn % 2 == 0) | (rn == 1)) != (k % 83 == 0), "primary").otherwise("alternate").alias("selection"), F.date_add(F.lit("1992-06-01").cast("date"), (c % 400).cast("int")).alias("recognition"),
    )
    x = F.col("c_custkey")
    one = lambda test, days: F.when(test, days).otherwise(0)
    labels = table(spark, d, "customer").select(
        x.alias("episode"), F.when(x % 5 > 0, "coil").otherwise("not_coil").alias("shape"), F.when(x % 29 == 0, None).when(x % 23 == 0, "s77").when(x % 19 == 0, "s5").when(x % 3 == 0, "s4").otherwise("s1").alias("active_id"),
        F.add_months(F.lit("2001-03-01").cast("date"), one(x % 31 == 0, 1)).alias("cutoff"), F.date_add(F.lit("2001-03-31").cast("date"), one(x % 31 == 0, 95) - one(x % 37 == 0, 1)).alias("decision_as_of"),
        F.date_sub(F.lit("2001-08-01").cast("date"), one(x % 41 == 0, 300)).cast("timestamp").alias("labeled_at"),
    )
    kind = F.when(k % 7 == 3, "retest").when(k % 7 == 4, "continuation").when(k % 7 == 5, "invalidation").when(k % 7 == 6, "failed_breakout").otherwise("breakout")
    events = o.select(
        c.alias("episode"), rn.alias("nth"), F.when(k % 101 == 0, "e1").otherwise(F.concat(F.lit("e"), rn.cast("string"))).alias("id"), F.when(rn % 3 > 0, F.when(k % 103 == 0, "s555").otherwise("s1")).alias("structure_id"), kind.alias("kind"),
        F.col("day").alias("trigger"), F.when(k % 7 == 6, F.date_add("day", 10)).alias("resolution"), F.when(k % 7 == 3, F.when(k % 2 == 0, "failed").otherwise("deep")).alias("retest_state"),
    )
    rest = events.select("episode", "id", "structure_id")
    return labels, tree, rest.filter("nth % 4 = 0"), events, rest.filter("nth % 4 = 1")


@query("gold_contract", f"""WITH RECURSIVE {_LABELS}, ids AS (SELECT DISTINCT c, id FROM s), one AS (SELECT c, id, arg_max(parent, nth) AS parent, arg_max(prim, nth) AS prim FROM (SELECT c, id, nth, coalesce(parent, '') AS parent, prim FROM s) GROUP BY 1, 2),
 w AS (SELECT c, id, nullif(parent, '') AS up, prim AS ok, [id] AS seen, false AS cyc FROM one UNION ALL SELECT w.c, w.id, nullif(o.parent, ''), w.ok AND o.prim, list_append(w.seen, o.id), list_contains(w.seen, o.id) FROM w JOIN one o ON o.c = w.c AND o.id = w.up WHERE NOT w.cyc),
 ch AS (SELECT c, id, bool_or(cyc) AS cyc, bool_and(ok) AS ok FROM w GROUP BY 1, 2), kids AS (SELECT DISTINCT c, parent AS id FROM s WHERE parent IS NOT NULL),
 k AS (SELECT s.*, p.id IS NOT NULL AS there, kids.id IS NOT NULL AS kid, cyc FROM s LEFT JOIN ids p ON p.c = s.c AND p.id = s.parent LEFT JOIN kids ON kids.c = s.c AND kids.id = s.id JOIN ch ON ch.c = s.c AND ch.id = s.id),
 ev AS (SELECT e.*, lag(coalesce(res, trig)) OVER (PARTITION BY e.c, sid ORDER BY e.nth) AS over_, last_value(CASE WHEN kind = 'breakout' THEN 1 WHEN kind IN ('invalidation', 'failed_breakout') OR failed THEN 0 END IGNORE NULLS) OVER (PARTITION BY e.c, sid ORDER BY e.nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS act, r.rec FROM e LEFT JOIN (SELECT c, id, arg_max(rec, nth) AS rec FROM s GROUP BY 1, 2) r ON r.c = e.c AND r.id = e.sid),
 ref AS (SELECT c, id, sid, 'bottom' AS t FROM e WHERE nth % 4 = 0 UNION ALL SELECT c, id, sid, 'event' FROM e UNION ALL SELECT c, id, sid, 'phase' FROM e WHERE nth % 4 = 1),
 f AS (SELECT c, 1 AS g, 0 AS nth, 1 AS p, 'open_cutoff' AS fault FROM l WHERE month(cutoff) % 3 != 0 UNION ALL SELECT c, 2, 0, 2, 'early_decision' FROM l WHERE decided < last_day(make_date(year(cutoff), quarter(cutoff) * 3, 1)) UNION ALL SELECT c, 3, 0, 3, 'late_decision' FROM l WHERE decided > labeled
  UNION ALL SELECT c, 4, 0, 4, 'duplicate_structure' FROM s GROUP BY c, id HAVING count(*) > 1 UNION ALL SELECT c, 5, nth, 5, 'unknown_parent' FROM k WHERE parent IS NOT NULL AND NOT there UNION ALL SELECT c, 5, nth, 6, 'cyclic_parents' FROM k WHERE cyc
  UNION ALL SELECT c, 7, nth, 7, 'wrong_relationship' FROM k WHERE rel != CASE WHEN parent IS NOT NULL AND kid THEN 'parent_child' WHEN parent IS NOT NULL THEN 'child' WHEN kid THEN 'parent' ELSE 'standalone' END
  UNION ALL SELECT c, 8, min(nth), 8, 'primary_count' FROM k GROUP BY c, parent HAVING count(*) FILTER (prim) != 1 UNION ALL SELECT c, 9, 0, 9, 'no_structure' FROM l WHERE coil AND c NOT IN (SELECT c FROM s) UNION ALL SELECT c, 10, 0, 10, 'no_active' FROM l WHERE coil AND active IS NULL
  UNION ALL SELECT l.c, 11, 0, 11, 'unknown_active' FROM l LEFT JOIN ch ON ch.c = l.c AND ch.id = l.active WHERE active IS NOT NULL AND ch.id IS NULL UNION ALL SELECT l.c, 12, 0, 12, 'active_not_primary' FROM l JOIN ch ON ch.c = l.c AND ch.id = l.active WHERE NOT ok
  UNION ALL SELECT DISTINCT ref.c, 13, 0, 13, 'unknown_reference' FROM ref LEFT JOIN ids ON ids.c = ref.c AND ids.id = ref.sid WHERE sid IS NOT NULL AND ids.id IS NULL
  UNION ALL SELECT c, 14, nth, 14, 'events_out_of_order' FROM ev WHERE trig < over_ UNION ALL SELECT c, 14, nth, 15, 'event_before_recognition' FROM ev WHERE trig < rec UNION ALL SELECT c, 14, nth, 16, 'no_active_breakout' FROM ev WHERE kind IN ('retest', 'continuation', 'invalidation') AND coalesce(act, 0) = 0
  UNION ALL SELECT c, CASE t WHEN 'bottom' THEN 17 WHEN 'event' THEN 18 ELSE 19 END, 0, CASE t WHEN 'bottom' THEN 17 WHEN 'event' THEN 18 ELSE 19 END, 'duplicate_' || t FROM (SELECT c, t FROM ref GROUP BY c, t, id HAVING count(*) > 1))
 SELECT l.c AS episode, arg_min(fault, (g, f.nth, p)) AS fault, (SELECT string_agg(fault, ',' ORDER BY p) FROM (SELECT DISTINCT fault, p FROM f z WHERE z.c = l.c)) AS faults FROM l LEFT JOIN f ON f.c = l.c GROUP BY l.c""")
def _(spark, d):
    return S.label_contract(*_labels(spark, d))


@query("eval_gates")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    state = lambda x: F.element_at(F.array(*[F.lit(v) for v in ("forming", "pre_breakout", "breaking_out", "post_breakout")]), (x % 4 + 1).cast("int"))
    items = table(spark, d, "orders").select(
        c.alias("setup"), state(k).alias("expected"), state(k + F.when(k % 5 == 0, 1).otherwise(0)).alias("predicted"), (k % 4).alias("tp"), (k % 3).alias("fp"), (k % 2).alias("fn"), F.when(k % 6 == 0, "actionable").otherwise("watch").alias("expected_action"),
        F.when(k % 6 < 2, "actionable").otherwise("avoid").alias("predicted_action"), (k % 6 == 1).alias("false_action"), (k % 7 == 0).alias("correction"), (k % 21 == 0).alias("critical"),
    )
    g = E.gate_confidence(items)
    return g.select("gate", *[F.round(x, 6).alias(x) for x in ("point", "low", "high")], "setups")


# An item's payload as text, with forbidden keys at depths one to six.
_PAYLOAD = """o AS (SELECT o_custkey AS session, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders),
 j AS (SELECT *, '{"ticker": "T' || k || '", "bars": [{"close": 1.5, "note": {"a": [[{"' || CASE WHEN k % 31 = 0 THEN 'lid-grade' ELSE 'x' END || '": null}]]}}, {"' || CASE WHEN k % 23 = 0 THEN 'majorHighs' ELSE 'highs' END || '": []}], "' || CASE WHEN k % 41 = 0 THEN 'coilScore' ELSE 'score' END || '": {"text": "grade", "' || CASE WHEN k % 37 = 0 THEN 'grade' ELSE 'rank' END || '": 3}}' AS payload FROM o)"""


def _payloads(spark, d):
    k = F.col("k")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("k"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("position"))
    key = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    text = F.concat(
        F.lit('{"ticker": "T'), k.cast("string"), F.lit('", "bars": [{"close": 1.5, "note": {"a": [[{"'), key(31, "lid-grade", "x"), F.lit('": null}]]}}, {"'), key(23, "majorHighs", "highs"), F.lit('": []}], "'), key(41, "coilScore", "score"), F.lit('": {"text": "grade", "'), key(37, "grade", "rank"), F.lit('": 3}}'),
    )
    return o.withColumn("payload", text)


@query("release_key_scan", f"WITH {_PAYLOAD} SELECT k AS id, replace(t.fullkey, '\"', '') AS path FROM j, json_tree(j.payload) t WHERE t.key IN ('lid-grade', 'majorHighs', 'coilScore', 'grade')")
def _(spark, d):
    return R.leaks(_payloads(spark, d), "k", "payload")


@query("release_verify", f"""WITH {_PAYLOAD}, i AS (SELECT *, 'T' || k AS ticker, k % 3 > 0 AS reviewable, CASE WHEN k % 53 = 0 THEN 'short' ELSE sha256(k::VARCHAR) END AS hash, CASE WHEN k % 59 = 0 THEN NULL WHEN k % 61 = 0 THEN 's0' ELSE 's' || k END AS sample, k % 31 = 0 OR k % 23 = 0 OR k % 41 = 0 OR k % 37 = 0 AS leak FROM j WHERE k % 67 != 0),
 m AS (SELECT session, position, CASE WHEN k % 71 = 0 THEN 'U' ELSE 'T' || k END AS ticker, (k % 3 > 0) != (k % 73 = 0) AS reviewable FROM o),
 x AS (SELECT coalesce(i.session, m.session) AS session, i.k IS NOT NULL AS here, m.session IS NOT NULL AS there, i.ticker != m.ticker AS o, i.reviewable != m.reviewable AS r, i.reviewable, hash, sample, leak, count(sample) OVER (PARTITION BY i.session, sample) AS uses FROM i FULL JOIN m ON i.session = m.session AND i.position = m.position),
 g AS (SELECT session, count(*) FILTER (here) AS n_items, count(*) FILTER (here AND reviewable) AS n_reviewable, bool_or(here != there) AS a, bool_or(here AND there AND o) AS b, bool_or(here AND there AND r) AS c, bool_or(here AND length(hash) != 64) AS d, bool_or(here AND (uses > 1 OR (reviewable AND sample IS NULL))) AS e, bool_or(here AND leak) AS f FROM x GROUP BY 1)
 SELECT session, n_items, n_reviewable, nullif(concat_ws(',', CASE WHEN a THEN 'count' END, CASE WHEN b THEN 'order' END, CASE WHEN c THEN 'reviewability' END, CASE WHEN d THEN 'bars_hash' END, CASE WHEN e THEN 'sample_id' END, CASE WHEN f THEN 'leak' END), '') AS faults FROM g""")
def _(spark, d):
    k = F.col("k")
    p, name = _payloads(spark, d), F.concat(F.lit("T"), k.cast("string"))
    items = p.filter(k % 67 != 0).select(
        "session", "position", name.alias("ticker"), (k % 3 > 0).alias("reviewable"), F.when(k % 53 == 0, "short").otherwise(F.sha2(k.cast("string"), 256)).alias("bars_hash"),
        F.when(k % 59 == 0, None).when(k % 61 == 0, "s0").otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("sample_id"), "payload",
    )
    return R.release_faults(items, p.select("session", "position", F.when(k % 71 == 0, "U").otherwise(name).alias("ticker"), ((k % 3 > 0) != (k % 73 == 0)).alias("reviewable")))
