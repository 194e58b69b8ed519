"""Queries over event-like rows: reviews, evaluation, universes, comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basewatch.functions.scalars import canonical_hash, wilson
from basewatch.operators import evaluate as E
from basewatch.operators import reviews as R
from basewatch.operators import screen, vision
from basewatch.plans.registry import registry
from basewatch.sources.tables import table

query, QUERIES, SQL = registry()


def _log(spark, d):
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in (("click", "approved"), ("view", "corrected"), ("error", "revoke"))], F.lit("capture"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("ticker"), kind.alias("decision"), F.col("value").alias("price"), "ts")


_LOG = "lg AS (SELECT event_id AS id, user_id AS ticker, CASE event_type WHEN 'click' THEN 'approved' WHEN 'view' THEN 'corrected' WHEN 'error' THEN 'revoke' ELSE 'capture' END AS decision, value AS price, ts FROM events)"


@query("rev_effective", f"WITH {_LOG}, t AS (SELECT * FROM lg WHERE decision != 'capture' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY id DESC) = 1) SELECT ticker, CASE WHEN decision = 'corrected' THEN price END AS override, CASE WHEN decision != 'revoke' THEN decision END AS state, id AS event_id FROM t")
def _(spark, d):
    return R.effective(_log(spark, d))


@query("win_latest_decision", f"WITH {_LOG} SELECT id, ticker, decision, price FROM lg QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY id DESC) = 1")
def _(spark, d):
    return R.latest(_log(spark, d), "ticker").select("id", "ticker", "decision", "price")


_ITEMS = "items AS (SELECT o_custkey % 50 AS session_id, o_orderkey AS position, o_custkey AS ticker, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'reviewed' ELSE 'skipped' END AS status FROM orders)"


def _items(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "reviewed").otherwise("skipped")
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("session_id"), F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("ticker"), status.alias("status"))


@query("agg_session_counts", f"WITH {_ITEMS} SELECT session_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'reviewed') AS reviewed, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS total, arg_min(ticker, position) FILTER (status = 'pending') AS first_pending FROM items GROUP BY session_id")
def _(spark, d):
    return R.session_counts(_items(spark, d))


@query("join_idempotency", "WITH r AS (SELECT user_id AS session_id, event_type AS ticker, event_id % 7 AS key, event_id, value FROM events), done AS (SELECT session_id, ticker, key, min_by(value, event_id) AS hash FROM r WHERE event_id % 3 = 0 GROUP BY ALL) SELECT r.event_id, CASE WHEN done.hash IS NULL THEN 'new' WHEN done.hash = r.value THEN 'replay' ELSE 'conflict' END AS outcome FROM r LEFT JOIN done USING (session_id, ticker, key)")
def _(spark, d):
    r = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("ticker"), (F.col("event_id") % 7).alias("key"), "event_id", F.col("value").alias("hash"))
    done = r.filter("event_id % 3 = 0").groupBy("session_id", "ticker", "key").agg(F.min_by("hash", "event_id").alias("hash"))
    return R.new_requests(r, done).select("event_id", "outcome")


@query("agg_latest_sample", "WITH e AS (SELECT event_id, user_id AS sample, ts AS created_at FROM events), n AS (SELECT *, lag(event_id) OVER (PARTITION BY sample ORDER BY created_at, event_id) AS supersedes, count(*) OVER (PARTITION BY sample) AS n_events, row_number() OVER (PARTITION BY sample ORDER BY created_at DESC, event_id DESC) AS nth FROM e) SELECT event_id, sample, supersedes, n_events FROM n WHERE nth = 1")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("sample"), F.col("ts").alias("created_at"))
    return R.grouped_samples(e).select("event_id", "sample", "supersedes", "n_events")


_PAIRS = "items AS (SELECT o_orderstatus AS expected, CASE WHEN o_orderkey % 4 = 0 THEN substr('FOP', (o_orderkey % 3 + 1)::INT, 1) ELSE o_orderstatus END AS predicted, o_custkey AS setup, o_totalprice FROM orders)"


def _pairs(spark, d):
    k = F.col("o_orderkey")
    wrong = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (k % 3 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("expected"), F.when(k % 4 == 0, wrong).otherwise(F.col("o_orderstatus")).alias("predicted"), F.col("o_custkey").alias("setup"), "o_totalprice", "o_orderdate")


@query("agg_confusion", f"WITH {_PAIRS} SELECT expected, predicted, count(*) AS n FROM items GROUP BY ALL")
def _(spark, d):
    return E.confusion(_pairs(spark, d))


_Z = 1.959963984540054
_WILSON = lambda k, n, s: f"round({'greatest(0.0,' if s == '-' else 'least(1.0,'} (({k})::DOUBLE / ({n}) + {_Z * _Z} / (2 * ({n}))) / (1 + {_Z * _Z} / ({n})) {s} {_Z} * sqrt(({k})::DOUBLE / ({n}) * (1 - ({k})::DOUBLE / ({n})) / ({n}) + {_Z * _Z} / (4.0 * ({n}) * ({n}))) / (1 + {_Z * _Z} / ({n}))), 6)"
_CLASS = f"WITH {_PAIRS}, l AS (SELECT DISTINCT expected AS label FROM items UNION SELECT DISTINCT predicted FROM items), n AS (SELECT label, (SELECT count(*) FROM items WHERE expected = label AND predicted = label) AS tp, (SELECT count(*) FROM items WHERE expected != label AND predicted = label) AS fp, (SELECT count(*) FROM items WHERE expected = label AND predicted != label) AS fn FROM l), s AS (SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, {_WILSON('tp', 'tp + fp', '-')} AS precision_low, {_WILSON('tp', 'tp + fp', '+')} AS precision_high, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1 FROM n)"


@query("agg_prf", _CLASS + " SELECT * FROM s")
def _(spark, d):
    return E.class_scores(_pairs(spark, d))


@query("agg_macro_f1_fixed_labels", _CLASS + " SELECT round((sum(f1) + 0.0) / (count(*) + 1), 6) AS macro_f1, count(*) + 1 AS n_labels FROM s")
def _(spark, d):
    p = _pairs(spark, d)
    labels = p.select(F.explode(F.array(F.col("expected"), F.lit("never"))).alias("label"))
    return E.macro_f1(p, labels)


@query("agg_wilson", f"SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n, {_WILSON('''count(*) FILTER (o_orderstatus = 'F')''', 'count(*)', '-')} AS low, {_WILSON('''count(*) FILTER (o_orderstatus = 'F')''', 'count(*)', '+')} AS high FROM orders GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return g.select("o_orderpriority", "k", "n", low.alias("low"), high.alias("high"))


@query("agg_numeric_summary", "WITH r AS (SELECT event_type AS key, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS nth, count(*) OVER (PARTITION BY event_type) AS of FROM events WHERE value IS NOT NULL) SELECT key AS event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) FILTER (nth = ceil(of * 95 / 100)) AS p95, max(value) AS max FROM r GROUP BY key")
def _(spark, d):
    return E.numeric_summary(table(spark, d, "events").select("event_type", "value"), "event_type", "value")


@query("win_state_transition", "WITH t AS (SELECT user_id AS setup, event_id AS at, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) SELECT * FROM t WHERE previous IS NULL OR previous != state")
def _(spark, d):
    return E.transitions(table(spark, d, "events").select(F.col("user_id").alias("setup"), F.col("event_id").alias("at"), F.col("event_type").alias("state")))


@query("eval_setup_split", "SELECT o_custkey AS setup, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def _(spark, d):
    return E.split_leaks(table(spark, d, "orders").select(F.col("o_custkey").alias("setup"), F.col("o_orderstatus").alias("split")))


@query("eval_match_dates")
def _(spark, d):
    o = table(spark, d, "orders")
    return E.matched_dates(o.select(F.col("o_custkey").alias("episode"), F.when(F.col("o_orderkey") % 2 == 0, "expected").otherwise("predicted").alias("kind"), F.to_date("o_orderdate").alias("day")), 1)


@query("agg_bootstrap_ci")
def _(spark, d):
    p = _pairs(spark, d).groupBy(F.col("expected").alias("metric"), F.col("setup")).agg(F.count_if(F.col("expected") == F.col("predicted")).alias("good"), F.count("*").alias("n"))
    return E.bootstrap(p)


@query("normalize_tickers", "WITH t AS (SELECT o_orderkey AS pos, upper(trim(' ' || lower(o_orderpriority) || ' ')) AS ticker FROM orders) SELECT ticker, min(pos) AS pos FROM t WHERE ticker != '' GROUP BY ticker")
def _(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.upper(F.trim(F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")))).alias("ticker"))
    return t.filter("ticker != ''").groupBy("ticker").agg(F.min("pos").alias("pos"))


@query("set_except_tickers", "SELECT DISTINCT s_nationkey AS k, 'only_before' AS side FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 3 != 0)")
def _(spark, d):
    after = table(spark, d, "customer").filter("c_nationkey % 3 != 0").select(F.col("c_nationkey").alias("k"))
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct().join(after, "k", "left_anti").withColumn("side", F.lit("only_before"))


@query("set_intersect_points", "SELECT DISTINCT o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT o_orderdate::DATE FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("day"))
    return o.filter("o_orderstatus = 'F'").select("day").intersect(o.filter("o_orderstatus = 'P'").select("day"))


_LIFE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'pre_breakout' WHEN '2-HIGH' THEN 'forming' WHEN '3-MEDIUM' THEN 'breaking_out' WHEN '5-LOW' THEN 'post_breakout' ELSE 'odd' END"


def _screened(spark, d):
    p = F.col("o_orderpriority")
    life = F.when(p == "1-URGENT", "pre_breakout").when(p == "2-HIGH", "forming").when(p == "3-MEDIUM", "breaking_out").when(p == "5-LOW", "post_breakout").otherwise("odd")
    grade = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit(None).cast("string")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("symbol"), life.alias("lifecycle"), grade.alias("grade"), F.col("o_totalprice").alias("coil_score"), "o_custkey")


@query("sort_screen", f"WITH r AS (SELECT o_orderkey AS symbol, o_custkey, {_LIFE} AS lifecycle, CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS grade, o_totalprice AS coil_score FROM orders) SELECT symbol, lifecycle, grade, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE lifecycle WHEN 'pre_breakout' THEN 0 WHEN 'forming' THEN 1 WHEN 'breaking_out' THEN 2 WHEN 'post_breakout' THEN 3 WHEN 'no_structure' THEN 4 ELSE 99 END, CASE WHEN lifecycle = 'pre_breakout' THEN CASE grade WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END ELSE 0 END, coil_score DESC, symbol)::INT AS rank FROM r")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(*screen.screen_order())
    return _screened(spark, d).select("symbol", "lifecycle", "grade", F.row_number().over(w).alias("rank"))


@query("agg_bucket_counts", f"WITH r AS (SELECT {_LIFE} AS lifecycle FROM orders), n AS (SELECT unnest(['pre_breakout', 'forming', 'breaking_out', 'post_breakout', 'no_structure']) AS lifecycle) SELECT n.lifecycle, count(r.lifecycle) AS n FROM n LEFT JOIN r USING (lifecycle) GROUP BY 1")
def _(spark, d):
    return screen.bucket_counts(_screened(spark, d))


@query("join_snapshot_diff", f"WITH r AS (SELECT o_orderkey AS symbol, {_LIFE} AS lifecycle, CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS grade FROM orders), b AS (SELECT * FROM r WHERE symbol % 5 != 0), a AS (SELECT symbol, lifecycle, CASE WHEN symbol % 7 = 0 THEN 'B' ELSE grade END AS grade FROM r WHERE symbol % 6 != 0) SELECT symbol, b.grade AS before_grade, b.lifecycle AS before_lifecycle, a.grade AS after_grade, a.lifecycle AS after_lifecycle, CASE WHEN b.lifecycle IS NULL THEN 'added' WHEN a.lifecycle IS NULL THEN 'removed' WHEN b.grade IS NOT DISTINCT FROM a.grade AND b.lifecycle = a.lifecycle THEN 'same' ELSE 'changed' END AS change FROM b FULL JOIN a USING (symbol)")
def _(spark, d):
    r = _screened(spark, d)
    after = r.filter("symbol % 6 != 0").withColumn("grade", F.when(F.col("symbol") % 7 == 0, "B").otherwise(F.col("grade")))
    return vision.compared(r.filter("symbol % 5 != 0"), after)


@query("topk_trendlines", """WITH h AS (SELECT user_id AS symbol, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx, value + 1 AS price, 0.5 AS confidence FROM events WHERE event_type = 'purchase'),
 t AS (SELECT a.symbol, a.idx AS ia, b.idx AS ib, h.confidence AS c, a.price + (b.price - a.price) / (b.idx - a.idx) * (h.idx - a.idx) AS line, h.price AS p FROM h a JOIN h b ON a.symbol = b.symbol AND b.idx - a.idx >= 2 JOIN h ON h.symbol = a.symbol),
 s AS (SELECT symbol, ia, ib, count(*) AS touches, round(least(1.0, avg(c) * (1 + 0.1 * (count(*) - 2))), 4)::DOUBLE AS confidence FROM t WHERE line > 0 AND abs(p - line) / line * 100 <= 1.5 GROUP BY ALL)
 SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY touches DESC, confidence DESC, ia, ib)::INT AS rank FROM s QUALIFY rank <= 5""")
def _(spark, d):
    e = table(spark, d, "events").filter("event_type = 'purchase'")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return vision.trendlines(e.select(F.col("user_id").alias("symbol"), F.row_number().over(w).alias("idx"), (F.col("value") + 1).alias("price"), F.lit(0.5).alias("confidence")))


@query("join_vision_snap", """WITH c AS (SELECT user_id AS capture, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS pos, pos * 10.0::DOUBLE AS x, value + 1 AS high, (event_id % 400)::DOUBLE AS y_high FROM events WHERE event_type != 'error'),
 d AS (SELECT user_id AS capture, event_id AS det, (event_id % 600)::DOUBLE AS x, (event_id * 7 % 400)::DOUBLE AS y, value + 1 AS price FROM events WHERE event_type = 'error'),
 near AS (SELECT d.*, (SELECT arg_min(c.pos, (abs(c.x - d.x), c.pos)) FROM c WHERE c.capture = d.capture) AS nearest FROM d),
 s AS (SELECT capture, max(high) - min(high) AS span FROM c GROUP BY capture),
 t AS (SELECT near.capture, det, c.pos, c.high, abs(c.pos - nearest) + 10 * abs(c.high - price) / greatest(span, 1e-9) + 4 * abs(c.y_high - near.y) / 400 AS score FROM near JOIN c ON c.capture = near.capture AND abs(c.pos - nearest) <= 3 JOIN s ON s.capture = near.capture)
 SELECT capture, det, pos, high, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY capture, det ORDER BY score, pos) = 1""")
def _(spark, d):
    e = table(spark, d, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    c = e.filter("event_type != 'error'").select(F.col("user_id").alias("capture"), pos.alias("pos"), (pos * 10.0).alias("x"), (F.col("value") + 1).alias("high"), (F.col("event_id") % 400).cast("double").alias("y_high"))
    det = e.filter("event_type = 'error'").select(F.col("user_id").alias("capture"), F.col("event_id").alias("det"), (F.col("event_id") % 600).cast("double").alias("x"), (F.col("event_id") * 7 % 400).cast("double").alias("y"), (F.col("value") + 1).alias("price"))
    return vision.snapped(det, c, 400.0)


@query("json_canonical_hash")
def _(spark, d):
    return table(spark, d, "events").select("event_id", canonical_hash()("props").alias("sha256"))


@query("ext_rollup_buckets", f"SELECT {_LIFE} AS lifecycle, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2)")
def _(spark, d):
    s = _screened(spark, d).select("lifecycle", "symbol")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("symbol"), "o_orderstatus")
    return s.join(o, "symbol").rollup("lifecycle", "o_orderstatus").agg(F.count("*").alias("n"))
