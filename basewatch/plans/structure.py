"""Queries over lids and what they rest on, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basewatch.operators import anatomy, breakout, gold, lids, peaks, roles, screen
from basewatch.operators import bars as B
from basewatch.operators import reviews as R
from basewatch.plans.events import _LOG, _log
from basewatch.plans.price import _NUMBERED, _QUARTERS, _SWINGS, AS_OF, _clean, _r
from basewatch.plans.registry import registry
from basewatch.sources.tables import DILATED_SQL, MONTHLY_SQL, TICKS_SQL, dilated_bars, monthly_bars, table, ticks, written

query, QUERIES, SQL = registry()


def _as_of():
    return F.lit(AS_OF).cast("date")


def _mountains(spark, d):
    return lids.mountains(lids.charts(_clean(spark, d), _as_of()))


def _flat(df):
    """Arrays of points as their times, numbers rounded: rows that can be compared."""
    times = lambda c: F.transform(c, lambda t: t["q_idx"]).alias(c)
    return df.select(*[times(c) if c in ("anchors", "touches") else F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("win_mountain_pivot", f"WITH {DILATED_SQL}{_QUARTERS}, w AS (SELECT *, lag(high) OVER o AS b, lead(high) OVER o AS a FROM qq WINDOW o AS (PARTITION BY symbol ORDER BY q_idx)) SELECT symbol, q_idx, high FROM w WHERE b < high * 0.99 AND a <= high * 1.01")
def _(spark, d):
    return peaks.mountain_pivots(B.quarterly(_clean(spark, d))).select("symbol", "q_idx", "high")


@query("det_mountain_candidates")
def _(spark, d):
    t = _mountains(spark, d).select("symbol", F.explode("tops").alias("t")).select("symbol", "t.*")
    return t.withColumn("prominence_pct", F.round("prominence_pct", 6))


@query("det_zone_select")
def _(spark, d):
    return _flat(lids.zone_lids(_mountains(spark, d)))


@query("det_sloped_lid")
def _(spark, d):
    return _flat(lids.sloped_lids(_mountains(spark, d)))


@query("det_sloped_rejections")
def _(spark, d):
    return lids.sloped_rejections(lids.sloped_lids(_mountains(spark, d)))


@query("limit_diag")
def _(spark, d):
    return _flat(lids.sloped_lids(_mountains(spark, d)).filter("rank <= 5"))


@query("det_select_family")
def _(spark, d):
    m = written(_mountains(spark, d), "charts")
    return _flat(lids.chosen(lids.zone_lids(m), lids.sloped_lids(m)))


@query("det_lid_breakout")
def _(spark, d):
    m = written(_mountains(spark, d), "charts")
    walk = lids.lid_quarters(m, lids.chosen(lids.zone_lids(m), lids.sloped_lids(m)))
    return breakout.assess(walk.filter("complete"))


@query("det_analyze")
def _(spark, d):
    return lids.analysed(_clean(spark, d), _as_of())


@query("det_window_roles")
def _(spark, d):
    return roles.window_roles(_clean(spark, d))


@query("det_as_of_replay")
def _(spark, d):
    cut = F.lit("1997-12-31").cast("date")
    return lids.analysed(B.clean(dilated_bars(spark, d), cut), cut)


@query("screen_analysis_ranked")
def _(spark, d):
    a = lids.analysed(_clean(spark, d), _as_of())
    rank = F.row_number().over(Window.orderBy(*screen.screen_order()))  # one row for each symbol
    return a.select("symbol", "lifecycle", "grade", "coil_score", rank.alias("rank"))


_MAJORS = _SWINGS + ", t AS (SELECT * FROM sw WHERE prominence_pct >= 15), l AS (SELECT a.symbol, a.idx AS a, b.idx AS b, a.price AS price_a, (b.price - a.price) / (b.idx - a.idx) AS slope FROM t a JOIN t b ON a.symbol = b.symbol AND b.idx - a.idx >= 24)"
_TOUCHES = _MAJORS + ", n AS (SELECT l.symbol, a, b, count(*) AS touches FROM l JOIN sw ON l.symbol = sw.symbol AND idx >= a AND price_a + slope * (idx - a) > 0 AND abs(price - (price_a + slope * (idx - a))) / (price_a + slope * (idx - a)) <= 0.035 GROUP BY ALL)"


def _lines(spark, d):
    s = written(peaks.swings(_clean(spark, d)), "swings")
    return s, peaks.pair_lines(s.filter("prominence_pct >= 15"), 24)


def _touches(spark, d):
    s, lines = _lines(spark, d)
    at = peaks.line_at(F.col("idx"))
    hits = lines.join(s.select("symbol", "idx", "price"), "symbol").filter((F.col("idx") >= F.col("a")) & (at > 0) & (F.abs(F.col("price") - at) <= 0.035 * at))
    return hits.groupBy("symbol", "a", "b").agg(F.count("*").alias("touches"))


@query("join_pair_touches", _TOUCHES + " SELECT * FROM n")
def _(spark, d):
    return _touches(spark, d)


#: Majors by a plain recursion over swings by prominence, then every pair with its clustered touches, gates and score.
_BEST = _SWINGS.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT symbol, list({'idx': idx, 'price': price} ORDER BY prominence_pct DESC, idx) AS tops FROM sw WHERE prominence_pct >= 15 GROUP BY symbol),
 pick AS (SELECT symbol, tops, [] :: STRUCT(idx BIGINT, price DOUBLE)[] AS kept, 1 AS i FROM o UNION ALL
  SELECT symbol, tops, CASE WHEN len(list_filter(kept, lambda k: abs(k.idx - tops[i].idx) < 9)) > 0 THEN kept ELSE list_append(kept, tops[i]) END, i + 1 FROM pick WHERE i <= len(tops)),
 mj AS (SELECT symbol, unnest(kept) AS t FROM pick WHERE i = len(tops) + 1),
 lines AS (SELECT x.symbol, x.t.idx AS a, y.t.idx AS b, x.t.price AS pa, (y.t.price - x.t.price) / (y.t.idx - x.t.idx) AS slope, (SELECT max(idx) FROM c WHERE c.symbol = x.symbol) AS last FROM mj x JOIN mj y ON x.symbol = y.symbol AND y.t.idx - x.t.idx >= 24),
 ok AS (SELECT *, slope * 1200 / (pa + slope * (last - a)) AS slope_pct FROM lines WHERE pa + slope * (last - a) > 0 AND slope * 1200 / (pa + slope * (last - a)) BETWEEN -3 AND 30),
 e AS (SELECT ok.*, sw.idx, sw.price, (sw.price - (pa + slope * (sw.idx - a))) / (pa + slope * (sw.idx - a)) AS off FROM ok JOIN sw ON sw.symbol = ok.symbol AND sw.prominence_pct >= 5 AND pa + slope * (sw.idx - a) > 0),
 g AS (SELECT symbol, a, b, pa, slope, slope_pct, last, list({'idx': idx, 'price': price} ORDER BY idx) FILTER (abs(off) <= 0.035) AS near, count(*) FILTER (off > 0.035) AS overshoots FROM e GROUP BY ALL HAVING count(*) FILTER (off > 0.035) <= 2 AND count(*) FILTER (abs(off) <= 0.035) > 0),
 walk AS (SELECT symbol, a, b, pa, slope, slope_pct, last, overshoots, near, [] :: STRUCT(idx BIGINT, price DOUBLE)[] AS hits, 1 AS i FROM g UNION ALL
  SELECT symbol, a, b, pa, slope, slope_pct, last, overshoots, near, CASE WHEN len(hits) > 0 AND near[i].idx - hits[-1].idx <= 6 THEN CASE WHEN near[i].price > hits[-1].price THEN list_append(hits[:-2], near[i]) ELSE hits END ELSE list_append(hits, near[i]) END, i + 1 FROM walk WHERE i <= len(near)),
 h AS (SELECT *, hits[-1].idx - hits[1].idx AS span, last - hits[-1].idx AS quiet FROM walk WHERE i = len(near) + 1 AND len(hits) >= 2),
 viol AS (SELECT h.symbol, a, b, slope_pct, overshoots, hits, span, quiet, count(*) FILTER (pa + slope * (c.idx - a) <= 0 OR close > (pa + slope * (c.idx - a)) * 1.025) AS violations,
   count(*) FILTER (c.idx < last - 11 AND (pa + slope * (c.idx - a) <= 0 OR close > (pa + slope * (c.idx - a)) * 1.025)) AS early, max(pa + slope * (last - a)) AS lid_now, arg_max(close, c.idx) AS close_now
   FROM h JOIN c ON c.symbol = h.symbol AND c.idx >= hits[1].idx GROUP BY ALL),
 r AS (SELECT *, 0.40 * least(len(hits), 5) / 5 + 0.25 * least(span / 120, 1.0) + 0.20 * greatest(0.0, least(1.0, 1 - abs(slope_pct) / 15)) + 0.15 * greatest(0.0, least(1.0, 1 - quiet / 60)) - 0.10 * overshoots - 0.05 * violations AS score
   FROM viol WHERE span >= 24 AND early = 0 AND NOT (quiet > 48 AND close_now < 0.8 * lid_now))
 SELECT symbol, a, b, len(hits) AS touches, overshoots, violations, round(slope_pct, 6) AS slope_pct, round(score, 6) AS score FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(score, 9) DESC, span DESC, len(hits) DESC, a, b) = 1"""


@query("win_best_pair", _BEST)
def _(spark, d):
    c = _clean(spark, d)
    best = peaks.best_pairs(written(peaks.swings(c), "swings"), c)
    return best.withColumns({"slope_pct": F.round("slope_pct", 6), "score": F.round("score", 6)})


@query("join_line_violations", _MAJORS + " SELECT l.symbol, a, b, count(*) AS violations FROM l JOIN c ON c.symbol = l.symbol AND c.idx >= a AND price_a + slope * (c.idx - a) > 0 AND c.close > (price_a + slope * (c.idx - a)) * 1.025 GROUP BY ALL")
def _(spark, d):
    at = peaks.line_at(F.col("idx"))
    over = _lines(spark, d)[1].join(_clean(spark, d).select("symbol", "idx", "close"), "symbol").filter((F.col("idx") >= F.col("a")) & (at > 0) & (F.col("close") > at * 1.025))
    return over.groupBy("symbol", "a", "b").agg(F.count("*").alias("violations"))


@query("agg_ls_fit", _SWINGS + ", t AS (SELECT * FROM sw WHERE prominence_pct >= 15), f AS (SELECT symbol, regr_slope(price, idx) AS s, regr_intercept(price, idx) AS i FROM t GROUP BY symbol HAVING count(*) >= 2) SELECT symbol, round(s, 6) AS slope, round(i, 6) AS intercept, round(sqrt(avg(pow((price - (i + s * idx)) / (i + s * idx), 2))) * 100, 6) AS rms_pct, round(avg(abs(price - (i + s * idx)) / (i + s * idx)) * 100, 6) AS mean_abs_pct FROM t JOIN f USING (symbol) GROUP BY symbol, s, i")
def _(spark, d):
    t = peaks.swings(_clean(spark, d)).filter("prominence_pct >= 15")
    f = t.groupBy("symbol").agg(F.regr_slope("price", "idx").alias("s"), F.regr_intercept("price", "idx").alias("i"), F.count("*").alias("n")).filter("n >= 2")
    off = (F.col("price") - (F.col("i") + F.col("s") * F.col("idx"))) / (F.col("i") + F.col("s") * F.col("idx"))
    g = t.join(f, "symbol").groupBy("symbol", "s", "i").agg((F.sqrt(F.avg(off * off)) * 100).alias("rms_pct"), (F.avg(F.abs(off)) * 100).alias("mean_abs_pct"))
    return g.select("symbol", F.round("s", 6).alias("slope"), F.round("i", 6).alias("intercept"), *_r("rms_pct", "mean_abs_pct"))


@query("set_dedupe_months", f"WITH {TICKS_SQL} SELECT symbol, date_trunc('month', day)::DATE AS bar_date, arg_max(price, key) AS price FROM ticks GROUP BY ALL")
def _(spark, d):
    return ticks(spark, d).groupBy("symbol", F.to_date(F.trunc("day", "MM")).alias("bar_date")).agg(F.max_by("price", "key").alias("price"))


@query("win_quarter_contiguity", f"WITH {MONTHLY_SQL}{_NUMBERED}{_QUARTERS.replace(_NUMBERED, '')}, o AS (SELECT symbol, q_idx, year * 4 + qtr AS ordinal FROM qq) SELECT symbol, q_idx, ordinal - lag(ordinal) OVER (PARTITION BY symbol ORDER BY q_idx) AS step FROM o")
def _(spark, d):
    q = B.quarterly(B.clean(monthly_bars(spark, d))).withColumn("ordinal", F.col("year") * 4 + F.col("qtr"))
    return q.select("symbol", "q_idx", (F.col("ordinal") - F.lag("ordinal").over(Window.partitionBy("symbol").orderBy("q_idx"))).alias("step"))


@query("join_month_to_quarter", f"WITH {DILATED_SQL}{_QUARTERS} SELECT c.symbol, c.idx, qq.q_idx FROM c JOIN qq ON c.symbol = qq.symbol AND year(c.bar_date) = qq.year AND quarter(c.bar_date) = qq.qtr")
def _(spark, d):
    c = _clean(spark, d)
    q = B.quarterly(c).select("symbol", "year", "qtr", "q_idx")
    return c.withColumns({"year": F.year("bar_date"), "qtr": F.quarter("bar_date")}).join(q, ["symbol", "year", "qtr"]).select("symbol", "idx", "q_idx")


@query("win_rolling_extrema_12", f"WITH {DILATED_SQL}, r AS (SELECT symbol, bar_date, max(high) OVER w AS top, min(low) OVER w AS bottom, count(*) OVER w AS n, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS back FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT symbol, bar_date, top, bottom FROM r WHERE n = 12 AND back <= 60")
def _(spark, d):
    w = B.by_time().rowsBetween(-11, 0)
    r = dilated_bars(spark, d).select("symbol", "bar_date", F.max("high").over(w).alias("top"), F.min("low").over(w).alias("bottom"), F.count("*").over(w).alias("n"))
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("bar_date")))
    return r.withColumn("back", back).filter("n = 12 AND back <= 60").drop("n", "back")


@query("agg_zscore", "SELECT event_id, round(CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0.0 END, 5) AS z FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type)")
def _(spark, d):
    g = table(spark, d, "events").filter("value IS NOT NULL")
    s = g.groupBy("event_type").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))  # one row for each type, not a window over a hot one
    return g.join(s, "event_type").select("event_id", F.round(F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0), 5).alias("z"))


@query("topk_highs", "WITH t AS (SELECT user_id, ts::DATE AS day, event_id, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY value DESC, event_id DESC) = 1) SELECT user_id, day, event_id, value FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day) <= 3")
def _(spark, d):
    e = table(spark, d, "events").filter("value IS NOT NULL").withColumn("day", F.to_date("ts"))
    one = e.groupBy("user_id", "day").agg(F.max(F.struct("value", "event_id")).alias("m")).select("user_id", "day", "m.event_id", "m.value")
    return one.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("day"))).filter("nth <= 3").drop("nth")


@query("join_session_items", f"WITH {_LOG}, t AS (SELECT * FROM lg WHERE decision != 'capture' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY id DESC) = 1) SELECT o_orderkey AS item, o_custkey AS ticker, CASE WHEN t.decision != 'revoke' THEN t.decision END AS state, coalesce(t.decision = 'corrected', false) AS overridden FROM orders LEFT JOIN t ON t.ticker = o_custkey")
def _(spark, d):
    state = R.effective(_log(spark, d)).select("ticker", "state")
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("ticker"))
    return items.join(state, "ticker", "left").select("item", "ticker", "state", F.coalesce(F.col("state") == "corrected", F.lit(False)).alias("overridden"))


@query("join_export_union_semi", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id")
    session = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    current = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("event_id"))
    return e.join(session, "user_id", "left_semi").select("event_id", "user_id").union(e.join(current, "event_id", "left_semi").select("event_id", "user_id")).distinct()


@query("set_union_universe", "WITH u AS (SELECT s_nationkey AS k, s_suppkey AS pos FROM supplier UNION ALL SELECT c_nationkey, 1000000000 + c_custkey FROM customer) SELECT k, min(pos) AS pos FROM u GROUP BY k")
def _(spark, d):
    own = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").cast("long").alias("pos"))
    more = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), (F.lit(10**9) + F.col("c_custkey")).cast("long").alias("pos"))
    return own.unionByName(more).groupBy("k").agg(F.min("pos").alias("pos"))


@query("set_first_seen_items", "SELECT o_custkey AS ticker, min(o_orderkey) AS ordinal FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("ticker")).agg(F.min("o_orderkey").alias("ordinal"))


def _flat_structs(df):
    """Structs as columns named by both names, joined by an underscore."""
    out = []
    for f in df.schema.fields:
        out += [F.col(f"{f.name}.{g}").alias(f"{f.name}_{g}") for g in f.dataType.names] if f.dataType.typeName() == "struct" else [F.col(f.name)]
    return df.select(*out)


@query("det_anatomy")
def _(spark, d):
    return _flat_structs(anatomy.anatomy(lids.measured(*lids.detected(_clean(spark, d), _as_of()))))


def _reviewed_points(spark, d):
    """A reviewer's tops: every 37th month, some without a price, some as breakout peaks, in some symbols only flagged ones in the lid."""
    i, n = F.col("idx"), F.length("symbol")
    some = _clean(spark, d).filter((i % 37 == 11) & (n % 3 > 0))
    return some.select("symbol", i.alias("nth"), F.col("bar_date").alias("day"), F.when(i % 4 > 0, F.col("high") * 1.01).alias("price"), F.when(i % 5 == 0, "breakout_peak").otherwise("major_top").alias("role"), F.when(n % 2 == 0, i % 3 == 0).alias("lid_member"))


@query("det_review_lid", f"""WITH {DILATED_SQL}{_QUARTERS}, lq AS (SELECT symbol, max(q_idx) AS last FROM qq GROUP BY 1), nd AS (SELECT qq.symbol, last + 1 AS n_all, CASE WHEN last_month % 3 = 0 AND last_day(bar_date) <= DATE '{AS_OF}' THEN last + 1 ELSE last END AS n_done FROM qq JOIN lq ON qq.symbol = lq.symbol AND q_idx = last),
 pt AS (SELECT c.symbol, c.idx, q_idx, CASE WHEN idx % 4 > 0 THEN c.high * 1.01 ELSE c.high END AS price, length(c.symbol) % 2 = 0 AND idx % 3 = 0 AS member FROM c JOIN qq ON qq.symbol = c.symbol AND qq.year = year(c.bar_date) AND qq.qtr = quarter(c.bar_date) JOIN nd ON nd.symbol = c.symbol WHERE idx % 37 = 11 AND length(c.symbol) % 3 > 0 AND idx % 5 > 0 AND q_idx < n_done),
 ex AS (SELECT symbol, bool_or(length(symbol) % 2 = 0 AND idx % 3 = 0) AS explicit FROM c WHERE idx % 37 = 11 GROUP BY 1), an AS (SELECT pt.* FROM pt JOIN ex USING (symbol) WHERE NOT explicit OR member),
 f AS (SELECT symbol, count(*) AS anchors, regr_slope(price, q_idx) AS s, regr_intercept(price, q_idx) AS b, max(q_idx) AS last_q FROM an GROUP BY 1 HAVING count(*) >= 2), v AS (SELECT f.*, b + s * (n_all - 1) AS here FROM f JOIN nd USING (symbol) WHERE b + s * (n_all - 1) > 0),
 e AS (SELECT symbol, sqrt(avg(pow((price - (b + s * q_idx)) / (b + s * q_idx), 2))) * 100 AS err, min(b + s * q_idx) AS low FROM an JOIN v USING (symbol) GROUP BY 1)
 SELECT symbol, anchors::INT AS anchors, round(s, 6) AS slope, round(here, 4) AS value_at_last, round(s * 400 / here, 4) AS slope_pct_per_year, CASE WHEN low > 0 THEN round(err, 4) END AS fit_error_pct, (last_q + 1)::INT AS start_q FROM v JOIN e USING (symbol)""")
def _(spark, d):
    lid = lids.review_lids(lids.charts(_clean(spark, d), _as_of()), _reviewed_points(spark, d))
    error = F.when(F.col("fit_error_pct") < float("inf"), F.round("fit_error_pct", 4)).alias("fit_error_pct")
    return lid.select("symbol", F.size("anchors").alias("anchors"), F.round("slope", 6).alias("slope"), F.round("value_at_last", 4).alias("value_at_last"), F.round("slope_pct_per_year", 4).alias("slope_pct_per_year"), error, F.col("start_q").cast("int").alias("start_q"))


@query("det_review_override")
def _(spark, d):
    return lids.overridden(_clean(spark, d), _as_of(), _reviewed_points(spark, d))


@query("eval_anatomy_phases")
def _(spark, d):
    """How the phases that an analysis saw a year and a half ago agree with those it sees now."""
    then = F.lit("2012-06-30").cast("date")
    of = lambda months, at: anatomy.phases(anatomy.anatomy(lids.measured(*lids.detected(months, at))))
    return gold.phase_metrics(of(_clean(spark, d), _as_of()), of(B.clean(dilated_bars(spark, d), then), then))
