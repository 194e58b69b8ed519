"""Queries over bars, and the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from basewatch.functions.scalars import grade_for_slope
from basewatch.operators import bars as B
from basewatch.operators import breakout, peaks, screen
from basewatch.params import DEFAULT
from basewatch.plans.registry import registry
from basewatch.sources.tables import DILATED_SQL, MONTHLY_SQL, dilated_bars, monthly_bars

query, QUERIES, SQL = registry()
AS_OF = "2014-01-31"
_NUMBERED = ", c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS idx FROM bars)"
_QUARTERS = _NUMBERED + """, q AS (SELECT symbol, year(bar_date) AS year, quarter(bar_date) AS qtr, arg_min(open, idx) AS open, max(high) AS high, min(low) AS low, arg_max(close, idx) AS close,
  max(bar_date) AS bar_date, max(idx) AS close_src_idx, max(month(bar_date)) AS last_month, CASE WHEN count(DISTINCT month(bar_date)) = 3 THEN sum(volume) END AS volume FROM c GROUP BY ALL),
 qq AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY year, qtr) - 1 AS q_idx FROM q)"""


def _clean(spark, d):
    return B.clean(dilated_bars(spark, d))


def _r(*cols, digits=6):
    return [F.round(c, digits).alias(c) for c in cols]


@query("src_bars_monthly", f"WITH {MONTHLY_SQL} SELECT * FROM bars")
def _(spark, d):
    return monthly_bars(spark, d)


@query("src_bars_dilated", f"WITH {DILATED_SQL} SELECT * FROM bars")
def _(spark, d):
    return dilated_bars(spark, d)


@query("clean_bars_as_of", f"WITH {DILATED_SQL} SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) - 1 AS idx FROM bars WHERE bar_date <= DATE '2000-06-30'")
def _(spark, d):
    return B.clean(dilated_bars(spark, d), F.lit("2000-06-30").cast("date"))


@query("agg_quarterly_bars", f"WITH {DILATED_SQL}{_QUARTERS} SELECT qq.*, (SELECT min(idx) FROM c WHERE c.symbol = qq.symbol AND year(c.bar_date) = qq.year AND quarter(c.bar_date) = qq.qtr AND c.high = qq.high) AS high_src_idx FROM qq")
def _(spark, d):
    return B.quarterly(_clean(spark, d))


@query("det_completeness", f"WITH {DILATED_SQL}{_QUARTERS} SELECT symbol, q_idx, close FROM qq WHERE q_idx < (SELECT max(q_idx) FROM qq z WHERE z.symbol = qq.symbol) OR (last_month % 3 = 0 AND last_day(bar_date) <= DATE '{AS_OF}')")
def _(spark, d):
    return B.completed(B.quarterly(_clean(spark, d)), F.lit(AS_OF).cast("date")).select("symbol", "q_idx", "close")


@query("join_merge_history", f"""WITH {DILATED_SQL}, live AS (SELECT symbol, bar_date, open, high, low, close * 1.01 AS close, volume FROM bars WHERE bar_date >= DATE '2005-01-01'),
 b AS (SELECT *, 0 AS l FROM bars WHERE bar_date < DATE '2010-01-01' UNION ALL SELECT *, 1 FROM live)
 SELECT symbol, bar_date, open, high, low, close, volume FROM b QUALIFY row_number() OVER (PARTITION BY symbol, bar_date ORDER BY l DESC) = 1""")
def _(spark, d):
    bars = dilated_bars(spark, d)
    live = bars.filter("bar_date >= DATE '2005-01-01'").withColumn("close", F.col("close") * 1.01)
    return B.merged(bars.filter("bar_date < DATE '2010-01-01'"), live)


@query("inspect_bars", f"""WITH {DILATED_SQL}, t AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS pos, bar_date, CASE WHEN month(bar_date) = 5 THEN -open ELSE open END AS open, CASE WHEN month(bar_date) = 7 THEN low / 2 ELSE high END AS high, low, CASE WHEN month(bar_date) = 9 THEN NULL ELSE close END AS close, CASE WHEN month(bar_date) = 11 THEN -volume ELSE volume END AS volume FROM bars)
 SELECT symbol, pos, 'nonpositive' AS issue FROM t WHERE open <= 0 UNION ALL
 SELECT symbol, pos, 'impossible_range' FROM t WHERE high < greatest(open, close, low) OR low > least(open, close, high) UNION ALL
 SELECT symbol, pos, 'invalid_field' FROM t WHERE close IS NULL UNION ALL SELECT symbol, pos, 'invalid_volume' FROM t WHERE volume < 0""")
def _(spark, d):
    b = dilated_bars(spark, d).withColumn("pos", F.row_number().over(B.by_time()))
    m = F.month("bar_date")
    damaged = b.withColumns({"open": F.when(m == 5, -F.col("open")).otherwise(F.col("open")), "high": F.when(m == 7, F.col("low") / 2).otherwise(F.col("high")), "close": F.when(m != 9, F.col("close")), "volume": F.when(m == 11, -F.col("volume")).otherwise(F.col("volume"))})
    return B.issues(damaged)


#: Bars as they may come in: of some symbols out of order, twice, with a negative volume, stretched upwards; the same in SQL.
_DAMAGED = """ordered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date) AS nth FROM bars),
 d AS (SELECT symbol, nth + CASE WHEN symbol < 'C' AND nth % 50 = 7 THEN 3 ELSE 0 END + 0.0 AS key, bar_date, open, CASE WHEN symbol < 'J' AND nth % 37 = 0 THEN high * 8 ELSE high END AS high, low, close, CASE WHEN symbol BETWEEN 'E' AND 'F' AND nth = 5 THEN -volume ELSE volume END AS volume FROM ordered
   UNION ALL SELECT symbol, nth + 2.5, bar_date, open, high, low, close, volume FROM ordered WHERE symbol > 'U' AND nth % 90 = 11),
 b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY key, bar_date) AS pos FROM d)"""


def _damaged(spark, d):
    b = dilated_bars(spark, d).withColumn("nth", F.row_number().over(B.by_time()))
    s, nth = F.col("symbol"), F.col("nth")
    again = b.filter((s > "U") & (nth % 90 == 11)).withColumn("key", nth + 2.5)
    b = b.withColumn("key", nth + F.when((s < "C") & (nth % 50 == 7), 3).otherwise(0) + 0.0)
    b = b.withColumns({"high": F.when((s < "J") & (nth % 37 == 0), F.col("high") * 8).otherwise(F.col("high")), "volume": F.when(s.between("E", "F") & (nth == 5), -F.col("volume")).otherwise(F.col("volume"))})
    return b.unionByName(again).withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("key", "bar_date"))).drop("nth", "key")


_QUALITY = f"""WITH {DILATED_SQL}, {_DAMAGED}, r AS (SELECT symbol, pos, bar_date, open, high, low, close, volume, (abs(open) + abs(close)) / 2 AS body, (high - low) / body AS range, greatest(0, high - greatest(open, close)) / body AS upper, greatest(0, least(open, close) - low) / body AS lower, lag(close) OVER w AS before,
   lag(bar_date) OVER w AS last_date, row_number() OVER (PARTITION BY symbol, bar_date ORDER BY pos) AS times FROM b WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
 h AS (SELECT symbol FROM r WHERE times > 1 UNION ALL SELECT symbol FROM r WHERE bar_date < last_date UNION ALL SELECT symbol FROM r WHERE volume < 0),
 s AS (SELECT *, median(range) OVER t AS mid, count(range) OVER t AS n FROM r WINDOW t AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
 f AS (SELECT symbol, (n >= 12 AND greatest(upper, lower) >= 0.5 AND greatest(upper, lower) >= 6 * mid) AS wick, coalesce(greatest(body / before, before / body) >= 4, false) AS jump FROM s)
 SELECT symbol, sum(wick::INT)::BIGINT AS wicks, sum(jump::INT)::BIGINT AS jumps, coalesce(any_value(n_hard), 0) AS hard,
  CASE WHEN any_value(n_hard) > 0 THEN 'quarantined' WHEN sum(wick::INT) + sum(jump::INT) > 0 THEN 'flagged_for_review' ELSE 'clear_by_defined_checks' END AS status FROM f LEFT JOIN (SELECT symbol, count(*) AS n_hard FROM h GROUP BY symbol) USING (symbol) GROUP BY symbol"""


@query("data_quality", _QUALITY)
def _(spark, d):
    return B.data_quality(_damaged(spark, d))


_FEATURES = f"""WITH {DILATED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS back, CASE WHEN count(*) OVER w = 12 THEN max(high) OVER w END AS top, CASE WHEN count(*) OVER w = 12 THEN min(low) OVER w END AS bottom FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
 f AS (SELECT symbol, count(*) AS n_bars, arg_max(close, bar_date) AS last_close, {', '.join(f'max(high) FILTER (back <= {n}) AS high{n}, min(low) FILTER (back <= {n}) AS low{n}' for n in (120, 60, 36, 24))},
  regr_slope(top, -back) FILTER (back <= 60) AS ah, stddev_pop(top) FILTER (back <= 60) AS sh, regr_slope(bottom, -back) FILTER (back <= 60) AS al, stddev_pop(bottom) FILTER (back <= 60) AS sl, regr_r2(close, -back) FILTER (back <= 60) AS r2,
  max(high) FILTER (back > 24) AS old_high, max(bar_date) AS last_date FROM r GROUP BY symbol),
 g AS (SELECT f.*, (SELECT min(bar_date) FROM r WHERE r.symbol = f.symbol AND back > 24 AND high = old_high) AS old_date FROM f WHERE n_bars >= 120),
 h AS (SELECT symbol, n_bars / 12.0 AS age_years, last_close, (last_close - low120) / (high120 - low120) AS position, (high120 - last_close) / high120 AS distance, (high24 - low24) / (high120 - low120) AS rr120, (high24 - low24) / (high60 - low60) AS rr60,
  (low36 - low120) / low120 AS low_lift, CASE WHEN sh > 0 THEN ah / sh ELSE 0.0 END AS slope_high, CASE WHEN sl > 0 THEN al / sl ELSE 0.0 END AS slope_low, r2 AS trend_r2, old_high / high120 AS old_peak_similarity,
  CASE WHEN old_high / high120 >= 0.8 THEN (year(last_date) - year(old_date)) * 12 + month(last_date) - month(old_date) ELSE 0 END::INT AS peak_age FROM g WHERE high120 > low120 AND high60 > low60)"""
_FCOLS = ("age_years", "last_close", "position", "distance", "rr120", "rr60", "low_lift", "slope_high", "slope_low", "trend_r2", "old_peak_similarity")
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _FCOLS)


@query("agg_features", _FEATURES + f" SELECT symbol, {_ROUNDED}, peak_age FROM h")
def _(spark, d):
    return screen.features(dilated_bars(spark, d)).select("symbol", *_r(*_FCOLS), "peak_age")


_c = lambda x: f"greatest(0.0, least(1.0, {x}))"
_SCORES = _FEATURES + f""", p AS (SELECT *, ({_c('(0.60 - rr120) / 0.35')} + {_c('(0.70 - rr60) / 0.35')}) / 2 AS squeeze FROM h),
 s AS (SELECT symbol, ({_c('(age_years - 10) / 15')} + {_c('(position - 0.70) / 0.25')} + squeeze + {_c('low_lift / 1.5')} + ((old_peak_similarity >= 0.8)::INT + {_c('(peak_age - 60) / 120.0')} + {_c('(old_peak_similarity - 0.80) / 0.20')}) / 3) / 5 AS score_long,
  ({_c('(0.15 - distance) / 0.15')} + {_c('(position - 0.75) / 0.20')} + {_c('(0.50 - rr120) / 0.30')} + {_c('(0.70 - rr60) / 0.35')}) / 4 AS score_tight,
  ({_c('(slope_low - 0.005) / 0.05')} + {_c('(0.03 - abs(slope_high)) / 0.03')} + {_c('(position - 0.65) / 0.25')} + squeeze) / 4 AS score_ascending,
  ({_c('(trend_r2 - 0.65) / 0.25')} + {_c('(slope_high - 0.04) / 0.05')} + {_c('(rr120 - 0.65) / 0.25')}) / 3 AS score_anti FROM p),
 t AS (SELECT *, {_c('0.40 * score_long + 0.35 * score_tight + 0.25 * score_ascending - 0.35 * score_anti')} AS score_total FROM s)"""


@query("screen_scores", _SCORES + " SELECT symbol, round(score_long, 6) AS score_long, round(score_tight, 6) AS score_tight, round(score_ascending, 6) AS score_ascending, round(score_anti, 6) AS score_anti, round(score_total, 6) AS score_total FROM t")
def _(spark, d):
    return screen.scores(screen.features(dilated_bars(spark, d))).select("symbol", *_r("score_long", "score_tight", "score_ascending", "score_anti", "score_total"))


@query("sort_legacy", _SCORES + " SELECT symbol, round(score_total, 6) AS score_total, row_number() OVER (ORDER BY round(score_total, 6) DESC, round(score_long, 6) DESC, symbol)::INT AS rank FROM t")
def _(spark, d):
    s = screen.scores(screen.features(dilated_bars(spark, d))).select("symbol", *_r("score_total", "score_long"))
    return s.select("symbol", "score_total", F.row_number().over(Window.orderBy(F.desc("score_total"), F.desc("score_long"), "symbol")).alias("rank"))  # one row for each symbol


@query("win_pivot_high", f"WITH {DILATED_SQL}{_NUMBERED}, w AS (SELECT *, max(high) OVER b AS mb, count(*) OVER b AS nb, max(high) OVER a AS ma, count(*) OVER a AS na FROM c WINDOW b AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) SELECT symbol, idx, high FROM w WHERE nb = 3 AND na = 3 AND high > mb AND high >= ma")
def _(spark, d):
    return peaks.pivots(_clean(spark, d), 3, 3).select("symbol", "idx", "high")


_SWINGS = f"""WITH {DILATED_SQL}{_NUMBERED}, w AS (SELECT *, max(high) OVER b AS mb, count(*) OVER b AS nb, max(high) OVER a AS ma, count(*) OVER a AS na FROM c WINDOW b AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
 v AS (SELECT *, (nb = 3 AND na = 3 AND high > mb AND high >= ma) AS top FROM w),
 k AS (SELECT t.symbol, t.idx, t.bar_date, t.high, max(b.idx) FILTER (b.idx < t.idx) AS wl, min(b.idx) FILTER (b.idx > t.idx) AS wr FROM v t LEFT JOIN v b ON b.symbol = t.symbol AND b.idx != t.idx AND (b.high > t.high OR (b.top AND b.high >= t.high * (1 - 1.0 / 100))) WHERE t.top GROUP BY ALL),
 mm AS (SELECT k.symbol, k.idx, k.bar_date, k.high, min(c.low) FILTER (c.idx < k.idx AND c.idx > coalesce(wl, -1)) AS ll, min(c.low) FILTER (c.idx > k.idx AND c.idx < coalesce(wr, 2147483647)) AS lr FROM k JOIN c USING (symbol) GROUP BY ALL),
 sw AS (SELECT symbol, idx, bar_date, high AS price, coalesce((high - greatest(ll, lr)) / high * 100, 0.0) AS prominence_pct FROM mm)"""


@query("det_swing_highs", _SWINGS + " SELECT symbol, idx, bar_date, price, round(prominence_pct, 6) AS prominence_pct FROM sw")
def _(spark, d):
    return peaks.swings(_clean(spark, d)).withColumn("prominence_pct", F.round("prominence_pct", 6))


@query("det_select_majors")
def _(spark, d):
    return peaks.separated(peaks.swings(_clean(spark, d)), DEFAULT.major_prominence_pct, DEFAULT.major_separation)


@query("det_price_zones")
def _(spark, d):
    return peaks.zones(peaks.swings(_clean(spark, d)).filter("prominence_pct >= 18.5")).withColumn("level", F.round("level", 6))


_LID = _QUARTERS + """, z AS (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY q_idx ROWS BETWEEN 24 PRECEDING AND 8 PRECEDING) AS lid, lag(close) OVER (PARTITION BY symbol ORDER BY q_idx) AS before FROM qq),
 tr AS (SELECT *, greatest(high - low, abs(high - before), abs(low - before)) AS true_range FROM z),
 bd AS (SELECT *, greatest(2.5, least(5.0, avg(true_range) OVER (PARTITION BY symbol ORDER BY q_idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) / lid * 100 * 0.5)) AS band_pct FROM tr)"""


def _lids(spark, d):
    """Quarters with the highest high of the four years that ended two years before as their lid."""
    q = B.quarterly(_clean(spark, d))
    lid = F.max("high").over(Window.partitionBy("symbol").orderBy("q_idx").rowsBetween(-24, -8))
    return peaks.escape_band(q.withColumn("lid", lid))


@query("win_true_range_band", f"WITH {DILATED_SQL}{_LID} SELECT symbol, q_idx, round(true_range, 6) AS true_range, round(band_pct, 6) AS band_pct FROM bd WHERE lid IS NOT NULL")
def _(spark, d):
    return _lids(spark, d).filter("lid IS NOT NULL").select("symbol", "q_idx", *_r("true_range", "band_pct"))


@query("det_breakout_fsm")
def _(spark, d):
    return breakout.assess(_lids(spark, d).filter("lid IS NOT NULL"))


@query("agg_log_r2", f"WITH {DILATED_SQL}{_NUMBERED} SELECT symbol, round(regr_r2(ln(close), idx), 6) AS r2, round(regr_slope(ln(close), idx), 8) AS slope FROM c GROUP BY symbol HAVING count(*) >= 3")
def _(spark, d):
    c = _clean(spark, d)
    return c.groupBy("symbol").agg(F.round(F.regr_r2(F.ln("close"), F.col("idx")), 6).alias("r2"), F.round(F.regr_slope(F.ln("close"), F.col("idx")), 8).alias("slope"), F.count("*").alias("n")).filter("n >= 3").drop("n")


@query("agg_dir_efficiency", f"WITH {DILATED_SQL}{_NUMBERED}, e AS (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY idx)) AS r FROM c) SELECT symbol, round(abs(sum(r)) / nullif(sum(abs(r)), 0), 6) AS efficiency FROM e GROUP BY symbol")
def _(spark, d):
    w = Window.partitionBy("symbol").orderBy("idx")
    r = _clean(spark, d).withColumn("r", F.ln(F.col("close") / F.lag("close").over(w)))
    return r.groupBy("symbol").agg(F.round(F.abs(F.sum("r")) / F.nullif(F.sum(F.abs("r")), F.lit(0.0)), 6).alias("efficiency"))


@query("win_fast_rejection", f"WITH {DILATED_SQL}{_QUARTERS} SELECT symbol, q_idx, high, min(close) OVER (PARTITION BY symbol ORDER BY q_idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS low_close FROM qq")
def _(spark, d):
    w = Window.partitionBy("symbol").orderBy("q_idx").rowsBetween(1, 2)
    return B.quarterly(_clean(spark, d)).select("symbol", "q_idx", "high", F.min("close").over(w).alias("low_close"))


@query("win_direction_changes", f"WITH {DILATED_SQL}{_QUARTERS}, s AS (SELECT symbol, q_idx, sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY q_idx)) AS s FROM qq), t AS (SELECT symbol, s, lag(s) OVER (PARTITION BY symbol ORDER BY q_idx) AS p FROM s WHERE s != 0) SELECT symbol, count(*) FILTER (p IS NOT NULL AND s != p) AS changes FROM t GROUP BY symbol")
def _(spark, d):
    w = Window.partitionBy("symbol").orderBy("q_idx")
    s = B.quarterly(_clean(spark, d)).select("symbol", "q_idx", F.signum(F.col("close") - F.lag("close").over(w)).alias("s")).filter("s != 0")
    return s.withColumn("p", F.lag("s").over(w)).groupBy("symbol").agg(F.count_if((F.col("s") != F.col("p"))).alias("changes"))


@query("agg_volume_ratio", f"WITH {DILATED_SQL}{_NUMBERED}, v AS (SELECT symbol, volume, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS a, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS b, count(*) OVER (PARTITION BY symbol) AS n FROM c WHERE volume > 0) SELECT symbol, round(avg(volume) FILTER (b <= 12) / avg(volume) FILTER (a <= n // 3), 6) AS ratio FROM v GROUP BY symbol")
def _(spark, d):
    w = Window.partitionBy("symbol")
    v = _clean(spark, d).filter("volume > 0").select("symbol", "volume", F.row_number().over(w.orderBy("idx")).alias("a"), F.row_number().over(w.orderBy(F.desc("idx"))).alias("b"), F.count("*").over(w).alias("n"))
    return v.groupBy("symbol").agg(F.round(F.avg(F.when(F.col("b") <= 12, F.col("volume"))) / F.avg(F.when(F.col("a") <= F.floor(F.col("n") / 3), F.col("volume"))), 6).alias("ratio"))


@query("agg_relative_volume", f"WITH {DILATED_SQL}{_NUMBERED} SELECT symbol, idx, CASE WHEN count(volume) OVER w >= 2 THEN round(volume / median(volume) OVER w, 6) END AS relative FROM c WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    w = Window.partitionBy("symbol").orderBy("idx").rowsBetween(-8, -1)
    v = _clean(spark, d).withColumn("t", F.sort_array(F.collect_list("volume").over(w)))
    n = F.size("t")
    mid = (F.try_element_at("t", F.floor((n + 1) / 2).cast("int")) + F.try_element_at("t", F.floor((n + 2) / 2).cast("int"))) / 2
    return v.select("symbol", "idx", F.when(n >= 2, F.round(F.col("volume") / mid, 6)).alias("relative"))


@query("agg_range_contraction", f"WITH {DILATED_SQL}{_NUMBERED}, v AS (SELECT symbol, (high - low) / close * 100 AS r, idx, count(*) OVER (PARTITION BY symbol) AS n FROM c) SELECT symbol, round(median(r) FILTER (idx >= n - n // 3) / median(r) FILTER (idx < n // 3), 6) AS contraction FROM v GROUP BY symbol")
def _(spark, d):
    v = _clean(spark, d).select("symbol", ((F.col("high") - F.col("low")) / F.col("close") * 100).alias("r"), "idx", F.floor(F.count("*").over(Window.partitionBy("symbol")) / 3).alias("k"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    return v.groupBy("symbol").agg(F.round(F.median(F.when(F.col("idx") >= F.col("n") - F.col("k"), F.col("r"))) / F.median(F.when(F.col("idx") < F.col("k"), F.col("r"))), 6).alias("contraction"))


@query("join_asof_last_close", f"WITH {DILATED_SQL} SELECT symbol, arg_max(close, bar_date) AS close, max(bar_date) AS bar_date FROM bars WHERE bar_date <= DATE '2003-03-15' GROUP BY symbol")
def _(spark, d):
    return dilated_bars(spark, d).filter("bar_date <= DATE '2003-03-15'").groupBy("symbol").agg(F.max_by("close", "bar_date").alias("close"), F.max("bar_date").alias("bar_date"))


@query("limit_max_bars", f"WITH {DILATED_SQL} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) <= 24")
def _(spark, d):
    w = Window.partitionBy("symbol").orderBy(F.desc("bar_date"))
    return dilated_bars(spark, d).withColumn("nth", F.row_number().over(w)).filter("nth <= 24").drop("nth")


@query("det_pullbacks", _SWINGS + """, t AS (SELECT symbol, idx AS a, coalesce(lead(idx) OVER (PARTITION BY symbol ORDER BY idx), 1000000000) AS b, price FROM sw WHERE prominence_pct >= 15),
 p AS (SELECT t.symbol, a, price, arg_min(c.idx, (c.low, c.idx)) AS low_idx, min(c.low) AS low FROM t JOIN c ON c.symbol = t.symbol AND c.idx > a AND c.idx < b GROUP BY t.symbol, a, b, price HAVING count(*) >= 3)
 SELECT symbol, a AS touch_idx, low_idx, low, round((price - low) / price * 100, 6) AS depth_pct FROM p""")
def _(spark, d):
    c = _clean(spark, d)
    w = Window.partitionBy("symbol").orderBy("idx")
    t = peaks.swings(c).filter("prominence_pct >= 15").select("symbol", F.col("idx").alias("touch_idx"), "price", F.coalesce(F.lead("idx").over(w), F.lit(10**9)).alias("next"))
    pairs = t.join(c.select("symbol", "idx", "low"), "symbol").filter("idx > touch_idx AND idx < next")
    low = pairs.groupBy("symbol", "touch_idx", "price").agg(F.min(F.struct("low", "idx")).alias("m"), F.count("*").alias("n")).filter("n >= 3")
    return low.select("symbol", "touch_idx", F.col("m.idx").alias("low_idx"), F.col("m.low").alias("low"), F.round((F.col("price") - F.col("m.low")) / F.col("price") * 100, 6).alias("depth_pct"))


_GRADE = "CASE WHEN s IS NULL OR s < -3 THEN NULL WHEN s >= -1 AND s < 5 THEN 'A' WHEN s < 6.5 THEN 'B' WHEN s < 12 THEN 'C' END"


@query("classify_grade", f"WITH {DILATED_SQL}{_NUMBERED}, f AS (SELECT symbol, regr_slope(high, idx) / avg(high) * 1200 AS s FROM c GROUP BY symbol) SELECT symbol, round(s, 6) AS slope_pct, {_GRADE} AS grade FROM f")
def _(spark, d):
    f = _clean(spark, d).groupBy("symbol").agg((F.regr_slope("high", "idx") / F.avg("high") * 1200).alias("s"))
    return f.select("symbol", F.round("s", 6).alias("slope_pct"), grade_for_slope(F.col("s")).alias("grade"))


@query("agg_slope_hist", f"WITH {DILATED_SQL}{_NUMBERED}, f AS (SELECT symbol, regr_slope(high, idx) / avg(high) * 1200 AS s FROM c GROUP BY symbol) SELECT CASE WHEN s < -3 THEN '<-3' WHEN s < 0 THEN '-3..0' WHEN s < 2 THEN '0..2' WHEN s < 5 THEN '2..5' WHEN s < 12 THEN '5..12' ELSE '>=12' END AS bucket, count(*) AS n, round(min(s), 6) AS low, round(median(s), 6) AS middle, round(max(s), 6) AS high FROM f GROUP BY 1")
def _(spark, d):
    f = _clean(spark, d).groupBy("symbol").agg((F.regr_slope("high", "idx") / F.avg("high") * 1200).alias("s"))
    s = F.col("s")
    bucket = F.when(s < -3, "<-3").when(s < 0, "-3..0").when(s < 2, "0..2").when(s < 5, "2..5").when(s < 12, "5..12").otherwise(">=12")
    return f.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.min("s"), 6).alias("low"), F.round(F.median("s"), 6).alias("middle"), F.round(F.max("s"), 6).alias("high"))


@query("join_anchor_pairs", _SWINGS + ", t AS (SELECT * FROM sw WHERE prominence_pct >= 15) SELECT a.symbol, a.idx AS first_idx, b.idx AS last_idx, round((b.price - a.price) / (b.idx - a.idx), 6) AS slope FROM t a JOIN t b ON a.symbol = b.symbol AND b.idx - a.idx >= 24")
def _(spark, d):
    t = peaks.swings(_clean(spark, d)).filter("prominence_pct >= 15")
    a, b = t.alias("a"), t.alias("b")
    pairs = a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("b.idx") - F.col("a.idx") >= 24))
    return pairs.select("a.symbol", F.col("a.idx").alias("first_idx"), F.col("b.idx").alias("last_idx"), F.round((F.col("b.price") - F.col("a.price")) / (F.col("b.idx") - F.col("a.idx")), 6).alias("slope"))


@query("flagship_proximity", f"WITH {DILATED_SQL}{_QUARTERS} SELECT symbol, round(arg_max(close, q_idx) / max(high) * 100, 6) AS proximity_pct, count(*) AS quarters FROM qq GROUP BY symbol")
def flagship(spark, d):
    q = B.quarterly(_clean(spark, d))
    return q.groupBy("symbol").agg(F.round(F.max_by("close", "q_idx") / F.max("high") * 100, 6).alias("proximity_pct"), F.count("*").alias("quarters"))


