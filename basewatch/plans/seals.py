"""Registered queries over sealed snapshots and the log of reviews, with the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from basewatch.functions import canonical
from basewatch.operators import reviews, sealed
from basewatch.plans.events import _LOG, _log
from basewatch.plans.registry import registry
from basewatch.sources import review_log
from basewatch.sources.tables import MONTHLY_SQL, folder, monthly_bars, table, written

query, QUERIES, SQL = registry()

_WHO = ("frozen-bars", "ledger", "https://data.example")


def _snapshots(spark, d):
    """One snapshot of each symbol's months, of which some are damaged, by the symbol's last letter."""
    number = lambda c: canonical.number(F.col(c))
    tokens = {"date": F.date_format("bar_date", "yyyy-MM-dd"), **{c: number(c) for c in ("open", "high", "low", "close")}, "volume": F.col("volume").cast("long").cast("string"), "adjusted_close": F.lit(None).cast("string")}
    row = F.create_map(*[x for k, v in tokens.items() for x in (F.lit(k), v)])
    g = monthly_bars(spark, d).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(F.col("bar_date").alias("at"), F.to_json(row, {"ignoreNullFields": "false"}).alias("row")))).alias("all"))
    requests = g.select(
        "symbol", F.date_format(F.get("all", F.lit(0))["at"], "yyyy-MM-dd").alias("start"), F.date_format(F.element_at("all", -1)["at"], "yyyy-MM-dd").alias("end"), F.lit("1999-01-01T00:00:00Z").alias("fetched_at"),
        F.substring(F.sha2("symbol", 256), 1, 40).alias("code_sha"), F.transform("all", lambda x: F.from_json(x["row"], "map<string,string>")).alias("rows"),
    )
    # letters, digits, dots and dashes are all that a symbol may have
    s = written(sealed.sealed(requests.withColumn("symbol", F.regexp_replace("symbol", "[ _]", "-")), *_WHO), "seals")
    kind, text = F.ascii(F.right("symbol", F.lit(1))) % 5, F.col("snapshot")
    short = F.regexp_replace(text, '"code_sha":"[0-9a-f]', '"code_sha":"')
    changed = F.when(kind == 1, F.regexp_replace(text, '"fetched_at":"1999', '"fetched_at":"1998')).when(kind == 2, short).when(kind == 3, F.regexp_replace(text, r"^\{", '{"note":1,')).when(kind == 4, F.regexp_replace(text, '"volume":([0-9]+)}', '"volume":$1.0}')).otherwise(text)
    return s.select(changed.alias("snapshot"))


@query("src_snapshot_sealed", "WITH " + MONTHLY_SQL + """, j AS (SELECT translate(symbol, ' _', '--') AS symbol, symbol AS given, bar_date,
  '"close":' || close || ',"date":"' || strftime(bar_date, '%Y-%m-%d') || '","high":' || high || ',"low":' || low || ',"open":' || open || ',"volume":' AS said, volume::DOUBLE::VARCHAR AS float, volume::BIGINT::VARCHAR AS int FROM bars),
 g AS (SELECT symbol, ascii(right(symbol, 1)) % 5 AS kind, substr(sha256(given), 1, 40) AS code, min(bar_date) AS a, max(bar_date) AS z, count(*) AS n,
  '[' || string_agg('{"adjusted_close":null,' || said || CASE WHEN ascii(right(symbol, 1)) % 5 = 4 THEN float ELSE int END || '}', ',' ORDER BY bar_date) || ']' AS rows, '[' || string_agg('{' || said || float || '}', ',' ORDER BY bar_date) || ']' AS made FROM j GROUP BY ALL),
 h AS (SELECT *, sha256(rows) AS rows_sha, sha256(made) AS made_sha FROM g)
 SELECT symbol, CASE kind WHEN 1 THEN 'snapshot_hash' WHEN 2 THEN 'code_sha' WHEN 3 THEN 'unknown_key' WHEN 4 THEN 'rows_hash' END AS fault, CASE WHEN kind = 0 THEN n END AS n_bars, rows_sha AS provider_rows_sha256, made_sha AS monthly_bars_sha256,
  sha256('{"code_sha":"' || CASE WHEN kind = 2 THEN code[2:] ELSE code END || '","fetched_at":"' || CASE WHEN kind = 1 THEN '1998' ELSE '1999' END || '-01-01T00:00:00Z","kind":"frozen-bars","monthly_bars":' || made || ',"monthly_bars_sha256":"' || made_sha || '","provider":"ledger","provider_rows":' || rows
   || ',"provider_rows_sha256":"' || rows_sha || '","provider_semantics":{"adjusted_close_used":false,"ohlc_adjustment":"raw_unadjusted","volume_adjustment":"provider_split_adjusted"},"request":{"endpoint":"https://data.example/eod/' || symbol || '","params":{"fmt":"json","from":"' || strftime(a, '%Y-%m-%d')
   || '","order":"a","period":"m","to":"' || strftime(z, '%Y-%m-%d') || '"}},"schema_version":1,"symbol":"' || symbol || '"}') AS snapshot_sha256 FROM h""")
def _(spark, d):
    c = sealed.checked(_snapshots(spark, d), *_WHO)
    return c.select("symbol", "fault", F.size("bars").cast("long").alias("n_bars"), "provider_rows_sha256", "monthly_bars_sha256", "snapshot_sha256")


@query("sink_review_log", f"WITH {_LOG} SELECT row_number() OVER (ORDER BY decision = 'capture', ts, id) AS id, id AS event, ticker, decision, price FROM lg")
def _(spark, d):
    log, path = _log(spark, d).withColumnRenamed("id", "event"), folder(spark, "review-log")
    decided = log.filter("decision != 'capture'")
    # the second delivery of a batch changes nothing
    for name, batch in (("decisions", decided), ("decisions", decided), ("captures", log.filter("decision = 'capture'"))):
        review_log.append(batch, path, ["ts", "event"], name)
    return review_log.read(spark, path).select("id", "event", "ticker", "decision", "price")


@query("rev_append_legacy", """WITH p AS (SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type = 'error' THEN -value ELSE value END AS price, CASE WHEN event_type = 'view' THEN 'breakout_peak' WHEN event_type = 'click' THEN 'structural_retest' ELSE 'major_top' END AS role FROM events),
 g AS (SELECT user_id, min(day) || 'T00:00:00Z' AS since, bool_or(NOT coalesce(price > 0, false)) AS bad, count(*) FILTER (role != 'breakout_peak') AS anchors, count(*) AS points, '[' || string_agg('{"date":"' || day || '","price":' || coalesce(price::VARCHAR, 'null') || ',"role":"' || role || '"}', ',' ORDER BY event_id) || ']' AS said FROM p GROUP BY 1),
 f AS (SELECT *, CASE WHEN bad THEN 'price' WHEN anchors < 2 THEN 'too_few_anchors' END AS fault FROM g)
 SELECT 'U' || user_id AS ticker, '3M' AS "interval", since AS created_at, CASE WHEN fault IS NULL THEN 'corrected' END AS decision, points, fault, 'legacy-sha256:' || sha256('{"created_at":"' || since || '","interval":"3M","points":' || said || ',"ticker":"U' || user_id || '"}') AS event_id FROM f""")
def _(spark, d):
    kind = F.col("event_type")
    point = F.struct("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(kind == "error", -F.col("value")).otherwise(F.col("value")).alias("price"), F.when(kind == "view", "breakout_peak").when(kind == "click", "structural_retest").alias("role"))
    g = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    day = F.array_min(F.transform("points", lambda p: p["date"]))
    corrections = g.select(F.concat(F.lit(" u"), "user_id").alias("ticker"), F.lit(None).cast("string").alias("interval"), F.concat(day, F.lit("T00:00:00Z")).alias("created_at"), "points")
    return reviews.legacy_decisions(corrections).withColumn("points", F.size("points").cast("long"))
