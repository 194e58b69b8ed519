"""Sealed snapshots: what a provider sent, the bars made from it, and hashes of both and of the whole.

A snapshot is one JSON text. Sealing builds it from rows; checking derives everything in it again
from the provider's rows alone and compares, all as expressions, one row for each snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewatch.functions import canonical as C
from basewatch.operators.contracts import PRICES, first_fault, iso_day

#: What bars are and aren't adjusted for. Fixed values.
SEMANTICS = {"ohlc_adjustment": "raw_unadjusted", "adjusted_close_used": "false", "volume_adjustment": "provider_split_adjusted"}
FIELDS = (*PRICES, "volume")
_BARS = T.ArrayType(T.StructType([T.StructField("date", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in FIELDS]]))
_TEXTS = "map<string, string>"
#: Numbers are read as they stand, so that 100 and 100.0 stay apart.
_TYPES = dict.fromkeys(("schema_version", "kind", "provider", "symbol", "fetched_at", "code_sha", "provider_rows_sha256", "monthly_bars_sha256", "snapshot_sha256"), "string")
_TYPES |= {"request": f"struct<endpoint: string, params: {_TEXTS}>", "provider_semantics": _TEXTS, "provider_rows": f"array<{_TEXTS}>", "monthly_bars": f"array<{_TEXTS}>"}
_SHAPE = ", ".join(f"{k} {v}" for k, v in _TYPES.items())


def _object(parts: dict[str, Column]) -> Column:
    """An object of members that are JSON already."""
    return F.concat(F.lit("{"), *[x for i, k in enumerate(sorted(parts)) for x in (F.lit(("," if i else "") + f'"{k}":'), parts[k])], F.lit("}"))


def _list(parts: Column) -> Column:
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")))


def _row(row: Column) -> Column:
    """A flat row of JSON tokens: the date is a text, all else numbers or null. Null if a token is neither."""
    entries = F.array_sort(F.map_entries(row), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    told = lambda e: F.when(e["value"].isNull(), "null").when(e["key"] == "date", C.text(e["value"])).otherwise(C.raw_number(e["value"]))
    parts = F.transform(entries, lambda e: F.concat(C.text(e["key"]), F.lit(":"), told(e)))
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def rows_json(rows: Column) -> Column:
    """A provider's rows, as arrays of maps of tokens, as canonical JSON."""
    return _list(F.transform(rows, _row))


def bars_of(rows: Column) -> Column:
    """The bars that rows give: date and five doubles, nothing else."""
    field = lambda r, c: F.try_element_at(r, F.lit(c))
    return F.transform(rows, lambda r: F.struct(field(r, "date").alias("date"), *[field(r, c).try_cast("double").alias(c) for c in FIELDS]))


def bars_json(bars: Column) -> Column:
    return C.canonical(bars, _BARS)


def _whole(c: dict[str, Column], rows: Column, bars: Column) -> dict[str, Column]:
    """All members but the last hash, as JSON, from columns and from the JSON of rows and bars."""
    params = _object({k: C.text(v) for k, v in {"fmt": F.lit("json"), "period": F.lit("m"), "order": F.lit("a"), "from": c["start"], "to": c["end"]}.items()})
    semantics = _object({k: F.lit(v) if v == "false" else C.text(F.lit(v)) for k, v in SEMANTICS.items()})
    named = {k: C.text(c[k]) for k in ("kind", "provider", "symbol", "fetched_at", "code_sha")}
    return named | {
        "schema_version": F.lit("1"), "request": _object({"endpoint": C.text(c["endpoint"]), "params": params}), "provider_semantics": semantics,
        "provider_rows": rows, "provider_rows_sha256": C.text(C.digest(rows)), "monthly_bars": bars, "monthly_bars_sha256": C.text(C.digest(bars)),
    }


def sealed(requests: DataFrame, kind: str, provider: str, base_url: str) -> DataFrame:
    """requests(symbol, start, end, fetched_at, code_sha, rows: array of maps of JSON tokens) -> symbol, snapshot (JSON text).

    A snapshot whose rows have a number that JSON can't hold is null."""
    given = {k: F.col(k) for k in ("symbol", "start", "end", "fetched_at", "code_sha")}
    given |= {"kind": F.lit(kind), "provider": F.lit(provider), "endpoint": F.concat(F.lit(f"{base_url}/eod/"), F.col("symbol"))}
    r = requests.withColumns({"_rows": rows_json(F.col("rows")), "_bars": bars_json(bars_of(F.col("rows")))})
    members = _whole(given, F.col("_rows"), F.col("_bars"))
    return r.select("symbol", _object(members | {"snapshot_sha256": C.text(C.digest(_object(members)))}).alias("snapshot"))


def _row_faults(rows: Column, start: Column, end: Column) -> dict[str, Column]:
    """Tests over a snapshot's rows, as arrays; a missing number counts as bad."""
    field = lambda r, c: F.try_element_at(r, F.lit(c))
    n = lambda r, c: field(r, c).try_cast("double")
    good = lambda r, c: F.coalesce(~F.isnan(n(r, c)) & (F.abs(n(r, c)) < float("inf")), F.lit(False))
    day = lambda r: iso_day(field(r, "date"))
    follows = lambda test: F.exists(F.sequence(F.lit(1), F.greatest(F.size(rows) - 1, F.lit(1))), lambda i: F.coalesce(test(day(F.get(rows, i - 1)), day(F.get(rows, i))), F.lit(False)))
    bad = lambda c: F.exists(rows, lambda r: ~good(r, c) | (n(r, c) <= 0))
    low, high = lambda r: F.least(*[n(r, c) for c in PRICES]), lambda r: F.greatest(*[n(r, c) for c in PRICES])
    return {
        "no_rows": F.size(rows) == 0,
        "bad_date": F.exists(rows, lambda r: day(r).isNull()),
        "outside_range": F.exists(rows, lambda r: ~day(r).between(start, end)),
        "not_ascending": follows(lambda a, b: b <= a),
        "month_twice": follows(lambda a, b: F.trunc(a, "MM") == F.trunc(b, "MM")),
        **{f"bad_{c}": bad(c) for c in PRICES},
        "containment": F.exists(rows, lambda r: (n(r, "high") < high(r)) | (n(r, "low") > low(r))),
        "bad_volume": F.exists(rows, lambda r: ~good(r, "volume") | (n(r, "volume") < 0)),
    }


def checked(snapshots: DataFrame, kind: str, provider: str, base_url: str) -> DataFrame:
    """snapshots(snapshot: JSON text, whatever else) -> the same with symbol, bars (array), the three hashes derived again, and `fault`.

    fault is the first demand that the snapshot fails, null if none. Keys that a snapshot doesn't
    have are a fault, so that nothing in it is outside its hash. A null or unreadable text, or one
    with two values for a key, is `unreadable`."""
    s = snapshots.withColumn("_s", F.from_json("snapshot", _SHAPE, {"mode": "PERMISSIVE"})).withColumn("_keys", F.json_object_keys("snapshot"))
    s = s.withColumns({f"_{k}": F.col(f"_s.{k}") for k in ("provider_rows", "monthly_bars", "symbol")})
    s = s.withColumns({"_start": iso_day(F.col("_s.request.params")["from"]), "_end": iso_day(F.col("_s.request.params")["to"])})
    s = s.withColumns({"_rows": rows_json(F.col("_provider_rows")), "_made": bars_of(F.col("_provider_rows"))})
    s = s.withColumns({"_bars": bars_json(F.col("_made")), "_told": rows_json(F.col("_monthly_bars"))})
    c = {k: F.col(f"_s.{k}") for k in ("kind", "provider", "symbol", "fetched_at", "code_sha")} | {"start": F.col("_s.request.params")["from"], "end": F.col("_s.request.params")["to"], "endpoint": F.col("_s.request.endpoint")}
    s = s.withColumns({"provider_rows_sha256": C.digest(F.col("_rows")), "monthly_bars_sha256": C.digest(F.col("_bars")), "snapshot_sha256": C.digest(_object(_whole(c, F.col("_rows"), F.col("_bars"))))})
    p, same = F.col("_s.request.params"), lambda a, b: a.eqNullSafe(b)
    differs = lambda k: ~same(F.col(f"_s.{k}"), F.col(k))
    tests = {
        "unreadable": F.col("_keys").isNull() | (F.size(F.array_distinct("_keys")) != F.size("_keys")),
        "schema_version": ~same(F.col("_s.schema_version"), F.lit("1")),
        "identity": ~same(F.col("_s.kind"), F.lit(kind)) | ~same(F.col("_s.provider"), F.lit(provider)),
        "no_request": p.isNull(),
        "token_kept": F.map_contains_key(p, "api_token"),
        "params": F.array_sort(F.map_keys(p)) != F.array(*[F.lit(k) for k in sorted(("fmt", "period", "order", "from", "to"))]),
        "format": ~same(p["fmt"], F.lit("json")) | ~same(p["period"], F.lit("m")),
        "order": ~same(p["order"], F.lit("a")),
        "symbol": ~F.coalesce(F.col("_s.symbol").rlike(r"^[A-Z0-9][A-Z0-9.\-]*$"), F.lit(False)),
        "endpoint": ~same(F.col("_s.request.endpoint"), F.concat(F.lit(f"{base_url}/eod/"), F.col("_s.symbol"))),
        "semantics": ~same(F.to_json(F.array_sort(F.map_entries("_s.provider_semantics"))), F.to_json(F.array_sort(F.map_entries(F.create_map(*[F.lit(x) for kv in SEMANTICS.items() for x in kv]))))),
        "range": F.col("_start").isNull() | F.col("_end").isNull() | (F.col("_start") > F.col("_end")),
        "fetched_at": ~F.coalesce(F.col("_s.fetched_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|\+00:00)$"), F.lit(False)),
        "code_sha": ~F.coalesce(F.col("_s.code_sha").rlike("^[0-9a-f]{40}$"), F.lit(False)),
        "rows_missing": F.col("_provider_rows").isNull(),
        "rows_not_json": F.col("_rows").isNull(),
        "rows_hash": differs("provider_rows_sha256"),
        **_row_faults(F.col("_provider_rows"), F.col("_start"), F.col("_end")),
        "bars": ~same(F.col("_told"), F.col("_bars")),
        "bars_hash": differs("monthly_bars_sha256"),
        "unknown_key": F.size(F.array_except("_keys", F.array(*[F.lit(k) for k in _TYPES]))) > 0,
        "snapshot_hash": differs("snapshot_sha256"),
    }
    s = s.withColumns({"symbol": F.col("_symbol"), "fault": first_fault(tests)})
    return s.withColumn("bars", F.when(F.col("fault").isNull(), F.col("_made"))).drop("_s", "_keys", "_symbol", "_provider_rows", "_monthly_bars", "_start", "_end", "_rows", "_made", "_bars", "_told")


def read_sealed(spark, path: str, kind: str, provider: str, base_url: str) -> DataFrame:
    """Snapshot files under path, one JSON text each, checked: file, symbol, bars, hashes, fault. Faulty ones stay, without bars."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("snapshot"))
    return checked(files, kind, provider, base_url).drop("snapshot")


def write_sealed(snapshots: DataFrame, path: str, kind: str, provider: str, base_url: str) -> None:
    """Writes snapshots(symbol, snapshot) by symbol, each as a line of its own; a faulty one fails the job, and an existing folder isn't replaced."""
    fine = checked(snapshots.select("snapshot"), kind, provider, base_url)
    sound = F.when(F.col("fault").isNull(), F.col("snapshot")).otherwise(F.raise_error(F.concat(F.lit("snapshot of "), F.coalesce("symbol", F.lit("?")), F.lit(": "), F.col("fault"))))
    fine.select("symbol", sound.alias("value")).write.partitionBy("symbol").mode("errorifexists").text(path)
