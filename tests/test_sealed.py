"""Sealed snapshots against Python's own JSON and hashes, with each kind of damage."""

import copy
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from basewatch.operators import sealed as S

WHO = ("frozen-bars", "somebody", "https://data.example")


def sha(x):
    return hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def seal(snapshot):
    bars = [{"date": r["date"], **{c: float(r[c]) for c in S.FIELDS}} for r in snapshot["provider_rows"]]
    s = {**snapshot, "provider_rows_sha256": sha(snapshot["provider_rows"]), "monthly_bars": bars, "monthly_bars_sha256": sha(bars)}
    return {**s, "snapshot_sha256": sha(s)}


def example():
    rows = [{"date": f"2020-{m:02}-01", "open": 10, "high": 12.5, "low": 9.0, "close": 11.100000381469727, "adjusted_close": 1e-5, "volume": 10**m} for m in range(1, 10)]
    params = {"fmt": "json", "period": "m", "order": "a", "from": "2020-01-01", "to": "2020-12-31"}
    semantics = {"ohlc_adjustment": "raw_unadjusted", "adjusted_close_used": False, "volume_adjustment": "provider_split_adjusted"}
    return {"schema_version": 1, "kind": WHO[0], "provider": WHO[1], "symbol": "ABC.US", "fetched_at": "2026-01-01T00:00:00Z", "code_sha": "a" * 40, "request": {"endpoint": WHO[2] + "/eod/ABC.US", "params": params}, "provider_semantics": semantics, "provider_rows": rows}


def damaged():
    """Name of the fault -> snapshot; those whose hashes are made anew have only the fault itself."""

    def with_(path, value, again=True):
        s = copy.deepcopy(example()) if again else seal(example())
        at = s
        for k in path[:-1]:
            at = at[k]
        if value is None:
            del at[path[-1]]
        else:
            at[path[-1]] = value
        return seal(s) if again else s

    yield "schema_version", with_(["schema_version"], 2)
    yield "identity", with_(["provider"], "else")
    yield "token_kept", with_(["request", "params", "api_token"], "secret")
    yield "params", with_(["request", "params", "more"], "x")
    yield "params", with_(["request", "params", "to"], None)
    yield "format", with_(["request", "params", "period"], "d")
    yield "order", with_(["request", "params", "order"], "d")
    yield "symbol", with_(["symbol"], "a b")
    yield "endpoint", with_(["request", "endpoint"], WHO[2] + "/eod/XYZ.US")
    yield "semantics", with_(["provider_semantics", "adjusted_close_used"], True)
    yield "range", with_(["request", "params", "from"], "2021-01-01")
    yield "fetched_at", with_(["fetched_at"], "yesterday")
    yield "code_sha", with_(["code_sha"], "abc")
    yield "rows_hash", with_(["provider_rows", 3, "close"], 11.2, again=False)
    yield "rows_hash", with_(["provider_rows", 3, "open"], 10.0, again=False)  # 10 and 10.0 are different texts
    yield "no_rows", with_(["provider_rows"], [])
    yield "bad_date", with_(["provider_rows", 2, "date"], "2020-3-1")
    yield "outside_range", with_(["provider_rows", 8, "date"], "2021-09-01")
    yield "not_ascending", with_(["provider_rows", 4, "date"], "2020-04-01")
    yield "month_twice", with_(["provider_rows", 4, "date"], "2020-04-30")
    yield "bad_open", with_(["provider_rows", 0, "open"], -10)
    yield "containment", with_(["provider_rows", 5, "high"], 10.5)
    yield "bad_volume", with_(["provider_rows", 8, "volume"], -1)
    yield "bars", with_(["monthly_bars", 1, "high"], 12.6, again=False)
    yield "bars_hash", with_(["monthly_bars_sha256"], "0" * 64, again=False)
    yield "snapshot_hash", with_(["snapshot_sha256"], "0" * 64, again=False)
    yield "snapshot_hash", with_(["fetched_at"], "2026-01-02T00:00:00Z", again=False)
    yield "unknown_key", with_(["extra"], 1)


def test_each_damage_is_named(spark):
    good = seal(example())
    shuffled = json.dumps(dict(reversed(good.items())), indent=2)  # order and blanks are not the content
    cases = [(None, json.dumps(good)), (None, shuffled), ("unreadable", "{"), ("unreadable", None), ("unreadable", ""), *[(name, json.dumps(s)) for name, s in damaged()]]
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], "i int, snapshot string")
    got = {r.i: r for r in S.checked(df, *WHO).collect()}
    assert [got[i].fault for i in range(len(cases))] == [name for name, _ in cases]
    for i in (0, 1):
        assert (got[i].provider_rows_sha256, got[i].monthly_bars_sha256, got[i].snapshot_sha256) == (good["provider_rows_sha256"], good["monthly_bars_sha256"], good["snapshot_sha256"])
        assert [b.asDict() for b in got[i].bars] == good["monthly_bars"]
    assert S.checked(df.limit(0), *WHO).count() == 0


def test_sealing_gives_the_same_text(spark, tmp_path):
    want = seal(example())
    rows = [{k: v if k == "date" else json.dumps(v) for k, v in r.items()} for r in want["provider_rows"]]
    df = spark.createDataFrame([("ABC.US", "2020-01-01", "2020-12-31", want["fetched_at"], want["code_sha"], rows)], "symbol string, start string, end string, fetched_at string, code_sha string, rows array<map<string,string>>")
    made = S.sealed(df, *WHO)
    assert made.first().snapshot == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    path = str(tmp_path / "sealed")
    S.write_sealed(made, path, *WHO)
    back = S.read_sealed(spark, path + "/*/*", *WHO).collect()
    assert [(r.symbol, r.fault, len(r.bars)) for r in back] == [("ABC.US", None, 9)]
    with pytest.raises(Exception, match="already exists"):
        S.write_sealed(made, path, *WHO)
    with pytest.raises(Exception, match="snapshot of ABC.US: code_sha"):
        S.write_sealed(made.withColumn("snapshot", F.replace("snapshot", F.lit("a" * 40), F.lit("b"))), str(tmp_path / "other"), *WHO)
