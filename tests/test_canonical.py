"""Canonical JSON against Python's json module, at every depth."""

import hashlib
import json
import random
import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewatch.functions import canonical as C


def plain(x, ascii_only=False):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)


def test_numbers(spark):
    r = random.Random(5)
    bits = [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(20000)]
    short = [round(r.uniform(-1e4, 1e4), r.randrange(6)) * 10.0 ** r.randrange(-9, 20) for _ in range(20000)]
    single = [struct.unpack("<f", struct.pack("<f", r.uniform(0.01, 5000)))[0] for _ in range(20000)]
    odd = [0.0, -0.0, 1.0, -1.5, 1e16, 1e15, 9999999999999998.0, 123456789012345680.0, 1e-4, 1e-5, 0.1 + 0.2, 5e-324, 1.7976931348623157e308, 2.0**-44, 2e23, 1e23, 1e22, 100.0, 0.001]
    values = [x for x in bits + short + single + odd if x == x and abs(x) != float("inf")]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    wrong = [(x, got) for x, got in df.select("x", C.number(F.col("x"))).collect() if got != repr(x)]
    assert not wrong, (len(wrong), wrong[:5])
    assert [r[0] for r in spark.createDataFrame([(float("nan"),), (float("inf"),)], "x double").select(C.number(F.col("x"))).collect()] == [None, None]


def test_texts(spark):
    odd = ["", 'a"b\\c', "".join(map(chr, range(33))), "é 漢字 🎉  \x7f\x80", "\\u000b", None, "plain"]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    for ascii_only in (False, True):
        assert [r[0] for r in df.select(C.canonical(F.col("x"), T.StringType(), ascii_only)).collect()] == [plain(x, ascii_only) for x in odd]


def test_nested_rows(spark):
    kind = "struct<zeta: array<struct<b: double, a: string, n: long>>, alpha: map<string, array<boolean>>, Upper: date, e: array<double>>"
    rows = [
        ({"zeta": [{"b": 1.0, "a": "x", "n": 3}, {"b": None, "a": None, "n": None}, None], "alpha": {"k": [True, None], "B": [], "é": None}, "Upper": None, "e": []},),
        ({"zeta": None, "alpha": {}, "Upper": None, "e": [1e-7, 3.3519999980926514]},),
        (None,),
    ]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("v", T._parse_datatype_string(kind))]))
    got = df.select(C.canonical(F.col("v"), df.schema["v"].dataType).alias("c")).select("c", C.digest(F.col("c"))).collect()
    for (want,), (text, sha) in zip(rows, got, strict=True):
        assert text == plain(want) and sha == hashlib.sha256(plain(want).encode()).hexdigest()
    bad = spark.createDataFrame([([1.0, float("nan")],)], "v array<double>")
    assert bad.select(C.canonical(F.col("v"), bad.schema["v"].dataType)).first()[0] is None
