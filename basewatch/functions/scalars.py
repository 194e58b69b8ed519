"""Column expressions that several operators use."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from basewatch.params import DEFAULT, Params


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def grade_for_slope(slope: Column, p: Params = DEFAULT) -> Column:
    flat = slope.between(*p.grade_a) & (slope < p.grade_a[1])
    return F.when(slope.isNull() | (slope < p.grade_floor), None).when(flat, "A").when(slope < p.grade_b, "B").when(slope < p.grade_c, "C")


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper Wilson bound, rounded to 6 digits; null without trials."""
    n = F.nullif(trials, F.lit(0)).cast("double")
    p = successes / n
    centre, wide = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.round(F.greatest(F.lit(0.0), centre - wide), 6), F.round(F.least(F.lit(1.0), centre + wide), 6)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where nothing was found right, null where there was nothing to find."""
    return F.when(2 * tp + fp + fn > 0, F.round(2.0 * tp / (2 * tp + fp + fn), 6))


def canonical_hash(ascii_only: bool = False):
    """SHA-256 of canonical JSON (sorted keys, no spaces) of a JSON text: key order and number format aren't what to_json keeps."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.sha256(json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False).encode()).hexdigest())

    return run
