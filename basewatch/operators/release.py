"""Checks of a released review session: order, counts, hashes, unique samples, and no model field at any depth of what reviewers see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewatch.sources.tables import written

#: Fields that a reviewer may not see before the assessment is locked.
FORBIDDEN = (
    "algorithm_analysis", "analysis", "coil_score", "corpus_labels", "grade", "lid_grade", "lid_line", "lid_slope_pct_per_year", "lifecycle", "major_highs", "model_grade", "model_snapshot", "model_status",
    "quarterly_bars", "reviewed_highs", "score_total", "screen_snapshot", "source_features",
)


def snake_case(key: Column) -> Column:
    return F.lower(F.replace(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1_$2"), F.lit("-"), F.lit("_")))


def key_paths(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Every key of a JSON column at every depth: id, path, key, depth. What isn't JSON, and null, has none.

    Values are VARIANTs and are opened level by level, each level's children written before the next:
    as many passes as the deepest value has levels, each over what is left to open."""
    spark = rows.sparkSession
    left = rows.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.try_parse_json(json_col).alias("value"))
    none = spark.range(0).select(F.lit(None).cast(rows.schema[id_col].dataType).alias("id"), F.lit("").alias("path"), F.lit("").alias("key"), F.lit(0).alias("depth"))
    out, depth = [none], 0
    while True:
        depth += 1
        inside = left.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select("pos", "key", F.col("value").alias("child")))
        path = F.when(F.col("key").isNotNull(), F.concat("path", F.lit("."), "key")).otherwise(F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = written(inside.select("id", path.alias("path"), "key", F.col("child").alias("value")), "json-level")
        out.append(level.filter("key IS NOT NULL").select("id", "path", "key", F.lit(depth).alias("depth")))
        kind = F.schema_of_variant("value")
        left = level.filter(kind.startswith("OBJECT") | kind.startswith("ARRAY")).select("id", "path", "value")
        if left.limit(1).count() == 0:
            break
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def leaks(rows: DataFrame, id_col: str, json_col: str, forbidden: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """The paths of forbidden keys, whatever their case and depth: id, path."""
    return key_paths(rows, id_col, json_col).filter(snake_case(F.col("key")).isin(*forbidden)).select("id", "path")


def release_faults(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """items(session, position, ticker, reviewable, bars_hash, sample_id, payload) and manifest(session, position, ticker, reviewable) -> session, n_items, n_reviewable, faults (comma-joined, null if none).

    Faults: count, order, reviewability, bars_hash (no SHA-256), sample_id (missing on a reviewable item, or used twice), leak."""
    so = lambda test: F.coalesce(test, F.lit(False))
    m = manifest.select("session", "position", F.col("ticker").alias("m_ticker"), F.col("reviewable").alias("m_reviewable"), F.lit(True).alias("m"))
    keyed = items.withColumn("item", F.struct("session", "position"))
    key = F.to_json("item")
    leaking = leaks(keyed.withColumn("item", key), "item", "payload").select(F.col("id").alias("item")).distinct().withColumn("leak", F.lit(True))
    uses = F.count("sample_id").over(Window.partitionBy("session", "sample_id"))
    x = keyed.withColumn("item", key).join(leaking, "item", "left").withColumn("uses", uses).withColumn("i", F.lit(True)).join(m, ["session", "position"], "full_outer")
    here, there = F.col("i").isNotNull(), F.col("m").isNotNull()
    n = lambda test: F.count_if(so(test))
    g = x.groupBy("session").agg(
        n(here).alias("n_items"), n(here & F.col("reviewable")).alias("n_reviewable"), n(here != there).alias("count"), n(here & there & ~F.col("ticker").eqNullSafe(F.col("m_ticker"))).alias("order"),
        n(here & there & ~F.col("reviewable").eqNullSafe(F.col("m_reviewable"))).alias("reviewability"), n(here & ~so(F.col("bars_hash").rlike("^[0-9a-f]{64}$"))).alias("bars_hash"),
        n(here & ((F.col("uses") > 1) | (so(F.col("reviewable")) & F.col("sample_id").isNull()))).alias("sample_id"), n(F.col("leak")).alias("leak"),
    )
    names = ("count", "order", "reviewability", "bars_hash", "sample_id", "leak")
    listed = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in names])), ",")
    return g.select("session", "n_items", "n_reviewable", F.nullif(listed, F.lit("")).alias("faults"))
