"""Mixing sources to target weights.

Tokens are added up for each source, each source gets a target, and the ratio of the two is the
source's repetition rate. Each document then comes out floor(rate) times, and once more if a
number hashed from its id lies under the fraction: a Bernoulli copy that is the same on every run.
The hashed number is turned by a source's offset, modulo one: of `TURNS` even offsets the one whose
copies come nearest to the target, found by one aggregate over all documents. Each turn keeps the
probability, and a source of few documents comes near its target as well.

A source's rate is one row; the join is on the source, and where Spark doesn't broadcast the
rates (they are as many as the sources) it can split a hot source's partition, since the other
side has one row for it. Nothing is gathered for a source but its sum, added up before the shuffle.

Defined cases: a very long text counts whole; other columns, whatever their names, are carried or
left alone; a null source is a source of its own, sorted last; null text has size 0 and comes
out as often as its source's rate says; rows with the same id share their copy decision; an empty
table gives an empty mix; a source without words has target 0 and rate 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basewatch.llm.common import cut, hash_unit, packed, unpacked, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP, SEED, TURNS = 1.5, 2.0, "mix-1", 32


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target.

    Targets are share of all sizes, dealt by weight, none above cap times its source's size. The
    excess goes to the others by weight, again and again: that ends at min(cap * size, level *
    weight) for the one level that fits, found from running sums over sources by cap * size /
    weight. The windows run over one row for each source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("top"))
    by_level = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    before, after, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(whole)
    s = s.withColumn("level", (budget - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(after))
    fits = F.when(F.col("level") <= F.col("top") / F.col("w"), F.col("level"))
    s = s.withColumn("level", F.coalesce(F.first(fits, ignorenulls=True).over(whole), F.lit(float("inf"))))
    return s.select("source", "source_size", F.least("top", F.round(F.col("level") * F.col("w"), 6)).alias("target"))


def copies(unit: Column, rate: Column, turn: Column) -> Column:
    """Copies of a document whose hashed number is unit, with its source's rate and turn."""
    whole, at = F.floor(rate), unit + turn / TURNS
    return (whole + (at - F.floor(at) < rate - whole).cast("long")).cast("long")


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))


def _rates(sized: DataFrame, **targets) -> DataFrame:
    """sized(source, size, unit), written -> rate_source, source_size, target, rate, turn: a row for each source."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = source_targets(source_sizes(sized), **targets).select(F.col("source").alias("rate_source"), "source_size", "target", rate.alias("rate"))
    rates = cut(rates, "rates")
    rows = sized.join(rates.select("rate_source", "rate"), F.col("source").eqNullSafe(F.col("rate_source")))
    taken = rows.groupBy("source").agg(*[F.sum(F.col("size") * copies(F.col("unit"), F.col("rate"), F.lit(k))).alias(f"t{k}") for k in range(TURNS)])
    off = [F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(TURNS)]
    best = rates.join(taken, F.col("source").eqNullSafe(F.col("rate_source")))
    return cut(best.select("rate_source", "source_size", "target", "rate", F.least(*off)["k"].alias("turn")), "rates")


def mix_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed=SEED, **targets) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, rate, n_copies, taken."""
    # the sizes are read twice, so they are written once: three narrow columns instead of the texts
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hash_unit(seed, F.col(id_col)).alias("unit")), "sizes")
    rates = _rates(sized, **targets)
    out = sized.join(rates, F.col("source").eqNullSafe(F.col("rate_source")), "inner").drop("rate_source")
    out = out.withColumn("n_copies", copies(F.col("unit"), F.col("rate"), F.col("turn"))).drop("unit", "turn")
    return out.withColumn("taken", F.col("size") * F.col("n_copies"))


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed=SEED, **targets) -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as often as the mix takes it."""
    sized = cut(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hash_unit(seed, F.col(id_col)).alias("unit")), "sizes")
    rates = _rates(sized, **targets)
    rows = packed(docs, _unit=hash_unit(seed, F.col(id_col)), _source=F.col(source_col))
    out = rows.join(rates, F.col("_source").eqNullSafe(F.col("rate_source")), "inner")
    out = out.withColumn("_n", copies(F.col("_unit"), F.col("rate"), F.col("turn"))).filter("_n > 0")
    return unpacked(out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_nth")))


#: DuckDB. word_count there: regexp_extract_all of the same class.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, (2.0 * source_size)::DOUBLE AS top FROM per),
lev AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
best AS (SELECT arg_min(lev, top / w) AS lev FROM lev WHERE lev <= top / w),
t AS (SELECT source, source_size, least(top, round((SELECT lev FROM best) * w, 6))::DOUBLE AS target FROM lev),
r AS (SELECT s.doc_id, s.size, t.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
      ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(16**13)!r} AS unit FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
turned AS (SELECT r.*, k, floor(rate)::BIGINT + (unit + k / {TURNS} - floor(unit + k / {TURNS}) < rate - floor(rate))::BIGINT AS n_copies FROM r, range({TURNS}) AS x(k)),
turn AS (SELECT source, k FROM (SELECT source, k, abs(sum(size * n_copies) - any_value(target)) AS off FROM turned GROUP BY source, k) QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1),
n AS (SELECT turned.* FROM turned JOIN turn ON turned.source IS NOT DISTINCT FROM turn.source AND turned.k = turn.k)
SELECT doc_id, size, source_size, target, n_copies, size * n_copies AS taken FROM n"""
