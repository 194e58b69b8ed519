"""Late and corrected bars: a keyed table of bars with versions, and results that follow its changes.

Each micro-batch is merged by symbol and month: of all versions that came in, in whatever order, the
highest stands, so the table only depends on what has come in. Quarters that a changed bar touches are
reopened: those that are whole again come out anew, the others are withdrawn. The breakout states of the
symbols touched are worked out again from their corrected quarters.

The folder holds three tables as Parquet, each a list of changes by batch: `bars`, `quarters` and
`states`. A batch writes its changes under its own number, and reads only what came before it, so that
one that runs again replaces its own and changes nothing. Keys are dealt to BUCKETS folders by a hash of
the symbol, and a batch reads the buckets of its symbols only; compact() folds old batches into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basewatch.operators import bars as B
from basewatch.operators import breakout, peaks
from basewatch.params import DEFAULT, Params

BARS = "symbol string, bar_date date, open double, high double, low double, close double, volume double, version int"
QUARTERS = "symbol string, year int, qtr int, open double, high double, low double, close double, bar_date date, volume double, withdrawn boolean"
STATES = "symbol string, state string, escape_q int, confirmed_q int, via string, failed int, consecutive int, quarters int, withdrawn boolean"
_KEYS = {"bars": ["symbol", "bar_date"], "quarters": ["symbol", "year", "qtr"], "states": ["symbol"]}
_SHAPES = {"bars": BARS, "quarters": QUARTERS, "states": STATES}
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("symbol"), F.lit(BUCKETS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def changes(self, name: str, before: int | None = None) -> DataFrame:
        """All changes of a table, with batch and bucket, as far as they are of batches before a number."""
        shape = _SHAPES[name] + ", batch int, bucket int"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], shape)
        rows = self.spark.read.schema(shape).parquet(self._path(name))
        return rows if before is None else rows.filter(F.col("batch") < before)

    def put(self, name: str, rows: DataFrame, batch: int) -> None:
        """Write a batch's changes in place of what it wrote before."""
        columns = StructType.fromDDL(_SHAPES[name]).names
        rows.select(*columns, _bucket().alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self._path(name)}/batch={batch}")

    def current(self, name: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """A table as its changes leave it. Of bars the highest version stands, of results the last batch's."""
        rows = self.changes(name, before)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        return _standing(name, rows)

    def compact(self, name: str) -> None:
        """Fold all batches into the last one's folder. Not to be run while a stream writes."""
        batches = sorted(r[0] for r in self.changes(name).select("batch").distinct().collect())
        if len(batches) < 2:
            return
        held = f"{self._path(name)}-compacted"
        rows = self.current(name)
        columns = StructType.fromDDL(_SHAPES[name]).names
        rows.select(*columns, _bucket().alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(held)
        path, jvm = self.spark._jvm.org.apache.hadoop.fs.Path, self.spark._jsc.hadoopConfiguration()
        fs = path(held).getFileSystem(jvm)
        # the last batch goes first: what stands is the same with and without the older ones
        for b in reversed(batches):
            fs.delete(path(f"{self._path(name)}/batch={b}"), True)
            if b == batches[-1]:
                fs.rename(path(held), path(f"{self._path(name)}/batch={b}"))


def _standing(name: str, rows: DataFrame) -> DataFrame:
    keys = _KEYS[name]
    rest = [c for c in StructType.fromDDL(_SHAPES[name]).names if c not in keys]
    # of one version that came twice with different values the greater one: alike in every order of arrival
    order = F.struct("version", *[c for c in rest if c != "version"]) if name == "bars" else F.col("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("s")).select(*keys, *[f"s.{c}" for c in rest])


def _whole(bars: DataFrame) -> DataFrame:
    """Quarters with a valid bar for each of their months."""
    valid = bars.filter("high > 0 AND low > 0 AND close > 0").withColumns({"year": F.year("bar_date"), "qtr": F.quarter("bar_date")})
    first, last = (lambda c: F.min_by(c, "bar_date")), (lambda c: F.max_by(c, "bar_date"))
    q = valid.groupBy("symbol", "year", "qtr").agg(
        first(F.coalesce("open", "close")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close").alias("close"), F.max("bar_date").alias("bar_date"),
        F.when(F.count("volume") == 3, F.sum("volume")).alias("volume"), F.count_distinct(F.month("bar_date")).alias("months"),
    )
    return q.filter("months = 3").drop("months")


def _assessed(quarters: DataFrame, p: Params) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("year", "qtr")
    q = quarters.withColumn("q_idx", F.row_number().over(w) - 1)
    q = q.withColumn("lid", F.max("high").over(Window.partitionBy("symbol").orderBy("q_idx").rowsBetween(-24, -8)))
    found = breakout.assess(peaks.escape_band(q, p=p).filter("lid IS NOT NULL"), p)
    return found.join(q.groupBy("symbol").agg(F.count("*").cast("int").alias("quarters")), "symbol")


def merge(store: Store, rows: DataFrame, batch: int, p: Params = DEFAULT) -> None:
    """Take in a micro-batch of BARS."""
    known = rows.filter("symbol IS NOT NULL AND bar_date IS NOT NULL")
    incoming = _standing("bars", known.withColumn("bar_date", F.to_date(F.trunc("bar_date", "MM"))))
    store.put("bars", incoming, batch)  # read again from here: the rows of the batch are worked out once
    came = store.changes("bars").filter(F.col("batch") == batch)
    buckets = sorted(r[0] for r in came.select("bucket").distinct().collect())  # BUCKETS numbers at most
    before = store.current("bars", buckets, before=batch)
    after = _standing("bars", store.changes("bars", before=batch + 1).filter(F.col("bucket").isin(buckets)))
    values = [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("open", "high", "low", "close", "volume")]
    same = F.col("b.symbol").isNotNull()
    for v in values:
        same = same & v
    both = after.alias("a").join(came.select("symbol", "bar_date"), ["symbol", "bar_date"], "left_semi").alias("a").join(before.alias("b"), (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.bar_date") == F.col("b.bar_date")), "left")
    touched = both.filter(~same).select("a.symbol", F.year("a.bar_date").alias("year"), F.quarter("a.bar_date").alias("qtr")).distinct()
    there = after.withColumns({"year": F.year("bar_date"), "qtr": F.quarter("bar_date")}).join(touched, ["symbol", "year", "qtr"], "left_semi").drop("year", "qtr")
    anew = touched.join(_whole(there), ["symbol", "year", "qtr"], "left").withColumn("withdrawn", F.col("close").isNull())
    store.put("quarters", anew, batch)
    reopened = store.changes("quarters").filter(F.col("batch") == batch).select("symbol").distinct()
    quarters = _standing("quarters", store.changes("quarters", before=batch + 1).filter(F.col("bucket").isin(buckets))).filter("NOT withdrawn")
    found = _assessed(quarters.join(reopened, "symbol", "left_semi"), p)
    store.put("states", reopened.join(found, "symbol", "left").withColumn("withdrawn", F.col("state").isNull()), batch)


def drain(bars: DataFrame, folder: str, p: Params = DEFAULT) -> Store:
    """Merge what a stream of BARS has brought since the last call."""
    store = Store(bars.sparkSession, folder)
    stream = bars.writeStream.option("checkpointLocation", f"{store.folder}/stream").trigger(availableNow=True)
    stream.foreachBatch(lambda rows, n: merge(store, rows, n, p)).start().awaitTermination()
    return store


def corrected_quarters(store: Store) -> DataFrame:
    return store.current("quarters").filter("NOT withdrawn").drop("withdrawn")


def corrected_states(store: Store) -> DataFrame:
    return store.current("states").filter("NOT withdrawn").drop("withdrawn")
