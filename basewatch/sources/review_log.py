"""The review log on shared storage: batches of events whose ids follow one another without gaps.

An append writes its batch beside the log first and then publishes it by creating the next numbered
file of `commits`, which says where the batch lies and which id it starts with. That file can be made
by one writer only; who loses takes the next number. A batch without such a file, because its job
failed or was ended, is no part of the log. Only numbers of batches and rows pass through the driver.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_COMMIT = "batch string, first long, n long, name string"


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """Commits of the log: number, batch, first, n, name."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(f"{path}/commits")):
        return spark.createDataFrame([], "number long, " + _COMMIT)
    rows = spark.read.schema(_COMMIT).option("pathGlobFilter", "*.json").json(f"{path}/commits")
    return rows.select(F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("long").alias("number"), "*")


def _publish(spark: SparkSession, path: str, number: int, told: str) -> bool:
    """Creates the numbered file with its whole content, or says that another writer has."""
    fs, at = _fs(spark, path)
    fs.mkdirs(at(f"{path}/commits"))
    draft, final = f"{path}/commits/_{uuid.uuid4().hex}", f"{path}/commits/{number:012d}.json"
    out = fs.create(at(draft), False)
    try:
        out.write(bytearray(told.encode()))
    finally:
        out.close()
    try:
        if fs.getScheme() == "file":
            # a local rename would replace the file of another writer, a link can't
            os.link(urlparse(draft).path, urlparse(final).path)
            return True
        return bool(fs.rename(at(draft), at(final)))
    except FileExistsError:
        return False
    finally:
        fs.delete(at(draft), False)


def append(events: DataFrame, path: str, order: list[str], name: str | None = None) -> tuple[int, int]:
    """Appends events, in the order of the named columns, and returns the first id and how many there are.

    With a name (a stream's batch, a delivery) the same batch is appended once only, however often the
    call is repeated. An empty batch is recorded too and takes no id. Ties of `order` follow all other columns."""
    spark = events.sparkSession
    done = lambda: _commits(spark, path).filter(F.col("name") == name).select("first", "n").head() if name is not None else None
    if found := done():
        return found[0], found[1]
    batch = uuid.uuid4().hex
    staged, final = f"{path}/staged/{batch}", f"{path}/batches/batch={batch}"
    keys = [*order, *[c for c in events.columns if c not in order]]
    at = F.monotonically_increasing_id()
    events.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_part": F.shiftright(at, 33), "_row": at.bitwiseAND((1 << 33) - 1)}).write.parquet(staged)
    rows = spark.read.parquet(staged)
    counts = rows.groupBy("_part").agg(F.count("*").alias("n"))  # one row for each partition
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows.join(before, "_part").withColumn("_seq", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before").write.parquet(final)
    n = spark.read.parquet(final).count()
    fs, to = _fs(spark, path)
    fs.delete(to(staged), True)
    while True:
        last = _commits(spark, path).orderBy(F.desc("number")).select("number", "first", "n").head()
        number, first = (last["number"] + 1, last["first"] + last["n"]) if last else (1, 1)
        if _publish(spark, path, number, json.dumps({"batch": batch, "first": first, "n": n, "name": name})):
            return first, n
        if found := done():
            return found[0], found[1]


def read(spark: SparkSession, path: str) -> DataFrame:
    """All published events with their id, from 1 on. Batches that nothing has published aren't looked at."""
    starts = _commits(spark, path).filter("n > 0").select("batch", "first")
    return spark.read.parquet(f"{path}/batches").join(starts, "batch").withColumn("id", F.col("first") + F.col("_seq")).drop("batch", "first", "_seq")
