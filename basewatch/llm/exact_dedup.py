"""Exact dedup as a stateful stream.

Two streams run one after the other, both from a state folder that the caller may name and use
again. The first digests arriving files: doc_id, locator (file and row number) and digest of each
row. The second keeps the state, in RocksDB on the executors' disks with its changes in the state
folder: one entry for each digest ever seen, and no watermark, so that nothing expires. An entry
retains the digest, the stable identifier (the smallest doc_id so far) and the locator of that row's
content, and counts the rows. A second run with the same folder takes up only files that are new and
meets the entries of all earlier ones, also after a restart.

A digest alone decides nothing: each row whose digest another row has, of this run or an earlier
one, is read again by its locator, and its full bytes are held against those of the row that stays.
Only such rows' texts are fetched: a bitmap of rows for each stretch of a file, a bit a row, tells
them apart while the file is read, so that no other text is shuffled. Rows that differ in spite of equal digests are grouped again by
their whole texts. A hot group's rows are compared in salted parts, with the one row that stays
copied to each part.

Texts are equal when identical after each run of ASCII white space became one space. Defined
cases: null counts as empty text; a null doc_id sorts after all others; of rows with the same
smallest doc_id the one whose locator comes first stays; repeated rows are copies of each other; a
very long text is one row of a task; an empty table gives an empty result; other columns, whatever
their names, are carried or left alone.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewatch.llm.common import SPACE, cut, packed, remove, scratch, unpacked

PART = 512
#: Rows of a file in one bitmap of 4 KB, the size of Spark's bitmaps, and how many bitmaps are broadcast at most.
STRETCH, BROADCAST = 32_768, 4_096
#: The state's store. Many small stores: no space set aside beforehand, and changes instead of whole files to the shared folder.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _locator() -> Column:
    return F.concat(F.col("_metadata.file_path"), F.lit("#"), F.lpad(F.col("_metadata.row_index").cast("string"), 12, "0"))


def _place() -> dict[str, Column]:
    """Where a row stands: stretch of its file, and place in the stretch."""
    nth = F.col("_metadata.row_index")
    return {"_file": F.col("_metadata.file_path"), "_stretch": F.floor(nth / STRETCH), "_nth": F.pmod(nth, F.lit(STRETCH)).cast("int")}


def picked(rows: DataFrame, locators: DataFrame, name: str) -> DataFrame:
    """Rows, with the columns of _place(), whose locator is among locators(locator)."""
    nth = F.substring("locator", -12, 12).cast("long")
    places = locators.select(F.expr("left(locator, length(locator) - 13)").alias("_file"), F.floor(nth / STRETCH).alias("_stretch"), F.pmod(nth, F.lit(STRETCH)).alias("at"))
    maps = cut(places.groupBy("_file", "_stretch").agg(F.bitmap_construct_agg("at").alias("_bits")), name)
    maps = F.broadcast(maps) if maps.count() <= BROADCAST else maps  # beyond, Spark shuffles the rows by stretch
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_nth") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(maps, ["_file", "_stretch"]).filter(F.getbit(byte, F.pmod("_nth", F.lit(8))) == 1).drop("_file", "_stretch", "_nth", "_bits")


def _pattern(path: str) -> str:
    """A pattern that matches just this path, file or folder: a plain path given to a stream has to be a folder."""
    path = re.sub(r"([\[\]{}*?\\])", r"\\\1", path.rstrip("/"))
    return path if path.endswith("\\*") or path[-2:-1] == "\\" else f"{path[:-1]}[{path[-1]}]"


def _digests(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows of files -> doc_id, locator, digest, text_sha256."""
    rows = rows.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"), _locator().alias("locator"))
    return rows.select("doc_id", "locator", digest(F.col("text")).alias("digest"), sha256(F.col("text")).alias("text_sha256"))


def _digested(spark: SparkSession, source: str, state: str, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> str:
    """Digest files that are new under the pattern source: state/digested has doc_id, locator, digest, text_sha256 of every row ever seen."""
    schema, out = spark.read.parquet(source).schema, f"{state}/digested"
    rows = _digests(spark.readStream.schema(schema).parquet(source), id_col, text_col, digest)
    rows.writeStream.format("parquet").option("checkpointLocation", f"{state}/digesting").trigger(availableNow=True).start(out).awaitTermination()
    return out


def digest_state(spark: SparkSession, path: str, state: str, kind: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream digested rows that are new under path through the state -> digest, kept (struct: doc_id and locator of the row that stays), n."""
    source = spark.readStream.schema(f"doc_id {kind}, locator string, digest string, text_sha256 string")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    kept = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "locator")
    entries = source.parquet(path).groupBy("digest").agg(F.min(kept).alias("kept"), F.count("*").alias("n"))
    out = f"{state}/entries"
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        # entries that a batch changed, under the batch's number: run again after a failure, it replaces its own
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n:08d}")
        entries.writeStream.outputMode("update").option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    shape = f"digest string, kept struct<late: boolean, doc_id: {kind}, locator: string>, n long, batch int"
    try:
        batches = spark.read.parquet(out).select("batch").distinct().limit(2).count()
    except AnalysisException:  # no batch has ever been written
        return spark.createDataFrame([], shape).drop("batch")
    seen = spark.read.schema(shape).parquet(out)
    return seen.drop("batch") if batches < 2 else seen.groupBy("digest").agg(F.max_by("kept", "batch").alias("kept"), F.max("n").alias("n"))


def groups(spark: SparkSession, path: str, id_col="doc_id", text_col="text", digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, state: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row for each row under path: locator, doc_id, text_sha256, keep_id, keep_locator, group_size, kept.

    state: folder of an earlier call over the same path, which then only takes up what is new."""
    pattern, state = pattern or _pattern(path), state or scratch(spark, "dedup-state")
    digested = _digested(spark, pattern, state, id_col, text_col, digest)
    return _grouped(spark.read.parquet(pattern), digested, state, id_col, text_col, files_per_batch)


def _grouped(there: DataFrame, digested: str, state: str, id_col: str, text_col: str, files_per_batch: int | None = None) -> DataFrame:
    """Rows of files and the folder of all digests -> groups()'s rows."""
    spark, kind = there.sparkSession, there.schema[id_col].dataType.simpleString()
    entries = digest_state(spark, digested, state, kind, files_per_batch)
    texts = there.select(normalised(F.col(text_col)).alias("text"), _locator().alias("locator"), *[c.alias(k) for k, c in _place().items()])
    narrow = spark.read.schema(f"doc_id {kind}, locator string, digest string, text_sha256 string").parquet(digested)
    rows = cut(narrow.join(entries, "digest"), "digested")

    # full bytes, for every row that shares its digest: fetched by locator
    several = cut(rows.filter("n > 1").select("doc_id", "locator", "digest", F.ceil(F.col("n") / PART).cast("int").alias("parts"), (F.col("locator") == F.col("kept.locator")).alias("stays")), "shared-digests")
    fetched = lambda some, name: picked(texts, some.select("locator"), name).join(some, "locator")
    heads = fetched(several.filter("stays"), "heads").select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("head"))
    hits = fetched(several.filter("NOT stays"), "hits").withColumn("part", F.pmod(F.xxhash64("locator"), F.col("parts")).cast("int"))
    differ = hits.join(heads, ["digest", "part"]).filter("text != head")
    # rows that only share the digest: grouped by the text itself
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "locator")
    apart = cut(differ.select("locator", "doc_id", "digest", "text"), "collisions")
    again = apart.groupBy("digest", "text").agg(F.min(order).alias("kept2"), F.count("*").alias("n2"))
    moved = apart.select("locator", "digest", "text").join(again, ["digest", "text"]).select("locator", "kept2", "n2")
    lost = apart.groupBy("digest").agg(F.count("*").alias("n_apart"))
    out = rows.join(moved, "locator", "left").join(lost, "digest", "left")
    kept = F.coalesce("kept2", "kept")
    size = F.coalesce("n2", F.col("n") - F.coalesce("n_apart", F.lit(0)))
    return out.select("locator", "doc_id", kept["doc_id"].alias("keep_id"), kept["locator"].alias("keep_locator"), size.alias("group_size"), (F.col("locator") == kept["locator"]).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col="doc_id", text_col="text", state: str | None = None, in_files: bool = False) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    state: folder of earlier calls in the shared folder; rows equal to any row of an earlier call go too.
    in_files: docs is a plain read of files, so that they needn't be written for their rows to be found again; without state only."""
    if in_files:
        return _stay_in_files(docs, id_col, text_col)
    spark, state = docs.sparkSession, state or scratch(docs.sparkSession, "dedup-state")
    new = uuid.uuid4().hex
    docs.write.parquet(f"{state}/arrivals/{new}")
    found = groups(spark, "", id_col, text_col, state=state, pattern=f"{state}/arrivals/*")
    is_new = F.col("locator").contains(f"/arrivals/{new}/")
    earlier = found.filter(~is_new).select(F.col("keep_locator").alias("_earlier")).distinct()
    stay = found.filter(is_new & F.col("kept")).join(earlier, F.col("keep_locator") == F.col("_earlier"), "left_anti").select("locator")
    there = spark.read.schema(docs.schema).parquet(f"{state}/arrivals/{new}")
    return unpacked(picked(packed(there, **_place()), stay, "stay"))


def _stay_in_files(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """deduplicated() of a plain read of files. Their digests are all that is written, and go with the state once the bitmaps are there."""
    spark, state = docs.sparkSession, scratch(docs.sparkSession, "dedup-state")
    _digests(docs, id_col, text_col, sha256).write.parquet(f"{state}/digested")
    stay = _grouped(docs, f"{state}/digested", state, id_col, text_col).filter("kept").select("locator")
    out = unpacked(picked(packed(docs, **_place()), stay, "stay"))
    remove(spark, state)
    return out


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)"""
