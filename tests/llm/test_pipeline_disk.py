"""Stages of the pipeline leave no second copy of the texts in the shared folder."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from basewatch.llm import exact_dedup, quality
from basewatch.llm.common import table

SF = "/root/testdata/sf0.01"


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)


def test_stages_pick_rows_from_the_files(spark):
    docs, shared = table(spark, SF, "documents"), spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    texts = os.path.getsize(f"{SF}/documents.parquet")
    for stage, plain in ((corpus_pipeline.quality_rules, quality.passed), (corpus_pipeline.exact_copies, exact_dedup.deduplicated)):
        before = _bytes(shared)
        got = stage(spark, docs, SF)
        rows = sorted(map(str, got.collect()))
        assert _bytes(shared) - before < texts / 2, stage.__name__
        assert got.columns == docs.columns and rows == sorted(map(str, plain(docs).collect())), stage.__name__


def test_rows_in_files_keep_repeats_and_nulls(spark, tmp_path):
    path = f"file://{tmp_path}/d#1"
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "a"), (1, words, "en", "a"), (None, None, None, None), (2, "", "en", None), (3, "x", None, "b"), (4, " x ", "en", "b"), (5, "x", "en", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    assert sorted(r.doc_id for r in quality.passed(docs, in_files=True).collect()) == [1, 1]
    kept = exact_dedup.deduplicated(docs, in_files=True)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4]
    assert kept.filter(F.col("doc_id") == 1).first().text == words
    assert exact_dedup.deduplicated(spark.read.parquet(path).limit(0)).count() == 0
