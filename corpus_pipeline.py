"""From raw documents to mixed, tokenised text: each stage is one operator over all that the last one kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's
result as Parquet in the shared folder and reads it again for the next one. So docs is always a
plain read of files, and the first two stages pick the rows that stay from them instead of writing
the texts once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basewatch.llm import bpe, exact_dedup, mixing, near_dedup, quality
from basewatch.llm.common import cut, table
from basewatch.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passed(docs, in_files=True)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs, in_files=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mix),
    ("BPE", tokens),
]

#: The quality stage's estimates, the stream and the merges aren't SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
