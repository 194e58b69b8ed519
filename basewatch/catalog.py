"""All registered queries of the price-structure engine, and the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basewatch.plans import contracts, corpus, events, gold, labels, price, seals, streams, structure


def queries():
    return price.QUERIES | structure.QUERIES | events.QUERIES | corpus.QUERIES | contracts.QUERIES | gold.QUERIES | labels.QUERIES | streams.QUERIES | seals.QUERIES


def oracle_sql() -> dict[str, str]:
    return price.SQL | structure.SQL | events.SQL | corpus.SQL | contracts.SQL | gold.SQL | labels.SQL | streams.SQL | seals.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price.flagship(spark, sf_dir)
