"""Parquet directories as named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; column pruning and predicate pushdown are Catalyst's."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temp views for ``spark.sql``; lazily scanned, so unused ones cost a footer."""
    for n in names or TABLES:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
