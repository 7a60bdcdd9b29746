"""Benchmark results as CSV and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def last_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*key, "v.*")


def read_results(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    """The last line of each key of files with one JSON object a line."""
    return last_of_each(spark.read.json(path), key, order)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
