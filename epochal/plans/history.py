"""A history of transactions derived by formula from the table of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import global_row_number


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx_id, commit_epoch, writer_id, k, page, kind, cents, rk, snapshot_epoch, rpage."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    e = global_row_number(e, ["ts", "event_id"], hour, "commit_epoch", start=2)
    h = e.select(F.col("event_id").alias("tx_id"), F.col("commit_epoch").cast("long"), (F.col("user_id") % 16).alias("writer_id"), F.col("user_id").alias("k"), F.expr("user_id div 20").alias("page"), F.col("event_type").alias("kind"), F.round(F.col("value") * 100).cast("long").alias("cents"), ((F.col("user_id") * 31 + 7) % 150).alias("rk"))
    return h.withColumn("snapshot_epoch", F.greatest(F.lit(1), F.col("commit_epoch") - 1 - (F.col("tx_id") * 7919) % 9)).withColumn("rpage", F.expr("rk div 20"))


#: The same in SQL, for the statements that check the queries.
SQL = """h AS (
  SELECT event_id AS tx_id, row_number() OVER (ORDER BY ts, event_id) + 1 AS commit_epoch, user_id % 16 AS writer_id, user_id AS k, user_id // 20 AS page,
    event_type AS kind, CAST(round(value * 100) AS BIGINT) AS cents, (user_id * 31 + 7) % 150 AS rk FROM events
), t AS (SELECT *, greatest(1, commit_epoch - 1 - (tx_id * 7919) % 9) AS snapshot_epoch, rk // 20 AS rpage FROM h)"""
