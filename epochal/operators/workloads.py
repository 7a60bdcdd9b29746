"""What must hold of the histories of well-known workloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def independent(spark: SparkSession, workers: int, each: int) -> DataFrame:
    """Every worker inserts rows of its own: worker, seq, key."""
    n = spark.range(workers * each)
    return n.select((F.col("id") % workers).alias("worker"), F.expr(f"id div {workers}").alias("seq")).withColumn("key", F.col("worker") * each + F.col("seq"))


def hot_rows(spark: SparkSession, workers: int, each: int, rows: int) -> DataFrame:
    """Every worker adds one to the same few rows: worker, seq, key, delta."""
    n = spark.range(workers * each)
    return n.select((F.col("id") % workers).alias("worker"), F.expr(f"id div {workers}").alias("seq"), (F.col("id") % rows).alias("key"), F.lit(1).alias("delta"))


def invariant(ops: DataFrame) -> DataFrame:
    """worker, inserts, valid: none of a worker's keys is there twice, by its own or by another's doing."""
    by_key = ops.groupBy("worker", "key").agg(F.count("*").alias("n"))
    shared = by_key.withColumn("workers", F.count("*").over(Window.partitionBy("key")))
    return shared.groupBy("worker").agg(F.sum("n").alias("inserts"), ((F.max("n") == 1) & (F.max("workers") == 1)).alias("valid"))


def counted(ops: DataFrame) -> DataFrame:
    """key, committed, total, valid: whether each row counts the operations that were committed on it."""
    return ops.groupBy("key").agg(F.count("*").alias("committed"), F.sum("delta").alias("total")).withColumn("valid", F.col("committed") == F.col("total"))


def transfers(ops: DataFrame, source: str, target: str, amount: str) -> DataFrame:
    """tx_id, side, account, delta: both sides of transfers."""
    sides = F.array(F.struct(F.lit("from").alias("side"), F.col(source).alias("account"), (-F.col(amount)).alias("delta")), F.struct(F.lit("to").alias("side"), F.col(target).alias("account"), F.col(amount).alias("delta")))
    return ops.select("tx_id", F.explode(sides).alias("x")).select("tx_id", "x.*")


def conserved(entries: DataFrame) -> DataFrame:
    """Whether transfers neither made nor lost money: accounts, total, valid."""
    balances = entries.groupBy("account").agg(F.sum("delta").alias("balance"))
    return balances.agg(F.count("*").alias("accounts"), F.sum("balance").alias("total"), (F.sum("balance") == 0).alias("valid"))


def read_share(ops: DataFrame) -> DataFrame:
    """worker, n, reads, read_percent of a mixed load."""
    reads = F.sum((F.col("kind") == "view").cast("long"))
    return ops.groupBy("worker").agg(F.count("*").alias("n"), reads.alias("reads"), F.round(100.0 * reads / F.count("*"), 6).alias("read_percent"))


def own_columns(ops: DataFrame, names: list[str]) -> DataFrame:
    """row and the last value of each of its columns, each of which one worker writes: no write of one column may
    undo another's."""
    last = ops.groupBy("row", "col").agg(F.max_by("value", "seq").alias("last"))
    return last.groupBy("row").agg(*[F.max(F.when(F.col("col") == i, F.col("last"))).alias(n) for i, n in enumerate(names)])
