"""A commit log and base snapshots on a shared file system: Parquet with a manifest.

Records are appended by segment. The manifest names the format and the base epoch; a reader refuses another version
or a feature that it doesn't know and leaves everything as it is. Only ``compact`` writes a base.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import recovery, snapshot

VERSION, FEATURES = 1, frozenset({"segments"})


def write_manifest(spark: SparkSession, path: str, base_epoch: int, features: tuple[str, ...] = ("segments",), version: int = VERSION) -> None:
    """One more manifest; the one of the highest base is in force, so a reader never sees a gap between two."""
    spark.createDataFrame([(version, list(features), base_epoch)], "version int, features array<string>, base_epoch long").coalesce(1).write.mode("append").json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str):
    found = spark.read.schema("version int, features array<string>, base_epoch long").json(f"{path}/manifest").orderBy(F.desc("base_epoch")).first()
    if found is None:
        raise ValueError(f"{path} has no manifest")
    if found["version"] is None or found["base_epoch"] is None or found["features"] is None:
        raise ValueError(f"the manifest of {path} is damaged")
    if found["version"] != VERSION or set(found["features"]) - FEATURES:
        raise ValueError(f"{path} has format {found['version']} with {found['features']}; {VERSION} with {sorted(FEATURES)} can be read")
    return found


def append(records: DataFrame, path: str, batch: str) -> bool:
    """Writes a batch of sealed records (epoch, tx_id, n_pages, segment, ...) and gives whether it was new. The
    batch's name is its identity: it is a folder of its own, finished by one rename, so a batch that is tried again
    after a failure replaces what the failed try left, and one that was written already is left as it is."""
    if not {"checksum", "complete"} & set(records.columns):
        records = recovery.sealed(records)
    if batch in {r["batch"] for r in _written(records.sparkSession, path).select("batch").distinct().collect()}:
        return False
    records.withColumn("offset", F.row_number().over(Window.partitionBy("segment").orderBy("epoch"))).write.mode("overwrite").partitionBy("segment").parquet(f"{path}/log/batch={batch}")
    records.sparkSession.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").json(f"{path}/batches")
    return True


def _written(spark: SparkSession, path: str) -> DataFrame:
    """The batches that were written whole; there are none before the first."""
    try:
        return spark.read.schema("batch string").json(f"{path}/batches")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "batch string")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all batches that were written whole."""
    return spark.read.option("basePath", f"{path}/log").parquet(f"{path}/log").join(F.broadcast(_written(spark, path).distinct()), "batch", "left_semi")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records that can be recovered: after the base, up to the first torn or missing one."""
    base = manifest(spark, path)["base_epoch"]
    return recovery.recovered(recovery.valid_records(records(spark, path)), base)


def peek(spark: SparkSession, path: str, batch: str, segment: int, offset: int) -> DataFrame:
    """The record at a place, if it is there and valid: one folder is read. No row means that it is torn."""
    at = recovery.valid_records(records(spark, path).where((F.col("batch") == batch) & (F.col("segment") == segment) & (F.col("offset") == offset)))
    return at.where("valid")


def trim(spark: SparkSession, path: str) -> DataFrame:
    """Segments that hold no record newer than the base, and so may be deleted."""
    base = manifest(spark, path)["base_epoch"]
    return recovery.droppable(records(spark, path), base)


def rewrite(spark: SparkSession, path: str, to: str) -> None:
    """Writes the log's valid records after the base as a log of its own, with the same base: what an in-place
    recovery or a shortened log is here. The old one stays until whoever called deletes it."""
    base = manifest(spark, path)["base_epoch"]
    append(read(spark, path).drop("valid", "batch", "offset"), to, "rewritten")
    write_manifest(spark, to, base)


def compact(spark: SparkSession, path: str, base: DataFrame, versions: DataFrame, key: list[str], upto: int, deleted) -> DataFrame:
    """Writes the base as of ``upto`` beside the older ones and then names it in the manifest: a crash between the
    two leaves the old base in force."""
    old = manifest(spark, path)["base_epoch"]
    new = snapshot.compact(base, versions, key, old, upto, deleted)
    new.write.mode("overwrite").parquet(f"{path}/base/epoch={upto}")
    write_manifest(spark, path, upto)
    return spark.read.parquet(f"{path}/base/epoch={upto}")


def compact_when(spark: SparkSession, path: str, log_max: int, size: str = "bytes", **how) -> DataFrame | None:
    """Compacts (see ``compact``) if the records after the base take more than ``log_max`` bytes; to be called by a
    schedule or for each batch of a stream of commits."""
    after = read(spark, path).agg(F.sum(size).alias("n"), F.max("epoch").alias("upto")).first()
    return compact(spark, path, upto=after["upto"], **how) if (after["n"] or 0) > log_max else None
