"""Tables that cut a plan's lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is configured a local session takes a temporary one; on a
    cluster that is an error, since a folder of one machine is of no use to the others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="epochal-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts the lineage: a lost executor costs
    no more than the tasks it ran. The tables lie there until the folder is cleared, as checkpoints do."""
    path = f"{shared_dir(df.sparkSession)}/epochal-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
