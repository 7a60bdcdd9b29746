"""Streams over a commit log and over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail(spark: SparkSession, path: str, schema: str, files: int = 8) -> DataFrame:
    """The log as it grows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def newest_by_key(changes: DataFrame, key: str, epoch: str = "epoch") -> DataFrame:
    """The newest version of each key so far; with output mode update, the keys that a batch touched."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(epoch)).alias("v")).select(key, "v.*")


def tumbling(events: DataFrame, time: str, width: str, late: str, *aggregates) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width)).agg(*aggregates)


def sliding(events: DataFrame, time: str, width: str, slide: str, late: str, *aggregates) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width, slide)).agg(*aggregates)


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str, *aggregates) -> DataFrame:
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap)).agg(*aggregates)


def run_to_end(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs what there is and gives the result as a table in memory; for tests and small reports."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return stream.sparkSession.table(name)


def on_batches(stream: DataFrame, apply, checkpoint: str):
    """Calls apply(batch, id) for each batch: how an applied log is merged into a base, once a batch."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def validated(commits: DataFrame, granule: str = "granule") -> DataFrame:
    """tx_id, granule, conflict of each commit of a stream (tx_id, granule, snapshot_epoch, commit_epoch): whether
    another commit on the granule lies after its snapshot and before it. The state of a granule is the newest epoch
    seen. Commits of a granule that come with a batch are taken in the order of their epochs; a batch brings what a
    log's order puts after the batches before."""
    import pandas as pd

    def apply(key, batches, state):
        (head,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values("commit_epoch")
        # The newest epoch before each row: the state, then the rows before it in the batch.
        before = rows["commit_epoch"].cummax().shift(1, fill_value=head).clip(lower=head)
        state.update((max(head, int(rows["commit_epoch"].max())),))
        yield pd.DataFrame({"tx_id": rows["tx_id"], "granule": key[0], "conflict": before > rows["snapshot_epoch"]})

    return commits.groupBy(granule).applyInPandasWithState(apply, "tx_id long, granule long, conflict boolean", "head long", "append", "NoTimeout")
