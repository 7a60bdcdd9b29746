"""A history of transactions behind one object: what it tells, under the options that it is read with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import Options
from .operators import snapshot, stats, validate


@dataclass
class History:
    """``tx``: tx_id, kind, writer_id, page, rpage, k, snapshot_epoch, commit_epoch, growth_only, reason, dependent;
    ``log``: epoch, bytes, synced; ``ddl``: commit_epoch of the schema's changes. Every method gives a DataFrame."""

    tx: DataFrame
    log: DataFrame
    ddl: DataFrame
    options: Options = Options()
    base_epoch: int = 1

    def writers(self) -> DataFrame:
        return self.tx.where("kind <> 'view'")

    def outcomes(self, forgiven: DataFrame | None = None) -> DataFrame:
        return validate.ladder(self.tx, self.ddl, forgiven, self.options)

    def tx_info(self) -> DataFrame:
        """tx_id, writer_id, snapshot_epoch, commit_epoch (0: none), state, is_writer, ws_pages of every
        transaction."""
        done = self.tx.join(self.outcomes(), "tx_id").withColumns({"is_writer": F.col("kind") != "view", "ended": F.lit(True)})
        done = done.withColumn("commit_epoch", F.when(F.col("is_writer") & (F.col("outcome") != "refused"), F.col("commit_epoch")).otherwise(F.lit(0).cast("long")))
        return validate.ended(done).select("tx_id", "writer_id", "snapshot_epoch", "commit_epoch", "state", "is_writer", F.col("is_writer").cast("int").alias("ws_pages"))

    def write_set(self, tx_id: int | None = None) -> DataFrame:
        """tx_id, page of what one transaction, or each, wrote."""
        rows = self.writers() if tx_id is None else self.writers().where(F.col("tx_id") == tx_id)
        return rows.select("tx_id", "page").distinct()

    def gc(self, oldest: int) -> DataFrame:
        """The versions that no snapshot from ``oldest`` on sees."""
        return snapshot.reclaimable(self.writers().select("page", "commit_epoch"), "page", oldest, self.base_epoch)

    def at(self, epoch: int, key: list[str], deleted: Column) -> DataFrame:
        return snapshot.snapshot(self.writers(), key, epoch, deleted)

    def compact(self, base: DataFrame, key: list[str], upto: int, deleted: Column) -> DataFrame:
        """The base as of an epoch."""
        return snapshot.compact(base, self.writers().select(*base.columns), key, self.base_epoch, upto, deleted)

    def db_stats(self, oldest: int, forgiven: DataFrame | None = None) -> DataFrame:
        """One row with every counter."""
        told = self.tx.join(self.outcomes(forgiven), "tx_id").join(self.ddl.select("commit_epoch", F.lit(True).alias("d")).distinct(), "commit_epoch", "left").withColumn("is_ddl", F.coalesce("d", F.lit(False)))
        if forgiven is not None:
            told = told.join(forgiven.select("tx_id", F.lit(True).alias("f")).distinct(), "tx_id", "left").withColumn("forgiven", F.coalesce("f", F.lit(False)))
        else:
            told = told.withColumn("forgiven", F.lit(False))
        if "attempts" not in told.columns:
            told = told.withColumn("attempts", F.lit(1))
        active = self.tx.select("snapshot_epoch", (F.col("snapshot_epoch") >= oldest).alias("alive"))
        return stats.counters(told, self.writers().select("page", "commit_epoch"), self.log, active, self.base_epoch, oldest)
