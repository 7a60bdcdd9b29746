"""Versions and snapshots: what a table looked like at an epoch, and which versions may go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import last_before


def newest(versions: DataFrame, key: list[str], at: int | None = None, epoch: str = "commit_epoch") -> DataFrame:
    """Each key's newest version of at most epoch ``at``. The pick is an aggregate, so it is combined before the
    shuffle and a key with many versions isn't sorted."""
    rows = versions if at is None else versions.where(F.col(epoch) <= at)
    rest = [c for c in versions.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(epoch)).alias("v"))
    return best.select(*key, *[F.col(f"v.{c}").alias(c) for c in rest])


def snapshot(versions: DataFrame, key: list[str], at: int, deleted: Column, epoch: str = "commit_epoch") -> DataFrame:
    """The rows that an epoch sees: the newest version of each key, unless it is a deletion."""
    return newest(versions, key, at, epoch).where(~deleted)


def heads(versions: DataFrame, key: str, epoch: str = "commit_epoch") -> DataFrame:
    return versions.groupBy(key).agg(F.max(epoch).alias("head_epoch"))


def value_as_of(records: DataFrame, value: str, at: int, base, epoch: str = "epoch") -> DataFrame:
    """The newest value recorded at most at ``at``, else the base."""
    return records.where(F.col(epoch) <= at).agg(F.coalesce(F.max_by(value, epoch), F.lit(base)).alias(value))


def changed_between(versions: DataFrame, key: list[str], base: int, upto: int, epoch: str = "commit_epoch") -> DataFrame:
    """Each key's newest version of at most ``upto``, where that is newer than ``base``."""
    return newest(versions.where(F.col(epoch) > base), key, upto, epoch)


def lifetimes(versions: DataFrame, key: str, epoch: str = "commit_epoch") -> DataFrame:
    """Adds next_epoch, that of the version that takes a version's place; null for the newest."""
    return versions.withColumn("next_epoch", F.lead(epoch).over(Window.partitionBy(key).orderBy(epoch)))


def reclaimable(versions: DataFrame, key: str, oldest: int, compacted: int = 0, epoch: str = "commit_epoch") -> DataFrame:
    """Versions that no snapshot from ``oldest`` on can see; of a key whose newest version is compacted, all."""
    lived = lifetimes(versions, key, epoch)
    return lived.where((F.col("next_epoch") <= oldest) | (F.col("next_epoch").isNull() & (F.col(epoch) <= min(oldest, compacted))))


def prune_sizes(sizes: DataFrame, oldest: int, epoch: str = "epoch") -> DataFrame:
    """Size records that a snapshot from ``oldest`` on needs: the newest of at most it, and all after."""
    last = sizes.where(F.col(epoch) <= oldest).agg(F.max(epoch).alias("__last"))
    return sizes.crossJoin(F.broadcast(last)).where((F.col(epoch) > oldest) | (F.col(epoch) == F.col("__last"))).drop("__last")


def oldest_snapshot(active: DataFrame, visible: int) -> DataFrame:
    """The oldest snapshot that a living reader holds, at most the visible epoch."""
    return active.where("alive").agg(F.least(F.coalesce(F.min("snapshot_epoch"), F.lit(visible)), F.lit(visible)).alias("oldest"))


def compact(base: DataFrame, versions: DataFrame, key: list[str], base_epoch: int, upto: int, deleted: Column, epoch: str = "commit_epoch") -> DataFrame:
    """The base as of ``upto``: the keys that changed since the base take their newest version, the others stay."""
    new = changed_between(versions, key, base_epoch, upto, epoch)
    kept = base.join(new.select(*key), key, "left_anti")
    return kept.unionByName(new.where(~deleted), allowMissingColumns=True)


def read_pages(reads: DataFrame, base: DataFrame, versions: DataFrame, key: str, value: str, at: str = "snapshot_epoch", epoch: str = "commit_epoch", width: int = 100_000) -> DataFrame:
    """Each read (its key and the epoch that it sees) with the value and the epoch of the newest version that is no
    newer, else the base's at epoch 0; null if neither has the key. ``validate.read_set`` records what was read."""
    facts = versions.select(key, F.col(epoch).alias(at), F.struct(F.col(epoch).alias("epoch"), F.col(value).alias("value")).alias("__v"))
    found = last_before(reads, facts, [key], at, "__v", "__found", strict=False, width=width)
    below = base.select(key, F.col(value).alias("__base"), F.lit(True).alias("__in_base"))
    joined = found.join(below, key, "left")
    epoch_read = F.coalesce(F.col("__found.epoch"), F.when(F.col("__in_base"), F.lit(0).cast("long")))
    return joined.withColumns({"read_epoch": epoch_read, value: F.when(F.col("__found").isNotNull(), F.col("__found.value")).otherwise(F.col("__base"))}).drop("__found", "__base", "__in_base")


def installed(chains: DataFrame, commits: DataFrame, key: str, epoch: str = "commit_epoch") -> DataFrame:
    """The versions after commits were installed: what a chain has already isn't installed again, so a
    repeated installation changes nothing."""
    return chains.unionByName(missing(chains, commits, key, epoch))


def missing(chains: DataFrame, commits: DataFrame, key: str, epoch: str = "commit_epoch") -> DataFrame:
    """The versions of commits that their keys' chains don't have."""
    return commits.join(chains.select(key, epoch).distinct(), [key, epoch], "left_anti")


def copied(versions: DataFrame, key: list[str], at: int, deleted: Column, path: str, epoch: str = "commit_epoch") -> DataFrame:
    """Writes what an epoch sees as a table of its own and reads it: a copy that later commits don't touch."""
    snapshot(versions, key, at, deleted, epoch).write.mode("overwrite").parquet(path)
    return versions.sparkSession.read.parquet(path)


def generated(spark, first: int, last: int, **columns: Column) -> DataFrame:
    """Rows i from ``first`` to ``last`` with columns by formula: what a recursive query would count up."""
    return spark.range(first, last + 1).withColumnRenamed("id", "i").withColumns(columns)
