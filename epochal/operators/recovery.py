"""What a commit log recovers to."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import last_before

#: The most pages of a record, and what a record's header says it is.
MOST_PAGES, MAGIC = 1 << 24, 0x4D574C43


def checksum(*fields: str) -> Column:
    """What a record's fields hash to; a null counts as a value of its own."""
    return F.xxhash64(F.lit(MAGIC), *[F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields])


def sealed(log: DataFrame, fields: tuple[str, ...] = ("epoch", "tx_id", "n_pages")) -> DataFrame:
    """Adds the checksum that a record is written with."""
    return log.withColumn("checksum", checksum(*fields))


def valid_records(log: DataFrame, fields: tuple[str, ...] = ("epoch", "tx_id", "n_pages")) -> DataFrame:
    """Adds valid: the number of pages is within its bounds and the checksum is what the record's fields give. A log
    without checksums has a flag, complete, instead."""
    whole = F.col("checksum") == checksum(*fields) if "checksum" in log.columns else F.col("complete")
    return log.withColumn("valid", F.coalesce((F.col("n_pages") > 0) & (F.col("n_pages") <= MOST_PAGES) & whole, F.lit(False)))


def recovered(log: DataFrame, base_epoch: int) -> DataFrame:
    """The records after the base up to the first that is invalid or missing. The first break is one aggregate; no
    task sees the log in order. Records of at most the base are skipped."""
    after = log.where(F.col("epoch") > base_epoch)
    # Ranges of epochs: within one, the first invalid record and the first valid one that doesn't follow its neighbour.
    width = 100_000
    ranged = after.groupBy("epoch").agg(F.min("valid").alias("valid")).withColumn("r", F.floor(F.col("epoch") / width))
    before = F.lag("epoch").over(Window.partitionBy("r").orderBy("epoch"))
    torn = F.when(~F.col("valid"), F.col("epoch"))
    hole = F.when(before.isNotNull() & (F.col("epoch") != before + 1), before + 1)
    ranges = ranged.select("r", "epoch", F.least(torn, hole).alias("stop")).groupBy("r").agg(F.min("stop").alias("stop"), F.min("epoch").alias("a"), F.max("epoch").alias("b"))
    last = F.coalesce(F.lag("b").over(Window.orderBy("r")), F.lit(base_epoch).cast("long"))
    ranges = ranges.withColumn("last", last)
    stop = ranges.agg(F.min(F.least("stop", F.when(F.col("a") != F.col("last") + 1, F.col("last") + 1))).alias("stop"))
    return after.crossJoin(F.broadcast(stop)).where("valid and (stop is null or epoch < stop)").drop("stop")


def recovered_epoch(log: DataFrame, base_epoch: int) -> DataFrame:
    return recovered(log, base_epoch).agg(F.coalesce(F.max("epoch"), F.lit(base_epoch)).alias("recovered_epoch"))


def visible_epoch(durable: DataFrame, base_epoch: int) -> DataFrame:
    """The last epoch up to which every commit is there."""
    return recovered_epoch(durable.withColumn("valid", F.lit(True)), base_epoch).withColumnRenamed("recovered_epoch", "visible_epoch")


def tail(log: DataFrame, base_epoch: int) -> DataFrame:
    """The records that a rewritten log keeps: those newer than the base."""
    return log.where(F.col("epoch") > base_epoch)


def after_failures(appends: DataFrame) -> DataFrame:
    """Adds state to appended commits (epoch, failed): a failed append is undone if it is the last; otherwise the
    prefix ends before it, and it and all later ones are lost."""
    marks = appends.agg(F.max("epoch").alias("__last"), F.min(F.when(F.col("failed"), F.col("epoch"))).alias("__first"))
    joined = appends.crossJoin(F.broadcast(marks))
    state = F.when(F.col("__first").isNull() | (F.col("epoch") < F.col("__first")), "installed").when(F.col("epoch") == F.col("__last"), F.when(F.col("__first") == F.col("__last"), "undone").otherwise("lost")).otherwise("lost")
    return joined.withColumn("state", state).drop("__last", "__first")


def record_states(pending: DataFrame, log: DataFrame) -> DataFrame:
    """Adds record_state to commits that were being published (epoch): complete if the log has their record whole,
    torn if it is there but not valid, unreadable if it isn't there."""
    there = valid_records(log).groupBy("epoch").agg(F.max("valid").alias("__valid"))
    return pending.join(there, "epoch", "left").withColumn("record_state", F.when(F.col("__valid"), "complete").when(~F.col("__valid"), "torn").otherwise("unreadable")).drop("__valid")


def repaired(pending: DataFrame) -> DataFrame:
    """What becomes of a commit whose publisher died."""
    return pending.withColumn("outcome", F.when(~F.col("pending"), "none").when(F.col("record_state") == "complete", "finished").when(F.col("record_state") == "torn", "undone").otherwise("broken"))


class _Run:
    """A run of records in their order, and where segments of it begin."""

    def __init__(self, sizes: np.ndarray, limit: int):
        self.limit, self.upto = limit, np.cumsum(sizes)

    def first(self, fill: int) -> int:
        """The place of the first record that doesn't fit behind ``fill`` bytes; beyond the run if all do."""
        return int(np.searchsorted(self.upto, self.limit - fill, "right"))

    def after(self, at: int) -> int:
        """Where the segment after the one that begins at a place begins; a record too large is alone in its own."""
        before = self.upto[at - 1] if at else 0
        return max(at + 1, int(np.searchsorted(self.upto, before + self.limit, "right")))

    def outline(self) -> tuple[list[int], list[int]]:
        """For each place at which the run's first segment may begin, which lies within the first ``limit`` bytes:
        how many segments begin, and the bytes in the last of them."""
        n, known = len(self.upto), {}
        places = range(min(self.first(0), n - 1) + 1)
        for at in places:
            path = []
            while at < n and at not in known:  # chains that meet go on alike, so each place is walked once
                path.append(at)
                at = self.after(at)
            for p in reversed(path):
                more = self.after(p)
                known[p] = (1 + known[more][0], known[more][1]) if more < n else (1, int(self.upto[-1] - (self.upto[p - 1] if p else 0)))
        return [known[p][0] for p in places], [known[p][1] for p in places]


def segments(log: DataFrame, limit: int, order: str = "epoch", size: str = "bytes", width: int = 10_000) -> DataFrame:
    """Adds segment, from 0: records go in their order into a segment until the next one would not fit into ``limit``
    bytes; that one begins the next segment, and a record above the limit has one of its own.

    How full a segment is depends on all records before. So each range of ``width`` epochs first works out, alone,
    how many segments it begins and how full it leaves the last one, for each place at which its first one may begin
    (``_Run.outline``, a short list). One pass over these lists, a row a range, then fixes what each range starts
    from, and the ranges number their records alone again. The order's values are unique."""
    slim = log.select(F.floor(F.col(order) / width).alias("__r"), F.col(order).alias("__o"), F.col(size).cast("long").alias("__s"))

    def outline(group: pd.DataFrame) -> pd.DataFrame:
        run = _Run(group.sort_values("__o")["__s"].to_numpy(), limit)
        counts, fills = run.outline()
        return pd.DataFrame({"__r": [int(group["__r"].iloc[0])], "upto": [run.upto[: len(counts)].tolist()], "counts": [counts], "fills": [fills], "total": [int(run.upto[-1])]})

    outlines = slim.groupBy("__r").applyInPandas(outline, "__r long, upto array<long>, counts array<long>, fills array<long>, total long")

    def fix(batches):
        fill, segment = limit, -1  # the first record finds no room and begins segment 0
        for batch in batches:
            out = []
            for r, upto, counts, fills, total in zip(batch["__r"], batch["upto"], batch["counts"], batch["fills"], batch["total"], strict=True):
                out.append((r, fill, segment))
                at = int(np.searchsorted(upto, limit - fill, "right"))
                segment, fill = (segment + counts[at], fills[at]) if at < len(counts) else (segment, fill + total)
            yield pd.DataFrame(out, columns=["__r", "__fill", "__segment"])

    fixed = outlines.repartition(1).sortWithinPartitions("__r").mapInPandas(fix, "__r long, __fill long, __segment long")

    def number(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__o")
        run = _Run(group["__s"].to_numpy(), limit)
        begins, at = np.zeros(len(group), "i8"), run.first(int(group["__fill"].iloc[0]))
        while at < len(group):
            begins[at] = 1
            at = run.after(at)
        return pd.DataFrame({"__o": group["__o"], "segment": int(group["__segment"].iloc[0]) + np.cumsum(begins)})

    numbered = slim.join(fixed, "__r").groupBy("__r").applyInPandas(number, "__o long, segment long")
    return log.join(numbered, F.col(order) == F.col("__o")).drop("__o")


def droppable(segmented: DataFrame, base_epoch: int) -> DataFrame:
    """Segments that hold nothing newer than the base: the next one begins at most one epoch after it. One row a
    segment is looked at in order; the last segment stays."""
    firsts = segmented.groupBy("segment").agg(F.min("epoch").alias("first"))
    following = firsts.withColumn("next", F.lead("first").over(Window.orderBy("segment")))
    return following.where(F.col("next") <= base_epoch + 1).select("segment")


def compaction_points(log: DataFrame, limit: int) -> DataFrame:
    """epoch at which a compactor that is woken by the size of the log runs: the last one before the log since the
    last compaction would outgrow ``limit`` bytes, and the bytes that each run takes in."""
    cut = segments(log, limit)
    last = cut.agg(F.max("segment").alias("__last"))
    return cut.groupBy("segment").agg(F.max("epoch").alias("epoch"), F.sum("bytes").alias("bytes")).crossJoin(F.broadcast(last)).where("segment < __last").select("epoch", "bytes")


def group_commits(commits: DataFrame, syncs: DataFrame, width: int = 100_000) -> DataFrame:
    """tx_id and sync_id: the first sync that began after a commit's record was written. Time is read backwards, so
    that it is the newest before it: frames that grow take a row once, those that shrink each time they are cut."""
    asks = commits.select("tx_id", (-F.col("append_end")).alias("at"), F.lit(0).alias("all"))
    facts = syncs.select((-F.col("sync_start")).alias("at"), (-F.col("sync_id")).alias("minus"), F.lit(0).alias("all"))
    found = last_before(asks, facts, ["all"], "at", "minus", "found", width=width)
    return found.select("tx_id", (-F.col("found")).alias("sync_id"))


def batch_durability(requests: DataFrame, batch: str, level: str = "sync_level") -> DataFrame:
    """The strongest level that a batch's requests ask for, which all of them get."""
    return requests.groupBy(batch).agg(F.max(level).alias(level), F.count("*").alias("requests"))


#: What a fault leaves of a log, for tests of recovery: (name, the record's epoch as a condition's subject).
FAULTS = ("none", "torn", "missing", "short", "repeated", "flipped")


def with_fault(log: DataFrame, fault: str, epoch: int) -> DataFrame:
    """A sealed log as a fault at one record leaves it: torn (a body that its checksum doesn't match), missing, short
    (no pages), repeated (written twice, which changes nothing), flipped (the record says it is of another epoch)."""
    here = F.col("epoch") == epoch
    if fault not in FAULTS:
        raise ValueError(f"no fault {fault!r}")
    if fault == "torn":
        return log.withColumn("checksum", F.when(here, F.col("checksum") + 1).otherwise(F.col("checksum")))
    if fault == "missing":
        return log.where(~here)
    if fault == "short":
        return log.withColumn("n_pages", F.when(here, F.lit(0).cast("long")).otherwise(F.col("n_pages")))
    if fault == "repeated":
        return log.unionByName(log.where(here))
    if fault == "flipped":
        return log.withColumn("epoch", F.when(here, F.col("epoch") + 1).otherwise(F.col("epoch")))
    return log
