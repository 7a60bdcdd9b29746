"""Counters and reports of benchmark runs and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def throughput(runs: DataFrame, group: list[str], seconds: Column) -> DataFrame:
    return runs.groupBy(*group).agg((F.count("*") / seconds).alias("tx_s"))


def per_100(count: Column, committed: Column) -> Column:
    """How many to 100 committed transactions; 0 when there are none."""
    return F.when(committed > 0, 100.0 * count / committed).otherwise(0.0)


def merged_share(runs: DataFrame, group: list[str]) -> DataFrame:
    """What part of a hundred transactions was committed by a merge, and how many replays were lost to one merge; a
    share without transactions or merges is null. Columns transactions, merged, lost."""
    n = lambda c: F.sum(c)
    rows = runs.groupBy(*group).agg(n("transactions").alias("t"), n("merged").alias("m"), n("lost").alias("l"))
    return rows.select(*group, F.when(F.col("t") > 0, F.round(100.0 * F.col("m") / F.col("t"), 6)).alias("merged_percent"), F.when(F.col("m") > 0, F.round(F.col("l") / F.col("m"), 6)).alias("lost_per_merge"))


def attempts(operations: DataFrame, group: list[str], kind: str = "kind") -> DataFrame:
    """Reads, writes and refused operations (kind view, error, others), and what part of a hundred was refused."""
    n = lambda c: F.sum(c.cast("long"))
    k = F.col(kind)
    return operations.groupBy(*group).agg(n(k == "view").alias("reads"), n(~k.isin("view", "error")).alias("writes"), n(k == "error").alias("busy"), F.round(100.0 * n(k == "error") / F.count("*"), 6).alias("busy_percent"))


def key_invariants(rows: DataFrame, key: str) -> DataFrame:
    """Whether a key is unique, how many rows there are, and how many numbers between its least and greatest lack."""
    return rows.agg((F.count("*") == F.countDistinct(key)).alias("valid"), F.count("*").alias("n"), (F.max(key) - F.min(key) + 1 - F.count("*")).alias("gaps"))


def agreement(rows: DataFrame, group: str, same: Column) -> DataFrame:
    """How many results of each group agree with those of another run, and how many differ."""
    return rows.groupBy(group).agg(F.sum(same.cast("long")).alias("same"), F.sum((~same).cast("long")).alias("differ"), F.count("*").alias("n"))


def rolled_up(processes: DataFrame, group: list[str]) -> DataFrame:
    """One row from the rows of a run's processes: sums, the weighted mean wait, the upper median of the medians and
    the highest of the high percentiles."""
    upper = F.element_at(F.sort_array(F.collect_list("p50")), F.floor(F.count("*") / 2).cast("int") + 1)
    return processes.groupBy(*group).agg(F.sum("committed").alias("committed"), F.sum("retries").alias("retries"), (F.sum(F.col("wait") * F.col("committed")) / F.sum("committed")).alias("wait"), upper.alias("p50"), F.max("p99").alias("p99"), F.sum("rss").alias("rss"))


def side_by_side(rows: DataFrame, group: str, variant: str, value: str, variants: list[str]) -> DataFrame:
    """A column for each variant; only groups that have all of them."""
    return rows.groupBy(group).pivot(variant, variants).agg(F.first(value)).dropna(subset=variants)


def stage_times(times: DataFrame, long_ns: int = 500_000) -> DataFrame:
    slow = F.sum((F.col("ns") >= long_ns).cast("long"))
    return times.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("ns").alias("total"), F.max("ns").alias("longest"), slow.alias("slow"), F.round(F.avg("ns"), 6).alias("mean"), F.round(100.0 * slow / F.count("*"), 6).alias("slow_percent"))


def back_pressure_us(ratio: Column) -> Column:
    """The delay of a writer as the log fills, in microseconds."""
    return F.least(F.lit(500.0) * ratio * ratio * ratio, F.lit(50_000.0))


def shared_back_pressure_us(over: Column) -> Column:
    return F.least(over * 1000, F.lit(20_000))


def retry_delay_us(attempt: Column) -> Column:
    """The least sleep before a retry: doubling from 5 while below 2000."""
    return F.lit(5) * F.pow(F.lit(2), F.least(attempt, F.lit(9))).cast("long")


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A hash of a table's rows, whatever their order, that any engine with MD5 can compute: the exclusive or and the
    sum of 60 bits a row. A null is told from every text."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    v = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
    return rows.agg(F.bit_xor(v).alias("x"), F.sum(v.cast("decimal(38,0)")).cast("string").alias("s"), F.count("*").alias("n"))


def shown(number: Column, from_: int = 100_000) -> Column:
    """A number as reports show it: with separators of thousands from a bound on."""
    return F.when(number >= from_, F.format_number(number, 0)).otherwise(number.cast("string"))


#: The counters that a history and its log tell, by the relation that they come from; times of running code and what
#: only its mechanism has (gates, caches, prepared pages) are of no history and not counted here.
COUNTERS = {
    "tx": "commits aborts read_only schema_conflicts read_conflicts page_conflicts fast_commits relocations rebases rebase_retries unrebasable reads_saved rebases_grouped rebase_max_attempts".split(),
    "versions": "epoch page_versions versions_allocated versions_reclaimed pages_published bytes_retained schema_generation last_schema_epoch ddl_barriers".split(),
    "log": "log_bytes log_syncs base_epoch compaction_backlog compactions compacted_pages".split(),
    "snapshots": "snapshot_count oldest_active_snapshot".split(),
}


def counters(tx: DataFrame, versions: DataFrame, log: DataFrame, active: DataFrame, base_epoch: int, oldest: int, page_size: int = 4096, log_limit: int = 4_194_304) -> DataFrame:
    """One row with every counter of a history (see ``COUNTERS``), each relation read once.

    tx: tx_id, kind, conflict, outcome, forgiven (a read conflict that routes explain), attempts, commit_epoch, is_ddl;
    versions: page, commit_epoch; log: epoch, bytes, synced; active: snapshot_epoch, alive. A version is reclaimed
    when a newer one of its page is no newer than ``oldest``; commits up to ``base_epoch`` are compacted."""
    from .recovery import compaction_points
    from .snapshot import lifetimes

    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    done = F.col("outcome") != "refused"
    writer = F.col("kind") != "view"
    a = tx.agg(
        n(done & writer).alias("commits"), n(~done).alias("aborts"), n(~writer).alias("read_only"),
        n(F.col("conflict").eqNullSafe("schema")).alias("schema_conflicts"), n(F.col("conflict").eqNullSafe("read")).alias("read_conflicts"), n(F.col("conflict").eqNullSafe("page")).alias("page_conflicts"),
        n(writer & F.col("conflict").isNull()).alias("fast_commits"), n(F.col("outcome") == "relocated").alias("relocations"), n(F.col("outcome") == "rebased").alias("rebases"),
        n(F.when(F.col("outcome") == "rebased", F.col("attempts") - 1).otherwise(0)).alias("rebase_retries"), n(F.col("conflict").isNotNull() & (F.col("outcome") == "refused")).alias("unrebasable"),
        n(F.col("forgiven")).alias("reads_saved"), n((F.col("outcome") == "rebased") & (F.col("attempts") == 1)).alias("rebases_grouped"), F.coalesce(F.max(F.when(F.col("outcome") == "rebased", F.col("attempts"))), F.lit(0)).cast("long").alias("rebase_max_attempts"),
        n(F.col("is_ddl")).alias("schema_generation"), F.coalesce(F.max(F.when(F.col("is_ddl"), F.col("commit_epoch"))), F.lit(0)).alias("last_schema_epoch"), n(F.col("is_ddl")).alias("ddl_barriers"),
    )
    gone = F.col("next_epoch") <= oldest
    v = lifetimes(versions.select("page", "commit_epoch"), "page").agg(F.coalesce(F.max("commit_epoch"), F.lit(base_epoch)).alias("epoch"), F.count("*").alias("versions_allocated"), n(gone).alias("versions_reclaimed"), F.countDistinct(F.when(F.col("commit_epoch") <= base_epoch, F.col("page"))).alias("compacted_pages"))
    v = v.withColumns({"page_versions": F.col("versions_allocated") - F.col("versions_reclaimed"), "pages_published": F.col("versions_allocated"), "compaction_backlog": F.greatest(F.col("epoch") - base_epoch, F.lit(0))}).withColumn("bytes_retained", F.col("page_versions") * page_size)
    kept = log.where(F.col("epoch") > base_epoch).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("log_bytes"))
    syncs = log.agg(n(F.col("synced")).alias("log_syncs"))
    runs = compaction_points(log, log_limit).agg(F.count("*").alias("compactions"))
    s = active.agg(n(F.col("alive")).alias("snapshot_count"), F.min(F.when(F.col("alive"), F.col("snapshot_epoch"))).alias("oldest_active_snapshot"))
    out = a.crossJoin(v).crossJoin(kept).crossJoin(syncs).crossJoin(runs).crossJoin(s).withColumn("base_epoch", F.lit(base_epoch).cast("long"))
    return out.select(*[F.col(c).cast("long").alias(c) for names in COUNTERS.values() for c in names])
