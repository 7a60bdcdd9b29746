"""Whether a recorded history is what some serial order gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import last_before


def value_before(ops: DataFrame, key: str, order: list[str], reset: Column, delta: Column) -> DataFrame:
    """Adds inc and before: how often a key was reset before an operation, and the sum of the changes since."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    lived = ops.withColumn("inc", F.coalesce(F.sum(reset.cast("long")).over(before), F.lit(0)))
    within = Window.partitionBy(key, "inc").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return lived.withColumn("before", F.coalesce(F.sum(delta).over(within), F.lit(0)))


def unexplained(ops: DataFrame, key: str, order: list[str], reset: Column, delta: Column, observed: str) -> DataFrame:
    """The operations that observed another value than the serial order gives them: what their key was before."""
    return value_before(ops, key, order, reset, delta).where(~F.col(observed).eqNullSafe(F.col("before")))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, epoch: str, value: str, name: str, width: int = 100_000) -> DataFrame:
    """For each left row, the newest right value of its key of at most ``at``; rows without one are left out."""
    facts = right.select(key, F.col(epoch).alias(at), F.col(value).alias("__value"))
    return last_before(left, facts, [key], at, "__value", name, strict=False, width=width).where(F.col(name).isNotNull())


def epoch_gaps(commits: DataFrame, width: int = 100_000) -> DataFrame:
    """first_missing, n of each run of epochs without a commit, found by ranges of epochs and between these."""
    e = commits.select("commit_epoch").distinct().withColumn("r", F.expr(f"commit_epoch div {width}"))
    inside = e.withColumn("next", F.lead("commit_epoch").over(Window.partitionBy("r").orderBy("commit_epoch"))).where("next > commit_epoch + 1")
    ends = e.groupBy("r").agg(F.min("commit_epoch").alias("a"), F.max("commit_epoch").alias("commit_epoch"))
    between = ends.withColumn("next", F.lead("a").over(Window.orderBy("r"))).where("next > commit_epoch + 1")
    return inside.select("commit_epoch", "next").unionByName(between.select("commit_epoch", "next")).select((F.col("commit_epoch") + 1).alias("first_missing"), (F.col("next") - F.col("commit_epoch") - 1).alias("n"))


def double_orders(commits: DataFrame) -> DataFrame:
    return commits.groupBy("commit_epoch", "commit_order").agg(F.count("*").alias("n")).where("n > 1")


def order_in_epoch(commits: DataFrame, queue: str) -> DataFrame:
    """The place of each commit among those of its epoch."""
    return commits.withColumn("commit_order", F.row_number().over(Window.partitionBy("commit_epoch").orderBy(queue)) - 1)


def shared_holdings(holdings: DataFrame, value: str, holder: str) -> DataFrame:
    """Spans in which a holder takes a unique value while another still has it: each span is compared with the
    furthest end among those that began before it. Columns from_epoch, to_epoch (exclusive, null: still held)."""
    end = F.coalesce("to_epoch", F.lit(1 << 62))
    w = Window.partitionBy(value).orderBy("from_epoch", holder).rowsBetween(Window.unboundedPreceding, -1)
    return holdings.withColumn("held_until", F.max(end).over(w)).where("from_epoch < held_until").drop("held_until")


def durable(acks: DataFrame, present: DataFrame, per_tx: int) -> DataFrame:
    """Acknowledged transactions that aren't there whole."""
    whole = present.groupBy("tag").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).where((F.col("n") == per_tx) & (F.col("a") == 0) & (F.col("b") == per_tx - 1))
    return acks.join(whole, "tag", "left_anti")


def in_doubt(intents: DataFrame, log: DataFrame) -> DataFrame:
    """Intents without a commit are resolved by the log: it holds their sequence number or a later one of the slot."""
    last = log.groupBy("slot").agg(F.max("seq").alias("last"))
    return intents.where("not committed").join(last, "slot", "left").withColumn("resolved", F.when(F.col("last") >= F.col("seq"), "committed").otherwise("lost")).drop("last")


def open_loop(jobs: DataFrame, group: str, arrive: str, service: str) -> DataFrame:
    """Latency from scheduled arrival to the end when jobs of a group run one after the other: the end is the
    service so far plus the latest surplus of an arrival over the service before it."""
    upto = Window.partitionBy(group).orderBy(arrive, "tx_id").rowsBetween(Window.unboundedPreceding, 0)
    done = jobs.withColumn("__c", F.sum(service).over(upto))
    start = F.max(F.col(arrive) - (F.col("__c") - F.col(service))).over(upto)
    return done.withColumn("latency", start + F.col("__c") - F.col(arrive)).drop("__c")


def placements(gaps: DataFrame, doubtful: DataFrame, width: int = 100_000) -> DataFrame:
    """epoch and candidates: which transactions of unknown outcome (tx_id, snapshot_epoch, upto) may be the commit
    that an epoch lacks: it began before and ended after it. One candidate settles an epoch; several leave a search,
    which is one of few rows."""
    from .ordering import interval_join

    spans = doubtful.select("tx_id", (F.col("snapshot_epoch") + 1).alias("first"), F.col("upto").alias("last"))
    return interval_join(gaps.select("epoch"), spans, "epoch", "first", "last", width).groupBy("epoch").agg(F.array_sort(F.collect_list("tx_id")).alias("candidates"))


def settled(candidates: DataFrame, tries: int = 5000) -> DataFrame:
    """epoch and tx_id: a choice of one candidate an epoch, none twice, epochs that share candidates searched
    together by going back, at most ``tries`` steps a group of epochs; epochs without a choice have a null."""
    import pandas as pd

    from .graph import connected_components

    each = candidates.select("epoch", F.explode("candidates").alias("tx_id"))
    # Epochs hang together by the candidates that they share; a candidate's least epoch stands for it.
    edges = each.join(each.groupBy("tx_id").agg(F.min("epoch").alias("least")), "tx_id").where("least <> epoch").select(F.col("least").alias("a"), F.col("epoch").alias("b"))
    parts = candidates.join(connected_components(edges), F.col("epoch") == F.col("node"), "left").select("epoch", "candidates", F.coalesce("component", "epoch").alias("part"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("epoch")
        options = [list(c) for c in group["candidates"]]
        chosen: list[int] = []
        at, left = [0] * len(options), tries
        while len(chosen) < len(options) and left:
            left -= 1
            i = len(chosen)
            following = [j for j in range(at[i], len(options[i])) if options[i][j] not in chosen]
            if following:
                chosen.append(options[i][following[0]])
                at[i] = following[0] + 1
            elif i == 0:
                break
            else:
                at[i] = 0
                chosen.pop()
        whole = len(chosen) == len(options)
        return pd.DataFrame({"epoch": group["epoch"], "tx_id": pd.array(chosen if whole else [None] * len(options), dtype="Int64")})

    return parts.groupBy("part").applyInPandas(search, "epoch long, tx_id long")
