"""Merging a refused transaction row by row with what was committed since its snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible(tx: DataFrame) -> DataFrame:
    """Adds reason: why a transaction can't be merged, null if it can. Columns rebase_on, first_commit, in_backoff,
    has_ddl, header_changed, catalog_reason."""
    reason = F.when(~F.col("rebase_on"), "off").when(~F.col("first_commit"), "not the snapshot's first commit").when(F.col("in_backoff"), "back-off").when(F.col("has_ddl"), "schema change").when(F.col("header_changed"), "header changed").otherwise(F.col("catalog_reason"))
    return tx.withColumn("reason", reason)


def read_dependent(stmts: DataFrame, net: DataFrame) -> DataFrame:
    """tx_id, dependent: whether a transaction's effect may depend on what it read: it ran a read or a statement that
    addresses no single row, changed nothing with one, or counted other changes than its net ones."""
    per = stmts.groupBy("tx_id").agg(F.max(F.col("is_read").cast("int")).alias("reads"), F.max((~F.col("is_point")).cast("int")).alias("wide"), F.max((F.col("counted") == 0).cast("int")).alias("idle"), F.sum("counted").alias("counted"))
    joined = per.join(net.groupBy("tx_id").agg(F.count("*").alias("net")), "tx_id", "left")
    return joined.select("tx_id", ((F.col("reads") == 1) | (F.col("wide") == 1) | (F.col("idle") == 1) | (F.col("counted") != F.coalesce("net", F.lit(0)))).alias("dependent"))


def replayable(changes: DataFrame, current: DataFrame, key: list[str], columns: list[str], unique: list[str] = ()) -> DataFrame:
    """Adds ok to row changes (key, kind, old, new): an update or delete needs the row exactly as it was; an insert
    needs its key free; what it writes to a unique column must not be another row's, neither one that stays nor one
    that a change of the same batch with a smaller key writes."""
    now = current.select(*key, F.struct(*columns).alias("now"))
    joined = changes.join(now, key, "left")
    ok = F.when(F.col("kind") == 1, F.col("now").isNull()).otherwise(F.col("now").isNotNull() & F.col("old").eqNullSafe(F.col("now")))
    joined = joined.withColumn("ok", ok)
    for u in unique:
        value = F.col(f"new.{u}")
        held = current.select(F.col(u).alias("__held"), F.struct(*key).alias("__by")).where("__held is not null")
        joined = joined.join(held, (value == F.col("__held")) & (F.col("kind") != 3), "left")
        mine = F.col("__by").isNull() | (F.col("__by") == F.struct(*key))
        joined = joined.withColumn("ok", F.col("ok") & mine).drop("__held", "__by")
        writes = joined.where(F.col("ok") & (F.col("kind") != 3) & value.isNotNull())
        first = writes.groupBy(value.alias("__value")).agg(F.min(F.struct(*key)).alias("__first"))
        joined = joined.join(first, (value == F.col("__value")) & (F.col("kind") != 3), "left")
        joined = joined.withColumn("ok", F.col("ok") & (F.col("__first").isNull() | (F.col("__first") == F.struct(*key)))).drop("__value", "__first")
    return joined.drop("now")


def with_policy(inserts: DataFrame, current: DataFrame, key: str, columns: list[str], unique: str, policy: str, not_null: str | None = None, default=None, changed: DataFrame | None = None) -> DataFrame:
    """What an insert does under its table's conflict clause: key, the columns as written, and outcome: inserted,
    replaced (rows of the same key or unique value go), ignored or refused. With the clause replace a null in
    ``not_null`` takes the default; under the others it is a violation. ``changed`` (key): rows that another
    transaction changed since the snapshot; replacing one of them is refused."""
    value = F.col(not_null) if not_null else None
    rows = inserts.withColumn(not_null, F.coalesce(value, F.lit(default))) if not_null and policy == "replace" else inserts
    wrong = F.col(not_null).isNull() if not_null else F.lit(False)
    hit = current.select(F.col(key).alias("__k"), F.col(unique).alias("__u"))
    if changed is not None:
        hit = hit.join(changed.select(F.col(key).alias("__k"), F.lit(True).alias("__c")).distinct(), "__k", "left")
    else:
        hit = hit.withColumn("__c", F.lit(None).cast("boolean"))
    # Two equalities, each joined by itself: an OR in the condition would compare all with all.
    by_key = hit.select(F.col("__k").alias(key), F.lit(True).alias("__same"), F.col("__c").alias("__c1"))
    by_value = hit.where("__u is not null").groupBy(F.col("__u").alias(unique)).agg(F.max(F.coalesce("__c", F.lit(False))).alias("__c2"), F.min("__k").alias("__owner"))
    joined = rows.join(by_key, key, "left").join(by_value, unique, "left")
    taken = F.coalesce(F.col("__same"), F.lit(False)) | F.col("__owner").isNotNull()
    touched = F.coalesce(F.col("__c1"), F.lit(False)) | F.coalesce(F.col("__c2"), F.lit(False))
    if policy == "replace":
        outcome = F.when(wrong, "refused").when(taken & touched, "refused").when(taken, "replaced").otherwise("inserted")
    elif policy == "ignore":
        outcome = F.when(wrong | taken, "ignored").otherwise("inserted")
    elif policy in ("abort", "fail", "rollback"):
        outcome = F.when(wrong | taken, "refused").otherwise("inserted")
    else:
        raise ValueError(f"no conflict clause {policy!r}")
    return joined.select(key, *columns, outcome.alias("outcome"))


def replay_order(changes: DataFrame, ranks: DataFrame) -> DataFrame:
    """Adds phase and place: updates first, deletes from children to parents, inserts from parents to children."""
    phase = F.element_at(F.create_map(F.lit(2), F.lit(0), F.lit(3), F.lit(1), F.lit(1), F.lit(2)), F.col("kind"))
    # One row a table of the schema: dealt by table, all changes of one would meet in one task.
    return changes.join(F.broadcast(ranks), "tbl").withColumn("phase", phase).withColumn("place", F.when(F.col("kind") == 3, -F.col("rank")).otherwise(F.when(F.col("kind") == 1, F.col("rank")).otherwise(0)))


def referenced_updates(changes: DataFrame, refmask: DataFrame) -> DataFrame:
    """Updates that touch a column which another table refers to: true conflicts."""
    return changes.where("kind = 2").join(F.broadcast(refmask), "tbl").where(F.col("mask").bitwiseAND(F.col("refmask")) != 0)


def merged_row(mask: Column, bit: int, new: Column, current: Column) -> Column:
    """Only a changed column takes its new value."""
    return F.when(F.shiftright(mask, bit).bitwiseAND(1) == 1, new).otherwise(current)


def back_off(streak: Column) -> Column:
    """How many conflicts go by without an attempt after a streak of lost ones."""
    return F.pow(F.lit(2), F.least(streak, F.lit(5))).cast("long") - 1


def components(requests: DataFrame) -> DataFrame:
    """Adds component to requests (tx_id, keys): those that share a key, in chains, are one. A request of one key is
    of that key's component; only keys that stand together in a request make edges."""
    from .graph import connected_components

    rows = requests.drop("component").withColumn("__least", F.array_min("keys"))
    edges = rows.select(F.col("__least").alias("a"), F.explode("keys").alias("b")).where("a <> b").distinct()
    if edges.isEmpty():
        return rows.withColumnRenamed("__least", "component")
    parts = connected_components(edges)
    return rows.join(parts, F.col("__least") == F.col("node"), "left").withColumn("component", F.coalesce("component", "__least")).drop("node", "__least")


def admit(requests: DataFrame) -> DataFrame:
    """Replays requests in their order of arrival; what a request installs decides on the next ones that share a row
    with it. Columns tx_id, arrival, snapshot_epoch, keys (array<long>). Adds verdict and commit_order (-1: none).

    Only requests of the same component of rows depend on each other. Components are dealt out and sorted by
    arrival, and each task folds over its stream of batches; it holds the newest commits of one component's rows and
    never a component's requests."""
    import pandas as pd

    schema = "tx_id long, verdict string, commit_order long"
    dealt = components(requests).select("component", "arrival", "tx_id", "snapshot_epoch", "keys").repartition("component").sortWithinPartitions("component", "arrival", "tx_id")

    def fold(batches):
        of, head = None, {}
        for batch in batches:
            verdict, order = [], []
            for component, arrival, seen, keys in zip(batch["component"], batch["arrival"], batch["snapshot_epoch"], batch["keys"], strict=True):
                if component != of:
                    of, head = component, {}
                clash = any(head.get(k, 0) > seen for k in keys)
                verdict.append("refused" if clash else "merged")
                order.append(-1 if clash else arrival)
                if not clash:
                    head.update(dict.fromkeys(keys, arrival))
            yield pd.DataFrame({"tx_id": batch["tx_id"], "verdict": verdict, "commit_order": order})

    return dealt.mapInPandas(fold, schema)
