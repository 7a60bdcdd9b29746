"""Constraints and foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statements import is_ddl
from ..sources.scratch import materialize
from .ordering import global_row_number, last_before


def fk_order(tables: list[str], edges: list[tuple[str, str]]) -> dict[str, int]:
    """Each table's rank: 0 without parents, else one more than the highest parent's. The graph is one of a schema's
    tables, so it is worked out here; a cycle is refused."""
    rank = {t: 0 for t in tables if not any(c == t for c, _ in edges)}
    for _ in tables:
        for t in tables:
            parents = [p for c, p in edges if c == t]
            if parents and all(p in rank for p in parents):
                rank[t] = 1 + max(rank[p] for p in parents)
    if set(rank) != set(tables):
        raise ValueError(f"foreign keys in a circle: {sorted(set(tables) - set(rank))}")
    return rank


def fk_ranks(spark, tables: list[str], edges: list[tuple[str, str]]) -> DataFrame:
    """tbl, rank of ``fk_order``."""
    rank = fk_order(tables, edges)
    return spark.createDataFrame([(t, rank[t]) for t in tables], "tbl string, rank int")


def fk_violations(child: DataFrame, column: str, parent: DataFrame, to: str) -> DataFrame:
    """Child rows whose reference no parent has; null refers to nothing."""
    refs = parent.select(F.col(to).alias("__to"))
    return child.where(F.col(column).isNotNull()).join(refs, F.col(column) == F.col("__to"), "left_anti")


def cascade(deleted: DataFrame, chain: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """The rows that a delete takes along, table by table in the order of rank: (child, its reference, its key)."""
    out = []
    for child, column, key in chain:
        gone = child.join(deleted.select(F.col(deleted.columns[0]).alias("__p")).distinct(), F.col(column) == F.col("__p"), "left_semi")
        out.append(gone)
        deleted = gone.select(key)
    return out


def set_null(child: DataFrame, column: str, deleted: DataFrame) -> DataFrame:
    gone = deleted.select(F.col(deleted.columns[0]).alias("__p")).distinct()
    return child.join(gone, F.col(column) == F.col("__p"), "left").withColumn(column, F.when(F.col("__p").isNull(), F.col(column))).drop("__p")


def reference_masks(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """For each parent, the bits of its columns that others refer to."""
    bits = edges.join(columns, (edges["parent"] == columns["tbl"]) & (edges["to_col"] == columns["col"])).select("tbl", F.expr("shiftleft(1L, bit)").alias("m"))
    return bits.groupBy("tbl").agg(F.bit_or("m").alias("refmask"))


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """Values of a unique column that several rows hold; nulls are no values."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def allocate(rows: DataFrame, order: list[str], bucket, last: int, name: str = "rowid") -> DataFrame:
    """Row ids for new rows in serial order, dense from the last one on."""
    return global_row_number(rows, order, bucket, name, start=last + 1)


def after_deletes(tables: dict[str, DataFrame], keys: list, own: dict[str, str], deleted: dict[str, DataFrame], enforce: bool = True) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """The tables after rows were deleted and every foreign key has acted, parents before children, and the children
    whose key forbids it (tbl, key, parent): where there are any, the deletion is refused as a whole.

    ``keys``: ForeignKey with on_delete cascade, set null or no action; ``own``: each table's key column; ``deleted``:
    tables of keys. With ``enforce=False`` no key acts, and what is left an orphan is the application's business.
    A table that refers to itself is followed until nothing more goes, a turn a generation."""
    tables, gone = dict(tables), {t: d.select(F.col(d.columns[0]).alias("__gone")).distinct() for t, d in deleted.items()}
    rank = fk_order(list(tables), [(k.child, k.parent) for k in keys if k.child != k.parent])
    hit = lambda k: tables[k.child].join(gone[k.parent], F.col(k.column) == F.col("__gone"), "left_semi")
    for t in sorted(tables, key=lambda t: (rank[t], t)) if enforce else ():
        acting = sorted((k for k in keys if k.parent == t and t in gone), key=lambda k: k.child != t)
        for k in acting:
            if k.on_delete == "cascade":
                more = hit(k).select(F.col(own[k.child]).alias("__gone"))
                while k.child == t and not (more := more.join(gone[t], "__gone", "left_anti")).isEmpty():
                    gone[t] = materialize(gone[t].unionByName(more).distinct())
                    more = hit(k).select(F.col(own[t]).alias("__gone"))
                if k.child != t:
                    gone[k.child] = (gone[k.child].unionByName(more) if k.child in gone else more).distinct()
            elif k.on_delete == "set null":
                tables[k.child] = set_null(tables[k.child], k.column, gone[t])
    left = {t: d.join(gone[t], F.col(own[t]) == F.col("__gone"), "left_anti") if t in gone else d for t, d in tables.items()}
    refused = None
    for k in keys if enforce else ():
        if k.on_delete == "no action" and k.parent in gone:
            found = left[k.child].join(gone[k.parent], F.col(k.column) == F.col("__gone"), "left_semi").select(F.lit(k.child).alias("tbl"), F.col(own[k.child]).cast("string").alias("key"), F.col(k.column).cast("string").alias("parent"))
            refused = found if refused is None else refused.unionByName(found)
    return left, refused


def orphans(changes: DataFrame, column: str, parents: DataFrame, to: str, enforce: bool = True) -> DataFrame:
    """Adds ok to the written rows of a child: its reference is null or there now, whatever was there when it was
    written. Without enforcement all are."""
    if not enforce:
        return changes.withColumn("ok", F.lit(True))
    there = parents.select(F.col(to).alias("__to"), F.lit(True).alias("__there")).distinct()
    return changes.join(there, F.col(column) == F.col("__to"), "left").withColumn("ok", F.col(column).isNull() | F.col("__there").isNotNull()).drop("__to", "__there")


def violations(rows: DataFrame, key: list[str], not_null: list[str] = (), checks: dict[str, Column] | None = None, unique: list[str] = ()) -> DataFrame:
    """constraint and n: how many rows break each rule of a table. A key is unique and not null; a check that is
    neither true nor null is broken; nulls are never equal in a unique column. All rules that look at one row are
    counted in one pass."""
    rules = {f"not null {c}": F.col(c).isNull() for c in [*key, *not_null]} | {f"check {n}": ~F.coalesce(c, F.lit(True)) for n, c in (checks or {}).items()}
    counted = rows.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in rules.items()])
    names = F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(f"`{n}`").alias("n")) for n in rules])
    out = counted.select(F.explode(names).alias("x")).select("x.*")
    for name, columns in [("primary key", key), *((f"unique {u}", [u]) for u in unique)]:
        whole = rows.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("c")).where("c > 1")
        out = out.unionByName(whole.agg(F.lit(name).alias("constraint"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")))
    return out.where("n > 0")


def generations(statements: DataFrame, width: int = 100_000) -> DataFrame:
    """commit_epoch and schema_gen: how many changes of the schema were committed up to each of them. Statements
    (commit_epoch, sql): those that create, drop or alter anything but temporary objects; rebuilding an index or the
    file changes no table, but is a change of the schema to whoever holds an older snapshot."""
    ddl = statements.where(is_ddl(F.col("sql"))).select("commit_epoch").distinct()
    return global_row_number(ddl, ["commit_epoch"], F.floor(F.col("commit_epoch") / width), "schema_gen")


def generation_at(rows: DataFrame, generations: DataFrame, at: str = "snapshot_epoch", width: int = 100_000) -> DataFrame:
    """Adds schema_gen: the generation that an epoch sees, 0 before the first change."""
    asks = rows.withColumn("__all", F.lit(0))
    facts = generations.select(F.lit(0).alias("__all"), F.col("commit_epoch").alias(at), F.col("schema_gen").cast("long").alias("__g"))
    return last_before(asks, facts, ["__all"], at, "__g", "schema_gen", strict=False, width=width).withColumn("schema_gen", F.coalesce("schema_gen", F.lit(0).cast("long"))).drop("__all")
