"""Differences of two states of a table, as rows of inserts, updates and deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


WIDEST = 64


def row_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key, kind (1 insert, 2 update, 3 delete), mask of the changed columns (0 but for updates), old and new row;
    equal rows give none. A column's bit is its place among those that aren't key. Of more than 64 such columns the
    masks of updates are null: such rows can be compared but not merged column by column."""
    rest = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*rest).alias("old"), F.lit(True).alias("__o"))
    n = new.select(*key, F.struct(*rest).alias("new"), F.lit(True).alias("__n"))
    both = o.join(n, key, "full_outer")
    pairs = [(F.col(f"old.{c}"), F.col(f"new.{c}")) for c in rest]
    same = reduce(lambda x, y: x & y, [a.eqNullSafe(b) for a, b in pairs], F.lit(True))
    changed = changed_mask(pairs) if mergeable(len(rest)) else F.lit(None).cast("long")
    kind = F.when(F.col("__o").isNull(), 1).when(F.col("__n").isNull(), 3).when(~same, 2)
    return both.withColumn("kind", kind).where("kind is not null").select(*key, "kind", F.when(F.col("kind") == 2, changed).otherwise(F.lit(0).cast("long")).alias("mask"), "old", "new")


def mergeable(columns: int) -> bool:
    """Whether a mask has room for so many columns."""
    return columns <= WIDEST


def changed_mask(pairs: list[tuple[Column, Column]]) -> Column:
    """A bit for each pair that differs; null equals null. At most 64 pairs."""
    if not mergeable(len(pairs)):
        raise ValueError("a mask has room for 64 columns")
    bits = [F.when(a.eqNullSafe(b), F.lit(0)).otherwise(F.lit(1 << i if i < 63 else -(1 << 63))).cast("long") for i, (a, b) in enumerate(pairs)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits, F.lit(0).cast("long"))


def tagged(value: Column, kind: str) -> Column:
    """A dynamically typed value: its type's tag with the value in the field of that type."""
    fields = {"int": "long", "real": "double", "text": "string", "blob": "binary"}
    return F.struct(F.when(value.isNull(), "null").otherwise(kind).alias("t"), *[(value if k == kind else F.lit(None)).cast(t).alias(k) for k, t in fields.items()])


def identical(a: Column, b: Column, affinity: bool) -> Column:
    """Equality of tagged values. Without affinity 1 and 1.0 differ; with it numbers compare by their exact values:
    two integers as integers, and an integer with a real only where the real is that integer, so that neither is
    rounded to the other's type."""
    if not affinity:
        return a.eqNullSafe(b)

    def crossed(i: Column, r: Column) -> Column:
        # Reals of 2^63 and more are no longs; below, a real without a fraction is one exactly.
        return F.coalesce((r["real"] >= -(2.0**63)) & (r["real"] < 2.0**63) & (F.floor(r["real"]) == r["real"]) & (r["real"].cast("long") == i["int"]), F.lit(False))

    both = F.when((a["t"] == "int") & (b["t"] == "int"), a["int"] == b["int"]).when((a["t"] == "int") & (b["t"] == "real"), crossed(a, b)).when((a["t"] == "real") & (b["t"] == "int"), crossed(b, a))
    return both.otherwise(a.eqNullSafe(b))


def same_rows(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """How two states of a table differ: missing, extra and different rows."""
    d = row_diff(a, b, key)
    n = lambda k: F.coalesce(F.sum((F.col("kind") == k).cast("long")), F.lit(0))
    return d.agg(n(3).alias("missing"), n(1).alias("extra"), n(2).alias("different"))


def apply_diff(base: DataFrame, diff: DataFrame, key: list[str]) -> DataFrame:
    """The state after a diff: rows it touches take its new row or go, the others stay."""
    kept = base.join(diff.select(*key), key, "left_anti")
    return kept.unionByName(diff.where("kind <> 3").select(*key, "new.*").select(base.columns))
