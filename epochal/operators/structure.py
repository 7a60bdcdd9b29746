"""Growth, routes and three-way merges of page tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumbered(page: Column, lo: Column, hi: Column, delta: Column) -> Column:
    """New pages (those after lo up to hi) move by delta; the others stay."""
    return F.when((page > lo) & (page <= hi), page + delta).otherwise(page)


def relocated(rows: DataFrame, lo: int, hi: int, delta: int, columns: list[str]) -> DataFrame:
    """Rows whose own numbers and references to others move alike, so that every reference still points at its row."""
    return rows.withColumns({c: renumbered(F.col(c), F.lit(lo), F.lit(hi), F.lit(delta)) for c in columns})


def relocation_reason(t: DataFrame, pending: int) -> DataFrame:
    """Adds reason, null where a transaction that extended the file can be moved behind what others added, else the
    number of the first rule that it breaks. Columns: own_commits, size_before, size_after, new_pages, writes_first
    (page 1 is written), first_read (the snapshot's page 1 is there), first_differs (in more than the counter and the
    size), head_read (its newest version is there), head_sound (counters and format agree and the file hasn't shrunk),
    head_size, real_conflict. ``pending``: a page that may be in no file."""
    rules = {
        1: (F.col("own_commits") != 0) | (F.col("size_after") <= F.col("size_before")),
        2: ~F.col("writes_first") | (F.col("new_pages") != F.col("size_after") - F.col("size_before")),
        3: ~F.col("first_read"),
        4: F.col("first_differs"),
        5: ~F.col("head_read"),
        6: ~F.col("head_sound") | (F.col("head_size") < F.col("size_before")),
        7: F.col("head_size") == F.col("size_before"),
        9: F.col("real_conflict"),
        8: ((F.col("size_before") < pending) & (F.col("size_after") >= pending)) | ((F.col("head_size") < pending) & (F.col("head_size") + F.col("size_after") - F.col("size_before") >= pending)),
    }
    reason = reduce(lambda found, r: found.when(r[1], r[0]), rules.items(), F.when(F.lit(False), 0))
    return t.withColumn("reason", reason)


def referenced_once(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """New pages with another number of references than one."""
    n = refs.groupBy(F.col("child").alias("page")).agg(F.count("*").alias("n"))
    return pages.join(n, "page", "left").select("page", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def bounds(children: DataFrame) -> DataFrame:
    """Adds lower: the upper key of the neighbour before; a null upper key is the last."""
    w = Window.partitionBy("page").orderBy(F.asc_nulls_last("upper"))
    return children.withColumn("lower", F.lag("upper").over(w))


def same_routes(old: DataFrame, new: DataFrame, used: DataFrame) -> DataFrame:
    """page, same: whether every child that was used is still reached by the same range of keys."""
    o, n = bounds(old), bounds(new)
    pairs = used.join(o.select("page", "child", F.col("lower").alias("ol"), F.col("upper").alias("ou"), F.lit(True).alias("o")), ["page", "child"], "left").join(n.select("page", "child", "lower", "upper", F.lit(True).alias("n")), ["page", "child"], "left")
    same = F.coalesce(F.col("o") & F.col("n"), F.lit(False)) & F.col("ol").eqNullSafe(F.col("lower")) & F.col("ou").eqNullSafe(F.col("upper"))
    return pairs.groupBy("page").agg(F.min(same).alias("same"))


def forgiven_reads(reads: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """tx_id of readers of changed inner pages (tx_id, page, child) to whom the change makes no difference: they went
    through at least one child, and all that they went through are reached by the same ranges of keys."""
    routes = reads.join(same_child_routes(old, new), ["page", "child"], "left")
    return routes.groupBy("tx_id").agg(F.min(F.coalesce("same", F.lit(False))).alias("same")).where("same").select("tx_id")


def same_child_routes(old: DataFrame, new: DataFrame) -> DataFrame:
    """page, child, same: whether a child is there before and after, between the same keys."""
    o = bounds(old).select("page", "child", F.struct("lower", "upper").alias("o"))
    n = bounds(new).select("page", "child", F.struct("lower", "upper").alias("n"))
    return o.join(n, ["page", "child"], "full_outer").select("page", "child", (F.col("o").isNotNull() & F.col("n").isNotNull() & F.col("o").eqNullSafe(F.col("n"))).alias("same"))


def merged_children(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Three-way merge of the children of pages: page, child, upper, and conflict: a child that both changed, that
    one dropped, or that ours made and theirs has too."""
    side = lambda d, n: d.select("page", "child", F.struct("upper").alias(n))
    both = reduce(lambda a, b: a.join(b, ["page", "child"], "full_outer"), [side(base, "b"), side(ours, "o"), side(theirs, "t")])
    lost = F.col("b").isNotNull() & (F.col("o").isNull() | F.col("t").isNull())
    twice = F.col("b").isNull() & F.col("o").isNotNull() & F.col("t").isNotNull()
    clash = F.col("b").isNotNull() & (~F.col("o").eqNullSafe(F.col("b"))) & (~F.col("t").eqNullSafe(F.col("b")))
    taken = F.when(F.col("t").eqNullSafe(F.col("b")), F.coalesce("o", "t")).otherwise(F.coalesce("t", "o"))
    return both.select("page", "child", taken["upper"].alias("upper"), (lost | twice | clash).alias("conflict"))


def well_formed(children: DataFrame) -> DataFrame:
    """page, ok: exactly one child without an upper key, and no upper key twice."""
    return children.groupBy("page").agg((F.sum(F.col("upper").isNull().cast("int")) == 1).alias("one"), (F.count("upper") == F.countDistinct("upper")).alias("strict")).select("page", (F.col("one") & F.col("strict")).alias("ok"))
