"""Ordered computations without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)


def global_row_number(df: DataFrame, order: list[str], bucket: Column, name: str, start: int = 1) -> DataFrame:
    """Row numbers over the whole table. ``bucket`` rises with the order (a range of its first column): rows are
    numbered within their bucket, and a running count of the buckets, a small table, places each bucket."""
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(*BEFORE)
    offsets = sizes.select(F.col("__bucket"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__bucket").orderBy(*order)
    numbered = rows.withColumn("__at", F.row_number().over(within)).join(offsets, "__bucket")
    return numbered.withColumn(name, F.col("__at") + F.col("__before") + (start - 1)).drop("__bucket", "__at", "__before")


def last_before(asks: DataFrame, facts: DataFrame, key: list[str], at: str, value: str, name: str, strict: bool = True, width: int = 100_000) -> DataFrame:
    """Adds to each ask the value of its key's newest fact before its own place ``at`` (with ``strict=False``, at it
    or before), null without one; a null key has none.

    Both sides are dealt by key and by ranges of ``width`` places, so one hot key is the work of many tasks; what
    lies before a range is carried over from the ranges' newest facts, one row a key and range."""
    names, kind = asks.columns, facts.schema[value].dataType
    left = asks.select("*", F.col(at).alias("__at"), F.lit(True).alias("__ask"), F.lit(None).cast(kind).alias("__v"))
    right = facts.select(*[F.col(c) if c in key else F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in names], F.col(at).alias("__at"), F.lit(False).alias("__ask"), F.col(value).alias("__v"))
    both = left.unionByName(right).withColumn("__r", F.floor(F.col("__at") / width))
    fact = F.when(~F.col("__ask"), F.struct("__at", "__v"))
    frame = Window.partitionBy(*key, "__r").orderBy("__at").rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    here = both.withColumn("__here", F.max(fact).over(frame)).where("__ask")
    lasts = both.groupBy(*key, "__r").agg(F.max(fact).alias("__last"))
    carried = lasts.select(*key, "__r", F.max("__last").over(Window.partitionBy(*key).orderBy("__r").rowsBetween(*BEFORE)).alias("__carried"))
    found = here.join(carried, [*key, "__r"], "left").withColumn(name, F.coalesce("__here", "__carried")["__v"])
    return found.select(*names, name)


def interval_join(points: DataFrame, intervals: DataFrame, at: str, first: str, last: str, width: int = 10_000) -> DataFrame:
    """Every point with every interval that holds it, both ends included. Intervals go to each range of ``width``
    places that they touch, points to theirs, so the join is one of equal ranges."""
    spread = intervals.withColumn("__r", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    return points.withColumn("__r", F.floor(F.col(at) / width)).join(spread, "__r").where((F.col(at) >= F.col(first)) & (F.col(at) <= F.col(last))).drop("__r")


def floor_percentile(df: DataFrame, value: str, tie: str, p: float, group: list[str]) -> DataFrame:
    """The value at place floor(p * (n - 1)) of each group in ascending order; no row for an empty group."""
    w = Window.partitionBy(*group).orderBy(value, tie)
    ranked = df.withColumn("__at", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*group)))
    return ranked.where(F.col("__at") == F.floor(F.lit(p) * (F.col("__n") - 1)) + 1).select(*group, value)


def floor_percentile_all(df: DataFrame, value: str, p: float, name: str, width: float = 1000.0) -> DataFrame:
    """The same over a whole table. Rows are counted by ranges of ``width``; a running sum over the ranges, one row
    each, says in which the place lies, and only that range's values are counted one by one."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("__v")).withColumn("__r", F.floor(F.col("__v") / width))
    sizes = rows.groupBy("__r").agg(F.count("*").alias("__n"))
    upto = sizes.withColumn("__upto", F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__total", F.sum("__n").over(Window.partitionBy()))
    place = F.floor(F.lit(p) * (F.col("__total") - 1))
    here = upto.where((F.col("__upto") > place) & (F.col("__upto") - F.col("__n") <= place)).select("__r", (place - F.col("__upto") + F.col("__n")).alias("__place"))
    counts = rows.join(F.broadcast(here), "__r").groupBy("__r", "__place", "__v").agg(F.count("*").alias("__n"))
    running = Window.partitionBy("__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("__upto", F.sum("__n").over(running)).where("__upto > __place").agg(F.min("__v").alias(name))


def islands(df: DataFrame, value: str, longest: int, width: int = 1_000_000) -> DataFrame:
    """Runs of adjacent values, cut after ``longest``: first, n. Runs are found within ranges of ``width`` values.
    Where one range ends and the next begins with adjacent values the run goes on: where it started is looked up by
    a window over the ranges, one row each."""
    r = df.where(F.col(value).isNotNull()).select(F.col(value).cast("long").alias("v")).distinct().withColumn("r", F.floor(F.col("v") / width))
    w = Window.partitionBy("r").orderBy("v")
    runs = r.withColumn("isl", F.col("v") - F.row_number().over(w)).groupBy("r", "isl").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    ranges = runs.groupBy("r").agg(F.min("a").alias("low"), F.max("b").alias("high"), F.max("a").alias("last"))
    order = Window.orderBy("r")
    ranges = ranges.withColumn("goes_on", F.coalesce(F.col("low") == F.lag("high").over(order) + 1, F.lit(False)))
    own = F.when(~F.col("goes_on") | (F.col("last") != F.col("low")), F.col("last"))
    ranges = ranges.withColumn("start", F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = ranges.select("r", F.when(F.col("goes_on"), F.col("low")).alias("a"), F.lag("start").over(order).alias("start"))
    whole = runs.join(ranges, ["r", "a"], "left").groupBy(F.coalesce("start", "a").alias("first")).agg(F.max("b").alias("b"))
    cut = whole.select("b", F.explode(F.sequence("first", "b", F.lit(longest).cast("long"))).alias("first"))
    return cut.select("first", (F.least(F.col("b"), F.col("first") + longest - 1) - F.col("first") + 1).alias("n"))


def streaks(df: DataFrame, group: list[str], order: list[str], hit: Column) -> DataFrame:
    """The length of the streak of hits that ends at each row, per group; 0 where the row is no hit."""
    w = Window.partitionBy(*group).orderBy(*order)
    isl = df.withColumn("__hit", hit).withColumn("__isl", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*group, "__hit").orderBy(*order)))
    n = F.row_number().over(Window.partitionBy(*group, "__hit", "__isl").orderBy(*order))
    return isl.withColumn("streak", F.when(F.col("__hit"), n).otherwise(0)).drop("__hit", "__isl")


def group_frame_sum(df: DataFrame, partition: list[str], order: str, value: str, before: int, name: str) -> DataFrame:
    """Adds the sum over a row's peers and the ``before`` groups of peers before them (a GROUPS frame, which Spark
    has not): the groups are numbered, and the frame is a range of their numbers."""
    rows = df.withColumn("__g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*partition).orderBy("__g").rangeBetween(-before, 0))).drop("__g")
