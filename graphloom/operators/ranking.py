"""Positions over a whole table or within groups of any size, without a task that holds a whole group.

Rows are range-partitioned and sorted; each row's number is its place in its partition plus the rows of the partitions before, a
prefix sum over one number per partition. The sorted rows are written once, as the bounds of the ranges come from a sample and a
second run could cut elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import materialise


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place of each row in the order, from 0. Rows that are equal in all of it may change places."""
    # the id holds the partition above bit 33 and the place in it below
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    return placed.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_before") + F.col("_id") % F.lit(1 << 33)).drop("_id", "_part", "_before")


def cumulated(df: DataFrame, order: list[Column], weight: Column, name: str = "upto", place: str = "place") -> DataFrame:
    """Adds the sum of weight up to and with each row in the order, and its place from 0. A task sums its own range; what stands before it is
    one number per partition."""
    placed = materialise(df.withColumn("_w", weight.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sums = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.sum("_w").alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = F.broadcast(sums.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0")))
    own = F.sum("_w").over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = placed.withColumn("_part", part).withColumn("_own", own).join(starts, "_part")
    return out.select(*df.columns, (F.col("_s0") + F.coalesce("_own", F.lit(0))).alias(name), (F.col("_n0") + F.col("_id") % F.lit(1 << 33)).alias(place))


def group_positions(df: DataFrame, by: list[str], order: list[Column], name: str = "rank", size: str = "size") -> DataFrame:
    """Adds the place of each row in its group, from 0, and the size of the group. A null key is a group of its own.

    Only the first number and the count of each group are joined back."""
    if not by:
        n = numbered(df, order, name)
        return n.withColumn(size, F.lit(n.count()))
    n = numbered(df, [*[F.col(c) for c in by], *order], "_at")
    per = n.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]).agg(F.min("_at").alias("_first"), F.count("*").alias(size))
    cond = F.col(by[0]).eqNullSafe(F.col("_k0"))
    for i, c in enumerate(by[1:], 1):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return n.join(per, cond).select(*df.columns, (F.col("_at") - F.col("_first")).alias(name), size)
