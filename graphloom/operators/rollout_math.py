"""Numbers of policy rollouts: group baselines, masked statistics, returns, advantages, masks and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_normalised(df: DataFrame, group: str, reward: str) -> DataFrame:
    """(r - mean) / (sample deviation + 1e-9) within the group; null for a group of one."""
    w = Window.partitionBy(group)
    return df.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_samp(reward).over(w) + 1e-9))


def leave_one_out(df: DataFrame, group: str, reward: str) -> DataFrame:
    """r - mean of the others of the group; null for a group of one."""
    w = Window.partitionBy(group)
    others = (F.sum(reward).over(w) - F.col(reward)) / F.nullif(F.count("*").over(w) - 1, F.lit(0))
    return df.withColumn("advantage", F.col(reward) - others)


def mean_baseline(df: DataFrame, group: str, reward: str) -> DataFrame:
    return df.withColumn("advantage", F.col(reward) - F.avg(reward).over(Window.partitionBy(group)))


def standardised(df: DataFrame, value: str, name: str = "z") -> DataFrame:
    """(x - mean) / sample deviation over all rows: two aggregates joined back as one row, no global window."""
    s = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(F.broadcast(s)).withColumn(name, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")  # one row of statistics


def masked_mean(x: Column, m: Column) -> Column:
    return F.sum(x * m) / F.greatest(F.sum(m), F.lit(1))


def masked_normalised(df: DataFrame, value: str, mask: str, name: str, least: float = 1e-8) -> DataFrame:
    """Mean and variance over the masked places of all rows, applied to every place."""
    m = df.agg((F.sum(F.col(value) * F.col(mask)) / F.sum(mask)).alias("_m"), F.sum(mask).alias("_n"), F.sum(F.col(value) * F.col(value) * F.col(mask)).alias("_q"))
    j = df.join(F.broadcast(m))  # one row of statistics
    var = F.greatest(F.col("_q") / F.col("_n") - F.col("_m") * F.col("_m"), F.lit(least))
    return j.withColumn(name, (F.col(value) - F.col("_m")) / F.sqrt(var)).drop("_m", "_n", "_q")


def reverse_sums(df: DataFrame, seq: str, pos: str, value: Column, name: str) -> DataFrame:
    """Sum of value from each place to the end of its sequence (the undiscounted return)."""
    w = Window.partitionBy(seq).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def as_arrays(df: DataFrame, seq: str, pos: str, cols: list[str]) -> DataFrame:
    """One row per sequence with its columns as arrays in order."""
    packed = F.array_sort(F.collect_list(F.struct(pos, *cols))).alias("_s")
    return df.groupBy(seq).agg(packed).select(seq, *[F.col(f"_s.{c}").alias(c) for c in cols])


def terminal_rewards(df: DataFrame, seq: str, pos: str, kl: str, reward: str, coefficient: float, low: float = -10.0, high: float = 10.0) -> DataFrame:
    """-coefficient * kl at each place, plus the clipped reward at the last one."""
    last = F.lead(pos).over(Window.partitionBy(seq).orderBy(pos)).isNull()
    r = -F.lit(max(coefficient, 0.0)) * F.col(kl) + F.when(last, F.greatest(F.least(F.col(reward), F.lit(high)), F.lit(low))).otherwise(0.0)
    return df.withColumn("token_reward", r)


def position_ids(df: DataFrame, seq: str, pos: str, mask: str) -> DataFrame:
    """packed: place within the sequence; attended: running count of the mask minus 1, 1 where masked out."""
    w = Window.partitionBy(seq).orderBy(pos)
    run = F.sum(mask).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return df.withColumn("packed", F.row_number().over(w) - 1).withColumn("attended", F.when(F.col(mask) == 0, F.lit(1)).otherwise(run))


def span_mask(df: DataFrame, seq: str, pos: str, start: Column, stop: Column) -> DataFrame:
    """0 from each start mark through its stop mark (to the end where it is not closed), else 1: running counts of both."""
    w = Window.partitionBy(seq).orderBy(pos)
    begun = F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ended = F.coalesce(F.sum(stop.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("loss_mask", F.when(begun > ended, 0).otherwise(1))


def best_of(df: DataFrame, group: str, output: str, reward: str, pos: str) -> DataFrame:
    """The first output with the greatest reward per group."""
    return df.groupBy(group).agg(F.max_by(output, F.struct(F.col(reward), -F.col(pos))).alias("output"), F.max(reward).alias("reward"))


def best_and_worst(df: DataFrame, group: str, output: str, reward: str, pos: str) -> DataFrame:
    """chosen: the first output with the greatest reward; rejected: the first with the least. Groups of one are left out."""
    top, low = F.struct(F.col(reward), -F.col(pos)), F.struct(F.col(reward), F.col(pos))
    g = df.groupBy(group).agg(
        F.max_by(output, top).alias("chosen"), F.min_by(output, low).alias("rejected"), F.max(reward).alias("chosen_reward"), F.min(reward).alias("rejected_reward"), F.count("*").alias("n")
    )
    return g.where("n > 1").drop("n")
