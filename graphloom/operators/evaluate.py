"""Evaluation: accuracy, comparison of two stages, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def right(predicted: Column, gold: Column) -> Column:
    """Exact match with any of a list of gold answers; nulls are wrong."""
    return F.coalesce(F.array_contains(gold, predicted), F.lit(False))


def accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    """total, right and percent per group; rows without a prediction or a gold answer are counted as skipped."""
    ok = F.col("predicted").isNotNull() & F.col("gold").isNotNull()
    hit = right(F.col("predicted"), F.col("gold"))
    g = df.groupBy(*by).agg(F.count_if(ok).alias("total"), F.count_if(ok & hit).alias("right"), F.count_if(~ok).alias("skipped"))
    return g.withColumn("percent", F.round(100.0 * F.col("right") / F.nullif("total", F.lit(0)), 4))


def compared(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Accuracy of two stages on the same rows, and how many improved, degraded or stayed. A row of one stage only is an error."""
    j = first.select(key, F.col("predicted").alias("p1"), "gold").join(second.select(key, F.col("predicted").alias("p2")), key, "full")
    checked = j.withColumn("p2", F.when(F.col("gold").isNull() & F.col("p1").isNull(), F.raise_error(F.lit("a row is missing in the first stage"))).otherwise(F.col("p2")))
    a, b = right(F.col("p1"), F.col("gold")), right(F.col("p2"), F.col("gold"))
    share = lambda c: F.round(100 * F.avg(c.cast("int")), 4)
    return checked.agg(F.count("*").alias("n"), share(a).alias("first"), share(b).alias("second"), F.count_if(~a & b).alias("improved"), F.count_if(a & ~b).alias("degraded"), F.count_if(a == b).alias("same"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per bin from 1 to bins; the upper bound belongs to the last bin, values outside are in none."""
    at = F.least(F.expr(f"width_bucket({value}, {low}D, {high}D, {bins})"), F.lit(bins))
    return df.where(F.col(value).between(low, high)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
