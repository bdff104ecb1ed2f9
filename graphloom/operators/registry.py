"""Named post-processors and reward combiners; SQL functions for use in spark.sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import rollout_math as rm


def _conditional(df: DataFrame) -> DataFrame:
    """Rewards over all rows as z-scores, written into a template."""
    z = rm.standardised(df, "reward", "z")
    return z.select("input", tx.filled_reward("{input} <score:{reward}>", F.col("input").cast("string"), F.col("z")).alias("prompt"), "output")


PROCESSORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rs": lambda df: rm.best_of(df, "input", "output", "reward", "pos"),
    "csft": _conditional,
    "iter_dpo": lambda df: rm.best_and_worst(df, "input", "output", "reward", "pos"),
}


def processor(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in PROCESSORS:
        raise ValueError(f"unknown post-processor {name}; there are {sorted(PROCESSORS)}")
    return PROCESSORS[name]


def combined_reward(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


#: SQL functions whose bodies the optimizer sees through.
SQL_FUNCTIONS = {
    "loom_label_key(s STRING) RETURNS STRING": r"regexp_replace(lower(s), '(?U)\\s+', '')",
    "loom_tag_count(s STRING, t STRING) RETURNS INT": "cast((length(s) - length(replace(s, t, ''))) / length(t) as int)",
    "loom_preview(s STRING, n INT) RETURNS STRING": "case when length(s) > n then concat(left(s, n), '...') else s end",
}


def register_sql_functions(spark: SparkSession) -> None:
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
