"""Plug-in points for models and services: scorers, token ids, remote rewards, phase timing."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def scored(df: DataFrame, col: str, model: Callable[[], Callable[[list[str]], list[float]]], name: str = "reward") -> DataFrame:
    """Adds a model's score of a text; model() is called once per task."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = model()
        for b in batches:
            yield pd.Series(f(b.fillna("").tolist()), index=b.index)

    return df.withColumn(name, score(col))


def demo_reward(df: DataFrame, seed: int, keys: list[str], name: str = "reward") -> DataFrame:
    """A placeholder reward from -1, 0, 1 and 2, drawn by a hash of seed and keys; for trying pipelines out."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return df.withColumn(name, (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 4 - 1).cast("int"))


def appended(first: DataFrame | None, second: DataFrame | None) -> DataFrame | None:
    """Two batches of experience as one; None if either is."""
    return None if first is None or second is None else first.unionByName(second)


def summed_rewards(df: DataFrame, col: str, clients: list[Callable[[list[str]], list[float]]], tries: int = 100, wait: float = 1.0, name: str = "reward") -> DataFrame:
    """Adds the sum of several services' rewards; a call that fails is tried again after a pause."""

    def ask(f: Callable[[list[str]], list[float]], texts: list[str]) -> list[float]:
        for left in range(tries - 1, -1, -1):
            try:
                return f(texts)
            except OSError:
                if not left:
                    raise
                time.sleep(wait)
        raise AssertionError

    @pandas_udf("double")
    def total(s: pd.Series) -> pd.Series:
        texts = s.fillna("").tolist()
        return pd.DataFrame([ask(f, texts) for f in clients]).sum(axis=0).set_axis(s.index).astype(float)

    return df.withColumn(name, total(col))


def best_of_n(prompts: DataFrame, key: str, n: int, generate: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """n generations of each prompt and the one with the greatest reward, the earliest of equal ones."""
    from graphloom.operators.rollout_math import best_of

    wide = prompts.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return best_of(score(generate(wide)), key, "output", "reward", "sample")


def single_token_ids(tokens: DataFrame, col: str, vocabulary: DataFrame, name: str = "token_id") -> DataFrame:
    """The id of each word from a vocabulary (token, id); a word that is not exactly one token is an error."""
    j = tokens.join(vocabulary.select(F.col("token").alias(col), F.col("id").alias(name)), col, "left")
    fail = F.raise_error(F.concat(F.lit("not one token: "), F.coalesce(F.col(col), F.lit("null")))).cast("long")
    return j.withColumn(name, F.when(F.col(name).isNull(), fail).otherwise(F.col(name)))


def resumed(ranks: DataFrame, consumed: int, replicas: int) -> DataFrame:
    """The rows of a sampler that are left after `consumed` rows over all replicas."""
    return ranks.where(F.col("turn") >= consumed // replicas)


@contextmanager
def timed(phases: dict[str, float], name: str):
    """Adds the seconds of a block to phases[name]."""
    began = time.perf_counter()
    try:
        yield
    finally:
        phases[name] = phases.get(name, 0.0) + time.perf_counter() - began


def observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """df with aggregates that are gathered while it runs, without a second pass."""
    o = Observation(name)
    return df.observe(o, *[m.alias(k) for k, m in metrics.items()]), o
