"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that are not seen and may stand inside a word.
INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
#: HTML-like tags and <|...|> markers; a mail address in angle brackets is not one.
TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|<\|[^<>|]*\|>")
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; tags, invisible characters, punctuation and white space do not count."""
    if not text:
        return []
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    if "<" in text:
        text = TAG.sub(" ", text)
    return WORD.findall(text.lower())


class WordHash(dict):
    """word -> signed 64-bit hash, remembered (bounded) between the texts of a task."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def trimmed(c: Column | str) -> Column:
    """Without outer white space of any kind, tabs included; null stays null."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+|\s+$", "")


def name_key(c: Column | str) -> Column:
    """dataset and source compare without case, outer white space and the difference of - and _."""
    return F.translate(F.lower(trimmed(c)), "-", "_")


def split_kind(c: Column | str) -> Column:
    """train, valid or test from the usual words; null for anything else."""
    s = F.lower(trimmed(c))
    return (
        F.when(s.isin("train", "training"), F.lit("train"))
        .when(s.isin("valid", "validation", "val", "dev"), F.lit("valid"))
        .when(s.isin("test", "testing"), F.lit("test"))
    )


def latest(df: DataFrame, key: str, version: str, cols: list[str]) -> DataFrame:
    """One row per key: the cols of the row with the greatest version. Cut in every task before the shuffle; the values are a struct, so
    the aggregate sorts by key (it never holds a group).

    Rows with a null key go; a null version counts as the oldest; equal versions are settled by the values themselves."""
    order = F.struct(F.col(version).isNotNull(), F.col(version), *[F.col(c) for c in cols])
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_v"))
    return picked.select(key, "_v.*")


def release(spark: SparkSession) -> None:
    """Between the passes of an operator: lets Spark's cleaner drop the shuffle files of plans that are no longer referenced, so
    that the disk holds those of one pass at a time. A hint; nothing depends on it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
