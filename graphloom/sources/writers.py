"""Sinks: JSON lines, partitioned outputs, append logs, rewritten files, retained checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranking import cumulated
from graphloom.session import file_system


def write_jsonl(df: DataFrame, path: str, force: bool = False, by: list[str] | None = None) -> None:
    """JSON lines; an existing path is an error unless forced."""
    w = df.write.mode("overwrite" if force else "errorifexists")
    (w.partitionBy(*by) if by else w).json(path)


def pair_payload(pairs: DataFrame) -> DataFrame:
    """The columns of a link-prediction file, similarity with six decimals."""
    return pairs.withColumn("similarity", F.round("similarity", 6))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def merged_shards(spark, paths: list[str], index: str = "sample_index", schema: str | None = None) -> DataFrame:
    """Rows of several shard files in the order of their index, which goes."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(paths).orderBy(index).drop(index)


def rewritten(df: DataFrame, path: str) -> str:
    """Writes df beside path, then swaps it in and keeps the old one as .bak: a table that is being read is never overwritten.

    On any file system that Spark reads; a swap that fails is an error."""
    fresh, backup = f"{path}.{uuid.uuid4().hex}", f"{path}.bak"
    df.write.parquet(fresh)
    fs, at = file_system(df.sparkSession, path)
    fs.delete(at(backup), True)
    for a, b in ((path, backup), (fresh, path)):
        if not fs.rename(at(a), at(b)):
            raise OSError(f"{a} could not be renamed to {b}")
    return backup.removeprefix("file://")


def named_outputs(df: DataFrame, root: str, stage: str | None = None, total: int | None = None) -> list[str]:
    """JSON lines per dataset, as `dataset_stage_total.jsonl`, or `dataset.jsonl` without a stage; one folder per dataset, written in
    one pass each. Gives the paths."""
    names = sorted(r[0] for r in df.select("dataset").distinct().collect())  # one row per graph
    paths = [f"{root.rstrip('/')}/{n}{f'_{stage}_{total}' if stage else ''}.jsonl" for n in names]
    for n, path in zip(names, paths):
        write_jsonl(df.where(F.col("dataset") == n), path, force=True)
    return paths


def expired(checkpoints: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Of (name, written_at, bytes) the ones to delete so that the newest stay within a number and a total size."""
    r = cumulated(checkpoints, [F.desc("written_at"), F.col("name")], F.col("bytes"), "_b", "_n")
    return r.where((F.col("_n") >= most) | (F.col("_b") > most_bytes)).drop("_n", "_b")
