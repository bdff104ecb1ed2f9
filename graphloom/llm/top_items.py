"""Problem 4: the N best items of every group, by one global range-partitioned sort.

Rows are range-partitioned and sorted on (group, order columns), so a group of any size is spread over as many partitions as it
needs and no task ever holds more than its own range. Each partition numbers its rows within their groups; only the first group
of a partition can have begun in an earlier one, so per partition just that group's total (and the last group's) is needed, and
a prefix sum over those at most two rows per partition turns local positions into exact ones.

The same skeleton gives running sums (of tokens, for a budget) instead of positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import materialise

MARKS = ["upto", "part", "first", "edge"]


def _codes(batch: pa.RecordBatch, groups: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """For sorted rows: index of the group run of each row, and the key of each run."""
    n = batch.num_rows
    change = np.zeros(n, dtype=bool)
    change[0] = True
    cols = [batch.column(g) for g in groups]
    for c in cols:
        ids = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= ids[1:] != ids[:-1]
    run = np.cumsum(change) - 1
    return run, [tuple(c[int(i)].as_py() for c in cols) for i in np.flatnonzero(change)]


def _running(groups: list[str], weight: str, most: float | None, marks: list[str]):
    """Adds the marks upto (the sum of weight within the group so far), part and first (in the partition's first group?); and, at the
    end, a row for the partition's first group and one for its last, with edge 0 and 1 and the group's total in upto."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        key, upto, first, schema, head = None, 0, True, None, None
        for b in batches:
            if not b.num_rows:
                continue
            schema = b.schema
            runs, keys = _codes(b, groups)
            w = b.column(weight).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(w)
            starts = np.flatnonzero(np.diff(runs, prepend=-1))
            offset = -np.where(starts > 0, total[starts - 1], 0)
            if keys[0] == key:
                offset[0] += upto
            elif key is not None:
                first = False
            local = total + offset[runs]
            in_first = (runs == 0) & first
            if first:
                head = (keys[0], int(local[in_first][-1]))
            key, upto = keys[-1], int(local[-1])
            first = first and len(keys) == 1
            extra = [pa.array(local), pa.array(np.full(len(w), part, np.int32)), pa.array(in_first), pa.nulls(len(w), pa.int32())]
            out = pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, *marks])
            yield out if most is None else out.filter(pa.array(local <= most))
        if head is not None:
            ends = [(0, *head)] if key == head[0] else [(0, *head), (1, key, upto)]
            cols = [pa.array([e[1][groups.index(f.name)] for e in ends], type=f.type) if f.name in groups else pa.nulls(len(ends), f.type) for f in schema]
            extra = [pa.array([e[2] for e in ends], pa.int64()), pa.array([part] * len(ends), pa.int32()), pa.nulls(len(ends), pa.bool_()), pa.array([e[0] for e in ends], pa.int32())]
            yield pa.RecordBatch.from_arrays([*cols, *extra], names=[*schema.names, *marks])

    return run


def running_totals(df: DataFrame, groups: list[str], order: list[Column], weight: Column | None = None, most: int | None = None, partitions: int | None = None, name: str = "position") -> DataFrame:
    """df with one more column: the sum of weight (default 1) over the rows of the group up to and with this one, in the order given.

    groups: columns that make a group (a null is a group of its own). order must settle every tie that matters: rows that are
    equal in all of it may change places. weight must not be negative; null counts as 0. most: rows whose total exceeds it may be
    left out early (they are left out in the end). An empty table gives an empty result; a column of df named like the new one
    is replaced by it, unless it is one of the groups (an error); any other name may occur."""
    spark = df.sparkSession
    if name in groups:
        raise ValueError(f"{name} is a column of the groups")
    df = df.drop(name) if name in df.columns else df
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    upto, part, first, edge = marks = [prefix + m for m in MARKS]
    w, before, key = prefix + "w", prefix + "before", prefix + "key"
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = df.withColumn(w, F.lit(1).cast("long") if weight is None else weight.cast("long"))
    keys = [F.col(g) for g in groups]
    placed = base.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    fields = [T.StructField(f.name, f.dataType, True) for f in placed.schema] + [
        T.StructField(m, t) for m, t in zip(marks, (T.LongType(), T.IntegerType(), T.BooleanType(), T.IntegerType()))
    ]
    # written once: the bounds of the ranges come from a sample, so a second run of the sort could cut elsewhere
    numbered = materialise(placed.mapInArrow(_running(groups, w, most, marks), T.StructType(fields)))
    ends = numbered.where(F.col(edge).isNotNull()).select(part, edge, upto, F.struct(*groups).alias(key)).collect()  # at most two small rows a partition
    known = spark.createDataFrame(_prefix([(e[0], e[1], tuple(e[3]), e[2]) for e in ends]), f"{part} int, {before} long")
    # only a partition's first group can have begun earlier
    earlier = F.when(F.col(first), F.coalesce(F.col(before), F.lit(0))).otherwise(F.lit(0))
    out = numbered.where(F.col(edge).isNull()).join(F.broadcast(known), part, "left").withColumn(name, F.col(upto) + earlier)
    if most is not None:
        out = out.where(F.col(name) <= most)
    return out.select(*df.columns, name)


def _prefix(ends: list[tuple[int, int, tuple, int]]) -> list[tuple[int, int]]:
    """(partition, total of its first group in the partitions before it)."""
    out, open_key, open_sum = [], None, 0
    parts: dict[int, dict[int, tuple]] = {}
    for part, edge, key, total in ends:
        parts.setdefault(part, {})[edge] = (key, total)
    for part in sorted(parts):
        head, tail = parts[part][0], parts[part].get(1)
        before = open_sum if head[0] == open_key else 0
        out.append((part, before))
        open_key, open_sum = tail if tail else (head[0], head[1] + before)
    return out


def top_items(df: DataFrame, groups: list[str], order: list[Column], n: int, name: str = "position") -> DataFrame:
    """The first n rows of every group in the given order, with their exact positions from 1."""
    return running_totals(df, groups, order, most=n, name=name)


def scored_candidates(similar_pairs: DataFrame) -> DataFrame:
    """One row per target and reference pair: the similarity of the latest scored_at among rows that count (target and
    similarity present, similarity within [-1, 1]). Of equal scored_at the greater similarity stands. A null ref_pair_id goes."""
    ok = similar_pairs.where("target_sample_id is not null and ref_pair_id is not null and similarity is not null and not isnan(similarity) and similarity between -1 and 1")
    order = F.struct(F.col("scored_at").isNotNull(), F.col("scored_at"), F.col("similarity"))
    return ok.groupBy("target_sample_id", "ref_pair_id").agg(F.max_by("similarity", order).alias("similarity"))
