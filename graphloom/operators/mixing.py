"""Interleaving, sharding, sampling without replacement and batching of rows."""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.ranking import cumulated, group_positions, numbered


def pattern(shares: dict[str, float]) -> dict[str, tuple[int, int, int]]:
    """For each source with a positive share: (rows per cycle, first place in the cycle, cycle length), shares as small fractions."""
    parts = {k: Fraction(v).limit_denominator(1000) for k, v in shares.items() if v > 0}
    base = lcm(*[p.denominator for p in parts.values()]) if parts else 1
    counts = {k: p.numerator * (base // p.denominator) for k, p in parts.items()}
    total, at, out = sum(counts.values()), 0, {}
    for k, n in counts.items():
        out[k] = (n, at, total)
        at += n
    return out


def interleaved(df: DataFrame, source: str, order: list[Column], shares: dict[str, float], until: str = "first_exhausted") -> DataFrame:
    """Rows of several sources in a repeating pattern, as a place column, computed in closed form from each row's rank in its source.

    first_exhausted ends with the first source that runs out; all_exhausted keeps every row. Sources without a share follow at the
    end, each row once."""
    cycle = pattern(shares)
    r = group_positions(df, [source], order, "_r", "_size").drop("_size")
    n, start, length = F.lit(None).cast("long"), F.lit(None).cast("long"), max([c[2] for c in cycle.values()], default=1)
    for name, (count, first, _) in cycle.items():
        hit = F.col(source) == name
        n, start = F.when(hit, F.lit(count)).otherwise(n), F.when(hit, F.lit(first)).otherwise(start)
    r = r.withColumn("_n", n).withColumn("place", F.floor(F.col("_r") / F.col("_n")) * length + start + F.col("_r") % F.col("_n"))
    if until == "first_exhausted":
        ends = r.where("_n is not null").groupBy(source).agg(F.max("place").alias("_end")).agg(F.min("_end").alias("_end"))
        r = r.join(F.broadcast(ends)).where("_n is null or place <= _end").drop("_end")  # one row
    return r.drop("_r", "_n")


def sampled_ranks(df: DataFrame, order: list[Column], replicas: int, drop_tail: bool = False) -> DataFrame:
    """Distributed sampler: rows in a seeded order dealt to replicas in turn; short of a full round the first rows come again, or the
    rest is dropped. Columns: replica, turn."""
    n = df.count()
    ranked = numbered(df, order, "_r")
    whole = n - n % replicas if drop_tail else -(-n // replicas) * replicas
    kept = ranked.where(F.col("_r") < whole)
    if whole > n:
        kept = kept.union(ranked.where(F.col("_r") < whole - n).withColumn("_r", F.col("_r") + n))
    return kept.withColumn("replica", (F.col("_r") % replicas).cast("int")).withColumn("turn", F.floor(F.col("_r") / replicas)).drop("_r")


def contiguous_shards(df: DataFrame, order: list[Column], shards: int) -> DataFrame:
    """shard: blocks of ceil(n / shards) rows in order."""
    size = -(-df.count() // shards) or 1
    return numbered(df, order, "_r").withColumn("shard", F.floor(F.col("_r") / size)).drop("_r")


def packed(df: DataFrame, by: list[str], order: list[Column], ids: str, multiple: int) -> DataFrame:
    """Each sequence with its place in the pack of its group: k (from 1, its number in the attention mask), start (its first position), and the
    pack's used and padded lengths. The pack is never gathered in one row, so a group of any size is laid out over all tasks."""
    size = F.size(ids).cast("long")
    r = cumulated(df, [*[F.col(c) for c in by], *order], size, "_upto", "_k")
    per = r.groupBy(*by).agg(F.min(F.col("_upto") - size).alias("_before"), F.min("_k").alias("_first"), F.sum(size).alias("used"))
    padded = F.col("used") + (multiple - F.col("used") % multiple) % multiple
    return r.join(per, by).select(*df.columns, (F.col("_k") - F.col("_first") + 1).alias("k"), (F.col("_upto") - size - F.col("_before")).alias("start"), "used", padded.alias("padded"))


def minibatch(buffer: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """n rows of a buffer without replacement, by a seeded order; all of them where there are fewer."""
    return buffer.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])), *keys).limit(n)


def concatenated(chosen: DataFrame, rejected: DataFrame, ids: str, pad: int) -> DataFrame:
    """Both sides as one batch, chosen first, every sequence padded on the right to the longest of both; side tells them apart."""
    both = chosen.withColumn("side", F.lit("chosen")).unionByName(rejected.withColumn("side", F.lit("rejected")))
    longest = both.agg(F.coalesce(F.max(F.size(ids)), F.lit(0)).alias("_n"))  # one row
    wide = both.crossJoin(F.broadcast(longest))
    return wide.withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), F.col("_n") - F.size(ids)))).drop("_n")


def batches(df: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    """batch: blocks of `size` rows of each group in order, from 0; a group of any size is numbered over all tasks."""
    return group_positions(df, by, order, "_r", "_size").withColumn("batch", F.floor(F.col("_r") / size)).drop("_r", "_size")


def latest_rows(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """First-in-first-out buffer: the last `limit` rows per key; a limit of 0 or less keeps all."""
    if limit <= 0:
        return df
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*[c.desc() for c in order]))).where(F.col("_r") <= limit).drop("_r")


def rotated(df: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """The next row's value, the last row of a batch taking the first one's."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(name, F.coalesce(F.lead(value).over(w), F.first(value).over(whole)))


def weighted_interleaved(df: DataFrame, source: str, order: list[Column], shares: dict[str, float], seed: int, until: str = "first_exhausted") -> DataFrame:
    """Rows of several sources in a random sequence of sources drawn by shares, as a place column.

    The source of place i comes from a hash of seed and i; the n-th place of a source takes its n-th row. first_exhausted ends
    before a source would run out; all_exhausted goes on, a source that ran out beginning again, until every source was used up."""
    spark = df.sparkSession
    sizes = {r[0]: r[1] for r in df.groupBy(source).agg(F.count("*")).collect() if r[0] in shares and shares[r[0]] > 0}  # one number per source
    total = sum(shares[s] for s in sizes)
    if not sizes:
        return df.where("false").withColumn("place", F.lit(0).cast("long"))
    reach = [n * total / shares[s] for s, n in sizes.items()]
    n = int(1.2 * (min(reach) if until == "first_exhausted" else max(reach))) + 1000
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("place").cast("string"))), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    at, chosen = 0.0, F.lit(None).cast("string")
    for s in sorted(sizes, reverse=True):
        at += shares[s] / total
        chosen = F.when(u >= 1 - at, F.coalesce(chosen, F.lit(s))).otherwise(chosen)
    places = group_positions(spark.range(n).withColumnRenamed("id", "place").withColumn("_s", chosen), ["_s"], [F.col("place")], "_n", "_all").drop("_all")
    size = F.create_map(*[x for s, k in sizes.items() for x in (F.lit(s), F.lit(k))])[F.col("_s")]
    last = places.where(F.col("_n") == size - (0 if until == "first_exhausted" else 1)).agg(F.min("place") if until == "first_exhausted" else F.max("place")).first()[0]
    cut = places.where(F.col("place") < last) if until == "first_exhausted" else places.where(F.col("place") <= last)
    rows = group_positions(df.where(F.col(source).isin(list(sizes))), [source], order, "_r", "_c").drop("_c")
    return cut.withColumn("_r", F.col("_n") % size).join(rows.withColumn("_s", F.col(source)), ["_s", "_r"]).select(*df.columns, "place")
