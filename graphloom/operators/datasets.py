"""Builders of node-classification and link-prediction datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vectors as vx
from graphloom.operators.ranking import numbered


def seeded(seed: int, *cols: str) -> Column:
    """A random order that any engine reproduces: md5 of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def seeded_sample(df: DataFrame, by: list[str], n: Column | int, seed: int, keys: list[str], most: int | None = None) -> DataFrame:
    """Up to n rows per stratum, without replacement. most: a constant bound of n; with it (or a constant n) each task keeps only so
    many rows of a stratum before the shuffle, so a stratum of any size is no single task's load."""
    w = Window.partitionBy(*by).orderBy(seeded(seed, *keys), *keys)
    r = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return (r if most is None else r.where(F.col("_r") <= most)).drop("_r")


def stratified(df: DataFrame, by: list[str], level: str, counts: dict[str, int], seed: int, keys: list[str]) -> DataFrame:
    """Up to the asked number of rows per stratum and level."""
    n = F.lit(0)
    for name, k in counts.items():
        n = F.when(F.col(level) == name, F.lit(k)).otherwise(n)
    return seeded_sample(df.where(F.col(level).isin(list(counts))), [*by, level], n, seed, keys, max(counts.values(), default=0))


def short_of(df: DataFrame, by: list[str], level: str, counts: dict[str, int]) -> DataFrame:
    """Strata and levels with fewer rows than asked: (by, level, have, want)."""
    want = F.lit(None)
    for name, k in counts.items():
        want = F.when(F.col(level) == name, F.lit(k)).otherwise(want)
    have = df.groupBy(*by, level).agg(F.count("*").alias("have"))
    return have.withColumn("want", want).where("have < want")


def without(df: DataFrame, *blocked: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose keys are in none of the blocked tables."""
    for b in blocked:
        df = df.join(b.select(*on).distinct(), on, "left_anti")
    return df


def local_ids(rows: DataFrame, offsets: DataFrame, col: str) -> DataFrame:
    """Ids that may be global or local made local: within [offset, offset + size) minus offset; below size as they are; else dropped."""
    o = offsets.select("dataset", "offset", "size")  # one row per graph; an equi-join, so the planner may choose by size
    r = rows.join(o, "dataset")
    inside = (F.col(col) >= F.col("offset")) & (F.col(col) < F.col("offset") + F.col("size"))
    local = F.when(inside, F.col(col) - F.col("offset")).when((F.col(col) >= 0) & (F.col(col) < F.col("size")), F.col(col))
    return r.withColumn(col, local).where(F.col(col).isNotNull()).drop("offset", "size")


def negative_pairs(nodes: DataFrame, edges: DataFrame, per_graph: int, seed: int, tries: int = 4) -> DataFrame:
    """Pairs of nodes without an edge, drawn by hashes: candidate i of a graph has ends md5(seed, i, 0 / 1) modulo its size. `tries`
    candidates are made per wanted pair, self pairs, repeats and edges go, and the first per_graph in draw order stay."""
    size = nodes.groupBy("dataset").agg((F.max("node_id") + 1).alias("n"))
    c = size.select("dataset", "n", F.explode(F.sequence(F.lit(0), F.lit(per_graph * tries - 1))).alias("i"))
    number = lambda e: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "dataset", F.col("i").cast("string"), F.lit(str(e)))), 1, 12), 16, 10).cast("long") % F.col("n")
    c = c.select("dataset", "i", number(0).alias("a"), number(1).alias("b")).where("a <> b")
    c = c.groupBy("dataset", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("i").alias("i"))
    c = c.join(edges.select("dataset", "u", "v"), ["dataset", "u", "v"], "left_anti")
    return c.withColumn("_r", F.row_number().over(Window.partitionBy("dataset").orderBy("i"))).where(F.col("_r") <= per_graph).select("dataset", "u", "v")


def pair_vectors(pairs: DataFrame, emb: DataFrame) -> DataFrame:
    """similarity (cosine of the two ends) and vector (their mean, unit length) of each pair; a missing vector is an error."""
    e = lambda s: emb.select("dataset", F.col("node_id").alias(s), F.col("emb").alias(f"e{s}"))
    j = pairs.join(e("u"), ["dataset", "u"], "left").join(e("v"), ["dataset", "v"], "left")
    checked = F.when(F.col("eu").isNull() | F.col("ev").isNull(), F.raise_error(F.lit("a pair has no vector at one of its ends"))).otherwise(vx.dot(vx.unit(F.col("eu")), vx.unit(F.col("ev"))))
    return j.select(*pairs.columns, F.round(checked, 6).alias("similarity"), vx.unit_or_same(vx.mean_pair(vx.unit(F.col("eu")), vx.unit(F.col("ev")))).alias("vector"))


def hop_payload(pairs: DataFrame, hops: DataFrame) -> DataFrame:
    """node_u_hop, node_v_hop and common_hop (sorted) of each pair; ends without neighbours have empty lists."""
    h = lambda s: hops.select("dataset", F.col("node_id").alias(s), F.col("hop").alias(f"node_{s}_hop"))
    j = pairs.join(h("u"), ["dataset", "u"], "left").join(h("v"), ["dataset", "v"], "left")
    none = F.array().cast("array<bigint>")
    j = j.withColumn("node_u_hop", F.coalesce("node_u_hop", none)).withColumn("node_v_hop", F.coalesce("node_v_hop", none))
    return j.withColumn("common_hop", F.array_sort(F.array_intersect("node_u_hop", "node_v_hop")))


def curriculum(df: DataFrame, level: str, keys: list[Column], hard_first: bool = True, name: str = "place") -> DataFrame:
    """Position of each row when levels follow each other (unknown ones last) and each level keeps the given order."""
    ranks = {"hard": 0, "medium": 1, "easy": 2} if hard_first else {"easy": 0, "medium": 1, "hard": 2}
    r = F.lit(3)
    for k, v in ranks.items():
        r = F.when(F.lower(F.col(level)) == k, F.lit(v)).otherwise(r)
    return numbered(df.withColumn("_rank", r), [F.col("_rank"), *keys], name).drop("_rank")
