"""Graph operators: canonical edges, adjacency, hops, degrees, PageRank, difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranking import group_positions
from graphloom.session import materialise

HUB = 10_000
#: Above this many neighbours a node's list is not expanded for each of its neighbours.
WIDE = 1_000


def canonical_edges(edges: DataFrame, src: str = "src", dst: str = "dst", by: list[str] | None = None) -> DataFrame:
    """Undirected edges with u < v, each once; self loops and null ends go."""
    by = by or []
    ok = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    return ok.select(*by, F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).distinct()


def both_ways(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return edges.select(*by, F.col("u").alias("src"), F.col("v").alias("dst")).union(edges.select(*by, "v", "u"))


def hop_lists(adj: DataFrame, by: list[str]) -> DataFrame:
    """Sorted unique neighbour list per node: one row per node, so a hub's list must fit a row; pairs that only need common
    neighbours take common_neighbours, which makes no lists of hubs."""
    return adj.groupBy(*by, F.col("src").alias("node_id")).agg(F.array_sort(F.collect_set("dst")).alias("hop"))


def two_hops(adj: DataFrame, anchors: DataFrame | None, by: list[str]) -> DataFrame:
    """Distinct (src, dst) at distance of two steps, without src itself; only from the anchors where they are given, so the
    self-join starts from the anchors' rows and not from the whole graph."""
    first = adj if anchors is None else adj.join(anchors, [*by, "src"], "left_semi")
    # the neighbours of a hub are dealt to buckets of at most HUB, which meet all of its neighbours in tasks of their own
    parts = degrees(adj, by).select(*by, F.col("node_id").alias("mid"), F.ceil(F.col("degree") / HUB).cast("int").alias("_parts"))
    a = first.select(*by, "src", F.col("dst").alias("mid")).join(parts, [*by, "mid"]).withColumn("_part", F.pmod(F.xxhash64("src"), F.col("_parts")).cast("int")).drop("_parts")
    b = adj.select(*by, F.col("src").alias("mid"), F.col("dst").alias("far")).join(parts, [*by, "mid"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return a.join(b, [*by, "mid", "_part"]).where("src <> far").select(*by, "src", F.col("far").alias("dst")).distinct()


def wide_marks(adj: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of nodes with more than WIDE neighbours: (mid, degree, total: the sum of its neighbours), a written table; for each node the sorted list
    `outs` of wide nodes that it leads to, with the largest, `base`; and the list `ins` of those that lead to it. The lists are short: the edges
    hold at most their number / WIDE wide nodes."""
    wide = materialise(adj.groupBy(*by, F.col("src").alias("mid")).agg(F.count("*").alias("degree"), F.sum("dst").alias("total")).where(F.col("degree") > WIDE))
    outs = adj.withColumnRenamed("dst", "mid").join(wide, [*by, "mid"]).groupBy(*by, F.col("src").alias("node_id"))
    outs = outs.agg(F.array_sort(F.collect_list("mid")).alias("outs"), F.max_by("mid", F.struct("degree", "mid")).alias("base"))
    ins = adj.withColumnRenamed("src", "mid").join(wide.select(*by, "mid"), [*by, "mid"], "left_semi").groupBy(*by, F.col("dst").alias("node_id")).agg(F.collect_list("mid").alias("ins"))
    return wide, materialise(outs), materialise(ins)


def narrow_two_hops(adj: DataFrame, anchors: DataFrame | None, by: list[str], marks: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(src, dst) at distance of two steps, src <> dst, of the pairs that no wide node joins; a pair comes once for each node between."""
    wide, outs, ins = marks
    first = adj if anchors is None else adj.join(anchors, [*by, "src"], "left_semi")
    ends = lambda df, a, b: df.select(*by, F.col("node_id").alias(a), b)
    a = first.withColumnRenamed("dst", "mid").join(wide, [*by, "mid"], "left_anti").join(ends(outs, "src", "outs"), [*by, "src"], "left")
    b = adj.select(*by, F.col("src").alias("mid"), "dst").join(wide, [*by, "mid"], "left_anti").join(ends(ins, "dst", "ins"), [*by, "dst"], "left")
    met = F.coalesce(F.arrays_overlap("outs", "ins"), F.lit(False))
    return a.join(b, [*by, "mid"]).where((F.col("src") != F.col("dst")) & ~met).select(*by, "src", "dst")


def two_hop_totals(adj: DataFrame, by: list[str]) -> DataFrame:
    """reached and checksum (number and sum of the nodes at distance of two steps, without src itself) of each node that reaches one.

    Neighbours of the same wide nodes share what they reach through them: it is counted once for each such set of wide nodes, as the neighbours
    of the largest and those of the others that it lacks. Only what no wide node joins is expanded pair by pair."""
    adj = materialise(adj)
    wide, outs, ins = marks = wide_marks(adj, by)
    # both steps below run within the partitions of src, or of set, so there is one exchange of the pairs
    few = narrow_two_hops(adj, None, by, marks).repartition(*by, "src").distinct().groupBy(*by, "src").agg(F.count("*").alias("reached"), F.sum("dst").alias("checksum"))
    sets = outs.select(*by, "outs", "base").distinct().join(wide.select(*by, F.col("mid").alias("base"), "degree", "total"), [*by, "base"])
    other = sets.select(*by, "outs", "base", F.explode("outs").alias("mid")).where("mid <> base").join(adj.select(*by, F.col("src").alias("mid"), "dst"), [*by, "mid"])
    other = other.join(ins.withColumnRenamed("node_id", "dst"), [*by, "dst"]).where("not array_contains(ins, base)").select(*by, "outs", "dst").distinct()
    other = other.groupBy(*by, "outs").agg(F.count("*").alias("_n"), F.sum("dst").alias("_s"))
    sets = sets.join(other, [*by, "outs"], "left").select(*by, "outs", (F.col("degree") + F.coalesce("_n", F.lit(0))).alias("_n"), (F.col("total") + F.coalesce("_s", F.lit(0))).alias("_s"))
    own = F.when(F.arrays_overlap("outs", "ins"), 1).otherwise(0)
    many = outs.join(sets, [*by, "outs"]).join(ins, [*by, "node_id"], "left").select(*by, F.col("node_id").alias("src"), (F.col("_n") - own).alias("reached"), (F.col("_s") - own * F.col("node_id")).alias("checksum"))
    return few.union(many).groupBy(*by, "src").agg(F.sum("reached").alias("reached"), F.sum("checksum").alias("checksum")).where("reached > 0")


def common_neighbours(edges: DataFrame, adj: DataFrame, by: list[str]) -> DataFrame:
    """n_u, n_v and the sorted list of common neighbours of each edge.

    Each edge is expanded from its end of lower degree and checked against the other, so a hub with a third of all edges is
    expanded for none of them: the rows stay within the edges to the power 1.5."""
    d = degrees(adj, by)
    deg = lambda c, n: d.select(*by, F.col("node_id").alias(c), F.col("degree").alias(n))
    e = edges.join(deg("u", "n_u"), [*by, "u"]).join(deg("v", "n_v"), [*by, "v"])
    low, high = F.when(F.col("n_u") <= F.col("n_v"), F.col("u")).otherwise(F.col("v")), F.when(F.col("n_u") <= F.col("n_v"), F.col("v")).otherwise(F.col("u"))
    wide = e.select(*by, "u", "v", low.alias("src"), high.alias("other")).join(adj.select(*by, "src", F.col("dst").alias("w")), [*by, "src"])
    both = wide.join(adj.select(*by, F.col("src").alias("other"), F.col("dst").alias("w")), [*by, "other", "w"], "left_semi")
    found = both.groupBy(*by, "u", "v").agg(F.array_sort(F.collect_list("w")).alias("common"))
    return e.join(found, [*by, "u", "v"], "left").withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))


def degrees(adj: DataFrame, by: list[str]) -> DataFrame:
    return adj.groupBy(*by, F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))


def pagerank(nodes: DataFrame, adj: DataFrame, by: list[str], rounds: int = 10, damping: float = 0.85, cut: int = 5) -> DataFrame:
    """PageRank per graph with uniform handling of dangling nodes; lineage is cut by a written table every `cut` rounds."""
    n = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    out = materialise(adj.join(degrees(adj, by).withColumnRenamed("node_id", "src"), [*by, "src"]).select(*by, "src", "dst", (1 / F.col("degree")).alias("w")))
    rank = nodes.join(n, by).select(*by, "node_id", "n", (1 / F.col("n")).alias("pr"))
    for i in range(rounds):
        send = rank.select(*by, F.col("node_id").alias("src"), "pr").join(out, [*by, "src"]).groupBy(*by, F.col("dst").alias("node_id")).agg(F.sum(F.col("pr") * F.col("w")).alias("got"))
        held = rank.join(out.select(*by, F.col("src").alias("node_id")).distinct(), [*by, "node_id"], "left_anti").groupBy(*by).agg(F.sum("pr").alias("lost"))
        rank = rank.join(send, [*by, "node_id"], "left").join(held, by, "left")
        rank = rank.select(*by, "node_id", "n", ((1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) / F.col("n"))).alias("pr"))
        if (i + 1) % cut == 0 and i + 1 < rounds:
            rank = materialise(rank)
    return rank.drop("n")


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson score interval, clamped to 0..1; 0 where n is not positive."""
    z2 = z * z
    p = hits / n
    low = (p + z2 / (2 * n) - z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)
    return F.when(n <= 0, 0.0).otherwise(F.greatest(F.least(low, F.lit(1.0)), F.lit(0.0)))


def homophily(nodes: DataFrame, adj: DataFrame, by: list[str]) -> DataFrame:
    """Per node: degree, neighbours of the same label, score = Wilson bound + a small degree bonus (against the largest degree)."""
    lab = nodes.select(*by, F.col("node_id"), "label")
    a = adj.join(lab.select(*by, F.col("node_id").alias("src"), F.col("label").alias("own")), [*by, "src"])
    a = a.join(lab.select(*by, F.col("node_id").alias("dst"), F.col("label").alias("other")), [*by, "dst"])
    per = a.groupBy(*by, F.col("src").alias("node_id")).agg(F.count("*").alias("degree"), F.count_if(F.col("own") == F.col("other")).alias("same"))
    per = lab.join(per, [*by, "node_id"], "left").select(*by, "node_id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("same", F.lit(0)).alias("same"))
    top = per.groupBy(*by).agg(F.max("degree").alias("top"))
    bonus = F.when(F.col("top") > 0, 0.05 * F.log1p("degree") / F.log1p("top")).otherwise(0.0)
    return per.join(top, by).select(*by, "node_id", "degree", "same", F.round(wilson(F.col("same"), F.col("degree")) + bonus, 9).alias("score"))


def tercile_nodes(scored: DataFrame, by: list[str]) -> DataFrame:
    """hard (lowest third of scores), medium, easy; graphs of fewer than three nodes are all medium. Ties by node id."""
    r = group_positions(scored, by, [F.col("score"), F.col("node_id")], "rank", "n")
    lo, hi = F.floor(F.col("n") / 3), F.floor(2 * F.col("n") / 3)
    level = F.when(F.col("n") < 3, "medium").when(F.col("rank") < lo, "hard").when(F.col("rank") < hi, "medium").otherwise("easy")
    return r.select(*by, "node_id", "score", level.alias("difficulty"))


def tercile_pairs(pairs: DataFrame, by: list[str], positive: Column, similarity: str = "similarity", tie: str = "pair_id") -> DataFrame:
    """easy, medium, hard by thirds; positives from the most similar on, negatives from the least; the rest of the division is hard."""
    order = F.when(positive, -F.col(similarity)).otherwise(F.col(similarity))
    r = group_positions(pairs, by, [order, F.col(tie)], "_rank", "_n")
    b = F.when(F.floor(F.col("_n") / 3) > 0, F.floor(F.col("_n") / 3)).otherwise(F.col("_n"))
    level = F.when(F.col("_rank") < b, "easy").when(F.col("_rank") < 2 * b, "medium").otherwise("hard")
    return r.withColumn("difficulty", level).drop("_rank", "_n")
