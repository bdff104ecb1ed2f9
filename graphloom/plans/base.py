"""Tables that many queries share, as DataFrames and as the DuckDB CTEs of their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.session import table


def key(c: str):
    return F.translate(F.lower(tx.strip(F.col(c))), "-", "_")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """One row per node: label (first element of a list-like category), split, pagerank."""
    raw = table(spark, d, "graph_nodes").groupBy("dataset", "node_id").agg(*[F.max(c).alias(c) for c in ("category", "split", "pagerank", "same_as")])
    label = F.regexp_replace("category", r'^\["?|"?\]$', "")
    return raw.select("dataset", "node_id", label.alias("label"), "split", "pagerank", "same_as")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Canonical undirected edges: no self loop, no null, u < v, each once."""
    e = table(spark, d, "graph_edges").where("src is not null and dst is not null and src <> dst")
    return e.select("dataset", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return e.select("dataset", F.col("u").alias("src"), F.col("v").alias("dst")).union(e.select("dataset", "v", "u"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """The latest non-blank summary of each node, by local id."""
    off = table(spark, d, "graph_datasets").select(key("dataset").alias("k"), F.col("dataset").alias("dataset"), "base_offset")
    r = table(spark, d, "jsonl_records").select(key("dataset").alias("k"), "node_id", tx.strip(F.col("summary_en")).alias("text"), "written_at", "record_id")
    r = r.where("text is not null and text <> ''").join(F.broadcast(off), "k")
    local = F.when(F.col("node_id") >= F.col("base_offset"), F.col("node_id") - F.col("base_offset")).otherwise(F.col("node_id"))
    return r.groupBy("dataset", local.alias("node_id")).agg(F.max_by("text", F.struct("written_at", "record_id", "text")).alias("text"))


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    """A vector for every node, drawn from the embeddings table by a fixed rule on position and node id."""
    e = table(spark, d, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    ds = table(spark, d, "graph_datasets").select("dataset", "position")
    at = nodes(spark, d).select("dataset", "node_id").join(F.broadcast(ds), "dataset").crossJoin(F.broadcast(n))  # one row
    at = at.select("dataset", "node_id", ((F.col("node_id") * 31 + F.col("position") * 17) % F.col("n")).alias("vec_id"))
    return at.join(e.select("vec_id", F.col("embedding").alias("emb")), "vec_id").select("dataset", "node_id", "emb")


def offsets(spark: SparkSession, d: str) -> DataFrame:
    """Running base offsets of the datasets in their order: the number of nodes before each."""
    from pyspark.sql import Window

    sizes = nodes(spark, d).groupBy("dataset").agg((F.max("node_id") + 1).alias("size"))
    p = table(spark, d, "graph_datasets").select("dataset", "position").join(sizes, "dataset")  # one row per dataset
    w = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)))


def positives(spark: SparkSession, d: str, splits: tuple[str, ...]) -> DataFrame:
    """dataset (as the graphs spell it), u < v (local ids) of the labelled pairs of some splits, by the latest export of each sample."""
    cols = ["dataset", "split", "label", "node_u", "node_v"]
    p = table(spark, d, "pair_samples").groupBy("sample_id").agg(F.max_by(F.struct(*cols), "exported_at").alias("r")).select("r.*")
    g = table(spark, d, "graph_datasets").select(key("dataset").alias("k"), F.col("dataset").alias("name"), "base_offset")  # one row per graph
    p = p.where("label = 1").where(key("split").isin(*splits)).withColumn("k", key("dataset")).join(g, "k")
    local = lambda c: F.when(F.col(c) >= F.col("base_offset"), F.col(c) - F.col("base_offset")).otherwise(F.col(c))
    p = p.select(F.col("name").alias("dataset"), local("node_u").alias("a"), local("node_v").alias("b")).where("a is not null and b is not null")
    return p.select("dataset", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


NODES = """nodes as (select dataset, node_id, regexp_replace(max(category), '^\\["?|"?\\]$', '', 'g') as label, max(split) as split, max(pagerank) as pagerank, max(same_as) as same_as from graph_nodes group by 1, 2)"""
EDGES = """edges as (select distinct dataset, least(src, dst) as u, greatest(src, dst) as v from graph_edges where src is not null and dst is not null and src <> dst)"""
ADJ = f"""{EDGES}, adj as (select dataset, u as src, v as dst from edges union all select dataset, v, u from edges)"""


def skey(c: str) -> str:
    return f"replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '-', '_')"


def sstrip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x{{A0}}\\x{{85}}\\x{{2028}}\\x{{2029}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}\\x{{1680}}\\x{{202F}}\\x{{205F}}\\x0B]+|[\\s\\x{{A0}}\\x{{85}}\\x{{2028}}\\x{{2029}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}\\x{{1680}}\\x{{202F}}\\x{{205F}}\\x0B]+$', '', 'g')"


TEXTS = f"""texts as (select g.dataset, case when r.node_id >= base_offset then r.node_id - base_offset else r.node_id end as node_id,
  arg_max(t, struct_pack(a := written_at, b := record_id, c := t)) as text
  from (select *, {sstrip('summary_en')} as t from jsonl_records) r join graph_datasets g on {skey('r.dataset')} = {skey('g.dataset')} where t is not null and t <> '' group by 1, 2)"""
EMB = """emb as (select n.dataset, n.node_id, e.embedding as emb from (select n.dataset, n.node_id, (n.node_id * 31 + g.position * 17) % (select count(*) from embeddings) as vec_id
  from nodes n join graph_datasets g using (dataset)) n join embeddings e on e.vec_id = n.vec_id)"""
TEST_PAIRS = f"""test_pairs as (select distinct g.dataset, least(a, b) as u, greatest(a, b) as v from (select k, case when r.u >= base_offset then r.u - base_offset else r.u end as a, case when r.v >= base_offset then r.v - base_offset else r.v end as b
  from (select {skey('r.d')} as k, r from (select arg_max(struct_pack(d := dataset, s := split, l := label, u := node_u, v := node_v), exported_at) as r from pair_samples group by sample_id) where r.l = 1 and {skey('r.s')} in ('test', 'testing'))
  join graph_datasets g0 on k = {skey('g0.dataset')}) x join graph_datasets g on x.k = {skey('g.dataset')} where a is not null and b is not null)"""
OFFSETS = """sizes as (select dataset, max(node_id) + 1 as size from nodes group by 1),
offs as (select dataset, position, size, cast(coalesce(sum(size) over (order by position rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from graph_datasets join sizes using (dataset))"""


def with_(*ctes: str) -> str:
    return "with " + ", ".join(ctes) + " "
