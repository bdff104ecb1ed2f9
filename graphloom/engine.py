"""The retriever as an object: one or several graphs, four strategies, batches of queries in one plan.

Graphs come as tables keyed by dataset, so many graphs are one plan and not one object each; global ids are routed by offset."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import graph as g
from graphloom.operators import retrieve as rt
from graphloom.session import bounded, materialise
from graphloom.sources import readers as rd

BY = ["dataset"]
_ENGINES: dict[tuple, GraphEngine] = {}


@dataclass
class GraphEngine:
    """nodes: dataset, node_id, label, text, pagerank (may be null); adjacency: dataset, src, dst; vectors: dataset, node_id, emb.

    limits: documents per strategy; default_k where a strategy has none; share: weight of the query text in the fused vector."""

    nodes: DataFrame
    adjacency: DataFrame
    vectors: DataFrame
    default_k: int = 5
    limits: dict[str, int] = field(default_factory=dict)
    share: float = 0.5
    preview: int = 480

    @staticmethod
    def shared(spark: SparkSession, root: str, names: list[str], **options) -> GraphEngine:
        """from_folders, once per root, names and options: later calls of the session get the same engine."""
        key = (id(spark), root, tuple(names), tuple(sorted((k, str(v)) for k, v in options.items())))
        if key not in _ENGINES:
            _ENGINES[key] = GraphEngine.from_folders(spark, root, names, **options)
        return _ENGINES[key]

    @staticmethod
    def from_folders(spark: SparkSession, root: str, names: list[str], **options) -> GraphEngine:
        """Graph folders with node_texts.json, category.json, first_hop_indices.json and node_emb.npy, as one engine."""
        from graphloom.sources.npy import NpySource

        spark.dataSource.register(NpySource)
        nodes = adj = vec = None
        both = lambda a, b: b if a is None else a.unionByName(b)
        for name in names:
            d = next((f"{root.rstrip('/')}/{s}" for s in rd.spellings(name) if rd.exists(f"{root.rstrip('/')}/{s}")), None)
            if d is None:
                raise FileNotFoundError(f"no folder for {name} below {root}")
            array = lambda f, d=d: rd.json_array(spark, f"{d}/{f}")
            n = rd.node_texts(array("node_texts.json")).drop("path").join(rd.categories(array("category.json")).drop("path"), "node_id", "full")
            nodes = both(nodes, n.select(F.lit(name).alias("dataset"), "node_id", "label", "text", F.lit(None).cast("double").alias("pagerank")))
            hop = rd.neighbour_lists(array("first_hop_indices.json"))
            adj = both(adj, hop.select(F.lit(name).alias("dataset"), F.col("node_id").alias("src"), F.explode("hop").alias("dst")))
            vec = both(vec, spark.read.format("npy").load(f"{d}/node_emb.npy").select(F.lit(name).alias("dataset"), F.col("pos").alias("node_id"), F.col("values").alias("emb")))
        return GraphEngine(nodes, adj, vec, **options)

    def check(self) -> None:
        """Texts, labels and vectors must be there for the same nodes, and neighbours must be nodes."""
        n, v = self.nodes.count(), self.vectors.count()
        if n != v:
            raise ValueError(f"{n} nodes but {v} vectors")
        key = ["dataset", "node_id"]
        lost = self.adjacency.select("dataset", F.col("dst").alias("node_id")).join(self.nodes, key, "left_anti").head(1)
        if lost:
            raise ValueError(f"neighbour {lost[0].node_id} of {lost[0].dataset} is no node")

    def offsets(self) -> DataFrame:
        """dataset, size, offset in the order of the names: one row per graph."""
        sizes = self.nodes.groupBy("dataset").agg((F.max("node_id") + 1).alias("size"))
        w = Window.orderBy("dataset").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)))

    def locate(self, queries: DataFrame) -> DataFrame:
        """gid -> dataset and node_id; ids beyond all graphs are an error."""
        j = queries.join(bounded(self.offsets(), 100_000, "graphs"), (F.col("gid") >= F.col("offset")) & (F.col("gid") < F.col("offset") + F.col("size")), "left")
        fail = F.raise_error(F.concat(F.lit("no graph holds node "), F.col("gid").cast("string")))
        return j.withColumn("node_id", F.when(F.col("dataset").isNull(), fail).otherwise(F.col("gid") - F.col("offset")).cast("long")).drop("offset", "size")

    def hits(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The parsed queries, and their documents without texts: qid, dataset, node_id, strategy, k, cand, score, doc_id."""
        q = queries if "dataset" in queries.columns else self.locate(queries)
        asked = materialise(rt.parsed_queries(q, self.default_k, self.limits))
        most = max([self.default_k, *self.limits.values()])
        if "max_results" in queries.columns:
            most = max(most, queries.agg(F.max(F.col("max_results").try_cast("int"))).first()[0] or 0)
        of = lambda s: asked.where(F.col("strategy") == s)
        cols = ["qid", "dataset", "node_id", "strategy", "k", "cand", "score"]
        adjacency = materialise(self.adjacency.select("dataset", "src", "dst").distinct())
        vectors = materialise(self.vectors.select("dataset", "node_id", "emb"))
        near = rt.hop_best(of("one_hop"), adjacency, vectors, most, 1, self.share)
        far = rt.hop_best(of("two_hop"), adjacency, vectors, most, 2, self.share)
        sim = rt.similar_candidates(of("similar"), vectors, most)
        degree = g.degrees(adjacency, BY).withColumn("degree", F.col("degree").cast("double"))
        rank = self.nodes.join(degree, ["dataset", "node_id"], "left").select("dataset", "node_id", F.coalesce("pagerank", "degree", F.lit(0.0)).alias("pagerank"))
        pr = rt.pagerank_candidates(of("pagerank"), rank, most).select(*cols)
        found = near.union(far).union(sim).join(asked.select("qid", "strategy", "k"), "qid").select(*cols)
        return asked, rt.ranked(found.union(pr), ["qid"], "score", "cand", F.col("k"), most=most)

    def batch_query(self, queries: DataFrame) -> DataFrame:
        """queries: qid, query, and dataset with node_id or gid; maybe max_results -> one row per query in no order: qid, strategy,
        score_name, target, docs (ranked list of doc_id, node_id, score, doc). A query without candidates has an empty list."""
        asked, hits = self.hits(queries)
        docs = rt.as_documents(hits, self.nodes.select("dataset", "node_id", F.when(F.col("text") != "", F.col("text")).alias("text")), self.preview)
        lists = docs.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.col("cand").alias("node_id"), "score", "doc"))).alias("docs"))
        target = self.nodes.select("dataset", "node_id", F.struct("node_id", tx.preview(F.col("text"), self.preview).alias("text_preview"), "label").alias("target"))
        out = asked.join(target, ["dataset", "node_id"], "left").join(lists, "qid", "left")
        missing = F.raise_error(F.concat(F.lit("node out of range: "), F.col("node_id").cast("string")))
        none = F.array().cast(lists.schema["docs"].dataType)
        return out.select(
            "qid",
            "dataset",
            "strategy",
            F.when(F.col("strategy") == "pagerank", "pagerank").otherwise("similarity").alias("score_name"),
            F.when(F.col("target").isNull(), missing).otherwise(F.col("target")).alias("target"),
            F.coalesce("docs", none).alias("docs"),
        )


@dataclass
class LinkEngine:
    """Retrieval for node pairs. pairs: pair_id, dataset, split, node_u, node_v, label, common_1hop, node_u_1hop, node_v_1hop, (the same
    with _2hop), similar_pairs; texts: dataset, node_id, text; top_pairs: dataset, node_u, node_v, is_edge, rank (may be None)."""

    pairs: DataFrame
    texts: DataFrame
    top_pairs: DataFrame | None = None
    default_k: int = 5
    limits: dict[str, int] = field(default_factory=dict)
    seed: int = 20240101

    def batch_query(self, queries: DataFrame) -> DataFrame:
        """queries: qid, pair_id, query -> qid, strategy, score_name, doc_id, doc: one row per document."""
        kind = tx.search_kind(F.col("query"))
        k = F.lit(self.default_k)
        for name, n in self.limits.items():
            k = F.when(kind == name, F.lit(n)).otherwise(k)
        q = queries.select("qid", "pair_id", kind.alias("strategy"), F.greatest(k, F.lit(0)).alias("k")).join(self.pairs, "pair_id")
        most = max([self.default_k, *self.limits.values()])
        docs = None
        for strategy, hop, shift in (("one_hop", "1hop", 0), ("two_hop", "2hop", 17)):
            if f"common_{hop}" in self.pairs.columns:
                r = rt.neighbour_roles(q.where(F.col("strategy") == strategy), f"common_{hop}", f"node_u_{hop}", f"node_v_{hop}", most, self.seed + shift)
                head = F.when(F.col("role") == "common", F.lit(f"[common {strategy} neighbour] ")).otherwise(F.concat(F.lit("[Node "), F.upper("role"), F.lit(f" {strategy} neighbour] ")))
                tail = F.when(F.col("role") == "common", F.lit(" It is joined to both nodes.")).otherwise(F.concat(F.lit(" It is joined to node "), F.upper("role"), F.lit(" only.")))
                r = self._texts(r, "neighbour", "t").select("qid", "strategy", "k", "doc_id", F.concat(head, F.col("t"), tail).alias("doc"))
                docs = r if docs is None else docs.union(r)
        s = q.where("strategy = 'similar'").select("qid", "strategy", "k", "dataset", F.posexplode(F.slice(F.coalesce("similar_pairs", F.array().cast(self.pairs.schema["similar_pairs"].dataType)), 1, most)).alias("i", "p"))
        s = s.select("qid", "strategy", "k", "dataset", (F.col("i") + 1).alias("doc_id"), F.col("p.node_u").alias("a"), F.col("p.node_v").alias("b"), F.col("p.is_edge").alias("is_edge"))
        docs = self._pair_docs(s, "[similar pair] ", "existing edge", "reference pair", docs)
        if self.top_pairs is not None:
            t = self.top_pairs.select("dataset", F.col("node_u").alias("a"), F.col("node_v").alias("b"), "is_edge", "rank")
            best = Window.partitionBy("dataset").orderBy("rank", "a", "b")
            t = t.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most + 2).drop("_n")  # a query leaves out its own pair, either way round
            p = q.where("strategy = 'pagerank'").join(t, "dataset").where("not (a in (node_u, node_v) and b in (node_u, node_v))")
            p = p.withColumn("doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "a", "b"))).where(F.col("doc_id") <= most)
            docs = self._pair_docs(p.select("qid", "strategy", "k", "dataset", "doc_id", "a", "b", "is_edge"), "[pagerank] ", "high-ranked edge", "high-ranked pair", docs)
        name = F.when(F.col("strategy").isin("one_hop", "two_hop"), "coverage").otherwise("reference")
        return docs.where("doc_id <= k").select("qid", "strategy", name.alias("score_name"), "doc_id", "doc")

    def _texts(self, df: DataFrame, node: str, name: str) -> DataFrame:
        t = self.texts.select("dataset", F.col("node_id").alias(node), tx.preview_within(F.col("text")).alias(name))
        return df.join(t, ["dataset", node], "left").withColumn(name, F.coalesce(name, F.concat(F.lit("Node "), F.col(node).cast("string"))))

    def _pair_docs(self, df: DataFrame, head: str, yes: str, no: str, docs: DataFrame | None) -> DataFrame:
        j = self._texts(self._texts(df, "a", "ta"), "b", "tb")
        doc = F.concat(F.lit(head), F.when(F.col("is_edge"), F.lit(yes)).otherwise(F.lit(no)), F.lit(". First node: "), F.col("ta"), F.lit(". Second node: "), F.col("tb"), F.lit("."))
        r = j.select("qid", "strategy", "k", "doc_id", doc.alias("doc"))
        return r if docs is None else docs.union(r)
