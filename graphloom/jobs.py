"""Command line: the data plane of dataset building, scoring and evaluation.

    python -m graphloom.jobs nc-generate  --nodes P --adjacency P --mode stage1 --seed 7 --out P
    python -m graphloom.jobs build-lp     --nodes P --edges P --vectors P --seed 7 --out P
    python -m graphloom.jobs lp-stage     --pairs P --difficulties medium,hard --out P
    python -m graphloom.jobs score        --responses P --labels P --rules nc1 --out P
    python -m graphloom.jobs suite        --config P
    python -m graphloom.jobs accuracy     --results P
    python -m graphloom.jobs compare      --first P --second P

Paths are read by their ending (parquet, orc, json, jsonl, csv). Tables: nodes(dataset, node_id, label, split, text), edges(dataset,
src, dst), adjacency(dataset, src, dst), vectors(dataset, node_id, emb), pairs as build-lp writes them, responses(idx, response),
labels(idx, gold), results(key, predicted, gold array)."""

from __future__ import annotations

import argparse
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import rewards as rw
from graphloom.functions import text as tx
from graphloom.operators import datasets as ds
from graphloom.operators import evaluate as ev
from graphloom.operators import graph as g
from graphloom.operators import registry as rg
from graphloom.operators import retrieve as rt
from graphloom.operators import rollout as ro
from graphloom.operators.ranking import numbered
from graphloom.session import materialise
from graphloom.sources import readers as rd
from graphloom.sources import writers as wr

RULES = {"nc1": (rw.NC_STAGE1, False), "nc2": (rw.NC_STAGE2, False), "lp1": (rw.LP_STAGE1, True), "lp2": (rw.LP_STAGE2, True)}
BY = ["dataset"]


def difficulties(text: str) -> list[str]:
    found = [x.strip().lower() for x in text.split(",") if x.strip()]
    if not found:
        raise ValueError("no difficulty is named")
    return found


def nc_generate(nodes: DataFrame, adjacency: DataFrame, mode: str, seed: int, counts: dict[str, int], split: str = "train", size: int = 1000, blocked: DataFrame | None = None) -> DataFrame:
    """Samples for node classification: dataset, node_id, text, difficulty (null for eval). Difficulty is taken over all nodes with a
    text, then the split's nodes are drawn; blocked (dataset, node_id) are left out; too few candidates are an error."""
    valid = nodes.where("text is not null and trim(text) <> ''")
    if mode == "eval":
        pool = valid.where(F.col("split") == split)
        return ds.seeded_sample(pool, BY, size, seed, ["dataset", "node_id"]).select("dataset", "node_id", "text", F.lit(None).cast("string").alias("difficulty"))
    level = g.tercile_nodes(g.homophily(valid, adjacency, BY), BY).drop("score")
    pool = valid.where(F.col("split") == split).join(level, ["dataset", "node_id"]).select("dataset", "node_id", "text", "difficulty")
    if blocked is not None:
        pool = ds.without(pool, blocked, on=["dataset", "node_id"])
    short = ds.short_of(pool, BY, "difficulty", counts).head(1)
    if short:
        raise ValueError(f"{short[0].dataset} has {short[0].have} {short[0].difficulty} nodes of {short[0].want}")
    return ds.stratified(pool, BY, "difficulty", counts, seed, ["dataset", "node_id"])


def _negatives(nodes: DataFrame, edges: DataFrame, wanted: int, seed: int) -> DataFrame:
    """negative_pairs with more tries until every graph has the wanted number; a warning names a graph that still has fewer."""
    for tries in (4, 64):
        found = materialise(ds.negative_pairs(nodes, edges, wanted, seed, tries))
        have = nodes.select("dataset").distinct().join(found.groupBy("dataset").agg(F.count("*").alias("n")), "dataset", "left")
        short = have.where(F.coalesce("n", F.lit(0)) < wanted).head(1)
        if not short:
            break
    else:
        warnings.warn(f"{short[0].dataset} has {short[0].n or 0} negative pairs of {wanted}", stacklevel=2)
    return found


def drawn_pairs(nodes: DataFrame, e: DataFrame, seed: int, train: tuple[int, int], test: tuple[int, int]) -> DataFrame:
    """dataset, u, v, label, split of the positives and negatives, train and test without overlap; e: canonical edges. Negatives are drawn over the
    range of ids, so where ids have gaps an end may be no node."""
    keys = ["dataset", "u", "v"]
    pos_train = ds.seeded_sample(e, BY, train[0], seed, keys)
    pos_test = ds.seeded_sample(ds.without(e, pos_train, on=keys), BY, test[0], seed + 1, keys)
    neg_all = _negatives(nodes, e, train[1] + test[1], seed)
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(ds.seeded(seed, *keys), *keys))
    neg = neg_all.withColumn("_r", rank)
    part = lambda df, label, split: df.select(*keys, F.lit(label).alias("label"), F.lit(split).alias("split"))
    return materialise(part(pos_train, 1, "train").union(part(pos_test, 1, "test")).union(part(neg.where(F.col("_r") <= train[1]), 0, "train")).union(part(neg.where(F.col("_r") > train[1]), 0, "test")))


def build_lp(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, seed: int, train: tuple[int, int], test: tuple[int, int], k: int = 10) -> DataFrame:
    """Link-prediction pairs: positives and negatives for train and test without overlap, similarity, difficulty terciles (train), pair
    ids in bucketed order, the k most similar reference edges (all edges but test positives) and common neighbours. A negative with an end that
    is no node has neither similarity, difficulty nor reference edges; an edge without a vector is an error."""
    e = materialise(g.canonical_edges(edges, by=BY))
    keys = ["dataset", "u", "v"]
    pairs = drawn_pairs(nodes, e, seed, train, test)
    pos_test = pairs.where("label = 1 and split = 'test'")
    end = lambda c: vectors.select("dataset", F.col("node_id").alias(c))
    whole = pairs.join(end("u"), ["dataset", "u"], "left_semi").join(end("v"), ["dataset", "v"], "left_semi")
    whole = whole.select(*pairs.columns).union(ds.without(pairs.where("label = 1"), whole, on=keys))  # an edge without a vector fails in pair_vectors
    measured = materialise(ds.pair_vectors(whole, vectors))
    p = materialise(pairs.join(measured.select(*keys, "similarity", "vector"), keys, "left").select(*pairs.columns, "similarity", "vector"))
    level = g.tercile_pairs(p.where("split = 'train' and similarity is not null").withColumn("_tie", ds.seeded(seed, *keys)), ["dataset", "label"], F.col("label") == 1, tie="_tie").select(*keys, "difficulty")
    p = p.join(level, keys, "left")
    order = F.when(F.col("difficulty") == "easy", 0).when(F.col("difficulty") == "medium", 1).when(F.col("difficulty") == "hard", 2).otherwise(3)
    p = materialise(numbered(p.withColumn("_o", order), [F.col("dataset"), F.col("split"), F.col("_o"), ds.seeded(seed, *keys)], "_p").drop("_o"))
    first = p.groupBy("dataset", "split").agg(F.min("_p").alias("_f"))
    p = p.join(first, ["dataset", "split"]).withColumn("pair_id", F.col("_p") - F.col("_f")).drop("_p", "_f")
    pool = ds.pair_vectors(ds.without(e, pos_test, on=keys), vectors)
    named = lambda df: df.select("dataset", F.xxhash64(*keys).alias("node_id"), F.col("vector").alias("emb"), "u", "v", "similarity")
    ref = named(pool)
    ask = named(p.where("vector is not null")).select(F.col("node_id").alias("qid"), "dataset", "node_id", "emb")
    hits = rt.similar_candidates(ask.select("qid", "dataset", "node_id"), ask.select("dataset", "node_id", "emb"), k, pool=ref.select("dataset", "node_id", "emb"))
    hits = hits.join(ref.select("dataset", F.col("node_id").alias("cand"), F.col("u").alias("ru"), F.col("v").alias("rv")), ["dataset", "cand"])
    top = rt.ranked(hits, ["qid"], "score", "cand", k).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", F.col("ru").alias("node_u"), F.col("rv").alias("node_v"), F.col("score").alias("similarity"), F.lit(True).alias("is_edge")))).alias("similar_pairs")
    )
    out = p.withColumn("qid", F.xxhash64(*keys)).join(top, "qid", "left").drop("qid", "vector")
    hops = g.hop_lists(g.both_ways(e, BY), BY)
    return wr.pair_payload(ds.hop_payload(out, hops).withColumnRenamed("common_hop", "common_1hop").withColumnRenamed("node_u_hop", "node_u_1hop").withColumnRenamed("node_v_hop", "node_v_1hop"))


def lp_stage(pairs: DataFrame, levels: list[str]) -> DataFrame:
    return pairs.where(F.lower(F.coalesce("difficulty", F.lit("medium"))).isin(levels))


def score(responses: DataFrame, labels: DataFrame, rules: str) -> DataFrame:
    r, link = RULES[rules]
    gold = labels.select("idx", F.col("gold").cast("int" if link else "string").alias("gold"))
    return responses.join(gold, "idx", "left").select("idx", rw.total(F.col("response"), F.col("gold"), r, link).alias("reward"))


def embed(spark: SparkSession, path: str, texts: DataFrame, encoder) -> DataFrame:
    """Warms the embedding cache: vectors of (dataset, node_id, text), written once to path and read from there afterwards."""
    return rd.cached_vectors(spark, path, lambda: rd.remote_vectors(texts, "text", encoder).select("dataset", "node_id", F.col("embedding").alias("emb")))


def evaluate(samples: DataFrame, generate: ro.Generator, retrieve: ro.Retriever, rounds: int = 12, searches: int = 5) -> DataFrame:
    """samples: qid, dataset, prompt, gold -> accuracy per dataset of the answers that the rollouts end with."""
    done = ro.rollout(samples, generate, retrieve, rounds, searches)
    said = done.select("qid", F.when(F.col("transcript").contains(tx.ANSWER[0]), tx.last_body(F.col("transcript"), tx.ANSWER)).alias("predicted"))
    return ev.accuracy(samples.select("qid", "dataset", F.array("gold").alias("gold")).join(said, "qid"), BY)


#: What every run of a suite must name.
RUN_KEYS = ("name", "datasets", "samples", "out")


def suite(spark: SparkSession, config: str, generate: ro.Generator, retrieve: ro.Retriever, dry_run: bool = False) -> list[tuple[str, str]]:
    """The runs of a configuration, each over its datasets: (name, dataset) in order. A run reads `samples` (qid, dataset, prompt, gold),
    evaluates one dataset at a time and appends the accuracy to `out`; dry_run only says what would run. A run that lacks a key is
    an error, before anything runs; so is a configuration without runs."""
    runs = [(r["name"], r["options"]) for r in rd.run_options(spark, config).collect()]  # a handful
    if not runs:
        raise ValueError("the configuration has no runs")
    for name, o in runs:
        missing = [k for k in RUN_KEYS if not o.get(k)]
        if missing:
            raise ValueError(f"run {name} lacks {', '.join(missing)}")
    done = []
    for name, o in runs:
        for dataset in [x.strip() for x in o["datasets"].split(",") if x.strip()]:
            done.append((name, dataset))
            if not dry_run:
                part = rd.read_any(spark, o["samples"]).where(F.col("dataset") == dataset)
                found = evaluate(part, generate, retrieve, int(o.get("rounds", 12)), int(o.get("searches", 5)))
                wr.append_log(found.withColumn("run", F.lit(name)), o["out"])
    return done


def iterate(prompts: DataFrame, key: str, generate, score, kind: str, rows: int, iterations: int, samples: int) -> DataFrame:
    """Iterations of generate, score and post-process over a window of `rows` prompts each, in order of the key. generate(df with sample,
    iteration) adds output; score adds reward; kind names the post-processor. Every iteration is a written table; a model that is trained between
    them plugs in through generate. Columns of the post-processor, and iteration."""
    out = None
    placed = materialise(numbered(prompts, [F.col(key)], "_at"))
    for i in range(iterations):
        window = placed.where((F.col("_at") >= i * rows) & (F.col("_at") < (i + 1) * rows)).drop("_at")
        wide = window.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        scored = score(generate(wide, i)).select(F.col(key).alias("input"), "output", "reward", F.col("sample").alias("pos"))
        part = materialise(rg.processor(kind)(scored).withColumn("iteration", F.lit(i)))
        out = part if out is None else out.unionByName(part)
    return out


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="graphloom.jobs")
    s = a.add_subparsers(dest="job", required=True)

    def sub(name: str, paths: list[str], **more):
        p = s.add_parser(name)
        for x in paths:
            p.add_argument(f"--{x}", required=True)
        for x, default in more.items():
            p.add_argument(f"--{x.replace('_', '-')}", type=type(default), default=default)
        return p

    sub("nc-generate", ["nodes", "adjacency", "mode", "out"], seed=0, split="train", size=1000, easy=1000, medium=500, hard=500, blocked="")
    sub("build-lp", ["nodes", "edges", "vectors", "out"], seed=0, train_positive=1500, train_negative=1500, test_positive=500, test_negative=500, k=10)
    sub("lp-stage", ["pairs", "out"], difficulties="medium,hard")
    sub("score", ["responses", "labels", "out"], rules="nc1")
    sub("suite", ["config"], dry_run=1)
    sub("accuracy", ["results"])
    sub("compare", ["first", "second"])
    o = a.parse_args(argv)
    spark = SparkSession.builder.appName(f"graphloom {o.job}").getOrCreate()
    read = lambda x: rd.read_any(spark, getattr(o, x))
    if o.job == "nc-generate":
        counts = {"easy": o.easy, "medium": o.medium, "hard": o.hard} if o.mode == "stage1" else {"medium": o.medium, "hard": o.hard}
        blocked = rd.read_any(spark, o.blocked) if o.blocked else None
        wr.write_jsonl(nc_generate(read("nodes"), read("adjacency"), o.mode, o.seed, counts, o.split, o.size, blocked), o.out, by=BY)
    elif o.job == "build-lp":
        wr.write_jsonl(build_lp(read("nodes"), read("edges"), read("vectors"), o.seed, (o.train_positive, o.train_negative), (o.test_positive, o.test_negative), o.k), o.out, by=["dataset", "split"])
    elif o.job == "lp-stage":
        wr.write_jsonl(lp_stage(read("pairs"), difficulties(o.difficulties)), o.out)
    elif o.job == "score":
        wr.append_log(score(read("responses"), read("labels"), o.rules), o.out)
    elif o.job == "suite":
        if not o.dry_run:
            raise SystemExit("a model is needed: call jobs.suite with its generator; the command line only shows what would run")
        print("\n".join(f"{name}: {dataset}" for name, dataset in suite(spark, o.config, ro.scripted, None, dry_run=True)))
    elif o.job == "accuracy":
        ev.accuracy(read("results"), []).show()
    else:
        ev.compared(read("first"), read("second"), "key").show()


if __name__ == "__main__":
    main()
