"""Queries of plug-in points, side files, caches, batches and jobs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from graphloom import jobs
from graphloom.functions import vectors as vx
from graphloom.operators import hooks as hk
from graphloom.operators import mixing as mx
from graphloom.plans import base as b
from graphloom.plans.eval_plans import _folder
from graphloom.plans.registry import query
from graphloom.session import table
from graphloom.sources import readers as rd
from graphloom.sources import writers as wr


@query("best_of_generations", "select item_id, concat(text, ' #', cast(2 - item_id % 3 as varchar)) as output, 2 as reward from eval_items")
def best_of_generations(s, d):
    """Three generations of each prompt; the scorer likes the one whose number and the item's add up to 2 modulo 3."""
    prompts = table(s, d, "eval_items").select("item_id", "text")
    generate = lambda x: x.withColumn("output", F.concat("text", F.lit(" #"), F.col("sample").cast("string")))
    score = lambda x: x.withColumn("reward", ((F.col("sample") + F.col("item_id")) % 3).cast("int"))
    return hk.best_of_n(prompts, "item_id", 3, generate, score)


@query("model_scores", "select item_id, length(text)::double as reward from eval_items")
def model_scores(s, d):
    """A model's score of every text; the model here is the text's length."""
    return hk.scored(table(s, d, "eval_items").select("item_id", "text"), "text", lambda: lambda texts: [float(len(t)) for t in texts]).select("item_id", "reward")


@query("remote_rewards", "select item_id, (2 * length(text) + 1)::double as reward from eval_items")
def remote_rewards(s, d):
    """The sum of three services' rewards."""
    size = lambda texts: [float(len(t)) for t in texts]
    return hk.summed_rewards(table(s, d, "eval_items").select("item_id", "text"), "text", [size, size, lambda texts: [1.0] * len(texts)]).select("item_id", "reward")


@query("demo_rewards", "select item_id, (cast(concat('0x', substr(md5(concat_ws(':', '9', cast(item_id as varchar))), 1, 8)) as bigint) % 4 - 1)::int as reward from eval_items")
def demo_rewards(s, d):
    return hk.demo_reward(table(s, d, "eval_items").select("item_id"), 9, ["item_id"])


@query("experience_append", "select item_id, task from eval_items union all select item_id, upper(task) from eval_items")
def experience_append(s, d):
    i = table(s, d, "eval_items").select("item_id", "task")
    return hk.appended(i, i.withColumn("task", F.upper("task")))


@query("remote_embeddings", "select item_id, [length(text)::double, 1.0::double] as embedding from eval_items")
def remote_embeddings(s, d):
    return rd.remote_vectors(table(s, d, "eval_items").select("item_id", "text"), "text", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).select("item_id", "embedding")


@query("remote_search", "select item_id, [upper(task), split] as docs from eval_items")
def remote_search(s, d):
    """A search service: a list of texts for each query."""
    q = table(s, d, "eval_items").select("item_id", F.concat_ws("|", "task", "split").alias("query"))
    return rd.remote_documents(q, "query", lambda: lambda queries: [[x.split("|")[0].upper(), x.split("|")[1]] for x in queries]).select("item_id", "docs")


@query("pair_sources", f"""with c as (select {b.skey('dataset')} as dataset, {b.skey('split')} as split, count(distinct sample_id) as pairs from pair_samples where split is not null group by 1, 2), p as (select *, row_number() over (order by dataset, split) as position from c)
 select dataset, split, pairs, cast(coalesce(sum(pairs) over (order by position rows between unbounded preceding and 1 preceding), 0) as bigint) as base_offset from p""")
def pair_sources(s, d):
    """The registry of pair files: a dataset and split stands in it once; offsets follow the order of the files."""
    c = table(s, d, "pair_samples").where("split is not null").groupBy(b.key("dataset").alias("dataset"), b.key("split").alias("split")).agg(F.countDistinct("sample_id").alias("pairs"))
    from pyspark.sql import Window

    files = c.withColumn("position", F.row_number().over(Window.orderBy("dataset", "split")))  # one row per dataset and split
    return rd.source_registry(files).select("dataset", "split", "pairs", "base_offset")


@query("category_lines", b.with_(b.NODES) + "select distinct dataset as name, label as category from nodes where label is not null")
def category_lines(s, d):
    """Categories written as lines of names and lists, and read back."""
    path = _folder(s)
    n = b.nodes(s, d).where("label is not null").select("dataset", "label").distinct()  # categories are few
    lists = n.groupBy("dataset").agg(F.array_sort(F.collect_set("label")).alias("l"))
    line = F.concat(F.lit("'"), F.col("dataset"), F.lit("': ["), F.array_join(F.transform("l", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    lists.select(line.alias("value")).write.text(path)
    return rd.category_dictionary(s, path)


@query("discovered_graphs", "select dataset from graph_datasets")
def discovered_graphs(s, d):
    """Folders of graphs below a root, found by their marker file."""
    root = _folder(s)
    for r in table(s, d, "graph_datasets").select("dataset").collect():  # one row per graph
        s.range(1).selectExpr("'[]' as value").write.text(f"{root}/{r.dataset}/node_texts.json")
    s.range(1).selectExpr("'x' as value").write.text(f"{root}/no-graph/other.json")
    return s.createDataFrame([(x,) for x in rd.discovered(root)], "dataset string")


@query("top_pairs_file", "select dataset, position::bigint as node_u, position + 1::bigint as node_v, true as is_edge, position::int as rank from graph_datasets")
def top_pairs_file(s, d):
    """The side file of top pairs; where there is none, no rows."""
    path = _folder(s)
    g = table(s, d, "graph_datasets").select("dataset", F.col("position").cast("long").alias("node_u"), (F.col("position") + 1).cast("long").alias("node_v"), F.lit(True).alias("is_edge"), F.col("position").alias("rank"))
    wr.write_jsonl(g, path)
    return rd.pagerank_pairs(s, path).union(rd.pagerank_pairs(s, f"{path}-absent"))


@query("run_configurations", "select dataset as name, case when position % 2 = 0 then 'own' else 'all' end as mode, '5' as k from graph_datasets")
def run_configurations(s, d):
    path = _folder(s)
    runs = [{"name": r.dataset} | ({"mode": "own"} if r.position % 2 == 0 else {}) for r in table(s, d, "graph_datasets").collect()]  # one row per graph
    s.createDataFrame([(json.dumps({"shared": {"mode": "all", "k": "5"}, "runs": runs}),)], "value string").coalesce(1).write.text(path)
    return rd.run_options(s, path).select("name", F.col("options")["mode"].alias("mode"), F.col("options")["k"].alias("k"))


@query("sink_rewritten", "select item_id, upper(task) as task from eval_items")
def sink_rewritten(s, d):
    """A table rewritten from itself, the old one kept beside it."""
    path = _folder(s)
    table(s, d, "eval_items").select("item_id", "task").write.parquet(path)
    wr.rewritten(s.read.parquet(path).withColumn("task", F.upper("task")), path)
    assert s.read.parquet(f"{path}.bak").count() == s.read.parquet(path).count()
    return s.read.parquet(path)


@query("sink_named", "select item_id, replace(lower(trim(dataset)), '_', '-') as dataset from eval_items")
def sink_named(s, d):
    rows = table(s, d, "eval_items").select("item_id", F.translate(F.lower(F.trim("dataset")), "_", "-").alias("dataset"))
    paths = wr.named_outputs(rows, _folder(s), "stage1", 200)
    assert all(p.endswith("_stage1_200.jsonl") for p in paths)
    return s.read.schema("item_id long, dataset string").json(paths)


@query("embedding_cache", "select vec_id, len(embedding)::int as dims from embeddings")
def embedding_cache(s, d):
    """Vectors are made and written once; the second call reads the cache."""
    path = _folder(s)
    make = lambda: table(s, d, "embeddings").select("vec_id", "embedding")
    rd.cached_vectors(s, path, make)

    def never():
        raise AssertionError("the cache was not read")

    return rd.cached_vectors(s, path, never).select("vec_id", F.size("embedding").alias("dims"))


@query("observed_metrics", "select count(*) as n, round(sum(value), 2) as total from events")
def observed_metrics(s, d):
    """Aggregates gathered while the rows are written."""
    df, seen = hk.observed(table(s, d, "events"), "run", n=F.count(F.lit(1)), total=F.sum("value"))
    df.select("event_id").write.parquet(_folder(s))
    return s.createDataFrame([(seen.get["n"], round(seen.get["total"], 2))], "n long, total double")


@query("replay_minibatch", "select event_id from (select event_id, row_number() over (order by md5(concat_ws(':', '5', cast(event_id as varchar))), event_id) as r from events) where r <= 64")
def replay_minibatch(s, d):
    return mx.minibatch(table(s, d, "events").select("event_id"), 64, 5, ["event_id"])


_SIDES = "sq as (select o_custkey as seq, list(o_orderkey order by o_orderkey) as ids from orders group by 1), sides as (select *, 'chosen' as side from sq where seq % 2 = 0 union all select *, 'rejected' from sq where seq % 2 = 1)"


@query("preference_batch", f"with {_SIDES} select seq, side, list_concat(ids, list_transform(range(0, (select max(len(ids)) from sides) - len(ids)), lambda x: -1::bigint)) as ids from sides")
def preference_batch(s, d):
    """Chosen and rejected sequences in one batch, padded to the longest."""
    q = table(s, d, "orders").groupBy(F.col("o_custkey").alias("seq")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return mx.concatenated(q.where("seq % 2 = 0"), q.where("seq % 2 = 1"), "ids", -1)


@query("parameter_ema", """with n as (select count(*) as c from embeddings), p as (select a.vec_id, a.embedding::double[] as old, b.embedding::double[] as new from embeddings a cross join n join embeddings b on b.vec_id = (a.vec_id + 1) % n.c)
 select vec_id, round(list_sum(list_transform(list_zip(old, new), lambda z: 0.992::double * z[1] + 0.008::double * z[2])), 6) as total from p""")
def parameter_ema(s, d):
    """The moving average of parameters: 0.992 of the old vector and the rest of the new one, element by element."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count("*").alias("c"))  # one row
    new = e.crossJoin(F.broadcast(n)).select(F.pmod(F.col("vec_id") - 1, F.col("c")).alias("vec_id"), F.col("embedding").alias("new"))
    averaged = vx.blended(F.col("embedding"), F.col("new"), 0.992)
    return e.join(new, "vec_id").select("vec_id", F.round(F.aggregate(averaged, F.lit(0.0), lambda x, y: x + y), 6).alias("total"))


@query("job_iterations", """with p as (select item_id, (row_number() over (order by item_id) - 1) // 64 as iteration from eval_items), g as (select item_id, iteration, s as sample, (item_id * 7 + s * 5) % 11 as reward from p, range(0, 4) t(s) where iteration < 3)
 select iteration::int as iteration, item_id as input, cast(arg_max(sample, reward * 10 - sample) as varchar) as chosen, cast(arg_min(sample, reward * 10 + sample) as varchar) as rejected from g group by 1, 2""")
def job_iterations(s, d):
    """Three iterations of 64 prompts: four generations each, scored, the best and the worst kept as a preference pair."""
    prompts = table(s, d, "eval_items").select(F.col("item_id").alias("input"))
    generate = lambda x, i: x.withColumn("output", F.col("sample").cast("string"))
    score = lambda x: x.withColumn("reward", ((F.col("input") * 7 + F.col("sample") * 5) % 11).cast("double"))
    return jobs.iterate(prompts, "input", generate, score, "iter_dpo", rows=64, iterations=3, samples=4).select("iteration", "input", "chosen", "rejected")


@query("job_evaluation", "select dataset, count(*) as total, count(*) filter (item_id % 4 < 3) as \"right\" from (select item_id, replace(lower(trim(dataset)), '-', '_') as dataset from eval_items) group by 1")
def job_evaluation(s, d):
    """Scripted rollouts answer with their own id; the gold label is that id for three quarters of the items."""
    from graphloom.operators import rollout as ro

    i = table(s, d, "eval_items").select(F.col("item_id").alias("qid"), b.key("dataset").alias("dataset"), F.col("text").alias("prompt"), F.when(F.col("item_id") % 4 < 3, F.col("item_id").cast("string")).otherwise(F.lit("other")).alias("gold"))
    none = lambda asking: asking.select("qid", F.lit("None\n").alias("docs"))
    return jobs.evaluate(i, ro.scripted, none, rounds=6, searches=2).select("dataset", "total", "right")
