"""Queries of evaluation, prompts, registries, sources, sinks, streaming jobs, rollouts and general analytics."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import evaluate as ev
from graphloom.operators import prompts as pr
from graphloom.operators import registry as rg
from graphloom.operators import rollout as ro
from graphloom.plans import base as b
from graphloom.plans.registry import query
from graphloom.functions import rewards as rw
from graphloom.plans.reward_plans import ROLL, _reward_sql, responses, rollouts
from graphloom.plans.text_plans import sbody
from graphloom.session import materialise, scratch_dir, table
from graphloom.sources import readers as rd
from graphloom.sources import writers as wr
from graphloom.streaming import jobs as sj

# --- evaluation ------------------------------------------------------------------------------------------------------------------

_PRED = f"""with {b.NODES}, p as (select doc_id, {b.skey('d.dataset')} as dataset, {sbody('d.text', 'answer')} as predicted, n.label as gold from documents d left join nodes n on {b.skey('n.dataset')} = {b.skey('d.dataset')} and n.node_id = d.anchor_node_id)"""


def predictions(s, d):
    docs = table(s, d, "documents").select("doc_id", b.key("dataset").alias("dataset"), tx.first_body(F.col("text"), tx.ANSWER).alias("predicted"))
    gold = responses(s, d).select("doc_id", F.when(F.col("gold").isNotNull(), F.array("gold")).alias("gold"))
    return docs.join(gold, "doc_id")


@query("accuracy", _PRED + " select dataset, count(*) filter (predicted is not null and gold is not null) as total, count(*) filter (predicted = gold) as right, count(*) filter (predicted is null or gold is null) as skipped, round(100.0::double * count(*) filter (predicted = gold) / nullif(count(*) filter (predicted is not null and gold is not null), 0), 4) as percent from p group by 1".replace(" as right", ' as "right"'))
def accuracy(s, d):
    return ev.accuracy(predictions(s, d), ["dataset"])


@query("ab_compare", _PRED + """, q as (select *, coalesce(predicted = gold, false) as a, coalesce(case when doc_id % 2 = 0 then gold else predicted end = gold, false) as b from p)
 select count(*) as n, round(100 * avg(a::int), 4) as first, round(100 * avg(b::int), 4) as second, count(*) filter (not a and b) as improved, count(*) filter (a and not b) as degraded, count(*) filter (a = b) as same from q""")
def ab_compare(s, d):
    p = predictions(s, d)
    second = p.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("gold")[0]).otherwise(F.col("predicted")).alias("predicted"))
    return ev.compared(p.select("doc_id", F.coalesce("predicted", F.lit("")).alias("predicted"), "gold"), second, "doc_id")


@query("reward_histogram", "select least(floor((value - 0) / 20.0)::int + 1, 10) as bin, count(*) as n from events where value between 0 and 200 group by 1")
def reward_histogram(s, d):
    return ev.histogram(table(s, d, "events"), "value", 0.0, 200.0, 10)


@query("pairwise_accuracy", f"with {ROLL}, p as (select input, arg_max(reward, pos) as c, arg_min(reward, pos) as r from rollouts group by 1 having count(*) > 1) select round(avg((c > r)::int), 6) as accuracy, round(avg(c - r), 4) as gap from p")
def pairwise_accuracy(s, d):
    p = rollouts(s, d).groupBy("input").agg(F.max_by("reward", "pos").alias("c"), F.min_by("reward", "pos").alias("r"), F.count("*").alias("n")).where("n > 1")
    return p.agg(F.round(F.avg((F.col("c") > F.col("r")).cast("int")), 6).alias("accuracy"), F.round(F.avg(F.col("c") - F.col("r")), 4).alias("gap"))


@query("reward_mean_std", f"with {ROLL}, p as (select max(reward) as v from rollouts group by input union all select min(reward) from rollouts group by input) select round(avg(v), 3) as mean, round(greatest(stddev_samp(v), 1e-8), 3) as deviation from p")
def reward_mean_std(s, d):
    g = rollouts(s, d).groupBy("input").agg(F.max("reward").alias("c"), F.min("reward").alias("r"))
    v = g.select(F.col("c").alias("v")).union(g.select("r"))
    return v.agg(F.round(F.avg("v"), 3).alias("mean"), F.round(F.greatest(F.stddev_samp("v"), F.lit(1e-8)), 3).alias("deviation"))


@query("stored_normalisation", f"with {ROLL} select output, round((reward - 150000.0::double) / 70000.0::double, 6) as z from rollouts")
def stored_normalisation(s, d):
    stats = s.createDataFrame([(150000.0, 70000.0)], "mean double, deviation double")
    return rollouts(s, d).join(F.broadcast(stats)).select("output", F.round((F.col("reward") - F.col("mean")) / F.col("deviation"), 6).alias("z"))  # one row


@query("step_counts", "select dataset, count(*) as records, count(*) * 4 // 16 * 2 as steps, ceil(3.0 * (count(*) * 4 // 16 * 2))::bigint as total from graph_nodes group by 1")
def step_counts(s, d):
    n = table(s, d, "graph_nodes").groupBy("dataset").agg(F.count("*").alias("records"))
    steps = F.floor(F.col("records") * 4 / 16) * 2
    return n.select("dataset", "records", steps.alias("steps"), F.ceil(F.lit(3.0) * steps).alias("total"))


@query("response_lengths", "select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as tokens, least((length(text) - length(replace(text, '<|begin_of_documents|>', ''))) // 22, (length(text) - length(replace(text, '<|end_of_documents|>', ''))) // 20, 6) as retrievals from documents where text is not null")
def response_lengths(s, d):
    t = F.col("text")
    n = F.least(tx.occurrences(t, tx.DOCS[0]), tx.occurrences(t, tx.DOCS[1]), F.lit(6))
    return table(s, d, "documents").where("text is not null").select("doc_id", tx.token_count(t).cast("long").alias("tokens"), n.cast("long").alias("retrievals"))


@query("status_means", "select event_type, round(avg(value), 6) as mean_value, count(*) as n from events group by 1")
def status_means(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n"))


# --- prompts and registries ------------------------------------------------------------------------------------------------------


@query("nc_prompt", b.with_(b.NODES, b.TEXTS) + f""", c as (select dataset, string_agg(label, ', ' order by label) as classes from (select distinct dataset, label from nodes where label is not null) group by 1)
 select n.dataset, n.node_id, concat(case domain when 'paper' then 'Decide which research area the paper below belongs to.' when 'product' then 'Decide which shop category the product below belongs to.' when 'forum' then 'Decide which board the thread below belongs to.' else 'Decide which class the node below belongs to.' end,
  e'\\n', '{pr.SEARCH_HELP.replace('{k}', '5')}', case when domain in ('product', 'forum') then concat(e'\\nClasses: ', classes) else '' end, e'\\nThe ', case domain when 'paper' then 'paper' when 'product' then 'product' when 'forum' then 'thread' else 'node' end, ': ',
  case when length(t.text) > 500 then concat(left(t.text, 500), '...') else t.text end) as prompt from nodes n join graph_datasets g using (dataset) join c using (dataset) join texts t on t.dataset = n.dataset and t.node_id = n.node_id""")
def nc_prompt(s, d):
    n = b.nodes(s, d)
    c = n.where("label is not null").groupBy("dataset").agg(F.array_sort(F.collect_set("label")).alias("classes"))
    j = n.select("dataset", "node_id").join(F.broadcast(table(s, d, "graph_datasets").select("dataset", "domain")), "dataset").join(c, "dataset").join(b.texts(s, d), ["dataset", "node_id"])
    return pr.node_prompts(j).select("dataset", "node_id", "prompt")


@query("lp_prompt", b.with_(b.EDGES, b.TEXTS) + f""" select e.dataset, u, v, concat('Decide whether a ', case when contains(l, 'paper') or contains(l, 'arxiv') or contains(l, 'cite') or contains(l, 'med') then 'citation' when contains(l, 'shop') or contains(l, 'amazon') or contains(l, 'product') then 'co-purchase' when contains(l, 'forum') or contains(l, 'reddit') or contains(l, 'board') then 'shared discussion' else 'link' end,
  e' joins the two nodes; answer yes or no.\\n', '{pr.SEARCH_HELP.replace('{k}', '5')}', e'\\nNode U: ', case when length(a.text) > 480 then concat(left(a.text, 477), '...') else a.text end, e'\\nNode V: ', case when length(c.text) > 480 then concat(left(c.text, 477), '...') else c.text end) as prompt
 from (select *, lower(dataset) as l from edges) e join texts a on a.dataset = e.dataset and a.node_id = u join texts c on c.dataset = e.dataset and c.node_id = v""")
def lp_prompt(s, d):
    t = lambda x: b.texts(s, d).select("dataset", F.col("node_id").alias(x), F.col("text").alias(f"text_{x}"))
    return pr.link_prompts(b.edges(s, d).join(t("u"), ["dataset", "u"]).join(t("v"), ["dataset", "v"])).select("dataset", "u", "v", "prompt")


@query("pool_limits", "select dataset, position, coalesce(case when position % 3 = 0 then 0 when position % 3 = 1 then 7 end, nullif(position - 2, 0), 5) as lim from graph_datasets")
def pool_limits(s, d):
    p = F.col("position")
    return table(s, d, "graph_datasets").select("dataset", "position", pr.pool_limit(F.when(p % 3 == 0, 0).when(p % 3 == 1, 7), p - 2).alias("lim"))


@query("chat_template", "select item_id, concat('<|system|>Be brief.<|end|><|user|>', text, '<|end|>') as prompt from eval_items")
def chat_template(s, d):
    m = F.array(F.struct(F.lit("system").alias("role"), F.lit("Be brief.").alias("content")), F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    return table(s, d, "eval_items").select("item_id", pr.chat(m).alias("prompt"))


@query("preference_rows", f"with {ROLL} select input, arg_max(output, struct_pack(a := reward, b := -pos)) as chosen, arg_min(output, struct_pack(a := reward, b := pos)) as rejected, max(reward) - min(reward) as margin from rollouts group by 1 having count(*) > 1")
def preference_rows(s, d):
    p = rg.processor("iter_dpo")(rollouts(s, d))
    return p.select("input", "chosen", "rejected", (F.col("chosen_reward") - F.col("rejected_reward")).alias("margin"))


@query("csft_format", f"with {ROLL}, m as (select avg(reward) as m, stddev_samp(reward) as s from rollouts) select input, concat(cast(input as varchar), ' <score:', printf('%.2f', (reward - m) / s), '>') as prompt, output from rollouts, m")
def csft_format(s, d):
    return rg.processor("csft")(rollouts(s, d))


@query("sql_functions", "select dataset, regexp_replace(lower(dataset), '\\s+', '', 'g') as k, cast((length(dataset) - length(replace(dataset, 'o', ''))) as int) as n, case when length(domain) > 4 then concat(left(domain, 4), '...') else domain end as short from graph_datasets")
def sql_functions(s, d):
    rg.register_sql_functions(s)
    return table(s, d, "graph_datasets").selectExpr("dataset", "loom_label_key(dataset) as k", "loom_tag_count(dataset, 'o') as n", "loom_preview(domain, 4) as short")


@query("lateral_topk", "select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) as r from customer join orders on o_custkey = c_custkey) where r <= 2")
def lateral_topk(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = table(s, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2")
    return top.join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


# --- sources and sinks -----------------------------------------------------------------------------------------------------------


def _folder(s) -> str:
    return f"{scratch_dir(s).rstrip('/')}/files-{uuid.uuid4().hex}"


@query("source_jsonl", "select distinct record_id, node_id, summary_en from jsonl_records")
def source_jsonl(s, d):
    path = _folder(s)
    wr.write_jsonl(table(s, d, "jsonl_records").select("record_id", "node_id", "summary_en"), path)
    return rd.json_lines(s, path, "record_id long, node_id long, summary_en string")[0].distinct()


@query("source_csv", "select n_nationkey, n_name, n_regionkey from nation")
def source_csv(s, d):
    path = _folder(s) + ".csv"
    table(s, d, "nation").write.option("header", "true").csv(path)
    return rd.read_any(s, path, schema="n_nationkey int, n_name string, n_regionkey int")


@query("source_orc", "select c_custkey, c_name from customer")
def source_orc(s, d):
    path = _folder(s) + ".orc"
    table(s, d, "customer").write.orc(path)
    return rd.read_any(s, path).select("c_custkey", "c_name")


@query("source_partitioned", "select stage, count(*) as n from jsonl_records where stage is not null group by 1")
def source_partitioned(s, d):
    path = _folder(s)
    wr.write_jsonl(table(s, d, "jsonl_records").where("stage is not null").select("record_id", "stage"), path, by=["stage"])
    return s.read.schema("record_id long, stage string").json(path).groupBy("stage").agg(F.count("*").alias("n"))


@query("sink_append_log", "select 2 * count(*) as n, count(distinct item_id) as items from eval_items")
def sink_append_log(s, d):
    path = _folder(s)
    rows = table(s, d, "eval_items").select("item_id", "text")
    wr.append_log(rows, path)
    wr.append_log(rows, path)
    return s.read.schema("item_id long, text string").json(path).agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"))


@query("sink_merged_shards", "select item_id, text from eval_items")
def sink_merged_shards(s, d):
    rows = table(s, d, "eval_items").select(F.col("item_id").alias("sample_index"), "item_id", "text")
    paths = []
    for shard in range(3):
        paths.append(_folder(s))
        wr.write_jsonl(rows.where(F.col("item_id") % 3 == shard), paths[-1])
    return wr.merged_shards(s, paths, schema="sample_index long, item_id long, text string")


@query("sink_pair_payload", "select sample_id, exported_at, round(similarity, 6) as similarity from pair_samples group by all")
def sink_pair_payload(s, d):
    return wr.pair_payload(table(s, d, "pair_samples").select("sample_id", "exported_at", "similarity")).distinct()


@query("checkpoint_retention", "select o_orderkey as name from (select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) as n, sum(o_custkey) over (order by o_orderdate desc, o_orderkey rows unbounded preceding) as b from orders) where n > 100 or b > 200000")
def checkpoint_retention(s, d):
    c = table(s, d, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("written_at"), F.col("o_custkey").alias("bytes"))
    return wr.expired(c, 100, 200000).select("name")


@query("source_graph_folder", None)
def source_graph_folder(s, d):
    """A graph folder of JSON files and NumPy arrays, read back as one table: text, label, neighbours, split and vector of each node."""
    import numpy as np

    from graphloom.sources.npy import NpySource

    root = _folder(s)
    put = lambda name, x: s.createDataFrame([(json.dumps(x),)], "value string").coalesce(1).write.text(f"{root}/{name}")
    put("node_texts.json", ["plain", {"summary_en": " s ", "text": "t"}, {"summary": "", "original": "o"}, 7])
    put("category.json", ["a", ["b"], ["c", "d"], "e"])
    put("first_hop_indices.json", [[1, 2.0], "bad", [], [0]])
    put("splits.json", {"train": [0, "1", "x"], "test": [3]})
    np.save(os.path.join(root.removeprefix("file://"), "node_emb.npy"), np.arange(8, dtype=np.float32).reshape(4, 2))
    s.dataSource.register(NpySource)
    f = lambda n: rd.json_array(s, f"{root}/{n}")
    t = rd.node_texts(f("node_texts.json")).drop("path").join(rd.categories(f("category.json")).drop("path"), "node_id").join(rd.neighbour_lists(f("first_hop_indices.json")).drop("path"), "node_id")
    e = s.read.format("npy").load(f"{root}/node_emb.npy").withColumnRenamed("pos", "node_id")
    return t.join(rd.splits(s, f"{root}/splits.json"), "node_id", "left").join(e, "node_id")


# --- streaming and iteration -----------------------------------------------------------------------------------------------------


def _stream(s, df, schema: str, files: int = 3):
    """A file stream over rows written in a few files."""
    path = _folder(s)
    df.repartition(files).write.parquet(path)
    return s.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)


@query("reward_stream", f"select doc_id as idx, reward from ({_reward_sql(rw.NC_STAGE1, False)})")
def reward_stream(s, d):
    r = responses(s, d).select(F.col("doc_id").alias("idx"), "response", "gold")
    labels = materialise(r.select("idx", "gold"))
    out = _folder(s)
    q = sj.reward_batches(_stream(s, r.select("idx", "response"), "idx long, response string"), labels, lambda batch, epoch: batch.write.mode("append").parquet(out), checkpoint=_folder(s))
    q.awaitTermination()
    return s.read.parquet(out)


@query("replay_stream", "select user_id as key, least(count(*), 20)::int as held from events group by 1")
def replay_stream(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = _folder(s)
    held = sj.replay_buffer(_stream(s, e, "user_id long, event_id long, ts timestamp, value double"), "user_id", "value", 20)
    put = lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)
    q = held.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", _folder(s)).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(out).groupBy("key").agg(F.max_by("held", "epoch").alias("held"))


@query(
    "joined_streams",
    "select a.event_id as click_id, b.event_id as error_id from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'error' and b.ts >= a.ts and b.ts <= a.ts + interval '30 minutes'",
)
def joined_streams(s, d):
    """Clicks and the errors of the same user within half an hour: two streams with watermarks, matched as they arrive."""
    e = table(s, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    wide = "user_id long, event_id long, ts timestamp, event_type string"
    side = lambda kind, name: _stream(s, e.where(F.col("event_type") == kind), wide, 2).select(F.col("user_id").alias(f"{name}_user"), F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_ts"))
    joined = sj.joined(side("click", "click"), side("error", "error"), "click", "error", "30 minutes", "1000 days")
    out = _folder(s)
    q = joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(s)).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema("click_id long, error_id long").parquet(out).select("click_id", "error_id")


@query("late_events_stream", "select time_bucket(interval '1 hour', ts) as start, count(*) as n from events group by 1")
def late_events_stream(s, d):
    """Hourly counts of a stream with a watermark; a first, early file and later ones, none later than the watermark allows."""
    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    out = _folder(s)
    counts = sj.sliding(_stream(s, e, "event_id long, ts timestamp"), "1 hour", "1 hour", "1000 days")
    put = lambda batch, epoch: batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)
    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", _folder(s)).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).groupBy(F.col("start").cast("timestamp_ntz").alias("start")).agg(F.max_by("n", "epoch").alias("n"))


@query("sliding_events", "select s.start, count(*) as n from events e join (select distinct unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as start from events) s on e.ts >= s.start and e.ts < s.start + interval '1 hour' group by 1")
def sliding_events(s, d):
    return sj.sliding(table(s, d, "events"), "1 hour", "30 minutes", "1 day")


_DAY = "time_bucket(interval '1 hour', ts)"


@query("tumbling_events", f"select {_DAY} as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_events(s, d):
    return sj.tumbling(table(s, d, "events"), "1 hour", "1 day").withColumn("total", F.round("total", 4))


@query("session_events", "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as fresh from events), k as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as sess from g) select user_id, min(ts) as start, count(*) as n from k group by user_id, sess")
def session_events(s, d):
    return sj.sessions(table(s, d, "events"), "30 minutes", "1 day")


@query("rollout_loop", "select item_id as qid, least(item_id % 4, 2)::int as searches, true as finished, least(item_id % 4, 2)::int as blocks, item_id % 4 > 0 as told from eval_items")
def rollout_loop(s, d):
    """Scripted rollouts over the evaluation items: each asks a few queries about a node of its graph, gets what the engine retrieves for them
    and answers. blocks: document blocks in the transcript; told: of these with a text of the graph."""
    from graphloom.plans.job_plans import engine

    items = table(s, d, "eval_items").select(F.col("item_id").alias("qid"), F.concat("text", F.lit("\n")).alias("prompt"), b.key("dataset").alias("k"))
    size = b.nodes(s, d).groupBy("dataset").agg(F.min("node_id").alias("node_id")).withColumn("k", b.key("dataset"))  # one row per graph
    anchors = materialise(items.join(size, "k").select("qid", "dataset", "node_id"))
    graph = engine(s, d)

    def retrieve(asking):
        found = graph.batch_query(asking.join(anchors, "qid"))
        return found.select("qid", tx.neighbour_lines(F.transform("docs", lambda x: x["doc"])).alias("docs"))

    out = ro.rollout(items, ro.scripted, retrieve, rounds=6, searches=2)
    told = tx.occurrences(F.col("transcript"), tx.DOCS[0] + "\n(1) ")
    return out.select("qid", "searches", "finished", tx.occurrences(F.col("transcript"), tx.DOCS[0]).alias("blocks"), (told > 0).alias("told"))


# --- general analytics -----------------------------------------------------------------------------------------------------------


@query("pricing_summary", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def pricing_summary(s, d):
    li = table(s, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("cube_sales", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_sales(s, d):
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("rollup_sales", "select r_name, n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)")
def rollup_sales(s, d):
    c = table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations, fixed
    c = c.join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions, fixed
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("customers"))


@query("approx_users", None)
def approx_users(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("middle"))


@query("asof_join", "select e.event_id, max(o.o_orderkey) as before_key from events e join orders o on o.o_custkey = e.user_id and o.o_orderkey <= e.event_id group by 1")
def asof_join(s, d):
    """The last order key of the same user at or before each event id: both sides in one sorted stream, the last seen key carried."""
    e = table(s, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("at"), F.col("event_id"), F.lit(None).cast("long").alias("seen"))
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), F.lit(None).cast("long").alias("event_id"), F.col("o_orderkey").alias("seen"))
    w = Window.partitionBy("k").orderBy("at", F.col("seen").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = e.union(o).withColumn("before_key", F.last("seen", ignorenulls=True).over(w))
    return both.where("event_id is not null and before_key is not null").select("event_id", "before_key")


@query("range_join", "select e.event_id, d.dataset from events e join graph_datasets d on e.user_id >= d.position * 20 and e.user_id < d.position * 20 + 20")
def range_join(s, d):
    r = table(s, d, "graph_datasets").select("dataset", (F.col("position") * 20).alias("lo"), (F.col("position") * 20 + 20).alias("hi"))
    return table(s, d, "events").join(F.broadcast(r), (F.col("user_id") >= F.col("lo")) & (F.col("user_id") < F.col("hi"))).select("event_id", "dataset")  # seven rows, fixed


@query("window_analytics", "select event_id, round(percent_rank() over w, 6) as pr, lag(event_id) over w as prev, lead(event_id) over w as next, first_value(event_id) over w as first, last_value(event_id) over (w rows between unbounded preceding and unbounded following) as last, count(*) over (partition by user_id order by epoch(ts)::bigint range between 3600 preceding and current row) as hour from events window w as (partition by user_id order by ts, event_id)")
def window_analytics(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(s, d, "events").select(
        "event_id", F.round(F.percent_rank().over(w), 6).alias("pr"), F.lag("event_id").over(w).alias("prev"), F.lead("event_id").over(w).alias("next"), F.first("event_id").over(w).alias("first"),
        F.last("event_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"),
        F.count("*").over(Window.partitionBy("user_id").orderBy(F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))).rangeBetween(-3600, Window.currentRow)).alias("hour"),
    )


@query("date_parts", "select event_id, year(ts)::int as y, month(ts)::int as m, date_diff('day', timestamp '1970-01-01', ts)::int as days from events")
def date_parts(s, d):
    return table(s, d, "events").select("event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.datediff("ts", F.lit("1970-01-01").cast("date")).alias("days"))
