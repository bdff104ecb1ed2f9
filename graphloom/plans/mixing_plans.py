"""Queries of dataset building, sampling, mixing, packing and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.functions import vectors as vx
from graphloom.operators import datasets as ds
from graphloom.operators import graph as g
from graphloom.operators import mixing as mx
from graphloom.operators.ranking import numbered
from graphloom.plans import base as b
from graphloom.plans.graph_plans import HOMO, TERC
from graphloom.plans.registry import query
from graphloom.plans.text_plans import squestion
from graphloom.session import table

BY = ["dataset"]


def _difficulty(s, d):
    return g.tercile_nodes(g.homophily(b.nodes(s, d), b.adjacency(s, d), BY), BY).drop("score")


_MD5 = "md5(concat_ws(':', '{seed}', {keys}))"
_NK = "dataset, cast(node_id as varchar)"
_STRAT = f"""strat as (select dataset, node_id, difficulty from (select *, row_number() over (partition by dataset, difficulty order by {_MD5.format(seed=42, keys=_NK)}, dataset, node_id) as rn from terc)
 where rn <= case difficulty when 'easy' then 8 when 'medium' then 5 else 5 end)"""


@query("stratified_sample", b.with_(b.NODES, b.ADJ, HOMO, TERC, _STRAT) + "select dataset, node_id, difficulty from strat")
def stratified_sample(s, d):
    return ds.stratified(_difficulty(s, d), BY, "difficulty", {"easy": 8, "medium": 5, "hard": 5}, 42, ["dataset", "node_id"])


_EVAL = f"""ev as (select dataset, node_id from (select dataset, node_id, row_number() over (partition by dataset order by {_MD5.format(seed=7, keys=_NK)}, dataset, node_id) as rn from nodes where split = 'test') where rn <= 10)"""


@query("eval_sample", b.with_(b.NODES, _EVAL) + "select dataset, node_id from ev")
def eval_sample(s, d):
    return ds.seeded_sample(b.nodes(s, d).where("split = 'test'").select("dataset", "node_id"), BY, 10, 7, ["dataset", "node_id"])


@query("stage2_exclusion", b.with_(b.NODES, b.ADJ, HOMO, TERC, _STRAT, _EVAL) + "select dataset, node_id, difficulty from terc where difficulty in ('medium', 'hard') and (dataset, node_id) not in (select dataset, node_id from strat union select dataset, node_id from ev)")
def stage2_exclusion(s, d):
    pool = _difficulty(s, d).where("difficulty in ('medium', 'hard')")
    return ds.without(pool, stratified_sample(s, d), eval_sample(s, d), on=["dataset", "node_id"])


@query("enough_candidates", b.with_(b.NODES, b.ADJ, HOMO, TERC) + "select dataset, difficulty, have, want from (select dataset, difficulty, count(*) as have, case difficulty when 'easy' then 30 when 'medium' then 20 else 20 end as want from terc group by 1, 2) where have < want")
def enough_candidates(s, d):
    return ds.short_of(_difficulty(s, d), BY, "difficulty", {"easy": 30, "medium": 20, "hard": 20})


@query("local_ids", b.with_(b.NODES) + f""", o as (select g.dataset, g.base_offset as "offset", max(node_id) + 1 as size from graph_datasets g join nodes using (dataset) group by 1, 2)
 select record_id, written_at, o.dataset, case when node_id >= "offset" and node_id < "offset" + size then node_id - "offset" else node_id end as node_id from jsonl_records r join o on {b.skey('o.dataset')} = {b.skey('r.dataset')}
 where (node_id >= "offset" and node_id < "offset" + size) or (node_id >= 0 and node_id < size) group by all""")
def local_ids(s, d):
    o = table(s, d, "graph_datasets").join(b.nodes(s, d).groupBy("dataset").agg((F.max("node_id") + 1).alias("size")), "dataset").select("dataset", F.col("base_offset").alias("offset"), "size", b.key("dataset").alias("dk"))
    r = table(s, d, "jsonl_records").select("record_id", "written_at", "node_id", b.key("dataset").alias("dk")).join(F.broadcast(o.select("dk", "dataset")), "dk").drop("dk")
    return ds.local_ids(r, o, "node_id").distinct().select("record_id", "written_at", "dataset", "node_id")


@query("difficulty_filter", f"select distinct record_id, {b.skey('difficulty')} as difficulty from jsonl_records where {b.skey('difficulty')} in ('medium', 'hard')")
def difficulty_filter(s, d):
    return table(s, d, "jsonl_records").select("record_id", b.key("difficulty").alias("difficulty")).where(F.col("difficulty").isin("medium", "hard")).distinct()


@query("valid_summaries", f"select distinct record_id from jsonl_records where {b.sstrip('summary_en')} <> ''")
def valid_summaries(s, d):
    return table(s, d, "jsonl_records").where(tx.strip(F.col("summary_en")) != "").select("record_id").distinct()


@query("head_valid", f"select record_id from (select record_id, row_number() over (order by record_id) as rn from (select distinct record_id from jsonl_records where {b.sstrip('summary_en')} <> '')) where rn <= 100")
def head_valid(s, d):
    return valid_summaries(s, d).orderBy("record_id").limit(100)


@query("slice_window", "select item_id from (select item_id, row_number() over (order by item_id) - 1 as rn from eval_items) where rn >= 32 and rn < 48")
def slice_window(s, d):
    return table(s, d, "eval_items").select("item_id").orderBy("item_id").offset(32).limit(16)


_CUR = "case lower(trim(regexp_replace(difficulty, '\\s+', '', 'g'))) when 'hard' then 0 when 'medium' then 1 when 'easy' then 2 else 3 end"


@query("curriculum_order", f"select record_id, row_number() over (order by rk, record_id) - 1 as place from (select record_id, min({_CUR}) as rk from jsonl_records group by 1)")
def curriculum_order(s, d):
    level = F.regexp_replace("difficulty", r"\s+", "")
    rank = F.when(F.lower(level) == "hard", 0).when(F.lower(level) == "medium", 1).when(F.lower(level) == "easy", 2).otherwise(3)
    r = table(s, d, "jsonl_records").groupBy("record_id").agg(F.min(rank).alias("rk")).withColumn("level", F.element_at(F.array(*[F.lit(x) for x in ("hard", "medium", "easy", "-")]), F.col("rk") + 1))
    return ds.curriculum(r, "level", [F.col("record_id")]).select("record_id", F.col("place").cast("long").alias("place"))


@query("bucket_shuffle", b.with_(b.NODES, b.ADJ, HOMO, TERC) + f"select dataset, node_id, row_number() over (order by case difficulty when 'easy' then 0 when 'medium' then 1 else 2 end, {_MD5.format(seed=5, keys=_NK)}, dataset, node_id) - 1 as place from terc")
def bucket_shuffle(s, d):
    c = ds.curriculum(_difficulty(s, d), "difficulty", [ds.seeded(5, "dataset", "node_id"), F.col("dataset"), F.col("node_id")], hard_first=False)
    return c.select("dataset", "node_id", F.col("place").cast("long").alias("place"))


_SHARES = {"papernet-cs": 0.5, "shopweb-home": 0.25, "medcite": 0.25}


def _inter_sql(end: str) -> str:
    return f"""with r as (select item_id, dataset, row_number() over (partition by dataset order by item_id) - 1 as r from eval_items),
 p as (select *, case dataset when 'papernet-cs' then 2 when 'shopweb-home' then 1 when 'medcite' then 1 end as n, case dataset when 'papernet-cs' then 0 when 'shopweb-home' then 2 when 'medcite' then 3 end as st from r),
 q as (select *, (r // n) * 4 + st + r % n as place from p), e as (select min(m) as e from (select max(place) as m from q where n is not null group by dataset)) select item_id, place from q, e where {end}"""


@query("interleave_balanced", _inter_sql("n is null or place <= e"))
def interleave_balanced(s, d):
    return mx.interleaved(table(s, d, "eval_items"), "dataset", [F.col("item_id")], _SHARES).select("item_id", "place")


@query("interleave_all", _inter_sql("true"))
def interleave_all(s, d):
    return mx.interleaved(table(s, d, "eval_items"), "dataset", [F.col("item_id")], _SHARES, "all_exhausted").select("item_id", "place")


@query("dist_sampler", """with n as (select count(*) as n from eval_items), r as (select item_id, row_number() over (order by md5(concat_ws(':', '3', cast(item_id as varchar))), item_id) - 1 as r from eval_items),
 a as (select item_id, r from r union all select item_id, r + n as r from r, n where r < (n + 6) // 7 * 7 - n) select item_id, cast(r % 7 as int) as replica, r // 7 as turn from a""")
def dist_sampler(s, d):
    return mx.sampled_ranks(table(s, d, "eval_items").select("item_id"), [ds.seeded(3, "item_id"), F.col("item_id")], 7)


@query("contiguous_shards", "select item_id, (row_number() over (order by item_id) - 1) // 67 as shard from eval_items")
def contiguous_shards(s, d):
    return mx.contiguous_shards(table(s, d, "eval_items").select("item_id"), [F.col("item_id")], 3)


@query("fixed_batches", "select event_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 16 as batch from events")
def fixed_batches(s, d):
    return mx.batches(table(s, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 16).select("event_id", "batch")


@query("replay_buffer_fifo", "select event_id from (select event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 20")
def replay_buffer_fifo(s, d):
    return mx.latest_rows(table(s, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 20).select("event_id")


@query("unmatched_join", "select o_orderkey, coalesce(lead(o_totalprice) over w, first(o_totalprice) over (partition by o_custkey order by o_orderkey)) as other from orders window w as (partition by o_custkey order by o_orderkey)")
def unmatched_join(s, d):
    return mx.rotated(table(s, d, "orders"), ["o_custkey"], [F.col("o_orderkey")], "o_totalprice", "other").select("o_orderkey", "other")


@query("cyclic_source", "select i.item_id, r.name as r_name from (select item_id, (row_number() over (order by item_id) - 1) % 5 as k from eval_items) i join (select r_regionkey as k, r_name as name from region) r on r.k = i.k")
def cyclic_source(s, d):
    i = numbered(table(s, d, "eval_items").select("item_id"), [F.col("item_id")]).select("item_id", (F.col("place") % 5).cast("int").alias("r_regionkey"))
    return i.join(F.broadcast(table(s, d, "region")), "r_regionkey").select("item_id", "r_name")  # five regions, fixed


# --- packing ---------------------------------------------------------------------------------------------------------------------

SEQ = "sq as (select o_custkey as seq, list(o_orderkey order by o_orderkey) as ids from orders group by 1)"


def sequences(s, d):
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("seq")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))


@query("pad_left", f"with {SEQ} select seq, list_concat(list_transform(range(0, greatest(24 - len(ids), 0)), lambda x: 0::bigint), ids) as padded from sq")
def pad_left(s, d):
    return sequences(s, d).select("seq", vx.padded_left(F.col("ids"), F.lit(24), F.lit(0).cast("long")).alias("padded"))


@query("pad_right", f"with {SEQ} select seq, list_concat(ids, list_transform(range(0, greatest(24 - len(ids), 0)), lambda x: 0::bigint)) as padded from sq")
def pad_right(s, d):
    return sequences(s, d).select("seq", vx.padded_right(F.col("ids"), F.lit(24), F.lit(0).cast("long")).alias("padded"))


@query("remove_padding", f"with {SEQ} select seq, ids from sq")
def remove_padding(s, d):
    padded = sequences(s, d).select("seq", vx.padded_left(F.col("ids"), F.lit(24), F.lit(-1).cast("long")).alias("padded"))
    return padded.select("seq", F.filter("padded", lambda x: x != -1).alias("ids"))


@query("truncate_len", f"with {SEQ} select seq, ids[1:greatest(1, least(len(ids), 12 - len(ids) // 2))] as kept from sq")
def truncate_len(s, d):
    n = F.size("ids")
    return sequences(s, d).select("seq", F.slice("ids", F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(12) - F.floor(n / 2).cast("int")))).alias("kept"))


@query("label_mask", f"with {SEQ} select seq, list_transform(list_zip(ids, range(1, len(ids) + 1)), lambda z: case when z[2] <= 2 then -100 else z[1] end) as labels from sq")
def label_mask(s, d):
    return sequences(s, d).select("seq", F.transform("ids", lambda x, i: F.when(i < 2, F.lit(-100).cast("long")).otherwise(x)).alias("labels"))


@query("placeholder_labels", f"with {SEQ} select seq, list_transform(ids, lambda x: case when x % 3 = 0 then x // 3 else -100 end) as labels from sq")
def placeholder_labels(s, d):
    return sequences(s, d).select("seq", F.transform("ids", lambda x: F.when(x % 3 == 0, F.floor(x / 3)).otherwise(F.lit(-100).cast("long"))).alias("labels"))


@query("pack_sequences", f"""with {SEQ}, p as (select c_nationkey as pack, seq, ids, row_number() over (partition by c_nationkey order by seq) as k from sq join customer on c_custkey = seq), f as (select pack, flatten(list(ids order by k)) as ids, flatten(list(list_transform(ids, lambda x: k) order by k)) as attention from p group by 1)
 select pack, len(ids) as used, len(ids) + (8 - len(ids) % 8) % 8 as padded, list_sum(attention)::bigint as checksum from f""")
def pack_sequences(s, d):
    q = sequences(s, d).join(table(s, d, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_nationkey").alias("pack")), "seq")
    rows = mx.packed(q, ["pack"], [F.col("seq")], "ids", 8)
    return rows.groupBy("pack").agg(F.max("used").alias("used"), F.max("padded").alias("padded"), F.sum(F.col("k") * F.size("ids")).alias("checksum"))


@query("unpack_sequences", f"with {SEQ} select seq, pos, ids[pos] as id from (select seq, ids, unnest(range(1, len(ids) + 1)) as pos from sq)")
def unpack_sequences(s, d):
    return sequences(s, d).select("seq", F.posexplode("ids").alias("p", "id")).select("seq", (F.col("p") + 1).cast("long").alias("pos"), "id")


@query("max_length_drop", "select item_id, n from (select item_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as n from eval_items) where n < 42 - 2")
def max_length_drop(s, d):
    return table(s, d, "eval_items").select("item_id", tx.token_count(F.col("text")).cast("long").alias("n")).where("n < 42 - 2")


@query("batch_to_rows", "select o_custkey, o_orderkey, o_totalprice from orders")
def batch_to_rows(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("o_orderkey"), F.collect_list("o_totalprice").alias("o_totalprice"))
    return o.select("o_custkey", F.explode(F.arrays_zip("o_orderkey", "o_totalprice")).alias("z")).select("o_custkey", "z.*")


# --- set operations and registries -----------------------------------------------------------------------------------------------


@query("blocked_union", "select dataset, src as id from graph_edges where src is not null union select dataset, dst from graph_edges where dst is not null")
def blocked_union(s, d):
    e = table(s, d, "graph_edges")
    return e.select("dataset", F.col("src").alias("id")).union(e.select("dataset", "dst")).where("id is not null").distinct()


@query("labelled_union", b.with_(b.EDGES) + "select dataset, u, v, 1 as label, 'train' as split from edges union all select dataset, v, u, 0, 'test' from edges")
def labelled_union(s, d):
    e = b.edges(s, d)
    return e.withColumn("label", F.lit(1)).withColumn("split", F.lit("train")).union(e.select("dataset", "v", "u").withColumn("label", F.lit(0)).withColumn("split", F.lit("test")))


@query("set_difference", "select sample_id, list_sort(list_filter(list_distinct(uh), lambda x: not list_contains(vh, x))) as only_u, list_sort(list_intersect(uh, vh)) as shared from (select sample_id, arg_max(node_u_1hop, exported_at) as uh, arg_max(node_v_1hop, exported_at) as vh from pair_samples group by 1) where uh is not null and vh is not null")
def set_difference(s, d):
    p = table(s, d, "pair_samples").groupBy("sample_id").agg(F.max_by("node_u_1hop", "exported_at").alias("u"), F.max_by("node_v_1hop", "exported_at").alias("v")).where("u is not null and v is not null")
    return p.select("sample_id", F.array_sort(F.array_except("u", "v")).alias("only_u"), F.array_sort(F.array_intersect("u", "v")).alias("shared"))


@query("sanitised_candidates", b.with_(b.NODES) + f""", one as (select sample_id, arg_max(struct_pack(d := dataset, u := node_u, h := node_u_1hop), exported_at) as r from pair_samples group by 1), z as (select {b.skey('dataset')} as dk, base_offset, max(node_id) + 1 as n from graph_datasets join nodes using (dataset) group by 1, 2),
 l as (select sample_id, n, case when r.u >= base_offset then r.u - base_offset else r.u end as u, list_transform(r.h, lambda x: case when x >= base_offset then x - base_offset else x end) as h from one join z on dk = {b.skey('one.r.d')} where r.h is not null and r.u is not null)
 select sample_id, list_filter(list_transform(list_sort(list_transform(list_distinct(h), lambda x: struct_pack(p := list_position(h, x), x := x))), lambda z: z.x), lambda x: x >= 0 and x < n and x <> u) as cands from l""")
def sanitised_candidates(s, d):
    """Ids made local, in the range of the sample's graph, without the anchor, each once in order."""
    p = table(s, d, "pair_samples").groupBy("sample_id").agg(F.max_by(F.struct("dataset", "node_u", "node_u_1hop"), "exported_at").alias("r")).where("r.node_u_1hop is not null and r.node_u is not null")
    size = b.nodes(s, d).groupBy("dataset").agg((F.max("node_id") + 1).alias("n")).join(table(s, d, "graph_datasets"), "dataset").select(b.key("dataset").alias("dk"), "n", "base_offset")  # one row per graph
    local = lambda x: F.when(x >= F.col("base_offset"), x - F.col("base_offset")).otherwise(x)
    p = p.withColumn("dk", b.key("r.dataset")).join(size, "dk").select("sample_id", "n", local(F.col("r.node_u")).alias("u"), F.transform("r.node_u_1hop", local).alias("h"))
    return p.select("sample_id", F.filter(F.array_distinct("h"), lambda x: (x >= 0) & (x < F.col("n")) & (x != F.col("u"))).alias("cands"))


@query("label_batches", "select label, count(*) as n, sum(case when sample_id % 2 = 0 then 1 else 0 end)::bigint as matched from (select sample_id, max(label) as label from pair_samples group by 1) where label is not null group by 1")
def label_batches(s, d):
    p = table(s, d, "pair_samples").groupBy("sample_id").agg(F.max("label").alias("label")).where("label is not null")
    return p.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("sample_id") % 2 == 0).alias("matched"))


@query("option_merge", "select dataset, case when position % 2 = 0 then 'own' else 'shared' end as mode, 5 as k from graph_datasets")
def option_merge(s, d):
    shared = F.create_map(F.lit("mode"), F.lit("shared"), F.lit("k"), F.lit("5"))
    own = F.when(F.col("position") % 2 == 0, F.create_map(F.lit("mode"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    # the right side wins: its keys are taken out of the left before the maps are joined
    merged = F.map_concat(F.map_filter(shared, lambda k, _: ~F.map_contains_key(own, k)), own)
    return table(s, d, "graph_datasets").select("dataset", merged["mode"].alias("mode"), merged["k"].cast("int").alias("k"))


@query("lp_sources", f"""with c as (select {b.skey('dataset')} as dataset, {b.skey('split')} as split, count(distinct sample_id) as pairs from pair_samples where split is not null group by 1, 2)
 select dataset, split, pairs, cast(coalesce(sum(pairs) over (order by dataset, split rows between unbounded preceding and 1 preceding), 0) as bigint) as base_offset from c""")
def lp_sources(s, d):
    c = table(s, d, "pair_samples").where("split is not null").groupBy(b.key("dataset").alias("dataset"), b.key("split").alias("split")).agg(F.countDistinct("sample_id").alias("pairs"))
    w = Window.orderBy("dataset", "split").rowsBetween(Window.unboundedPreceding, -1)  # one row per dataset and split
    return c.withColumn("base_offset", F.coalesce(F.sum("pairs").over(w), F.lit(0)))


@query("unique_categories", "select label, min(node_id) as first_node from (select node_id, regexp_replace(category, '^\\[\"?|\"?\\]$', '', 'g') as label from graph_nodes where category is not null) group by 1")
def unique_categories(s, d):
    return table(s, d, "graph_nodes").where("category is not null").groupBy(F.regexp_replace("category", r'^\["?|"?\]$', "").alias("label")).agg(F.min("node_id").alias("first_node"))


@query("answer_key_lookup", f"select item_id, arg_max(answer, pos) as answer from (select {squestion('task')} as k, split as answer, item_id as pos from eval_items) a join (select item_id, {squestion('task')} as k from eval_items) q using (k) group by 1")
def answer_key_lookup(s, d):
    i = table(s, d, "eval_items").withColumn("k", tx.question_key(F.col("task")))
    keys = i.groupBy("k").agg(F.max_by("split", "item_id").alias("answer"))
    return i.join(keys, "k").select("item_id", "answer")


@query("eval_holdout", "select order_key as o_orderkey from (select o_orderkey as order_key, row_number() over (order by o_orderkey) as rn, count(*) over () as n from orders) where rn <= floor(n * 0.03)")
def eval_holdout(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey").orderBy("o_orderkey").limit(int(o.count() * 0.03))


@query("skip_identical_pair", """with one as (select sample_id, arg_max(struct_pack(u := node_u, v := node_v, l := similar_pairs), exported_at) as r from pair_samples group by 1), e as (select sample_id, r.u as u, r.v as v, unnest(r.l) as p from one)
 select sample_id, p.node_u as ref_u, p.node_v as ref_v, count(*) as n from e where u is not null and v is not null and not (p.node_u in (u, v) and p.node_v in (u, v)) group by 1, 2, 3""")
def skip_identical_pair(s, d):
    """The recorded similar pairs of every sample, without those that have the sample's own two ends."""
    p = table(s, d, "pair_samples").groupBy("sample_id").agg(F.max_by(F.struct(F.col("node_u").alias("u"), F.col("node_v").alias("v"), "similar_pairs"), "exported_at").alias("r"))
    e = p.where("r.u is not null and r.v is not null").select("sample_id", "r.u", "r.v", F.explode("r.similar_pairs").alias("p"))
    kept = e.where("not (p.node_u in (u, v) and p.node_v in (u, v))")
    return kept.groupBy("sample_id", F.col("p.node_u").alias("ref_u"), F.col("p.node_v").alias("ref_v")).agg(F.count("*").alias("n"))


@query("record_global_id", "select sample_id, base_offset + pair_id as global_id from (select sample_id, arg_max(dataset, exported_at) as ds, arg_max(pair_id, exported_at) as pair_id from pair_samples where pair_id is not null group by 1) p join graph_datasets g on replace(lower(trim(p.ds)), '-', '_') = replace(lower(g.dataset), '-', '_')")
def record_global_id(s, d):
    p = table(s, d, "pair_samples").where("pair_id is not null").groupBy("sample_id").agg(F.max_by(F.struct("dataset", "pair_id"), "exported_at").alias("r"))
    o = table(s, d, "graph_datasets").select(b.key("dataset").alias("dk"), "base_offset")
    return p.withColumn("dk", b.key("r.dataset")).join(F.broadcast(o), "dk").select("sample_id", (F.col("base_offset") + F.col("r.pair_id")).alias("global_id"))


@query("sort_by_idx_text", "select o_orderkey, row_number() over (order by cast(o_orderkey as varchar), o_orderkey) - 1 as place from orders")
def sort_by_idx_text(s, d):
    o = table(s, d, "orders").select("o_orderkey")
    return numbered(o, [F.col("o_orderkey").cast("string"), F.col("o_orderkey")])


@query("json_encode", "select dataset, concat('{\"dataset\":\"', dataset, '\",\"position\":', cast(position as varchar), '}') as line from graph_datasets")
def json_encode(s, d):
    return table(s, d, "graph_datasets").select("dataset", F.to_json(F.struct("dataset", "position")).alias("line"))
