"""Queries of rewards, rollout numbers and losses.

Responses are all documents (the rollouts among them carry tags); the gold label is that of the document's anchor node. Token
sequences are the events of a user; prompt groups are the orders of a customer.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import losses as ls
from graphloom.functions import rewards as rw
from graphloom.functions import text as tx
from graphloom.functions import vectors as vx
from graphloom.operators import rollout_math as rm
from graphloom.plans import base as b
from graphloom.plans.registry import query
from graphloom.plans.text_plans import SEGMENTS_SQL, sbody
from graphloom.session import table


def responses(s, d, link: bool = False):
    docs = table(s, d, "documents")
    if link:
        yes = F.regexp_replace("text", "(?s)<answer>(.*?)</answer>", F.when(F.col("doc_id") % 3 == 0, F.lit("<answer>Yes</answer>")).when(F.col("doc_id") % 3 == 1, F.lit("<answer> no.</answer>")).otherwise(F.lit("<answer>maybe</answer>")))
        label = table(s, d, "pair_samples").groupBy(F.col("sample_id").alias("doc_id")).agg(F.max("label").alias("gold"))
        return docs.select("doc_id", yes.alias("response")).join(label, "doc_id", "left")
    n = b.nodes(s, d).select(b.key("dataset").alias("dk"), "node_id", F.col("label").alias("gold"))
    r = docs.select("doc_id", F.col("text").alias("response"), b.key("dataset").alias("dk"), F.col("anchor_node_id").alias("node_id"))
    return r.join(n, ["dk", "node_id"], "left")


_NC = f"""r as (select doc_id, coalesce(d.text, '') as text, n.label as gold from documents d left join nodes n on {b.skey('n.dataset')} = {b.skey('d.dataset')} and n.node_id = d.anchor_node_id)"""
_LP = """r as (select doc_id, coalesce(regexp_replace(d.text, '(?s)<answer>(.*?)</answer>', case doc_id % 3 when 0 then '<answer>Yes</answer>' when 1 then '<answer> no.</answer>' else '<answer>maybe</answer>' end, 'g'), '') as text, l.gold
 from documents d left join (select sample_id, max(label) as gold from pair_samples group by 1) l on l.sample_id = d.doc_id)"""


def _occ(t: str) -> str:
    return f"((length(text) - length(replace(text, '{t}', ''))) / {len(t)})"


def _tokens(c: str) -> str:
    return f"len(list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> ''))"


def _reward_sql(r: rw.Rules, link: bool) -> str:
    key = "regexp_replace(lower({0}), '\\s+', '', 'g')"
    if link:
        cls = "case when said is null or gold is null then -1.0 when (said = 'yes')::int = gold then 1.5 else 0.0 end"
        said = "case when l in ('yes', 'edge', 'true') then 'yes' when l in ('no', 'false') then 'no' end"
    else:
        cls = f"case when answer is null then -1.0 when gold is null then -0.5 when {key.format('answer')} = {key.format('gold')} then 1.5 else 0.0 end"
        said = "null"
    used = " + ".join(f"cast(contains(text, '<|begin_of_query|>{k}') and contains(text, '<|end_of_query|>') as int)" if not r.ordered_search else f"cast(regexp_matches(text, '(?s)<\\|begin_of_query\\|>{k}.*?<\\|end_of_query\\|>') as int)" for k in tx.SEARCH_KINDS)
    cov = f"least(0.5 * ({used}), 2.0)" if r.coverage else "0.0"
    eff = "0.0" if r.ideal_searches is None else f"case when cls <> 1.5 then 0.0 when {_occ('<|begin_of_query|>')} = 0 then -0.2 when {_occ('<|begin_of_query|>')} = {r.ideal_searches} then 0.8 else 0.0 end"
    return f"""with {b.NODES}, {_LP if link else _NC}, a as (select *, {sbody('text', 'answer')} as answer from r), l as (select *, regexp_replace(lower(answer), '[^a-z]', '', 'g') as l from a),
 c as (select *, {said} as said from l), k as (select *, {cls} as cls, coalesce(answer, '') as block from c)
 select doc_id, round(greatest(least(cls
  + case when {_occ('<think>')} = 1 and {_occ('</think>')} = 1 and {_occ('<answer>')} = 1 and {_occ('</answer>')} = 1 then {r.pair_bonus} else -{r.pair_bonus} end
  + case when {_occ('<|begin_of_documents|>')} = {_occ('<|end_of_documents|>')} and {_occ('<|begin_of_query|>')} = {_occ('<|end_of_query|>')} then {r.balance_bonus} else -{r.balance_malus} end
  - case when contains(block, '<|begin_of_query|>') or contains(block, '<|begin_of_documents|>') then 0.5 else 0 end - case when {_tokens('block')} > {r.answer_tokens} then 0.2 else 0 end - case when contains(block, '<think>') then 0.3 else 0 end
  + case when not regexp_matches(text, '(?s)<think>(.*?)</think>') then -0.3 when short = 0 then 0.5 else greatest(-{r.segment_malus} * short, -0.6) end
  + {cov} + {eff} + case when {_tokens('text')} > {r.response_tokens} then -0.5 else 0 end, 15.0), -15.0)::double, 6) as reward
 from (select *, len(list_filter({SEGMENTS_SQL}, lambda g: len(list_filter(string_split_regex(g, '\\s+'), lambda x: x <> '')) < {r.segment_tokens})) as short from k)"""


def _reward(s, d, r, link):
    return responses(s, d, link).select("doc_id", F.round(rw.total(F.col("response"), F.col("gold"), r, link), 6).alias("reward"))


@query("reward_nc_stage1", _reward_sql(rw.NC_STAGE1, False))
def reward_nc_stage1(s, d):
    return _reward(s, d, rw.NC_STAGE1, False)


@query("reward_nc_stage2", _reward_sql(rw.NC_STAGE2, False))
def reward_nc_stage2(s, d):
    return _reward(s, d, rw.NC_STAGE2, False)


@query("reward_lp_stage1", _reward_sql(rw.LP_STAGE1, True))
def reward_lp_stage1(s, d):
    return _reward(s, d, rw.LP_STAGE1, True)


@query("reward_lp_stage2", _reward_sql(rw.LP_STAGE2, True))
def reward_lp_stage2(s, d):
    return _reward(s, d, rw.LP_STAGE2, True)


@query("reward_cover_em", f"with {b.NODES}, {_NC}, a as (select *, {sbody('text', 'answer')} as answer from r) select doc_id, case when answer is not null and gold is not null and list_has_all(string_split(trim(regexp_replace(lower(replace(answer, '_', ' ')), '\\s+', ' ', 'g')), ' '), string_split(lower(gold), ' ')) then 1.0::double else -1.0::double end as score from a")
def reward_cover_em(s, d):
    return responses(s, d).select("doc_id", rw.cover_match(tx.first_body(F.col("response"), tx.ANSWER), F.col("gold")).alias("score"))


@query("reward_sum", "select o_orderkey, round(floor(o_totalprice) / 1000 + o_custkey, 3) as total from orders")
def reward_sum(s, d):
    parts = F.array(F.floor("o_totalprice") / 1000, F.col("o_custkey").cast("double"))
    return table(s, d, "orders").select("o_orderkey", F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


# --- groups of samples -----------------------------------------------------------------------------------------------------------


def rollouts(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("input"), F.col("o_orderkey").alias("output"), F.floor("o_totalprice").cast("double").alias("reward"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos"))


ROLL = "rollouts as (select o_custkey as input, o_orderkey as output, floor(o_totalprice) as reward, row_number() over (partition by o_custkey order by o_orderkey) as pos from orders)"


@query("group_norm", f"with {ROLL} select output, round((reward - avg(reward) over w) / (stddev_samp(reward) over w + 1e-9), 4) as advantage from rollouts window w as (partition by input)")
def group_norm(s, d):
    return rm.group_normalised(rollouts(s, d), "input", "reward").select("output", F.round("advantage", 4).alias("advantage"))


@query("rloo", f"with {ROLL} select output, round(reward - (sum(reward) over w - reward) / nullif(count(*) over w - 1, 0), 3) as advantage from rollouts window w as (partition by input)")
def rloo(s, d):
    return rm.leave_one_out(rollouts(s, d), "input", "reward").select("output", F.round("advantage", 3).alias("advantage"))


@query("reinforce_baseline", f"with {ROLL} select output, round(reward - avg(reward) over (partition by input), 3) as advantage from rollouts")
def reinforce_baseline(s, d):
    return rm.mean_baseline(rollouts(s, d), "input", "reward").select("output", F.round("advantage", 3).alias("advantage"))


@query("reward_zscore", f"with {ROLL} select output, round((reward - (select avg(reward) from rollouts)) / (select stddev_samp(reward) from rollouts), 6) as z from rollouts")
def reward_zscore(s, d):
    return rm.standardised(rollouts(s, d), "reward").select("output", F.round("z", 6).alias("z"))


@query("rejection_sampling", f"with {ROLL} select input, arg_max(output, struct_pack(a := reward, b := -pos)) as output, max(reward) as reward from rollouts group by 1")
def rejection_sampling(s, d):
    return rm.best_of(rollouts(s, d), "input", "output", "reward", "pos")


@query("iterative_dpo", f"with {ROLL} select input, arg_max(output, struct_pack(a := reward, b := -pos)) as chosen, arg_min(output, struct_pack(a := reward, b := pos)) as rejected, max(reward) as chosen_reward, min(reward) as rejected_reward from rollouts group by 1 having count(*) > 1")
def iterative_dpo(s, d):
    return rm.best_and_worst(rollouts(s, d), "input", "output", "reward", "pos")


@query("samples_expanded", "select c_custkey, unnest(range(0, 4)) as sample from customer")
def samples_expanded(s, d):
    return table(s, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("sample"))


# --- token sequences -------------------------------------------------------------------------------------------------------------

TOK = """tok as (select user_id as seq, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as pos, value, case when event_type = 'error' then 0 else 1 end as mask, event_type from events)"""


def tokens(s, d):
    e = table(s, d, "events")
    return e.select(F.col("user_id").alias("seq"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("pos"), "value", F.when(F.col("event_type") == "error", 0).otherwise(1).alias("mask"), "event_type")


@query("discounted_return", f"with {TOK} select seq, pos, round(sum(value * mask) over (partition by seq order by pos desc rows unbounded preceding), 4) as ret from tok")
def discounted_return(s, d):
    return rm.reverse_sums(tokens(s, d), "seq", "pos", F.col("value") * F.col("mask"), "ret").select("seq", "pos", F.round("ret", 4).alias("ret"))


@query("discounted_return_gamma", f"with {TOK} select a.seq, a.pos, round(sum(b.value * pow(0.9::double, b.pos - a.pos)) + 0.0000123, 4) as ret from tok a join tok b on a.seq = b.seq and b.pos >= a.pos group by 1, 2")
def discounted_return_gamma(s, d):
    a = rm.as_arrays(tokens(s, d), "seq", "pos", ["value"]).select("seq", F.posexplode(vx.discounted(F.col("value"), 0.9)).alias("pos", "ret"))
    return a.select("seq", "pos", F.round(F.col("ret") + 0.0000123, 4).alias("ret"))


@query(
    "gae",
    f"""with {TOK}, dl as (select seq, pos, value + 0.9::double * coalesce(lead(value / 2) over (partition by seq order by pos), 0) - value / 2 as delta from tok)
 select a.seq, a.pos, round(sum(b.delta * pow(0.9::double * 0.8::double, b.pos - a.pos)), 4) as advantage from dl a join dl b on a.seq = b.seq and b.pos >= a.pos group by 1, 2""",
)
def gae(s, d):
    t = tokens(s, d).withColumn("guess", F.col("value") / 2)
    a = rm.as_arrays(t, "seq", "pos", ["value", "guess"]).select("seq", F.posexplode(vx.advantages(F.col("value"), F.col("guess"), 0.9, 0.8)).alias("pos", "a"))
    return a.select("seq", "pos", F.round("a", 4).alias("advantage"))


@query("terminal_reward", f"with {TOK} select seq, pos, round(-0.01::double * value + case when lead(pos) over (partition by seq order by pos) is null then greatest(least(value, 10.0), -10.0) else 0 end, 6) as token_reward from tok")
def terminal_reward(s, d):
    return rm.terminal_rewards(tokens(s, d), "seq", "pos", "value", "value", 0.01).select("seq", "pos", F.round("token_reward", 6).alias("token_reward"))


@query("masked_mean", f"with {TOK} select seq, round(sum(value * mask) / greatest(sum(mask), 1), 6) as mean from tok group by 1")
def masked_mean(s, d):
    return tokens(s, d).groupBy("seq").agg(F.round(rm.masked_mean(F.col("value"), F.col("mask")), 6).alias("mean"))


@query("adv_normalize", f"with {TOK}, m as (select sum(value * mask) / sum(mask) as m, sum(value * value * mask) / sum(mask) as q from tok) select seq, pos, round((value - m) / sqrt(greatest(q - m * m, 1e-8)), 5) as z from tok, m")
def adv_normalize(s, d):
    return rm.masked_normalised(tokens(s, d), "value", "mask", "z").select("seq", "pos", F.round("z", 5).alias("z"))


@query("approx_kl", f"with {TOK}, k as (select seq, pos, value / 500 - mask / 4.0::double as x from tok) select seq, round(avg(x), 6) as k1, round(avg(exp(-x) - 1 + x), 6) as k3 from k group by 1")
def approx_kl(s, d):
    lp, ref = F.col("value") / 500, F.col("mask") / F.lit(4.0)
    return tokens(s, d).groupBy("seq").agg(F.round(F.avg(ls.kl_k1(lp, ref)), 6).alias("k1"), F.round(F.avg(ls.kl_k3(lp, ref)), 6).alias("k3"))


@query("kl_weighted_mean", f"with {TOK} select event_type, round(sum(value * (pos + 1)) / sum(pos + 1), 5) as kl from tok group by 1")
def kl_weighted_mean(s, d):
    return tokens(s, d).groupBy("event_type").agg(F.round(F.sum(F.col("value") * (F.col("pos") + 1)) / F.sum(F.col("pos") + 1), 5).alias("kl"))


@query("ema_fold", f"with {TOK}, n as (select *, count(*) over (partition by seq) as n from tok) select seq, round(sum(0.1::double * value * pow(0.9::double, n - 1 - pos)), 5) as ema from n group by 1")
def ema_fold(s, d):
    return rm.as_arrays(tokens(s, d), "seq", "pos", ["value"]).select("seq", F.round(vx.smoothed(F.col("value"), 0.9), 5).alias("ema"))


@query("adaptive_kl", f"with {TOK} select seq, round(0.2::double * exp(sum(ln(1 + greatest(least(value / 50 - 1, 0.2::double), -0.2::double) * 0.05::double))), 6) as coefficient from tok group by 1")
def adaptive_kl(s, d):
    return rm.as_arrays(tokens(s, d), "seq", "pos", ["value"]).select("seq", F.round(vx.adapted_coefficient(F.col("value"), 0.2, 50.0, 1.0, 20.0), 6).alias("coefficient"))


@query("position_ids", f"with {TOK} select seq, pos, pos::bigint as packed, case when mask = 0 then 1 else sum(mask) over (partition by seq order by pos rows unbounded preceding)::bigint - 1 end as attended from tok")
def position_ids(s, d):
    return rm.position_ids(tokens(s, d), "seq", "pos", "mask").select("seq", "pos", F.col("packed").cast("long").alias("packed"), "attended")


@query("first_last_unmasked", f"with {TOK} select seq, min(case when mask = 1 then pos end) as first_pos, max(case when mask = 1 then pos end) as last_pos, count(*) as total, sum(mask)::bigint as unmasked from tok group by 1")
def first_last_unmasked(s, d):
    on = F.when(F.col("mask") == 1, F.col("pos"))
    return tokens(s, d).groupBy("seq").agg(F.min(on).alias("first_pos"), F.max(on).alias("last_pos"), F.count("*").alias("total"), F.sum("mask").alias("unmasked"))


@query("span_mask", f"""with {TOK} select seq, pos, case when sum(cast(event_type = 'signup' as int)) over (partition by seq order by pos rows unbounded preceding) > coalesce(sum(cast(event_type = 'purchase' as int)) over (partition by seq order by pos rows between unbounded preceding and 1 preceding), 0) then 0 else 1 end as loss_mask from tok""")
def span_mask(s, d):
    return rm.span_mask(tokens(s, d), "seq", "pos", F.col("event_type") == "signup", F.col("event_type") == "purchase").select("seq", "pos", "loss_mask")


# --- losses ----------------------------------------------------------------------------------------------------------------------


@query("ppo_clip_loss", f"with {TOK}, t as (select *, exp(value / 500 - 0.1::double) as r, mask - 0.5::double as a from tok), q as (select seq, sum(-least(r * a, greatest(least(r, 1.2::double), 0.8::double) * a) * mask) / greatest(sum(mask), 1) as l from t group by 1) select round(avg(l), 6) as loss, count(*) as sequences from q")
def ppo_clip_loss(s, d):
    t = tokens(s, d).withColumn("term", ls.ppo_term(F.col("value") / 500, F.lit(0.1), F.col("mask") - 0.5))
    q = t.groupBy("seq").agg(rm.masked_mean(F.col("term"), F.col("mask")).alias("l"))
    return q.agg(F.round(F.avg("l"), 6).alias("loss"), F.count("*").alias("sequences"))


@query("value_loss", f"with {TOK}, t as (select seq, mask, value / 100 as v, value / 110 as o, mask * 1.0::double as r from tok) select round(avg(greatest(pow(v - r, 2), pow(o + greatest(least(v - o, 0.2::double), -0.2::double) - r, 2)) / 2), 6) as loss from t")
def value_loss(s, d):
    return tokens(s, d).agg(F.round(F.avg(ls.value_term(F.col("value") / 100, F.col("value") / 110, F.col("mask") * 1.0)), 6).alias("loss"))


PAIR = "pr as (select input, max(reward) / 1e5 as c, min(reward) / 1e5 as r, avg(reward) / 1e5 as rc, 0.3::double as rr from rollouts group by 1)"


def preference_pairs(s, d):
    return rollouts(s, d).groupBy("input").agg((F.max("reward") / 1e5).alias("c"), (F.min("reward") / 1e5).alias("r"), (F.avg("reward") / 1e5).alias("rc"), F.lit(0.3).alias("rr"))


@query("pairwise_loss", f"with {ROLL}, {PAIR} select round(avg(ln(1 + exp(-(c - r)))), 6) as loss, round(avg(ln(1 + exp(-(c - r - 0.1)))), 6) as with_margin, round(avg(ln(1 + exp(r - c))), 6) as log_exp from pr")
def pairwise_loss(s, d):
    c, r = F.col("c"), F.col("r")
    return preference_pairs(s, d).agg(F.round(F.avg(ls.pairwise(c, r)), 6).alias("loss"), F.round(F.avg(ls.pairwise(c, r, F.lit(0.1))), 6).alias("with_margin"), F.round(F.avg(ls.log_exp(c, r)), 6).alias("log_exp"))


@query("dpo_loss", f"with {ROLL}, {PAIR}, h as (select c - r - (rc - rr) as h from pr) select round(avg(ln(1 + exp(-0.1 * h))), 6) as dpo, round(avg(0.9 * ln(1 + exp(-0.1 * h)) + 0.1 * ln(1 + exp(0.1 * h))), 6) as smoothed, round(avg(pow(h - 5, 2)), 6) as ipo from h")
def dpo_loss(s, d):
    a = [F.col(x) for x in ("c", "r", "rc", "rr")]
    return preference_pairs(s, d).agg(F.round(F.avg(ls.dpo(*a)), 6).alias("dpo"), F.round(F.avg(ls.dpo(*a, smoothing=0.1)), 6).alias("smoothed"), F.round(F.avg(ls.dpo(*a, ipo=True)), 6).alias("ipo"))


@query("kto_loss", f"with {ROLL}, {PAIR}, k as (select input % 2 = 0 as good, c - rc as x, greatest(avg(r - rr) over (), 0) as kl from pr) select round(avg(case when good then 1 - 1 / (1 + exp(-0.1 * (x - kl))) else 1.5 * (1 - 1 / (1 + exp(-0.1 * (kl - x)))) end), 6) as loss from k")
def kto_loss(s, d):
    p = preference_pairs(s, d)
    kl = p.agg(F.avg(F.col("r") - F.col("rr")).alias("kl"))
    t = p.join(F.broadcast(kl))  # one row
    return t.agg(F.round(F.avg(ls.kto(F.col("c") - F.col("rc"), F.col("kl"), F.col("input") % 2 == 0, bad=1.5)), 6).alias("loss"))


_LSM = "(e[{i}] - list_max(e) - ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))))"


@query("causal_lm_loss", f"with e as (select vec_id, label, embedding::double[] as e from embeddings) select label, round(avg(-(e[label + 1] - list_max(e) - ln(list_sum(list_transform(e, lambda x: exp(x - list_max(e))))))), 5) as loss from e group by 1")
def causal_lm_loss(s, d):
    e = table(s, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.groupBy("label").agg(F.round(F.avg(ls.cross_entropy(F.col("e"), (F.col("label") + 1).cast("int"))), 5).alias("loss"))


@query("kd_loss", "with e as (select vec_id, label, embedding::double[] as x, list_reverse(embedding::double[]) as t from embeddings) select vec_id, round(-(list_sum(list_transform(list_zip(t, x), lambda z: exp(z[1]) * z[2])) / list_sum(list_transform(t, lambda z: exp(z))) - ln(list_sum(list_transform(x, lambda z: exp(z))))), 5) as loss from e")
def kd_loss(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return e.select("vec_id", F.round(ls.distillation(F.col("x"), F.reverse("x")), 5).alias("loss"))


@query("prm_loss", "with e as (select vec_id, label, embedding::double[] as e from embeddings) select round(avg(-(e[label % 2 + 1] - ln(exp(e[1]) + exp(e[2])))), 6) as loss, round(avg(cast((case when e[1] >= e[2] then 0 else 1 end) = label % 2 as int)), 6) as accuracy from e")
def prm_loss(s, d):
    e = table(s, d, "embeddings").select((F.col("label") % 2).alias("y"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("e"))
    hit = F.when(F.element_at("e", 1) >= F.element_at("e", 2), 0).otherwise(1) == F.col("y")
    return e.agg(F.round(F.avg(ls.cross_entropy(F.col("e"), (F.col("y") + 1).cast("int"))), 6).alias("loss"), F.round(F.avg(hit.cast("int")), 6).alias("accuracy"))


@query("sequence_logps", f"with {TOK} select seq, round(sum(case when pos >= 3 then value * mask end), 4) as total, round(sum(case when pos >= 3 then value * mask end) / greatest(sum(case when pos >= 3 then mask end), 1), 6) as mean from tok group by 1")
def sequence_logps(s, d):
    late = F.col("pos") >= 3
    v, m = F.when(late, F.col("value") * F.col("mask")), F.when(late, F.col("mask"))
    return tokens(s, d).groupBy("seq").agg(F.round(F.sum(v), 4).alias("total"), F.round(F.sum(v) / F.greatest(F.sum(m), F.lit(1)), 6).alias("mean"))


@query("actor_total", f"with {TOK} select seq, round(avg(value) + 0.1 * avg(mask) + 0.02 * avg(value * value), 4) as total, round(0.7 * avg(value) + 0.3 * avg(mask), 4) as distilled from tok group by 1")
def actor_total(s, d):
    v, m = F.avg("value"), F.avg("mask")
    return tokens(s, d).groupBy("seq").agg(F.round(v + 0.1 * m + 0.02 * F.avg(F.col("value") * F.col("value")), 4).alias("total"), F.round(0.7 * v + 0.3 * m, 4).alias("distilled"))
