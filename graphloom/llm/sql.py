"""SQL twins of the training-data queries, where SQL can express them on whole tables."""

from __future__ import annotations



def _key(c: str) -> str:
    return f"replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '-', '_')"


def _trim(c: str) -> str:
    return f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


_PAIRS = f"""
s as (select sample_id, arg_max(struct_pack(d := dataset, s := split, u := node_u, v := node_v), exported_at) r from pair_samples where sample_id is not null group by 1),
n as (select sample_id, {_key('r.d')} dataset,
  case when {_trim('r.s')} in ('train', 'training') then 'train' when {_trim('r.s')} in ('valid', 'validation', 'val', 'dev') then 'valid'
       when {_trim('r.s')} in ('test', 'testing') then 'test' end split, r.u u, r.v v from s),
l as (select n.sample_id, n.dataset, n.split, case when u >= base_offset then u - base_offset else u end u, case when v >= base_offset then v - base_offset else v end v
  from n join (select {_key('dataset')} dataset, base_offset from graph_datasets) g using (dataset)),
same as (select {_key('dataset')} dataset, node_id, max(same_as) same_as from graph_nodes where same_as is not null group by 1, 2),
p as (select sample_id, l.dataset, split, least(coalesce(a.same_as, u), coalesce(b.same_as, v)) x, greatest(coalesce(a.same_as, u), coalesce(b.same_as, v)) y
  from l left join same a on a.dataset = l.dataset and a.node_id = u left join same b on b.dataset = l.dataset and b.node_id = v where u is not null and v is not null)
"""

_SCORED = """
ok as (select target_sample_id, ref_pair_id, arg_max(similarity, struct_pack(a := scored_at, b := similarity)) similarity from similar_pairs
  where target_sample_id is not null and ref_pair_id is not null and similarity is not null and not isnan(similarity) and similarity between -1 and 1 group by 1, 2),
top as (select *, row_number() over (partition by target_sample_id order by similarity desc, ref_pair_id) as position from ok)
"""

_CELLS = f"""
r as (select record_id, arg_max(struct_pack(d := dataset, f := difficulty), written_at) r from jsonl_records where record_id is not null group by 1),
have as (select {_key('r.d')} d, {_trim('r.f')} f, count(*) n from r group by 1, 2)
"""

def _words(c: str) -> str:
    """Lower-case runs of letters and digits without tags and invisible characters, as a list."""
    hidden = "[\\x{AD}\\x{34F}\\x{61C}\\x{180E}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FE00}-\\x{FE0F}\\x{FEFF}]"
    tag = "</?[A-Za-z][A-Za-z0-9]*(?:\\s[^<>]*)?/?>|<\\|[^<>|]*\\|>"
    return f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({c}, '{hidden}', '', 'g'), '{tag}', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


SQL = {
    "p1_found": f"""with t as (select record_id, arg_max(summary_en, written_at) as s from jsonl_records where record_id is not null group by 1),
w as (select record_id, {_words('s')} as l from t where s is not null), k as (select * from w where len(l) >= 20),
e as (select record_id, unnest(l) as word from k), o as (select record_id, word, row_number() over (partition by record_id, word) as nth from e),
j as (select a.record_id as record_id_a, b.record_id as record_id_b, count(*) as shared from o a join o b on a.word = b.word and a.nth = b.nth and a.record_id < b.record_id group by 1, 2)
select record_id_a, record_id_b from j join k x on x.record_id = record_id_a join k y on y.record_id = record_id_b where shared >= 0.75 * greatest(len(x.l), len(y.l))""",
    "p1_groups": f"""with recursive t as (select record_id, arg_max(summary_en, written_at) as s from jsonl_records where record_id is not null group by 1),
w as (select record_id, case when s is null then [] else {_words('s')} end as l from t), k as (select *, list_sort(l) as bag from w where len(l) >= 20),
e as (select record_id, unnest(l) as word from k), o as (select record_id, word, row_number() over (partition by record_id, word) as nth from e),
j as (select a.record_id as x, b.record_id as y, count(*) as shared from o a join o b on a.word = b.word and a.nth = b.nth and a.record_id <> b.record_id group by 1, 2),
p as (select j.x, j.y, m.bag as other, n.bag = m.bag as same from j join k n on n.record_id = x join k m on m.record_id = y where shared >= 0.75 * greatest(len(n.l), len(m.l))),
c as (select record_id as x, record_id as y from k union select c.x, p.y from c join p on p.x = c.y),
g as (select x, min(y) as class_id from c group by 1), h as (select x, count(distinct other) as n_links from p where not same group by 1)
select t.record_id, coalesce(class_id, t.record_id) as class_id, coalesce(n_links, 0) as n_links from t left join g on g.x = t.record_id left join h on h.x = t.record_id""",
    "p6_found": f"""with i as (select item_id, {_words('text')} as l from eval_items), d as (select doc_id, {_words('text')} as l from documents where text is not null),
g as (select distinct item_id, array_to_string(l[p:p + 11], ' ') as run from (select item_id, l, unnest(range(1, len(l) - 10)) as p from i)),
h as (select distinct doc_id, array_to_string(l[p:p + 11], ' ') as run from (select doc_id, l, unnest(range(1, len(l) - 10)) as p from d))
select distinct item_id, doc_id from g join h using (run)""",
    "p2_found": f"""with {_PAIRS} select distinct least(t.sample_id, h.sample_id) as sample_id_a, greatest(t.sample_id, h.sample_id) as sample_id_b
from p t join p h on t.split = 'train' and h.split in ('valid', 'test') and t.dataset = h.dataset and t.x = h.x and t.y = h.y""",
    "p2_report": f"""with {_PAIRS}, c as (select dataset, x, y, count(*) copies from p where split = 'train' group by 1, 2, 3)
select h.split, h.dataset, count(*) as samples, count(copies) as overlapping, cast(coalesce(sum(copies), 0) as bigint) as train_pairs,
  round(avg(case when copies is not null then 1.0::double end), 6) as mean_coverage
from p h left join c on c.dataset = h.dataset and c.x = h.x and c.y = h.y where h.split in ('valid', 'test') group by 1, 2""",
    "p2_coverage": f"""with {_PAIRS}, c as (select dataset, x, y, count(*) copies from p where split = 'train' group by 1, 2, 3)
select h.sample_id, h.split, h.dataset, case when copies is null then 0.0::double else 1.0::double end as coverage, cast(coalesce(copies, 0) as bigint) as train_records
from p h left join c on c.dataset = h.dataset and c.x = h.x and c.y = h.y where h.split in ('valid', 'test')""",
    "p2_members": f"""with {_PAIRS} select sample_id, split, dataset, min(sample_id) over (partition by dataset, x, y) as rep from p where split is not null""",
    "p3_neighbours": """with v as (select sample_id, any_value(vector)::double[] as v from pair_samples where sample_id is not null and len(vector) = 64
  and list_bool_and(list_transform(vector, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(vector, lambda x: x <> 0)) group by 1),
s as (select a.sample_id, b.sample_id as neighbour_id, case when a.v = b.v then 1.0::double else list_cosine_similarity(a.v, b.v) end as c from v a join v b on a.sample_id % 100 = 0 and a.sample_id <> b.sample_id)
select sample_id, neighbour_id, cast(rank as int) as rank, round(c, 6) as cosine from (select *, row_number() over (partition by sample_id order by c desc, neighbour_id) as rank from s) where rank <= 5""",
    "p4_found": f"with {_SCORED} select target_sample_id, ref_pair_id from top where position <= 10",
    "p4_top": f"with {_SCORED} select target_sample_id, ref_pair_id, similarity, position from top where position <= 10",
    # no case hangs on the tokenizer: four characters stand for a token
    "p7_found": f"""with h as (select {_key('source')} as s, sum(coalesce(length(text), 0)) / 4.0 as tokens from documents group by 1)
select t.source from source_targets t left join h on h.s = {_key('t.source')} where coalesce(tokens, 0) * max_repeats < target_permille * token_budget / 1000.0""",
    "p5_found": f"""with {_CELLS} select t.dataset, t.difficulty from sample_targets t left join have on d = {_key('t.dataset')} and f = {_trim('t.difficulty')}
where coalesce(n, 0) < greatest(min_rows, ceil(target_permille * sample_size / 1000.0))""",
}
