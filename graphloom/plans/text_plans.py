"""Queries of the text expressions, over all documents, items and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.plans.base import sstrip
from graphloom.plans.registry import query
from graphloom.session import table

D = "documents"


def body():
    return F.col("text")


def docs(s, d):
    return table(s, d, D).where("text is not null")


_BODY = "case when regexp_matches({c}, '(?s){a}(.*?){b}') then trim(regexp_extract({c}, '(?s){a}(.*?){b}', 1), e' \\t\\n\\r\\x0b\\f') end"


def squestion(c: str) -> str:
    """The SQL of a question key."""
    marks = tx.QUESTION_MARKS.replace("'", "''")
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '{marks}', ' ', 'g'), 'import\\s[a-z.]+\\sas\\s[a-z.]+\\n', ' ', 'g'), '\\s+', ' ', 'g'))"


def sbody(c: str, tag: str) -> str:
    return _BODY.format(c=c, a=f"<{tag}>", b=f"</{tag}>")


#: the tail after the last opening mark, in SQL
_TAIL = "list_extract(string_split({c}, '{t}'), -1)"


@query("extract_answer", f"select doc_id, {sbody('text', 'answer')} as answer from documents where text is not null")
def extract_answer(s, d):
    return docs(s, d).select("doc_id", tx.first_body(body(), tx.ANSWER).alias("answer"))


@query("extract_last_answer", "select doc_id, string_split(list_extract(string_split(text, '<answer>'), -1), '</answer>')[1] as answer from documents where text is not null")
def extract_last_answer(s, d):
    return docs(s, d).select("doc_id", tx.last_body(body(), tx.ANSWER).alias("answer"))


_QUERY_SQL = f"""select doc_id, case when contains(text, '<|begin_of_query|>') and contains(tail, '<|end_of_query|>') and q <> '' then q end as query from
(select *, trim(regexp_replace(replace(string_split(tail, '<|end_of_query|>')[1], '"', ''), '\\s+', ' ', 'g')) as q from
 (select doc_id, text, {_TAIL.format(c='text', t='<|begin_of_query|>')} as tail from documents where text is not null))"""


@query("extract_query", _QUERY_SQL)
def extract_query(s, d):
    return docs(s, d).select("doc_id", tx.last_query(body()).alias("query"))


_KIND = """case when p in ('1-hop', '1 hop', '1hop', 'one-hop', 'one hop') then 'one_hop' when p in ('2-hop', '2 hop', '2hop', 'two-hop', 'two hop') then 'two_hop'
 when p in ('pagerank', 'page rank', 'pr') then 'pagerank' else 'similar' end"""


@query(
    "search_type_parse",
    f"""with q as ({_QUERY_SQL}) select doc_id, {_KIND} as strategy, case when regexp_matches(query, '(?s)^([a-zA-Z0-9\\- ]+?):(.*)$') then trim(regexp_extract(query, '(?s)^([a-zA-Z0-9\\- ]+?):(.*)$', 2)) else trim(query) end as query_text,
 case when starts_with(l, '1-hop') or starts_with(l, '1 hop') or starts_with(l, '1hop') or starts_with(l, 'one-hop') or starts_with(l, 'one hop') then 'direct neighbours'
  when starts_with(l, '2-hop') or starts_with(l, '2 hop') or starts_with(l, '2hop') or starts_with(l, 'two-hop') or starts_with(l, 'two hop') then 'neighbours of neighbours'
  when starts_with(l, 'pagerank') or starts_with(l, 'page rank') or starts_with(l, 'pr') or starts_with(l, 'global') then 'globally important nodes'
  when starts_with(l, 'similar') or starts_with(l, 'sim') or starts_with(l, 'most similar') then 'semantically similar nodes' else 'the graph' end as scope
 from (select *, lower(trim(regexp_extract(query, '(?s)^([a-zA-Z0-9\\- ]+?):(.*)$', 1))) as p, lower(trim(query)) as l from q where query is not null)""",
)
def search_type_parse(s, d):
    q = docs(s, d).select("doc_id", tx.last_query(body()).alias("q")).where("q is not null")
    c = F.col("q")
    return q.select("doc_id", tx.search_kind(c).alias("strategy"), tx.search_text(c).alias("query_text"), tx.search_scope(c).alias("scope"))


@query("normalize_label", "select dataset, node_id, regexp_replace(lower(max(category)), '\\s+', '', 'g') as label_key from graph_nodes group by 1, 2")
def normalize_label(s, d):
    return table(s, d, "graph_nodes").groupBy("dataset", "node_id").agg(F.max("category").alias("c")).select("dataset", "node_id", tx.label_key(F.col("c")).alias("label_key"))


@query(
    "yes_no_answer",
    f"""select doc_id, case when a in ('yes', 'edge', 'true') then 'yes' when a in ('no', 'false') then 'no' end as said from
 (select doc_id, regexp_replace(lower({sbody("replace(replace(text, 'robust control', 'Yes.'), 'text mining', 'no')", 'answer')}), '[^a-z]', '', 'g') as a from documents where text is not null)""",
)
def yes_no_answer(s, d):
    t = F.replace(F.replace(body(), F.lit("robust control"), F.lit("Yes.")), F.lit("text mining"), F.lit("no"))
    return docs(s, d).select("doc_id", tx.yes_no(tx.first_body(t, tx.ANSWER)).alias("said"))


_AKEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower(replace({c}, '_', ' ')), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("normalize_answer", f"select item_id, {_AKEY.format(c='text')} as answer_key from eval_items")
def normalize_answer(s, d):
    return table(s, d, "eval_items").select("item_id", tx.answer_key(body()).alias("answer_key"))


@query(
    "cover_exact_match",
    f"""select a.item_id, b.item_id as other_id, list_has_all(string_split({_AKEY.format(c='b.text')}, ' '), string_split({_AKEY.format(c="split_part(a.text, ' ', 1)")}, ' ')) as covered from eval_items a join eval_items b on a.dataset = b.dataset and a.task = b.task""",
)
def cover_exact_match(s, d):
    i = table(s, d, "eval_items")
    a = i.select("item_id", "dataset", "task", F.split_part(body(), F.lit(" "), F.lit(1)).alias("gold"))
    b = i.select(F.col("item_id").alias("other_id"), "dataset", "task", "text")
    return a.join(b, ["dataset", "task"]).select("item_id", "other_id", tx.covers(tx.answer_key(F.col("gold")), tx.answer_key(body())).alias("covered"))


@query(
    "normalize_text",
    f"select item_id, {squestion('concat(text, chr(10), chr(65281), chr(20840), chr(35282), chr(65288), chr(8212), chr(12299), chr(10), text, chr(32), chr(73), task)')} as question_key from eval_items",
)
def normalize_text(s, d):
    wide = F.lit("\n\uff01\u5168\u89d2\uff08\u2014\u300b\n")  # full-width marks around two letters of another script
    return table(s, d, "eval_items").select("item_id", tx.question_key(F.concat("text", wide, "text", F.lit(" I"), "task")).alias("question_key"))


@query("strip_sequence", "select doc_id, regexp_replace(concat('<pad><pad><s>', text, '</s><pad>'), '^(<pad>|<s>|</s>)+|(<pad>|<s>|</s>)+$', '', 'g') as text from documents where text is not null")
def strip_sequence(s, d):
    return docs(s, d).select("doc_id", tx.strip_runs(F.concat(F.lit("<pad><pad><s>"), body(), F.lit("</s><pad>")), ["<pad>", "<s>", "</s>"]).alias("text"))


@query("boxed_answer", "select doc_id, concat('{', cast(doc_id as varchar), '}') as boxed from documents where text is not null")
def boxed_answer(s, d):
    t = F.concat(F.replace(F.replace(F.replace(body(), F.lit("{"), F.lit("(")), F.lit("}"), F.lit(")")), F.lit("\\"), F.lit("/")), F.lit(" so \\boxed{{"), F.col("doc_id").cast("string"), F.lit("}} ends."))
    return docs(s, d).select("doc_id", tx.boxed(t).alias("boxed"))


@query(
    "chat_parts",
    "select item_id, trim(string_split(list_extract(string_split(concat('<|user|>', text, '<|end|><|assistant|>', task, '<|end|>'), '<|user|>'), -1), '<|end|>')[1]) as question, task as solution from eval_items",
)
def chat_parts(s, d):
    c = F.concat(F.lit("<|user|>"), body(), F.lit("<|end|><|assistant|>"), F.col("task"), F.lit("<|end|>"))
    return table(s, d, "eval_items").select("item_id", tx.chat_part(c, "<|user|>", "<|end|>").alias("question"), tx.chat_part(c, "<|assistant|>", "<|end|>").alias("solution"))


@query("thought_text", "select doc_id, string_split(list_extract(string_split(text, '<think>'), -1), '</think>')[1] as thought from documents where contains(text, '<think>')")
def thought_text(s, d):
    return docs(s, d).where(body().contains("<think>")).select("doc_id", tx.last_body(body(), tx.THINK).alias("thought"))


@query(
    "preview_text",
    f"""select record_id, written_at, case when length(summary_en) > 120 then concat(left(summary_en, 120), '...') else summary_en end as short,
 case when length(t) > 120 then concat(left(t, 117), '...') else t end as within from (select *, {sstrip('summary_en')} as t from jsonl_records)""",
)
def preview_text(s, d):
    c = F.col("summary_en")
    return table(s, d, "jsonl_records").select("record_id", "written_at", tx.preview(c, 120).alias("short"), tx.preview_within(c, 120).alias("within"))


@query("token_count", "select doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as tokens from documents where text is not null")
def token_count(s, d):
    return docs(s, d).select("doc_id", tx.token_count(body()).cast("long").alias("tokens"))


_OCC = "cast((length(text) - length(replace(text, '{t}', ''))) / {n} as integer)"


@query(
    "tag_counts",
    "select doc_id, " + ", ".join(f"{_OCC.format(t=t, n=len(t))} as {n}" for t, n in (("<think>", "thinks"), ("<|begin_of_query|>", "queries"), ("<|end_of_query|>", "query_ends"), ("<|begin_of_documents|>", "docs"))) + " from documents where text is not null",
)
def tag_counts(s, d):
    tags = {"thinks": "<think>", "queries": tx.QUERY[0], "query_ends": tx.QUERY[1], "docs": tx.DOCS[0]}
    return docs(s, d).select("doc_id", *[tx.occurrences(body(), t).alias(n) for n, t in tags.items()])


SEGMENTS_SQL = "string_split_regex(regexp_replace(regexp_extract(text, '(?s)<think>(.*?)</think>', 1), '(?s)<\\|begin_of_documents\\|>.*?<\\|end_of_documents\\|>', ' ', 'g'), '(?s)<\\|begin_of_query\\|>.*?<\\|end_of_query\\|>')"


@query(
    "think_segments",
    f"select doc_id, len(segs) as segments, len(list_filter(segs, lambda g: len(list_filter(string_split_regex(g, '\\s+'), lambda x: x <> '')) < 30)) as short from (select doc_id, {SEGMENTS_SQL} as segs from documents where regexp_matches(text, '(?s)<think>(.*?)</think>'))",
)
def think_segments(s, d):
    segs = docs(s, d).select("doc_id", tx.think_segments(body()).alias("segs")).where("segs is not null")
    return segs.select("doc_id", F.size("segs").cast("long").alias("segments"), F.size(F.filter("segs", lambda g: tx.token_count(g) < 30)).cast("long").alias("short"))


_USED = " + ".join("cast(regexp_matches(text, '(?s)<\\|begin_of_query\\|>" + k + ".*?<\\|end_of_query\\|>') as integer)" for k in tx.SEARCH_KINDS)
_USED2 = " + ".join("cast(contains(text, '<|begin_of_query|>" + k + "') and contains(text, '<|end_of_query|>') as integer)" for k in tx.SEARCH_KINDS)


@query("search_coverage", f"select doc_id, {_USED} as in_order, {_USED2} as anywhere from documents where text is not null")
def search_coverage(s, d):
    return docs(s, d).select("doc_id", tx.used_search_kinds(body(), True).alias("in_order"), tx.used_search_kinds(body(), False).alias("anywhere"))


@query(
    "format_neighbours",
    """select dataset, count(*) as n, string_agg(concat('(', cast(rn as varchar), ') ', regexp_replace(text, '^\\s*\\d+\\s+', ''), e'\\n'), '' order by rn) as lines from
 (select dataset, text, row_number() over (partition by dataset order by item_id) as rn from eval_items) where rn <= 5 group by 1""",
)
def format_neighbours(s, d):
    from pyspark.sql import Window

    i = table(s, d, "eval_items").withColumn("rn", F.row_number().over(Window.partitionBy("dataset").orderBy("item_id"))).where("rn <= 5")
    g = i.groupBy("dataset").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("x"))
    return g.select("dataset", "n", tx.neighbour_lines(F.transform("x", lambda r: r["text"])).alias("lines"))


@query("reward_template", "select target_sample_id, ref_pair_id, scored_at, concat('score ', printf('%.2f', round(abs(similarity), 1)), ' for ', ref_split) as line from similar_pairs where similarity is not null and not isnan(similarity) group by all")
def reward_template(s, d):
    p = table(s, d, "similar_pairs").where("similarity is not null and not isnan(similarity)")
    return p.select("target_sample_id", "ref_pair_id", "scored_at", tx.filled_reward("score {reward} for {input}", F.col("ref_split"), F.round(F.abs("similarity"), 1)).alias("line")).distinct()


@query("end_mark", "select item_id, case when ends_with(t, '<eos>') then t else concat(t, ' <eos>') end as text from (select item_id, regexp_replace(concat(text, e'\\n\\n'), '\\n+$', '') as t from eval_items)")
def end_mark(s, d):
    return table(s, d, "eval_items").select("item_id", tx.with_end(F.concat(body(), F.lit("\n\n")), "<eos>").alias("text"))


@query("split_idx_prompt", "select item_id, split_part(concat(cast(item_id as varchar), '<split>', text), '<split>', 1) as idx, text as prompt from eval_items")
def split_idx_prompt(s, d):
    c = F.concat(F.col("item_id").cast("string"), F.lit("<split>"), body())
    return table(s, d, "eval_items").select("item_id", tx.split_marker(c, "<split>", 1).alias("idx"), tx.split_marker(c, "<split>", 2).alias("prompt"))


@query(
    "relation_desc",
    """select dataset, case when contains(l, 'paper') or contains(l, 'arxiv') or contains(l, 'cite') or contains(l, 'med') then 'citation' when contains(l, 'shop') or contains(l, 'amazon') or contains(l, 'product') then 'co-purchase'
 when contains(l, 'forum') or contains(l, 'reddit') or contains(l, 'board') then 'shared discussion' else 'link' end as relation from (select dataset, lower(dataset) as l from graph_datasets)""",
)
def relation_desc(s, d):
    return table(s, d, "graph_datasets").select("dataset", tx.relation_of(F.col("dataset")).alias("relation"))


@query("truth_words", "select sample_id, exported_at, case when (label = 1) then 'yes' when (label = 0) then 'no' end as word from pair_samples group by all")
def truth_words(s, d):
    p = table(s, d, "pair_samples").select("sample_id", "exported_at", F.when(F.col("label") == 1, F.lit("True")).when(F.col("label") == 0, F.lit("False")).alias("w")).distinct()
    return p.select("sample_id", "exported_at", tx.truth_word(F.col("w")).alias("word"))


@query("reflection_cue", """select doc_id, concat('You searched ', scope, ' for "', q, '". Reflect on what was found before the next step.') as cue from (select doc_id, split_part(q0, ':', 2) as q, case when starts_with(q0, '1-hop') then 'direct neighbours' when starts_with(q0, '2-hop') then 'neighbours of neighbours' when starts_with(q0, 'pagerank') then 'globally important nodes' else 'semantically similar nodes' end as scope from (select doc_id, trim(regexp_replace(regexp_extract(text, '(?s)<\\|begin_of_query\\|>(.*?)<\\|end_of_query\\|>', 1), ':\\s+', ':')) as q0 from documents where regexp_matches(text, '(?s)<\\|begin_of_query\\|>(.*?)<\\|end_of_query\\|>')))""")
def reflection_cue(s, d):
    q = docs(s, d).select("doc_id", tx.first_body(body(), tx.QUERY).alias("q")).where("q is not null")
    c = F.col("q")
    return q.select("doc_id", F.concat(F.lit("You searched "), tx.search_scope(c), F.lit(' for "'), tx.search_text(c), F.lit('". Reflect on what was found before the next step.')).alias("cue"))
