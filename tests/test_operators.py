"""Edge cases of operators and expressions, with results worked out by hand."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.functions import rewards as rw
from graphloom.functions import text as tx
from graphloom.functions import vectors as vx
from graphloom.operators import datasets as ds
from graphloom.operators import evaluate as ev
from graphloom.operators import graph as g
from graphloom.operators import mixing as mx
from graphloom.operators import prompts as pr
from graphloom.operators import registry as rg
from graphloom.operators import retrieve as rt
from graphloom.operators import rollout as ro
from graphloom.operators import rollout_math as rm
from graphloom.sources import readers as rd
from graphloom.sources import writers as wr


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    "text,want",
    [("<answer> a\n</answer><answer>b</answer>", "a"), ("none", None), ("<answer></answer>", ""), ("<answer>open", None), (None, None), ("", None)],
)
def test_first_body(spark, text, want):
    assert one(spark, text, lambda c: tx.first_body(c, tx.ANSWER)) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("x <|begin_of_query|> 1-hop:  a\n b <|end_of_query|>", "1-hop: a b"),
        ("<|begin_of_query|>a<|end_of_query|> <|begin_of_query|>\"b\"<|end_of_query|>", "b"),
        ("<|begin_of_query|> <|end_of_query|>", None),
        ("<|begin_of_query|>open", None),
        ("none", None),
    ],
)
def test_last_query(spark, text, want):
    assert one(spark, text, tx.last_query) == want


@pytest.mark.parametrize(
    "query,kind,rest",
    [("1 hop: x", "one_hop", "x"), ("PageRank:", "pagerank", ""), ("what: y", "similar", "y"), ("plain words", "similar", "plain words"), ("sim:z", "similar", "z"), ("two-hop: a: b", "two_hop", "a: b")],
)
def test_search_parts(spark, query, kind, rest):
    assert one(spark, query, tx.search_kind) == kind
    assert one(spark, query, tx.search_text) == rest


@pytest.mark.parametrize("text,want", [(r"so \boxed{a{b}c} end", "a{b}c"), (r"\boxed{x} \boxed{y}", "y"), (r"\boxed{open", None), ("none", None)])
def test_boxed(spark, text, want):
    assert one(spark, text, tx.boxed) == want


@pytest.mark.parametrize("text,want", [("Yes!", "yes"), ("an edge", None), ("TRUE.", "yes"), ("no", "no"), ("", None), (None, None)])
def test_yes_no(spark, text, want):
    assert one(spark, text, tx.yes_no) == want


def test_previews_and_counts(spark):
    assert one(spark, "abcdef", lambda c: tx.preview(c, 4)) == "abcd..."
    assert one(spark, "abcd", lambda c: tx.preview(c, 4)) == "abcd"
    assert one(spark, " abcdef ", lambda c: tx.preview_within(c, 5)) == "ab..."
    assert one(spark, " a  b\t", tx.token_count) == 2
    assert one(spark, "", tx.token_count) == 0
    assert one(spark, "aaa", lambda c: tx.occurrences(c, "aa")) == 1


def test_label_key_takes_all_white_space(spark):
    assert one(spark, " Signal  Theory ", tx.label_key) == "signaltheory"


def full(answer, segments=("w " * 40,), queries=0):
    return "<think>" + segments[0] + "".join(f"<|begin_of_query|>1-hop: a<|end_of_query|><|begin_of_documents|>d<|end_of_documents|>{'w ' * 40}" for _ in range(queries)) + f"</think><answer>{answer}</answer>"


def reward(spark, response, gold, rules, link):
    kind = "int" if link else "string"
    df = spark.createDataFrame([(response, gold)], f"r string, g {kind}")
    return round(df.select(rw.total(F.col("r"), F.col("g"), rules, link).alias("x")).first().x, 6)


def test_rewards(spark):
    assert reward(spark, full("ML "), "ml", rw.NC_STAGE1, False) == pytest.approx(1.5 + 0.6 + 0.5)
    assert reward(spark, full("ml", queries=2), "ml", rw.NC_STAGE1, False) == pytest.approx(1.5 + 0.6 + 0.5 + 0.5)
    assert reward(spark, full("ml"), None, rw.NC_STAGE1, False) == pytest.approx(-0.5 + 0.6 + 0.5)
    assert reward(spark, "", "ml", rw.NC_STAGE1, False) == pytest.approx(-1 - 0.5 + 0.1 - 0.3)
    assert reward(spark, None, None, rw.LP_STAGE1, True) == pytest.approx(-1 - 0.5 + 0.1 - 0.3)
    assert reward(spark, full("yes"), 1, rw.LP_STAGE2, True) == pytest.approx(1.5 + 0.8 - 0.15 - 0.2)
    long = tuple(["w " * 100])
    assert reward(spark, full("no", long).replace("</think>", "<|begin_of_query|>a<|end_of_query|>" + "w " * 100 + "</think>"), 0, rw.LP_STAGE2, True) == pytest.approx(1.5 + 0.8 + 0.5)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vx.norm(F.col("a")), vx.unit(F.col("a")), vx.unit_or_same(F.col("b")), vx.dot(F.col("a"), F.col("a"))).first()
    assert r[0] == 5 and r[1] == [0.6, 0.8] and r[2] == [0.0, 0.0] and r[3] == 25
    d = spark.createDataFrame([([1.0, 2.0, 3.0], [0.5, 0.5, 0.5])], "r array<double>, v array<double>")
    assert d.select(vx.discounted(F.col("r"), 0.5)).first()[0] == [1 + 0.5 * 3.5, 3.5, 3.0]
    a = d.select(vx.advantages(F.col("r"), F.col("v"), 1.0, 1.0)).first()[0]
    assert a == pytest.approx([5.5, 4.5, 2.5])
    e = d.select(vx.discounted(F.array().cast("array<double>"), 0.5)).first()[0]
    assert e == []


def test_edges_and_hops(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (2, 3), (None, 4), (5, None)], "src long, dst long")
    c = g.canonical_edges(e)
    assert sorted(map(tuple, c.collect())) == [(1, 2), (2, 3)]
    adj = g.both_ways(c.withColumn("k", F.lit("g")), ["k"])
    assert sorted(map(tuple, g.two_hops(adj, None, ["k"]).collect())) == [("g", 1, 3), ("g", 3, 1)]
    only = spark.createDataFrame([("g", 3)], "k string, src long")
    assert [tuple(r) for r in g.two_hops(adj, only, ["k"]).collect()] == [("g", 3, 1)]
    empty = g.canonical_edges(e.where("false"))
    assert empty.count() == 0


def test_pagerank_adds_up_and_ranks_the_hub_first(spark):
    nodes = spark.createDataFrame([("g", i) for i in range(5)], "k string, node_id long")
    adj = g.both_ways(spark.createDataFrame([("g", 0, i) for i in range(1, 4)], "k string, u long, v long"), ["k"])
    r = {x.node_id: x.pr for x in g.pagerank(nodes, adj, ["k"], rounds=12, cut=4).collect()}
    assert sum(r.values()) == pytest.approx(1) and max(r, key=r.get) == 0 and r[4] == min(r.values())


@pytest.mark.parametrize("n,want", [(0, []), (1, ["medium"]), (2, ["medium"] * 2), (3, ["hard", "medium", "easy"]), (4, ["hard", "medium", "easy", "easy"])])
def test_node_terciles(spark, n, want):
    df = spark.createDataFrame([("g", i, float(i)) for i in range(n)], "k string, node_id long, score double")
    assert [r.difficulty for r in g.tercile_nodes(df, ["k"]).orderBy("node_id").collect()] == want


@pytest.mark.parametrize("n,want", [(1, ["easy"]), (2, ["easy"] * 2), (3, ["easy", "medium", "hard"]), (4, ["easy", "medium", "hard", "hard"])])
def test_pair_terciles(spark, n, want):
    df = spark.createDataFrame([(i, float(n - i)) for i in range(n)], "pair_id long, similarity double")
    got = g.tercile_pairs(df, [], F.lit(True)).orderBy("pair_id").collect()
    assert [r.difficulty for r in got] == want


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (5, 5), (0, 5)], "h long, n long").select(g.wilson(F.col("h"), F.col("n")).alias("w"))
    w = [r.w for r in df.collect()]
    assert w[0] == 0 and w[2] == pytest.approx(0, abs=1e-9) and w[1] == pytest.approx(1 / (1 + 3.8416 / 5))


def test_neighbour_roles_fill_up_from_the_other_side(spark):
    df = spark.createDataFrame([(1, 10, 20, [7], [7, 1, 2, 20], [7, 5])], "pair_id long, node_u long, node_v long, c array<long>, u array<long>, v array<long>")
    got = rt.neighbour_roles(df, "c", "u", "v", 5).orderBy("doc_id").collect()
    assert [r.role for r in got] == ["common", "u", "u", "v"] and {r.neighbour for r in got} == {7, 1, 2, 5}
    assert rt.neighbour_roles(df, "c", "u", "v", 0).count() == 0
    none = spark.createDataFrame([(1, 10, 20, None, None, None)], "pair_id long, node_u long, node_v long, c array<long>, u array<long>, v array<long>")
    assert rt.neighbour_roles(none, "c", "u", "v", 5).count() == 0


def test_top_k_of_nothing_and_of_zero(spark):
    c = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.5), (1, 7, 0.1)], "qid long, cand long, score double")
    assert [r.cand for r in rt.ranked(c, ["qid"], "score", "cand", 2).orderBy("doc_id").collect()] == [5, 6]
    assert rt.ranked(c, ["qid"], "score", "cand", 0).count() == 0
    assert rt.ranked(c.where("false"), ["qid"], "score", "cand", 3).count() == 0


def test_similar_candidates_match_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(30, 4))
    emb = spark.createDataFrame([("g", i, [float(x) for x in m[i]]) for i in range(30)], "dataset string, node_id long, emb array<double>")
    ask = spark.createDataFrame([(i, "g", i) for i in range(0, 30, 7)], "qid long, dataset string, node_id long")
    got = {(r.qid, r.cand) for r in rt.ranked(rt.similar_candidates(ask, emb, 3, block=2), ["qid"], "score", "cand", 3).collect()}
    want = set()
    for q in range(0, 30, 7):
        s = m @ m[q]
        s[q] = -np.inf
        want |= {(q, int(c)) for c in np.argsort(-s)[:3]}
    assert got == want


def test_missing_vector_is_an_error(spark):
    emb = spark.createDataFrame([("g", 1, [1.0])], "dataset string, node_id long, emb array<double>")
    pairs = spark.createDataFrame([("g", 1, 2)], "dataset string, u long, v long")
    with pytest.raises(PySparkException):
        ds.pair_vectors(pairs, emb).collect()


def test_negative_pairs_are_no_edges(spark):
    nodes = spark.createDataFrame([("g", i) for i in range(12)], "dataset string, node_id long")
    edges = spark.createDataFrame([("g", 0, i) for i in range(1, 12)], "dataset string, u long, v long")
    got = ds.negative_pairs(nodes, edges, 10, 1).collect()
    assert len(got) == 10 and all(0 < r.u < r.v for r in got) and len({(r.u, r.v) for r in got}) == 10


def test_local_ids(spark):
    off = spark.createDataFrame([("g", 100, 10)], "dataset string, offset long, size long")
    rows = spark.createDataFrame([("g", 105), ("g", 5), ("g", 50), ("g", 110), ("h", 1)], "dataset string, node_id long")
    assert sorted(r.node_id for r in ds.local_ids(rows, off, "node_id").collect()) == [5, 5]


def test_group_numbers_of_one(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 0), ("b", 4.0, 1)], "g string, r double, pos int")
    assert [r.advantage for r in rm.group_normalised(df, "g", "r").where("g = 'a'").collect()] == [None]
    assert [r.advantage for r in rm.leave_one_out(df, "g", "r").where("g = 'a'").collect()] == [None]
    assert sorted(r.advantage for r in rm.leave_one_out(df, "g", "r").where("g = 'b'").collect()) == [-2, 2]
    assert rm.best_and_worst(df.withColumn("o", F.lit(1)), "g", "o", "r", "pos").count() == 1


def test_span_mask_that_is_not_closed(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate("..S.E.S..")], "s int, p int, t string")
    got = rm.span_mask(df, "s", "p", F.col("t") == "S", F.col("t") == "E").orderBy("p").collect()
    assert [r.loss_mask for r in got] == [1, 1, 0, 0, 0, 1, 0, 0, 0]


def test_interleaving(spark):
    assert mx.pattern({"a": 0.5, "b": 0.25, "c": 0.25, "d": 0}) == {"a": (2, 0, 4), "b": (1, 2, 4), "c": (1, 3, 4)}
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(2)], "s string, i int")
    got = mx.interleaved(df, "s", [F.col("i")], {"a": 0.5, "b": 0.5}).orderBy("place").collect()
    assert [r.s for r in got] == ["a", "b", "a", "b"]


def test_sampler_wraps_and_drops(spark):
    df = spark.range(10).toDF("i")
    assert mx.sampled_ranks(df, [F.col("i")], 4).count() == 12
    assert mx.sampled_ranks(df, [F.col("i")], 4, drop_tail=True).count() == 8
    assert mx.sampled_ranks(df.where("false"), [F.col("i")], 4).count() == 0


def test_accuracy_and_comparison(spark):
    df = spark.createDataFrame([(1, "a", ["a", "b"]), (2, "c", ["a"]), (3, None, ["a"])], "k int, predicted string, gold array<string>")
    r = ev.accuracy(df, []).first()
    assert (r.total, r.right, r.skipped, r.percent) == (2, 1, 1, 50.0)
    second = spark.createDataFrame([(1, "x"), (2, "a"), (3, "a")], "k int, predicted string")
    c = ev.compared(df, second, "k").first()
    assert (c.improved, c.degraded, c.same) == (2, 1, 0)
    h = {r.bin: r.n for r in ev.histogram(spark.createDataFrame([(0.0,), (10.0,), (11.0,)], "v double"), "v", 0, 10, 10).collect()}
    assert h == {1: 1, 10: 1}


def test_rollout_ends(spark):
    items = spark.createDataFrame([(i, f"p{i} ") for i in range(4)], "qid long, prompt string")
    got = {r.qid: r for r in ro.rollout(items, ro.scripted, lambda q: q.select("qid", F.lit("(1) d\n").alias("docs")), rounds=6, searches=2).collect()}
    assert [got[i].searches for i in range(4)] == [0, 1, 2, 2] and all(r.finished for r in got.values())
    assert got[1].transcript.count(tx.DOCS[0]) == 1
    short = ro.rollout(items, ro.scripted, lambda q: q.select("qid", F.lit("d").alias("docs")), rounds=2, searches=5).collect()
    assert sorted((r.qid, r.finished) for r in short) == [(0, True), (1, True), (2, False), (3, False)]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text("﻿{\"a\": 1}\n\n{\"a\": 2}\nnot json\n", encoding="utf-8")
    ok, bad = rd.json_lines(spark, str(p), "a long")
    assert sorted(r.a for r in ok.collect()) == [1, 2] and bad.count() == 1


def test_registry_and_options(spark, tmp_path):
    files = spark.createDataFrame([(0, "a", "train", 5), (1, "b", "train", 3)], "position int, dataset string, split string, pairs long")
    assert [r.base_offset for r in rd.source_registry(files).orderBy("position").collect()] == [0, 5]
    with pytest.raises(PySparkException):
        rd.source_registry(files.union(files)).collect()
    p = tmp_path / "runs.json"
    p.write_text('{"shared": {"k": "5", "m": "x"}, "runs": [{"name": "r1", "k": "7"}]}')
    r = rd.run_options(spark, str(p)).first()
    assert r.name == "r1" and r.options == {"k": "7", "m": "x", "name": "r1"}
    q = tmp_path / "c.txt"
    q.write_text("'arx': ['a', 'b']\n'pub': ['c']")
    assert rd.category_dictionary(spark, str(q)).count() == 3


def test_unknown_processor_and_existing_output(spark, tmp_path):
    with pytest.raises(ValueError):
        rg.processor("none")
    df = spark.range(3).toDF("i")
    wr.write_jsonl(df, str(tmp_path / "o"))
    with pytest.raises(PySparkException):
        wr.write_jsonl(df, str(tmp_path / "o"))
    wr.write_jsonl(df, str(tmp_path / "o"), force=True)


def test_rewritten_keeps_a_backup(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    backup = wr.rewritten(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(f"file://{backup}").count() == 3


def test_prompt_limits(spark):
    df = spark.createDataFrame([(0, 0), (None, 0), (None, 7), (3, None)], "own int, d int")
    assert [r.r for r in df.select(pr.pool_limit(F.col("own"), F.col("d")).alias("r")).collect()] == [0, 5, 7, 3]


def test_plans_have_no_cartesian_and_push_filters_down(spark):
    from graphloom.plans import registry

    d = "/root/testdata/sf0.001"
    plan = registry.QUERIES["retrieve_one_hop"](spark, d)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "WindowGroupLimit" in plan
    plan = registry.QUERIES["pricing_summary"](spark, d)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_partkey" not in plan.split("ReadSchema")[1]


def test_smoothing(spark):
    df = spark.createDataFrame([([1.0, 1.0],)], "x array<double>")
    assert df.select(vx.smoothed(F.col("x"), 0.9)).first()[0] == pytest.approx(0.19)
    assert math.isclose(df.select(vx.adapted_coefficient(F.col("x"), 1.0, 1.0, 1.0, 1.0)).first()[0], 1.0)


@pytest.mark.parametrize("partitions", ["1", "3", "9"])
def test_positions_over_partitions(spark, partitions):
    from graphloom.operators.ranking import group_positions, numbered

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([("hot", (i * 37) % 500) for i in range(500)] + [(f"g{i % 9}", i) for i in range(60)] + [(None, i) for i in range(5)], "g string, i long")
        got = numbered(df, [F.col("i"), F.col("g")]).collect()
        assert [r.place for r in sorted(got, key=lambda r: (r.i, r.g is not None, r.g or ""))] == list(range(565))
        per = {(r.g, r.i): (r.rank, r.size) for r in group_positions(df, ["g"], [F.col("i")]).collect()}
        assert len(per) == 565 and all(per["hot", i] == (i, 500) for i in range(500)) and per[None, 3] == (3, 5) and per["g0", 9] == (1, 7)
        assert group_positions(df.where("false"), ["g"], [F.col("i")]).count() == 0 and numbered(df.where("false"), [F.col("i")]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_common_neighbours_of_a_hub(spark):
    e = spark.createDataFrame([("g", 0, i) for i in range(1, 30)] + [("g", 1, 2), ("g", 2, 3)], "k string, u long, v long")
    got = {(r.u, r.v): (r.n_u, r.n_v, r.common) for r in g.common_neighbours(e, g.both_ways(e, ["k"]), ["k"]).collect()}
    assert got[0, 1] == (29, 2, [2]) and got[0, 2] == (29, 3, [1, 3]) and got[1, 2] == (2, 3, [0]) and got[0, 9] == (29, 1, [])


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.integers(0, 20).map(lambda n: n / 20), min_size=1))
def test_pattern_fills_its_cycle(shares):
    p = mx.pattern(shares)
    assert set(p) == {k for k, v in shares.items() if v > 0}
    taken = sorted(x for n, at, _ in p.values() for x in range(at, at + n))
    length = max((c[2] for c in p.values()), default=0)
    assert taken == list(range(length)) and all(abs(n / length - shares[k] / sum(shares.values())) < 1e-9 for k, (n, _, _) in p.items())
