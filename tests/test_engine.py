"""Engines, jobs, hooks and streams on small tables."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom import jobs
from graphloom.engine import GraphEngine, LinkEngine
from graphloom.operators import graph as g
from graphloom.operators import hooks as hk
from graphloom.operators import mixing as mx
from graphloom.sources import readers as rd


@pytest.fixture(scope="module")
def engine(spark):
    rng = np.random.default_rng(0)
    rows = [(d, i, f"l{i % 2}", f"text {d}{i}" if i else "", float(i)) for d in ("a", "b") for i in range(6)]
    nodes = spark.createDataFrame(rows, "dataset string, node_id long, label string, text string, pagerank double")
    adj = g.both_ways(spark.createDataFrame([(d, i, i + 1) for d in ("a", "b") for i in range(4)], "dataset string, u long, v long"), ["dataset"])
    emb = spark.createDataFrame([(d, i, [float(x) for x in rng.normal(size=64)]) for d in ("a", "b") for i in range(6)], "dataset string, node_id long, emb array<double>")
    return GraphEngine(nodes, adj, emb, default_k=2)


def test_batches_over_graphs(spark, engine):
    engine.check()
    q = spark.createDataFrame([(1, 1, "1-hop: x", None), (2, 8, "2-hop:", None), (3, 7, "pagerank: y", "1"), (4, 0, "similar: z", "9"), (5, 5, "1-hop: none", None), (6, 2, "similar:", "-3")], "qid long, gid long, query string, max_results string")
    got = {r.qid: r for r in engine.batch_query(q).collect()}
    assert {d.node_id for d in got[1].docs} == {0, 2} and got[1].dataset == "a" and got[1].score_name == "similarity"
    assert {d.node_id for d in got[2].docs} == {0, 4} and got[2].dataset == "b" and got[2].target.text_preview == "text b2"
    assert [d.node_id for d in got[3].docs] == [5] and got[3].score_name == "pagerank"
    assert len(got[4].docs) == 5 and [d.doc_id for d in got[4].docs] == [1, 2, 3, 4, 5]
    assert got[5].docs == [] and got[6].docs == []
    assert next(d.doc for d in got[1].docs if d.node_id == 0) == "Node 0"
    with pytest.raises(PySparkException):
        engine.batch_query(spark.createDataFrame([(1, 99, "1-hop:")], "qid long, gid long, query string")).collect()


def test_inconsistent_graphs_are_refused(spark, engine):
    with pytest.raises(ValueError):
        GraphEngine(engine.nodes.where("node_id < 5"), engine.adjacency, engine.vectors).check()


def test_graph_folders(spark, tmp_path):
    for name in ("g_one", "two"):
        d = tmp_path / name
        d.mkdir()
        (d / "node_texts.json").write_text(json.dumps(["a", {"summary": "b"}, None]))
        (d / "category.json").write_text(json.dumps([["x"], "y", "z"]))
        (d / "first_hop_indices.json").write_text(json.dumps([[1, 2], [0], None]))
        np.save(d / "node_emb.npy", np.eye(3, 64, dtype=np.float32))
    assert rd.discovered(str(tmp_path)) == ["g_one", "two"]
    e = GraphEngine.from_folders(spark, f"file://{tmp_path}", ["g-one", "two"])
    e.check()
    r = e.batch_query(spark.createDataFrame([(1, "two", 0, "1-hop:")], "qid long, dataset string, node_id long, query string")).first()
    assert {d.doc for d in r.docs} == {"b", "Node 2"} and r.target.label == "x"
    with pytest.raises(FileNotFoundError):
        GraphEngine.from_folders(spark, f"file://{tmp_path}", ["none"])


def test_edge_index_shape(spark, tmp_path):
    from graphloom.sources.npy import edge_index

    np.save(tmp_path / "e.npy", np.array([[0, 1, 2], [1, 2, 0]]))
    assert sorted(map(tuple, edge_index(spark, str(tmp_path / "e.npy")).collect())) == [(0, 1), (1, 2), (2, 0)]
    np.save(tmp_path / "f.npy", np.zeros((3, 3)))
    with pytest.raises(ValueError):
        edge_index(spark, str(tmp_path / "f.npy"))


def test_link_engine(spark):
    sp = "array<struct<pair_id:long,split:string,node_u:long,node_v:long,label:int,similarity:double,is_edge:boolean>>"
    pairs = spark.createDataFrame([(1, "g", 0, 1, [2], [2, 3, 1], [2, 4], [(9, "train", 5, 6, 1, 0.5, True)]), (2, "g", 5, 6, None, None, None, None)], f"pair_id long, dataset string, node_u long, node_v long, common_1hop array<long>, node_u_1hop array<long>, node_v_1hop array<long>, similar_pairs {sp}")
    texts = spark.createDataFrame([("g", 2, "two"), ("g", 5, "five")], "dataset string, node_id long, text string")
    top = spark.createDataFrame([("g", 0, 1, True, 0), ("g", 5, 6, True, 1), ("g", 2, 3, False, 2)], "dataset string, node_u long, node_v long, is_edge boolean, rank int")
    e = LinkEngine(pairs, texts, top, default_k=3, limits={"pagerank": 1})
    q = spark.createDataFrame([(1, 1, "1-hop:"), (2, 1, "similar:"), (3, 1, "pagerank:"), (4, 2, "1-hop:"), (5, 2, "similar:"), (6, 2, "pagerank:")], "qid long, pair_id long, query string")
    got = {}
    for r in e.batch_query(q).orderBy("qid", "doc_id").collect():
        got.setdefault(r.qid, []).append(r)
    assert [r.doc.split("]")[0] for r in got[1]] == ["[common one_hop neighbour", "[Node U one_hop neighbour", "[Node V one_hop neighbour"] and "two" in got[1][0].doc
    assert got[2][0].doc == "[similar pair] existing edge. First node: five. Second node: Node 6." and got[2][0].score_name == "reference"
    assert "First node: five" in got[3][0].doc and len(got[3]) == 1 and "Node 1" in got[6][0].doc
    assert 4 not in got and 5 not in got


def graph(spark, n=60):
    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([("g", i, f"c{i % 3}", "train" if i % 3 else "test", f"t{i}" if i % 10 else " ") for i in range(n)], "dataset string, node_id long, label string, split string, text string")
    edges = spark.createDataFrame([("g", int(a), int(b)) for a, b in rng.integers(0, n, (4 * n, 2))], "dataset string, src long, dst long")
    emb = spark.createDataFrame([("g", i, [float(x) for x in rng.normal(size=8)]) for i in range(n)], "dataset string, node_id long, emb array<double>")
    return nodes, edges, emb


def test_node_samples_and_exclusion(spark):
    nodes, edges, _ = graph(spark)
    adj = g.both_ways(g.canonical_edges(edges, by=["dataset"]), ["dataset"])
    one = jobs.nc_generate(nodes, adj, "stage1", 1, {"easy": 3, "medium": 3, "hard": 3}).collect()
    assert len(one) == 9 and all(r.node_id % 3 and r.node_id % 10 for r in one)
    ev = jobs.nc_generate(nodes, adj, "eval", 1, {}, split="test", size=5)
    blocked = spark.createDataFrame([("g", r.node_id) for r in one], "dataset string, node_id long").union(ev.select("dataset", "node_id"))
    two = jobs.nc_generate(nodes, adj, "stage2", 1, {"medium": 2, "hard": 2}, blocked=blocked).collect()
    assert not {r.node_id for r in one} & {r.node_id for r in two} and ev.count() == 5
    with pytest.raises(ValueError):
        jobs.nc_generate(nodes, adj, "stage1", 1, {"easy": 999})


def test_link_dataset(spark):
    nodes, edges, emb = graph(spark)
    out = jobs.build_lp(nodes, edges, emb, 5, (20, 20), (6, 6), 4).collect()
    e = {tuple(r)[1:] for r in g.canonical_edges(edges, by=["dataset"]).collect()}
    train, test = [r for r in out if r.split == "train"], [r for r in out if r.split == "test"]
    assert len(train) == 40 and len(test) == 12 and len({(r.u, r.v) for r in out}) == 52
    assert all(((r.u, r.v) in e) == (r.label == 1) for r in out)
    assert sorted(r.pair_id for r in train) == list(range(40))
    rank = {"easy": 0, "medium": 1, "hard": 2}
    assert [rank[r.difficulty] for r in sorted(train, key=lambda r: r.pair_id)] == sorted(rank[r.difficulty] for r in train)
    held = {(r.u, r.v) for r in test if r.label == 1}
    for r in out:
        refs = [(x.node_u, x.node_v) for x in r.similar_pairs]
        assert len(refs) == 4 and (r.u, r.v) not in refs and not held & set(refs)
        assert r.common_1hop == sorted(set(r.node_u_1hop) & set(r.node_v_1hop))


def test_link_dataset_fills_references_among_many_negatives(spark):
    nodes, edges, emb = graph(spark)
    n_edges = g.canonical_edges(edges, by=["dataset"]).count()
    out = jobs.build_lp(nodes, edges, emb, 5, (20, 3 * n_edges), (6, 2 * n_edges), 4).collect()
    assert sum(r.label == 0 for r in out) == 5 * n_edges
    assert all(r.similar_pairs is not None and len(r.similar_pairs) == 4 for r in out)


def test_link_dataset_of_ids_with_gaps(spark):
    nodes, edges, emb = graph(spark)
    far = lambda df, *cols: df.union(df.withColumns({c: F.col(c) + 1_000_000 for c in cols}).select(*df.columns))
    nodes, edges, emb = far(nodes, "node_id"), far(edges, "src", "dst"), far(emb, "node_id")
    there = {r.node_id for r in nodes.collect()}
    out = jobs.build_lp(nodes, edges, emb, 5, (20, 20), (6, 6), 4).collect()
    assert sum(r.label == 0 for r in out) == 26 and any({r.u, r.v} - there for r in out)
    for r in out:
        if {r.u, r.v} <= there:
            assert r.similarity is not None and len(r.similar_pairs) == 4
        else:
            assert r.label == 0 and r.similarity is None and r.difficulty is None and r.similar_pairs is None
    with pytest.raises(PySparkException):
        jobs.build_lp(nodes, edges, emb.where("node_id < 1000000"), 5, (20, 20), (6, 6), 4).collect()


def test_link_pairs_of_ids_with_gaps_are_those_of_sql(spark, tmp_path):
    import duckdb

    from graphloom.plans import registry

    nodes, edges, _ = graph(spark)
    far = lambda df, *cols: df.union(df.withColumns({c: F.col(c) + 1_000_000 for c in cols}).select(*df.columns))
    n = far(nodes, "node_id").select("dataset", "node_id", F.lit("x").alias("category"), "split", F.lit(None).cast("double").alias("pagerank"), F.lit(None).cast("long").alias("same_as"))
    n.write.parquet(f"{tmp_path}/graph_nodes.parquet")
    far(edges, "src", "dst").select("dataset", "src", "dst").write.parquet(f"{tmp_path}/graph_edges.parquet")
    c = duckdb.connect()
    for t in ("graph_nodes", "graph_edges"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.QUERIES["job_lp_pairs"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(c.sql(registry.SQL["job_lp_pairs"]).fetchall()) and len(got) == 30


def test_command_line(spark, tmp_path):
    p = str(tmp_path / "p.parquet")
    spark.createDataFrame([(1, "HARD"), (2, None), (3, "easy")], "pair_id long, difficulty string").write.parquet(p)
    jobs.main(["lp-stage", "--pairs", p, "--out", str(tmp_path / "o")])
    assert {r.pair_id for r in spark.read.json(str(tmp_path / "o")).collect()} == {1, 2}
    with pytest.raises(ValueError):
        jobs.difficulties(" , ")


def test_weighted_interleaving(spark):
    df = spark.createDataFrame([("a", i) for i in range(300)] + [("b", i) for i in range(100)] + [("c", i) for i in range(5)], "s string, i int")
    first = mx.weighted_interleaved(df, "s", [F.col("i")], {"a": 0.6, "b": 0.4}, 1).orderBy("place").collect()
    assert [r.place for r in first] == list(range(len(first))) and 180 < len(first) < 330 and {r.s for r in first} == {"a", "b"}
    for s in "ab":
        assert [r.i for r in first if r.s == s] == list(range(sum(r.s == s for r in first)))
    every = mx.weighted_interleaved(df, "s", [F.col("i")], {"a": 0.6, "b": 0.4}, 1, "all_exhausted").collect()
    assert {(r.s, r.i) for r in every} == {("a", i) for i in range(300)} | {("b", i) for i in range(100)}


def test_hooks(spark):
    df = spark.createDataFrame([("ab",), ("c",), (None,)], "t string")
    assert [r.reward for r in hk.scored(df, "t", lambda: lambda xs: [float(len(x)) for x in xs]).collect()] == [2.0, 1.0, 0.0]
    two = [lambda xs: [1.0] * len(xs), lambda xs: [float(len(x)) for x in xs]]
    assert [r.reward for r in hk.summed_rewards(df, "t", two).collect()] == [3.0, 2.0, 1.0]
    best = hk.best_of_n(spark.createDataFrame([(1,), (2,)], "k int"), "k", 4, lambda d: d.withColumn("output", F.concat_ws("-", "k", "sample")), lambda d: d.withColumn("reward", (F.col("sample") % 3).cast("double")))
    assert {r.output for r in best.collect()} == {"1-2", "2-2"}
    with pytest.raises(PySparkException):
        hk.single_token_ids(df, "t", spark.createDataFrame([("ab", 1)], "token string, id long")).collect()
    e = rd.remote_vectors(df, "t", lambda: lambda xs: [[float(len(x))] for x in xs]).collect()
    assert [r.embedding for r in e] == [[2.0], [1.0], [0.0]]
    phases = {}
    with hk.timed(phases, "x"):
        watched, o = hk.observed(df, "o", n=F.count("*"))
        watched.collect()
    assert phases["x"] > 0 and o.get["n"] == 3


def test_late_events_are_dropped_by_the_watermark(spark, tmp_path):
    from graphloom.streaming import jobs as sj

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in/*")
    (tmp_path / "in").mkdir()
    batches = [["2030-01-01 00:00:00", "2030-01-01 12:00:00"], ["2030-01-01 00:10:00"], ["2030-01-03 00:00:00"], ["2030-01-03 00:01:00"]]
    q = None
    for i, times in enumerate(batches):
        df = spark.createDataFrame([(i, t, 1, "x", 1.0) for t in times], "event_id long, ts string, user_id long, event_type string, value double")
        df.select("event_id", F.to_timestamp("ts").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
        q = q or sj.tumbling(stream, "1 hour", "1 hour").writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", f"file://{tmp_path}/c").start()
        q.processAllAvailable()
    q.stop()
    got = {str(r.start): r.n for r in spark.table("late").collect()}
    assert got == {"2030-01-01 00:00:00": 1, "2030-01-01 12:00:00": 1}  # the row at 00:10 came after the watermark had passed it


def test_suite_checks_its_runs(spark, tmp_path):
    samples = spark.createDataFrame([(1, "a", "p ", "1"), (2, "a", "p ", "x"), (3, "b", "p ", "3")], "qid long, dataset string, prompt string, gold string")
    samples.write.parquet(f"{tmp_path}/s.parquet")
    put = lambda name, x: (tmp_path / name).write_text(json.dumps(x)) and f"file://{tmp_path}/{name}"
    shared = {"samples": f"{tmp_path}/s.parquet", "out": f"{tmp_path}/out.json", "rounds": "6"}
    good = put("good.json", {"shared": shared, "runs": [{"name": "r1", "datasets": "a, b"}, {"name": "r2", "datasets": "b"}]})
    none = lambda asking: asking.select("qid", F.lit("None\n").alias("docs"))
    from graphloom.operators.rollout import scripted

    assert jobs.suite(spark, good, scripted, none, dry_run=True) == [("r1", "a"), ("r1", "b"), ("r2", "b")]
    assert not (tmp_path / "out.json").exists()
    jobs.suite(spark, good, scripted, none)
    got = {(r.run, r.dataset): (r.right, r.total) for r in spark.read.json(f"{tmp_path}/out.json").collect()}
    assert got == {("r1", "a"): (1, 2), ("r1", "b"): (1, 1), ("r2", "b"): (1, 1)}
    with pytest.raises(ValueError, match="r1 lacks out"):
        jobs.suite(spark, put("bad.json", {"shared": {"samples": "x"}, "runs": [{"name": "r1", "datasets": "a"}]}), scripted, none)


def test_embedding_job_reads_its_cache(spark, tmp_path):
    t = spark.createDataFrame([("a", 1, "xy"), ("a", 2, None)], "dataset string, node_id long, text string")
    length = lambda: lambda texts: [[float(len(x))] for x in texts]
    got = {(r.node_id, r.emb[0]) for r in jobs.embed(spark, f"{tmp_path}/c", t, length).collect()}
    assert got == {(1, 2.0), (2, 0.0)} == {(r.node_id, r.emb[0]) for r in jobs.embed(spark, f"{tmp_path}/c", t.where("false"), length).collect()}


def test_batches_of_two_sides_and_minibatches(spark):
    a, b = spark.createDataFrame([(1, [1, 2])], "k long, ids array<long>"), spark.createDataFrame([(2, [3])], "k long, ids array<long>")
    assert {(r.k, r.side, tuple(r.ids)) for r in mx.concatenated(a, b, "ids", 0).collect()} == {(1, "chosen", (1, 2)), (2, "rejected", (3, 0))}
    assert mx.concatenated(a.where("false"), b.where("false"), "ids", 0).count() == 0
    few = mx.minibatch(spark.range(10), 4, 1, ["id"]).collect()
    assert len({r.id for r in few}) == 4 and mx.minibatch(spark.range(3), 9, 1, ["id"]).count() == 3


def test_packs_of_any_size(spark):
    rows = [("p", i, [i] * (i % 3)) for i in range(7)] + [("q", 1, [5])]
    df = spark.createDataFrame(rows, "pack string, seq long, ids array<long>")
    got = {(r.pack, r.seq): (r.k, r.start, r.used, r.padded) for r in mx.packed(df, ["pack"], [F.col("seq")], "ids", 4).collect()}
    at = 0
    for i in range(7):
        assert got["p", i] == (i + 1, at, 6, 8)
        at += i % 3
    assert got["q", 1] == (1, 0, 1, 4)


def test_two_hops_over_a_hub_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(g, "HUB", 3)
    star = [("g", 0, i) for i in range(1, 12)]
    adj = g.both_ways(spark.createDataFrame(star, "k string, u long, v long"), ["k"])
    got = {(r.src, r.dst) for r in g.two_hops(adj, None, ["k"]).collect()}
    assert got == {(i, j) for i in range(1, 12) for j in range(1, 12) if i != j}


@pytest.mark.parametrize("wide", [0, 3, 6, 1000])
def test_two_hop_totals_with_wide_nodes(spark, monkeypatch, wide):
    monkeypatch.setattr(g, "WIDE", wide)
    rng = np.random.default_rng(7)
    star = {("g", 0, i) for i in range(1, 20)} | {("g", 30, i) for i in range(10, 26)} | {("h", 5, i) for i in range(6, 12)}
    adj = star | {(k, v, u) for k, u, v in star if u != 30} | {("g", int(x), int(y)) for x, y in rng.integers(0, 30, (40, 2))}  # some of it one way only
    df = spark.createDataFrame(sorted(adj), "k string, src long, dst long")
    pairs = {(k, a, d) for k, a, m in adj for j, c, d in adj if k == j and m == c and a != d}
    want = {(k, a): (sum((k, a) == p[:2] for p in pairs), sum(p[2] for p in pairs if (k, a) == p[:2])) for k, a, _ in pairs}
    assert {(r.k, r.src): (r.reached, r.checksum) for r in g.two_hop_totals(df, ["k"]).collect()} == want
    if wide == 3:  # nothing is expanded at a wide node: its neighbours would be squared
        few = g.narrow_two_hops(df, None, ["k"], g.wide_marks(df, ["k"])).count()
        assert few < sum(1 for k, a, m in adj for j, c, d in adj if k == j and m == c) / 4


@pytest.mark.parametrize(("steps", "wide", "block"), [(1, 2, 100), (2, 0, 100), (2, 4, 100), (2, 4, 7), (2, 1000, 9)])
def test_best_of_hops_are_those_of_all_pairs(spark, monkeypatch, steps, wide, block):
    from graphloom.operators import retrieve as rt

    monkeypatch.setattr(g, "WIDE", wide)
    rng = np.random.default_rng(11)
    pairs = {(0, i) for i in range(1, 20)} | {(20, i) for i in range(12, 28)} | {(int(x), int(y)) for x, y in rng.integers(0, 28, (25, 2)) if x != y}
    adj = g.both_ways(g.canonical_edges(spark.createDataFrame([("g", u, v) for u, v in pairs], "dataset string, src long, dst long"), by=["dataset"]), ["dataset"])
    few = rng.normal(size=(9, 64))  # copies, so that scores are equal
    emb = spark.createDataFrame([("g", i, [float(x) for x in few[i % 9]]) for i in range(28)], "dataset string, node_id long, emb array<double>")
    ask = spark.createDataFrame([(i, "g", i % 28 if i < 40 else 0, "" if i % 3 else f"t{i}") for i in range(60)], "qid long, dataset string, node_id long, query_text string")
    hops = adj if steps == 1 else g.two_hops(adj, None, ["dataset"])
    rows = lambda df: sorted(tuple(r) for r in rt.ranked(df, ["qid"], "score", "cand", 3).select("qid", "dataset", "node_id", "cand", "score", "doc_id").collect())
    want = rows(rt.fused_scores(rt.hop_candidates(ask, hops), ask, emb))
    assert rows(rt.hop_best(ask, adj, emb, 3, steps, block=block)) == want and len(want) > 100


def test_nearest_in_several_blocks_from_a_pool(spark):
    rng = np.random.default_rng(4)
    emb = spark.createDataFrame([("g", i, [float(x) for x in rng.normal(size=4)]) for i in range(30)], "dataset string, node_id long, emb array<double>")
    ask = emb.select(F.col("node_id").alias("qid"), "dataset", "node_id")
    from graphloom.operators import retrieve as rt

    rows = lambda block: {(r.qid, r.cand, r.score) for r in rt.ranked(rt.similar_candidates(ask, emb, 3, block=block, pool=emb.where("node_id < 20")), ["qid"], "score", "cand", 3).collect()}
    assert rows(7) == rows(1000) and len(rows(7)) == 90


def test_a_cluster_needs_a_shared_folder(spark):
    from graphloom.session import scratch_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        scratch_dir(Session())


def test_services_answer_in_order(spark):
    import threading
    import urllib.error
    import urllib.request

    from graphloom import services as sv

    labels = spark.createDataFrame([(1, "a"), (2, "b")], "idx long, gold string")
    length = lambda: lambda texts: [[float(len(x))] for x in texts]
    server = sv.served({"/reward": sv.rewards(spark, labels), "/encode": sv.embeddings(spark, length)})
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def post(path, body):
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        return json.loads(urllib.request.urlopen(r, timeout=60).read())

    try:
        assert post("/encode", {"texts": ["abc", "", "x"]}) == {"embeddings": [[3.0], [0.0], [1.0]]}
        good, bad = "<think>t</think><answer>a</answer>", "<answer>b</answer>"
        got = post("/reward", {"query": [{"idx": 1, "response": bad}, {"idx": 1, "response": good}, {"idx": 9, "response": good}]})["rewards"]
        assert got[1] > got[2] > got[0] or got[1] > got[0]
        for path, body, code in (("/none", {}, 404), ("/encode", {}, 400)):
            with pytest.raises(urllib.error.HTTPError) as e:
                post(path, body)
            assert e.value.code == code
    finally:
        server.shutdown()


def test_engines_are_shared_and_batches_append(spark, tmp_path):
    d = tmp_path / "g"
    d.mkdir()
    for name, x in (("node_texts", ["a"]), ("category", ["x"]), ("first_hop_indices", [[]])):
        (d / f"{name}.json").write_text(json.dumps(x))
    np.save(d / "node_emb.npy", np.eye(1, 64, dtype=np.float32))
    assert GraphEngine.shared(spark, f"file://{tmp_path}", ["g"]) is GraphEngine.shared(spark, f"file://{tmp_path}", ["g"])
    one = spark.range(2)
    assert hk.appended(one, None) is None and hk.appended(None, one) is None and hk.appended(one, one).count() == 4


def _no_pairs(monkeypatch):
    def fail(*_):
        raise AssertionError("all pairs of two steps are listed")

    monkeypatch.setattr(g, "two_hops", fail)


def test_engine_lists_no_pairs_of_two_steps(spark, engine, monkeypatch):
    _no_pairs(monkeypatch)
    r = engine.batch_query(spark.createDataFrame([(2, 8, "2-hop:")], "qid long, gid long, query string")).first()
    assert {d.node_id for d in r.docs} == {0, 4}


def test_engine_hits_have_no_texts(spark, engine, monkeypatch):
    _no_pairs(monkeypatch)
    _, hits = engine.hits(spark.createDataFrame([(2, 8, "2-hop:")], "qid long, gid long, query string"))
    assert {r.cand for r in hits.collect()} == {0, 4} and "doc" not in hits.columns


def test_batch_of_parsed_queries_lists_no_pairs_of_two_steps(spark, monkeypatch):
    from graphloom.plans import registry

    _no_pairs(monkeypatch)
    assert registry.QUERIES["batch_query"](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("limit", [0, 1000])
def test_similar_pairs_of_copies_and_far_ids(spark, tmp_path, monkeypatch, limit):
    import duckdb

    from graphloom.operators import retrieve as rt
    from graphloom.plans import registry

    monkeypatch.setattr(rt, "VECTORS", limit)  # 0: in blocks
    rng = np.random.default_rng(2)
    ids = [int(i) for i in range(25)] + [20_000_000 + i for i in range(25)]
    links = sorted({(ids[min(x, y)], ids[max(x, y)]) for x, y in rng.integers(0, 50, (200, 2)) if x != y})
    tables = {
        "graph_nodes": spark.createDataFrame([("g", i, "x", "test", None, None) for i in ids], "dataset string, node_id long, category string, split string, pagerank double, same_as long"),
        "graph_edges": spark.createDataFrame([("g", u, v) for u, v in links], "dataset string, src long, dst long"),
        "graph_datasets": spark.createDataFrame([("g", 0)], "dataset string, position int"),
        "embeddings": spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(12)], "vec_id long, embedding array<float>"),
    }
    c = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = registry.QUERIES["similar_pairs_knn"](spark, str(tmp_path)).select("dataset", "u", "v", "ref_u", "ref_v", "rank").collect()
    assert sorted(tuple(r) for r in got) == sorted(c.sql(registry.SQL["similar_pairs_knn"]).fetchall()) and len(got) == 3 * len(links)


def test_similar_pairs_bring_no_rows_of_pairs_to_the_driver(spark):
    import tracemalloc

    from graphloom.operators import retrieve as rt

    rng = np.random.default_rng(4)
    emb = spark.createDataFrame([("g", i, [float(x) for x in rng.normal(size=4)]) for i in range(250)], "dataset string, node_id long, emb array<double>")
    side = lambda c: emb.select("dataset", F.col("node_id").alias(c))
    pairs = side("u").join(side("v"), "dataset").where("u < v")  # 31,125 kinds
    arrow = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(arrow)
    spark.conf.set(arrow, "false")  # as in a session that sets nothing
    rt.pairs_best(pairs.where("v < 3"), emb, 3)  # libraries are loaded
    tracemalloc.start()
    try:
        assert rt.pairs_best(pairs, emb, 3) is not None
        assert tracemalloc.get_traced_memory()[1] < 4_000_000  # Python objects and arrays, at once
    finally:
        tracemalloc.stop()
        spark.conf.set(arrow, before)
