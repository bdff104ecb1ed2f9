import datetime as dt

from pyspark.sql import functions as F

from graphloom.llm import overlaps as ov

T = dt.datetime(2030, 1, 1)
SAMPLES = "sample_id long, dataset string, split string, node_u long, node_v long, exported_at timestamp, hash string"


def fixture(spark, rows):
    s = spark.createDataFrame([(*r, T, "x") for r in rows], SAMPLES)
    n = spark.createDataFrame([("a-b", 5, 4), ("a-b", 5, 4), ("a-b", 1, None)], "dataset string, node_id long, same_as long")
    d = spark.createDataFrame([("a-b", 0, 1000), ("c", 1, 2000)], "dataset string, position int, base_offset long")
    return s, n, d


def test_pairs(spark):
    rows = [
        (1, "a-b", "train", 1, 2), (2, " A_B", "Test ", 2, 1), (3, "a-b", "val", 1001, 2), (4, "a-b", "dev", 1, 3), (5, "c", "test", 1, 2), (6, "a-b", None, 1, 2), (7, "a-b", "other", 1, 2),
        (8, "a-b", "TRAINING", 5, 9), (9, "a-b", "testing", 9, 1004), (10, "a-b", "train", None, 2), (11, None, "test", 1, 2), (12, "a-b", "test", 1, None), (13, "c", "train", 3, 3), (14, "c", "test", 2003, 3), (2, "a-b", "test", 2, 1),
    ]
    records, overlaps = ov.split_overlaps(*fixture(spark, rows))
    got = {tuple(r) for r in ov.overlap_pairs(records, overlaps).collect()}
    assert got == {(1, 2), (1, 3), (8, 9), (13, 14)}
    rep = {(r.split, r.dataset): (r.samples, r.overlapping, r.train_pairs) for r in ov.overlap_report(records, overlaps).collect()}
    assert rep == {("test", "a_b"): (2, 2, 2), ("valid", "a_b"): (2, 1, 1), ("test", "c"): (2, 1, 1)}


def test_empty(spark):
    records, overlaps = ov.split_overlaps(*fixture(spark, []))
    assert ov.overlap_pairs(records, overlaps).count() == 0 and ov.overlap_report(records, overlaps).count() == 0


def longest(a, b):
    return max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, min(len(a) - i, len(b) - j) + 1) if a[i : i + k] == b[j : j + k]), default=0)


def test_long_sequences_are_extended_from_selected_seeds(spark):
    train = [list(range(100, 130)), list(range(500, 520)) + [1, 2, 3] + list(range(700, 710)), [7] * 12]
    held = [[0, 0] + list(range(105, 121)) + [9, 9], list(range(510, 520)) + [8] + list(range(700, 708)), [40, 41, 42], [7] * 6, [1]]
    df = lambda rows: spark.createDataFrame(list(enumerate(rows)), "seq long, tokens array<long>")
    p = ov.Winnow(k=4, w=3, coverage=0.3)
    got = {(r.train_seq, r.held_seq): r.covered_tokens for r in ov.sequence_overlaps(df(train), df(held), p).collect()}
    assert got == {(0, 0): 16, (1, 1): 18, (2, 3): 6}
    for t, a in enumerate(train):  # the guarantee: a shared run of k + w - 1 tokens is always found
        for h, b in enumerate(held):
            assert (longest(a, b) >= 6) == ((t, h) in got)


def test_only_equal_tokens_count_and_gaps_are_limited():
    p = ov.Winnow(k=3, w=1, gap=8)
    seeds = lambda t, h: [(i, j) for i in range(len(h) - 2) for j in range(len(t) - 2) if h[i : i + 3] == t[j : j + 3]]
    run = lambda t, h: ov.covered(seeds(t, h), t, h, p)
    t = list(range(100, 140))
    assert run(t, t) == 40 and run(t, t[:10] + [1] + t[11:]) == 39  # a substitution
    assert run(t, t[:20] + [1, 2, 3] + t[20:]) == 40 and run(t, t[:20] + t[23:]) == 37  # an insertion, a deletion
    assert run(t, t[:6] + [1, 2] + [t[7], 3, t[9], t[10]]) == 9  # beyond the last seed: t[7], t[9], t[10]
    assert run(t, t[:5] + [1] * 20 + t[25:30]) == 10  # too far apart for one chain; what lies between does not count
    assert ov.covered([(0, 5)], t, [1, 2, 3], p) == 0  # equal hashes of unequal tokens


def test_coverage_and_members(spark):
    rows = [(1, "a-b", "train", 1, 2), (2, "a-b", "test", 2, 1), (3, "a-b", "val", 1, 3), (4, "a-b", "train", 2, 1), (5, "a-b", None, 1, 2)]
    records, overlaps = ov.split_overlaps(*fixture(spark, rows))
    assert {tuple(r) for r in ov.overlap_coverage(records, overlaps).collect()} == {(2, "test", "a_b", 1.0, 2), (3, "valid", "a_b", 0.0, 0)}
    members, links = ov.overlap_members(records, overlaps)
    assert {(r.sample_id, r.rep) for r in members.collect()} == {(1, 1), (2, 1), (4, 1), (3, 3)} and [tuple(r) for r in links.collect()] == [(1, 1, 1.0)]


def test_winnowing_selects_minima(spark):
    df = spark.createDataFrame([([5, 3, 4, 3, 9, 1],), ([2],), ([],)], "h array<long>")
    got = [[(m.pos, m.hash) for m in r.m] for r in df.select(ov.winnowed(F.col("h"), 3).alias("m")).collect()]
    assert got[0] == [(3, 3), (5, 1)] or got[0] == [(1, 3), (3, 3), (5, 1)]
    assert got[1] == [(0, 2)] and got[2] == []
