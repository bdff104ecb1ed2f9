import datetime as dt
import itertools
import random

import pytest

from graphloom.llm import quotas as q

T = dt.datetime(2030, 1, 1)


def cells(*rows):
    return [q.Cell(*r) for r in rows]


def test_needs_are_plain_shortfalls():
    c = cells(("a", "x", 5, 5, 3), ("a", "y", 5, 5, 9), ("b", "x", 2, 2, 0))
    assert q.needs(c) == {("a", "x"): 2, ("a", "y"): 0, ("b", "x"): 2}


def test_allotment_reaches_targets_then_neighbours():
    c = cells(("a", "x", 4, 4, 2), ("a", "y", 4, 4, 9), ("b", "x", 4, 4, 9), ("b", "y", 4, 4, 9))
    got = {k: v[0] for k, v in q.allot(c, 16).items()}
    assert got["a", "x"] == 2 and sum(got.values()) == 16 and all(got[k] >= 4 for k in got if k != ("a", "x"))
    short = q.allot(cells(("a", "x", 4, 4, 1)), 4)
    assert short["a", "x"] == (1, 3)


def test_floors_come_first_and_the_size_is_kept():
    c = cells(("a", "x", 3, 3, 9, 3), ("a", "y", 9, 9, 9, 0), ("b", "x", 3, 3, 9, 3))
    got = q.allot(c, 8)
    assert sum(n for n, _ in got.values()) == 8 and got["a", "x"][0] == got["b", "x"][0] == 3


def test_a_short_column_moves_along_its_margins():
    c = cells(("a", "x", 4, 4, 1), ("a", "y", 4, 4, 20), ("b", "x", 4, 4, 20), ("b", "y", 4, 4, 20))
    got = {k: v[0] for k, v in q.allot(c, 16).items()}
    assert got["a", "x"] == 1 and sum(got.values()) == 16 and got["b", "y"] <= 5 and got["a", "y"] >= 4 and got["b", "x"] >= 4


def test_flow_has_the_least_cost():
    r = random.Random(3)
    for _ in range(30):
        net, arcs = q.Network(), []
        for a, b in itertools.product(range(2), range(2)):
            arcs.append((a, b, r.randint(0, 3), r.randint(0, 5)))
        handles = [net.arc(("r", a), ("c", b), room, cost) for a, b, room, cost in arcs]
        for i in range(2):
            net.arc("s", ("r", i), 2, 0)
            net.arc(("c", i), "t", 2, 0)
        sent = net.run("s", "t", 4)
        cost = sum(net.flow(h) * a[3] for h, a in zip(handles, arcs))
        options = []
        for f in itertools.product(*[range(a[2] + 1) for a in arcs]):
            rows = [f[0] + f[1], f[2] + f[3]]
            cols = [f[0] + f[2], f[1] + f[3]]
            if max(rows) <= 2 and max(cols) <= 2:
                options.append((-sum(f), sum(x * a[3] for x, a in zip(f, arcs))))
        assert (-sent, cost) == min(options)


def fixture(spark, n=900):
    r = random.Random(1)
    rows = [(i, r.choice(["A-b ", "a_b", "c"]), r.choice([" Easy", "hard\t", "MEDIUM", "", None, "?"]), T) for i in range(n)] + [(0, "c", "hard", T - dt.timedelta(1)), (None, "c", "hard", T)]
    rec = spark.createDataFrame(rows, "record_id long, dataset string, difficulty string, written_at timestamp")
    tar = spark.createDataFrame([("a-b", "easy", 400, 2, 100), ("a-b", "hard", 300, 2, 100), ("c", "easy", 299, 2, 100), ("c", "never", 1, 2, 100)], "dataset string, difficulty string, target_permille int, min_rows int, sample_size long")
    return rec, tar


def test_sample_and_report(spark):
    rec, tar = fixture(spark)
    sample, report = q.quota_sample(rec, tar)
    rows = sample.collect()
    assert len({r.record_id for r in rows}) == len(rows) == 100
    per = {(r.dataset, r.difficulty): r for r in report.collect()}
    assert per["c", "never"].missing == 2 and per["c", "never"].quota == 0
    for k, r in per.items():
        assert sum((x.dataset, x.difficulty) == k for x in rows) == r.quota <= r.available
    assert [r[:2] for r in q.shortfalls(rec, tar)] == [("c", "never")]
    assert {r.record_id for r in q.quota_sample(rec, tar, seed=43)[0].collect()} != {r.record_id for r in rows}


@pytest.mark.parametrize("part", ["records", "targets"])
def test_empty(spark, part):
    rec, tar = fixture(spark)
    rec, tar = (rec.where("false"), tar) if part == "records" else (rec, tar.where("false"))
    sample, report = q.quota_sample(rec, tar)
    assert sample.count() == 0 and report.count() == (4 if part == "records" else 0)
