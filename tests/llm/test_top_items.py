import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import top_items as ti


def brute(rows, n):
    by = {}
    for g, s, i in rows:
        by.setdefault(g, []).append((-s, i))
    return {(g, i, k + 1) for g, xs in by.items() for k, (_, i) in enumerate(sorted(xs)[:n])}


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_positions_across_partitions(spark, partitions):
    r = random.Random(partitions)
    rows = [("hot", r.randrange(5) / 4, i) for i in range(900)] + [(f"g{r.randrange(40)}", r.random(), 1000 + i) for i in range(600)] + [(None, 0.5, 5000 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, s double, i long")
    for n in (1, 10, 500):
        got = ti.running_totals(df, ["g"], [F.col("s").desc(), F.col("i")], most=n, partitions=partitions)
        assert {(x.g, x.i, x.position) for x in got.collect()} == brute(rows, n)


def test_running_sums(spark):
    rows = [("a", i, 10 * i) for i in range(50)] + [("b", 1, None), ("b", 2, 3)]
    df = spark.createDataFrame(rows, "g string, i long, w long")
    got = {(x.g, x.i): x.upto for x in ti.running_totals(df, ["g"], [F.col("i")], weight=F.col("w"), partitions=7, name="upto").collect()}
    assert all(got["a", i] == 10 * i * (i + 1) // 2 for i in range(50)) and got["b", 1] == 0 and got["b", 2] == 3


def test_empty_and_clashes(spark):
    df = spark.createDataFrame([], "g string, s double, i long")
    assert ti.top_items(df, ["g"], [F.col("s")], 3).count() == 0
    full = spark.createDataFrame([("a", 0.1, 1, 9, "x", "y", 3), ("a", 0.9, 2, 9, "x", None, 4)], "g string, s double, i long, position int, _w string, _upto string, __part int")
    got = ti.top_items(full, ["g"], [F.col("s").desc()], 3)
    assert got.columns == ["g", "s", "i", "_w", "_upto", "__part", "position"]
    assert [(r.i, r.position, r["_upto"]) for r in got.orderBy("position").collect()] == [(2, 1, None), (1, 2, "y")]
    with pytest.raises(ValueError):
        ti.top_items(full, ["position"], [F.col("s")], 3)


def test_candidates_that_count(spark):
    rows = [
        (1, 1, 0.5, 1), (1, 1, 0.9, 2), (1, 2, float("nan"), 1), (1, 3, None, 1), (1, 4, 1.5, 1), (1, 5, -1.0, 1), (None, 6, 0.1, 1), (1, None, 0.1, 1), (1, 7, 0.2, 3), (1, 7, 0.2, 3), (1, 8, 0.7, 1), (1, 8, 0.3, 2),
    ]
    df = spark.createDataFrame(rows, "target_sample_id long, ref_pair_id long, similarity double, scored_at long")
    assert {tuple(r) for r in ti.scored_candidates(df).collect()} == {(1, 1, 0.9), (1, 5, -1.0), (1, 7, 0.2), (1, 8, 0.3)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_prefix_over_any_cuts(rows, cuts):
    """Ends of partitions, as the tasks report them, give the total of each partition's first group before it."""
    rows = sorted(rows)
    bounds = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    ends, want = [], []
    for part, (a, b) in enumerate(zip(bounds, bounds[1:])):
        own = rows[a:b]
        if not own:
            continue
        total = lambda g, xs: sum(w for k, w in xs if k == g)
        first, last = own[0][0], own[-1][0]
        ends.append((part, 0, (first,), total(first, own)))
        if last != first:
            ends.append((part, 1, (last,), total(last, own)))
        want.append((part, total(first, rows[:a])))
    assert ti._prefix(ends) == want
