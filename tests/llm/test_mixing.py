import math
import os
from collections import Counter

import pytest

from graphloom.llm import mixing as mx

TARGETS = "source string, target_permille int, max_repeats int, token_budget long"


def counts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def test_bisections():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    assert mx.tempered(shares, 0) == pytest.approx({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}) and mx.tempered(shares, 1) == pytest.approx(shares)
    e = mx.exponent_for_entropy(shares, 1.0)
    assert mx.entropy(mx.tempered(shares, e)) == pytest.approx(1.0, abs=1e-9)
    assert mx.exponent_for_entropy(shares, math.log(3)) == pytest.approx(0, abs=1e-6)
    t = {"a": 0.1, "b": 0.1, "c": 0.8}
    assert mx.exponent_within_caps(shares, t, {"a": 1, "b": 1, "c": 1}) == 1
    e = mx.exponent_within_caps(shares, t, {"a": 1, "b": 1, "c": 0.4})
    assert 0 < e < 1 and mx.tilted(shares, t, e)["c"] == pytest.approx(0.4, abs=1e-6)


def test_mix_keeps_caps_and_budgets(spark):
    rows = [(i, "a", 100) for i in range(50)] + [(100 + i, "b", 40) for i in range(10)] + [(200, "b", 0), (201, "d", 99), (202, None, 5)]
    t = spark.createDataFrame([("A", 500, 2, 8000), ("b", 500, 3, 8000), ("c", 0, 1, 8000)], TARGETS)
    used, report = mx.mix(counts(spark, rows), t)
    uses = used.collect()
    often = Counter((r.source, r.doc_id) for r in uses)
    assert max(n for (s, _), n in often.items() if s == "b") == 3 and sum(r.tokens for r in uses if r.source == "b") == 1200
    a = sum(r.tokens for r in uses if r.source == "a")
    assert 6800 <= a <= 6900 and max(n for (s, _), n in often.items() if s == "a") <= 2
    at = sorted((r.start, r.tokens, r.block, r.doc_id) for r in uses if r.source == "a")
    assert [x[0] for x in at] == list(range(0, 100 * len(at), 100))  # one use after the other
    first = [x[3] for x in at if x[2] == 0]
    assert len(first) == len(set(first)) == 50 and first != sorted(first) and [x[3] for x in at if x[2] == 1] != first[: len(at) - 50]
    rep = {r.source: r for r in report.collect()}
    assert rep["b"].tokens_missing == 2800 and rep["A"].tokens_missing == 0 and rep["c"].tokens_actual == 0 and rep["b"].most_uses == 3
    assert sum(r.permille_actual for r in rep.values()) == pytest.approx(1000, abs=0.01)


def test_repetition_limits_and_budgets():
    natural, weights = {"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 0.1, "b": 0.1, "c": 0.8}
    got = mx.repetition_limits(natural, weights, {"a": 1, "b": 1, "c": 0.4})
    assert got["a"] == got["b"] == 1 and mx.tilted(natural, weights, got["c"])["c"] == pytest.approx(0.4, abs=1e-6)
    assert mx.repetition_limits({"a": 1.0, "b": 0.0}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 0}) == {"a": 1, "b": 0}
    assert mx.budgets(weights, {"a": 1000, "b": 120, "c": 400}, got, 1000) == {"a": 480, "b": 120, "c": 400}
    assert mx.budgets(weights, {"a": 50, "b": 20, "c": 400}, got, 1000) == {"a": 50, "b": 20, "c": 400}


def test_a_mix_of_wanted_entropy(spark):
    rows = [(i, "a", 10) for i in range(70)] + [(100 + i, "b", 10) for i in range(20)] + [(200 + i, "c", 10) for i in range(10)]
    t = spark.createDataFrame([(s, 0, 9, 600) for s in "abc"], TARGETS)
    used, _ = mx.mix(counts(spark, rows), t, entropy_wanted=math.log(3))
    assert Counter(r.source for r in used.collect()) == {"a": 20, "b": 20, "c": 20}


def test_empty(spark):
    t = spark.createDataFrame([("a", 1000, 2, 100)], TARGETS)
    used, report = mx.mix(counts(spark, []), t)
    assert used.count() == 0 and report.first().tokens_missing == 100
    used, report = mx.mix(counts(spark, [(1, "a", 5)]), t.where("false"))
    assert used.count() == 0 and report.count() == 0


@pytest.mark.skipif(not os.path.exists(os.path.join(mx.TOKENIZERS, mx.VOCABULARY)), reason="no vocabulary here")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", " User-Mail"), (2, None, None), (3, "", "x"), (4, "<|endoftext|>" + "word " * 20_000, "x")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.source, r.tokens) for r in mx.token_counts(df.withColumn("tokens", df.doc_id)).collect()}
    assert got[1] == ("user_mail", 2) and got[2] == (None, 0) and got[3] == ("x", 0) and got[4][1] > 20_000
    enc = mx._encoding(mx.TOKENIZERS)
    assert enc.decode(enc.encode_ordinary("Grüße, it's 42!")) == "Grüße, it's 42!"
