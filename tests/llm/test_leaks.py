import random

import numpy as np

from graphloom.llm import leaks as lk
from graphloom.llm.common import words


def longest_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


def fixture():
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(8, 40)))) for i in range(20)]
    docs = []
    for d in range(80):
        t = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if d % 2:
            w = items[d % 20][1].split()
            a = r.randrange(max(1, len(w) - 11))
            piece = w[a : a + r.randint(9, 20)]
            if d % 4 == 3 and len(piece) > 13:
                piece[6] = "changed"
            t[len(t) // 2 : len(t) // 2] = piece
        docs.append((d, "<b>" + " ".join(t).upper() + "</b>!"))
    return docs, items


def test_exact_runs_match_brute_force(spark):
    docs, items = fixture()
    D = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    I = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, d) for i, it in items for d, dt in docs if longest_run(words(dt), words(it)) >= 12}
    for p in (lk.SpacedSeeds(), lk.SpacedSeeds(bitmap_bits=8)):  # a bitmap that tells seeds apart, and one that is nearly full
        got = lk.leaks(D, I, p=p).where("longest_run >= 12").collect()
        assert {(r.item_id, r.doc_id) for r in got} == want and len(want) > 10
        assert len(got) == len({(r.item_id, r.doc_id) for r in got})


def test_substitutions_are_tolerated(spark):
    w = [f"t{i}" for i in range(30)]
    changed = list(w)
    changed[7] = changed[15] = changed[23] = "other"
    D = spark.createDataFrame([(1, "before " + " ".join(changed) + " after")], "doc_id long, text string")
    I = spark.createDataFrame([(9, " ".join(w))], "item_id long, text string")
    r = lk.leaks(D, I).first()
    assert (r.overlap_words, r.substituted, r.longest_run, r.doc_word, r.item_word) == (30, 3, 7, 1, 0)


def test_edges(spark):
    sch = "doc_id long, text string"
    I = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(14))), (2, None), (None, "a b"), (3, "")], "item_id long, text string")
    text = "in​visible " + " ".join(f"Q{i}" if i % 3 else f"<i>q{i}</i>" for i in range(14))
    D = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, " ".join(["x"] * 50_000) + " " + text), (None, text)], sch)
    got = lk.leaks(D, I)
    assert sorted((r.item_id, r.doc_id) for r in got.collect()) == [(1, 1), (1, 1), (1, 4)]
    assert {r.item_id: r.docs for r in lk.leak_report(got, I).where("item_id is not null").collect()} == {1: 2, 2: 0, 3: 0}
    assert lk.leaks(D.where("false"), I).count() == 0 and lk.leaks(D, I.where("false")).count() == 0


def test_recall_of_substituted_overlaps():
    r = np.random.default_rng(11)
    found = 0
    for _ in range(400):  # passages of 20 to 40 words with a tenth to a fifth of the words replaced
        item = r.integers(1, 2**62, r.integers(20, 41)).astype(np.uint64)
        doc = item.copy()
        at = r.choice(len(doc) - 2, int(len(doc) * r.uniform(0.1, 0.2)), replace=False) + 1
        doc[at] = r.integers(1, 2**62, len(at)).astype(np.uint64)
        found += any((lk.seed_hashes(item, m) == lk.seed_hashes(doc, m)).any() for m in lk.SpacedSeeds().masks)
    assert found >= 0.95 * 400


def test_align():
    a = np.array([1, 2, 3, 4, 5, 6], dtype=np.uint64)
    assert lk.align(a, a, 0, 0.2)[:4] == (0, 6, 0, 6)
    assert lk.align(a, np.array([3, 4, 9], dtype=np.uint64), 2, 0.2)[:4] == (2, 2, 0, 2)
