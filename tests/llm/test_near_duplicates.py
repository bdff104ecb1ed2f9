import random
from collections import Counter

from graphloom.llm import near_duplicates as nd
from graphloom.llm.common import words

SCHEMA = "record_id long, text string, at long, bag string"  # a clashing extra column


def brute(rows, least=20, threshold=0.75):
    last = {}
    for i, t, at, _ in rows:
        if i is not None and (i not in last or at >= last[i][1]):
            last[i] = (t, at)
    bags = {i: Counter(words(t)) for i, (t, _) in last.items() if len(words(t)) >= least}
    out = set()
    for a in bags:
        for b in bags:
            if a < b and sum((bags[a] & bags[b]).values()) >= threshold * max(sum(bags[a].values()), sum(bags[b].values())) - 1e-9:
                out.add((a, b))
    return out


def made(seed=1, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(n):
        base = [r.choice(vocabulary) for _ in range(r.randint(25, 60))] + ["the", "of", "and"] * 4
        rows.append((10 * i, " ".join(base), 1, "x"))
        for k in range(r.randint(0, 2)):
            t = list(base)
            for _ in range(r.randint(0, len(t) // 8)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            r.shuffle(t)
            rows.append((10 * i + k + 1, "<p>" + ", ".join(t).upper() + "</p>", 1, None))
    return rows


def run(spark, rows, p=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return nd.near_duplicates(df, "record_id", "text", "at", p)


def test_all_pairs_of_brute_force(spark):
    rows = made()
    got = {tuple(r) for r in nd.pairs_of_records(*run(spark, rows)).collect()}
    want = brute(rows)
    assert got <= want and len(want) > 60 and len(got) >= 0.97 * len(want), (len(got), len(want))


def test_repeats_nulls_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [
        (1, text, 1, "a"), (1, text, 2, "a"), (2, text.replace("word3", "wo­rd3"), 1, None), (3, None, 1, None), (4, "", 1, None), (5, "short text", 1, None), (6, "short text", 1, None),
        (None, text, 1, None), (7, "changed later " * 20, 1, None), (7, text, 2, None), (8, text, 2, None), (8, "other words here " * 20, 3, None),
    ]
    members, links = run(spark, rows)
    assert {tuple(r) for r in nd.pairs_of_records(members, links).collect()} == {(1, 2), (1, 7), (2, 7)} == brute(rows)
    assert members.count() == 8
    members, links = nd.near_duplicates(spark.createDataFrame([], SCHEMA), "record_id", "text", "at")
    assert members.count() == 0 and links.count() == 0 and nd.pairs_of_records(members, links).count() == 0 and nd.classes(members, links).count() == 0


def test_a_long_text_counts_whole(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, long, 1, None), (2, long + " tail" * 500, 1, None), (3, " ".join(f"w{i}" for i in range(20_000)), 1, None)]
    assert {tuple(r) for r in nd.pairs_of_records(*run(spark, rows)).collect()} == {(1, 2)}


def test_classes_follow_chains(spark):
    base = [f"a{i}" for i in range(40)]
    rows = []
    for i in range(6):  # each is near its neighbours only
        t = base[: 40 - 5 * i] + [f"b{j}" for j in range(5 * i)]
        rows.append((100 - i, " ".join(t), 1, None))
    rows.append((7, " ".join(f"z{i}" for i in range(30)), 1, None))
    got = {r.id: (r.class_id, r.n_links) for r in nd.classes(*run(spark, rows)).collect()}
    assert got[7] == (7, 0)
    assert {got[i][0] for i in range(95, 101)} == {95} and got[100][1] >= 1 and got[98][1] >= 2


def test_one_setting_of_bands():
    p = nd.MinMax()
    meet = lambda j: 1 - (1 - j**p.rows) ** p.bands
    assert meet(0.6) > 0.78 and meet(0.7) > 0.98 and meet(0.78) > 0.9996


def test_a_long_chain_is_one_class(spark):
    n = 300
    members = spark.createDataFrame([(i, i) for i in range(n + 5)] + [(999, None)], "id long, rep long")
    links = spark.createDataFrame([(i, i + 1, 0.9) for i in range(n - 1)] + [(n, n + 2, 0.8)], "rep_a long, rep_b long, similarity double")
    got = {r.id: (r.class_id, r.n_links) for r in nd.classes(members, links).collect()}
    assert {got[i][0] for i in range(n)} == {0} and got[0][1] == 1 and got[5][1] == 2
    assert got[n + 2] == (n, 1) and got[n + 1] == (n + 1, 0) and got[999] == (999, 0)


def test_a_hot_family_keeps_its_pairs(spark):
    r = random.Random(8)
    base = [f"h{i}" for i in range(40)]
    rows = []
    for i in range(60):  # a third of all rows: copies with up to a tenth of the words replaced by rare ones
        t = list(base)
        for at in r.sample(range(40), r.randint(2, 4)):
            t[at] = f"rare{i}x{at}"
        rows.append((i, " ".join(t), 1, None))
    rows += [(100 + i, " ".join(f"o{r.randrange(5000)}" for _ in range(40)), 1, None) for i in range(120)]
    got, want = {tuple(x) for x in nd.pairs_of_records(*run(spark, rows)).collect()}, brute(rows)
    assert got <= want and len(want) > 1500 and len(got) >= 0.97 * len(want), (len(got), len(want))
