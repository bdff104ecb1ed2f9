import numpy as np

from graphloom.llm import similar_vectors as sv

SCHEMA = "sample_id long, vector array<float>, rep string, key_low long"


def frame(spark, ids, m):
    return spark.createDataFrame([(int(i), [float(x) for x in v], None, 1) for i, v in zip(ids, m)], SCHEMA)


def brute(ids, m, k=5, cosine=0.85):
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        for j in np.lexsort((ids, -s[i]))[:k]:
            if s[i, j] >= cosine:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def found(spark, df, p=None):
    p = p or sv.Forest()
    members, links = sv.neighbours(df, "sample_id", "vector", p)
    n = sv.nearest(members, sv.both_ways(links), p.k).where(f"cosine >= {p.cosine}")
    return {(min(r.id, r.neighbour), max(r.id, r.neighbour)) for r in n.collect()}


def clusters(seed, groups, size, noise):
    r = np.random.default_rng(seed)
    c = r.normal(size=(groups, 64))
    m = np.repeat(c, size, axis=0) + noise * r.normal(size=(groups * size, 64))
    ids = r.permutation(len(m))
    return ids, m


def test_recall_against_brute_force(spark):
    ids, m = clusters(2, 150, 12, 0.3)
    got, want = found(spark, frame(spark, ids, m)), brute(ids, m)
    assert len(want) > 3000 and len(got & want) >= 0.97 * len(want)


def test_small_leaves_descend_deeper(spark):
    ids, m = clusters(3, 20, 40, 0.25)
    p = sv.Forest(candidates=1500, keep=16)
    got, want = found(spark, frame(spark, ids, m), p), brute(ids, m)
    assert len(got & want) >= 0.9 * len(want)


def test_copies_ties_and_unusable_vectors(spark):
    r = np.random.default_rng(4)
    v, w = r.normal(size=64), r.normal(size=64)
    rows = [(i, [float(x) for x in v], None, 1) for i in range(1, 10)] + [(3, [float(x) for x in v], "again", 1)]
    rows += [(20, None, None, 1), (21, [], None, 1), (22, [1.0] * 32, None, 1), (23, [float("nan")] + [1.0] * 63, None, 1), (24, [0.0] * 64, None, 1), (25, [float(x) for x in w], None, 1), (26, [float(-x) for x in w], None, 1), (None, [float(x) for x in w], None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    members, links = sv.neighbours(df, "sample_id", "vector")
    n = sv.nearest(members, sv.both_ways(links)).collect()
    by = {}
    for x in n:
        by.setdefault(x.id, []).append((x.rank, x.neighbour))
    assert [b for _, b in sorted(by[1])] == [2, 3, 4, 5, 6] and [b for _, b in sorted(by[9])] == [1, 2, 3, 4, 5]
    assert set(by) == set(range(1, 10))


def test_empty(spark):
    members, links = sv.neighbours(spark.createDataFrame([], SCHEMA), "sample_id", "vector")
    assert members.count() == 0 and links.count() == 0 and sv.nearest(members, sv.both_ways(links)).count() == 0 and sv.asked_neighbours(spark.createDataFrame([], SCHEMA), "sample_id", "vector").count() == 0


def test_strings_are_signs_of_independent_projections():
    p = sv.Forest(trees=3)
    m = np.random.default_rng(5).normal(size=(50, 64)).astype(np.float32)
    at = sv.planes(p)
    got = sv.strings(m, at, 3)
    for i in range(50):
        for t in range(3):
            assert f"{int(got[i, t]):064b}" == "".join("1" if x > 0 else "0" for x in m[i] @ at[:, t * 64 : t * 64 + 64])


def test_the_ladder_finds_the_depth_with_enough_candidates():
    r = np.random.default_rng(9)
    s = r.integers(0, 2**63, (400, 3), dtype=np.int64).view(np.uint64) << np.uint64(1)
    s[:150] = s[0] ^ r.integers(0, 2**40, (150, 3), dtype=np.int64).view(np.uint64)  # a dense region
    bits = 10
    counts = np.stack([np.bincount((s[:, t] >> np.uint64(54)).astype(int), minlength=1024) for t in range(3)])
    held = lambda i, d: sum(int(((s[:, t] ^ s[i, t]) >> np.uint64(64 - d) == 0).sum()) if d else 400 for t in range(3))
    got = sv.Ladder(counts, bits).depths(s, 40)
    for i in range(0, 400, 7):
        assert got[i] == max([d for d in range(1, bits + 1) if held(i, d) >= 40], default=0)
    assert (got[:150] == bits).all()


def test_a_dense_group_keeps_its_nearest(spark):
    r = np.random.default_rng(6)
    ids = r.permutation(2100)
    for noise in (0.4, 1e-4):  # a third of all rows
        m = np.concatenate([r.normal(size=64) + noise * r.normal(size=(700, 64)), r.normal(size=(1400, 64))])
        u = m.astype(np.float32).astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        s = u @ u.T
        np.fill_diagonal(s, -2)
        want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(700) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.85}
        got = found(spark, frame(spark, ids, m))
        assert len(want) > 2000 and len(got & want) >= 0.99 * len(want)


def test_p3_neighbours_lists_five_for_every_vector(spark, tmp_path):
    from graphloom.llm import queries

    r = np.random.default_rng(7)
    ids, m = 100 * r.permutation(300), r.normal(size=(300, 64))  # all are asked; hardly any two at cosine 0.85
    frame(spark, ids, m).write.parquet(f"{tmp_path}/pair_samples.parquet")
    got = {(x.sample_id, x.rank): x.neighbour_id for x in queries.p3_neighbours(spark, str(tmp_path)).collect()}
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert got == {(ids[i], k + 1): ids[j] for i in range(300) for k, j in enumerate(np.argsort(-s[i])[:5])}
