"""Problem 3: the k most similar vectors of every vector, by a forest of hash-prefix trees.

Every tree has its own 64 random projections; the signs of a vector's projections are its bit string there, and the tree is the array of
all strings sorted: a range-partitioned sort. A vector descends in every tree to its longest prefixes and ascends in all trees at once:
its depth is the greatest one at which its subtrees together hold enough candidates, found from the counts of all prefixes of up to `deepest`
bits (a table of bounded size). Where even the deepest counted subtrees hold far more, in a dense region, each tree goes down
further on its own, along the sorted strings. Candidates of the reached subtrees are compared by the Hamming distance of 192 bits
(the strings of three trees), and what is near enough is verified by the exact cosine.

A vector that is near more strings of a subtree than it may take stands in a dense group, where strings do not tell which are nearest: all
such vectors are compared with each other exactly, block by block. A vector outside a dense group keeps all it is near to, so no
link between the two sorts is lost.

Vectors that are equal are one representative from the start, so a copy repeated by a third of all rows is one leaf entry.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import release
from graphloom.session import materialise

U64 = np.uint64
WORD = 64


@dataclass(frozen=True)
class Forest:
    """dims: length of a usable vector; k: neighbours; cosine: least cosine of interest; trees: sorted arrays, at least 3;
    distance: greatest Hamming distance (of 192 bits) that is verified: at cosine 0.85 the mean is 34 and the deviation 5.3, so 2 % of the pairs just there are lost, 0.5 % at 0.87;
    candidates: what a vector's subtrees hold together at the depth it stops at, at least, for 100,000 vectors. It grows as the number of vectors
    to the power 0.36, which with the trees fixed keeps the share of found neighbours at cosine 0.85 (each bit agrees with probability 0.823);
    deepest: bits of the counted prefixes, at most (trees * 2^deepest counts are sent to the tasks);
    keep: near strings that a vector takes from one subtree; a vector with more is compared with all of the kind;
    block: vectors that are sent to all tasks at once for that; passes: parts of the pairs that are verified one after the other."""

    dims: int = 64
    k: int = 5
    cosine: float = 0.85
    trees: int = 12
    distance: int = 45
    candidates: int = 12_000
    deepest: int = 16
    keep: int = 48
    block: int = 65_536
    passes: int = 2
    seed: int = 20300102

    def enough(self, n: int) -> int:
        return int(self.candidates * max(1e-3, n / 1e5) ** 0.36)

    def counted(self, n: int) -> int:
        """Bits of the counted prefixes: a few more than vectors that lie evenly would stop at."""
        return min(self.deepest, max(2, math.ceil(math.log2(max(2.0, self.trees * n / self.enough(n)))) + 3))


def planes(p: Forest) -> np.ndarray:
    return np.random.default_rng(p.seed).standard_normal((p.dims, p.trees * WORD)).astype(np.float32)


def strings(m: np.ndarray, at: np.ndarray, trees: int) -> np.ndarray:
    """(n, dims) -> (n, trees) strings of 64 bits, the first bit the highest."""
    weights = U64(1) << np.arange(WORD - 1, -1, -1, dtype=U64)
    out = np.empty((len(m), trees), dtype=U64)
    for lo in range(0, len(m), 1000):
        part = m[lo : lo + 1000]
        scaled = part / np.abs(part).max(axis=1, keepdims=True)
        out[lo : lo + 1000] = ((scaled @ at > 0).reshape(len(part), trees, WORD) * weights).sum(axis=2, dtype=U64)
    return out


def _usable(id_col: str, vector_col: str, p: Forest):
    """Usable vectors only: id and 128-bit key of equal vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, ids = b.column(vector_col), b.column(id_col)
            sizes = np.diff(vectors.offsets.to_numpy())
            ok = (sizes == p.dims) & ~vectors.is_null().to_numpy(zero_copy_only=False) & ~ids.is_null().to_numpy(zero_copy_only=False)
            chosen = b.filter(pa.array(ok))
            if not chosen.num_rows:
                continue
            m = chosen.column(vector_col).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, p.dims)
            good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
            m, kept = m[good] + np.float32(0), chosen.column(id_col).filter(pa.array(good))  # + 0: no negative zero
            key = [xxhash.xxh3_128_intdigest(r.tobytes()) for r in m]
            high = np.array([k >> 64 for k in key], dtype=U64).view(np.int64)
            low = np.array([k & 0xFFFFFFFFFFFFFFFF for k in key], dtype=U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([kept.cast(pa.int64()), pa.array(high), pa.array(low)], names=["id", "key_high", "key_low"])

    return run


def _hashed(p: Forest):
    at = planes(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(b.num_rows, -1)
                s = strings(m, at, p.trees).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * p.trees), pa.array(s.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), lists], names=["id", "s"])

    return run


def _unpacked(b: pa.RecordBatch) -> np.ndarray:
    return b.column("s").flatten().to_numpy(zero_copy_only=False).view(U64).reshape(b.num_rows, -1)


def _counts(p: Forest, bits: int):
    """(slot, n): how many strings of the task stand at each tree and prefix; slot = tree * 2^bits + prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p.trees << bits, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                slots = (_unpacked(b) >> U64(WORD - bits)).astype(np.int64) + (np.arange(p.trees) << bits)
                total += np.bincount(slots.ravel(), minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "n"])

    return run


class Ladder:
    """The sizes of all subtrees down to `bits`: counts[d] has (trees, 2^d)."""

    def __init__(self, counts: np.ndarray, bits: int):
        self.bits = bits
        self.counts = [counts]
        for _ in range(bits):
            self.counts.append(self.counts[-1].reshape(len(counts), -1, 2).sum(axis=2))
        self.counts.reverse()

    def depths(self, s: np.ndarray, enough: int) -> np.ndarray:
        """The greatest depth at which the subtrees of each (trees,) row of strings hold enough together; 0, the root, if none does."""
        out, open_ = np.zeros(len(s), dtype=np.int8), np.ones(len(s), dtype=bool)
        trees = np.arange(s.shape[1])
        for d in range(self.bits, 0, -1):
            at = np.flatnonzero(open_)
            held = self.counts[d][trees, (s[at] >> U64(WORD - d)).astype(np.int64)].sum(axis=1)
            done = at[held >= enough]
            out[done], open_[done] = d, False
        return out


def _planted(p: Forest, ladder: Ladder, enough: int):
    """One row per vector and tree: its string there (shifted to sort as unsigned), its depth and its 192 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = _unpacked(b)
            many = lambda x: pa.array(np.repeat(x, p.trees))
            sketch = s[:, :3].view(np.int64)
            tree = pa.array(np.tile(np.arange(p.trees, dtype=np.int8), len(s)))
            cols = [tree, pa.array((s ^ U64(1 << 63)).view(np.int64).ravel()), many(ladder.depths(s, enough)), *(many(sketch[:, i]) for i in range(3)), many(b.column("id").to_numpy())]
            yield pa.RecordBatch.from_arrays(cols, names=["tree", "s", "depth", "w0", "w1", "w2", "id"])

    return run


def subtrees(s: np.ndarray, depth: int) -> np.ndarray:
    """Borders of the runs of sorted strings that share a prefix of `depth` bits."""
    head = s >> U64(WORD - depth) if depth else np.zeros(len(s), dtype=U64)
    return np.concatenate([[0], np.flatnonzero(head[1:] != head[:-1]) + 1, [len(s)]])


def near_in_span(asking: np.ndarray, words: np.ndarray, p: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the asking ones and of strings within the distance; (i, i) alone for an i with more than p.keep of them."""
    n = len(words)
    left, right = [], []
    block = max(1, 100_000 // n)
    cols = [np.ascontiguousarray(words[:, i]) for i in range(3)]
    for lo in range(0, len(asking), block):
        own = asking[lo : lo + block]
        d = np.zeros((len(own), n), dtype=np.uint8)
        for c in cols:
            d += np.bitwise_count(c[own, None] ^ c)
        d[np.arange(len(own)), own] = 255
        near = d <= p.distance
        many = np.flatnonzero(near.sum(axis=1) > p.keep)
        near[many] = False
        near[many, own[many]] = True
        a, b = np.nonzero(near)
        left.append(own[a])
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def tree_pairs(s: np.ndarray, depth: np.ndarray, words: np.ndarray, bits: int, most: int, p: Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs met in a stretch of one tree: every vector with the members of its subtree. Below `bits` a subtree of more
    than `most` is left for longer prefixes; strings that are equal in all bits and still too many are marked as dense."""
    spans = [(lo, hi, int(d), False) for d in np.unique(depth) for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(subtrees(s, int(d)))) if hi - lo > 1]
    while spans:
        lo, hi, d, whole = spans.pop()
        asking = np.arange(hi - lo) if whole else np.flatnonzero(depth[lo:hi] == d)
        if not len(asking):
            continue
        if hi - lo <= most or d < bits:
            a, b = near_in_span(asking, words[lo:hi], p)
            yield a + lo, b + lo
        elif d >= WORD:
            yield asking + lo, asking + lo
        else:
            c = subtrees(s[lo:hi], d + 1) + lo
            spans += [(x, y, d + 1, True) for x, y in zip(c[:-1], c[1:]) if y - x > 1]


def _met(p: Forest, low: int, bits: int, most: int):
    """Streams a sorted partition and gives the pairs that are near in it, and (a, a) of the vectors in a dense group. Rows wait until
    the subtree at the least depth that any vector stops at is whole."""

    def pairs(trees: np.ndarray, s: np.ndarray, depth: np.ndarray, words: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
        found = []
        for t in np.unique(trees):
            own = np.flatnonzero(trees == t)
            for a, b in tree_pairs(s[own], depth[own], words[own], bits, most, p):
                x, y = ids[own[a]], ids[own[b]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        if not found:
            return None
        f = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0
        joined = lambda: tuple(np.concatenate([h[i] for h in held]) for i in range(5))
        for b in batches:
            if not b.num_rows:
                continue
            number = lambda c: b.column(c).to_numpy()  # noqa: B023, E731
            held.append((number("tree"), number("s").view(U64) ^ U64(1 << 63), number("depth"), np.stack([number(f"w{i}").view(U64) for i in range(3)], axis=1), number("id")))
            rows += b.num_rows
            if rows >= 100_000:
                every = joined()
                trees, s = every[:2]
                last = (trees == trees[-1]) & ((s >> U64(WORD - low)) == (s[-1] >> U64(WORD - low)) if low else True)
                cut = int(np.argmax(last))
                if cut and (out := pairs(*(x[:cut] for x in every))) is not None:
                    yield out
                held = [tuple(x[cut:] for x in every)]
                rows = min(len(s) - cut, 50_000)  # a long subtree is looked at again only now and then
        if held and (out := pairs(*joined())) is not None:
            yield out

    return run


def closest(asked: tuple[np.ndarray, np.ndarray], known: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, unit vectors) twice, the known ids sorted -> ids of asked, ids of their k most similar known ones and the cosines; equal
    cosines by smaller id, none itself.

    Single precision tells who may be among them (its error is below `margin`), double precision decides."""
    margin = 4e-6
    (ids, q), (others, r) = asked, known
    n, wide = len(others), len(others) // 64
    single = r.astype(np.float32).T
    left, right, scores = [], [], []
    for lo in range(0, len(ids), 256):
        own, u = ids[lo : lo + 256], q[lo : lo + 256]
        s = u.astype(np.float32) @ single
        at = np.searchsorted(others, own)
        here = np.flatnonzero(others[np.minimum(at, n - 1)] == own)
        s[here, at[here]] = -2
        least = np.full(len(own), -2, dtype=np.float32)
        if wide >= k:  # the k-th of the greatest of groups is not above the k-th of all
            least = np.partition(s[:, : wide * 64].reshape(len(own), 64, wide).max(axis=1), wide - k, axis=1)[:, wide - k] - np.float32(margin)
        maybe = (s >= least[:, None]) & (s > -2)
        for i in np.arange(len(own)):
            c = np.flatnonzero(maybe[i])
            exact = r[c] @ u[i]
            if len(c) > k:
                some = exact >= np.partition(exact, len(c) - k)[len(c) - k]
                c, exact = c[some], exact[some]
            best = np.lexsort((others[c], -exact))[:k]
            left.append(np.full(len(best), own[i]))
            right.append(others[c[best]])
            scores.append(exact[best])
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), np.concatenate([none.astype(np.float64), *scores])


def _units(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    return ids.to_numpy(zero_copy_only=False), m / np.linalg.norm(m, axis=1, keepdims=True)


def _units(ids: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    return ids.to_numpy(zero_copy_only=False), m / np.linalg.norm(m, axis=1, keepdims=True)


def exact_nearest(asked: DataFrame, vectors: DataFrame, p: Forest) -> DataFrame:
    """(id, other): each asked (id, v) with its p.k most similar of vectors (id, v), equal cosines by smaller id; itself is none of them.

    The asked go out in blocks of p.block, one after the other, and every block meets all vectors once; a task gives its best p.k of
    each asked vector. Every asked vector meets every other: the time grows with the product of both numbers, the rows with the asked ones."""
    spark = asked.sparkSession
    out = spark.createDataFrame([], "id long, other long, score double")
    blocks = -(-asked.count() // p.block)
    placed = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))))
    for i in range(blocks):
        part = placed.where(F.col("block") == i).select("id", "v").toArrow().sort_by("id").combine_chunks()
        if not part.num_rows:
            continue
        sent = spark.sparkContext.broadcast((part.column("id").to_numpy(), np.stack(part.column("v").to_numpy()).astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, m = sent.value
            m = m.astype(np.float64)
            q = ids, m / np.linalg.norm(m, axis=1, keepdims=True)
            for b in batches:
                if b.num_rows:
                    ordered = pa.Table.from_batches([b]).sort_by("id").combine_chunks().to_batches()[0]
                    x, y, score = closest(q, _units(ordered.column("id"), ordered.column("v")), p.k)
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(score)], names=["id", "other", "score"])

        best = vectors.select("id", "v").mapInArrow(run, "id long, other long, score double")
        out = out.union(materialise(top(best, p.k)))
        sent.destroy()
    return top(out, p.k).select("id", "other")


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each id, cut in every task before they are shuffled."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _representatives(df: DataFrame, id_col: str, vector_col: str, p: Forest) -> tuple[DataFrame, DataFrame]:
    """(members with id and rep, vectors of the representatives with id and v), both written."""
    keyed = materialise(df.select(id_col, vector_col).mapInArrow(_usable(id_col, vector_col, p), "id long, key_high long, key_low long"))
    reps = keyed.groupBy("key_high", "key_low").agg(F.min("id").alias("rep"))
    members = materialise(keyed.distinct().join(reps, ["key_high", "key_low"]).select("id", "rep"))
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == p.dims))
    own = materialise(v.join(members.where("id = rep").select("id"), "id").dropDuplicates(["id"]))
    release(df.sparkSession)
    return members, own


def _measured(pairs: DataFrame, own: DataFrame) -> DataFrame:
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    side = lambda s: own.select(F.col("id").alias(s), F.col("v").alias(f"v_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    dot = F.aggregate(F.zip_with("v_a", "v_b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return both.select("a", "b", (dot / (length(F.col("v_a")) * length(F.col("v_b")))).alias("cosine"))


def neighbours(df: DataFrame, id_col: str, vector_col: str, p: Forest | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has id and rep (the smallest id with an equal vector) of every usable vector, one row an id;
    links has a < b and their cosine (at least p.cosine) for representatives found near each other by the forest.

    Usable: p.dims finite components, not all zero; nulls, other lengths and NaN are left out, an id counts once (its rows
    must have one vector). An empty table gives empty results."""
    p = p or Forest()
    spark = df.sparkSession
    members, own = _representatives(df, id_col, vector_col, p)
    n = own.count()
    bits, enough = p.counted(n), p.enough(n)
    hashed = materialise(own.select("id", "v").mapInArrow(_hashed(p), "id long, s array<long>"))
    counts = np.zeros(p.trees << bits, dtype=np.int64)
    held = hashed.mapInArrow(_counts(p, bits), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most trees * 2^bits rows
    counts[held.column("slot").to_numpy()] = held.column("n").to_numpy()
    ladder = Ladder(counts.reshape(p.trees, -1), bits)
    planted = hashed.mapInArrow(_planted(p, ladder, enough), "tree byte, s long, depth byte, w0 long, w1 long, w2 long, id long")
    low = planted.agg(F.min("depth")).first()[0] or 0
    forest = planted.repartitionByRange("tree", "s", "id").sortWithinPartitions("tree", "s", "id")
    met = materialise(forest.mapInArrow(_met(p, low, bits, 8 * max(1, enough // p.trees)), "a long, b long").distinct())
    release(spark)
    pairs, dense = met.where("a < b"), met.where("a = b").select(F.col("a").alias("id"))
    if dense.head(1):
        crowd = materialise(own.join(dense, "id"))
        close = exact_nearest(crowd, crowd, p).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        pairs = materialise(pairs.union(close).distinct())
    links = None
    for turn in range(p.passes):
        part = materialise(_measured(pairs.where(F.pmod(F.xxhash64("b", "a"), F.lit(p.passes)) == turn), own).where(F.col("cosine") >= p.cosine))
        links = part if links is None else links.union(part)
        release(spark)
    return members, links


def asked_neighbours(df: DataFrame, id_col: str, vector_col: str, every: int = 100, p: Forest | None = None) -> DataFrame:
    """(id, neighbour, cosine, rank): the exact p.k most similar of all other usable vectors for the ids divisible by `every`, without a
    least cosine. Below a cosine of about 0.8 no prefix of a string tells near from far, so a forest would have to ascend to the root."""
    p = p or Forest()
    members, own = _representatives(df, id_col, vector_col, p)
    wanted = materialise(members.where(F.col("id") % every == 0))
    asked = own.join(wanted.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    found = exact_nearest(asked, own, p).select(F.col("id").alias("a"), F.col("other").alias("b"))
    measured = _measured(found, own).toDF("rep", "other", "cosine")
    return nearest(members, measured, p.k, wanted)


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b", "cosine").union(links.select("b", "a", "cosine")).toDF("rep", "other", "cosine")


def nearest(members: DataFrame, far: DataFrame, k: int = 5, wanted: DataFrame | None = None) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar ids of every wanted id (of all members, if none are given) by the links
    rep, other, cosine; equal cosines by smaller id. Copies have cosine 1.

    Of a set of copies only the k + 1 smallest ids can be anybody's neighbours, so a set of any size stays short."""
    from pyspark.sql import Window

    wanted = members if wanted is None else wanted
    few = members.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("place") <= k + 1).select("rep", F.col("id").alias("neighbour"))
    own = few.select("rep", "neighbour", F.lit(1.0).alias("cosine"))
    others = far.join(few.withColumnRenamed("rep", "other"), "other").select("rep", "neighbour", "cosine")
    best = own.union(others).withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("place") <= k + 1)
    lists = best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour"))).alias("best"))
    each = wanted.join(lists, "rep").select("id", F.posexplode(F.slice(F.filter("best", lambda x: x["neighbour"] != F.col("id")), 1, k)).alias("rank", "n"))
    return each.select("id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.far")).alias("cosine"), (F.col("rank") + 1).alias("rank"))
