"""Problem 1: near-duplicate records with small edits, by min-max hashing.

Every text becomes a bag of (word, occurrence) elements. Under each hash function both the minimum and the maximum are
retained, so one evaluation gives two signature values; bands of such values are joined, and the pairs that meet in a band are
checked exactly on their bags. All words weigh alike, however many texts have them, so a family of edited copies is found by its
similarity alone, also where it makes its own words common. One setting of bands holds for tables of any size.

What meets by chance is dropped inside the join by a sketch of four bits of 64 signature values, before any bag is moved. Bands, and
then the exact checks, are taken in passes, so that the disk never holds more than the shuffle of one pass.

Records whose latest texts have the same bag (by 128 bits) are one representative from the start, so exact copies never meet each
other in a band. Texts themselves are never shuffled; of a representative only its elements are (four bytes a word).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import WordHash, mix64, release, words
from graphloom.session import materialise

U64, U32 = np.uint64, np.uint32
PLANES = 4
SKETCH = [f"s{i}" for i in range(PLANES)]


@dataclass(frozen=True)
class MinMax:
    """Parameters of the search, the same at every size.

    threshold: shared words, with repetition, against the longer text.
    min_words: shorter texts are in no pair.
    rows, bands: values per band (half of them minima, half maxima) and bands. Two texts of Jaccard similarity j meet with
    1 - (1 - j^rows)^bands: 0.78 at 0.6, the least that a pair at the threshold of 0.75 can have, 0.98 at 0.7, 0.9997 at 0.78.
    passes: parts of the bands, and of the exact checks, that are done one after the other.
    deviations: a pair at the threshold is dropped by the sketch where its agreement is so many deviations below the mean (3: 0.13 %)."""

    threshold: float = 0.75
    min_words: int = 20
    rows: int = 6
    bands: int = 32
    passes: int = 2
    deviations: float = 3.0
    seed: int = 20300101

    @property
    def per_pass(self) -> int:
        return -(-self.bands // self.passes)

    @property
    def fields(self) -> int:
        """Signature values of a pass that the sketch has bits of."""
        return min(64, self.rows * self.per_pass)

    @property
    def least_agreeing(self) -> int:
        """Fields that a pair at the threshold has alike, less the deviations; its Jaccard similarity is t / (2 - t) at least."""
        j = self.threshold / (2 - self.threshold)
        alike = j + (1 - j) / 2**PLANES
        return math.floor(self.fields * alike - self.deviations * math.sqrt(self.fields * alike * (1 - alike)))


@dataclass
class Bags:
    """The bags of a batch laid end to end: elements (word and occurrence), starts and sizes per text."""

    elements: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    kept: np.ndarray

    @staticmethod
    def of(texts: list[str | None], known: WordHash, least: int) -> Bags:
        flat: list[int] = []
        sizes, kept = [], []
        for i, text in enumerate(texts):
            tokens = words(text)
            if len(tokens) >= least:
                flat.extend(map(known.__getitem__, tokens))
                sizes.append(len(tokens))
                kept.append(i)
        w, n = np.array(flat, dtype=U64), np.array(sizes, dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(n)])[:-1].astype(np.int64)
        doc = np.repeat(np.arange(len(n), dtype=U64), n)
        with np.errstate(over="ignore"):
            key = mix64(w ^ mix64(doc + U64(1)))
            order = np.argsort(key, kind="stable")
            new = np.ones(len(w), dtype=bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))
            nth = np.empty(len(w), dtype=U64)
            nth[order] = (np.arange(len(w)) - first).astype(U64)  # how often the word stood in the text before
            elements = mix64(w + nth * U64(0x9E3779B97F4A7C15))
        return Bags(elements, starts, n, np.array(kept, dtype=np.int64))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers per bag, the same for any order of the same elements; together 128 bits."""
        if not len(self.sizes):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            sums = (np.add.reduceat(mix64(self.elements ^ U64(salt)), self.starts) for salt in (0, 0x5851F42D4C957F2D))
            high, low = (mix64(x ^ self.sizes.astype(U64)).view(np.int64) for x in sums)
            return high, low

    def short(self) -> np.ndarray:
        """The elements in four bytes each."""
        return (self.elements >> U64(32)).astype(U32)


def _overview(id_col: str, text_col: str, version_col: str | None, p: MinMax, kind: pa.DataType):
    """For every row its id, version and bag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in batches:
            bags = Bags.of(b.column(text_col).to_pylist(), known, p.min_words)
            keys, missing = np.zeros((2, b.num_rows), dtype=np.int64), np.ones(b.num_rows, dtype=bool)
            keys[:, bags.kept], missing[bags.kept] = bags.keys(), False
            version = b.column(version_col) if version_col else pa.nulls(b.num_rows, kind)
            yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), version, *(pa.array(k, mask=missing) for k in keys)], names=["id", "version", "bag_high", "bag_low"])

    return run


def _elements(id_col: str, text_col: str, p: MinMax):
    """For every row with enough words its id, bag and elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in batches:
            b = b.filter(b.column(id_col).is_valid())
            bags = Bags.of(b.column(text_col).to_pylist(), known, p.min_words)
            if len(bags.sizes):
                lists = pa.ListArray.from_arrays(pa.array(np.append(bags.starts, len(bags.elements)).astype(np.int32)), pa.array(bags.short().view(np.int32)))
                ids = b.column(id_col).take(pa.array(bags.kept)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(k) for k in bags.keys()), lists], names=["rep", "high", "low", "elements"])

    return run


def bands_of(elements: np.ndarray, starts: np.ndarray, p: MinMax, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts, bands of the pass) and sketches (texts, PLANES); elements are uint32, laid end to end.

    Bit i of plane j of a sketch is bit j of the i-th signature value."""
    rng = np.random.default_rng((p.seed, turn))
    bands = min(p.per_pass, p.bands - turn * p.per_pass)
    factor = rng.integers(0, 2**32, (bands, p.rows // 2, 2), dtype=np.uint64).astype(U32) | U32(1)
    keys, sketch = np.zeros((len(starts), bands), dtype=U64), np.zeros((len(starts), PLANES), dtype=U64)
    x, t = np.empty_like(elements), np.empty_like(elements)
    field = 0
    with np.errstate(over="ignore"):
        for band in range(bands):
            for a, c in factor[band]:
                np.add(elements, c, out=x)  # a product alone would leave an element of 0 the least under every function
                np.multiply(x, a, out=x)
                np.right_shift(x, U32(15), out=t)
                np.bitwise_xor(x, t, out=x)
                np.multiply(x, c, out=x)
                values = np.minimum.reduceat(x, starts).astype(U64), np.maximum.reduceat(x, starts).astype(U64)
                keys[:, band] = mix64(keys[:, band] * U64(0x2545F4914F6CDD1D) + (values[0] << U64(32) | values[1]))
                for v in values:
                    if field < p.fields:
                        mixed = mix64(v)
                        for plane in range(PLANES):
                            sketch[:, plane] |= ((mixed >> U64(plane)) & U64(1)) << U64(field)
                        field += 1
            keys[:, band] = mix64(keys[:, band] + U64(band + 1))
    return keys, sketch


def _banded(p: MinMax, turn: int):
    """(rep, size, elements) -> band, rep, size and sketch: one row per text and band of the pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                lists = part.column("elements")
                offsets = lists.offsets.to_numpy()
                keys, sketch = bands_of(lists.flatten().to_numpy().view(U32), (offsets[:-1] - offsets[0]).astype(np.int64), p, turn)
                many = lambda c: pa.array(np.repeat(c, keys.shape[1]))  # noqa: B023, E731
                cols = [pa.array(keys.view(np.int64).ravel()), many(part.column("rep").to_numpy()), many(part.column("size").to_numpy())]
                yield pa.RecordBatch.from_arrays([*cols, *(many(sketch[:, i].view(np.int64)) for i in range(PLANES))], names=["band", "rep", "size", *SKETCH])

    return run


def _met(one: DataFrame, p: MinMax, turn: int) -> DataFrame:
    """(rep_a, rep_b), each once, that meet in a band of the pass and are not told apart by their sizes and sketches."""
    keys = one.mapInArrow(_banded(p, turn), f"band long, rep long, size int, {', '.join(f'{c} long' for c in SKETCH)}")
    unlike = reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")) for c in SKETCH])
    near = F.bit_count(unlike) <= p.fields - p.least_agreeing
    sizes = F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * p.threshold - 1e-6  # else they cannot share enough
    meet = keys.alias("x").join(keys.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.rep") < F.col("y.rep")) & sizes & near)
    return meet.select(F.col("x.rep").alias("rep_a"), F.col("y.rep").alias("rep_b")).distinct()


def _checked(pairs: DataFrame, one: DataFrame, p: MinMax) -> DataFrame:
    """The pairs that reach the threshold, with their similarity."""
    side = lambda s: one.select(F.col("rep").alias(f"rep_{s}"), F.col("size").alias(f"size_{s}"), F.col("elements").alias(f"elements_{s}"))
    both = pairs.join(side("a"), "rep_a").join(side("b"), "rep_b")
    shared = F.size(F.array_intersect("elements_a", "elements_b")) / F.greatest("size_a", "size_b")
    return both.select("rep_a", "rep_b", shared.cast(T.DoubleType()).alias("similarity")).where(F.col("similarity") >= p.threshold - 1e-9)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, version_col: str | None = None, p: MinMax | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has id and rep of every record: the smallest id whose latest text has the same bag, null for a text
    with fewer than min_words words; links has rep_a < rep_b and the similarity of every found pair of different bags.

    A record written again (same id) counts once, by its latest version (of equal versions one with a bag, the greatest). Null ids
    go; null, empty and too short texts have no rep; an empty table gives empty results. Texts of any length are read whole."""
    spark = df.sparkSession
    p = p or MinMax()
    cols = [id_col, text_col] + ([version_col] if version_col else [])
    kind = df.schema[version_col].dataType.simpleString() if version_col else "bigint"
    texts = df.select(*cols)
    seen = texts.mapInArrow(_overview(id_col, text_col, version_col, p, pa.int64()), f"id long, version {kind}, bag_high long, bag_low long").where("id is not null")
    # a struct of flat values would be aggregated by sorting; the greatest version and, of its rows, the greatest bag are hash aggregates
    seen = materialise(seen)
    newest = seen.groupBy("id").agg(F.max("version").alias("newest"))
    current = seen.join(newest, "id").where(F.col("version").eqNullSafe(F.col("newest")))
    top = current.groupBy("id").agg(F.max("bag_high").alias("bag_high"))
    bags = materialise(current.groupBy("id", "bag_high").agg(F.max("bag_low").alias("bag_low")).join(top.withColumnRenamed("bag_high", "top"), "id").where(F.col("bag_high").eqNullSafe(F.col("top"))).drop("top"))
    reps = bags.where("bag_high is not null").groupBy("bag_high", "bag_low").agg(F.min("id").alias("rep"))
    members = materialise(bags.join(reps, ["bag_high", "bag_low"], "left").select("id", "rep", "bag_high", "bag_low"))

    chosen = members.where("id = rep").select("rep", "bag_high", "bag_low")
    found = texts.select(id_col, text_col).mapInArrow(_elements(id_col, text_col, p), "rep long, high long, low long, elements array<int>")
    one = materialise(found.join(chosen, "rep").where("high = bag_high and low = bag_low").dropDuplicates(["rep"]).select("rep", F.size("elements").alias("size"), "elements"))
    release(spark)
    met, links = None, None
    for turn in range(-(-p.bands // p.per_pass)):
        found = materialise(_met(one, p, turn))
        met = found if met is None else met.union(found)
        release(spark)
    met = materialise(met.distinct())
    for turn in range(p.passes):
        part = materialise(_checked(met.where(F.pmod(F.xxhash64("rep_b", "rep_a"), F.lit(p.passes)) == turn), one, p))
        links = part if links is None else links.union(part)
        release(spark)
    return members.select("id", "rep"), links


def pairs_of_records(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of record ids (a < b): copies of one bag, and the records of linked bags."""
    m = members.where("rep is not null")
    a, b = m.select(F.col("id").alias("id_a"), F.col("rep").alias("rep_a")), m.select(F.col("id").alias("id_b"), F.col("rep").alias("rep_b"))
    copies = a.join(b, (F.col("rep_a") == F.col("rep_b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
    linked = links.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return copies.union(linked)


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, n_links): the connected class of every record and the number of other bags its own is linked to.

    class_id is the smallest record id of the class; a record without a bag is its own class with 0 links. In each round every
    node is merged into the neighbour that comes first in a random order of the round, and the edges are drawn between what is left, until
    none is: a class halves about once a round, whatever its shape, also a long chain. Every round is a written table, so no
    lineage grows and no class is collected."""
    edges = materialise(links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    ends = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links"))
    merged, turn = [], 0
    while edges.head(1):
        order = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: B023, E731
        near = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min_by("b", order("b")).alias("near"))
        into = materialise(near.where(order("near") < order("node")))
        merged.append(into)
        moved = lambda df, c: df.join(into, F.col(c) == F.col("node"), "left").withColumn(c, F.coalesce("near", c)).drop("node", "near")  # noqa: B023, E731
        edges = materialise(moved(moved(edges, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        turn += 1
    # a node is merged once, so the rounds have different nodes: from the last round back, each follows where its neighbour went
    final = None
    for into in reversed(merged):
        step = into.select("node", F.col("near").alias("label"))
        if final is not None:
            later = final.select(F.col("node").alias("label"), F.col("label").alias("later"))
            step = materialise(step.join(later, "label", "left").select("node", F.coalesce("later", "label").alias("label")))
        final = step if final is None else final.union(step)
    labels = ends.withColumn("label", F.col("rep"))
    if final is not None:
        labels = ends.join(final, F.col("rep") == F.col("node"), "left").select("rep", "n_links", F.coalesce("label", "rep").alias("label"))
    known = members.join(labels, "rep", "left").select("id", F.coalesce("label", "rep").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = known.where("label is not null").groupBy("label").agg(F.min("id").alias("class_id"))
    return known.join(named, "label", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), "n_links")
