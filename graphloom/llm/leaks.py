"""Problem 6: evaluation texts inside training texts, by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens; positions with 0 are ignored, so a seed survives a substituted word there. The seeds
of the items and of the documents are joined by their hashes; around each hit the two texts are aligned along the diagonal,
tolerating substituted words, and the overlap is measured: words covered, substitutions, longest exact run.

Only document seeds that pass a bitmap of the item seeds (of a fixed size, whatever the number of items) are shuffled, and only documents
with a hit are read a second time, for the alignment. A phrase that many items and documents share is a skewed key of an ordinary
join, which the planner splits. The driver holds the bitmap and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WordHash, mix64, words
from graphloom.session import materialise

U64 = np.uint64


@dataclass(frozen=True)
class SpacedSeeds:
    """masks: fixed patterns; each starts and ends with 1 and spans at most min_words tokens, so every exact run of min_words words
    holds a whole seed. min_words: least overlap. substitutions: greatest share of unequal words inside an overlap.
    bitmap_bits: the bitmap has 2^bits bits (24: 2 MB); with more items than it can tell apart only more seeds are shuffled."""

    masks: tuple[str, ...] = ("11011011", "1101001011", "111010010111")
    min_words: int = 12
    substitutions: float = 0.2
    bitmap_bits: int = 24


class Tokens:
    """The tokens of a batch of texts laid end to end: hashes, starts and sizes per text."""

    def __init__(self, texts: list[str | None], known: WordHash):
        flat: list[int] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            found = words(text)
            sizes[i] = len(found)
            flat.extend(map(known.__getitem__, found))
        self.hashes, self.sizes = np.array(flat, dtype=U64), sizes
        self.starts = np.cumsum(sizes) - sizes

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.starts[i] : self.starts[i] + self.sizes[i]]


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the seed at every place where the mask fits; tokens are uint64."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    h = np.full(n, len(mask), dtype=U64)
    with np.errstate(over="ignore"):
        for i, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ tokens[i : i + n]) * U64(0x9E3779B97F4A7C15)
                h ^= h >> U64(29)
        return mix64(h)


def seeds_of(t: Tokens, p: SpacedSeeds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place in the text) of every seed of a batch; none reaches over the end of a text."""
    text = np.repeat(np.arange(len(t.sizes)), t.sizes)
    found = []
    for mask in p.masks:
        h = seed_hashes(t.hashes, mask)
        inside = np.flatnonzero(text[: len(h)] == text[len(mask) - 1 : len(mask) - 1 + len(h)])
        found.append((h[inside], text[inside], inside - t.starts[text[inside]]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _seeds(id_col: str, text_col: str, p: SpacedSeeds, sent=None):
    """(hash, id, place) of the seeds of every text; with a bitmap only of those that pass it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bitmap = WordHash(), None if sent is None else sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                part = part.filter(part.column(id_col).is_valid())
                h, text, place = seeds_of(Tokens(part.column(text_col).to_pylist(), known), p)
                if bitmap is not None:
                    slot = h >> U64(64 - p.bitmap_bits)
                    ok = np.flatnonzero(bitmap[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8) & 1)
                    h, text, place = h[ok], text[ok], place[ok]
                if len(h):
                    ids = part.column(id_col).cast(pa.int64()).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids, pa.array(place.astype(np.int32))], names=["hash", "id", "place"])

    return run


def _bitmaps(p: SpacedSeeds):
    """The bitmap of a task's seeds, in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (p.bitmap_bits - 3), dtype=np.uint8)
        for b in batches:
            slot = b.column("hash").to_numpy().view(U64) >> U64(64 - p.bitmap_bits)
            np.bitwise_or.at(bits, (slot >> U64(3)).astype(np.int64), np.left_shift(np.uint8(1), (slot & U64(7)).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    return run


def align(doc: np.ndarray, item: np.ndarray, diagonal: int, allowed: float) -> tuple[int, int, int, int, int]:
    """Along one diagonal (document place minus item place): (doc start, words, substitutions, longest exact run, item start) of the best
    overlap: the stretch, beginning and ending with equal words, with the most equal words whose share of substitutions is at
    most `allowed`; found by scoring equal words 1 and others so that the allowed share balances, as the greatest difference of
    two running sums."""
    lo, hi = max(0, diagonal), min(len(doc), len(item) + diagonal)
    same = doc[lo:hi] == item[lo - diagonal : hi - diagonal]
    if not same.any():
        return lo, 0, 0, 0, lo - diagonal
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    longest = int((edges[1::2] - edges[::2]).max())
    gain = np.where(same, 1.0, -(1 - allowed) / allowed if allowed > 0 else -float(len(same) + 1))
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    least = np.minimum.accumulate(sums[:-1])
    end = int(np.argmax(sums[1:] - least))
    begin = int(np.flatnonzero(sums[: end + 1] <= least[end])[-1])
    return lo + begin, end + 1 - begin, int((~same[begin : end + 1]).sum()), longest, lo + begin - diagonal


NAMES = ["item_id", "doc_id", "overlap_words", "substituted", "longest_run", "doc_word", "item_word", "item_share"]
SCHEMA = "item_id long, doc_id long, overlap_words int, substituted int, longest_run int, doc_word int, item_word int, item_share double"


def _aligned(p: SpacedSeeds):
    """Rows sorted by document and item, the document's text before its hits: the best overlap of every item, for each text of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        doc_id, docs, open_item, best, out = None, [], None, [], []

        def close() -> None:
            for (_, run_, start, n, changed, item_start, size), longest in best:
                if n >= p.min_words or longest >= p.min_words:
                    out.append((open_item, doc_id, n, changed, longest, start, item_start, (n - changed) / max(1, size)))

        def rows() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=NAMES)

        for b in batches:
            for d, text, item, diagonal, tokens in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "item_id", "diagonal")), b.column("tokens")):
                if d != doc_id or item != open_item:
                    close()
                    best, open_item = [], item
                if d != doc_id:
                    doc_id, docs = d, []
                if item is None:
                    docs.append(Tokens([text], known).hashes)
                    continue
                words_ = tokens.values.to_numpy().view(U64)
                for i, doc in enumerate(docs):
                    start, n, changed, longest, item_start = align(doc, words_, diagonal, p.substitutions)
                    row = (n - changed, longest, start, n, changed, item_start, len(words_))
                    if i == len(best):
                        best.append((row, longest))
                    else:
                        best[i] = (max(best[i][0], row), max(best[i][1], longest))
            if out:
                yield rows()
                out.clear()
        close()
        if out:
            yield rows()

    return run


def _tokenised(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in batches:
            t = Tokens(b.column(text_col).to_pylist(), known)
            lists = pa.ListArray.from_arrays(pa.array(np.append(t.starts, len(t.hashes)).astype(np.int32)), pa.array(t.hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(id_col).cast(pa.int64()), lists], names=["item_id", "tokens"])

    return run


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", p: SpacedSeeds | None = None) -> DataFrame:
    """One row per item and document that share at least p.min_words words in order (substituted words tolerated), with the best overlap.

    Only tokens count: case, punctuation, tags, invisible characters and white space do not. Null ids and null, empty or shorter
    texts are in no row; a document of any length is searched whole; repeated documents give a row each. An empty side gives an empty result."""
    p = p or SpacedSeeds()
    spark = docs.sparkSession
    i = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    kind = "hash long, id long, place int"
    item_seeds = materialise(i.mapInArrow(_seeds("item_id", "text", p), kind).withColumnsRenamed({"id": "item_id", "place": "at"}))
    bitmap = np.zeros(1 << (p.bitmap_bits - 3), dtype=np.uint8)
    for row in item_seeds.select("hash").mapInArrow(_bitmaps(p), "bits binary").toLocalIterator():  # a bitmap of fixed size from each task
        bitmap |= np.frombuffer(row.bits, dtype=np.uint8)
    passed = d.mapInArrow(_seeds("doc_id", "text", p, spark.sparkContext.broadcast(bitmap)), kind)
    hits = passed.join(item_seeds, "hash").select(F.col("id").alias("doc_id"), "item_id", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    hits = materialise(hits)
    tokens = i.mapInArrow(_tokenised("item_id", "text"), "item_id long, tokens array<long>")
    rows = d.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("int").alias("diagonal"), F.lit(None).cast("array<long>").alias("tokens"))
    rows = rows.unionByName(hits.join(tokens, "item_id").withColumn("text", F.lit(None).cast("string")))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", F.col("item_id").asc_nulls_first()).mapInArrow(_aligned(p), SCHEMA)


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per evaluation item: number of documents with it, the longest exact run and the greatest share of the item that one document holds."""
    per = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.max("longest_run").alias("longest_run"), F.round(F.max("item_share"), 6).alias("most_share"))
    return items.select("item_id").distinct().join(per, "item_id", "left").select("item_id", F.coalesce("docs", F.lit(0)).alias("docs"), "longest_run", "most_share")
