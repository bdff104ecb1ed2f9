"""Problem 2: the same or nearly the same records in several splits, by winnowing fingerprints.

A record is a sequence of tokens (64-bit numbers). A rolling hash over every run of k tokens is taken, and of each window of w
such hashes the minimum is selected, so any run of k + w - 1 tokens that two records share holds a selected hash of both.
Selected hashes are joined across splits. The seeds of a pair are chained where they are collinear and not further apart than a
limit; what lies between two seeds of a chain, and what follows its ends, is aligned with insertions, and the evaluation
record's tokens that have an equal partner are its coverage.

Selecting is built-in array expressions, evaluated inside the JVM; chains are followed in Arrow batches. Hot fingerprints (a record that a third of all rows repeat)
are met once per distinct sequence: equal sequences of one split are one row with a list-free count, and members are joined
back at the end.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import latest, name_key, split_kind


@dataclass(frozen=True)
class Winnow:
    """k: tokens per rolling hash; w: hashes per window; coverage: least covered share of the evaluation record; gap: most tokens between
    two seeds of a chain, and the stretch that is aligned at a time beyond its ends."""

    k: int = 2
    w: int = 1
    coverage: float = 1.0
    gap: int = 16


def rolling_hashes(tokens: Column, k: int) -> Column:
    """The hash of every run of k tokens; a sequence that is shorter has none."""
    starts = F.when(F.size(tokens) >= k, F.sequence(F.lit(1), F.size(tokens) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, k)))


def winnowed(hashes: Column, w: int) -> Column:
    """(pos, hash) of the rightmost minimum of every window of w hashes, each once; fewer than w hashes are one window."""
    n = F.size(hashes)
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - w, F.lit(0))))

    def least(s: Column) -> Column:
        window = F.transform(F.slice(hashes, s + 1, w), lambda h, i: F.struct(h.alias("hash"), (-(s + i)).alias("back")))
        return F.array_min(window)

    return F.array_distinct(F.transform(F.transform(starts, least), lambda m: F.struct((-m["back"]).alias("pos"), m["hash"].alias("hash"))))


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of a longest common subsequence of two short lists."""
    if not a or not b:
        return []
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def segments(seeds: list[tuple[int, int]], k: int, t: list[int], h: list[int]) -> list[tuple[int, int, int]]:
    """(place in h, place in t, length) of the equal runs around seeds (h place, t place): each seed is extended token by token both ways."""
    out = []
    for d, at in sorted((i - j, i) for i, j in set(seeds)):
        if out and out[-1][0] - out[-1][1] == d and at < out[-1][0] + out[-1][2]:
            continue  # inside the run before
        i, j = at, at - d
        if h[i : i + k] != t[j : j + k]:
            continue  # equal hashes of unequal tokens
        a, b = i, i + k
        while a and a - d and h[a - 1] == t[a - 1 - d]:
            a -= 1
        while b < len(h) and b - d < len(t) and h[b] == t[b - d]:
            b += 1
        out.append((a, a - d, b - a))
    return sorted(out)


def covered(seeds: list[tuple[int, int]], t: list[int], h: list[int], p: Winnow) -> int:
    """How many tokens of h have an equal partner in t along chains of seeds."""
    runs = segments(seeds, p.k, t, h)
    best: list[int] = []
    ends = [i + n for i, _, n in runs]
    order = sorted(range(len(runs)), key=lambda r: ends[r])
    sorted_ends = [ends[r] for r in order]
    places: set[int] = set()
    first, last = set(range(len(runs))), set(range(len(runs)))
    for r, (i, j, n) in enumerate(runs):
        places.update(range(i, i + n))
        score, before = 0, None
        for at in range(bisect_left(sorted_ends, i - p.gap), len(order)):  # chains link runs that end at most a gap before
            q = order[at]
            if sorted_ends[at] > i:
                break
            qi, qj, qn = runs[q]
            if q < r and 0 <= j - qj - qn <= p.gap and best[q] > score:
                score, before = best[q], q
        best.append(score + n)
        if before is not None:
            first.discard(r)
            last.discard(before)
            qi, qj, qn = runs[before]
            places.update(qi + qn + x for x, _ in common(h[qi + qn : i], t[qj + qn : j]))
    for r in last:  # beyond the ends of chains, stretch by stretch while half of it is equal
        i, j = runs[r][0] + runs[r][2], runs[r][1] + runs[r][2]
        while (found := common(h[i : i + p.gap], t[j : j + p.gap])) and 2 * len(found) >= min(p.gap, len(h) - i, len(t) - j):
            places.update(i + x for x, _ in found)
            i, j = i + found[-1][0] + 1, j + found[-1][1] + 1
    for r in first:
        i, j = runs[r][0], runs[r][1]
        while (found := common(h[max(0, i - p.gap) : i][::-1], t[max(0, j - p.gap) : j][::-1])) and 2 * len(found) >= min(p.gap, i, j):
            places.update(i - 1 - x for x, _ in found)
            i, j = i - found[-1][0] - 1, j - found[-1][1] - 1
    return len(places)


def _covered(p: Winnow):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, share = [], []
            for at, places, t, h in zip(*(b.column(c).to_pylist() for c in ("held_at", "train_at", "t", "h"))):
                n.append(covered(list(zip(at, places)), t, h, p))
                share.append(n[-1] / len(h))
            yield pa.RecordBatch.from_arrays([b.column("train_seq"), b.column("held_seq"), pa.array(n, pa.int32()), pa.array(share, pa.float64())], names=["train_seq", "held_seq", "covered_tokens", "coverage"])

    return run


def sequence_overlaps(train: DataFrame, held: DataFrame, p: Winnow | None = None) -> DataFrame:
    """train and held have seq (a key of the distinct sequence) and tokens array<long>; gives train_seq, held_seq, covered_tokens,
    coverage for every pair with at least the asked share of the held sequence covered: the tokens that have an equal partner in order
    along chains of seeds; unequal and inserted tokens between them do not count.

    Sequences shorter than k have no fingerprint and are in no pair. An empty side gives an empty result."""
    p = p or Winnow()

    def prints(df: DataFrame, side: str) -> DataFrame:
        marks = F.explode(winnowed(rolling_hashes(F.col("tokens"), p.k), p.w))
        return df.select(F.col("seq").alias(f"{side}_seq"), marks.alias("m")).select(f"{side}_seq", F.col("m.pos").alias(f"{side}_pos"), F.col("m.hash").alias("hash"))

    hits = prints(train, "train").join(prints(held, "held"), "hash")
    pairs = hits.groupBy("train_seq", "held_seq").agg(F.collect_list("held_pos").alias("held_at"), F.collect_list("train_pos").alias("train_at"))
    both = pairs.join(train.select(F.col("seq").alias("train_seq"), F.col("tokens").alias("t")), "train_seq").join(held.select(F.col("seq").alias("held_seq"), F.col("tokens").alias("h")), "held_seq")
    out = both.mapInArrow(_covered(p), "train_seq long, held_seq long, covered_tokens int, coverage double")
    return out.where(F.col("coverage") >= p.coverage - 1e-9)


def local_pairs(samples: DataFrame, nodes: DataFrame, datasets: DataFrame) -> DataFrame:
    """sample_id, dataset, split (train, valid, test or null), node_u <= node_v with local ids, same_as followed one step.

    The latest export of a sample counts. Samples with a null or unknown dataset or a null end node go (they name no pair);
    global ids become local by the base_offset of the sample's dataset."""
    bases = datasets.select(name_key("dataset").alias("dataset"), "base_offset")
    s = latest(samples, "sample_id", "exported_at", ["dataset", "split", "node_u", "node_v"])
    s = s.select("sample_id", name_key("dataset").alias("dataset"), split_kind("split").alias("split"), "node_u", "node_v").join(bases, "dataset")
    local = lambda c: F.when(F.col(c) >= F.col("base_offset"), F.col(c) - F.col("base_offset")).otherwise(F.col(c))
    s = s.select("sample_id", "dataset", "split", local("node_u").alias("u"), local("node_v").alias("v"))
    same = nodes.where("same_as is not null").select(name_key("dataset").alias("dataset"), "node_id", "same_as").groupBy("dataset", "node_id").agg(F.max("same_as").alias("same_as"))
    for end in ("u", "v"):
        s = s.join(same.withColumnRenamed("node_id", end), ["dataset", end], "left").withColumn(end, F.coalesce("same_as", end)).drop("same_as")
    return s.where("u is not null and v is not null").select("sample_id", "dataset", "split", F.least("u", "v").alias("node_u"), F.greatest("u", "v").alias("node_v"))


def with_tokens(pairs: DataFrame) -> DataFrame:
    """Each record as the token sequence of its two ends; a token is the hash of dataset and local node."""
    token = lambda c: F.xxhash64("dataset", c)
    tokens = F.array(token("node_u"), token("node_v"))
    return pairs.select("sample_id", "dataset", "split", tokens.alias("tokens"), F.xxhash64(tokens).alias("seq"))


def split_overlaps(samples: DataFrame, nodes: DataFrame, datasets: DataFrame, p: Winnow | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, overlaps): records with sample_id, dataset, split, seq; overlaps of distinct sequences, train against the rest."""
    records = with_tokens(local_pairs(samples, nodes, datasets))
    distinct = lambda kind: records.where(kind).groupBy("seq").agg(F.first("tokens").alias("tokens"))
    return records.drop("tokens"), sequence_overlaps(distinct("split = 'train'"), distinct("split in ('valid', 'test')"), p)


def overlap_pairs(records: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Every (sample_id_a < sample_id_b) of a train and a held-out sample whose sequences overlap."""
    train = records.where("split = 'train'").select(F.col("seq").alias("train_seq"), F.col("sample_id").alias("t"))
    held = records.where("split in ('valid', 'test')").select(F.col("seq").alias("held_seq"), F.col("sample_id").alias("h"))
    both = overlaps.join(train, "train_seq").join(held, "held_seq")
    return both.select(F.least("t", "h").alias("sample_id_a"), F.greatest("t", "h").alias("sample_id_b")).distinct()


def overlap_report(records: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Per held-out split and dataset: samples, overlapping samples, pairs with train samples, mean coverage of the overlapping."""
    train = records.where("split = 'train'").groupBy(F.col("seq").alias("train_seq")).agg(F.count("*").alias("copies"))
    hit = overlaps.join(train, "train_seq").groupBy("held_seq").agg(F.sum("copies").alias("pairs"), F.max("coverage").alias("coverage"))
    held = records.where("split in ('valid', 'test')").join(hit, F.col("seq") == F.col("held_seq"), "left")
    return held.groupBy("split", "dataset").agg(
        F.count("*").alias("samples"),
        F.count("pairs").alias("overlapping"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("train_pairs"),
        F.round(F.avg("coverage"), 6).alias("mean_coverage"),
    )


def overlap_coverage(records: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Per held-out record its split and dataset, the greatest coverage by one train record (0 without any) and the train records that overlap."""
    train = records.where("split = 'train'").groupBy(F.col("seq").alias("train_seq")).agg(F.count("*").alias("copies"))
    hit = overlaps.join(train, "train_seq").groupBy(F.col("held_seq").alias("seq")).agg(F.sum("copies").alias("train_records"), F.max("coverage").alias("coverage"))
    held = records.where("split in ('valid', 'test')").join(hit, "seq", "left")
    return held.select("sample_id", "split", "dataset", F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"), F.coalesce("train_records", F.lit(0)).alias("train_records"))


def overlap_members(records: DataFrame, overlaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): the overlaps in a form that does not grow with copies. members: every record of a split with the smallest sample id
    of its sequence; links: train_rep, held_rep and coverage of the overlapping sequences."""
    kept = records.where("split in ('train', 'valid', 'test')")
    rep = kept.groupBy("seq").agg(F.min("sample_id").alias("rep"))
    members = kept.join(rep, "seq").select("sample_id", "split", "dataset", "rep")
    named = lambda side: rep.select(F.col("seq").alias(f"{side}_seq"), F.col("rep").alias(f"{side}_rep"))
    return members, overlaps.join(named("train"), "train_seq").join(named("held"), "held_seq").select("train_rep", "held_rep", "coverage")
