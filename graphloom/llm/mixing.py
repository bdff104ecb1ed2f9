"""Problem 7: mixing sources to target weights, by temperature mixing.

Sizes are tokens of a public tokenizer, counted over all documents. The weights of the mix come from an exponent: either the asked shares
(tilted from the natural ones by an exponent of 1), or the natural shares raised to the exponent that meets a target entropy. For every source the
exponent is bisected at which its repetitions reach their cap: a source whose limit is below 1 is short, takes its cap, and
the others share the rest by their weights. Budgets are realised as blocks: every block is a random permutation of all documents of a source,
the last one cut at the budget. Running token totals come from a global range-partitioned sort, so a source that holds a third
of all rows is no single task.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import name_key
from graphloom.llm.top_items import running_totals

#: Where the vocabulary files of public tokenizers are; a parameter of every function that counts.
TOKENIZERS = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenization pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _encoding(folder: str):
    import tiktoken

    with open(os.path.join(folder, VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counted(text_col: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(folder)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(text_col).to_pylist()]
            keep = [i for i, name in enumerate(b.schema.names) if name != text_col]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(n, pa.int64())], names=[*(b.schema.names[i] for i in keep), "tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", folder: str | None = None) -> DataFrame:
    """id, source (as a key) and tokens of every document; empty and null texts have 0 tokens, a null source stays null."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), name_key(source_col).alias("source"), F.col(text_col).alias("_text"))
    return base.mapInArrow(_counted("_text", folder or TOKENIZERS), "doc_id long, source string, tokens long")


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent and made to add up to 1; a share of 0 stays 0."""
    raised = {s: x**exponent if x > 0 else 0.0 for s, x in shares.items()}
    total = sum(raised.values())
    return {s: x / total if total else 0.0 for s, x in raised.items()}


def entropy(shares: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in shares.values() if x > 0)


def exponent_for_entropy(shares: dict[str, float], wanted: float, steps: int = 60) -> float:
    """The exponent in [0, 8] whose mix has the wanted entropy; entropy falls as the exponent grows. Out of reach: the nearer end."""
    lo, hi = 0.0, 8.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        if entropy(tempered(shares, mid)) > wanted:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def tilted(natural: dict[str, float], target: dict[str, float], exponent: float) -> dict[str, float]:
    """natural * (target / natural) ** exponent, made to add up to 1: the natural shares at 0, the targets at 1."""
    raised = {s: math.exp((1 - exponent) * math.log(natural[s]) + exponent * math.log(t)) if t > 0 and natural.get(s, 0) > 0 else 0.0 for s, t in target.items()}
    total = sum(raised.values())
    return {s: x / total if total else 0.0 for s, x in raised.items()}


def exponent_within_caps(natural: dict[str, float], target: dict[str, float], most: dict[str, float], steps: int = 60) -> float:
    """The greatest exponent in [0, 1] at which no source needs more than its cap (most, in shares of the budget)."""
    fits = lambda e: all(w <= most[s] + 1e-12 for s, w in tilted(natural, target, e).items())
    if fits(1.0):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return lo


def repetition_limits(natural: dict[str, float], weights: dict[str, float], most: dict[str, float], steps: int = 60) -> dict[str, float]:
    """For each source the greatest exponent in [0, 1] at which the tilted mix keeps its cap (most, in shares of the budget); 1 where the
    weights themselves do, 0 where even the natural shares do not. A source without tokens has no tilt: 0, or 1 with no weight."""
    out = {}
    for s, w in weights.items():
        fits = lambda e: tilted(natural, weights, e)[s] <= most[s] + 1e-12  # noqa: B023, E731
        if natural.get(s, 0) <= 0:
            out[s] = 0.0 if w > 0 else 1.0
        elif w <= most[s]:
            out[s] = 1.0
        else:
            lo, hi = 0.0, 1.0
            for _ in range(steps):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if fits(mid) else (lo, mid)
            out[s] = lo
    return out


def budgets(weights: dict[str, float], caps: dict[str, int], limits: dict[str, float], total: int) -> dict[str, int]:
    """Tokens of each source: short sources (limit below 1) take their caps, the others share the rest by their weights; a source that
    would pass its cap so takes it, and the rest is shared again, until all fit. Rounded down, the remainder to the greatest fractions."""
    fixed = {s: caps[s] for s in weights if limits[s] < 1}
    while True:
        rest = max(0, total - sum(fixed.values()))
        open_ = {s: w for s, w in weights.items() if s not in fixed and w > 0}
        mass = sum(open_.values())
        share = {s: rest * w / mass for s, w in open_.items()} if mass else {}
        over = [s for s, x in share.items() if x > caps[s]]
        if not over:
            break
        fixed |= {s: caps[s] for s in over}
    out = {s: int(x) for s, x in share.items()}
    for s in sorted(share, key=lambda s: (-(share[s] - int(share[s])), s))[: round(sum(share.values())) - sum(out.values())]:
        out[s] = min(caps[s], out[s] + 1)
    return {s: fixed.get(s, out.get(s, 0)) for s in weights}


def plan(counts: DataFrame, targets: DataFrame, entropy_wanted: float | None = None) -> list[dict]:
    """One row per target source: its tokens, cap, wanted tokens, exponent, shortfall and budget. The target table bounds what is collected.

    With entropy_wanted the weights are the natural shares of the target sources raised to the exponent with that entropy, else the
    target shares. exponent: the source's repetition limit; below 1 it is short, and missing is what its weight asks beyond its cap.
    A source asked twice is an error."""
    have = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    asked = targets.select(F.col("source").alias("name"), name_key("source").alias("source"), "target_permille", "max_repeats", "token_budget")
    rows = [r.asDict() for r in asked.join(have, "source", "left").orderBy("source").collect()]
    if len({r["source"] for r in rows}) < len(rows):
        raise ValueError("a source is listed twice")
    if not rows:
        return []
    total = max(r["token_budget"] or 0 for r in rows)
    for r in rows:
        r["tokens"], r["docs"] = r["tokens"] or 0, r["docs"] or 0
        r["cap"] = r["tokens"] * (r["max_repeats"] or 0)
    mass = sum(r["tokens"] for r in rows) or 1
    natural = {r["source"]: r["tokens"] / mass for r in rows}
    weight = {r["source"]: (r["target_permille"] or 0) / 1000 for r in rows}
    if entropy_wanted is not None:
        weight = tempered(natural, exponent_for_entropy(natural, entropy_wanted))
    caps = {r["source"]: r["cap"] for r in rows}
    limits = repetition_limits(natural, weight, {s: c / max(1, total) for s, c in caps.items()})
    budget = budgets(weight, caps, limits, total)
    for r in rows:
        s = r["source"]
        r["wanted"], r["exponent"], r["budget"] = weight[s] * total, limits[s], budget[s]
        r["missing"] = r["wanted"] - r["cap"] if limits[s] < 1 else 0.0
    return rows


def mix(counts: DataFrame, targets: DataFrame, seed: int = 42, entropy_wanted: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(uses, report). uses: one row per use of a document: doc_id, source, block (from 0), start (tokens of the source's sequence of
    blocks before it) and tokens; start orders the uses of a source. report: one row per target source with wanted and actual
    tokens and shares, docs used, greatest use and the shortfall.

    Every block is a random order of the source's documents by a hash of seed, block and id; a document is used in a block if the
    tokens before it are within the budget, so no document is used more than max_repeats times and a source exceeds its budget by
    less than one document. Documents without tokens or target are in no mix; repeated ids count as documents of their own."""
    spark = counts.sparkSession
    rows = plan(counts, targets, entropy_wanted)
    wide = "source string, name string, budget long, tokens_all long, repeats int, wanted double, missing double, exponent double"
    plan_df = spark.createDataFrame([(r["source"], r["name"], r["budget"], r["tokens"], r["max_repeats"] or 0, float(r["wanted"]), float(r["missing"]), float(r["exponent"])) for r in rows], wide)
    d = counts.where("tokens > 0").join(F.broadcast(plan_df.where("budget > 0")), "source")  # one row per target source
    last = F.floor((F.col("budget") - 1) / F.col("tokens_all")).cast("int")  # blocks are few: at most max_repeats
    d = d.select("doc_id", "source", "tokens", "budget", "tokens_all", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    d = d.withColumn("draw", F.xxhash64(F.lit(seed), "block", "doc_id"))
    upto = running_totals(d, ["source", "block"], [F.col("draw"), F.col("doc_id")], weight=F.col("tokens"), name="upto")
    start = F.col("block") * F.col("tokens_all") + F.col("upto") - F.col("tokens")
    uses = upto.withColumn("start", start).where("start < budget").select("doc_id", "source", "block", "start", "tokens")
    used = uses.groupBy("doc_id", "source").agg(F.count("*").alias("uses"), F.sum("tokens").alias("sum"))
    per = used.groupBy("source").agg(F.sum("sum").alias("actual"), F.count("*").alias("docs_used"), F.max("uses").alias("most_uses"))
    whole = F.sum("actual").over(Window.partitionBy(F.lit(1)))  # one row per target source
    report = plan_df.join(per, "source", "left").withColumn("_all", whole)
    share = lambda c: F.round(1000 * c / F.col("_all"), 3)
    report = report.select(
        F.col("name").alias("source"),
        F.col("tokens_all").alias("tokens_available"),
        F.round("wanted", 3).alias("tokens_wanted"),
        F.coalesce("actual", F.lit(0)).alias("tokens_actual"),
        F.coalesce(share(F.col("actual")), F.lit(0.0)).alias("permille_actual"),
        F.coalesce("docs_used", F.lit(0)).alias("docs_used"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.round("missing", 3).alias("tokens_missing"),
        F.round("exponent", 6).alias("exponent"),
    )
    return uses, report
