"""Rule rewards of responses as one column expression each: no UDF, one projection for any number of rows.

Fixed values: the amounts of each rule, which differ by task (nc: node classification, lp: link prediction) and stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import text as tx


@dataclass(frozen=True)
class Rules:
    pair_bonus: float = 0.5
    balance_bonus: float = 0.1
    balance_malus: float = 0.3
    answer_tokens: int = 12
    segment_tokens: int = 30
    segment_malus: float = 0.2
    response_tokens: int = 2200
    ordered_search: bool = True
    coverage: bool = True
    ideal_searches: int | None = None


NC_STAGE1 = Rules()
NC_STAGE2 = Rules(segment_tokens=80, response_tokens=2000, coverage=False)
LP_STAGE1 = Rules(answer_tokens=6, response_tokens=2000, ordered_search=False)
LP_STAGE2 = Rules(pair_bonus=0.6, balance_bonus=0.2, balance_malus=0.4, answer_tokens=4, segment_tokens=80, segment_malus=0.15, response_tokens=2000, coverage=False, ideal_searches=3)


def nc_class(answer: Column, gold: Column) -> Column:
    """-1 without an answer tag, -0.5 without a gold label, 1.5 for the right label, else 0."""
    return F.when(answer.isNull(), -1.0).when(gold.isNull(), -0.5).when(tx.label_key(answer) == tx.label_key(gold), 1.5).otherwise(0.0)


def lp_class(answer: Column, gold: Column) -> Column:
    """-1 without a yes or no or without a label, 1.5 where they agree, else 0."""
    said = tx.yes_no(answer)
    return F.when(said.isNull() | gold.isNull(), -1.0).when((said == "yes").cast("int") == gold, 1.5).otherwise(0.0)


def form(response: Column, r: Rules) -> Column:
    n = lambda tag: tx.occurrences(response, tag)
    once = (n("<think>") == 1) & (n("</think>") == 1) & (n("<answer>") == 1) & (n("</answer>") == 1)
    balanced = (n(tx.DOCS[0]) == n(tx.DOCS[1])) & (n(tx.QUERY[0]) == n(tx.QUERY[1]))
    answer = F.coalesce(tx.first_body(response, tx.ANSWER), F.lit(""))
    off = lambda c, amount: F.when(c, -amount).otherwise(0.0)
    return (
        F.when(once, r.pair_bonus).otherwise(-r.pair_bonus)
        + F.when(balanced, r.balance_bonus).otherwise(-r.balance_malus)
        + off(answer.contains(tx.QUERY[0]) | answer.contains(tx.DOCS[0]), 0.5)
        + off(tx.token_count(answer) > r.answer_tokens, 0.2)
        + off(answer.contains("<think>"), 0.3)
    )


def think_length(response: Column, r: Rules) -> Column:
    """0.5 if no segment of the think block is short, else a malus per short one down to -0.6; -0.3 without a block."""
    segments = tx.think_segments(response)
    short = F.size(F.filter(segments, lambda s: tx.token_count(s) < r.segment_tokens))
    return F.when(segments.isNull(), -0.3).when(short == 0, 0.5).otherwise(F.greatest(-r.segment_malus * short, F.lit(-0.6)))


def coverage(response: Column, r: Rules) -> Column:
    return F.least(0.5 * tx.used_search_kinds(response, r.ordered_search), F.lit(2.0)) if r.coverage else F.lit(0.0)


def efficiency(response: Column, right: Column, r: Rules) -> Column:
    """Only for right answers: -0.2 without a search, 0.8 for the ideal number, else 0."""
    if r.ideal_searches is None:
        return F.lit(0.0)
    n = tx.occurrences(response, tx.QUERY[0])
    return F.when(~right, 0.0).when(n == 0, -0.2).when(n == r.ideal_searches, 0.8).otherwise(0.0)


def total(response: Column, gold: Column, r: Rules, link: bool) -> Column:
    """The clamped sum of all terms. A null response counts as an empty one."""
    text = F.coalesce(response, F.lit(""))
    answer = tx.first_body(text, tx.ANSWER)
    kind = lp_class(answer, gold) if link else nc_class(answer, gold)
    length = F.when(tx.token_count(text) > r.response_tokens, -0.5).otherwise(0.0)
    s = kind + form(text, r) + think_length(text, r) + coverage(text, r) + efficiency(text, kind == 1.5, r) + length
    return F.greatest(F.least(s, F.lit(15.0)), F.lit(-15.0))


def cover_match(predicted: Column, gold: Column) -> Column:
    """1 if every word of the gold answer is in the predicted one, -1 if not or without a prediction."""
    hit = tx.covers(tx.truth_word(tx.answer_key(gold)), tx.truth_word(tx.answer_key(predicted)))
    return F.when(predicted.isNotNull() & hit, 1.0).otherwise(-1.0)
