"""Loss formulas as column expressions on logged values (no back-propagation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus_neg(x: Column) -> Column:
    """-log sigmoid(x), stable on both sides."""
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def kl_k1(logp: Column, ref: Column, mask: Column | None = None) -> Column:
    d = logp - ref
    return d if mask is None else d * mask


def kl_k3(logp: Column, ref: Column, mask: Column | None = None) -> Column:
    d = kl_k1(logp, ref, mask)
    return F.exp(-d) - 1 + d


def ppo_term(logp: Column, old: Column, advantage: Column, eps: float = 0.2) -> Column:
    ratio = F.exp(logp - old)
    return -F.least(ratio * advantage, F.greatest(F.least(ratio, F.lit(1 + eps)), F.lit(1 - eps)) * advantage)


def value_term(value: Column, old: Column, returns: Column, eps: float = 0.2) -> Column:
    """Half the greater of the squared errors of the value and of the value clipped around the old one."""
    clipped = old + F.greatest(F.least(value - old, F.lit(eps)), F.lit(-eps))
    e1, e2 = value - returns, clipped - returns
    return F.greatest(e1 * e1, e2 * e2) / 2


def pairwise(chosen: Column, rejected: Column, margin: Column | None = None) -> Column:
    d = chosen - rejected
    return softplus_neg(d if margin is None else d - margin)


def log_exp(chosen: Column, rejected: Column) -> Column:
    return F.log1p(F.exp(rejected - chosen))


def dpo(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1, smoothing: float = 0.0, ipo: bool = False) -> Column:
    h = (chosen - rejected) - (ref_chosen - ref_rejected)
    if ipo:
        e = h - F.lit(1 / (2 * beta))
        return e * e
    return softplus_neg(h * beta) * (1 - smoothing) + softplus_neg(-h * beta) * smoothing


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def kto(logratio: Column, kl: Column, desirable: Column, beta: float = 0.1, good: float = 1.0, bad: float = 1.0) -> Column:
    """1 - sigmoid(beta (r - kl)) for desirable rows and 1 - sigmoid(beta (kl - r)) for the others, weighted; kl at least 0."""
    k = F.greatest(kl, F.lit(0.0))
    return F.when(desirable, good * (1 - sigmoid(beta * (logratio - k)))).otherwise(bad * (1 - sigmoid(beta * (k - logratio))))


def cross_entropy(logits: Column, place: Column) -> Column:
    from graphloom.functions.vectors import log_softmax_at

    return -log_softmax_at(logits, place)


def distillation(student: Column, teacher: Column) -> Column:
    """-sum softmax(teacher) * log softmax(student)."""
    top_s, top_t = F.array_max(student), F.array_max(teacher)
    exps = lambda a, top: F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(top, F.size(a)).alias("t")), lambda p: F.exp(p["x"] - p["t"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    weighted = F.zip_with(exps(teacher, top_t), student, lambda w, x: w * x)
    weight = total(exps(teacher, top_t))
    return -(total(weighted) / weight - top_s - F.log(total(exps(student, top_s))))
