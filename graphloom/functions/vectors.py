"""Vector and array expressions on array<float|double> columns; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double; null where a side is null or the lengths differ."""
    terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / by)


def unit(a: Column, least: float = 1e-12) -> Column:
    """Divided by its length, or by `least` if that is greater."""
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(F.greatest(norm(a), F.lit(least)), F.size(a)).alias("n")), lambda p: p["x"].cast("double") / p["n"])


def unit_or_same(a: Column) -> Column:
    """Divided by its length; a vector of length zero stays as it is."""
    n = norm(a)
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(F.when(n == 0, 1.0).otherwise(n), F.size(a)).alias("n")), lambda p: p["x"].cast("double") / p["n"])


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def mean_pair(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2)


def blended(a: Column, b: Column, share: float) -> Column:
    """share * a + (1 - share) * b; b where a is null."""
    return F.when(a.isNull(), F.transform(b, lambda x: x.cast("double"))).otherwise(F.zip_with(a, b, lambda x, y: x.cast("double") * share + y.cast("double") * (1 - share)))


def log_softmax_at(logits: Column, place: Column) -> Column:
    """log softmax of the element at a 1-based place, shifted by the greatest for stability."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(F.arrays_zip(logits.alias("x"), F.array_repeat(top, F.size(logits)).alias("t")), lambda p: F.exp(p["x"] - p["t"])), F.lit(0.0), lambda s, x: s + x)
    return F.element_at(logits, place) - top - F.log(total)


def padded_left(a: Column, n: Column, fill: Column) -> Column:
    return F.concat(F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0))), a)


def padded_right(a: Column, n: Column, fill: Column) -> Column:
    return F.concat(a, F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0))))


def discounted(rewards: Column, gamma: float) -> Column:
    """R_t = r_t + gamma * R_(t+1) for every place, by a fold from the end."""
    empty = F.array().cast("array<double>")
    back = F.aggregate(
        F.reverse(rewards),
        F.struct(F.lit(0.0).alias("last"), empty.alias("out")),
        lambda s, r: F.struct((r + F.lit(gamma) * s["last"]).alias("last"), F.concat(F.array(r + F.lit(gamma) * s["last"]), s["out"]).alias("out")),
        lambda s: s["out"],
    )
    return back


def advantages(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimation: A_t = delta_t + gamma * lam * A_(t+1), delta_t = r_t + gamma * V_(t+1) - V_t."""
    empty = F.array().cast("array<double>")
    pairs = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v")))

    def step(s: Column, p: Column) -> Column:
        a = p["r"] + F.lit(gamma) * s["next"] - p["v"] + F.lit(gamma * lam) * s["a"]
        return F.struct(a.alias("a"), p["v"].alias("next"), F.concat(F.array(a), s["out"]).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("next"), empty.alias("out")), step, lambda s: s["out"])


def smoothed(xs: Column, keep: float) -> Column:
    """Exponential moving average m = keep * m + (1 - keep) * x, from 0."""
    return F.aggregate(xs, F.lit(0.0), lambda m, x: m * F.lit(keep) + F.lit(1 - keep) * x)


def adapted_coefficient(kls: Column, start: float, target: float, steps: float, horizon: float) -> Column:
    """The controller v *= 1 + clip(kl / target - 1, -0.2, 0.2) * steps / horizon, over a sequence."""
    return F.aggregate(kls, F.lit(start), lambda v, k: v * (1 + F.greatest(F.least(k / F.lit(target) - 1, F.lit(0.2)), F.lit(-0.2)) * F.lit(steps / horizon)))
