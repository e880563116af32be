"""Numeric functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clamp01(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ratio(a, b, empty=0.0) -> Column:
    """a / b, ``empty`` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty).cast("double"))


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    exps = [F.exp(s - top) for s in scores]
    total = sum(exps[1:], exps[0])
    return [e / total for e in exps]


def argmax(names: list[str], scores: list[Column]) -> Column:
    """The first name with the largest score."""
    top = F.greatest(*scores)
    out = F.when(scores[0] == top, names[0])
    for n, s in zip(names[1:], scores[1:]):
        out = out.when(s == top, n)
    return out


def entropy(probabilities: list[Column], normalised: bool = True) -> Column:
    """-sum p ln p, over ln n if normalised; 0 ln 0 is 0."""
    import math

    parts = [F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0)) for p in probabilities]
    total = sum(parts[1:], parts[0])
    return total / math.log(len(probabilities)) if normalised else total


def nearest_rank(values, q: float) -> Column:
    """Element of the sorted array at round((n - 1) q), half to even."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.bround((F.size(values) - 1) * F.lit(q)) + 1).cast("int"))


def bin_of(x, bins: int) -> Column:
    """Half-open equal bins over [0, 1], the last one closed."""
    return F.least(F.floor(clamp01(x) * bins), F.lit(bins - 1)).cast("int")
