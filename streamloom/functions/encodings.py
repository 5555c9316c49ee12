"""Binned value encodings and logit arithmetic on array columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1.1920928955078125e-07  # Fixed value: float32 machine epsilon.


def normalized(value: Column, low: Column, high: Column) -> Column:
    """Clamped position of a value in [low, high] as a share of the range."""
    clamped = F.least(F.greatest(value.cast("double"), low), high)
    return (clamped - low) / F.greatest(high - low, F.lit(EPSILON))


def two_hot(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Weight split linearly between the two nearest of `bins` evenly spaced bins."""
    place = normalized(value, low, high) * F.lit(float(bins - 1))

    def weight(i: Column) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(place - i))

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), weight)


def gaussian_bins(value: Column, low: Column, high: Column, bins: int, sigma: float) -> Column:
    """Normalized bell curve over the bin centres."""
    if sigma < 0:
        raise ValueError("sigma must be >= 0")
    x = normalized(value, low, high)
    spread = 2.0 * sigma * sigma
    step = F.lit(1.0 / max(1, bins - 1))

    def bell(i: Column) -> Column:
        distance = x - i * step
        return F.exp(-(distance * distance) / F.lit(spread))

    raw = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), bell)
    total = F.greatest(array_sum(raw), F.lit(EPSILON))
    return F.transform(raw, lambda v: v / total)


def encoded(value: Column, low: Column, high: Column, bins: int, sigma: float = 0.0) -> Column:
    if sigma == 0.0:
        return two_hot(value, low, high, bins)
    return gaussian_bins(value, low, high, bins, sigma)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits).cast("double")
    return top + F.log(array_sum(F.transform(logits, lambda v: F.exp(v.cast("double") - top))))


def expected_share(logits: Column, lse: Column) -> Column:
    """Softmax-weighted mean of the bin positions 0..1."""
    last = F.greatest(F.size(logits) - 1, F.lit(1)).cast("double")
    weighted = F.transform(logits, lambda v, i: F.exp(v.cast("double") - lse) * (i / last))
    return array_sum(weighted)
