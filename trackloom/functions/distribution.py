"""Column expressions over bin distributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bins, neighbours of the mode.
BINS, RADIUS = 64, 2


def bin_centers(n: int = BINS) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k + 0.5) / n)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def bound(value: Column, make) -> Column:
    """make(value), with the value computed once: a Column used inside a lambda would be computed again for each element."""
    return F.transform(F.array(value), make)[0]


def softmax(logits: Column) -> Column:
    shifted = bound(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return bound(shifted, lambda e: bound(total(e), lambda sum_: F.transform(e, lambda x: x / sum_)))


def expectation(probs: Column, n: int = BINS) -> Column:
    return dot(probs, bin_centers(n))


def first_argmax(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


def mode_expectation(probs: Column, n: int = BINS, radius: int = RADIUS) -> Column:
    """The mean of the bins around the first mode."""

    def near(p: Column, at: Column) -> Column:
        low = F.greatest(at - radius, F.lit(0))
        size = F.least(at + radius, F.lit(n - 1)) - low + 1
        part = F.slice(p, (low + 1).cast("int"), size.cast("int"))
        moments = F.aggregate(part, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s"), low.cast("double").alias("k")), lambda a, x: F.struct((a["w"] + x).alias("w"), (a["s"] + x * (a["k"] + 0.5) / n).alias("s"), (a["k"] + 1.0).alias("k")))
        return bound(moments, lambda m: m["s"] / F.greatest(m["w"], F.lit(1e-12)))

    return bound(probs, lambda p: bound(first_argmax(p), lambda at: near(p, at)))


def spread_std(probs: Column, n: int = BINS) -> Column:
    squares = F.transform(bin_centers(n), lambda c: c * c)
    return bound(probs, lambda p: bound(expectation(p, n), lambda mean: F.sqrt(F.greatest(dot(p, squares) - mean * mean, F.lit(0.0)))))


def mode_gap(probs: Column, n: int = BINS) -> Column:
    return bound(probs, lambda p: F.abs(expectation(p, n) - mode_expectation(p, n)))


def decoded(probs: Column, mode: str = "expectation", n: int = BINS, radius: int = RADIUS) -> Column:
    """A position by the named decoding: the whole mean, or the mean around the first mode (radius 0: the mode itself)."""
    if mode not in ("expectation", "mode"):
        raise ValueError(f"unknown decoding: {mode}")
    return expectation(probs, n) if mode == "expectation" else mode_expectation(probs, n, radius)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
