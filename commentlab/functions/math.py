"""Scalar and array math as Column expressions (M1–M5, R2–R4, dot products)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sigmoid(x: Column | str) -> Column:
    """M1."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def clamp(x: Column | str, c: float = 0.1) -> Column:
    """M2: clamp to [-c, c]."""
    return F.greatest(F.lit(-c), F.least(F.lit(c), _c(x)))


def relu(x: Column | str) -> Column:
    """M3."""
    return F.greatest(_c(x), F.lit(0.0))


def argmax(a: Column | str) -> Column:
    """M5: 0-based index of the largest element, lowest index on ties."""
    arr = _c(a)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def softmax(a: Column | str) -> Column:
    """M4 (array form): exp(x - max) / sum(exp(x - max))."""
    arr = _c(a).cast("array<double>")
    m = F.array_max(arr)
    e = F.transform(arr, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def logsumexp(a: Column | str) -> Column:
    """log(sum(exp(a))), computed around the maximum."""
    arr = _c(a).cast("array<double>")
    m = F.array_max(arr)
    return m + F.log(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays (shorter length wins)."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0).cast("double"), lambda acc, v: acc + v
    )


def dot_literal(a: Column, weights: Sequence[float]) -> Column:
    """Dot product of an array column with a fixed weight vector (a model parameter, not data)."""
    return dot(a.cast("array<double>"), F.array(*[F.lit(float(w)) for w in weights]))


def array_sum(a: Column | str) -> Column:
    return F.aggregate(_c(a).cast("array<double>"), F.lit(0.0), lambda acc, x: acc + x)


def place_sum(col: Column | str) -> Column:
    """Sum of entry times 1-based place: tells a vector from its permutations."""
    c = F.col(col) if isinstance(col, str) else col
    return array_sum(F.transform(c, lambda x, i: x.cast("double") * (i + 1)))


def l2_norm(a: Column | str) -> Column:
    arr = _c(a).cast("array<double>")
    return F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x * x))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def pad_right(seq: Column | str, n: int, pad: int = 1) -> Column:
    """R2: first ``n`` items, then ``pad`` up to length ``n``."""
    s = _c(seq)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(s), F.lit(0)))
    return F.concat(F.slice(s, 1, n), fill)


def pad_left(seq: Column | str, n: int, pad: int = 1) -> Column:
    """``pad`` first, then the first ``n`` items (torchtext ``pad_first``)."""
    s = _c(seq)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(n) - F.size(s), F.lit(0)))
    return F.concat(fill, F.slice(s, 1, n))


def position_ids(seq: Column | str, pad: int = 1) -> Column:
    """i+1 on real tokens, 0 on padding."""
    return F.transform(_c(seq), lambda v, i: F.when(v == F.lit(pad), F.lit(0)).otherwise(i + 1))


def soft_margin_term(logit: Column | str, target: Column | str) -> Column:
    """Per-cell multi-label soft-margin (logistic) loss in the overflow-free form."""
    x, y = _c(logit), _c(target).cast("double")
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
