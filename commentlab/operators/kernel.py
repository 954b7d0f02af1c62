"""Random Fourier features (Rahimi and Recht, 2007): an RBF kernel as a plain inner product.

With w drawn from N(0, 2 gamma I) and b from U(0, 2 pi), z(x) = sqrt(2 / D) cos(W x + b) has
E[z(x) . z(y)] = exp(-gamma |x - y|^2), so that a linear model on z is a kernel model on x. D features keep the error of
one pair below e with a probability of at least 1 - 2 exp(-D e^2 / 8) (Hoeffding; each of the D terms lies in [-2, 2]).

W and b are model parameters of D x (dim + 1) numbers, fixed by a seed through md5, so that any engine can draw them.
The projection is one matrix product per Arrow batch.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WEIGHTS = 1 << 24  # W travels with the plan: a parameter, not data


def _uniforms(key: str) -> tuple[float, float]:
    """Two numbers in (0, 1) from the first and second eight hex digits of md5(key)."""
    digits = hashlib.md5(key.encode()).hexdigest()
    return (int(digits[:8], 16) + 0.5) / 2**32, (int(digits[8:16], 16) + 0.5) / 2**32


def fourier_weights(dim: int, n_features: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(W, b): W[i, j] by the Box-Muller rule from md5('seed:i:j'), b[i] from md5('seed:i:phase')."""
    if dim * n_features > MAX_WEIGHTS:
        raise ValueError(f"{n_features} features of {dim} dimensions are more than {MAX_WEIGHTS} weights")
    w = np.empty((n_features, dim))
    for i in range(n_features):
        for j in range(dim):
            u, v = _uniforms(f"{seed}:{i}:{j}")
            w[i, j] = math.sqrt(2 * gamma) * math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)
    return w, np.array([2 * math.pi * _uniforms(f"{seed}:{i}:phase")[0] for i in range(n_features)])


def fourier_features(vec: Column | str, dim: int, n_features: int, gamma: float, seed: int = 0) -> Column:
    """z(x) of an array column; null for a null vector, an error for one of another length."""
    w, b = fourier_weights(dim, n_features, gamma, seed)

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        given = np.flatnonzero(vectors.notna())
        if len(given):
            x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors.iloc[given]])
            out.iloc[given] = list(np.sqrt(2 / n_features) * np.cos(x @ w.T + b))
        return out

    return project((F.col(vec) if isinstance(vec, str) else vec).cast("array<double>"))


def rbf(x: Column | str, y: Column | str, gamma: float) -> Column:
    """exp(-gamma |x - y|^2) of two array columns."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    squares = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda p, q: (p - q) * (p - q))
    return F.exp(-F.lit(gamma) * F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s))


def scale_gamma(df: DataFrame, vec_col: str = "vec") -> float:
    """1 / (dim x variance of all entries), the usual default of kernel machines; one row comes back."""
    v = F.col(vec_col).cast("array<double>")
    entries = df.select(F.size(v).alias("n"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("s"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("q"))
    n, dim, s, q = entries.agg(F.sum("n"), F.max("n"), F.sum("s"), F.sum("q")).first()
    variance = q / n - (s / n) ** 2 if n else 0.0
    return 1.0 / (dim * variance) if variance > 0 else 1.0
