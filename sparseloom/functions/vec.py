"""Vector algebra as native columns over array<double>, and the same kernels in NumPy.

Sizes that differ raise at run time; `zip_with` alone would pad with nulls. p is a plan-time constant, so p = 2 becomes a dot
product and not a power.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def _same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different size")).cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return _same_size(a, b, total(F.zip_with(a, b, lambda x, y: x * y)))


def p_norm(v: Column | str, p: float = 2.0) -> Column:
    v = _col(v)
    if p < 1:
        raise ValueError("p must be at least 1")
    if p == 1:
        return total(F.transform(v, F.abs))
    if p == 2:
        return F.sqrt(total(F.transform(v, lambda x: x * x)))
    return F.pow(total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(1.0 / p))


def normalize(v: Column | str, p: float = 2.0) -> Column:
    """Divided by its p-norm; a zero vector stays as it is."""
    v = _col(v)
    norm = p_norm(v, p)
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def weighted_score(w: Column | str, x: Column | str, p: float = 2.0) -> Column:
    """Sum of |w|^(p-2) w x; written as sign(w) |w|^(p-1) x, which is 0 and not NaN where w is 0 and p < 2."""
    w, x = _col(w), _col(x)
    if p == 2:
        return dot(w, x)
    return _same_size(w, x, total(F.zip_with(w, x, lambda a, b: F.signum(a) * F.pow(F.abs(a), F.lit(float(p - 1))) * b)))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return _same_size(a, b, total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(normalize(a), normalize(b))


def scores(weights: np.ndarray, x: Column | str, p: float = 2.0) -> Column:
    """The score of every row of a small weight matrix; for wide layers use the Arrow kernel in `operators.encoders`."""
    x = _col(x)
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in effective_weights(weights, p)))
    return F.transform(rows, lambda w: dot(w, x))


def is_finite(v: Column | str) -> Column:
    v = _col(v)
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


# ---- NumPy


def effective_weights(w: np.ndarray, p: float) -> np.ndarray:
    return w if p == 2 else np.sign(w) * np.abs(w) ** (p - 1)


def np_p_norm(x: np.ndarray, p: float = 2.0) -> np.ndarray:
    if p == 1:
        return np.abs(x).sum(-1)
    if p == 2:
        return np.sqrt((x * x).sum(-1))
    return (np.abs(x) ** p).sum(-1) ** (1 / p)


def np_normalize(x: np.ndarray, p: float = 2.0) -> np.ndarray:
    norm = np_p_norm(x, p)[..., None]
    return np.where(norm > 0, x / np.where(norm > 0, norm, 1.0), x)


def np_scores(w: np.ndarray, x: np.ndarray, p: float = 2.0) -> np.ndarray:
    """One matrix product for the whole batch: rows of x against rows of w."""
    return x @ effective_weights(w, p).T


def weight_matrix(rows) -> np.ndarray:
    """A matrix from nested rows; ragged ones are rejected."""
    rows = [np.asarray(r, dtype=np.float64) for r in rows]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows of different length")
    return np.stack(rows) if rows else np.zeros((0, 0))
