"""Top k by score: equal scores go to the smaller index. Indices are 0-based, ranks 1-based."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import _col


def _ranked(scores: Column) -> Column:
    # ascending by (-score, index) puts NaN last
    return F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.cast("int").alias("i"))))


def _checked(scores: Column, k: int, value: Column) -> Column:
    if k < 0:
        raise ValueError("k must not be negative")
    return F.when(F.size(scores) >= k, value).otherwise(F.raise_error(F.lit("k is larger than the number of scores")).cast("array<int>"))


def rank_indices(scores: Column | str) -> Column:
    """All indices, best first."""
    return F.transform(_ranked(_col(scores)), lambda x: x["i"])


def top_ranked(scores: Column | str, r: int) -> Column:
    """The r best indices, best first."""
    s = _col(scores)
    return _checked(s, r, F.slice(rank_indices(s), 1, r))


def top_k_indices(scores: Column | str, k: int) -> Column:
    """The k best indices in ascending order: the active units of a code."""
    return F.array_sort(top_ranked(scores, k))


def positive_indices(scores: Column | str) -> Column:
    """Indices of the scores above 0, ascending; there may be none."""
    s = _col(scores)
    return F.filter(F.transform(s, lambda x, i: F.when(x > 0, i.cast("int")).otherwise(F.lit(-1))), lambda i: i >= 0)


def np_rank_indices(scores: np.ndarray) -> np.ndarray:
    return np.argsort(-scores, axis=-1, kind="stable")


def np_top_ranked(scores: np.ndarray, r: int) -> np.ndarray:
    if not 0 <= r <= scores.shape[-1]:
        raise ValueError("r is out of range")
    return np_rank_indices(scores)[..., :r]


def np_top_k_indices(scores: np.ndarray, k: int) -> np.ndarray:
    n = scores.shape[-1]
    if not 0 <= k <= n:
        raise ValueError("k is out of range")
    if k == 0 or k == n:
        return np.broadcast_to(np.arange(k), (*scores.shape[:-1], k)).copy()
    # the k-th largest value; all above it are in, of those equal to it the first ones
    kth = np.partition(scores, n - k, axis=-1)[..., n - k, None]
    above, equal = scores > kth, scores == kth
    room = k - above.sum(-1, keepdims=True)
    taken = above | (equal & (np.cumsum(equal, -1) <= room))
    return np.nonzero(taken.reshape(-1, n))[1].reshape(*scores.shape[:-1], k)
