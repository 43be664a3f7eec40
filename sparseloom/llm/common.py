"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint

DIM = 64
#: Rows of a few numbers that may be broadcast.
SMALL = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """`df`, written down and marked for broadcast if it has no more than `most` rows; else as it is, for a join by shuffle."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= most else df


def at_once(spark: SparkSession, *parts: Callable[[], DataFrame]) -> list[DataFrame]:
    """What the parts give, each made in a thread of its own: parts that run jobs while they are made, many of them too small for all
    cores, share the cluster instead of waiting for each other."""
    with ThreadPoolExecutor(len(parts)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(p)) for p in parts]]


def usable_vector(vec: str | Column, dim: int = DIM) -> Column:
    """Not null, `dim` entries, all finite, not all zero (a zero vector has no direction)."""
    v = F.col(vec) if isinstance(vec, str) else vec
    # array_contains gives false only where there is neither the value nor a null; no lambdas, so it stays in generated code
    whole = ~F.array_contains(v.cast("array<double>"), F.lit(float("nan")))
    most, least, infinite = F.array_max(v), F.array_min(v), F.lit(float("inf"))
    return F.coalesce((F.size(v) == dim) & whole & (most < infinite) & (least > -infinite) & ((most > 0) | (least < 0)), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, dtype=np.float64)
    # scaled first, so that squares of very large or very small entries stay in range
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-300)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def stack(series) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in series]) if len(series) else np.empty((0, DIM))


def list_matrix(column, dim: int = DIM) -> np.ndarray:
    """An Arrow list column without nulls as a matrix, without going through Python objects."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def list_array(rows: np.ndarray):
    """A matrix as an Arrow list column."""
    import pyarrow as pa

    n, d = rows.shape
    kind = pa.float32() if rows.dtype == np.float32 else pa.float64()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)), pa.array(rows.ravel(), kind))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))
