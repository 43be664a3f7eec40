"""A coarse partition of unit vectors into lists, every row assigned to one.

Centres are fitted by spherical k-means on a bounded sample. Where more lists are wanted than there are centres, a second set of
centres divides every list by what its vectors leave over (their residual); it is shared by all lists, so the number of
lists goes with the table while what is broadcast stays bounded. Long lists are cut into blocks, after their rows were counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_matrix, unit

#: The rows the centres are fitted on and the most centres of either level: these bound what is collected (16,384 vectors) and
#: broadcast (2 x 2,048 centres; lists: 4 million). Rows per list aimed at, and the most rows of a list that a task takes.
SAMPLE_ROWS, MOST_CENTRES, ROWS_PER_LIST, BLOCK = 16_384, 2_048, 384, 8_192
#: First-level centres whose lists a query may probe.
FIRST_PROBES = 32
#: Entries of a score matrix held at once.
SCORES_AT_ONCE = 4_000_000


@dataclass(frozen=True)
class Lists:
    centres: np.ndarray  # centres x dim, unit rows
    residuals: np.ndarray | None = None  # second-level centres x dim

    @property
    def count(self) -> int:
        return len(self.centres) * (1 if self.residuals is None else len(self.residuals))

    def nearest(self, u: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest lists of every row, nearest first."""
        n = min(n, self.count)
        wide = len(self.centres) + (0 if self.residuals is None else len(self.residuals) * self._first(n))
        step = max(1, SCORES_AT_ONCE // wide)
        parts = [self._nearest(u[low : low + step], n) for low in range(0, len(u), step)]
        return np.concatenate(parts) if parts else np.zeros((0, n), np.int64)

    def _first(self, n: int) -> int:
        """Centres of the first level whose lists are compared for n of them: all needed to have n, and some more."""
        return 1 if n == 1 else min(len(self.centres), max(FIRST_PROBES, -(-2 * n // len(self.residuals))))

    def _nearest(self, u: np.ndarray, n: int) -> np.ndarray:
        score = u @ self.centres.T
        if self.residuals is None:
            return best_columns(score, n)
        first = best_columns(score, self._first(n))
        # squared distance to first + second centre, without the row's own square
        r = self.residuals
        left = 1 - 2 * np.take_along_axis(score, first, 1)
        cross = self.centres @ r.T
        apart = left[:, :, None] - 2 * (u @ r.T)[:, None, :] + 2 * cross[first] + (r**2).sum(1)[None, None, :]
        at = best_columns(-apart.reshape(len(u), -1), n)
        return np.take_along_axis(first, at // len(r), 1) * len(r) + at % len(r)


def best_columns(score: np.ndarray, n: int) -> np.ndarray:
    """The columns of the n greatest scores of every row, greatest first."""
    if n == 1:
        return np.argmax(score, axis=1)[:, None]
    part = np.argpartition(-score, n - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(score, part, 1), axis=1, kind="stable"), 1)


@dataclass(frozen=True)
class Blocks:
    """How many blocks each list has: one, unless it is named."""

    lists: np.ndarray  # in order
    blocks: np.ndarray

    def of(self, at: np.ndarray) -> np.ndarray:
        if not len(self.lists):
            return np.ones(len(at), np.int64)
        found = np.minimum(np.searchsorted(self.lists, at), len(self.lists) - 1)
        return np.where(self.lists[found] == at, self.blocks[found], 1)


ONE_BLOCK = Blocks(np.zeros(0, np.int64), np.zeros(0, np.int64))


def block_of(idx: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """A block number below `blocks` for every id, the same for the same id."""
    h = idx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % blocks.astype(np.uint64)).astype(np.int32)


def repeated(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of the copy) for rows that are each wanted so many times."""
    row = np.repeat(np.arange(len(times)), times)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)


def count_blocks(rows: DataFrame, count: int, lists: Lists, probes: int, dim: int, block: int | None = None) -> Blocks:
    """Blocks of the lists in which `rows` (idx, vec) have more than `block` rows, each row in its `probes` nearest lists. Counted
    over all rows, in each task first; the driver gets the long lists, of which there are no more than rows / block. `count`: no
    fewer than there are rows; a table within a block needs no counting."""
    block = BLOCK if block is None else block
    if count <= block:
        return ONE_BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for batch in batches:
            if batch.num_rows:
                at, n = np.unique(lists.nearest(unit(list_matrix(batch.column(0), dim)), probes), return_counts=True)
                for a, b in zip(at.tolist(), n.tolist()):
                    held[a] = held.get(a, 0) + b
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["list", "n"])

    long = rows.select("vec").mapInArrow(count, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).filter(F.col("n") > block).orderBy("list").toArrow()
    return Blocks(long.column("list").to_numpy(), -(-long.column("n").to_numpy() // block))


def _spherical(x: np.ndarray, k: int, turns: int, rng: np.random.Generator, unit_length: bool) -> np.ndarray:
    # distinct rows first, so that a mass of copies does not take most seeds
    first = np.unique(np.round(x, 3), axis=0, return_index=True)[1]
    c = x[rng.permutation(np.sort(first))[:k]]
    for _ in range(turns):
        near = np.concatenate([np.argmin((c**2).sum(1) - 2 * x[low : low + 4096] @ c.T, axis=1) for low in range(0, len(x), 4096)])
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))[:, None]
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True) if unit_length else n.astype(c.dtype)
        c = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), c)
    return c


def fit(rows: DataFrame, dim: int, seed: int = 5, sample_rows: int = SAMPLE_ROWS, rows_per_list: int = ROWS_PER_LIST, turns: int = 6, count: int | None = None, most: int | None = None) -> Lists:
    """Centres for `rows` (idx long, vec array<double>, usable). Only this fit reads a sample; the rows in it are chosen by a
    hash of idx, so the same table gives the same centres. `count`: about how many rows there are, where that is known without reading them."""
    if count is None:
        count = rows.count()
    most = MOST_CENTRES if most is None else most
    wanted = max(1, math.ceil(count / rows_per_list))
    share = min(1.0, sample_rows / max(count, 1))
    sample = rows if share == 1 else rows.filter(F.pmod(F.xxhash64("idx", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    table = sample.select("idx", "vec").limit(int(sample_rows * 1.2)).toArrow().sort_by("idx")
    if not table.num_rows:
        return Lists(np.eye(1, dim))
    x = unit(list_matrix(table.column(1), dim)).astype(np.float32)
    rng = np.random.default_rng(seed)
    c = _spherical(x, min(wanted, most, len(x)), turns, rng, True)
    lists = Lists(c.astype(np.float64))
    second = min(most, -(-wanted // len(c)))
    if second == 1:
        return lists
    r = _spherical(x - c[lists.nearest(x)[:, 0]], second, turns, rng, False)
    return Lists(lists.centres, r.astype(np.float64))
