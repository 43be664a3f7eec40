"""Online winner-take-all training. Every step reads the weights the step before wrote, so the exact fold is one task; rows
go to it sorted by idx, streamed in Arrow batches, and are never collected by the driver. `train_averaged` is the distributed
alternative: partitions train apart and their weights are averaged after every epoch - a different, approximate result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from .encoders import Encoder, HebbianConfig, SignConfig, build_encoder, matrix_of

#: The most vectors one exact training may hold in its task; beyond, sample or use train_averaged.
MAX_TRAINING_ROWS = 2_000_000


def inner_config(encoder: Encoder) -> HebbianConfig:
    if isinstance(encoder.config, SignConfig):
        return encoder.config.inner()
    if isinstance(encoder.config, HebbianConfig):
        return encoder.config
    raise ValueError("random projections are not trained")


def _update(w: np.ndarray, row: int, x: np.ndarray, score: float, rate: float, gain: float, c: HebbianConfig) -> None:
    w[row] += rate * gain * (x - score * w[row])
    if c.renormalize_weights:
        w[row] = vec.np_normalize(w[row], c.p)


def step(w: np.ndarray, x: np.ndarray, c: HebbianConfig, rate: float) -> None:
    """One presentation, in place: the best unit moves to x; with delta, the unit of rank anti_winner_rank moves away, by the
    scores before the step, unless it is the best itself. Equal scores rank by the smaller unit."""
    s = vec.np_scores(w, x[None, :], c.p)[0]
    if c.delta == 0:
        best = int(np.argmax(s))
        _update(w, best, x, s[best], rate, 1.0, c)
        return
    order = np.argsort(-s, kind="stable")
    best, other = int(order[0]), int(order[c.anti_winner_rank - 1])
    _update(w, best, x, s[best], rate, 1.0, c)
    if other != best:
        _update(w, other, x, s[other], rate, -c.delta, c)


def fold(encoder: Encoder, x: np.ndarray, epochs: int, shuffle: bool = True, learning_rate: float | None = None, seed_offset: int | None = None, cumulative: bool = False) -> Encoder:
    """`epochs` passes over the rows. Shuffled orders come from seed + offset + epoch (offset: the steps so far), or, cumulative,
    from one stream that shuffles the order of the epoch before again."""
    c = inner_config(encoder)
    if epochs < 0:
        raise ValueError("epochs must not be negative")
    if not len(x) or not epochs:
        return encoder
    if x.shape[1] != c.input_dim:
        raise ValueError(f"vectors have {x.shape[1]} entries, expected {c.input_dim}")
    x, w = encoder.prepare(x), encoder.weights.copy()
    rate = c.learning_rate if learning_rate is None else learning_rate
    offset = encoder.steps if seed_offset is None else seed_offset
    stream, order = np.random.default_rng([c.seed, 1]), np.arange(len(x))
    for epoch in range(epochs):
        if shuffle:
            order = stream.permutation(order) if cumulative else np.random.default_rng(c.seed + offset + epoch).permutation(len(x))
        for i in order:
            step(w, x[i], c, rate)
    return encoder.with_weights(w, encoder.steps + epochs * len(x))


def _fold_in_one_task(df: DataFrame, encoder: Encoder, vec_col: str, order: str, **how) -> Encoder:
    n = df.count()
    if n > MAX_TRAINING_ROWS:
        raise ValueError(f"{n} rows for one training task; the limit is {MAX_TRAINING_ROWS}")
    if n == 0:
        return encoder
    shared = df.sparkSession.sparkContext.broadcast(encoder)
    dim = encoder.config.input_dim
    rows = df.select(F.col(order).alias("o"), F.col(vec_col).cast("array<double>").alias("v")).repartition(1).sortWithinPartitions("o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [matrix_of(b.column(1), dim) for b in batches if b.num_rows]
        e = fold(shared.value, np.concatenate(parts) if parts else np.zeros((0, dim)), **how)
        ends = np.arange(0, e.weights.size + 1, dim, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(e.weights), dtype=np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(e.weights.ravel())), pa.array(np.full(len(e.weights), e.steps))], names=["mu", "w", "steps"])

    # the weights are m x d doubles, whatever the number of rows
    table = rows.mapInArrow(run, "mu int, w array<double>, steps long").toArrow().sort_by("mu")
    return encoder.with_weights(np.array(table.column("w").to_pylist(), dtype=np.float64).reshape(encoder.weights.shape), table.column("steps")[0].as_py())


def train(df: DataFrame, config, vec_col: str = "vec", order: str = "idx", shuffle: bool = True) -> Encoder:
    """A new encoder, trained for config.epochs over the rows in the order of `order`."""
    start = build_encoder(config)
    if config.method == "projection" or config.epochs == 0:
        return start
    return _fold_in_one_task(df, start, vec_col, order, epochs=config.epochs, shuffle=shuffle, cumulative=True)


def train_more(df: DataFrame, encoder: Encoder, epochs: int = 1, vec_col: str = "vec", order: str = "idx", shuffle: bool = True, learning_rate: float | None = None, seed_offset: int | None = None) -> Encoder:
    """Mini-batch training of an encoder that exists, restored ones included; goes on counting steps."""
    inner_config(encoder)
    return _fold_in_one_task(df, encoder, vec_col, order, epochs=epochs, shuffle=shuffle, learning_rate=learning_rate, seed_offset=seed_offset)


def train_averaged(df: DataFrame, config, partitions: int, vec_col: str = "vec", order: str = "idx") -> Encoder:
    """Approximate: every partition trains on its rows, then the weights are averaged by rows; once per epoch. What reaches
    the driver is partitions x m x d doubles, summed by executors in between."""
    encoder = build_encoder(config)
    c = inner_config(encoder)
    dim = c.input_dim
    rows = df.select(F.col(order).cast("long").alias("o"), F.col(vec_col).cast("array<double>").alias("v")).withColumn("part", F.pmod(F.xxhash64("o"), F.lit(partitions)).cast("int"))
    for epoch in range(c.epochs):
        shared = df.sparkSession.sparkContext.broadcast(encoder)

        def run(table: pa.Table) -> pa.Table:
            x = matrix_of(table.sort_by("o").column("v").combine_chunks(), dim)
            e = fold(shared.value, x, 1, seed_offset=epoch)  # noqa: B023
            flat = (e.weights * len(x)).ravel()
            return pa.table({"mu": pa.array(np.repeat(np.arange(len(e.weights)), dim).astype(np.int32)), "i": pa.array(np.tile(np.arange(dim), len(e.weights)).astype(np.int32)), "w": pa.array(flat), "n": pa.array(np.full(flat.size, len(x)))})

        got = rows.groupBy("part").applyInArrow(run, "mu int, i int, w double, n long").groupBy("mu", "i").agg((F.sum("w") / F.sum("n")).alias("w"), F.sum("n").alias("n")).toArrow().sort_by([("mu", "ascending"), ("i", "ascending")])
        if not got.num_rows:
            return encoder
        w = got.column("w").to_numpy().reshape(encoder.weights.shape)
        if c.renormalize_weights:
            w = vec.np_normalize(w, c.p)
        encoder = encoder.with_weights(w, encoder.steps + got.column("n")[0].as_py())
    return encoder


def weights_frame(spark, encoder: Encoder) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(encoder.weights)], "mu int, w array<double>")
