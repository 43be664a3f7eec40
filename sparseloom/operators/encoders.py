"""Encoders: dense vectors to sparse codes, batch by batch in Arrow with one matrix product each, or as native columns.

Three methods: "hebbian" (learned weights, k strongest units), "projection" (sparse random weights, k strongest units) and
"sign" (k learned units, those with a positive score). An encoder is a frozen value; encoding shares no state between rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace
from typing import ClassVar, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import topk, vec

METHODS = ("hebbian", "projection", "sign")


def parse_method(name: str) -> str:
    low = name.strip().lower()
    if low not in METHODS:
        raise ValueError(f"unknown method {name!r}; expected one of {', '.join(METHODS)}")
    return low


@dataclass(frozen=True)
class HebbianConfig:
    """Winner-take-all learning. m units over input_dim entries, k of them active."""

    input_dim: int
    m: int
    k: int
    p: float = 2.0
    learning_rate: float = 0.01
    epochs: int = 5
    anti_winner_rank: int = 2
    delta: float = 0.0
    seed: int = 42
    normalize_inputs: bool = False
    renormalize_weights: bool = True
    method: ClassVar[str] = "hebbian"

    def __post_init__(self):
        if self.input_dim <= 0 or not 0 < self.k <= self.m or not 1 <= self.anti_winner_rank <= self.m or self.p < 1 or self.epochs < 0:
            raise ValueError(f"not a valid configuration: {self}")

    @property
    def activity(self) -> float:
        return self.k / self.m

    @classmethod
    def with_activity(cls, input_dim: int, k: int, activity: float, **more) -> HebbianConfig:
        return cls(input_dim, math.ceil(k / activity), k, **more)

    @classmethod
    def paper(cls, input_dim: int, m: int, k: int, **more) -> HebbianConfig:
        return cls(input_dim, m, k, **more)

    @classmethod
    def mnist(cls, k: int = 2, **more) -> HebbianConfig:
        return cls(784, int(k / 0.05), k, **more)

    @classmethod
    def cifar(cls, input_dim: int = 4096, k: int = 2, **more) -> HebbianConfig:
        return cls(input_dim, int(k / 0.005), k, **more)


@dataclass(frozen=True)
class ProjectionConfig:
    input_dim: int
    m: int
    k: int
    sampling_rate: float = 0.1
    seed: int = 42
    normalize_inputs: bool = False
    method: ClassVar[str] = "projection"

    def __post_init__(self):
        if self.input_dim <= 0 or not 0 < self.k <= self.m or not 0 < self.sampling_rate <= 1:
            raise ValueError(f"not a valid configuration: {self}")

    @property
    def activity(self) -> float:
        return self.k / self.m

    @classmethod
    def paper_baseline(cls, input_dim: int, k: int, **more) -> ProjectionConfig:
        return cls(input_dim, 10 * input_dim, k, **({"sampling_rate": 0.1} | more))


@dataclass(frozen=True)
class SignConfig:
    """k units, trained like the hebbian ones; every unit with a positive score is active."""

    input_dim: int
    k: int
    p: float = 2.0
    learning_rate: float = 0.01
    epochs: int = 5
    anti_winner_rank: int = 2
    delta: float = 0.0
    seed: int = 42
    normalize_inputs: bool = False
    renormalize_weights: bool = True
    method: ClassVar[str] = "sign"

    def __post_init__(self):
        self.inner()

    @property
    def m(self) -> int:
        return self.k

    @property
    def activity(self) -> float:
        return 1.0

    def inner(self) -> HebbianConfig:
        return HebbianConfig(self.input_dim, self.k, self.k, self.p, self.learning_rate, self.epochs, min(self.anti_winner_rank, self.k), self.delta, self.seed, self.normalize_inputs, self.renormalize_weights)


Config = HebbianConfig | ProjectionConfig | SignConfig
_CONFIGS = {c.method: c for c in (HebbianConfig, ProjectionConfig, SignConfig)}


def config_to_json(config: Config) -> str:
    return json.dumps({"method": config.method} | asdict(config), sort_keys=True)


def config_from_json(text: str) -> Config:
    fields = json.loads(text)
    return _CONFIGS[fields.pop("method")](**fields)


class Encodes(Protocol):
    def encode_batch(self, x: np.ndarray) -> list[np.ndarray]: ...


@dataclass(frozen=True)
class Encoder:
    config: Config
    weights: np.ndarray
    steps: int = 0

    def __post_init__(self):
        if self.weights.shape != (self.config.m, self.config.input_dim):
            raise ValueError(f"weights are {self.weights.shape}, expected {(self.config.m, self.config.input_dim)}")

    @property
    def p(self) -> float:
        return getattr(self.config, "p", 2.0)

    def prepare(self, x: np.ndarray) -> np.ndarray:
        """Inputs are brought to unit length in the 2-norm, whatever p is."""
        return vec.np_normalize(x) if self.config.normalize_inputs else x

    def scores(self, x: np.ndarray) -> np.ndarray:
        if x.shape[-1] != self.config.input_dim:
            raise ValueError(f"vectors have {x.shape[-1]} entries, expected {self.config.input_dim}")
        return vec.np_scores(self.weights, self.prepare(x), self.p)

    def encode_batch(self, x: np.ndarray) -> list[np.ndarray]:
        s = self.scores(x)
        if self.config.method == "sign":
            return [np.flatnonzero(row > 0) for row in s]
        return list(topk.np_top_k_indices(s, self.config.k))

    def with_weights(self, weights: np.ndarray, steps: int) -> Encoder:
        return replace(self, weights=weights, steps=steps)


def initial_weights(config: Config) -> np.ndarray:
    """Gaussian rows of unit p-norm; for "projection" each row has max(1, int(d * rate)) inputs. NumPy's PCG64, by the seed."""
    rng = np.random.default_rng(config.seed)
    if config.method != "projection":
        return vec.np_normalize(rng.standard_normal((config.m, config.input_dim)), getattr(config, "p", 2.0))
    size = max(1, int(config.input_dim * config.sampling_rate))
    out = np.zeros((config.m, config.input_dim))
    for row in out:
        row[np.sort(rng.choice(config.input_dim, size, replace=False))] = rng.standard_normal(size)
    return vec.np_normalize(out)


def sparse_rows(weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(input indices, weights) of the non-zero entries of each row."""
    return [(at, row[at]) for row in weights for at in (np.flatnonzero(row),)]


def build_encoder(config: Config) -> Encoder:
    return Encoder(config, initial_weights(config))


def restore_encoder(config: Config, weights: np.ndarray, steps: int = 0) -> Encoder:
    return Encoder(config, np.array(weights, dtype=np.float64), steps)


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    if column.null_count:
        raise ValueError("a vector is null")
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths != dim).any():
        raise ValueError(f"a vector has not {dim} entries")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if not np.isfinite(x).all():
        raise ValueError("a vector has an entry that is not finite")
    return x


def encode(df: DataFrame, encoder: Encoder, vec_col: str = "vec", code_col: str = "code", keep: tuple[str, ...] = ("idx",), engine: str = "numpy") -> DataFrame:
    """`keep` and the code of every row; no shuffle.

    engine "numpy": one matrix product per Arrow batch with the broadcast weights (m x d doubles, fixed by the configuration).
    engine "hof": native columns, for small layers. Null, wrongly long or non-finite vectors raise.
    """
    if engine == "hof":
        return df.select(*keep, encode_column(F.col(vec_col), encoder).alias(code_col))
    if engine != "numpy":
        raise ValueError(f"unknown engine {engine!r}; expected numpy or hof")
    shared = df.sparkSession.sparkContext.broadcast(encoder)
    rows = df.select(*keep, F.col(vec_col).cast("array<double>").alias("__vec"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = shared.value
        for batch in batches:
            x = matrix_of(batch.column(batch.num_columns - 1), e.config.input_dim)
            found = e.encode_batch(x) if len(x) else []
            ends = np.r_[0, np.cumsum([len(c) for c in found])].astype(np.int32)
            flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            codes = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], codes], names=[*keep, code_col])

    return rows.mapInArrow(run, f"{schema}, `{code_col}` array<int>")


def encode_column(v: Column | str, encoder: Encoder) -> Column:
    x = vec.as_double(v)
    if encoder.config.normalize_inputs:
        x = vec.normalize(x)
    s = vec.scores(encoder.weights, x, encoder.p)
    return topk.positive_indices(s) if encoder.config.method == "sign" else topk.top_k_indices(s, encoder.config.k)


def score_rows(df: DataFrame, encoder: Encoder, vec_col: str = "vec", keep: tuple[str, ...] = ("idx",)) -> DataFrame:
    """`keep` and scores array<double>, by the same kernel as `encode`."""
    shared = df.sparkSession.sparkContext.broadcast(encoder)
    rows = df.select(*keep, F.col(vec_col).cast("array<double>").alias("__vec"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches):
        e = shared.value
        for batch in batches:
            s = e.scores(matrix_of(batch.column(batch.num_columns - 1), e.config.input_dim))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, s.shape[1], dtype=np.int32)), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*keep, "scores"])

    return rows.mapInArrow(run, f"{schema}, scores array<double>")
