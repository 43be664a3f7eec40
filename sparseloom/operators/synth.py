"""Generated data. Every row draws from its own stream, seeded by (seed, stream, row), so any partitioning gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VEC = "idx long, vec array<double>, label int"


def _generate(spark: SparkSession, n: int, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([make(int(i)) for i in pdf["id"]], columns=[c.split()[0] for c in schema.split(", ")])

    return spark.range(n).mapInPandas(run, schema)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x)


def two_class_blobs(spark: SparkSession, dim: int, per_class: int, seed: int = 42) -> DataFrame:
    """Gaussian vectors; class 0 has 2 added to the first half of its entries, class 1 to the second."""

    def make(i: int):
        label = i // per_class
        x = np.random.default_rng([seed, 0, i]).standard_normal(dim)
        half = slice(0, dim // 2) if label == 0 else slice(dim // 2, dim)
        x[half] += 2
        return i, x.tolist(), label

    return _generate(spark, 2 * per_class, _VEC, make)


def random_unit_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    return _generate(spark, n, "idx long, vec array<double>", lambda i: (i, _unit(np.random.default_rng([seed, 1, i]).standard_normal(dim)).tolist()))


@dataclass(frozen=True)
class TextRetrievalConfig:
    corpus_size: int = 1000
    query_count: int = 100
    dim: int = 64
    topics: int = 10
    clusters_per_topic: int = 3
    noise: float = 0.1
    hard_negative_rate: float = 0.0
    seed: int = 42

    def __post_init__(self):
        if min(self.corpus_size, self.query_count, self.dim, self.topics, self.clusters_per_topic) <= 0 or self.noise < 0 or not 0 <= self.hard_negative_rate <= 1:
            raise ValueError(f"not a valid configuration: {self}")


def text_retrieval(spark: SparkSession, c: TextRetrievalConfig) -> DataFrame:
    """idx, vec, label (topic), role: passages around clusters around topics, some pulled towards another topic by half the
    noise; queries are passages with 1.5 times the noise. All of unit length."""
    rng = np.random.default_rng([c.seed, 2])
    topics = np.stack([_unit(v) for v in rng.standard_normal((c.topics, c.dim))])
    offsets = 0.2 * rng.standard_normal((c.topics, c.clusters_per_topic, c.dim))

    def passage(i: int) -> tuple[np.ndarray, int]:
        r = np.random.default_rng([c.seed, 3, i])
        topic = i % c.topics
        x = topics[topic] + offsets[topic, r.integers(c.clusters_per_topic)]
        if c.topics > 1 and r.random() < c.hard_negative_rate:
            other = (topic + 1 + r.integers(c.topics - 1)) % c.topics
            x = x + c.noise / 2 * (topics[other] - x)
        return _unit(x + c.noise * r.standard_normal(c.dim)), topic

    def make(i: int):
        if i < c.corpus_size:
            x, topic = passage(i)
            return i, x.tolist(), topic, "db"
        r = np.random.default_rng([c.seed, 4, i])
        x, topic = passage(int(r.integers(c.corpus_size)))
        return i - c.corpus_size, _unit(x + 1.5 * c.noise * r.standard_normal(c.dim)).tolist(), topic, "query"

    return _generate(spark, c.corpus_size + c.query_count, _VEC + ", role string", make)


def random_codes(spark: SparkSession, n: int, m: int, k: int, seed: int = 42) -> DataFrame:
    return _generate(spark, n, "idx long, code array<int>", lambda i: (i, np.sort(np.random.default_rng([seed, 5, i]).choice(m, k, replace=False)).tolist()))


def labelled_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isNotNull())
