"""Class-balanced splits, reproducible on any engine: rows are ordered within their class by an integer mix of idx and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries per class of the published protocols.
QUERIES_PER_CLASS = {"mnist": 100, "fashion": 100, "cifar": 1000}


def mixed(idx: Column | str, seed: int) -> Column:
    """A well spread order of ids in 64-bit arithmetic that does not overflow for ids and seeds below 2^31."""
    x = (F.col(idx) if isinstance(idx, str) else idx).cast("long")
    a = (x * 48_271 + seed * 2_147 + 11) % 2_147_483_647
    return (a * 69_621 + x) % 2_147_483_647


def split_by_class(df: DataFrame, per_class: int, seed: int = 42, label: str = "label", idx: str = "idx") -> DataFrame:
    """All rows with `role`: the first min(per_class, size) of each class in the mixed order are "query", the others "db",
    which is also the training set. Rows with a null or negative label stay out."""
    place = Window.partitionBy(label).orderBy(mixed(idx, seed), F.col(idx))
    ranked = df.filter(F.col(label) >= 0).withColumn("__r", F.row_number().over(place))
    return ranked.withColumn("role", F.when(F.col("__r") <= per_class, "query").otherwise("db")).drop("__r")


def paper_split(df: DataFrame, dataset: str, seed: int = 42) -> DataFrame:
    return split_by_class(df, QUERIES_PER_CLASS[dataset.lower()], seed)
