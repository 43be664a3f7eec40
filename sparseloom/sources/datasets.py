"""Named datasets: image sets with labels, ANN collections with ground truth."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import is_file
from .records import read_records

#: Files of the ANN collections: (directory, kind and name of base, of queries, of ground truth).
ANN = {
    "sift1m": ("", ("bvecs", "sift_base.bvecs"), ("bvecs", "sift_query.bvecs"), ("ivecs", "sift_groundtruth.ivecs")),
    "sift10k": ("siftsmall", ("fvecs", "siftsmall_base.fvecs"), ("fvecs", "siftsmall_query.fvecs"), ("ivecs", "siftsmall_groundtruth.ivecs")),
    "gist1m": ("", ("fvecs", "gist_base.fvecs"), ("fvecs", "gist_query.fvecs"), ("ivecs", "gist_groundtruth.ivecs")),
}
#: Fixed values: (images, labels) of the two image sets in IDX files.
IDX_FILES = (("train-images-idx3-ubyte", "train-labels-idx1-ubyte"), ("t10k-images-idx3-ubyte", "t10k-labels-idx1-ubyte"))
CIFAR_FILES = ("data_batch_1.bin", "data_batch_2.bin", "data_batch_3.bin", "data_batch_4.bin", "data_batch_5.bin", "test_batch.bin")


@dataclass(frozen=True)
class AnnDataset:
    name: str
    database: DataFrame
    queries: DataFrame
    truth: DataFrame  # qidx, nn


def _find(directory: str, name: str) -> str | None:
    for candidate in (name, name + ".gz"):
        path = os.path.join(directory, candidate)
        if is_file(path):
            return path
    return None


def ann_available(root: str, name: str) -> bool:
    d, base, _, _ = ANN[name.lower()]
    return _find(os.path.join(root, d), base[1]) is not None


def read_ann(spark: SparkSession, root: str, name: str, max_db: int | None = None, max_queries: int | None = None, files: dict[str, str] | None = None) -> AnnDataset:
    """sift1m, sift10k or gist1m, in either case. `files` may name base, query and truth files of another layout."""
    key = name.lower()
    if key not in ANN:
        raise ValueError(f"unknown collection {name!r}; expected one of {', '.join(ANN)}")
    d, base, query, truth = ANN[key]
    at = lambda part, spec: (files or {}).get(part) or _need(os.path.join(root, d), spec[1])
    db = read_records(spark, at("base", base), base[0], max_db)
    q = read_records(spark, at("query", query), query[0], max_queries)
    t = read_records(spark, at("truth", truth), truth[0], max_queries).withColumnRenamed("idx", "qidx")
    return AnnDataset(key, db, q, t)


def labelled(images: DataFrame, labels: DataFrame) -> DataFrame:
    """idx, vec, label; the counts must agree."""
    a, b = images.count(), labels.count()
    if a != b:
        raise ValueError(f"{a} images, {b} labels")
    return images.join(labels, "idx")


def idx_available(directory: str) -> bool:
    return all(_find(directory, f) for pair in IDX_FILES for f in pair)


def read_idx_dataset(spark: SparkSession, directory: str) -> DataFrame:
    """Training images, then test images; plain or gzipped. Also for the fashion set, which has the same files."""
    out, offset = None, 0
    for images, labels in IDX_FILES:
        pair = labelled(read_records(spark, _need(directory, images), "idx_images"), read_records(spark, _need(directory, labels), "idx_labels"))
        pair = pair.withColumn("idx", F.col("idx") + offset)
        offset += read_records(spark, _need(directory, labels), "idx_labels").count()
        out = pair if out is None else out.unionByName(pair)
    return out


read_mnist = read_fashion_mnist = read_idx_dataset


def _need(directory: str, name: str) -> str:
    path = _find(directory, name)
    if path is None:
        raise FileNotFoundError(os.path.join(directory, name))
    return path


def cifar_available(directory: str) -> bool:
    return all(_find(directory, f) for f in CIFAR_FILES)


def read_cifar10(spark: SparkSession, directory: str) -> DataFrame:
    out = None
    for i, name in enumerate(CIFAR_FILES):
        part = read_records(spark, _need(directory, name), "cifar10").withColumn("idx", F.col("idx") + i * 10_000)
        out = part if out is None else out.unionByName(part)
    return out


def read_fc7_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header row, doubles, and an int label in the last column."""
    from .text import read_lines

    lines = read_lines(spark, path).filter("idx > 0 and trim(line) != ''")
    cells = F.split("line", ",")
    return lines.select((F.col("idx") - 1).alias("idx"), F.transform(F.slice(cells, 1, F.size(cells) - 1), lambda x: F.trim(x).cast("double")).alias("vec"), F.trim(F.element_at(cells, -1)).cast("int").alias("label"))


def read_fc7_binary(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, "fc7")
