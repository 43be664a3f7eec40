"""Binary files of fixed-size records as a splittable Spark data source.

    register(spark); spark.read.format("fixed_records").option("kind", "fvecs").load(path)

Kinds: fvecs, bvecs, ivecs (a little-endian int32 dimension before every record), idx_images, idx_labels (big-endian header,
bytes), cifar10 (label byte and 3,072 pixel bytes) and fc7 (big-endian doubles, labels at the end of the file). Every record has
a fixed place, so a file is cut into ranges that tasks read on their own; gzipped files are one range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import files_of, reading, size_of, writing

RANGE_BYTES = 32 << 20
_PAYLOAD = {"fvecs": "<f4", "bvecs": "u1", "ivecs": "<i4"}
_SCHEMA = {
    "fvecs": "idx long, vec array<double>", "bvecs": "idx long, vec array<double>", "ivecs": "idx long, nn array<int>",
    "idx_images": "idx long, vec array<double>", "idx_labels": "idx long, label int", "cifar10": "idx long, vec array<double>, label int",
    "fc7": "idx long, vec array<double>, label int",
}
IMAGE_MAGIC, LABEL_MAGIC = 2051, 2049
CIFAR_PIXELS, CIFAR_RECORDS = 3072, 10_000


@dataclass
class Range(InputPartition):
    path: str
    kind: str
    header: int
    stride: int
    dim: int
    first: int
    count: int
    records: int  # of the whole file
    base: int  # idx of the file's first record


def layout(path: str, kind: str) -> tuple[int, int, int, int]:
    """(header bytes, record bytes, dimension, records) of a file; checks what the file says against its size."""
    size = size_of(path)
    with reading(path) as f:
        if kind in _PAYLOAD:
            head = f.read(4)
            if len(head) < 4:
                return 0, 4, 0, 0
            dim = struct.unpack("<i", head)[0]
            if dim <= 0:
                raise ValueError(f"{path}: dimension {dim}")
            stride = 4 + dim * np.dtype(_PAYLOAD[kind]).itemsize
            whole, rest = divmod(size, stride)
            if rest >= 4:
                raise EOFError(f"{path}: the last record is cut off")
            return 0, stride, dim, whole  # a piece of a dimension at the end is the end
        if kind == "idx_images":
            magic, n, rows, cols = struct.unpack(">iiii", f.read(16))
            if magic != IMAGE_MAGIC:
                raise ValueError(f"{path}: magic {magic}, expected {IMAGE_MAGIC}")
            return 16, rows * cols, rows * cols, n
        if kind == "idx_labels":
            magic, n = struct.unpack(">ii", f.read(8))
            if magic != LABEL_MAGIC:
                raise ValueError(f"{path}: magic {magic}, expected {LABEL_MAGIC}")
            return 8, 1, 1, n
        if kind == "cifar10":
            if size != CIFAR_RECORDS * (1 + CIFAR_PIXELS):
                raise ValueError(f"{path}: {size} bytes, expected {CIFAR_RECORDS * (1 + CIFAR_PIXELS)}")
            return 0, 1 + CIFAR_PIXELS, CIFAR_PIXELS, CIFAR_RECORDS
        if kind == "fc7":
            n, dim = struct.unpack(">ii", f.read(8))
            if size < 8 + n * (8 * dim + 4):
                raise EOFError(f"{path}: shorter than its header says")
            return 8, 8 * dim, dim, n
    raise ValueError(f"unknown kind {kind!r}; expected one of {', '.join(_SCHEMA)}")


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, max(d, 1), dtype=np.int32)[: n + 1]), pa.array(np.ascontiguousarray(rows).ravel(), kind))


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind = options.get("kind", "fvecs").lower()
        if self.kind not in _SCHEMA:
            raise ValueError(f"unknown kind {self.kind!r}; expected one of {', '.join(_SCHEMA)}")
        most = options.get("maxrecords")
        self.most = int(most) if most is not None else None
        self.files = files_of(options["path"])

    def partitions(self) -> list[Range]:
        out, base = [], 0
        for path in self.files:
            header, stride, dim, n = layout(path, self.kind)
            take = n if self.most is None else max(0, min(n, self.most - base))
            step = max(1, take if path.endswith(".gz") else RANGE_BYTES // stride)
            out += [Range(path, self.kind, header, stride, dim, first, min(step, take - first), n, base) for first in range(0, take, step)]
            base += n
        return out or [Range("", self.kind, 0, 1, 0, 0, 0, 0, 0)]

    def read(self, p: Range) -> Iterator[pa.RecordBatch]:
        rows_at_once = max(1, (4 << 20) // max(p.stride, 1))
        if not p.count:
            return
        with reading(p.path) as f:
            labels = None
            if p.kind == "fc7":
                f.seek(p.header + p.records * p.stride + 4 * p.first)
                labels = np.frombuffer(f.read(4 * p.count), ">i4").astype(np.int32)
            f.seek(p.header + p.first * p.stride)
            for low in range(0, p.count, rows_at_once):
                n = min(rows_at_once, p.count - low)
                raw = f.read(n * p.stride)
                if len(raw) != n * p.stride:
                    raise EOFError(f"{p.path}: the last record is cut off")
                yield self.batch(p, np.frombuffer(raw, np.uint8).reshape(n, p.stride), p.base + p.first + low, None if labels is None else labels[low : low + n])

    @staticmethod
    def batch(p: Range, raw: np.ndarray, start: int, labels: np.ndarray | None) -> pa.RecordBatch:
        idx = pa.array(np.arange(start, start + len(raw)))
        if p.kind in _PAYLOAD:
            if (np.ascontiguousarray(raw[:, :4]).view("<i4") != p.dim).any():
                raise ValueError(f"{p.path}: records of different dimension")
            x = np.ascontiguousarray(raw[:, 4:]).view(_PAYLOAD[p.kind])
            if p.kind == "ivecs":
                return pa.RecordBatch.from_arrays([idx, _lists(x.astype(np.int32), pa.int32())], names=["idx", "nn"])
            return pa.RecordBatch.from_arrays([idx, _lists(x.astype(np.float64), pa.float64())], names=["idx", "vec"])
        if p.kind == "idx_images":
            return pa.RecordBatch.from_arrays([idx, _lists(raw / 255.0, pa.float64())], names=["idx", "vec"])
        if p.kind == "idx_labels":
            return pa.RecordBatch.from_arrays([idx, pa.array(raw[:, 0].astype(np.int32))], names=["idx", "label"])
        if p.kind == "cifar10":
            return pa.RecordBatch.from_arrays([idx, _lists(raw[:, 1:] / 255.0, pa.float64()), pa.array(raw[:, 0].astype(np.int32))], names=["idx", "vec", "label"])
        x = np.ascontiguousarray(raw).view(">f8").astype(np.float64)
        return pa.RecordBatch.from_arrays([idx, _lists(x, pa.float64()), pa.array(labels)], names=["idx", "vec", "label"])


class FixedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return _SCHEMA[self.options.get("kind", "fvecs").lower()]

    def reader(self, schema) -> RecordReader:
        return RecordReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FixedRecords)


def read_records(spark: SparkSession, path: str, kind: str, max_records: int | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("fixed_records").option("kind", kind)
    if max_records is not None:
        reader = reader.option("maxRecords", str(max_records))
    return reader.load(path)


def write_vectors(df: DataFrame, path: str, kind: str = "fvecs", vec_col: str = "vec", order: str = "idx", single_file: bool = True) -> None:
    """Vectors in the order of `order` as fvecs, bvecs or ivecs. One file is written by one task; single_file=False writes a
    directory of parts in range order, which reads back as one table. Each part gets its name only when it is complete."""
    kind_np = _PAYLOAD[kind]
    rows = df.select(order, vec_col)
    rows = rows.repartition(1).sortWithinPartitions(order) if single_file else rows.repartitionByRange(order).sortWithinPartitions(order)

    def run(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        final = path if single_file else f"{path.rstrip('/')}/part-{ctx.partitionId():05d}.{kind}"
        n = 0
        with writing(final, str(ctx.taskAttemptId())) as f:
            for batch in batches:
                for v in batch.column(1).to_pylist():
                    f.write(struct.pack("<i", len(v)) + np.asarray(v).astype(kind_np).tobytes())
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    rows.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
