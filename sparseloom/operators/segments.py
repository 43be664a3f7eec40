"""A segmented index of sparse codes: append with the newest encoder, improve it with a newer one, consolidate, search.

On storage an index is a directory of immutable Parquet folders and numbered manifests, on any file system Spark can reach:

    codes/<uuid>/    idx, id, code of one write, one folder per append or segment
    weights/<uuid>/  mu, w of one encoder
    manifests/<n>.json

A change writes new folders first and then the next manifest, under a name that must not be taken; readers use the manifest of the
greatest number. They see the old or the new state, a driver that dies leaves files nobody refers to, of two writers at once
one fails, and an append costs only the new rows.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoders import Encoder, config_from_json, config_to_json, encode, restore_encoder
from .retrieval import hamming_extent, hamming_top_r
from .trainer import train, train_more, weights_frame


@dataclass(frozen=True)
class Segment:
    segment_id: int
    encoder: str  # folder of the weights
    config: str  # JSON
    steps: int
    items: int
    codes: tuple[str, ...]  # folders
    created_at: str


@dataclass(frozen=True)
class Manifest:
    dataset: str
    method: str
    vector_dim: int
    embedding_model: str
    segments: tuple[Segment, ...]
    version: int = 0
    batches: tuple[str, ...] = field(default=())  # ids of the batches that were appended, for idempotent ingest

    @property
    def items(self) -> int:
        return sum(s.items for s in self.segments)


def index_name(config, epochs: int | None = None) -> str:
    """A folder name that differs for every configuration: method, k, activity, and a hash of all fields."""
    import zlib

    text = config_to_json(config)
    return f"{config.method}-k{config.k}-a{config.activity:.4f}-ep{getattr(config, 'epochs', 0) if epochs is None else epochs}-seed{config.seed}-{zlib.crc32(text.encode()):08x}"


class SegmentedIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # ---- files

    def _at(self, *parts: str) -> str:
        return os.path.join(self.path, *parts)

    def _versions(self) -> list[int]:
        fs, path = file_system(self.spark, self._at("manifests"))
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> Manifest:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"no index at {self.path}")
        return self._read_manifest(versions[-1])

    def _read_manifest(self, version: int) -> Manifest:
        fs, path = file_system(self.spark, self._at("manifests", f"{version:06d}.json"))
        stream = fs.open(path)
        try:
            raw = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(raw["dataset"], raw["method"], raw["vector_dim"], raw["embedding_model"], tuple(Segment(**(s | {"codes": tuple(s["codes"])})) for s in raw["segments"]), raw["version"], tuple(raw["batches"]))

    def exists(self) -> bool:
        return bool(self._versions())

    def _commit(self, m: Manifest) -> Manifest:
        m = replace(m, version=m.version + 1)
        fs, temporary = file_system(self.spark, self._at("manifests", f".{uuid.uuid4().hex}"))
        _, final = file_system(self.spark, self._at("manifests", f"{m.version:06d}.json"))
        stream = fs.create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(asdict(m), indent=1).encode()))
        finally:
            stream.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError(f"the index was changed by another writer: version {m.version} exists")
        return m

    def _write_codes(self, codes: DataFrame) -> tuple[str, int]:
        name = f"codes/{uuid.uuid4().hex}"
        codes.write.parquet(self._at(name))
        return name, self.spark.read.parquet(self._at(name)).count()

    def _write_weights(self, encoder: Encoder) -> str:
        name = f"weights/{uuid.uuid4().hex}"
        weights_frame(self.spark, encoder).write.parquet(self._at(name))
        return name

    # ---- reading

    def encoder(self, segment: Segment) -> Encoder:
        rows = self.spark.read.parquet(self._at(segment.encoder)).toArrow().sort_by("mu")  # m x d doubles
        return restore_encoder(config_from_json(segment.config), np.array(rows.column("w").to_pylist()), segment.steps)

    def codes(self, *segment_ids: int) -> DataFrame:
        """segment_id, idx, id, code of the segments (all, if none is named). Other segments' files are not read."""
        out = None
        for s in self.manifest().segments:
            if segment_ids and s.segment_id not in segment_ids:
                continue
            part = self.spark.read.parquet(*(self._at(c) for c in s.codes)).select(F.lit(s.segment_id).alias("segment_id"), "idx", "id", "code")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "segment_id int, idx long, id string, code array<int>")

    def validate(self) -> None:
        m = self.manifest()
        for s in m.segments:
            if config_from_json(s.config).method != m.method:
                raise ValueError(f"segment {s.segment_id} is of another method than the index")
            rows = self.codes(s.segment_id).agg(F.count(F.lit(1)), F.count("id"), F.count("code")).first()
            if set(rows) != {s.items}:
                raise ValueError(f"segment {s.segment_id}: {tuple(rows)} rows, ids and codes, expected {s.items}")

    # ---- writing

    def create(self, corpus: DataFrame, config, dataset: str = "", embedding_model: str = "unknown", encoder: Encoder | None = None) -> Manifest:
        """Trains (unless an encoder is given), encodes and saves segment 0. corpus: idx, id, vec. An index that is already at
        this path is replaced as a whole."""
        encoder = encoder or train(corpus, config)
        codes, n = self._write_codes(self._encoded(corpus, encoder))
        segment = Segment(0, self._write_weights(encoder), config_to_json(encoder.config), encoder.steps, n, (codes,), _now())
        before = self.manifest().version if self.exists() else 0
        return self._commit(Manifest(dataset, encoder.config.method, encoder.config.input_dim, embedding_model, (segment,), before))

    @staticmethod
    def _encoded(rows: DataFrame, encoder: Encoder, offset: int = 0) -> DataFrame:
        return encode(rows.select((F.col("idx") + offset).cast("long").alias("idx"), F.col("id").cast("string").alias("id"), "vec"), encoder, keep=("idx", "id"))

    def append(self, items: DataFrame, on_conflict: str = "keep", batch_id: str | None = None) -> Manifest:
        """Encodes with the newest encoder, unchanged, into the newest segment. items: idx (from 0, for order), id, vec.

        on_conflict "keep" lets an id be there twice, "error" refuses ids that are. A batch_id that was appended before changes
        nothing, so a replayed batch is harmless.
        """
        m = self.manifest()
        if batch_id is not None and batch_id in m.batches:
            return m
        if on_conflict == "error":
            if not items.join(self.codes().select("id"), "id", "left_semi").isEmpty():
                raise ValueError("an id is already in the index")
        elif on_conflict != "keep":
            raise ValueError(f"unknown on_conflict {on_conflict!r}; expected keep or error")
        last = m.segments[-1]
        codes, n = self._write_codes(self._encoded(items, self.encoder(last), last.items))
        grown = replace(last, items=last.items + n, codes=(*last.codes, codes))
        return self._commit(replace(m, segments=(*m.segments[:-1], grown), batches=(*m.batches, batch_id) if batch_id is not None else m.batches))

    def improve(self, items: DataFrame, epochs: int = 1, learning_rate: float | None = None, shuffle: bool = True, batch_id: str | None = None) -> Manifest:
        """Trains the newest encoder further on the items and puts them, and only them, into a new segment."""
        m = self.manifest()
        if batch_id is not None and batch_id in m.batches:
            return m
        last = m.segments[-1]
        if m.method == "projection":
            raise ValueError("random projections are not trained")
        better = train_more(items, self.encoder(last), epochs, shuffle=shuffle, learning_rate=learning_rate, seed_offset=last.steps)
        codes, n = self._write_codes(self._encoded(items, better))
        segment = Segment(last.segment_id + 1, self._write_weights(better), config_to_json(better.config), better.steps, n, (codes,), _now())
        return self._commit(replace(m, segments=(*m.segments, segment), batches=(*m.batches, batch_id) if batch_id is not None else m.batches))

    def consolidate(self, vectors: DataFrame) -> Manifest:
        """All ids, in the order of segments, encoded by the newest encoder into one segment; no training. vectors: id, vec, one
        for every id of the index (of several the least, entry by entry)."""
        m = self.manifest()
        if m.method == "projection":
            raise ValueError("random projections are not consolidated")
        last = m.segments[-1]
        starts, start = [], 0
        for s in m.segments:
            starts.append((s.segment_id, start))
            start += s.items
        offset = F.element_at(F.create_map(*(F.lit(x) for pair in starts for x in pair)), F.col("segment_id"))
        ids = self.codes().select((F.col("idx") + offset).alias("idx"), "id")
        v = vectors.select(F.col("id").cast("string").alias("id"), "vec").groupBy("id").agg(F.min("vec").alias("vec"))
        if not ids.join(v, "id", "left_anti").isEmpty():
            raise ValueError("an id of the index has no vector")
        encoder = self.encoder(last)
        codes, n = self._write_codes(self._encoded(ids.join(v, "id"), encoder))
        merged = Segment(0, last.encoder, last.config, last.steps, n, (codes,), _now())
        return self._commit(replace(m, segments=(merged,)))

    def compact(self) -> Manifest:
        """Each segment's code folders written as one, without training or encoding. Of the batches of a stream (name-number) only
        the last is remembered, which is the one that can be replayed."""
        m = self.manifest()
        segments = []
        for s in m.segments:
            if len(s.codes) > 1:
                codes, _ = self._write_codes(self.spark.read.parquet(*(self._at(c) for c in s.codes)))
                s = replace(s, codes=(codes,))
            segments.append(s)
        last: dict[str, tuple[int, str]] = {}
        for b in m.batches:
            name, _, number = b.rpartition("-")
            key, at = (name, int(number)) if name and number.isdigit() else (b, 0)
            last[key] = max(last.get(key, (-1, "")), (at, b))
        return self._commit(replace(m, segments=tuple(segments), batches=tuple(b for _, b in sorted(last.values()))))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the last `keep` and the folders that none of those names; returns how many folders. Readers of
        older manifests, and writers at work, must be done."""
        versions = self._versions()
        used = set()
        for v in versions[-keep:]:
            for s in self._read_manifest(v).segments:
                used |= {*s.codes, s.encoder}
        gone = 0
        for kind in ("codes", "weights"):
            fs, path = file_system(self.spark, self._at(kind))
            for f in fs.listStatus(path) if fs.exists(path) else ():
                if f"{kind}/{f.getPath().getName()}" not in used:
                    gone += bool(fs.delete(f.getPath(), True))
        for v in versions[:-keep]:
            fs, path = file_system(self.spark, self._at("manifests", f"{v:06d}.json"))
            fs.delete(path, False)
        return gone

    # ---- search

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, hamming, rank (from 1). queries: idx, vec (and id). One segment orders by (distance, idx), several
        by (distance, segment, id), each query encoded by every segment's own encoder."""
        if k <= 0:
            raise ValueError("k must be positive")
        m = self.manifest()
        if len(m.segments) == 1:
            codes = self.codes()
            hits = hamming_top_r(encode(queries, self.encoder(m.segments[0])), codes, k)
            names = codes.select("idx", F.col("id").alias("doc_id"))
            return hits.join(names, "idx").select(F.col("qidx").alias("query_idx"), "doc_id", F.col("distance").alias("hamming"), "rank")
        merged = merge_candidates(self.candidates(queries, k), k)
        return merged.select("query_idx", F.col("corpus_id").alias("doc_id"), F.col("distance").alias("hamming"), "rank")

    def candidates(self, queries: DataFrame, k: int | None = None, normalized: bool = False) -> DataFrame:
        """query_idx, segment_id, corpus_id, distance, normalized. Without normalization only the k best of each segment by
        (distance, id), the key of the merge, need leave it; with it, all are ranked first, for the segment's own range."""
        out = None
        for s in self.manifest().segments:
            part = segment_candidates(encode(queries, self.encoder(s)), self.codes(s.segment_id), s.segment_id, k, normalized)
            out = part if out is None else out.unionByName(part)
        return out


def segment_candidates(queries: DataFrame, codes: DataFrame, segment_id: int, k: int | None = None, normalized: bool = False) -> DataFrame:
    """Queries (idx, code) against the codes (id, code) of one segment, all made by its encoder: query_idx, segment_id, corpus_id, distance,
    normalized; the k nearest by (distance, id), or all.

    normalized: (distance - least) / (most - least) over the whole segment for the query, 0 where all are equal; else null.
    It rises with the distance, so the k nearest are the same with and without it.
    """
    near = hamming_top_r(queries, codes, codes.count() if k is None else k, key="id")
    out = near.select(F.col("qidx").alias("query_idx"), F.lit(segment_id).alias("segment_id"), F.col("idx").alias("corpus_id"), "distance")
    if not normalized:
        return out.withColumn("normalized", F.lit(None).cast("double"))
    ends = hamming_extent(queries, codes).withColumnRenamed("qidx", "query_idx")
    scaled = F.when(F.col("high") > F.col("low"), (F.col("distance") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    return out.join(ends, "query_idx").select("query_idx", "segment_id", "corpus_id", "distance", scaled.alias("normalized"))


def merge_candidates(candidates: DataFrame, r: int) -> DataFrame:
    """The r best of each query over all segments, by (normalized where present, distance, segment_id, corpus_id), with rank."""
    order = Window.partitionBy("query_idx").orderBy(F.col("normalized").asc_nulls_first(), "distance", "segment_id", "corpus_id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= r)


def compression(items: int, dim: int, artifact_bytes: int) -> float:
    """Bytes of the dense vectors as doubles over those of the index."""
    return items * dim * 8 / artifact_bytes if artifact_bytes else 0.0


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def artifact_bytes(spark: SparkSession, path: str) -> int:
    fs, p = file_system(spark, path)
    return fs.getContentSummary(p).getLength()


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")
