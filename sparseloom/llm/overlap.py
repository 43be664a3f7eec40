"""Same or near-same records across splits (problem 6).

Records are brought to a canonical form first: a vector to unit length (so its own length plays no part), entries to 6 places.
The canonical form is hashed and evaluation hashes are joined with training hashes: these are the exact matches, counted once per
class of copies. A second stage finds the near ones among the classes: hashes that similar directions share (the axis of
several random frames a vector is nearest to, so fewer hashes are needed than by signs) are joined across the sides, a sketch of
14 coarse coordinates travels with the hash and drops most chance meetings in the join itself, and the cosine of what is left is checked.
Only a compact form of each class's representative (a byte per entry) is shuffled, never all vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DIM, list_matrix, rotation, small, stack, unit, usable_vector

MIN_COSINE = 0.975
#: Expected share of pairs at the threshold that no hash finds.
MISS = 5e-4
#: Axes of a frame: with signs, 8 bits of a hash. A sketch's axes, the bits of each, and those that tell classes of one name apart.
AXES, FRAME_BITS, SKETCH, BITS, TAG = 128, 8, 14, 4, 8


def nearest_axis(x: np.ndarray) -> np.ndarray:
    """The axis of the greatest share in every row, with its sign as the lowest bit."""
    at = np.abs(x).argmax(1)
    return at.astype(np.int64) * 2 + (x[np.arange(len(x)), at] > 0)


def sketch_frame(dim: int) -> np.ndarray:
    return rotation(dim, 3)[:, :SKETCH]


def sketched(x: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """Shares of the frame's axes in the directions of the rows of x, in 2 ** BITS levels."""
    share = x @ frame / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30) * np.sqrt(len(frame))
    return np.clip(np.floor(share * (2**BITS / 6) + 2 ** (BITS - 1)), 0, 2**BITS - 1).astype(np.int64)


@lru_cache(maxsize=64)
def _trials(min_cosine: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """20,000 pairs of directions of this cosine."""
    rng = np.random.default_rng(1)
    a = unit(rng.standard_normal((20_000, dim)))
    b = rng.standard_normal(a.shape)
    return a, min_cosine * a + math.sqrt(1 - min_cosine**2) * unit(b - (b * a).sum(1, keepdims=True) * a)


@lru_cache(maxsize=64)
def meeting_chance(axes: int, min_cosine: float, dim: int) -> float:
    """The chance that two vectors of this cosine are nearest to the same of so many signed random axes."""
    a, b = _trials(min_cosine, dim)
    frame = np.random.default_rng(2).standard_normal((dim, axes))
    return float((nearest_axis(a @ frame) == nearest_axis(b @ frame)).mean())


@lru_cache(maxsize=64)
def sketch_reach(min_cosine: float, dim: int) -> int:
    """The greatest distance (levels apart, over all axes) between the sketches of two vectors of this cosine in all trials."""
    a, b = _trials(min_cosine, dim)
    frame = sketch_frame(dim)
    return int(np.abs(sketched(a, frame) - sketched(b, frame)).sum(1).max())


def hash_shape(records: int, min_cosine: float, dim: int = DIM) -> tuple[list[int], int]:
    """(axes of each frame of a hash, hashes) for so many records: about as many bits as the records' number has, so that
    chance meetings per hash stay in proportion to the records."""
    bits = max(8, math.ceil(math.log2(max(records, 2))))
    frames = [AXES] * (bits // FRAME_BITS) + ([2 ** (bits % FRAME_BITS - 1)] if bits % FRAME_BITS else [])
    chance = math.prod(meeting_chance(axes, min_cosine, dim) for axes in frames)
    return frames, math.ceil(math.log(MISS) / math.log(1 - chance))


def _canonical(dim: int, seed: int):
    """idx, vec -> idx, the canonical form's hash (128 bits in two), and its direction with a byte per entry."""
    mixers = np.random.default_rng(seed).integers(1, 2**63, size=(2, dim), dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            u = unit(list_matrix(batch.column(1), dim))
            q = (np.round(u, 6) * 1e6).astype(np.int64).view(np.uint64)
            whole = []
            for no, m in enumerate(mixers):
                h = (q * m).sum(axis=1, dtype=np.uint64)
                h ^= h >> np.uint64(31 + no)
                whole.append(pa.array((h * m[0]).view(np.int64)))
            small_u = np.rint(u * (127 / np.abs(u).max(axis=1, keepdims=True))).astype(np.int8)
            form = pa.Array.from_buffers(pa.binary(), len(u), [None, pa.py_buffer(np.arange(0, (len(u) + 1) * dim, dim, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(small_u))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *whole, form], names=["idx", "h1", "h2", "form"])

    return run


def _poster(frames: list[int], hashes: int, seed: int, dim: int):
    """rep, h1, h2, form -> a row with the whole form's hash (its key is negative) and one for every hash that near forms share:
    key, rep, sketch. The `TAG` lowest bits of a whole key and of a near sketch are the class's: an idx may have several vectors, so
    several classes of its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        turn = sketch_frame(dim)
        axes = [[rng.standard_normal((dim, n)).astype(np.float32) for n in frames] for _ in range(hashes)]
        names = ["key", "rep", "sketch"]
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            rep, h1 = batch.column(0), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(h1 | np.int64(-(1 << 63))), rep, batch.column(2)], names=names)
            form = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
            sketch = pa.array((sketched(form, turn) << (TAG + BITS * np.arange(SKETCH))).sum(1) | (h1 & np.int64((1 << TAG) - 1)))
            for table, parts in enumerate(axes):
                key = np.full(n, table, np.int64)
                for frame in parts:
                    key = key * (2 * frame.shape[1]) + nearest_axis(form @ frame)
                yield pa.RecordBatch.from_arrays([pa.array(key), rep, sketch], names=names)

    return run


@F.pandas_udf(T.DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    return pd.Series((unit(stack(a)) * unit(stack(b))).sum(axis=1))


def class_pairs(df: DataFrame, is_train: Column, key: str = "idx", vec: str = "vec", min_cosine: float = MIN_COSINE, dim: int = DIM, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes of copies, members of the classes in them): pairs has eval_rep, eval_tag, train_rep, train_tag, cosine,
    exact (same canonical form); members has train, rep, tag, idx.

    A class is a set of records of one side with the same canonical form, named by its smallest key and a tag. Every record counts once,
    however often its row is repeated. Null, wrongly long, non-finite and zero vectors and null keys take no part.
    """
    rows = df.filter(usable_vector(vec, dim) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("idx"), F.coalesce(is_train, F.lit(False)).alias("train"), F.col(vec).cast("array<double>").alias("vec"))
    frames, hashes = hash_shape(df.count(), min_cosine, dim)
    low = F.lit((1 << TAG) - 1)

    def side(train: bool, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        mine = rows.filter(F.col("train") == train).select("idx", "vec")
        hashed = mine.mapInArrow(_canonical(dim, seed), "idx long, h1 long, h2 long, form binary")
        # combined before the shuffle, so that a mass of copies is a row per task
        reps = hashed.groupBy("h1", "h2").agg(F.min(F.struct("idx", "form")).alias("r")).select(F.col("r.idx").alias("rep"), "h1", "h2", F.col("r.form").alias("form"))
        posted = reps.mapInArrow(_poster(frames, hashes, seed + 1, dim), "key long, rep long, sketch long")
        return mine, hashed, posted.select("key", F.col("rep").alias(f"{name}_rep"), F.col("sketch").alias(f"{name}_sketch"))

    (e_rows, e_hashed, e), (t_rows, t_hashed, t) = side(False, "eval"), side(True, "train")
    # evaluation hashes meet training hashes: whole ones are exact matches if both halves agree, the others candidates for near
    same = F.col("eval_sketch") == F.col("train_sketch")
    level = lambda side, i: F.shiftright(f"{side}_sketch", TAG + BITS * i).bitwiseAND(F.lit(2**BITS - 1))
    apart = [F.abs(level("eval", i) - level("train", i)) for i in range(SKETCH)]
    close = sum(apart[1:], apart[0]) <= sketch_reach(min_cosine, dim)
    whole = F.col("key") < 0
    met = e.join(t, "key").filter(F.when(whole, same).otherwise(close))
    tag = lambda side: F.when(whole, F.col("key")).otherwise(F.col(f"{side}_sketch")).bitwiseAND(low).cast("int").alias(f"{side}_tag")
    met = small(met.groupBy("eval_rep", tag("eval"), "train_rep", tag("train")).agg(F.max(whole).alias("exact")))

    near = met.filter("not exact")
    va = e_rows.select(F.col("idx").alias("eval_rep"), F.col("vec").alias("va")).join(near, "eval_rep")
    vb = t_rows.select(F.col("idx").alias("train_rep"), F.col("vec").alias("vb")).join(near.select("train_rep"), "train_rep", "left_semi")
    near = va.join(vb, "train_rep").withColumn("cosine", _cosine("va", "vb")).filter(F.col("cosine") >= min_cosine - 1e-12)
    names = ["eval_rep", "eval_tag", "train_rep", "train_tag"]
    near = near.groupBy(*names).agg(F.max("cosine").alias("cosine"))
    pairs = met.filter("exact").select(*names, F.lit(1.0).alias("cosine"), "exact").unionByName(near.withColumn("exact", F.lit(False)))

    members = None
    for hashed, name, train in ((e_hashed, "eval", False), (t_hashed, "train", True)):
        found = met.select(F.col(f"{name}_rep").alias("idx"), F.col(f"{name}_tag").alias("tag")).distinct()
        hashes_of = hashed.select("idx", "h1", "h2", F.col("h1").bitwiseAND(low).cast("int").alias("tag"))
        named = hashes_of.join(found, ["idx", "tag"]).select(F.col("idx").alias("rep"), "tag", "h1", "h2").distinct()
        part = hashed.select("h1", "h2", "idx").join(named, ["h1", "h2"]).select(F.lit(train).alias("train"), "rep", "tag", "idx").distinct()
        members = part if members is None else members.unionByName(part)
    return pairs, members


def cross_split_pairs(df: DataFrame, is_train: Column, **options) -> DataFrame:
    """All pairs of an evaluation and a training record with a cosine of `min_cosine` or more: eval_idx, train_idx, cosine, exact."""
    pairs, members = class_pairs(df, is_train, **options)
    e = members.filter("not train").select(F.col("rep").alias("eval_rep"), F.col("tag").alias("eval_tag"), F.col("idx").alias("eval_idx"))
    t = members.filter("train").select(F.col("rep").alias("train_rep"), F.col("tag").alias("train_tag"), F.col("idx").alias("train_idx"))
    return pairs.join(e, ["eval_rep", "eval_tag"]).join(t, ["train_rep", "train_tag"]).select("eval_idx", "train_idx", "cosine", "exact")


def overlap_report(df: DataFrame, is_train: Column, role: str = "role", source: str = "source", **options) -> DataFrame:
    """Per role and source of the evaluation records: role, source, records, exact (records with the same canonical form in
    training), near (the other records with a match), exact_pairs, near_pairs. Null names count as "unknown".

    A record whose repeated rows name several roles or sources counts under the smallest. Pairs are counted from class sizes;
    copies are not expanded.
    """
    pairs, members = class_pairs(df, is_train, **options)
    key = options.get("key", "idx")
    train_size = members.filter("train").groupBy(F.col("rep").alias("train_rep"), F.col("tag").alias("train_tag")).agg(F.count(F.lit(1)).alias("n"))
    linked = pairs.join(train_size, ["train_rep", "train_tag"]).groupBy(F.col("eval_rep").alias("rep"), F.col("eval_tag").alias("tag")).agg(*(F.sum(F.when(F.col("exact") == x, F.col("n")).otherwise(0)).alias(c) for x, c in ((True, "e"), (False, "n"))))
    # a record with several vectors is in several classes
    per_record = small(members.filter("not train").join(linked, ["rep", "tag"]).groupBy("idx").agg(F.sum("e").alias("e"), F.sum("n").alias("n")))
    tidy = F.lower(F.trim(F.col(source)))
    meta = df.filter(~F.coalesce(is_train, F.lit(False)) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("idx")).agg(F.coalesce(F.min(role), F.lit("unknown")).alias("role"), F.coalesce(F.min(tidy), F.lit("unknown")).alias("source"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = meta.join(per_record, "idx", "left").groupBy("role", "source")
    return out.agg(F.count(F.lit(1)).alias("records"), count(F.col("e") > 0).alias("exact"), count((F.col("e") == 0) & (F.col("n") > 0)).alias("near"), count(F.col("e")).alias("exact_pairs"), count(F.col("n")).alias("near_pairs"))
