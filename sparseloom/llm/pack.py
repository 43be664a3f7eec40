"""Filling containers of fixed capacity (problem 8).

Documents are hashed to partitions of bounded size; each is packed by best fit decreasing and certified by a lower bound from
dual feasible functions. Where a partition used more containers than its bound, the documents of its unfilled containers
go on to the next round, as do those of every partition's emptiest container; there they are hashed anew, together with the
other partitions' leavings, and packed again. A certified container stays.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

PER_PARTITION, ROUNDS, FULL, SEED = 20_000, 4, 0.995, 42
MOST_SPECS = 1000
#: Shares of the capacity below which the dual feasible functions drop items (and count those within it of the whole as whole).
CUTS = tuple(i / 32 for i in range(1, 17))
#: Values of k of the second family of dual feasible functions.
STEPS = tuple(range(1, 9))


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing of `sizes` (1..capacity) has fewer containers; the greatest of the bounds by dual feasible functions."""
    if len(sizes) == 0:
        return 0
    x = sizes.astype(np.int64)
    best = -(-int(x.sum()) // capacity)
    for cut in CUTS:
        least = int(capacity * cut)
        kept = np.where(x > capacity - least, capacity, np.where(x >= least, x, 0))
        best = max(best, -(-int(kept.sum()) // capacity))
    for k in STEPS:
        up = (k + 1) * x
        # x stays where (k+1)x is a multiple of the capacity, else floor((k+1)x / capacity) of k parts; scaled by k
        scaled = np.where(up % capacity == 0, k * x, up // capacity * capacity)
        best = max(best, -(-int(scaled.sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of every item, numbered from 0; sizes are 1..capacity."""
    out = np.empty(len(sizes), dtype=np.int64)
    room: list[int] = []  # the distinct rooms left, in order
    at: dict[int, list[int]] = {}  # containers by room left
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect_left(room, size)
        if k < len(room):
            left = room[k]
            stack = at[left]
            box = stack.pop()
            if not stack:
                del at[left]
                room.pop(k)
        else:
            left, box, made = capacity, made, made + 1
        left -= size
        out[i] = box
        if left > 0:
            if left in at:
                at[left].append(box)
            else:
                at[left] = [box]
                insort(room, left)
    return out


def _pack_group(last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # in a fixed order, so that a task that runs again gives the same containers
        pdf = pdf.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        capacity = int(pdf["capacity"].iloc[0])
        sizes = pdf["tokens"].to_numpy(np.int64)
        box = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(box, weights=sizes).astype(np.int64)
        certified = len(fill) == lower_bound(sizes, capacity)
        if last:
            stays = np.ones(len(fill), dtype=bool)
        else:
            stays = np.ones(len(fill), dtype=bool) if certified else fill >= FULL * capacity
            if fill.min() < FULL * capacity:
                stays[int(np.argmin(fill))] = False
        return pdf.assign(box=box, stays=stays[box])

    return run


def pack(sizes: DataFrame, specs: DataFrame, per_partition: int = PER_PARTITION, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Containers of every capacity: spec_name, capacity, container, doc_id, piece_no, first_token, tokens.

    sizes: doc_id, tokens; specs: spec_name, capacity_tokens. A document with more tokens than a container is cut into full
    containers and one rest, which is packed like a document (piece_no from 0, first_token its offset); no other is cut.
    Documents with no tokens (null, 0) and specs with a null name or capacity below 1 take no part; of a repeated name the
    greatest capacity counts. Repeated doc_ids are packed as often as they come. No documents, or no specs: no rows.
    """
    found = specs.filter("spec_name is not null and capacity_tokens > 0").groupBy("spec_name").agg(F.max("capacity_tokens").cast("long").alias("c")).orderBy("spec_name").limit(MOST_SPECS + 1).collect()
    if len(found) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container specs")
    schema = "spec_name string, capacity long, container string, doc_id long, piece_no int, first_token long, tokens long"
    spark = sizes.sparkSession
    if not found:
        return spark.createDataFrame([], schema)
    each = F.explode(F.array(*(F.struct(F.lit(r.spec_name).alias("spec_name"), F.lit(r.c).cast("long").alias("capacity")) for r in found)))
    items = checkpoint(sizes.filter("doc_id is not null and tokens > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("long").alias("tokens")))
    count = items.count()
    if not count:
        return spark.createDataFrame([], schema)
    all_items = items.withColumn("s", each).select("doc_id", "tokens", "s.spec_name", "s.capacity")
    whole = F.floor(F.col("tokens") / F.col("capacity")).cast("int")
    cut = all_items.filter("tokens > capacity")
    full = cut.select("spec_name", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece_no"))
    full = full.select("spec_name", "capacity", F.concat_ws("-", F.lit("full"), "doc_id", "piece_no").alias("container"), "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("tokens"))
    rest = all_items.select("spec_name", "capacity", "doc_id", F.when(F.col("tokens") > F.col("capacity"), whole).otherwise(0).alias("piece_no"), F.when(F.col("tokens") > F.col("capacity"), F.col("tokens") - F.col("tokens") % F.col("capacity")).otherwise(0).cast("long").alias("first_token"), F.when(F.col("tokens") > F.col("capacity"), F.col("tokens") % F.col("capacity")).otherwise(F.col("tokens")).alias("tokens")).filter("tokens > 0")
    done, open_items = [full], rest
    for turn in range(rounds):
        parts = max(1, -(-count // per_partition))
        last = turn == rounds - 1 or parts == 1 and turn > 0
        keyed = open_items.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + turn), "doc_id", "piece_no"), F.lit(parts)).cast("int"))
        packed = keyed.groupBy("spec_name", "part").applyInPandas(_pack_group(last or parts == 1), "spec_name string, capacity long, doc_id long, piece_no int, first_token long, tokens long, part int, box long, stays boolean")
        packed = packed.withColumn("container", F.concat_ws("-", F.lit(f"r{turn}"), "part", "box"))
        stop = last or parts == 1
        if not stop:
            packed = checkpoint(packed)
        done.append(packed.filter("stays").select(*full.columns))
        if stop:
            break
        open_items = packed.filter("not stays").select("spec_name", "capacity", "doc_id", "piece_no", "first_token", "tokens")
        count = -(-open_items.count() // len(found))
        if not count:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_report(packed: DataFrame) -> DataFrame:
    """Per spec: spec_name, capacity, containers, lower_bound, documents, cut_documents, tokens, fill (share of all room used).

    A document counts as often as it was packed. The bound is that of one packing of all pieces together: the sums of the dual feasible functions add up over partitions.
    """
    x, c = F.col("tokens"), F.col("capacity")
    cuts = {f"f{i}": F.sum(F.when(x > c - F.floor(c * cut), c).when(x >= F.floor(c * cut), x).otherwise(0)) for i, cut in enumerate(CUTS)}
    steps = {f"g{k}": F.sum(F.when((k + 1) * x % c == 0, k * x).otherwise(F.floor((k + 1) * x / c) * c)) for k in STEPS}
    sums = {"tokens": F.sum(x), "documents": F.sum((F.col("piece_no") == 0).cast("long")), "cut_documents": F.sum((F.col("piece_no") == 1).cast("long"))} | cuts | steps
    # per container first: of those there are fewer, and each then counts once
    boxes = packed.groupBy("spec_name", "capacity", "container").agg(*(v.alias(k) for k, v in sums.items()))
    agg = boxes.groupBy("spec_name", "capacity").agg(F.count(F.lit(1)).alias("containers"), *(F.sum(k).alias(k) for k in sums))
    each = [x / c, *(F.col(k) / c for k in cuts), *(F.col(f"g{k}") / (k * c) for k in STEPS)]
    bound = F.ceil(F.greatest(*each) - 1e-9)
    return agg.select("spec_name", "capacity", "containers", bound.cast("long").alias("lower_bound"), "documents", "cut_documents", "tokens", (x / (F.col("containers") * c)).alias("fill"))
