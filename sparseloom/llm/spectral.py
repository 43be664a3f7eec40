"""Grouping records into similarity clusters (problem 1).

Power-iteration spectral clustering. Vectors are placed in lists around coarse centres; within a list (cut into blocks) every
record is tied to a leader it is close to, which gives one affinity per record instead of one per pair. Leaders that are
similar get affinities across blocks and lists, all of `MIN_AFFINITY` or more. The row-normalised affinities, weighted
by the leaders' numbers of records, are iterated on several random vectors at once: within a group the vectors become
constant, between groups they differ. Where all of a group's affinities are from 0.80 to 1, a turn leaves at most a fifth of
the spread, so after `TURNS` = 8 it is under 0.2 ** 8 = 2.6e-6 and within the grid. K-means clusters the leaders in that embedding:
the cells of a grid over all its vectors give the first centres, then leaders go to the nearest centre and centres to the mean
of their leaders. Records follow their leader and are ranked by their mean affinity to their cluster, which the cluster's
vector sum gives exactly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .coarse import Blocks, Lists, block_of, count_blocks, fit, repeated
from .common import DIM, checkpoint, list_array, list_matrix, small, unit, usable_vector

MIN_AFFINITY, LEADER_AFFINITY, PROBES, VECTORS, TURNS, CUT, GRID, LIST_ROWS = 0.80, 0.90, 10, 4, 8, 4, 1e-5, 1024
#: Entries of an affinity matrix held at once.
AFFINITIES_AT_ONCE = 2_000_000
TYPICAL = 5
#: Turns of k-means after the grid's cells.
LLOYD = 2


@dataclass(frozen=True)
class TableLists:
    """The lists of several tables, numbered table after table."""

    tables: tuple[Lists, ...]

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum([0, *(t.count for t in self.tables)])

    def numbered(self, blocks: list[Blocks]) -> Blocks:
        """The blocks of each table's lists as blocks of all."""
        return Blocks(np.concatenate([b.lists + start for b, start in zip(blocks, self.starts)]), np.concatenate([b.blocks for b in blocks]))

    def nearest(self, batch: pa.RecordBatch, u: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each table (column 0) in the batch: its rows, and the n nearest of its lists for each."""
        space = batch.column(0).to_numpy(zero_copy_only=False)
        for s in np.unique(space):
            rows = np.flatnonzero(space == s)
            yield rows, self.tables[s].nearest(u[rows], n) + self.starts[s]


def _place(lists: TableLists, blocks: Blocks, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                idx = batch.column(1).to_numpy(zero_copy_only=False)
                u = unit(list_matrix(batch.column(2), dim))
                at = np.zeros(len(idx), np.int64)
                for rows, near in lists.nearest(batch, u, 1):
                    at[rows] = near[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(block_of(idx, blocks.of(at))), batch.column(1), list_array(u.astype(np.float32))], names=["space", "list", "block", "idx", "u"])

    return run


def leaders_of(u: np.ndarray, least: float) -> np.ndarray:
    """The row of every row's leader: rows in order become leaders unless one before has an affinity of `least` or more."""
    leader = np.full(len(u), -1)
    at = 0
    while at < len(u):
        if leader[at] < 0:
            open_rows = np.flatnonzero(leader < 0)
            near = open_rows[u[open_rows] @ u[at] >= least]
            leader[near] = at
            leader[at] = at
        at += 1
    return leader


def _lead(least: float, dim: int):
    def run(table: pa.Table) -> pa.Table:
        idx, first = np.unique(table.column("idx").to_numpy(), return_index=True)
        u = list_matrix(table.column("u"), dim)[first].astype(np.float32)
        leader = leaders_of(u, least)
        own = leader == np.arange(len(u))
        sums = np.zeros((len(u), dim))
        np.add.at(sums, leader, u)
        size = np.bincount(leader, minlength=len(u))
        # what holds if the leader's records are the whole cluster
        dot = (u * sums[leader]).sum(1)
        near, to_mean = dot / size[leader], np.minimum(1, dot / np.linalg.norm(sums, axis=1)[leader])
        offsets = np.r_[0, np.cumsum(np.where(own, dim, 0))].astype(np.int32)
        total = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums[own].ravel().astype(np.float32)), mask=pa.array(~own))
        keys = [table.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(idx), np.int64))) for c in ("space", "list", "block")]
        return pa.table([*keys, pa.array(idx), pa.array(idx[leader]), pa.array(np.where(own, size, 0)), pa.array(near), pa.array(to_mean), list_array(u), total], names=["space", "list", "block", "idx", "leader", "size", "near", "to_mean", "u", "total"])

    return run


def _probe(lists: TableLists, blocks: Blocks, senders: Blocks, dim: int, probes: int):
    """space, idx, u -> a row for each list near a leader and each block of it; `part` is the leader's own among those sent there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            idx = batch.column(1).to_numpy(zero_copy_only=False)
            u = list_matrix(batch.column(2), dim)
            for rows, near in lists.nearest(batch, u, probes):
                row, at = np.repeat(rows, near.shape[1]), near.ravel()
                copy, block = repeated(blocks.of(at))
                row, at = row[copy], at[copy]
                part = block_of(idx[row], senders.of(at))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(part), pa.array(idx[row]), list_array(u[row].astype(np.float32))], names=["list", "block", "part", "idx", "u"])

    return run


def _at_home(senders: Blocks, dim: int):
    """space, list, block, idx, leader, u -> the same for each part of the leaders sent to the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                copy, part = repeated(senders.of(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)))
                rows = batch if len(copy) == batch.num_rows else batch.take(pa.array(copy))
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(part.astype(np.int32)), *rows.columns[3:]], names=["space", "list", "block", "part", "idx", "leader", "u"])

    return run


def _affinities(least: float, dim: int):
    """All affinities of `least` or more between the leaders sent to a block and those at home in it; and the leaders of other
    records at home that a leader is as close to (w is 0), by which clusters touch."""

    def run(sent: pa.Table, home: pa.Table) -> pa.Table:
        out = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        if sent.num_rows and home.num_rows:
            idx, there, leader = sent.column("idx").to_numpy(), home.column("idx").to_numpy(), home.column("leader").to_numpy()
            u, v = (list_matrix(t.column("u"), dim).astype(np.float32) for t in (sent, home))
            own = there == leader
            step = max(1, AFFINITIES_AT_ONCE // len(v))
            for low in range(0, len(u), step):
                s = u[low : low + step] @ v.T
                a, b = np.nonzero(s >= least)
                w = np.where(own[b], s[a, b], 0.0)
                other = idx[low + a] != leader[b]
                for o, x in zip(out, (idx[low + a][other], leader[b][other], w[other])):
                    o.append(x)
        a, b, w = (np.concatenate(o) for o in out)
        # of a pair of leaders once, with its affinity if that is there
        order = np.lexsort((-w, b, a))
        a, b, w = a[order], b[order], w[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        a, b, w = a[new], b[new], w[new]
        # a list is of one table
        space = np.full(len(a), home.column("space")[0].as_py() if home.num_rows else 0, np.int32)
        return pa.table([pa.array(space), pa.array(a), pa.array(b), pa.array(w.astype(np.float64))], names=["space", "a", "b", "w"])

    return run


def _outer_check(least: float, dim: int):
    """Per cluster: whether all pairs of an outer member and any member have the least affinity."""

    def run(outer: pa.Table, members: pa.Table) -> pa.Table:
        names = ["space", "cluster", "holds"]
        if not outer.num_rows or not members.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.bool_())], names=names)
        a, b = list_matrix(outer.column("outer_u"), dim), list_matrix(members.column("u"), dim)
        holds = all((a[low : low + 1024] @ b.T).min() >= least - 1e-6 for low in range(0, len(a), 1024))
        return pa.table([outer.column("outer_space").slice(0, 1), outer.column("outer_cluster").slice(0, 1), pa.array([holds])], names=names)

    return run


def spectral_clusters(df: DataFrame, key: str = "idx", vec: str = "vec", dim: int = DIM, least: float = MIN_AFFINITY, vectors: int = VECTORS, turns: int = TURNS) -> DataFrame:
    """cluster (the smallest key in it), idx, affinity (mean cosine to the cluster's members, itself included), size, tight,
    isolated.

    One row per record with a usable vector; repeated rows with the same key count once, a record alone is a cluster of one.
    `tight`: all members have a cosine of `least` or more with each other - by the angles to the cluster's mean where these
    settle it, else by measuring the outer members against all in blocks. `isolated`: none of its leaders has a cosine of
    `least` or more to a record of another cluster, nor a leader of another one to its records, as where the walk parts a chain. Null, wrongly long, non-finite and zero vectors
    and null keys take no part. If a key has several vectors, each of them is clustered and the smallest cluster counts.
    """
    return table_clusters({"": df}, key, vec, dim, least, vectors, turns).drop("table_name")


def table_clusters(tables: dict[str, DataFrame], key: str = "idx", vec: str = "vec", dim: int = DIM, least: float = MIN_AFFINITY, vectors: int = VECTORS, turns: int = TURNS) -> DataFrame:
    """table_name and the columns of `spectral_clusters` for every table, each clustered by itself. All go through the same jobs:
    every exchange takes a thread of the driver and its plan a part of the driver's memory, whatever the rows in it."""

    def usable(df: DataFrame) -> DataFrame:
        return df.filter(usable_vector(vec, dim) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("idx"), F.col(vec).cast("array<double>").alias("vec"))

    fitted, cut = [], []
    for df in tables.values():
        count = df.count()
        fitted.append(fit(usable(df), dim, rows_per_list=LIST_ROWS, count=count))
        cut.append(count_blocks(usable(df), count, fitted[-1], 1, dim))
    lists = TableLists(tuple(fitted))
    blocks = lists.numbered(cut)
    rows = reduce(DataFrame.unionByName, (usable(df).select(F.lit(s).alias("space"), "idx", "vec") for s, df in enumerate(tables.values())))
    placed = rows.mapInArrow(_place(lists, blocks, dim), "space int, list int, block int, idx long, u array<float>")
    led = checkpoint(placed.groupBy("list", "block").applyInArrow(_lead(LEADER_AFFINITY, dim), "space int, list int, block int, idx long, leader long, size long, near double, to_mean double, u array<float>, total array<float>"))
    heads = led.filter("idx = leader").select("space", "idx", "size", "u")

    # affinities between leaders, the same in both directions
    led_by = {r.space: r.n for r in heads.groupBy("space").agg(F.count(F.lit(1)).alias("n")).collect()}
    senders = lists.numbered([count_blocks(heads.filter(F.col("space") == s).select(F.col("u").alias("vec")), led_by.get(s, 0), own, PROBES, dim) for s, own in enumerate(fitted)])
    sent = heads.select("space", "idx", "u").mapInArrow(_probe(lists, blocks, senders, dim, PROBES), "list int, block int, part int, idx long, u array<float>")
    home = led.select("space", "list", "block", "idx", "leader", "u").mapInArrow(_at_home(senders, dim), "space int, list int, block int, part int, idx long, leader long, u array<float>")
    keys = ("list", "block", "part")
    found = sent.groupBy(*keys).cogroup(home.groupBy(*keys)).applyInArrow(_affinities(least, dim), "space int, a long, b long, w double")
    # both directions of a row, as a union of two would measure all affinities twice
    both = found.select("space", F.inline(F.array(F.struct("a", "b", "w"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "w"))))
    met = checkpoint(both.groupBy("space", "a", "b").agg(F.max("w").alias("w")))
    edges = met.filter("w > 0")
    sizes = heads.select("space", F.col("idx").alias("b"), "size")
    linked = edges.select("space", "a").distinct()
    loops = linked.join(sizes.withColumnRenamed("b", "a"), ["space", "a"]).select("space", "a", F.col("a").alias("b"), F.lit(1.0).alias("w"), "size")
    weighted = edges.join(sizes, ["space", "b"]).select("space", "a", "b", "w", "size").unionByName(loops).withColumn("w", F.col("w") * F.col("size"))
    walk = checkpoint(weighted.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("space", "a"))).select("space", "a", "b", "w").repartition("space", "b"))

    # several vectors at once; leaders without affinities are constant from the start
    u01 = lambda k: F.shiftrightunsigned(F.xxhash64("idx", F.lit(k)), 11) / F.lit(float(1 << 53))
    names = [f"v{k}" for k in range(vectors)]
    v = linked.select("space", F.col("a").alias("idx")).select("space", "idx", *(u01(k).alias(n) for k, n in enumerate(names)))
    for turn in range(turns):
        if turn and turn % CUT == 0:
            v = checkpoint(v)  # else the plan, and what the driver holds of it, grows with every turn
        v = walk.join(v.withColumnRenamed("idx", "b"), ["space", "b"]).groupBy("space", "a").agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in names)).withColumnRenamed("a", "idx")
    embedded = checkpoint(v)

    # k-means: the grid's cells give the first centres; a leader looks for its centre in its own cell and the nearer next ones
    def cell(*numbers) -> Column:
        return F.xxhash64("space", *numbers)

    own = [F.floor(F.col(n) / GRID) for n in names]
    next_one = [c + F.when(F.col(n) / GRID - c < 0.5, -1).otherwise(1) for c, n in zip(own, names)]
    around = embedded.withColumn("cell", F.explode(F.array(*(cell(*c) for c in itertools.product(*zip(own, next_one))))))
    distance = sum(((F.col(n) - F.col(f"m{k}")) ** 2 for k, n in enumerate(names)), F.lit(0.0))
    means = [F.avg(n).alias(f"m{k}") for k, n in enumerate(names)]
    centres = embedded.withColumn("cell", cell(*own)).groupBy("space", "cell").agg(F.min("idx").alias("centre"), *means).drop("cell")
    for turn in range(LLOYD):
        if turn:
            centres = embedded.join(labelled, ["space", "idx"]).groupBy("space", F.col("label").alias("centre")).agg(*means)
        placed_centres = centres.withColumn("cell", cell(*(F.floor(F.col(f"m{k}") / GRID) for k in range(vectors))))
        # centres closer than the grid are one: the smallest name wins among them
        close = around.join(placed_centres, ["space", "cell"]).withColumn("dist", distance)
        labelled = close.groupBy("space", "idx").agg(F.coalesce(F.min(F.when(F.col("dist") <= (GRID * 1.5) ** 2, F.col("centre"))), F.min_by("centre", "dist")).alias("label"))
    label = heads.select("space", "idx").join(labelled, ["space", "idx"], "left").select("space", F.col("idx").alias("leader"), F.coalesce("label", "idx").alias("label"))
    label = checkpoint(label)

    # the cluster's vector sum gives every member's mean affinity; vectors move only for clusters of several leaders
    sized = label.join(heads.select("space", F.col("idx").alias("leader"), "size"), ["space", "leader"])
    whole = sized.groupBy("space", "label").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("leaders"))
    placed_leaders = checkpoint(label.join(whole, ["space", "label"]))
    several = placed_leaders.filter("leaders > 1")
    alone = led.select("space", "idx", "leader", "near", "to_mean").join(placed_leaders.filter("leaders = 1").select("space", "leader", "label", "n"), ["space", "leader"])
    alone = alone.select("space", "idx", "leader", "label", "n", F.when(F.col("n") == 1, 1.0).otherwise(F.col("near")).alias("affinity"), F.when(F.col("n") == 1, 1.0).otherwise(F.col("to_mean")).alias("to_mean"))
    some = small(several.select("space", "leader", "label", "n"))
    sums = led.filter("idx = leader").select("space", "leader", "total").join(some, ["space", "leader"]).groupBy("space", "label").agg(F.array(*(F.sum(F.get("total", F.lit(i)).cast("double")) for i in range(dim))).alias("sum"))
    dot = F.aggregate(F.zip_with("u", "sum", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate("sum", F.lit(0.0), lambda a, x: a + x * x))
    merged = led.select("space", "idx", "leader", "u").join(some, ["space", "leader"]).join(sums, ["space", "label"]).select("space", "idx", "leader", "label", "n", (dot / F.col("n")).alias("affinity"), F.least(F.lit(1.0), dot / norm).alias("to_mean"))
    rated = checkpoint(alone.unionByName(merged))
    angle = F.acos(F.greatest(F.lit(-1.0), "to_mean"))
    limit = math.acos(least)
    worst = rated.filter("n > 1").groupBy("space", "label").agg(F.max(angle).alias("far"), F.min("idx").alias("first"), F.max_by("idx", angle).alias("far_idx"))
    # the two widest angles settle most clusters
    second = rated.filter("n > 1").join(worst.select("space", "label", "far_idx", "far", "first"), ["space", "label"]).groupBy("space", "label").agg(F.max(F.when(F.col("idx") != F.col("far_idx"), angle)).alias("next"), F.first("far").alias("far"), F.first("first").alias("first"))
    judged = checkpoint(second.withColumn("settled", F.coalesce(F.col("far") + F.coalesce("next", F.lit(0.0)) <= limit, F.lit(False))))
    # vectors are fetched for the clusters that the angles do not settle, which are few
    open_leaders = small(placed_leaders.join(judged.filter("not settled").select("space", "label"), ["space", "label"]).select("space", "leader", "label", "n"))
    open_rows = rated.select("space", "idx", "leader", "to_mean").join(open_leaders.select("space", "leader"), ["space", "leader"], "left_semi")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / 8192)).cast("int")
    members = led.select("space", "idx", "leader", "u").join(open_leaders, ["space", "leader"]).join(open_rows, ["space", "idx", "leader"])
    members = members.select("space", F.col("label").alias("cluster"), "u", angle.alias("angle"), F.pmod(F.xxhash64("idx"), parts).cast("int").alias("part"), parts.alias("parts"))
    outer = members.filter(F.col("angle") > limit / 2).select(F.col("space").alias("outer_space"), F.col("cluster").alias("outer_cluster"), F.col("u").alias("outer_u"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("outer_part"))
    checked = outer.groupBy("outer_space", "outer_cluster", "outer_part").cogroup(members.select("space", "cluster", "part", "u").groupBy("space", "cluster", "part")).applyInArrow(_outer_check(least, dim), "space int, cluster long, holds boolean")
    held = checked.groupBy("space", F.col("cluster").alias("label")).agg(F.min("holds").alias("holds"))
    state = judged.join(held, ["space", "label"], "left").select("space", "label", "first", (F.col("settled") | F.coalesce("holds", F.lit(False))).alias("tight"))
    ends = met.select("space", "a", "b").join(label.select("space", F.col("leader").alias("a"), F.col("label").alias("label")), ["space", "a"]).join(label.select("space", F.col("leader").alias("b"), F.col("label").alias("other")), ["space", "b"])
    touched = ends.filter("label != other").select("space", "label").distinct().withColumn("touched", F.lit(True))
    out = rated.join(state, ["space", "label"], "left").join(touched, ["space", "label"], "left")
    out = out.select("space", F.coalesce("first", "idx").alias("cluster"), "idx", "affinity", F.col("n").alias("size"), F.coalesce("tight", F.lit(True)).alias("tight"), F.col("touched").isNull().alias("isolated"))
    name = F.get(F.array(*(F.lit(t) for t in tables)), F.col("space")).alias("table_name")
    return out.groupBy("space", "idx").agg(F.min(F.struct("cluster", "affinity", "size", "tight", "isolated")).alias("s")).select(name, "s.cluster", "idx", "s.affinity", "s.size", "s.tight", "s.isolated")


def describe(clusters: DataFrame, least_size: int = 2, typical: int = TYPICAL, by: tuple[str, ...] = ()) -> DataFrame:
    """Clusters of at least so many members: the columns `by` that a cluster's name counts in, cluster, size, tight, typical (idx of the members of the highest affinity, equal
    ones by idx), affinity (of the most typical)."""
    order = Window.partitionBy(*by, "cluster").orderBy(F.desc("affinity"), "idx")
    top = clusters.filter(F.col("size") >= least_size).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= typical)
    return top.groupBy(*by, "cluster").agg(F.max("size").alias("size"), F.min("tight").alias("tight"), F.transform(F.array_sort(F.collect_list(F.struct("r", "idx"))), lambda x: x["idx"]).alias("typical"), F.max("affinity").alias("affinity"))
