"""Exact nearest neighbours: by Hamming distance of codes, by cosine, by squared L2. Results are keyed by query id.

Strategy "gemm" (default): every corpus batch takes one matrix product with the queries and keeps its best R per query by one
integer key (distance, then idx); the partial results, R rows per query and batch, meet in a window that Spark limits by group
before it shuffles. Up to `QUERIES_AT_ONCE` queries are broadcast and the corpus stays where it is; more queries and the corpus
are cut into blocks by hashes of their ids, and every two blocks meet in one cogrouped plan. Strategy "postings" joins codes by the
units they share, in native operators only: for codes that share few units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes as code_fn
from ..functions import vec
from .encoders import matrix_of

#: The most queries of a broadcast, and of a block where there are more; rows of a block of the corpus.
QUERIES_AT_ONCE, BLOCK = 8_192, 16_384
#: Entries of a distance matrix held at once.
DISTANCES_AT_ONCE = 4_000_000


def _ranked(df: DataFrame, order: list, r: int | None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy("qidx").orderBy(*order)))
    return out if r is None else out.filter(F.col("rank") <= r)


def _excluding(corpus: DataFrame, exclude: DataFrame | None, key: str) -> DataFrame:
    """Without the ids of `exclude` (one column `key`)."""
    return corpus if exclude is None else corpus.join(exclude.select(key).distinct(), key, "left_anti")


#: Queries against some of the corpus, both as tables of an id and a value: the rows that go on.
Kernel = Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]]


def _hash_block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _each(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _meet(q: DataFrame, c: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """`kernel` over all queries (qidx, value) and all of the corpus (idx, value), in batches or blocks."""
    few = q.limit(QUERIES_AT_ONCE + 1).toArrow().combine_chunks()
    if not few.num_rows:
        return q.sparkSession.createDataFrame([], schema)
    if few.num_rows <= QUERIES_AT_ONCE:
        shared = q.sparkSession.sparkContext.broadcast(few)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from kernel(shared.value, pa.Table.from_batches([batch]))

        return c.mapInArrow(run, schema)
    q_names, c_names = q.columns, c.columns
    parts, blocks = -(-q.count() // QUERIES_AT_ONCE), -(-max(1, c.count()) // BLOCK)
    left = q.select(*q_names, _hash_block(q_names[0], parts).alias("__q"), _each(blocks).alias("__c"))
    right = c.select(*c_names, _hash_block(c_names[0], blocks).alias("__c"), _each(parts).alias("__q"))
    empty = kernel_schema(schema)

    def meet(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if not queries.num_rows or not corpus.num_rows:
            return empty.empty_table()
        met = list(kernel(queries.select(q_names).combine_chunks(), corpus.select(c_names).combine_chunks()))
        return pa.Table.from_batches(met) if met else empty.empty_table()

    return left.groupBy("__q", "__c").cogroup(right.groupBy("__q", "__c")).applyInArrow(meet, schema)


def kernel_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def _array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def best_rows(key: np.ndarray, r: int) -> np.ndarray:
    """Columns of the r smallest keys of every row, unordered."""
    if r >= key.shape[1]:
        return np.tile(np.arange(key.shape[1]), (key.shape[0], 1))
    return np.argpartition(key, r - 1, axis=1)[:, :r]


def hamming_top_r(queries: DataFrame, corpus: DataFrame, r: int, strategy: str = "gemm", exclude: DataFrame | None = None, exclude_self: bool = False, query_key: str = "idx", key: str = "idx", code: str = "code") -> DataFrame:
    """qidx, idx, distance, rank: for every query the min(r, N) nearest codes by (distance, idx).

    Codes of different size are compared by size(a) + size(b) - 2 shared. r = 0 or an empty corpus gives no rows. `exclude`
    names ids to leave out, `exclude_self` leaves out the query's own id. Null codes take no part. Ids may be text; they are
    then ordered by their bytes.
    """
    if r < 0:
        raise ValueError("r must not be negative")
    q = queries.filter(F.col(code).isNotNull()).select(F.col(query_key).cast("long").alias("qidx"), F.col(code).alias("qcode"))
    c = _excluding(corpus.filter(F.col(code).isNotNull()), exclude, key)
    c = c.select((F.col(key) if dict(c.dtypes)[key] == "string" else F.col(key).cast("long")).alias("idx"), F.col(code).alias("code"))
    if strategy == "postings":
        return _ranked(_by_postings(q, c, r, exclude_self), ["distance", "idx"], r)
    if strategy != "gemm":
        raise ValueError(f"unknown strategy {strategy!r}; expected gemm or postings")
    by_text = dict(c.dtypes)["idx"] == "string"
    if by_text and exclude_self:
        raise ValueError("exclude_self needs numeric ids")

    def best(ids: pa.Array, q_ids: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        rank_key = distance * n + np.arange(n)
        if exclude_self:
            own = q_ids[:, None] == ids.to_numpy(zero_copy_only=False)[None, :]
            rank_key[own] = np.iinfo(np.int64).max
        at = best_rows(rank_key, r)
        a, b = np.repeat(np.arange(len(q_ids)), at.shape[1]), at.ravel()
        if exclude_self:
            a, b = a[~own[a, b]], b[~own[a, b]]
        return pa.RecordBatch.from_arrays([pa.array(q_ids[a]), ids.take(pa.array(b)), pa.array(distance[a, b].astype(np.int32))], names=["qidx", "idx", "distance"])

    schema = f"qidx long, idx {'string' if by_text else 'long'}, distance int"
    out = _meet(q, c, _distances(best), schema) if r else q.sparkSession.createDataFrame([], schema)
    return _ranked(out, ["distance", "idx"], r)


def _by_postings(q: DataFrame, c: DataFrame, r: int, exclude_self: bool) -> DataFrame:
    """qidx, idx, distance of all codes that share a unit with the query, and of the r with the fewest units, of which any code
    that shares nothing and is among the r best must be one."""
    cs = c.withColumn("size", F.size("code"))
    met = q.select("qidx", F.size("qcode").alias("qsize"), F.explode("qcode").alias("unit")).join(cs.select("idx", "size", F.explode("code").alias("unit")), "unit")
    if exclude_self:
        met = met.filter(F.col("qidx") != F.col("idx"))
    near = met.groupBy("qidx", "idx").agg((F.min("qsize") + F.min("size") - 2 * F.count(F.lit(1)).cast("int")).alias("distance"))
    few = cs.select("size", "idx").orderBy("size", "idx").limit(r + int(exclude_self)).collect()  # r rows
    if not few:
        return near
    kind = dict(c.dtypes)["idx"]
    rest = F.explode(F.array(*(F.struct(F.lit(x.idx).cast(kind).alias("idx"), F.lit(x.size).alias("size")) for x in few)))
    filled = q.select("qidx", F.size("qcode").alias("qsize"), rest.alias("x")).select("qidx", "x.idx", (F.col("qsize") + F.col("x.size")).alias("distance"))
    if exclude_self:
        filled = filled.filter(F.col("qidx") != F.col("idx"))
    return near.unionByName(filled).groupBy("qidx", "idx").agg(F.min("distance").alias("distance"))


def hamming_extent(queries: DataFrame, corpus: DataFrame, query_key: str = "idx", code: str = "code") -> DataFrame:
    """qidx, low, high: the least and greatest distance of every query to the corpus."""
    q = queries.filter(F.col(code).isNotNull()).select(F.col(query_key).cast("long").alias("qidx"), F.col(code).alias("qcode"))
    c = corpus.filter(F.col(code).isNotNull()).select(F.lit(0).cast("long").alias("idx"), F.col(code).alias("code"))

    def ends(ids: pa.Array, q_ids: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(distance.min(1).astype(np.int32)), pa.array(distance.max(1).astype(np.int32))], names=["qidx", "low", "high"])

    return _meet(q, c, _distances(ends), "qidx long, low int, high int").groupBy("qidx").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _multi_hot(row: np.ndarray, unit: np.ndarray, rows: int, width: int) -> np.ndarray:
    out = np.zeros((rows, width), dtype=np.float32)
    inside = unit < width  # units that no query has share nothing
    out[row[inside], unit[inside]] = 1
    return out


def _distances(then) -> Kernel:
    """A kernel that applies `then` to (ids in order, query ids, matrix of Hamming distances)."""

    def kernel(queries: pa.Table, corpus: pa.Table) -> Iterator[pa.RecordBatch]:
        q_ids, q_codes = queries.column(0).to_numpy(), _array(queries.column(1))
        q_size, q_units = q_codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), q_codes.flatten().to_numpy(zero_copy_only=False)
        q_starts = np.r_[0, np.cumsum(q_size)]
        width = int(q_units.max(initial=0)) + 1
        ids, codes = _array(corpus.column(0)), _array(corpus.column(1))
        order = pc.sort_indices(ids)
        ids, codes = ids.take(order), codes.take(order)
        size = codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        hot = _multi_hot(np.repeat(np.arange(len(ids)), size), codes.flatten().to_numpy(zero_copy_only=False), len(ids), width).T
        step = max(1, DISTANCES_AT_ONCE // len(ids))
        for low in range(0, len(q_ids), step):
            high = min(len(q_ids), low + step)
            units = q_units[q_starts[low] : q_starts[high]]
            shared = _multi_hot(np.repeat(np.arange(high - low), q_size[low:high]), units, high - low, width) @ hot
            yield then(ids, q_ids[low:high], q_size[low:high, None] + size[None, :] - 2 * np.rint(shared).astype(np.int64))

    return kernel


def hamming_rank_all(queries: DataFrame, corpus: DataFrame, **options) -> DataFrame:
    """As hamming_top_r with every code of the corpus ranked; N rows per query."""
    q = queries.filter(F.col(options.get("code", "code")).isNotNull())
    n = corpus.count()
    return hamming_top_r(q, corpus, n, **options)


def cosine_top_r(queries: DataFrame, corpus: DataFrame, r: int, query_key: str = "idx", key: str = "idx", vec_col: str = "vec", exclude_self: bool = False) -> DataFrame:
    """qidx, idx, score, rank by (cosine falling, idx). Zero vectors have the score 0 with all; null vectors take no part."""
    return _dense_top_r(queries, corpus, r, query_key, key, vec_col, exclude_self, "cosine")


def l2_top_r(queries: DataFrame, corpus: DataFrame, r: int, query_key: str = "idx", key: str = "idx", vec_col: str = "vec", exclude_self: bool = False) -> DataFrame:
    """qidx, idx, score (squared L2), rank by (score, idx)."""
    return _dense_top_r(queries, corpus, r, query_key, key, vec_col, exclude_self, "l2")


def _dense_top_r(queries, corpus, r, query_key, key, vec_col, exclude_self, metric) -> DataFrame:
    if r < 0:
        raise ValueError("r must not be negative")
    q = queries.filter(F.col(vec_col).isNotNull()).select(F.col(query_key).cast("long").alias("qidx"), vec.as_double(vec_col).alias("qvec"))
    c = corpus.filter(F.col(vec_col).isNotNull()).select(F.col(key).cast("long").alias("idx"), vec.as_double(vec_col).alias("vec"))
    schema = "qidx long, idx long, score double, tied double"
    cosine = metric == "cosine"

    def kernel(queries: pa.Table, corpus: pa.Table) -> Iterator[pa.RecordBatch]:
        q_ids, column = queries.column(0).to_numpy(), _array(queries.column(1))
        qs = matrix_of(column, len(column[0]))
        idx, x = corpus.column(0).to_numpy(), matrix_of(_array(corpus.column(1)), qs.shape[1])
        qs, x = (vec.np_normalize(qs), vec.np_normalize(x)) if cosine else (qs, x)
        order = np.argsort(idx, kind="stable")
        idx, x = idx[order], x[order]
        step = max(1, DISTANCES_AT_ONCE // len(idx))
        for low in range(0, len(q_ids), step):
            part = qs[low : low + step]
            s = part @ x.T
            # all that may be among the r best by the product, then exactly: products differ in the last places
            size = 1.0 if cosine else (part**2).sum(1)[:, None] + (x**2).sum(1)[None, :]
            rough = -s if cosine else size - 2 * s
            if exclude_self:
                rough = np.where(q_ids[low : low + step, None] == idx[None, :], np.inf, rough)
            if r < len(idx):
                slack = 2e-12 + 4 * x.shape[1] * np.finfo(np.float64).eps * np.max(size, axis=None if cosine else 1)
                a, b = np.nonzero(~(rough > (np.partition(rough, r - 1, axis=1)[:, r - 1] + slack)[:, None]))
            else:
                a, b = np.repeat(np.arange(len(part)), len(idx)), np.tile(np.arange(len(idx)), len(part))
            if exclude_self:
                keep = q_ids[low + a] != idx[b]
                a, b = a[keep], b[keep]
            exact = np.empty(len(a))
            for at in range(0, len(a), pairs := max(1, 8_000_000 // x.shape[1])):
                left, right = part[a[at : at + pairs]], x[b[at : at + pairs]]
                exact[at : at + pairs] = (left * right).sum(1) if cosine else ((left - right) ** 2).sum(1)
            # equal to 12 places is equal: sums in another order differ beyond. Rows are in the order of idx
            tied = np.round(exact, 12)
            order = np.lexsort((b, -tied if cosine else tied, a))
            first = np.searchsorted(a[order], np.arange(len(part)))
            best = order[np.arange(len(a)) - first[a[order]] < r]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[low + a[best]]), pa.array(idx[b[best]]), pa.array(exact[best]), pa.array(tied[best])], names=["qidx", "idx", "score", "tied"])

    out = _meet(q, c, kernel, schema) if r else q.sparkSession.createDataFrame([], schema)
    return _ranked(out, [F.desc("tied") if cosine else F.col("tied"), F.col("idx")], r).drop("tied")
