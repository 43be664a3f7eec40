"""Most similar vectors for every vector (problem 2).

Adaptive dimension scan. Vectors are brought to unit length, rotated at random and stored in lists around coarse centres. A
query goes to its nearest lists, so many that a sample of queries finds what the whole corpus has; within a list the distance is
summed over blocks of columns, and after every block a hypothesis test (Gao and Long's bound for randomly rotated vectors)
abandons the candidates whose partial distance is too large for the k-th best so far, which falls from part to part of a list.
While many of a part survive, the next block is added for all its pairs by one product, else for the survivors one by one.
What survives is measured in full, exactly. Long lists are cut into blocks on both sides, each query block meeting each corpus
block of its list, so that no task holds more than a block of either side. Queries whose lists hold fewer than k scan the whole corpus.

Sparse codes have the same scan in their own space: bits are put in order of rarity, a code is stored in the lists of its
rarest bits, shared bits are counted over blocks of columns (for all pairs through the codes that have each bit), and a candidate
is abandoned as soon as the bits that are left cannot bring it to the k-th best. Here the test is a bound and the result exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import coarse
from .coarse import ONE_BLOCK, Blocks, Lists, block_of, count_blocks, fit, repeated
from .common import DIM, checkpoint, list_array, list_matrix, rotation, unit, usable_vector

K, EPSILON, COLUMNS = 5, 2.1, 16
#: Lists that every query probes at least; more, until so many of the sampled queries' true neighbours lie in them.
PROBES, RECALL, SAMPLED_QUERIES = 8, 0.998, 256
PAIRS_AT_ONCE = 2_000_000
#: Rows of a list that are scanned before the limit falls anew.
PART = 1_024
#: The share of a part's pairs that may stay for their next columns to be added one by one.
FEW_STAY = 0.05
#: Queries that meet a batch of the corpus at once, and the most that are broadcast for it (8.5 MB); more meet in blocks.
QUERIES_AT_ONCE, MOST_BROADCAST = 4_096, 16_384


def adaptive_scan(q: np.ndarray, c: np.ndarray, k: int, epsilon: float = EPSILON, columns: int = COLUMNS, stats: dict | None = None, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query row, candidate row) of at least the k candidates nearest to every query, by squared distance; both rotated.

    Candidates of which the test is `epsilon` sure that they are further than the k-th best so far are not among them. `most`:
    the squared distance of every query's k-th best among other vectors; then only candidates no further than it are given."""
    n, dim = c.shape
    if n <= k:
        return np.repeat(np.arange(len(q)), n), np.tile(np.arange(n), len(q))

    def factor(seen: int) -> float:
        return min(1.0, seen / dim * (1 + epsilon / np.sqrt(seen)) ** 2) if seen < dim else 1.0

    out_q, out_c = [], []
    step = max(1, PAIRS_AT_ONCE // min(n, PART))
    # at least k rows in the first part, which gives the first limit
    starts = list(range(0, n, max(PART, k)))
    if n - starts[-1] < k and len(starts) > 1:
        starts.pop()
    for low in range(0, len(q), step):
        part_q = q[low : low + step]
        q_sq = (part_q[:, :columns] ** 2).sum(1)
        limit = None if most is None else most[low : low + step] * (1 + 1e-9) + 1e-11
        best = None
        for start, end in zip(starts, [*starts[1:], n]):
            some = c[start:end]
            partial = np.maximum(q_sq[:, None] + (some[:, :columns] ** 2).sum(1)[None, :] - 2 * (part_q[:, :columns] @ some[:, :columns].T), 0)
            seeds = np.zeros((len(part_q), 0), np.int64)
            if limit is None:
                seeds = np.argpartition(partial, k - 1, axis=1)[:, :k] if k < len(some) else np.tile(np.arange(len(some)), (len(part_q), 1))
                best = np.sort(((part_q[:, None, :] - some[seeds]) ** 2).sum(2), axis=1)
                limit = best[:, -1] * (1 + 1e-9) + 1e-12
            stay = partial <= (limit * factor(columns))[:, None]
            many, done = np.count_nonzero(stay), min(dim, columns)
            if stats is not None:
                stats["pairs"] = stats.get("pairs", 0) + partial.size
                stats["after_first"] = stats.get("after_first", 0) + many
            # where many stay, products give the next columns of all pairs for less than those of the pairs that stay cost by themselves
            while done < dim and many > FEW_STAY * partial.size:
                w, x = part_q[:, done : done + columns], some[:, done : done + columns]
                partial += (w**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * (w @ x.T)
                done = min(dim, done + columns)
                if done == dim and k <= len(some):
                    limit = np.minimum(limit, np.partition(partial, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-11)
                    seeds = seeds[:, :0]  # the k nearest are no further than the limit
                stay = partial <= (limit * factor(done))[:, None]
                many = np.count_nonzero(stay)
            a, b = np.nonzero(stay)
            left = partial[a, b]
            for done in range(done, dim, columns):
                left = left + ((part_q[a, done : done + columns] - some[b, done : done + columns]) ** 2).sum(1)
                stays = left <= limit[a] * factor(min(dim, done + columns))
                a, b, left = a[stays], b[stays], left[stays]
            if end < n and best is not None and len(a):
                # the k best so far, of those before and of this part, set the limit for the next one
                who, value = np.concatenate([np.repeat(np.arange(len(best)), best.shape[1]), a]), np.concatenate([best.ravel(), left])
                if start == 0:
                    who, value = a, left
                order = np.lexsort((value, who))
                who, value = who[order], value[order]
                first = np.searchsorted(who, np.arange(len(best) + 1))
                enough = np.flatnonzero(np.diff(first) >= k)
                kth = value[first[enough] + k - 1]
                limit[enough] = np.minimum(limit[enough], kth * (1 + 1e-9) + 1e-12)
                best[enough] = value[first[enough][:, None] + np.arange(k)[None, :]]
            # the seeds may have failed the test themselves: they are candidates all the same
            out_q.append(np.concatenate([a, np.repeat(np.arange(len(part_q)), seeds.shape[1])]) + low)
            out_c.append(np.concatenate([b, seeds.ravel()]) + start)
    return np.concatenate(out_q), np.concatenate(out_c)


def best_k(query: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k greatest scores of every query, equal ones by item; a pair counts once."""
    order = np.lexsort((item, -score, query))
    q, i = query[order], item[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])] if len(q) else np.zeros(0, bool)
    order, q = order[new], q[new]
    if not len(order):
        return order
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return order[rank < k]


def _few_copies(idx: np.ndarray, u: np.ndarray, k: int) -> np.ndarray:
    """Rows without those of which k copies of a smaller idx are there: they cannot be among the k best of any query."""
    weights = np.random.default_rng(0).integers(1, 2**63, u.shape[1], dtype=np.uint64) | np.uint64(1)
    h = (np.ascontiguousarray(u).view(np.uint64) * weights).sum(1, dtype=np.uint64)
    order = np.lexsort((idx, h))
    starts = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    if len(starts) == len(h):
        return np.arange(len(h))
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(h)]))
    # the same row delivered twice counts once
    new = np.r_[True, (group[1:] != group[:-1]) | (idx[order][1:] != idx[order][:-1])]
    order, group = order[new], group[new]
    rank = np.arange(len(group)) - np.searchsorted(group, group)
    return np.sort(order[rank < k])


def _placer(lists: Lists, probes: int, dim: int, own: Blocks, other: Blocks, copies: int | None = None):
    """idx, vec -> list, own_block, other_block, idx, unit vector: a row for every probed list and block of the other side in it.
    copies: how many rows of the same vector are kept of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            idx = batch.column(0).to_numpy(zero_copy_only=False)
            u = unit(list_matrix(batch.column(1), dim))
            if copies is not None and len(keep := _few_copies(idx, u, copies)) < len(idx):
                idx, u = idx[keep], u[keep]
            near = lists.nearest(u, probes)
            row, at = np.repeat(np.arange(len(u)), near.shape[1]), near.ravel()
            copy, block = repeated(other.of(at))
            row, at = row[copy], at[copy]
            mine = block_of(idx[row], own.of(at))
            for low in range(0, len(row), 8192):
                s = slice(low, low + 8192)
                yield pa.RecordBatch.from_arrays([pa.array(at[s].astype(np.int32)), pa.array(mine[s].astype(np.int32)), pa.array(block[s].astype(np.int32)), pa.array(idx[row[s]]), list_array(u[row[s]])], names=["list", "own_block", "other_block", "idx", "u"])

    return run


def _scan_lists(k: int, dim: int, epsilon: float):
    turn = rotation(dim)

    def run(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        names = ["query_idx", "idx", "cosine"]
        if not queries.num_rows or not corpus.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        qi, ci = queries.column("idx").to_numpy(), corpus.column("idx").to_numpy()
        ci, first = np.unique(ci, return_index=True)
        q, c = list_matrix(queries.column("u"), dim), list_matrix(corpus.column("u"), dim)[first]
        most = 2 - 2 * queries.column("least").to_numpy() if "least" in queries.column_names else None
        a, b = adaptive_scan(q @ turn, c @ turn, k, epsilon, most=most)
        keep_a, keep_b, keep_s = [a[:0]], [ci[:0]], [np.zeros(0)]
        for low in range(0, len(a), PAIRS_AT_ONCE):
            s = slice(low, low + PAIRS_AT_ONCE)
            # copies of a vector, or the same direction at another length, are equal to 12 places
            score = np.round((q[a[s]] * c[b[s]]).sum(1), 12)
            best = best_k(a[s], ci[b[s]], score, k)
            keep_a.append(a[s][best]); keep_b.append(ci[b[s][best]]); keep_s.append(score[best])  # noqa: E702
        qa, cb, sc = (np.concatenate(x) for x in (keep_a, keep_b, keep_s))
        best = best_k(qa, cb, sc, k)
        return pa.table([pa.array(qi[qa[best]]), pa.array(cb[best]), pa.array(sc[best])], names=names)

    return run


def _scan_whole(queries: Broadcast, k: int, dim: int, epsilon: float):
    """Every batch of the corpus against all `queries` (idx, u, and `least`, the cosine of the k-th best of the probed lists)."""
    scan = _scan_lists(k, dim, epsilon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, rest = batch.column(0).to_numpy(zero_copy_only=False), np.arange(batch.num_rows)
            # an idx with several rows: one of them at a time, as an idx counts once among a query's best
            while len(rest):
                first = np.unique(idx[rest], return_index=True)[1]
                rows, rest = rest[first], np.delete(rest, first)
                u = unit(list_matrix(batch.column(1).take(pa.array(rows)), dim))
                corpus = pa.table([pa.array(idx[rows]), list_array(u)], names=["idx", "u"])
                for low in range(0, queries.value.num_rows, QUERIES_AT_ONCE):
                    yield from scan(queries.value.slice(low, QUERIES_AT_ONCE).combine_chunks(), corpus).to_batches()

    return run


def _united(dim: int):
    """The vectors (column 1) of batches brought to unit length, the other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[1] = list_array(unit(list_matrix(batch.column(1), dim))) if batch.num_rows else columns[1]
            yield pa.RecordBatch.from_arrays(columns, names=[n if n != "vec" else "u" for n in batch.schema.names])

    return run


def _hashed(parts: int) -> Column:
    return F.pmod(F.xxhash64("idx", "vec"), F.lit(parts)).cast("int")


def _beyond(near: DataFrame, asked: DataFrame, c: DataFrame, k: int, dim: int, epsilon: float) -> DataFrame:
    """query_idx, idx, cosine of all corpus vectors that may be among the k best of the queries in `asked` (idx, vec, least), given
    what the probed lists have (`near`). Few queries are broadcast, the corpus is not moved, and only what is good enough leaves
    a task; more queries and the corpus are cut into blocks and every two of them meet."""
    t = asked.limit(MOST_BROADCAST + 1).toArrow().combine_chunks()
    schema = "query_idx long, idx long, cosine double"
    if not t.num_rows:
        return near
    if t.num_rows <= MOST_BROADCAST:
        shared = near.sparkSession.sparkContext.broadcast(pa.table([t.column("idx"), list_array(unit(list_matrix(t.column("vec"), dim))), t.column("least")], names=["idx", "u", "least"]))
        more = c.mapInArrow(_scan_whole(shared, k, dim, epsilon), schema)
    else:
        asked = checkpoint(asked)
        parts, blocks = -(-asked.count() // QUERIES_AT_ONCE), -(-c.count() // (4 * coarse.BLOCK))
        left = asked.select("idx", "vec", "least", _hashed(parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        right = c.select("idx", "vec", _hashed(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        left, right = left.mapInArrow(_united(dim), "idx long, u array<double>, least double, part int, block int"), right.mapInArrow(_united(dim), "idx long, u array<double>, block int, part int")
        more = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_scan_lists(k, dim, epsilon), schema)
    return near.unionByName(more).groupBy("query_idx", "idx").agg(F.max("cosine").alias("cosine"))


def measured_probes(q: DataFrame, c: DataFrame, lists: Lists, k: int, dim: int, least: int = PROBES, recall: float = RECALL, sampled: int = SAMPLED_QUERIES) -> int:
    """How many lists a query must probe so that the share `recall` of the true neighbours of a sample of queries lies in them.
    The sample, chosen by a hash, is compared with all rows; what its k best are, and the places of their lists, tells."""
    some = q.orderBy(F.xxhash64("idx", F.lit(3)), "idx").limit(sampled).toArrow().combine_chunks()
    if not some.num_rows or lists.count <= least:
        return min(least, lists.count)
    u = unit(list_matrix(some.column("vec"), dim))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit(list_matrix(batch.column(1), dim))
                s = u @ x.T
                at = coarse.best_columns(s, min(k, s.shape[1]))
                home = lists.nearest(x[at.ravel()])[:, 0].reshape(at.shape)
                row = np.repeat(np.arange(len(u)), at.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(batch.column(0).to_numpy(zero_copy_only=False)[at.ravel()]), pa.array(np.take_along_axis(s, at, 1).ravel()), pa.array(home.ravel())], names=["row", "idx", "cosine", "home"])

    met = c.mapInArrow(best, "row long, idx long, cosine double, home long").groupBy("row", "idx").agg(F.max("cosine").alias("cosine"), F.min("home").alias("home"))
    order = Window.partitionBy("row").orderBy(F.desc("cosine"), "idx")
    table = met.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).toArrow()
    rows, homes = table.column("row").to_numpy(), table.column("home").to_numpy()
    if not len(rows):
        return min(least, lists.count)
    n = least
    while n < lists.count:
        near = lists.nearest(u, n)
        if (near[rows] == homes[:, None]).any(1).mean() >= recall:
            break
        n = min(lists.count, n + max(1, n // 4))
    return n


def _rows(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    return df.filter(usable_vector(vec, dim) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("idx"), F.col(vec).cast("array<double>").alias("vec"))


def nearest_vectors(queries: DataFrame, corpus: DataFrame, k: int = K, key: str = "idx", vec: str = "vec", dim: int = DIM, probes: int | None = None, epsilon: float = EPSILON, whole: bool = False) -> DataFrame:
    """The `k` corpus vectors of the highest cosine for every query: query_idx, idx, cosine, rank (from 1).

    Null keys and null, wrongly long, non-finite and zero vectors take no part; rows with the same idx count once; equal
    cosines (to 12 places) go to the smaller idx. A query finds itself if it is in the corpus. A query whose probed lists hold
    fewer than `k` vectors is compared with all, so it has fewer than `k` only if the corpus has. With `whole` all queries
    are, for those whose neighbours lie scattered: each meets every corpus vector's first columns, at least. The centres are
    fitted on a bounded sample (see `coarse`), the number of probed lists is measured (see `measured_probes`) unless it is given;
    every row is indexed.
    """
    q, c = _rows(queries, key, vec, dim), _rows(corpus, key, vec, dim)
    count = corpus.count()
    lists = fit(c, dim, count=count)
    if probes is None:
        probes = min(PROBES, lists.count) if whole else measured_probes(q, c, lists, k, dim)
    q_blocks, c_blocks = count_blocks(q, queries.count(), lists, probes, dim), count_blocks(c, count, lists, 1, dim)
    schema = "list int, own_block int, other_block int, idx long, u array<double>"
    left, right = q.mapInArrow(_placer(lists, probes, dim, q_blocks, c_blocks), schema), c.mapInArrow(_placer(lists, 1, dim, c_blocks, q_blocks, k), schema)
    left, right = left.withColumnsRenamed({"own_block": "qb", "other_block": "cb"}), right.withColumnsRenamed({"own_block": "cb", "other_block": "qb"})
    keys = ("list", "qb", "cb")
    met = left.groupBy(*keys).cogroup(right.select(*left.columns).groupBy(*keys)).applyInArrow(_scan_lists(k, dim, epsilon), "query_idx long, idx long, cosine double")
    once = met.groupBy("query_idx", "idx").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("query_idx").orderBy(F.desc("cosine"), "idx")
    near = checkpoint(once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    held = near.groupBy("query_idx").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).filter(F.col("n") >= k).select(F.col("query_idx").alias("idx"), "least")
    asked = q.distinct().join(held, "idx", "left") if whole else q.distinct().join(held, "idx", "left_anti").withColumn("least", F.lit(None).cast("double"))
    once = _beyond(near.drop("rank"), asked.withColumn("least", F.coalesce("least", F.lit(-1.0))), c, k, dim, epsilon)
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# ---- sparse codes

WIDTH, ACTIVE = 3200, 16
#: Rarest bits whose lists a code is met in, one number after the other.
PREFIXES = (4, 7)
WORDS_AT_ONCE = 10


def _pack(codes: np.ndarray, width: int) -> np.ndarray:
    """Sorted bit positions as rows of 64-bit words."""
    words = -(-width // 64)
    bits = np.zeros((len(codes), words * 64), dtype=np.uint8)
    bits[np.arange(len(codes))[:, None], codes] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _counted(q: np.ndarray, first: int, end: int, rows: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """How many of the bits first..end-1 every code of q shares with each of n codes; `rows` has the codes of each bit, from its `starts` on."""
    active = q.shape[1]
    held = np.where((q >= first) & (q < end), starts[q + 1] - starts[q], 0)
    total = np.cumsum(held.sum(1))
    out = np.empty((len(q), n), np.uint8)
    low = 0
    while low < len(q):
        high = max(low + 1, int(np.searchsorted(total, PAIRS_AT_ONCE + (total[low - 1] if low else 0), "right")))
        at, number = repeated(held[low:high].ravel())
        met = rows[starts[q[low:high].ravel()[at]] + number]
        out[low:high] = np.bincount(at // active * n + met, minlength=(high - low) * n).reshape(-1, n)
        low = high
    return out


def code_scan(q: np.ndarray, c: np.ndarray, k: int, width: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, shared bits) of all candidates that share as many bits as the k-th best or more, and no fewer
    than `floor` has for the query; of those that share nothing, the first k rows are enough.

    q, c: bit positions in the order of columns. Candidates whose remaining bits cannot reach the k-th best are abandoned."""
    n = len(c)
    words = -(-width // 64)
    bits = np.argsort(c, axis=None, kind="stable")
    rows, starts = bits // c.shape[1], np.searchsorted(c.ravel()[bits], np.arange(width + 1))
    ends = [min(words, e) for e in range(WORDS_AT_ONCE, words + WORDS_AT_ONCE, WORDS_AT_ONCE)]
    more_q = [(q >= end * 64).sum(1).astype(np.uint8) for end in ends]
    more_c = [(c >= end * 64).sum(1).astype(np.uint8) for end in ends]
    qw = cw = None
    out = ([], [], [])
    step = max(1, PAIRS_AT_ONCE // max(1, n))
    for low in range(0, len(q), step):
        part = q[low : low + step]
        shared = _counted(part, 0, min(width, ends[0] * 64), rows, starts, n)
        least = np.zeros(len(part), np.uint8) if floor is None else floor[low : low + step].astype(np.uint8)
        if n >= k:
            # bits of more columns only add to these
            least = np.maximum(least, np.partition(shared, n - k, axis=1)[:, n - k])
        stay = shared + np.minimum(more_q[0][low : low + step, None], more_c[0][None, :]) >= least[:, None]
        if np.count_nonzero(stay) > FEW_STAY * stay.size:
            # the other columns of all pairs at once
            shared += _counted(part, ends[0] * 64, width, rows, starts, n)
            if n >= k:
                least = np.maximum(least, np.partition(shared, n - k, axis=1)[:, n - k])
            stay = shared >= np.maximum(least, 1)[:, None]
            stay[least == 0, :k] = True
            a, b = np.nonzero(stay)
            left = shared[a, b]
        else:
            if qw is None:
                qw, cw = _pack(q, width), np.ascontiguousarray(_pack(c, width).T)
            w = qw[low : low + step]
            a, b = np.nonzero(stay)
            left = shared[a, b]
            for i, (start, end) in enumerate(zip(ends, ends[1:]), 1):
                for word in range(start, end):
                    left = left + np.bitwise_count(w[a, word] & cw[word, b])
                stays = left + np.minimum(more_q[i][low + a], more_c[i][b]) >= least[a]
                a, b, left = a[stays], b[stays], left[stays]
        for o, x in zip(out, (a + low, b, left.astype(np.int16))):
            o.append(x)
    return tuple(np.concatenate(o) for o in out)


def _scan_codes(k: int, width: int, active: int):
    def run(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        names = ["q_class", "c_class", "first_idx", "shared"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        if not queries.num_rows or not corpus.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        qi, ci = queries.column("class").to_numpy(), corpus.column("class").to_numpy()
        qi, qf = np.unique(qi, return_index=True)
        ci, cf = np.unique(ci, return_index=True)
        q = list_matrix(queries.column("code"), active)[qf].astype(np.int64)
        c = list_matrix(corpus.column("code"), active)[cf].astype(np.int64)
        # classes are named by their smallest idx
        floor = queries.column("least").to_numpy()[qf] if "least" in queries.column_names else None
        a, b, shared = code_scan(q, c, k, width, floor)
        best = best_k(a, ci[b], shared.astype(np.int64), k)
        return pa.table([pa.array(qi[a[best]]), pa.array(ci[b[best]]), pa.array(ci[b[best]]), pa.array(shared[best].astype(np.int32))], names=names)

    return run


def _scan_codes_whole(queries: Broadcast, k: int, width: int, active: int):
    """Every batch of the corpus's codes (class, code; bits in the order of columns) against all `queries`."""
    scan = _scan_codes(k, width, active)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from scan(queries.value, pa.Table.from_batches([batch])).to_batches()

    return run


def _placed_bits(place: np.ndarray, active: int):
    """class, code -> class, code with the bits in order of rarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = np.sort(place[list_matrix(batch.column(1), active).astype(np.int64)], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, active, dtype=np.int32)), pa.array(flat.ravel()))], names=["class", "code"])

    return run


def _poster(prefix: int, group: np.ndarray, own: np.ndarray, other: np.ndarray, active: int):
    """class, code -> a row for each group of lists that one of its `prefix` rarest bits is in, and each block of the other side
    there. own, other: blocks by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cls = batch.column(0).to_numpy(zero_copy_only=False)
            code = list_matrix(batch.column(1), active).astype(np.int64)
            pairs = np.unique(np.repeat(np.arange(len(cls)), prefix) * np.int64(1 << 20) + group[code[:, :prefix]].ravel())
            row, at = pairs >> 20, pairs & ((1 << 20) - 1)
            copy, block = repeated(other[at])
            row, at = row[copy], at[copy]
            mine = block_of(cls[row], own[at])
            for low in range(0, len(row), 16_384):
                s = slice(low, low + 16_384)
                flat = code[row[s]].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, active, dtype=np.int32)), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(at[s].astype(np.int32)), pa.array(mine[s].astype(np.int32)), pa.array(block[s].astype(np.int32)), pa.array(cls[row[s]]), lists], names=["list", "own_block", "other_block", "class", "code"])

    return run


def nearest_codes(queries: DataFrame, corpus: DataFrame, k: int = K, key: str = "idx", code: str = "code", width: int = WIDTH, active: int = ACTIVE) -> DataFrame:
    """The `k` corpus codes of the smallest Hamming distance for every query code: query_idx, idx, hamming, rank (from 1).

    A code takes part if it has `active` different bits of 0..width-1, in any order; null codes and keys do not. Rows with
    the same idx count once. Equal distances go to the smaller idx, also among codes that share nothing with the query.
    The result is exact. Codes that occur more than once are compared once; of each, the k smallest idx can matter.

    First every code is met in the lists of its rarest bits: codes that share `t` bits share one of the `active - t + 1`
    rarest, so lists of 4 bits find all that share 13 or more. Queries whose k-th best shares fewer are compared with all codes
    where they are few enough to be broadcast, else met in the lists of more bits, at last of all.
    """
    c_bit = F.array_sort(F.array_distinct(F.col(code)))
    ok = F.col(key).isNotNull() & F.coalesce((F.size(F.array_distinct(F.col(code))) == active) & F.forall(F.col(code), lambda x: x.isNotNull() & (x >= 0) & (x < width)), F.lit(False))

    def rows(df: DataFrame) -> DataFrame:
        return df.filter(ok).select(F.col(key).cast("long").alias("idx"), c_bit.cast("array<int>").alias("code")).distinct()

    q_rows, c_rows = rows(queries), rows(corpus)
    # one row per different code: at most k of its idx can be among a query's k best
    first = Window.partitionBy("code").orderBy("idx")
    c_cls = checkpoint(c_rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).groupBy("code").agg(F.min("idx").alias("class"), F.sort_array(F.collect_list("idx")).alias("ids")))
    q_all = checkpoint(q_rows.withColumn("class", F.min("idx").over(Window.partitionBy("code"))))
    q_cls = q_all.filter("idx = class").select("class", "code")
    # at most `width` rows
    held = {r.bit: r.n for r in c_cls.select(F.explode("code").alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = np.lexsort((np.arange(width), [held.get(b, 0) for b in range(width)]))  # rarest first
    place = np.empty(width, dtype=np.int32)
    place[order] = np.arange(width)
    c_cls_ids = c_cls.select(F.col("class").alias("c_class"), "ids")
    schema = "q_class long, c_class long, first_idx long, shared int"
    placed = {name: df.select("class", "code").mapInArrow(_placed_bits(place, active), "class long, code array<int>") for name, df in (("q", q_cls), ("c", c_cls))}

    def best_classes(met: DataFrame) -> DataFrame:
        best = Window.partitionBy("q_class").orderBy(F.desc("shared"), "first_idx")
        met = met.groupBy("q_class", "c_class").agg(F.max("shared").alias("shared"), F.min("first_idx").alias("first_idx"))
        return met.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("q_class", "c_class", "shared")

    def meet(qs: DataFrame, prefix: int) -> DataFrame:
        # lists are gathered to groups of a few thousand codes; longer ones are cut into blocks by a hash of the class, on both
        # sides, and every two blocks of a list meet
        counts = {side: np.zeros(width, dtype=np.int64) for side in "qc"}
        both = qs.select(F.lit("q").alias("side"), "code").unionByName(placed["c"].select(F.lit("c").alias("side"), "code"))
        for r in both.select("side", F.explode(F.slice("code", 1, prefix)).alias("bit")).groupBy("side", "bit").agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r.side][r.bit] = r.n
        group, at, filled = np.zeros(width, int), 0, 0
        for bit in range(width):
            if filled and filled + counts["c"][bit] > 2048:
                at, filled = at + 1, 0
            group[bit], filled = at, filled + counts["c"][bit]
        blocks = {}
        for side, n in counts.items():
            blocks[side] = np.maximum(1, -(-np.bincount(group, weights=n, minlength=width).astype(np.int64) // coarse.BLOCK))
        kinds = "list int, own_block int, other_block int, class long, code array<int>"
        left = qs.mapInArrow(_poster(prefix, group, blocks["q"], blocks["c"], active), kinds).withColumnsRenamed({"own_block": "qb", "other_block": "cb"})
        right = placed["c"].mapInArrow(_poster(prefix, group, blocks["c"], blocks["q"], active), kinds).withColumnsRenamed({"own_block": "cb", "other_block": "qb"})
        keys = ("list", "qb", "cb")
        return best_classes(left.groupBy(*keys).cogroup(right.select(*left.columns).groupBy(*keys)).applyInArrow(_scan_codes(k, width, active), schema))

    def whole(few: pa.Table) -> DataFrame:
        shared = queries.sparkSession.sparkContext.broadcast(few)
        return best_classes(placed["c"].mapInArrow(_scan_codes_whole(shared, k, width, active), schema))

    def expanded(met: DataFrame) -> DataFrame:
        ids = met.join(c_cls_ids, "c_class").select("q_class", F.explode("ids").alias("idx"), "shared")
        best = Window.partitionBy("q_class").orderBy(F.desc("shared"), "idx")
        return ids.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    out, rest = None, placed["q"]
    for prefix in PREFIXES:
        near = checkpoint(expanded(meet(rest, min(prefix, active))))
        # complete where k are found and the k-th shares more than an unmet code can
        complete = near.groupBy("q_class").agg(F.count(F.lit(1)).alias("n"), F.min("shared").alias("least")).filter((F.col("n") == k) & (F.col("least") > active - prefix)).select("q_class")
        found = near.join(complete, "q_class", "left_semi").select("q_class", "idx", "shared", "rank")
        out = found if out is None else out.unionByName(found)
        rest = rest.join(complete, rest["class"] == complete["q_class"], "left_anti")
        # what k of them share already: others must share as much
        met = near.groupBy("q_class").agg(F.count(F.lit(1)).alias("n"), F.min("shared").alias("least")).filter(F.col("n") >= k).select(F.col("q_class").alias("class"), "least")
        few = rest.join(met, "class", "left").select("class", "code", F.coalesce("least", F.lit(0)).alias("least")).limit(MOST_BROADCAST + 1).toArrow().combine_chunks()
        if few.num_rows <= MOST_BROADCAST:
            break
        rest = checkpoint(rest)
    if 0 < few.num_rows <= MOST_BROADCAST:
        found = expanded(whole(few)).select("q_class", "idx", "shared")
        both = found.unionByName(near.join(complete, "q_class", "left_anti").select(*found.columns)).groupBy("q_class", "idx").agg(F.max("shared").alias("shared"))
        best = Window.partitionBy("q_class").orderBy(F.desc("shared"), "idx")
        out = out.unionByName(both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
    elif few.num_rows:
        far = expanded(meet(rest, active)).select("q_class", "idx", "shared")
        # of codes that share nothing, the smallest idx fill up
        fill = [r.idx for r in c_rows.select("idx").distinct().orderBy("idx").limit(2 * k).collect()]
        filling = rest.select(F.col("class").alias("q_class"), F.explode(F.array(*(F.lit(i).cast("long") for i in fill)) if fill else F.array().cast("array<long>")).alias("idx"), F.lit(0).alias("shared"))
        both = far.unionByName(filling).groupBy("q_class", "idx").agg(F.max("shared").alias("shared"))
        best = Window.partitionBy("q_class").orderBy(F.desc("shared"), "idx")
        out = out.unionByName(both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
    named = q_all.select(F.col("class").alias("q_class"), F.col("idx").alias("query_idx"))
    return out.join(named, "q_class").select("query_idx", "idx", (2 * active - 2 * F.col("shared")).alias("hamming"), "rank")
