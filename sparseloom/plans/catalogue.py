"""Named queries over the test tables, each with the SQL that must give the same rows.

Weights are coded by integers, so that SQL builds the same ones in place; there are M units over D entries, K of them active.
Vectors come from `embeddings`; the queries of retrieval are the rows whose vec_id is divisible by 50, against all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, text, topk, vec
from ..operators import metrics, retrieval, splits, textprep
from ..operators.encoders import Encoder, HebbianConfig, ProjectionConfig, SignConfig, encode, score_rows
from ..operators.segments import SegmentedIndex, merge_candidates, segment_candidates
from ..operators.trainer import train, train_more, weights_frame
from ..session import checkpoint, remove, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

D, M, K, R = 64, 160, 8, 10


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return add


# ---- inputs


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def coded_weights(m: int = M, dim: int = D, seed: int = 0) -> np.ndarray:
    mu, i = np.meshgrid(np.arange(m), np.arange(dim), indexing="ij")
    base = modulus(m)
    return ((mu * 7919 + i * 104729 + mu * i * 31 + seed * 613) % base - base // 2) / (base // 2)


def modulus(m: int) -> int:
    """A prime beyond the number of units, so that no two are the same."""
    return 2003 if m < 2003 else 6007


def hebbian(m: int = M, k: int = K, seed: int = 0, **more) -> Encoder:
    return Encoder(HebbianConfig(D, m, k, **more), coded_weights(m, seed=seed))


#: The width of the published setting: 32 of 3,200 units.
WIDE_M, WIDE_K = 3200, 32


def projection() -> Encoder:
    mu, i = np.meshgrid(np.arange(M), np.arange(D), indexing="ij")
    return Encoder(ProjectionConfig(D, M, K), np.where((mu * 37 + i * 11) % 10 == 0, coded_weights(), 0.0))


def is_query(c: str = "idx"):
    return F.col(c) % 50 == 0


def coded(spark: SparkSession, d: str) -> DataFrame:
    return encode(embeddings(spark, d), hebbian(), keep=("idx", "label"))


# ---- SQL pieces

_W = "((mu * 7919 + i * 104729 + mu * i * 31 + {seed} * 613) % {base} - {base} // 2) / ({base} // 2)::DOUBLE"
_E = "e AS (SELECT vec_id AS idx, embedding::DOUBLE[] AS vec, label FROM embeddings)"


def _scores(m: int = M, seed: int = 0, mask: str = "TRUE", source: str = "e") -> str:
    w = _W.format(seed=seed, base=modulus(m))
    return f"""w AS (SELECT mu, list(CASE WHEN {mask} THEN {w} ELSE 0 END ORDER BY i) AS w FROM range({m}) a(mu), range({D}) b(i) GROUP BY mu),
s AS (SELECT idx, mu, list_dot_product(vec, w) AS score FROM {source}, w)"""


def _codes(name: str = "c", k: int = K, **scores) -> str:
    return f"""{_scores(**scores)},
{name} AS (SELECT idx, list(mu::INTEGER ORDER BY mu) AS code FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, mu) AS r FROM s) WHERE r <= {k} GROUP BY idx)"""


_DIST = "len(a.code) + len(b.code) - 2 * len(list_intersect(a.code, b.code))"


def _ranked(extra: str = "TRUE", r: int | None = R) -> str:
    keep = "" if r is None else f"WHERE rank <= {r}"
    return f"""r AS (SELECT * FROM (SELECT a.idx AS qidx, b.idx AS idx, ({_DIST})::INTEGER AS distance,
  row_number() OVER (PARTITION BY a.idx ORDER BY {_DIST}, b.idx)::INTEGER AS rank FROM c a, c b WHERE a.idx % 50 = 0 AND {extra}) {keep})"""


# ---- vector algebra


@query(f"WITH {_E} SELECT a.idx, b.idx AS idx_b, round(list_dot_product(a.vec, b.vec), 6) AS dot FROM e a JOIN e b ON b.idx = a.idx + 1")
def vec_dot(spark, d):
    return _neighbours(spark, d, vec.dot("vec", "vec_b"), "dot")


@query(f"WITH {_E} SELECT a.idx, b.idx AS idx_b, round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS l2sq FROM e a JOIN e b ON b.idx = a.idx + 1")
def vec_l2sq(spark, d):
    return _neighbours(spark, d, vec.squared_l2("vec", "vec_b"), "l2sq")


@query(f"WITH {_E} SELECT a.idx, b.idx AS idx_b, round(list_cosine_similarity(a.vec, b.vec), 6) AS cosine FROM e a JOIN e b ON b.idx = a.idx + 1")
def vec_cosine(spark, d):
    return _neighbours(spark, d, vec.cosine("vec", "vec_b"), "cosine")


@query(f"WITH {_E} SELECT a.idx, b.idx AS idx_b, round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: abs(x[1]) * x[1] * x[2])), 6) AS score FROM e a JOIN e b ON b.idx = a.idx + 1")
def vec_weighted_score_p3(spark, d):
    return _neighbours(spark, d, vec.weighted_score("vec", "vec_b", 3), "score")


def _neighbours(spark, d, value, name):
    e = embeddings(spark, d)
    b = e.select((F.col("idx") - 1).alias("idx"), F.col("idx").alias("idx_b"), F.col("vec").alias("vec_b"))
    return e.join(b, "idx").select("idx", "idx_b", F.round(value, 6).alias(name))


for _p, _sql in ((1, "list_sum(list_transform(vec, lambda x: abs(x)))"), (2, "sqrt(list_dot_product(vec, vec))"), (3, "pow(list_sum(list_transform(vec, lambda x: pow(abs(x), 3))), 1.0 / 3)")):

    def _norm(spark, d, p=_p):
        return embeddings(spark, d).select("idx", F.round(vec.p_norm("vec", p), 6).alias("norm"))

    _norm.__name__ = f"vec_pnorm_{_p}"
    query(f"WITH {_E} SELECT idx, round({_sql}, 6) AS norm FROM e")(_norm)


@query(f"WITH {_E} SELECT idx, list_transform(vec, lambda x: round(x / list_sum(list_transform(vec, lambda y: abs(y))), 6)) AS unit FROM e")
def vec_normalize_p1(spark, d):
    return embeddings(spark, d).select("idx", F.transform(vec.normalize("vec", 1), lambda x: F.round(x, 6)).alias("unit"))


@query(f"WITH {_E} SELECT idx, list_transform(list_transform(vec, lambda x: x * 3), lambda x: round(x / (3 * sqrt(list_dot_product(vec, vec))), 6)) AS unit FROM e")
def vec_normalize(spark, d):
    scaled = F.transform("vec", lambda x: x * 3)
    return embeddings(spark, d).select("idx", F.transform(vec.normalize(scaled), lambda x: F.round(x, 6)).alias("unit"))


# ---- scores and top k


@query(f"WITH {_E}, {_scores()} SELECT idx, list(round(score, 6) ORDER BY mu) AS scores FROM s GROUP BY idx")
def score_gemv(spark, d):
    return score_rows(embeddings(spark, d), hebbian()).select("idx", F.transform("scores", lambda x: F.round(x, 6)).alias("scores"))


def _score16(spark, d):
    return embeddings(spark, d).select("idx", vec.scores(coded_weights(16), "vec").alias("scores"))


_S16 = f"WITH {_E}, {_scores(16)}, k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY score DESC, mu) AS r FROM s)"


@query(f"{_S16} SELECT idx, list(mu::INTEGER ORDER BY mu) AS units FROM k WHERE r <= 4 GROUP BY idx")
def topk_indices(spark, d):
    return _score16(spark, d).select("idx", topk.top_k_indices("scores", 4).alias("units"))


@query(f"{_S16} SELECT idx, list(mu::INTEGER ORDER BY r) AS units FROM k GROUP BY idx")
def rank_indices(spark, d):
    return _score16(spark, d).select("idx", topk.rank_indices("scores").alias("units"))


@query(f"{_S16} SELECT idx, list(mu::INTEGER ORDER BY r) AS units FROM k WHERE r <= 3 GROUP BY idx")
def top_ranked(spark, d):
    return _score16(spark, d).select("idx", topk.top_ranked("scores", 3).alias("units"))


# ---- encoding


@query(f"WITH {_E}, {_codes()} SELECT idx, code FROM c")
def encode_hebbian(spark, d):
    return encode(embeddings(spark, d), hebbian())


@query(f"WITH {_E}, {_codes(m=16, k=4)} SELECT idx, code FROM c")
def encode_columns(spark, d):
    return encode(embeddings(spark, d), hebbian(16, 4), engine="hof")


@query(f"WITH {_E}, {_codes(m=WIDE_M, k=WIDE_K)} SELECT idx, code FROM c")
def encode_wide(spark, d):
    """Codes at the published width."""
    return encode(embeddings(spark, d), hebbian(WIDE_M, WIDE_K))


@query(f"WITH {_E}, {_codes(m=WIDE_M, k=WIDE_K)}, {_ranked()} SELECT * FROM r")
def hamming_topr_wide(spark, d):
    c = checkpoint(encode(embeddings(spark, d), hebbian(WIDE_M, WIDE_K)))
    return retrieval.hamming_top_r(c.filter(is_query()), c, R)


@query(f"WITH {_E}, {_codes(mask='(mu * 37 + i * 11) % 10 = 0')} SELECT idx, code FROM c")
def encode_projection(spark, d):
    return encode(embeddings(spark, d), projection())


@query(f"WITH {_E}, {_scores(16)} SELECT e.idx, coalesce(x.code, []::INTEGER[]) AS code FROM e LEFT JOIN (SELECT idx, list(mu::INTEGER ORDER BY mu) AS code FROM s WHERE score > 0 GROUP BY idx) x USING (idx)")
def encode_sign(spark, d):
    return encode(embeddings(spark, d), Encoder(SignConfig(D, 16), coded_weights(16)))


@query(f"WITH {_E}, {_codes()} SELECT a.idx, len(list_intersect(a.code, b.code))::INTEGER AS shared FROM c a JOIN c b ON b.idx = a.idx + 1")
def code_intersection(spark, d):
    return _code_neighbours(spark, d, codes.intersection_size("code", "code_b"), "shared")


@query(f"WITH {_E}, {_codes()} SELECT a.idx, ({_DIST})::INTEGER AS distance FROM c a JOIN c b ON b.idx = a.idx + 1")
def hamming_pairs(spark, d):
    return _code_neighbours(spark, d, codes.hamming("code", "code_b"), "distance")


def _code_neighbours(spark, d, value, name):
    c = coded(spark, d)
    b = c.select((F.col("idx") - 1).alias("idx"), F.col("code").alias("code_b"))
    return c.join(b, "idx").select("idx", value.alias(name))


# ---- retrieval


@query(f"WITH {_E}, {_codes()}, {_ranked()} SELECT * FROM r")
def hamming_topr(spark, d):
    c = coded(spark, d)
    return retrieval.hamming_top_r(c.filter(is_query()), c, R)


@query(f"WITH {_E}, {_codes()}, {_ranked()} SELECT * FROM r")
def hamming_topr_join(spark, d):
    c = coded(spark, d)
    return retrieval.hamming_top_r(c.filter(is_query()), c, R, strategy="postings")


@query(f"WITH {_E}, {_codes()}, {_ranked('a.idx <> b.idx')} SELECT * FROM r")
def hamming_topr_exclude_self(spark, d):
    c = coded(spark, d)
    return retrieval.hamming_top_r(c.filter(is_query()), c, R, exclude_self=True)


@query(f"WITH {_E}, {_codes()}, {_ranked('b.idx % 3 <> 0')} SELECT * FROM r")
def hamming_topr_exclude_set(spark, d):
    c = coded(spark, d)
    return retrieval.hamming_top_r(c.filter(is_query()), c, R, exclude=c.filter("idx % 3 = 0"))


@query(f"WITH {_E}, {_codes()}, {_ranked(r=None)} SELECT * FROM r")
def hamming_rank_all(spark, d):
    c = coded(spark, d)
    return retrieval.hamming_rank_all(c.filter(is_query()), c)


_COS = f"""cr AS (SELECT *, row_number() OVER (PARTITION BY qidx ORDER BY s DESC, idx)::INTEGER AS rank FROM (
  SELECT a.idx AS qidx, b.idx AS idx, round(list_cosine_similarity(a.vec, b.vec), 12) AS s FROM e a, e b WHERE a.idx % 50 = 0) QUALIFY rank <= {R})"""


@query(f"WITH {_E}, {_COS} SELECT qidx, idx, rank, round(s, 6) AS score FROM cr")
def cosine_topr(spark, d):
    e = embeddings(spark, d)
    return retrieval.cosine_top_r(e.filter(is_query()), e, R).withColumn("score", F.round("score", 6))


@query(f"""WITH {_E} SELECT qidx, idx, round(s, 6) AS score FROM (SELECT a.idx AS qidx, b.idx AS idx,
  round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 12) AS s FROM e a, e b WHERE a.idx % 50 = 0 AND a.idx <> b.idx)
QUALIFY row_number() OVER (PARTITION BY qidx ORDER BY s, idx) = 1""")
def l2_nearest(spark, d):
    e = embeddings(spark, d)
    return retrieval.l2_top_r(e.filter(is_query()), e, 1, exclude_self=True).select("qidx", "idx", F.round("score", 6).alias("score"))


# ---- training: SQL folds the same steps with the weights as a list of lists


_TRAIN_M = 8


def _trained(spark, d, **more):
    return train_more(embeddings(spark, d), hebbian(_TRAIN_M, 2, learning_rate=0.05, **more), epochs=1, shuffle=False)


def _train_sql(delta: float = 0.0, anti: int = 2) -> str:
    w = _W.format(seed=0, base=modulus(_TRAIN_M))
    unit = lambda row: f"list_transform({row}, lambda q: q / sqrt(list_dot_product({row}, {row})))"
    gain = f"CASE WHEN mu = best THEN 1.0 WHEN {delta} <> 0 AND mu = other THEN -{delta} ELSE 0.0 END"
    return f"""
WITH RECURSIVE {_E},
t AS (SELECT row_number() OVER (ORDER BY idx) AS n, vec FROM e),
w0 AS (SELECT mu, list({w} ORDER BY i) AS w FROM range({_TRAIN_M}) a(mu), range({D}) b(i) GROUP BY mu),
f AS (
  SELECT 0::BIGINT AS n, (SELECT list(w ORDER BY mu) FROM w0) AS w
  UNION ALL
  SELECT n, list(CASE WHEN gain = 0 THEN wm ELSE {unit("up")} END ORDER BY mu) FROM (
    SELECT n, mu, wm, gain, list_transform(list_zip(wm, vec), lambda z: z[1] + 0.05 * gain * (z[2] - sc * z[1])) AS up FROM (
      SELECT *, {gain} AS gain FROM (
        SELECT *, max(CASE WHEN rk = 1 THEN mu END) OVER (PARTITION BY n) AS best, max(CASE WHEN rk = {anti} THEN mu END) OVER (PARTITION BY n) AS other FROM (
          SELECT *, row_number() OVER (PARTITION BY n ORDER BY sc DESC, mu) AS rk FROM (
            SELECT t.n, mu, f.w[mu + 1] AS wm, t.vec, list_dot_product(f.w[mu + 1], t.vec) AS sc FROM f JOIN t ON t.n = f.n + 1, range({_TRAIN_M}) u(mu)))))) GROUP BY n
)
"""


_LAST = f"(SELECT w FROM f WHERE n = (SELECT max(n) FROM f))"
_WEIGHTS = f"SELECT mu::INTEGER AS mu, list_transform({_LAST}[mu + 1], lambda x: round(x, 6)) AS w FROM range({_TRAIN_M}) u(mu)"


def _rounded_weights(spark, encoder):
    return weights_frame(spark, encoder).select("mu", F.transform("w", lambda x: F.round(x, 6)).alias("w"))


@query(_train_sql() + _WEIGHTS)
def train_winner_take_all(spark, d):
    return _rounded_weights(spark, _trained(spark, d))


@query(_train_sql(0.2, 3) + _WEIGHTS)
def train_anti_winner(spark, d):
    return _rounded_weights(spark, _trained(spark, d, delta=0.2, anti_winner_rank=3))


@query(_train_sql() + f"""SELECT idx, list(mu::INTEGER ORDER BY mu) AS code FROM (SELECT idx, mu, row_number() OVER (PARTITION BY idx ORDER BY list_dot_product(w.w[mu + 1], vec) DESC, mu) AS r
FROM e, (SELECT {_LAST} AS w) w, range({_TRAIN_M}) u(mu)) WHERE r <= 2 GROUP BY idx""")
def train_then_encode(spark, d):
    return encode(embeddings(spark, d), _trained(spark, d))


@query()
def train_wide(spark, d):
    """Units learned at the published width in three epochs, and the ranking by their codes."""
    e = embeddings(spark, d)
    encoder = train(e.select("idx", "vec"), HebbianConfig(D, WIDE_M, WIDE_K, epochs=3, normalize_inputs=True, seed=42))
    c = checkpoint(encode(e, encoder))
    return retrieval.hamming_top_r(c.filter(is_query()), c, R)


# ---- metrics. Judgements from labels: same label 1, among the 5 nearest by cosine 2.

_LABELS = "q AS (SELECT idx AS qid, label FROM e WHERE idx % 50 = 0)"
_HITS = "h AS (SELECT r.qidx AS qid, r.idx AS did, r.rank FROM r)"
_BASE = f"WITH {_E}, {_codes()}, {_ranked()}, {_LABELS}, {_HITS}"
_AP = """ap AS (SELECT q.qid, coalesce(sum(x.found / x.rank::DOUBLE), 0) / n.n AS ap FROM q JOIN (SELECT label, count(*) AS n FROM e GROUP BY label) n USING (label)
  LEFT JOIN (SELECT h.qid, h.rank, row_number() OVER (PARTITION BY h.qid ORDER BY h.rank) AS found FROM h JOIN q USING (qid) JOIN e ON e.idx = h.did AND e.label = q.label) x ON x.qid = q.qid GROUP BY q.qid, n.n)"""


def _ranking(spark, d):
    return hamming_topr(spark, d).select(F.col("qidx").alias("qid"), F.col("idx").alias("did"), "rank")


def _labels(spark, d):
    e = embeddings(spark, d)
    return e.filter(is_query()).select(F.col("idx").alias("qid"), "label"), e.select(F.col("idx").alias("did"), "label")


@query(f"{_BASE}, {_AP} SELECT qid, round(ap, 6) AS ap FROM ap")
def ap_at_r(spark, d):
    q, db = _labels(spark, d)
    return metrics.average_precision_by_label(_ranking(spark, d), q, db, R).withColumn("ap", F.round("ap", 6))


@query(f"{_BASE}, {_AP} SELECT round(avg(ap), 6) AS map FROM ap")
def map_by_label(spark, d):
    q, db = _labels(spark, d)
    return metrics.mean_average_precision(metrics.average_precision_by_label(_ranking(spark, d), q, db, R)).select(F.round("map", 6).alias("map"))


_TRUTH = f"t AS (SELECT qidx AS qid, idx AS did, rank FROM cr WHERE rank = 2)"


def _truth(spark, d):
    return cosine_topr(spark, d).filter("rank = 2").select(F.col("qidx").alias("qid"), F.col("idx").alias("did"))


@query(f"{_BASE}, {_COS}, {_TRUTH} SELECT round(avg((h.qid IS NOT NULL)::INTEGER), 6) AS recall FROM t LEFT JOIN h ON h.qid = t.qid AND h.did = t.did")
def recall_at_r(spark, d):
    return metrics.recall_at_r(_ranking(spark, d), _truth(spark, d), R).select(F.round("recall", 6).alias("recall"))


@query(f"{_BASE}, {_COS}, {_TRUTH} SELECT round(avg(coalesce(1.0::DOUBLE / h.rank, 0)), 6) AS mrr FROM t LEFT JOIN h ON h.qid = t.qid AND h.did = t.did")
def mrr(spark, d):
    return metrics.mrr(_ranking(spark, d), _truth(spark, d)).select(F.round("mrr", 6).alias("mrr"))


@query(f"{_BASE}, {_COS} SELECT round(avg(x), 6) AS recall FROM (SELECT cr.qidx, count(h.did)::DOUBLE / count(*) AS x FROM cr LEFT JOIN h ON h.qid = cr.qidx AND h.did = cr.idx GROUP BY cr.qidx)")
def recall_at_topk(spark, d):
    truth = cosine_topr(spark, d).select(F.col("qidx").alias("qid"), F.col("idx").alias("did"))
    q, _ = _labels(spark, d)
    return metrics.recall_at_top_k(_ranking(spark, d), truth, q, R).select(F.round("recall", 6).alias("recall"))


_QRELS = "j AS (SELECT q.qid, e.idx AS did, CASE WHEN cr.rank <= 5 THEN 2 ELSE 1 END AS score FROM q JOIN e USING (label) LEFT JOIN cr ON cr.qidx = q.qid AND cr.idx = e.idx)"
_GAINS = """g AS (SELECT j.qid, sum(CASE WHEN h.rank <= 10 THEN j.score / log2(h.rank + 1) END) AS dcg, count(h.did) AS found, count(*) AS relevant FROM j LEFT JOIN h USING (qid, did) GROUP BY j.qid),
i AS (SELECT qid, sum(score / log2(n + 1)) AS ideal FROM (SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS n FROM j) WHERE n <= 10 GROUP BY qid),
p AS (SELECT qid, sum(found / rank::DOUBLE) AS p FROM (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS found FROM h JOIN j USING (qid, did)) GROUP BY qid)"""


def _qrels(spark, d):
    q, db = _labels(spark, d)
    near = cosine_topr(spark, d).filter("rank <= 5").select(F.col("qidx").alias("qid"), F.col("idx").alias("did"), F.lit(2).alias("near"))
    return q.join(db, "label").join(near, ["qid", "did"], "left").select("qid", "did", F.coalesce("near", F.lit(1)).alias("score"))


@query(f"{_BASE}, {_COS}, {_QRELS}, {_GAINS} SELECT qid, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM g JOIN i USING (qid)")
def ndcg10(spark, d):
    return metrics.ndcg(_ranking(spark, d), _qrels(spark, d), 10).withColumn("ndcg", F.round("ndcg", 6))


@query(f"{_BASE}, {_COS}, {_QRELS}, {_GAINS} SELECT round(avg(coalesce(p, 0) / relevant), 6) AS map FROM g LEFT JOIN p USING (qid)")
def map_qrels(spark, d):
    return metrics.mean_average_precision(metrics.average_precision(_ranking(spark, d), _qrels(spark, d), 100)).select(F.round("map", 6).alias("map"))


@query(f"{_BASE}, {_COS}, {_QRELS}, {_GAINS} SELECT round(sum(found) / sum(relevant), 6) AS micro_recall FROM g")
def micro_recall(spark, d):
    return metrics.micro_recall(_ranking(spark, d), _qrels(spark, d), 10).select(F.round("micro_recall", 6).alias("micro_recall"))


@query(f"""{_BASE}, {_COS}, {_QRELS}, {_GAINS} SELECT round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg_10, round(avg(coalesce(p, 0) / relevant), 6) AS map_100,
  round(sum(found) / sum(relevant), 6) AS recall_10, round(sum(found) / sum(relevant), 6) AS recall_100 FROM g JOIN i USING (qid) LEFT JOIN p USING (qid)""")
def metric_set(spark, d):
    m = metrics.metric_set(_ranking(spark, d), _qrels(spark, d))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


@query(f"""WITH {_E}, {_codes()}, {_ranked(r=None)}, x AS (SELECT a.idx AS qidx, b.idx AS idx, row_number() OVER (PARTITION BY a.idx ORDER BY round(list_cosine_similarity(a.vec, b.vec), 12) DESC, b.idx) AS crank FROM e a, e b WHERE a.idx % 50 = 0)
SELECT r.qidx AS qid, round(corr(r.rank::DOUBLE, x.crank::DOUBLE), 6) AS rho FROM r JOIN x USING (qidx, idx) GROUP BY r.qidx""")
def spearman(spark, d):
    e = embeddings(spark, d)
    rename = lambda df: df.select(F.col("qidx").alias("qid"), F.col("idx").alias("did"), "rank")
    return metrics.spearman(rename(hamming_rank_all(spark, d)), rename(retrieval.cosine_top_r(e.filter(is_query()), e, e.count()))).withColumn("rho", F.round("rho", 6))


_VALID = "vec IS NOT NULL AND len(vec) = 64 AND list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND isfinite(x)))"


@query(f"""WITH c AS (SELECT DISTINCT idx, id, vec FROM corpus WHERE {_VALID}), q AS (SELECT DISTINCT idx, id, vec FROM queries WHERE {_VALID}),
h AS (SELECT q.id AS qid, c.id AS did, row_number() OVER (PARTITION BY q.idx ORDER BY round(list_cosine_similarity(q.vec, c.vec), 12) DESC, c.idx) AS rank FROM q, c QUALIFY rank <= 100),
j AS (SELECT query_id AS qid, corpus_id AS did, max(score) AS score FROM qrels WHERE score > 0 GROUP BY ALL),
g AS (SELECT j.qid, sum(CASE WHEN h.rank <= 10 THEN j.score / log2(h.rank + 1) END) AS dcg, count(h.did) FILTER (h.rank <= 10) AS f10, count(h.did) AS f100, count(*) AS relevant FROM j LEFT JOIN h USING (qid, did) GROUP BY j.qid),
i AS (SELECT qid, sum(score / log2(n + 1)) AS ideal FROM (SELECT qid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS n FROM j) WHERE n <= 10 GROUP BY qid),
p AS (SELECT qid, sum(found / rank::DOUBLE) AS p FROM (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS found FROM h JOIN j USING (qid, did)) GROUP BY qid)
SELECT round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg_10, round(avg(coalesce(p, 0) / relevant), 6) AS map_100, round(sum(f10) / sum(relevant), 6) AS recall_10, round(sum(f100) / sum(relevant), 6) AS recall_100
FROM g JOIN i USING (qid) LEFT JOIN p USING (qid)""")
def dense_metric_set(spark, d):
    """The dense baseline of the passages: cosine top 100 of every query, judged by the graded qrels."""

    def rows(table):
        t = spark.read.parquet(f"{d}/{table}.parquet").select("idx", "id", "vec")
        return t.filter(F.coalesce((F.size("vec") == D) & vec.is_finite("vec"), F.lit(False))).distinct()

    q, c = rows("queries"), rows("corpus")
    hits = retrieval.cosine_top_r(q, c, 100).select("qidx", "idx", "rank")
    named = hits.join(q.select(F.col("idx").alias("qidx"), F.col("id").alias("qid")), "qidx").join(c.select("idx", F.col("id").alias("did")), "idx")
    judged = spark.read.parquet(f"{d}/qrels.parquet").select(F.col("query_id").alias("qid"), F.col("corpus_id").alias("did"), "score")
    m = metrics.metric_set(named.select("qid", "did", "rank"), judged)
    return m.select(*(F.round(x, 6).alias(x) for x in m.columns))


@query(f"""WITH {_E}, {_codes()}, {_ranked()}, {_COS} SELECT coalesce(r.qidx, cr.qidx) AS qid, coalesce(r.idx, cr.idx) AS did, cr.rank AS dense_rank, r.rank AS code_rank FROM r FULL JOIN cr ON r.qidx = cr.qidx AND r.idx = cr.idx""")
def ranking_diagnostic(spark, d):
    dense = cosine_topr(spark, d).select(F.col("qidx").alias("qid"), F.col("idx").alias("did"), "rank")
    return metrics.diagnostic(dense, _ranking(spark, d))


# ---- segments: idx % 3, each with weights of its own

_SEGMENTS = 3


def _segments(spark, d, normalized: bool):
    e = embeddings(spark, d)
    out = None
    for s in range(_SEGMENTS):
        encoder = hebbian(seed=s)
        mine = encode(e.filter(F.col("idx") % _SEGMENTS == s).withColumn("id", F.format_string("v%05d", "idx")), encoder, keep=("id",))
        part = segment_candidates(encode(e.filter(is_query()), encoder), mine, s, R, normalized)
        out = part if out is None else out.unionByName(part)
    return out


def _segment_sql(normalized: bool, merged: bool) -> str:
    ctes = [_E]
    for s in range(_SEGMENTS):
        w = _W.format(seed=s, base=modulus(M))
        ctes += [
            f"w{s} AS (SELECT mu, list({w} ORDER BY i) AS w FROM range({M}) a(mu), range({D}) b(i) GROUP BY mu)",
            f"c{s} AS (SELECT idx, list(mu ORDER BY mu) AS code FROM (SELECT idx, mu, row_number() OVER (PARTITION BY idx ORDER BY list_dot_product(vec, w) DESC, mu) AS r FROM e, w{s}) WHERE r <= {K} GROUP BY idx)",
            f"d{s} AS (SELECT a.idx AS query_idx, {s}::INTEGER AS segment_id, printf('v%05d', b.idx) AS corpus_id, ({_DIST})::INTEGER AS distance FROM c{s} a, c{s} b WHERE a.idx % 50 = 0 AND b.idx % {_SEGMENTS} = {s})",
        ]
    span = "max(distance) OVER p - min(distance) OVER p"
    value = f"CASE WHEN {span} > 0 THEN (distance - min(distance) OVER p) / ({span})::DOUBLE ELSE 0 END" if normalized else "NULL::DOUBLE"
    ctes.append("u AS (" + " UNION ALL ".join(f"SELECT * FROM d{s}" for s in range(_SEGMENTS)) + ")")
    ctes.append(f"n AS (SELECT *, {value} AS normalized FROM u WINDOW p AS (PARTITION BY query_idx, segment_id))")
    ctes.append(f"k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_idx, segment_id ORDER BY distance, corpus_id) <= {R})")
    head = "WITH " + ",\n".join(ctes)
    if not merged:
        return f"{head} SELECT query_idx, segment_id, corpus_id, distance, round(normalized, 6) AS normalized FROM k"
    return f"{head} SELECT query_idx, segment_id, corpus_id, distance, row_number() OVER (PARTITION BY query_idx ORDER BY normalized NULLS FIRST, distance, segment_id, corpus_id)::INTEGER AS rank FROM k QUALIFY rank <= {R}"


@query(_segment_sql(False, False))
def segment_candidates_plain(spark, d):
    return _segments(spark, d, False)


@query(_segment_sql(True, False))
def segment_candidates_normalized(spark, d):
    return _segments(spark, d, True).withColumn("normalized", F.round("normalized", 6))


@query(_segment_sql(False, True))
def segment_merge(spark, d):
    return merge_candidates(_segments(spark, d, False), R).drop("normalized")


@query(_segment_sql(True, True))
def segment_merge_normalized(spark, d):
    return merge_candidates(_segments(spark, d, True), R).drop("normalized")


@query(f"WITH {_E}, {_codes()} SELECT (idx % 3)::BIGINT AS segment, count(*) AS items, (count(*) * {D} * 8)::BIGINT AS dense_bytes, round(count(*) * {D} * 8 / sum(len(code) * 4 + 8), 6) AS compression FROM c GROUP BY idx % 3")
def compression_report(spark, d):
    c = coded(spark, d).groupBy((F.col("idx") % 3).alias("segment")).agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("code") * 4 + 8).alias("b"))
    dense = F.col("items") * D * 8
    return c.select("segment", "items", dense.alias("dense_bytes"), F.round(dense / F.col("b"), 6).alias("compression"))


def _index(spark, name: str) -> SegmentedIndex:
    """An index in the shared folder of the session."""
    return SegmentedIndex(spark, f"{shared_folder(spark)}/sparseloom-index/{name}-{uuid.uuid4().hex}")


def _kept(index: SegmentedIndex, rows: DataFrame) -> DataFrame:
    """`rows`, written down, so that the index they come from can go."""
    out = checkpoint(rows)
    remove(index.spark, index.path)
    return out


def _items(spark, d):
    return embeddings(spark, d).select("idx", F.format_string("v%05d", "idx").alias("id"), "vec")


def _from_zero(rows: DataFrame) -> DataFrame:
    return textprep.numbered(rows, ["idx"]).drop("idx").withColumnRenamed("n", "idx")


@query(f"WITH {_E}, {_codes()} SELECT printf('v%05d', idx) AS id, code FROM c")
def index_append(spark, d):
    """One third at first, the others appended with the same encoder; a replayed batch changes nothing."""
    rows, index = _items(spark, d), _index(spark, "append")
    index.create(_from_zero(rows.filter("idx % 3 = 0")), hebbian().config, encoder=hebbian())
    for part in (1, 2, 2):
        index.append(_from_zero(rows.filter(F.col("idx") % 3 == part)), batch_id=f"part-{part}")
    return _kept(index, index.codes().select("id", "code"))


@query(f"WITH {_E}, {_codes()}, {_ranked()} SELECT qidx AS query_idx, printf('v%05d', idx) AS doc_id, distance AS hamming, rank FROM r")
def index_search(spark, d):
    rows, index = _items(spark, d), _index(spark, "search")
    index.create(rows, hebbian().config, encoder=hebbian())
    return _kept(index, index.search(rows.filter(is_query()).select("idx", "vec"), R))


@query(_train_sql() + f"""SELECT printf('v%05d', idx) AS id, list(mu::INTEGER ORDER BY mu) AS code FROM (SELECT idx, mu, row_number() OVER (PARTITION BY idx ORDER BY list_dot_product(w.w[mu + 1], vec) DESC, mu) AS r
FROM e, (SELECT {_LAST} AS w) w, range({_TRAIN_M}) u(mu)) WHERE r <= 2 GROUP BY idx""")
def index_consolidate(spark, d):
    """An index improved by training on all items, which leaves two segments, then consolidated with the newer encoder."""
    rows, index = _items(spark, d), _index(spark, "consolidate")
    start = hebbian(_TRAIN_M, 2, learning_rate=0.05)
    index.create(_from_zero(rows.filter("idx % 2 = 0")), start.config, encoder=start)
    index.improve(rows, shuffle=False)
    index.consolidate(rows.select("id", "vec"))
    # items that both segments hold are in the index twice
    return _kept(index, index.codes().select("id", "code").distinct())


# ---- splits and ids


@query(f"""WITH {_E}, x AS (SELECT idx, label, (((idx * 48271 + 42 * 2147 + 11) % 2147483647) * 69621 + idx) % 2147483647 AS o FROM e WHERE label >= 0)
SELECT idx, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY o, idx) <= 5 THEN 'query' ELSE 'db' END AS role FROM x""")
def split_by_class(spark, d):
    return splits.split_by_class(embeddings(spark, d).select("idx", "label"), 5)


@query("SELECT id AS _id FROM queries GROUP BY id ORDER BY id LIMIT 20")
def list_query_ids(spark, d):
    from ..sources.text import list_query_ids as first_ids

    return first_ids(spark.read.parquet(f"{d}/queries.parquet").select(F.col("id").alias("_id")).distinct())


@query("SELECT query_id, corpus_id, max(score) AS score FROM qrels WHERE score > 0 GROUP BY ALL")
def qrels_relevant(spark, d):
    q = spark.read.parquet(f"{d}/qrels.parquet")
    return q.filter("score > 0").groupBy("query_id", "corpus_id").agg(F.max("score").alias("score"))


# ---- text preparation

_WSP = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WSP}+|{_WSP}+$', '', 'g')"


@query(f"SELECT doc_id, {_sql_strip('''coalesce(title, '') || chr(10) || coalesce(text, '')''')} AS passage FROM documents")
def passage_text(spark, d):
    return documents(spark, d).select("doc_id", text.passage_text("title", "text").alias("passage"))


@query(rf"SELECT doc_id, coalesce(len(regexp_extract_all(text, '{_WSP.replace('[', '[^', 1)}+')), 0)::INTEGER AS words FROM documents")
def word_count(spark, d):
    return documents(spark, d).select("doc_id", text.word_count("text").alias("words"))


def _sql_pieces(separator: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(text, '{separator}'), lambda x: {_sql_strip('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, {_sql_pieces(chr(92) + 'n' + _WSP + '*' + chr(92) + 'n+')} AS paragraphs FROM documents WHERE text IS NOT NULL")
def split_paragraphs(spark, d):
    return documents(spark, d).filter("text is not null").select("doc_id", text.split_paragraphs("text").alias("paragraphs"))


@query(f"""WITH b AS (SELECT doc_id, CASE WHEN contains(t, '*** START OF') THEN regexp_replace(substr(t, instr(t, '*** START OF')), '^[^\\n]*\\n', '') ELSE t END AS t
  FROM (SELECT doc_id, 'licence' || chr(10) || '*** START OF THIS TEXT ***' || chr(10) || coalesce(text, '') || chr(10) || '*** END OF THIS TEXT ***' || chr(10) || 'more' AS t FROM documents))
SELECT doc_id, {_sql_strip("CASE WHEN contains(t, '*** END OF') THEN substr(t, 1, instr(t, '*** END OF') - 1) ELSE t END")} AS body FROM b""")
def strip_boilerplate(spark, d):
    framed = F.concat(F.lit("licence\n*** START OF THIS TEXT ***\n"), F.coalesce("text", F.lit("")), F.lit("\n*** END OF THIS TEXT ***\nmore"))
    return documents(spark, d).select("doc_id", text.strip_boilerplate(framed).alias("body"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('<p class="x">' || coalesce(title, '') || '</p>' || coalesce(text, ''), '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS body FROM documents""")
def strip_html(spark, d):
    marked = F.concat(F.lit('<p class="x">'), F.coalesce("title", F.lit("")), F.lit("</p>"), F.coalesce("text", F.lit("")))
    return documents(spark, d).select("doc_id", text.strip_html(marked).alias("body"))


@query("SELECT doc_id FROM documents WHERE " + " AND ".join(f"NOT contains(lower(coalesce(title, '')), '{t}')" for t in text.NOT_NARRATIVE))
def keyword_filter(spark, d):
    return documents(spark, d).filter(text.is_narrative("title")).select("doc_id")


_MARKED = r"regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(1), 'g')"
_WORDS = f"len(regexp_extract_all(x, '{_WSP.replace('[', '[^', 1)}+'))"


@query(f"""
WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split({_MARKED}, chr(1)), lambda x: {_sql_strip('x')}), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
f AS (
  SELECT doc_id, ps, 0 AS i, []::VARCHAR[] AS done, []::VARCHAR[] AS cur, 0::BIGINT AS n FROM p
  UNION ALL
  SELECT doc_id, ps, i + 1,
    CASE WHEN len(cur) > 0 AND n + k > 35 THEN list_append(done, array_to_string(cur, ' ')) WHEN n + k >= 25 THEN list_append(done, array_to_string(list_append(cur, x), ' ')) ELSE done END,
    CASE WHEN len(cur) > 0 AND n + k > 35 THEN [x] WHEN n + k >= 25 THEN [] ELSE list_append(cur, x) END,
    CASE WHEN len(cur) > 0 AND n + k > 35 THEN k WHEN n + k >= 25 THEN 0 ELSE n + k END
  FROM (SELECT *, {_WORDS} AS k FROM (SELECT *, ps[i + 1] AS x FROM f WHERE i < len(ps)))
),
z AS (SELECT doc_id, CASE WHEN len(cur) = 0 THEN done WHEN n < 12 AND len(done) > 0 THEN list_append(done[:-2], done[-1] || ' ' || array_to_string(cur, ' ')) ELSE list_append(done, array_to_string(cur, ' ')) END AS chunks FROM f WHERE i = len(ps))
SELECT printf('%s-%04d', doc_id::VARCHAR, j - 1) AS _id, doc_id, (j - 1)::INTEGER AS chunk_no, chunks[j] AS text FROM (SELECT doc_id, chunks, unnest(range(1, len(chunks) + 1)) AS j FROM z)""")
def chunk_sentences(spark, d):
    docs = documents(spark, d).filter("text is not null").withColumn("title", F.coalesce("title", F.lit("")))
    return textprep.corpus_rows(docs, least=25, most=35, separator="sentence").select("_id", "doc_id", "chunk_no", "text")


@query("SELECT q.id AS query_id, c.id AS corpus_id, 1 AS score FROM (SELECT DISTINCT id, book_slug FROM queries) q JOIN (SELECT DISTINCT id, book_slug FROM corpus) c USING (book_slug)")
def build_qrels(spark, d):
    q = spark.read.parquet(f"{d}/queries.parquet").select(F.col("id").alias("_id"), "book_slug").distinct()
    c = spark.read.parquet(f"{d}/corpus.parquet").select(F.col("id").alias("_id"), "book_slug").distinct()
    return textprep.build_qrels(q, c, "book_slug")


@query(f"""WITH a AS (SELECT book_slug AS doc_id, {_sql_strip('text')} AS text, idx AS o FROM queries WHERE book_slug IS NOT NULL), b AS (SELECT doc_id, text, min(o) AS o FROM a WHERE text <> '' GROUP BY doc_id, text)
SELECT printf('q-%05d', row_number() OVER (ORDER BY o, doc_id, text) - 1) AS _id, doc_id, text FROM b""")
def dedupe_queries(spark, d):
    q = spark.read.parquet(f"{d}/queries.parquet").select(F.col("book_slug").alias("doc_id"), F.col("text").alias("question"), "idx")
    return textprep.distinct_questions(q, "idx")


@query("SELECT q.* FROM (SELECT DISTINCT id, book_slug FROM queries) q WHERE book_slug IN (SELECT book_slug FROM corpus)")
def queries_with_chunks(spark, d):
    q = spark.read.parquet(f"{d}/queries.parquet").select("id", "book_slug").distinct()
    return textprep.queries_with_chunks(q, spark.read.parquet(f"{d}/corpus.parquet"), "book_slug")


@query("""SELECT DISTINCT query_id, corpus_id, score FROM qrels WHERE query_id IN (SELECT id FROM queries) AND corpus_id IN (SELECT id FROM corpus)""")
def keep_judged(spark, d):
    ids = lambda t: spark.read.parquet(f"{d}/{t}.parquet").select(F.col("id").alias("_id"))
    return textprep.keep_judged(spark.read.parquet(f"{d}/qrels.parquet"), ids("corpus"), ids("queries")).distinct()
