"""The pN_ queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, garble, mix, nearest, overlap, pack, reading, spectral, tokens, topn
from .common import at_once, read


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return spectral.table_clusters({t: read(spark, d, t) for t in ("corpus", "labeled")})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).filter("size >= 3 and tight and isolated").select("table_name", "idx", F.col("cluster").alias("cluster_idx"))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    clusters = spectral.describe(_clusters(spark, d), by=("table_name",))
    return clusters.select("cluster", "size", "tight", "typical", "affinity", "table_name")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    codes = read(spark, d, "sparse_codes")
    dense, code = at_once(
        spark,
        lambda: nearest.nearest_vectors(read(spark, d, "queries"), read(spark, d, "corpus"), 5),
        lambda: nearest.nearest_codes(codes.filter("role = 'query'"), codes.filter("role = 'corpus'"), 5),
    )
    out = dense.select(F.lit("dense").alias("space"), "query_idx", F.col("idx").alias("corpus_idx"))
    return out.unionByName(code.select(F.lit("code").alias("space"), "query_idx", F.col("idx").alias("corpus_idx")))


def p2_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages whose idx is divisible by 50 against all passages; the passage itself is among its own."""
    corpus = read(spark, d, "corpus")
    return nearest.nearest_vectors(corpus.filter("idx % 50 = 0"), corpus, 6, whole=True).withColumn("cosine", F.round("cosine", 6))


def p3_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(read(spark, d, "corpus"), read(spark, d, "books"))


def p3_passage_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.passage_tokens(read(spark, d, "corpus"), read(spark, d, "books"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(read(spark, d, "search_hits"), "query_id", "doc_id", "hamming", 5).select("query_id", "doc_id")


def p4_top_hits(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(read(spark, d, "search_hits"), "query_id", "doc_id", "hamming", 5)


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return garble.restored_values(read(spark, d, "corpus"), read(spark, d, "books"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_restored(spark, d).select("idx", "field").distinct()


def _train(role: str = "role"):
    return F.col(role) == "train"


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    split = read(spark, d, "retrieval_split").filter(F.col("role").isin("train", "db", "query"))
    pairs = overlap.cross_split_pairs(split, _train())
    return pairs.select(F.least("eval_idx", "train_idx").alias("idx_a"), F.greatest("eval_idx", "train_idx").alias("idx_b")).distinct()


def p6_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    split = read(spark, d, "retrieval_split").filter(F.col("role").isin("train", "db", "query"))
    return overlap.overlap_report(split, _train())


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_oversized(read(spark, d, "corpus"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pieces(spark, d).filter("piece_no = 0 and n_pieces > 1").select("idx")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(mix.sized_documents(read(spark, d, "documents")), read(spark, d, "pack_specs"))


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_report(_packed(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_report(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_level(read(spark, d, "documents"), read(spark, d, "reading_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_levels(spark, d).select("doc_id", "band")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.profile(p10_levels(spark, d), read(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_passages, p3_passage_tokens, p3_token_budget, p4_found, p4_top_hits, p5_found, p5_restored, p6_found, p6_overlap_report, p7_found, p7_pieces, p8_pack, p8_report, p9_mix, p9_report, p10_found, p10_levels, p10_profile)
}

_TOP5 = """
SELECT query_id, doc_id, hamming, position FROM (
  SELECT query_id, doc_id, hamming, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hamming, doc_id) AS INTEGER) AS position
  FROM (SELECT query_id, doc_id, min(hamming) AS hamming FROM search_hits
        WHERE query_id IS NOT NULL AND doc_id IS NOT NULL AND hamming >= 0 GROUP BY query_id, doc_id))
WHERE position <= 5"""

_VALID = "vec IS NOT NULL AND len(vec) = 64 AND list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND isfinite(x)))"

_SPLIT = """v AS (SELECT DISTINCT idx, role, vec, list_transform(vec, lambda x: round(x / sqrt(list_sum(list_transform(vec, lambda y: y * y))), 6)) AS form FROM retrieval_split
           WHERE role IN ('train', 'db', 'query') AND len(vec) = 64 AND list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND isfinite(x)))
             AND list_sum(list_transform(vec, lambda x: abs(x))) > 0)"""

SQL: dict[str, str] = {
    "p1_found": f"""
WITH v AS (SELECT DISTINCT 'corpus' AS table_name, idx, vec FROM corpus WHERE {_VALID} UNION ALL SELECT DISTINCT 'labeled', idx, vec FROM labeled WHERE {_VALID}),
n AS (SELECT a.table_name, a.idx, list_sort(list(DISTINCT b.idx)) AS near FROM v a JOIN v b ON a.table_name = b.table_name AND list_cosine_similarity(a.vec, b.vec) >= 0.80 GROUP BY a.table_name, a.idx),
g AS (SELECT table_name, near FROM n GROUP BY table_name, near HAVING count(*) = len(near) AND len(near) >= 3)
SELECT table_name, unnest(near) AS idx, near[1] AS cluster_idx FROM g""",
    "p2_passages": f"""
WITH c AS (SELECT DISTINCT idx, vec FROM corpus WHERE {_VALID})
SELECT query_idx, idx, round(s, 6) AS cosine, rank FROM (
  SELECT a.idx AS query_idx, b.idx AS idx, max(round(list_cosine_similarity(a.vec, b.vec), 12)) AS s,
    row_number() OVER (PARTITION BY a.idx ORDER BY max(round(list_cosine_similarity(a.vec, b.vec), 12)) DESC, b.idx)::INTEGER AS rank
  FROM c a, c b WHERE a.idx % 50 = 0 GROUP BY a.idx, b.idx) WHERE rank <= 6""",
    "p2_found": f"""
WITH c AS (SELECT DISTINCT idx, vec FROM corpus WHERE {_VALID}), q AS (SELECT DISTINCT idx, vec FROM queries WHERE {_VALID}),
s AS (SELECT DISTINCT role, idx, list_sort(list_distinct(code)) AS code FROM sparse_codes WHERE len(list_distinct(code)) = 16),
d AS (SELECT 'dense' AS space, q.idx AS query_idx, c.idx AS corpus_idx, round(list_cosine_similarity(q.vec, c.vec), 12) AS score FROM q, c
      UNION ALL SELECT 'code', a.idx, b.idx, len(list_intersect(a.code, b.code)) FROM s a, s b WHERE a.role = 'query' AND b.role = 'corpus')
SELECT space, query_idx, corpus_idx FROM d
QUALIFY row_number() OVER (PARTITION BY space, query_idx ORDER BY score DESC, corpus_idx) <= 5""",
    "p4_found": f"SELECT query_id, doc_id FROM ({_TOP5})",
    "p4_top_hits": _TOP5,
    "p6_found": f"""
WITH {_SPLIT} SELECT DISTINCT least(a.idx, b.idx) AS idx_a, greatest(a.idx, b.idx) AS idx_b
FROM v a JOIN v b ON a.role <> 'train' AND b.role = 'train' AND list_cosine_similarity(a.vec, b.vec) >= 0.975""",
    "p6_overlap_report": f"""
WITH {_SPLIT}, m AS (SELECT idx, coalesce(min(role), 'unknown') AS role, coalesce(min(lower(trim(source))), 'unknown') AS source FROM retrieval_split WHERE role IN ('db', 'query') GROUP BY idx),
p AS (SELECT a.idx, b.idx AS t, max(a.form = b.form) AS same FROM v a JOIN v b ON a.role <> 'train' AND b.role = 'train' AND list_cosine_similarity(a.vec, b.vec) >= 0.975 GROUP BY a.idx, b.idx),
c AS (SELECT idx, sum(same::INTEGER) AS e, sum((NOT same)::INTEGER) AS n FROM p GROUP BY idx)
SELECT role, source, count(*) AS records, count(*) FILTER (e > 0) AS exact, count(*) FILTER (e = 0 AND n > 0) AS near, coalesce(sum(e), 0)::BIGINT AS exact_pairs, coalesce(sum(n), 0)::BIGINT AS near_pairs
FROM m LEFT JOIN c USING (idx) GROUP BY role, source""",
    "p7_found": r"""SELECT DISTINCT idx FROM corpus WHERE len(regexp_extract_all(text, '[^ \t\n\r]+')) > 350""",
}
