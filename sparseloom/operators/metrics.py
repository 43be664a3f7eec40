"""Retrieval metrics over rankings (qid, did, rank from 1). Everything joins on the query id, never on position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _running_hits(hits: DataFrame) -> DataFrame:
    """`hits` holds the relevant ones among the ranked: the running count over rank, by query."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("found", F.count(F.lit(1)).over(w))


def average_precision(ranked: DataFrame, relevant: DataFrame, r: int, queries: DataFrame | None = None) -> DataFrame:
    """qid, ap: the sum of the precision at every hit of the first r, over ALL relevant documents (also those beyond r); 0
    for queries with none. relevant: qid, did. queries: the qid to report, by default those in either table."""
    rel = relevant.select("qid", "did").distinct()
    hits = _running_hits(ranked.filter(F.col("rank") <= r).join(rel, ["qid", "did"]))
    got = hits.groupBy("qid").agg(F.sum(F.col("found") / F.col("rank")).alias("precisions"))
    count = rel.groupBy("qid").agg(F.count(F.lit(1)).alias("relevant"))
    q = (queries if queries is not None else ranked.select("qid").unionByName(rel.select("qid"))).select("qid").distinct()
    out = q.join(count, "qid", "left").join(got, "qid", "left")
    return out.select("qid", F.when(F.col("relevant") > 0, F.coalesce("precisions", F.lit(0.0)) / F.col("relevant")).otherwise(F.lit(0.0)).alias("ap"))


def average_precision_by_label(ranked: DataFrame, query_labels: DataFrame, db_labels: DataFrame, r: int) -> DataFrame:
    """qid, ap where the relevant documents are those of the query's label. The number of relevant ones comes from the
    labels' counts, so no pairs are made. query_labels: qid, label; db_labels: did, label."""
    q = query_labels.select("qid", F.col("label").alias("qlabel"))
    hits = ranked.filter(F.col("rank") <= r).join(q, "qid").join(db_labels.select("did", "label"), "did").filter(F.col("label") == F.col("qlabel"))
    got = _running_hits(hits).groupBy("qid").agg(F.sum(F.col("found") / F.col("rank")).alias("precisions"))
    count = db_labels.groupBy(F.col("label").alias("qlabel")).agg(F.count(F.lit(1)).alias("relevant"))
    out = q.join(count, "qlabel", "left").join(got, "qid", "left")
    return out.select("qid", F.when(F.col("relevant") > 0, F.coalesce("precisions", F.lit(0.0)) / F.col("relevant")).otherwise(F.lit(0.0)).alias("ap"))


def mean_average_precision(ap: DataFrame) -> DataFrame:
    """map; 0 without queries."""
    return ap.agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"))


def recall_at_r(ranked: DataFrame, truth: DataFrame, r: int) -> DataFrame:
    """recall: the share of queries whose true nearest (truth: qid, did) is among the first r; 0 without queries."""
    hit = ranked.filter(F.col("rank") <= r).join(truth.select("qid", "did"), ["qid", "did"], "left_semi").select("qid").distinct().withColumn("hit", F.lit(1.0))
    return truth.select("qid").distinct().join(hit, "qid", "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0.0))), F.lit(0.0)).alias("recall"))


def recall_at_top_k(ranked: DataFrame, truth: DataFrame, queries: DataFrame, r: int) -> DataFrame:
    """recall: the mean share of a query's true ones that are among the first r; 1 for a query without true ones; 0 without
    queries."""
    t = truth.select("qid", "did").distinct()
    found = ranked.filter(F.col("rank") <= r).join(t, ["qid", "did"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("found"))
    size = t.groupBy("qid").agg(F.count(F.lit(1)).alias("size"))
    per = queries.select("qid").distinct().join(size, "qid", "left").join(found, "qid", "left")
    value = F.when(F.col("size").isNull(), 1.0).otherwise(F.coalesce("found", F.lit(0)) / F.col("size"))
    return per.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("recall"))


def mrr(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """mrr: the mean of 1 / rank of the true nearest, 0 where it is not ranked; 0 without queries."""
    at = ranked.join(truth.select("qid", "did"), ["qid", "did"]).groupBy("qid").agg(F.min("rank").alias("at"))
    return truth.select("qid").distinct().join(at, "qid", "left").agg(F.coalesce(F.avg(F.coalesce(1.0 / F.col("at"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def _relevant(qrels: DataFrame) -> DataFrame:
    """Judged above 0; of repeated pairs the greatest score."""
    return qrels.filter("score > 0").groupBy("qid", "did").agg(F.max("score").alias("score"))


def ndcg(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """qid, ndcg: linear gain over log2(rank + 1), against the k best judged ones; 0 where nothing is judged above 0."""
    rel = _relevant(qrels)
    gain = ranked.filter(F.col("rank") <= k).join(rel, ["qid", "did"]).groupBy("qid").agg(F.sum(F.col("score") / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = rel.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "did"))).filter(F.col("i") <= k)
    ideal = best.groupBy("qid").agg(F.sum(F.col("score") / F.log2(F.col("i") + 1)).alias("ideal"))
    q = ranked.select("qid").unionByName(qrels.select("qid")).distinct()
    out = q.join(ideal, "qid", "left").join(gain, "qid", "left")
    return out.select("qid", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(F.lit(0.0)).alias("ndcg"))


def micro_recall(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """micro_recall: relevant ones found among the first k, over all relevant ones, of the queries that have any."""
    rel = _relevant(qrels)
    found = ranked.filter(F.col("rank") <= k).join(rel, ["qid", "did"], "left_semi").agg(F.count(F.lit(1)).alias("found"))
    size = rel.agg(F.count(F.lit(1)).alias("size"))
    # two single rows
    both = found.withColumn("one", F.lit(1)).join(size.withColumn("one", F.lit(1)), "one")
    return both.select(F.when(F.col("size") > 0, F.col("found") / F.col("size")).otherwise(F.lit(0.0)).alias("micro_recall"))


def metric_set(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """ndcg_10, map_100, recall_10, recall_100 (micro) over the queries with judgements, in one pass over the ranking."""
    rel = _relevant(qrels)
    hits = _running_hits(ranked.filter(F.col("rank") <= 100).join(rel, ["qid", "did"]))
    per_hit = hits.groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= 10, F.col("score") / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.sum(F.col("found") / F.col("rank")).alias("precisions"),
        F.sum((F.col("rank") <= 10).cast("long")).alias("found_10"),
        F.count(F.lit(1)).alias("found_100"),
    )
    place = Window.partitionBy("qid").orderBy(F.desc("score"), "did")
    judged = rel.withColumn("i", F.row_number().over(place)).groupBy("qid").agg(F.sum(F.when(F.col("i") <= 10, F.col("score") / F.log2(F.col("i") + 1))).alias("ideal"), F.count(F.lit(1)).alias("relevant"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per = judged.join(per_hit, "qid", "left")
    return per.agg(
        F.coalesce(F.avg(zero("dcg") / F.col("ideal")), F.lit(0.0)).alias("ndcg_10"),
        F.coalesce(F.avg(zero("precisions") / F.col("relevant")), F.lit(0.0)).alias("map_100"),
        F.coalesce(F.sum(zero("found_10")) / F.sum("relevant"), F.lit(0.0)).alias("recall_10"),
        F.coalesce(F.sum(zero("found_100")) / F.sum("relevant"), F.lit(0.0)).alias("recall_100"),
    )


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, rho: the correlation of two rankings of the same documents."""
    met = a.select("qid", "did", F.col("rank").cast("double").alias("ra")).join(b.select("qid", "did", F.col("rank").cast("double").alias("rb")), ["qid", "did"])
    return met.groupBy("qid").agg(F.corr("ra", "rb").alias("rho"))


def diagnostic(dense: DataFrame, coded: DataFrame) -> DataFrame:
    """qid, did, dense_rank, code_rank: two rankings side by side; null where one does not have the document."""
    a = dense.select("qid", "did", F.col("rank").alias("dense_rank"))
    return a.join(coded.select("qid", "did", F.col("rank").alias("code_rank")), ["qid", "did"], "full")
