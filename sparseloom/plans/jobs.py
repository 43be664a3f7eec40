"""Programs: evaluation of labelled sets and ANN collections, grids, and the train and query runs of a text benchmark."""

from __future__ import annotations

import math
import time
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, retrieval, splits, synth, trainer
from ..operators.encoders import HebbianConfig, ProjectionConfig, SignConfig, encode, parse_method
from ..operators.segments import SegmentedIndex, artifact_bytes, compression, index_name
from ..sources import datasets
from ..sources.text import TextBenchmark

#: The dense baseline is made for no more documents than this, unless another limit is given.
DENSE_LIMIT = 250_000
#: Default number of results: by dataset; else all of the database.
DEFAULT_R = {"cifar": 1000, "synthetic-text": 100}


@dataclass(frozen=True)
class EvalConfig:
    dataset: str
    method: str = "hebbian"
    k: int = 2
    activity: float = 0.05
    epochs: int = 5
    seed: int = 42
    learning_rate: float = 0.01
    delta: float = 0.0
    anti_winner_rank: int = 2
    normalize_inputs: bool = False
    r: int | None = None
    per_class: int | None = None


@dataclass(frozen=True)
class EvalResult:
    dataset: str
    method: str
    k: int
    m: int
    map: float
    r: int
    train_seconds: float
    encode_seconds: float
    query_seconds: float
    queries: int
    database: int


def encoder_config(c: EvalConfig, dim: int, projection_rows: str = "baseline"):
    """The configuration of the method. A "projection" has 10 d units in evaluations ("baseline") and ceil(k / activity) in the
    text benchmark ("activity")."""
    method = parse_method(c.method)
    if method == "projection":
        if projection_rows == "baseline":
            return ProjectionConfig.paper_baseline(dim, c.k, seed=c.seed, normalize_inputs=c.normalize_inputs)
        return ProjectionConfig(dim, math.ceil(c.k / c.activity), c.k, seed=c.seed, normalize_inputs=c.normalize_inputs)
    common = {"learning_rate": c.learning_rate, "epochs": c.epochs, "anti_winner_rank": c.anti_winner_rank, "delta": c.delta, "seed": c.seed, "normalize_inputs": c.normalize_inputs}
    if method == "sign":
        return SignConfig(dim, c.k, **common)
    return HebbianConfig.with_activity(dim, c.k, c.activity, **common)


def _timed(f):
    t = time.monotonic()
    out = f()
    return out, time.monotonic() - t


def _materialised(df: DataFrame) -> DataFrame:
    df = df.persist()
    df.count()
    return df


def run_split(split: DataFrame, c: EvalConfig) -> EvalResult:
    """split: idx, vec, label, role ('db' is also the training set)."""
    db, queries = split.filter("role = 'db'"), split.filter("role = 'query'")
    first = db.select(F.size("vec")).first()
    if first is None:
        raise ValueError("the database is empty")
    config = encoder_config(c, first[0])
    encoder, t_train = _timed(lambda: trainer.train(db, config))
    (db_codes, q_codes), t_encode = _timed(lambda: (_materialised(encode(db, encoder, keep=("idx", "label"))), _materialised(encode(queries, encoder, keep=("idx", "label")))))
    n, nq = db_codes.count(), q_codes.count()
    r = c.r if c.r is not None else min(DEFAULT_R.get(c.dataset, n), n)

    def rank_and_score() -> float:
        ranked = retrieval.hamming_top_r(q_codes, db_codes, r).select(F.col("qidx").alias("qid"), F.col("idx").alias("did"), "rank")
        ap = metrics.average_precision_by_label(ranked, q_codes.select(F.col("idx").alias("qid"), "label"), db_codes.select(F.col("idx").alias("did"), "label"), r)
        return metrics.mean_average_precision(ap).first()[0]

    value, t_query = _timed(rank_and_score)
    db_codes.unpersist(), q_codes.unpersist()
    return EvalResult(c.dataset, config.method, config.k, config.m, value, r, t_train, t_encode, t_query, nq, n)


def evaluate_labelled(spark: SparkSession, data: DataFrame, c: EvalConfig) -> EvalResult:
    per_class = c.per_class if c.per_class is not None else splits.QUERIES_PER_CLASS.get(c.dataset, 100)
    return run_split(splits.split_by_class(data, per_class, c.seed), c)


def evaluate_mnist(spark: SparkSession, directory: str, c: EvalConfig | None = None) -> EvalResult:
    return evaluate_labelled(spark, datasets.read_idx_dataset(spark, directory), c or EvalConfig("mnist"))


def evaluate_fashion(spark: SparkSession, directory: str, c: EvalConfig | None = None) -> EvalResult:
    return evaluate_labelled(spark, datasets.read_idx_dataset(spark, directory), c or EvalConfig("fashion"))


def evaluate_cifar(spark: SparkSession, directory: str, c: EvalConfig | None = None) -> EvalResult:
    return evaluate_labelled(spark, datasets.read_cifar10(spark, directory), c or EvalConfig("cifar", activity=0.005))


def evaluate_synthetic_text(spark: SparkSession, c: EvalConfig | None = None, data: synth.TextRetrievalConfig | None = None) -> EvalResult:
    c = c or EvalConfig("synthetic-text", k=8, activity=0.01, epochs=3, normalize_inputs=True)
    return run_split(synth.text_retrieval(spark, data or synth.TextRetrievalConfig(seed=c.seed)), c)


def sweep(spark: SparkSession, split: DataFrame, c: EvalConfig, ks: tuple[int, ...] = (2, 4, 8, 16, 32, 64)) -> list[EvalResult]:
    return [run_split(split, replace(c, k=k)) for k in ks]


def evaluate_ann(spark: SparkSession, data: datasets.AnnDataset, c: EvalConfig | None = None) -> dict[str, float]:
    """recall of the true neighbours among the first r, by hash codes; honours every field of the configuration."""
    c = c or EvalConfig(data.name, k=8, activity=0.05, epochs=3, r=100, normalize_inputs=True)
    dim = data.database.select(F.size("vec")).first()[0]
    encoder, t_train = _timed(lambda: trainer.train(data.database, encoder_config(c, dim)))
    r = c.r or 100
    ranked = retrieval.hamming_top_r(encode(data.queries, encoder), encode(data.database, encoder), r).select(F.col("qidx").alias("qid"), F.col("idx").alias("did"), "rank")
    truth = data.truth.select(F.col("qidx").alias("qid"), F.explode(F.slice("nn", 1, r).cast("array<long>")).alias("did"))
    nearest = data.truth.filter(F.size("nn") > 0).select(F.col("qidx").alias("qid"), F.col("nn")[0].cast("long").alias("did"))
    queries = data.queries.select(F.col("idx").alias("qid"))
    return {
        "recall_at_r": metrics.recall_at_r(ranked, nearest, r).first()[0], "recall_at_top_k": metrics.recall_at_top_k(ranked, truth, queries, r).first()[0],
        "mrr": metrics.mrr(ranked, nearest).first()[0], "train_seconds": t_train,
    }


def text_config(k: int = 32, activity: float = 0.01, epochs: int = 3, **more) -> EvalConfig:
    return EvalConfig("scifact", k=k, activity=activity, epochs=epochs, **({"normalize_inputs": True} | more))


def train_text_benchmark(spark: SparkSession, bench: TextBenchmark, root: str, c: EvalConfig | None = None) -> dict:
    """Trains, encodes and saves; returns what was written and the compression."""
    config = encoder_config(c or text_config(), bench.dim, "activity")
    path = f"{root}/{bench.name}/{index_name(config)}"
    manifest, seconds = _timed(lambda: SegmentedIndex(spark, path).create(bench.corpus, config, bench.name, bench.model))
    size = artifact_bytes(spark, path)
    return {"path": path, "method": config.method, "k": config.k, "m": config.m, "items": manifest.items, "bytes": size, "compression": compression(manifest.items, bench.dim, size), "seconds": seconds}


def query_text_benchmark(spark: SparkSession, bench: TextBenchmark, path: str, r: int = 100, dense_baseline: bool = False, dense_limit: int = DENSE_LIMIT) -> dict:
    """Metrics of the saved index over the queries with judgements, and of the dense ranking where asked for; of a corpus beyond
    `dense_limit` its size instead, as "dense_left_out"."""
    index = SegmentedIndex(spark, path)
    manifest = index.manifest()
    if manifest.dataset != bench.name:
        raise ValueError(f"the index is of {manifest.dataset!r}, not {bench.name!r}")
    judged = bench.queries.join(bench.qrels.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")
    names = judged.select(F.col("idx").alias("query_idx"), F.col("id").alias("qid"))
    qrels = bench.qrels.select(F.col("query_id").alias("qid"), F.col("corpus_id").alias("did"), "score").join(names.select("qid"), "qid", "left_semi")

    def measured(hits: DataFrame) -> dict:
        return metrics.metric_set(hits.join(names, "query_idx").select("qid", F.col("doc_id").alias("did"), "rank"), qrels).first().asDict()

    found, seconds = _timed(lambda: measured(index.search(judged.select("idx", "vec"), r)))
    out = {"hash": found, "seconds": seconds, "queries": judged.count()}
    size = bench.corpus.count() if dense_baseline else 0
    if size > dense_limit:
        out["dense_left_out"] = size
    elif dense_baseline:
        dense = retrieval.cosine_top_r(judged, bench.corpus, r).select(F.col("qidx").alias("query_idx"), "idx", "rank")
        out["dense"] = measured(dense.join(bench.corpus.select("idx", F.col("id").alias("doc_id")), "idx"))
    return out


def result_frame(spark: SparkSession, results: list[EvalResult]) -> DataFrame:
    return spark.createDataFrame([asdict(r) for r in results])


# ---- console


def format_result(r: EvalResult) -> str:
    return f"{r.dataset:<16} {r.method:<10} k={r.k:<4d} m={r.m:<6d} mAP@{r.r:<6d} {100 * r.map:6.2f}  train {r.train_seconds:8.2f}s  encode {r.encode_seconds:8.2f}s  query {r.query_seconds:8.2f}s"


def format_metrics(m: dict) -> str:
    return f"nDCG@10 {m['ndcg_10']:.4f}  MAP@100 {m['map_100']:.4f}  R@10 {m['recall_10']:.4f}  R@100 {m['recall_100']:.4f}"


def format_train(t: dict) -> str:
    return f"{t['method']:<10} k={t['k']:<4d} m={t['m']:<6d} items={t['items']:<9d} bytes={t['bytes']:<12d} compression={t['compression']:.2f}x  {t['seconds']:.2f}s"
