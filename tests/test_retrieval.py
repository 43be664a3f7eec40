import numpy as np
import pytest
from pyspark.sql import functions as F

from sparseloom.operators import metrics, retrieval


def codes(spark, rows):
    return spark.createDataFrame([(i, list(c)) for i, c in enumerate(rows)], "idx long, code array<int>")


def found(df):
    return [(r.idx, r.distance) for r in df.orderBy("qidx", "rank").collect()]


def test_cases(spark):
    q = codes(spark, [[0, 1]])
    assert found(retrieval.hamming_top_r(q, codes(spark, [[2, 3], [0, 2], [0, 1]]), 2)) == [(2, 0), (1, 2)]
    assert found(retrieval.hamming_top_r(q, codes(spark, [[2, 3], [4, 5]]), 2)) == [(0, 4), (1, 4)]
    assert found(retrieval.hamming_top_r(codes(spark, [[0]]), codes(spark, [[0], [1]]), 1, exclude=spark.createDataFrame([(0,)], "idx long"))) == [(1, 2)]
    assert found(retrieval.hamming_top_r(q, codes(spark, [[0, 1]]), 0)) == []
    assert found(retrieval.hamming_top_r(q, codes(spark, []), 3)) == []
    assert found(retrieval.hamming_top_r(q, codes(spark, [[0, 1]]), 9)) == [(0, 0)]


def test_random_against_a_loop(spark):
    rng = np.random.default_rng(0)
    for _ in range(6):
        m, k, n, r = int(rng.integers(9, 40)), int(rng.integers(1, 8)), int(rng.integers(1, 50)), int(rng.integers(1, 60))
        db = [sorted(rng.choice(m, int(rng.integers(1, k + 1)), replace=False).tolist()) for _ in range(n)]
        qs = [sorted(rng.choice(m, k, replace=False).tolist()) for _ in range(4)]
        expected = [x for q in qs for x in sorted((len(q) + len(c) - 2 * len(set(q) & set(c)), i) for i, c in enumerate(db))[:r]]
        for strategy in ("gemm", "postings"):
            got = found(retrieval.hamming_top_r(codes(spark, qs), codes(spark, db).repartition(3), r, strategy))
            assert [(d, i) for i, d in got] == expected


def test_many_queries_go_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 4)
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(30, 3, replace=False).tolist()) for _ in range(20)]
    a = found(retrieval.hamming_top_r(codes(spark, rows), codes(spark, rows), 3))
    assert a == found(retrieval.hamming_top_r(codes(spark, rows), codes(spark, rows), 3, "postings"))


def test_text_ids_and_extent(spark):
    db = codes(spark, [[0, 1], [2, 3], [2, 4]]).select(F.concat(F.lit("d"), 9 - F.col("idx")).alias("id"), "code")
    q = codes(spark, [[0, 1]])
    assert found(retrieval.hamming_top_r(q, db, 3, key="id")) == [("d9", 0), ("d7", 4), ("d8", 4)]
    assert retrieval.hamming_extent(q, db).first()[1:] == (0, 4)


def test_dense(spark):
    x = np.random.default_rng(0).standard_normal((60, 5))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in retrieval.cosine_top_r(df.filter("idx < 10"), df.repartition(3), 4).collect():
        got[r.qidx, r["rank"]] = r.idx
    for q in range(10):
        s = np.round(u @ u[q], 12)
        assert [got[q, k] for k in range(1, 5)] == sorted(range(60), key=lambda i: (-s[i], i))[:4]
    near = {r.qidx: r.idx for r in retrieval.l2_top_r(df, df, 1, exclude_self=True).collect()}
    assert near[3] == 7 and near[7] == 3


def test_dense_with_many_copies(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.tile(rng.standard_normal(24), (1000, 1)), rng.standard_normal((2000, 24))])
    ids = rng.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "idx long, vec array<double>").coalesce(1)
    copies = np.sort(ids[:1000]).tolist()
    q = df.filter(F.col("idx") == copies[500])
    for top_r in (retrieval.cosine_top_r, retrieval.l2_top_r):
        assert [r.idx for r in top_r(q, df, 10).orderBy("rank").collect()] == copies[:10]
        assert [r.idx for r in top_r(q, df, 600, exclude_self=True).orderBy("rank").collect()] == copies[:500] + copies[501:601]


def ranking(spark, lists):
    return spark.createDataFrame([(q, d, i + 1) for q, ds in lists.items() for i, d in enumerate(ds)], "qid string, did string, rank int")


def pairs(spark, rows, schema="qid string, did string"):
    return spark.createDataFrame(rows, schema)


def test_metrics(spark):
    r = ranking(spark, {"q": ["0", "1", "2"]})
    assert metrics.average_precision(r, pairs(spark, [("q", "0"), ("q", "2")]), 3).first().ap == pytest.approx((1 + 2 / 3) / 2)
    # all relevant ones count, also those beyond r
    assert metrics.average_precision(r, pairs(spark, [("q", "0"), ("q", "9")]), 1).first().ap == 0.5
    assert metrics.average_precision(r, pairs(spark, []), 3).first().ap == 0
    two = ranking(spark, {"a": ["5", "1", "2"], "b": ["0", "1", "2"]})
    truth = pairs(spark, [("a", "1"), ("b", "0")])
    assert metrics.recall_at_r(two, truth, 3).first()[0] == 1 and metrics.recall_at_r(two, truth, 1).first()[0] == 0.5
    assert metrics.mrr(two, pairs(spark, [("a", "1"), ("b", "2")])).first()[0] == pytest.approx((1 / 2 + 1 / 3) / 2)
    assert metrics.mrr(two, pairs(spark, [("a", "7"), ("b", "2")])).first()[0] == pytest.approx(1 / 6)
    t = pairs(spark, [("a", "0"), ("a", "1"), ("a", "3"), ("b", "4"), ("b", "7"), ("b", "8")])
    k = ranking(spark, {"a": ["0", "1", "2"], "b": ["4", "5", "6"]})
    assert metrics.recall_at_top_k(k, t, k.select("qid"), 3).first()[0] == pytest.approx(0.5)
    assert metrics.recall_at_top_k(k, t.limit(0), k.select("qid"), 3).first()[0] == 1
    assert metrics.recall_at_top_k(k, t, k.select("qid").limit(0), 3).first()[0] == 0


def test_graded_metrics(spark):
    qrels = pairs(spark, [("a", "d1", 1), ("a", "d2", 1), ("b", "d3", 1), ("b", "d3", 0), ("c", "d9", 0)], "qid string, did string, score int")
    r = ranking(spark, {"a": ["d1", "x"], "b": ["d3", "y"]})
    assert metrics.micro_recall(r, qrels, 1).first()[0] == pytest.approx(2 / 3)
    m = metrics.metric_set(r, qrels).first()
    assert m.recall_10 == pytest.approx(2 / 3) and m.map_100 == pytest.approx((0.5 + 1) / 2)
    assert m.ndcg_10 == pytest.approx((1 / (1 + 1 / np.log2(3)) + 1) / 2)
    better = {x.qid: x.ndcg for x in metrics.ndcg(ranking(spark, {"a": ["d1", "d2"], "b": ["y", "d3"]}), qrels, 10).collect()}
    assert better["a"] == 1 and better["b"] == pytest.approx(1 / np.log2(3)) and better["c"] == 0


@pytest.mark.parametrize("how", ["hamming", "cosine", "l2", "extent"])
def test_blocks_give_what_a_broadcast_gives(spark, monkeypatch, how):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).round(1)
    x[50:90] = x[0]  # a mass of copies beyond any block
    df = spark.createDataFrame([(i, v.tolist(), sorted(rng.choice(40, 4, replace=False).tolist()) if i > 60 else [1, 2, 3, 4]) for i, v in enumerate(x)], "idx long, vec array<double>, code array<int>").cache()
    q = df.filter("idx % 2 = 0")
    run = {"hamming": lambda: retrieval.hamming_top_r(q, df, 7, exclude_self=True), "cosine": lambda: retrieval.cosine_top_r(q, df, 7), "l2": lambda: retrieval.l2_top_r(q, df, 7, exclude_self=True), "extent": lambda: retrieval.hamming_extent(q, df)}[how]
    rows = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    whole = rows(run())
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 40)
    monkeypatch.setattr(retrieval, "BLOCK", 64)
    plan = run()
    assert rows(plan) == whole and len(whole) == (150 if how == "extent" else 1050)
    assert "FlatMapCoGroups" in plan._jdf.queryExecution().executedPlan().toString()
    df.unpersist()
