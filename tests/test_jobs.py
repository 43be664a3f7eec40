import numpy as np
import pytest
from pyspark.sql import functions as F

from sparseloom.operators import metrics, retrieval, synth
from sparseloom.operators.encoders import Encoder, HebbianConfig, build_encoder, encode
from sparseloom.operators.trainer import train
from sparseloom.operators.textprep import hashed_bag_of_words
from sparseloom.plans import cli, jobs, prepare
from sparseloom.sources import text


SEEDS = (1, 2, 3)


def quality_data(spark, seed):
    data = synth.text_retrieval(spark, synth.TextRetrievalConfig(100, 20, 32, 10, 2, 0.1, seed=seed)).persist()
    db, q = data.filter("role = 'db'"), data.filter("role = 'query'")
    truth = retrieval.l2_top_r(q, db, 5).select(F.col("qidx").alias("qid"), F.col("idx").alias("did"), "rank").persist()
    return db, q, truth


def measured(q, db, encoder, truth):
    """recall@1 of the nearest, recall@5 of the nearest, MRR, and the mean rank correlation with the cosine ranking."""
    codes, dense = retrieval.hamming_rank_all(encode(q, encoder), encode(db, encoder)), retrieval.cosine_top_r(q, db, 100)
    rename = lambda d: d.select(F.col("qidx").alias("qid"), F.col("idx").alias("did"), "rank")
    r, first = rename(codes).persist(), truth.filter("rank = 1").drop("rank")
    out = (metrics.recall_at_r(r, first, 1).first()[0], metrics.recall_at_r(r, first, 5).first()[0], metrics.mrr(r, first).first()[0], metrics.spearman(r, rename(dense)).agg(F.avg("rho")).first()[0])
    r.unpersist()
    return out


def test_quality_of_learned_codes(spark):
    """Over three seeds: the floors hold for each; more epochs and more active units are not worse, and learning beats random
    units of the same size, on average."""
    kinds = {"learned": (16, 320, 10), "once": (16, 320, 1), "narrow": (2, 40, 10)}
    found = {kind: [] for kind in (*kinds, "untrained")}
    for seed in SEEDS:
        db, q, truth = quality_data(spark, seed)
        dense = retrieval.cosine_top_r(q, db, 1).select(F.col("qidx").alias("qid"), F.col("idx").alias("did"), "rank")
        assert metrics.recall_at_r(dense, truth.filter("rank = 1").drop("rank"), 1).first()[0] == 1
        for kind, (k, m, epochs) in kinds.items():
            config = HebbianConfig(32, m, k, epochs=epochs, normalize_inputs=True, seed=seed)
            found[kind].append(measured(q, db, train(db, config), truth))
        found["untrained"].append(measured(q, db, build_encoder(HebbianConfig(32, 320, 16, epochs=1, normalize_inputs=True, seed=seed)), truth))
        one, five, mrr, rho = found["learned"][-1]
        assert one >= 0.5 and five >= 0.3 and mrr >= 0.3 and five > 5 / 100 * 5 and rho > 0
    mean = {kind: np.mean(v, axis=0) for kind, v in found.items()}
    assert mean["learned"][2] >= mean["once"][2] - 0.05 and mean["learned"][2] >= mean["narrow"][2] - 0.02
    assert mean["learned"][1] >= mean["untrained"][1] - 0.05


def test_codes_agree_with_the_cosine_ranking(spark):
    """A well separated collection: rank correlation of code and cosine ranking of 0.75 or more."""
    rng = np.random.default_rng(0)
    t = rng.uniform(0, np.pi, 60)
    x = np.stack([np.cos(t), np.sin(t)], 1)  # on a half circle the ranking is one of angles
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, vec array<double>")
    w = np.stack([np.cos(a := np.linspace(0, np.pi, 64, endpoint=False)), np.sin(a)], 1)
    e = Encoder(HebbianConfig(2, 64, 24), w)
    rename = lambda d: d.select(F.col("qidx").alias("qid"), F.col("idx").alias("did"), "rank")
    rho = metrics.spearman(rename(retrieval.hamming_rank_all(encode(df, e), encode(df, e))), rename(retrieval.cosine_top_r(df, df, 60))).agg(F.avg("rho")).first()[0]
    assert rho >= 0.75


def test_run_split_and_sweep(spark):
    data = synth.two_class_blobs(spark, 8, 30)
    c = jobs.EvalConfig("blobs", k=2, activity=0.2, epochs=1, per_class=5)
    r = jobs.evaluate_labelled(spark, data, c)
    assert r.map > 0.6 and (r.queries, r.database, r.m, r.r) == (10, 50, 10, 50) and "mAP@50" in jobs.format_result(r)
    split = jobs.splits.split_by_class(data, 5)
    grid = jobs.sweep(spark, split, c, (1, 2))
    assert [g.k for g in grid] == [1, 2] and jobs.result_frame(spark, grid).count() == 2
    assert jobs.encoder_config(jobs.EvalConfig("x", "projection", k=2), 8).m == 80
    assert jobs.encoder_config(jobs.EvalConfig("x", "projection", k=2, activity=0.1), 8, "activity").m == 20


def test_text_benchmark_by_command_line(spark, tmp_path, capsys, monkeypatch):
    corpus = [("d1", [1.0, 0, 0], "A", "alpha"), ("d2", [0.9, 0.1, 0], "A", "almost alpha"), ("d3", [0, 1.0, 0], "B", "beta"), ("d4", [0, 0, 1.0], "C", "gamma")]
    queries = [("q1", [0.95, 0.05, 0], "find alpha topic"), ("q2", [0.05, 0.95, 0], "find beta topic")]
    vec = lambda v: [float(x) for x in v]
    cdf = spark.createDataFrame([(i, a, vec(b), c, t) for i, (a, b, c, t) in enumerate(corpus)], "idx long, id string, vec array<double>, title string, text string")
    qdf = spark.createDataFrame([(i, a, vec(b), t) for i, (a, b, t) in enumerate(queries)], "idx long, id string, vec array<double>, text string")
    rel = spark.createDataFrame([("q1", "d1", 2), ("q1", "d2", 1), ("q2", "d3", 1)], "query_id string, corpus_id string, score int")
    text.write_text_benchmark(str(tmp_path), "mini", cdf, qdf, rel, "test")
    said = []
    run = lambda *a: cli.main(list(a), spark, out=lambda *x: said.append(" ".join(map(str, x))))
    assert run("train-text", "mini", "--data", str(tmp_path), "--index", str(tmp_path / "index"), "--k", "3", "--activity", "0.1") == 0
    path = str(next((tmp_path / "index/mini").iterdir()))
    bench = text.read_text_benchmark(spark, str(tmp_path), "mini")
    found = jobs.query_text_benchmark(spark, bench, path, 4, dense_baseline=True)
    assert found["dense"]["ndcg_10"] == pytest.approx(1) and 0 < found["hash"]["recall_10"] <= 1 and found["queries"] == 2
    assert run("query-text", "mini", "--data", str(tmp_path), "--index", path, "--r", "4", "--dense") == 0
    assert said[-1].startswith("dense") and "nDCG@10 1.0000" in said[-1]
    # vectors of a model that is not there must not be mixed with those of another
    assert run("search-text", "mini", "--data", str(tmp_path), "--index", path) == 1 and "no embedder for the model 'test'" in capsys.readouterr().err
    monkeypatch.setitem(prepare.EMBEDDERS, "test", lambda texts: hashed_bag_of_words(texts, 3))
    assert run("query-text", "mini", "--data", str(tmp_path), "--index", path, "--dense", "--dense-limit", "3") == 0 and "left out: 4" in said[-1]
    lines = iter([":help", ":k 2", ":list", ":use q1", "alpha", ":use none", ":q"])
    assert cli.main(["search-text", "mini", "--data", str(tmp_path), "--index", path], spark, ask=lambda _: next(lines), out=lambda *x: said.append(str(x[0]))) == 0
    assert "q2" in said and sum("hamming=" in s for s in said) == 4
    assert run("eval-mnist", str(tmp_path)) == 1 and "no image files" in capsys.readouterr().err


def test_ann(spark, tmp_path):
    from sparseloom.sources.datasets import AnnDataset

    x = synth.random_unit_vectors(spark, 40, 8).persist()
    q = x.filter("idx < 5")
    truth = retrieval.l2_top_r(q, x, 3).groupBy("qidx").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "idx"))), lambda r: r["idx"].cast("int")).alias("nn"))
    m = jobs.evaluate_ann(spark, AnnDataset("x", x, q, truth), jobs.EvalConfig("x", k=4, activity=0.1, epochs=1, r=10))
    assert m["recall_at_r"] == 1 and 0 < m["recall_at_top_k"] <= 1 and np.isclose(m["mrr"], 1, atol=0.5)


def put_lines(path, rows):
    import json

    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_prepare_by_command_line(spark, tmp_path, capsys):
    said = []
    run = lambda *a: cli.main(["prepare", *map(str, a), "--root", str(tmp_path / "out")], spark, out=lambda *x: said.append(x[0]))
    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))

    # a benchmark as it lies there
    put_lines(tmp_path / "b/corpus.jsonl", [{"_id": f"d{i}", "title": "T", "text": words(5, f"w{i}x")} for i in range(12)])
    put_lines(tmp_path / "b/queries.jsonl", [{"_id": "q1", "text": "w1x0 w1x1"}, {"_id": "q2", "text": "w11x0 w11x1 w11x2 w11x3"}])
    (tmp_path / "b/qrels").mkdir()
    (tmp_path / "b/qrels/dev.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq2\td11\t1\nq2\td2\t0\n")
    assert run("benchmark", tmp_path / "b", "--name", "b", "--split", "dev") == 0 and said[-1].endswith("out/b")
    bench = text.read_text_benchmark(spark, str(tmp_path / "out"), "b")
    assert [r.id for r in bench.corpus.orderBy("idx").collect()] == [f"d{i}" for i in range(12)] and bench.dim == 384 and bench.model == prepare.DEFAULT_MODEL
    assert sorted(map(tuple, bench.qrels.collect())) == [("q1", "d1", 2), ("q2", "d11", 1)]
    top = retrieval.cosine_top_r(bench.queries, bench.corpus, 1).orderBy("qidx").collect()
    assert [r.idx for r in top] == [1, 11]
    assert run("benchmark", tmp_path / "b", "--name", "few", "--split", "dev", "--max-passages", 3) == 0
    few = text.read_text_benchmark(spark, str(tmp_path / "out"), "few")
    assert few.corpus.count() == 3 and few.qrels.count() == 1

    # books
    body = "licence\n*** START OF THIS TEXT ***\n" + "\n\n".join(words(200, f"p{k}y") for k in range(4)) + "\n*** END OF THIS TEXT ***\nmore"
    (tmp_path / "k").mkdir()
    (tmp_path / "k/one.txt").write_bytes(("\ufeff" + body).encode())
    (tmp_path / "k/two.txt").write_bytes("café only".encode("latin-1"))
    put_lines(tmp_path / "k/books.jsonl", [{"file": "two.txt", "slug": "second", "title": "Two"}, {"file": "one.txt", "slug": "first", "title": "One"}, {"file": "none.txt", "slug": "none", "title": "None"}])
    put_lines(tmp_path / "k/queries.jsonl", [{"_id": "a", "text": "p0y1", "book_slug": "first"}, {"_id": "b", "text": "café", "book_slug": "second"}, {"_id": "c", "text": "x", "book_slug": "none"}])
    assert run("books", tmp_path / "k", "--name", "k") == 0
    bench = text.read_text_benchmark(spark, str(tmp_path / "out"), "k")
    # pieces of 200 words: two would go beyond 350, so each is a passage
    assert [r.id for r in bench.corpus.orderBy("idx").collect()] == ["second-0000", *(f"first-{i:04d}" for i in range(4))]
    assert sorted(map(tuple, bench.qrels.collect())) == [("a", f"first-{i:04d}", 1) for i in range(4)] + [("b", "second-0000", 1)]
    assert "café only" in {r.text for r in text.read_corpus_jsonl(spark, str(tmp_path / "out/k/corpus.jsonl")).collect()}

    # stories
    doc = lambda i, kind, title, t, q: {"document": {"id": i, "kind": kind, "text": t, "summary": {"title": title}}, "question": {"text": q}}
    put_lines(tmp_path / "s.jsonl", [doc("x", "book", "Sea", "<p>one</p> two", "Who?"), doc("m", "film", "F", "three", "What?"), doc("x", "book", "Sea", "<p>one</p> two", " Who? "), doc("y", "book", "Poems", "four", "Why?"), doc("z", "book", None, "five", "Where?"), doc("e", "book", "E", " ", "None?")])
    assert run("stories", tmp_path / "s.jsonl", "--name", "s", "--kind", "book", "--narrative-only") == 0
    bench = text.read_text_benchmark(spark, str(tmp_path / "out"), "s")
    assert sorted(map(tuple, bench.qrels.collect())) == [("q-00000", "x-0000", 1), ("q-00001", "z-0000", 1)]
    assert run("stories", tmp_path / "s.jsonl", "--name", "n", "--kind", "none") == 1 and "no documents" in capsys.readouterr().err
    assert run("books", tmp_path / "k", "--name", "k2", "--model", "other") == 1 and "no embedder" in capsys.readouterr().err


def test_embedding_service(tmp_path):
    import io

    frames = lambda *texts: b"".join(f"{len(t.encode())}\n".encode() + t.encode() for t in texts)
    sink = io.BytesIO()
    cli.serve(lambda texts: np.array([[float(len(texts[0])), 0.5]]), io.BytesIO(frames("abc", "", "QUIT", "after")), sink)
    assert sink.getvalue() == frames("READY", "3 0.5", "ERR\tempty text")
    (tmp_path / "manifest.properties").write_text("embeddingModel=hashed-words-384\n")
    said = []
    assert cli.main(["embed", "two words", "--manifest", str(tmp_path / "manifest.properties")], out=said.append) == 0
    assert len(said[0].split()) == 384
