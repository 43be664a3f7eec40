import numpy as np
import pytest

from sparseloom.operators import splits, synth, textprep


def test_split_by_class(spark):
    df = spark.createDataFrame([(i, i % 3 if i else None) for i in range(31)], "idx long, label int")
    s = splits.split_by_class(df, 4, seed=1).collect()
    assert len(s) == 30 and all(sum(r.label == c and r.role == "query" for r in s) == 4 for c in range(3))
    assert {r.idx for r in s if r.role == "query"} == {r.idx for r in splits.split_by_class(df.repartition(5), 4, seed=1).collect() if r.role == "query"}
    assert {r.idx for r in s if r.role == "query"} != {r.idx for r in splits.split_by_class(df, 4, seed=2).collect() if r.role == "query"}
    assert all(r.role == "query" for r in splits.split_by_class(df, 99).collect())


def test_generators(spark):
    a = synth.two_class_blobs(spark, 8, 20)
    assert {tuple(r) for r in a.groupBy("label").count().collect()} == {(0, 20), (1, 20)}
    x = np.array([r.vec for r in synth.random_unit_vectors(spark, 50, 6).collect()])
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    c = synth.TextRetrievalConfig(40, 10, 16, 4, 2, 0.15, 0.3)
    rows = synth.text_retrieval(spark, c).orderBy("role", "idx").collect()
    assert [r.role for r in rows] == ["db"] * 40 + ["query"] * 10
    assert np.allclose(np.linalg.norm([r.vec for r in rows], axis=1), 1)
    assert rows == synth.text_retrieval(spark, c).repartition(3).orderBy("role", "idx").collect()
    with pytest.raises(ValueError):
        synth.TextRetrievalConfig(corpus_size=0)
    assert all(len(set(r.code)) == 3 and r.code == sorted(r.code) for r in synth.random_codes(spark, 20, 9, 3).collect())


def test_numbering_over_partitions(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(7)
    got = textprep.numbered(df, ["k"]).collect()
    assert all(r.k == r.n for r in got) and len(got) == 1000
    assert textprep.numbered(df.limit(0), ["k"]).count() == 0


def test_numbering_of_many_wide_rows(spark, tmp_path):
    """Range bounds are sampled anew by every run and partitions coalesce by their size: numbers must not depend on either."""
    from sparseloom.sources import text

    n, before = 400_000, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(n).selectExpr("(id * 7919) % 400000 AS k", "repeat(md5(cast(id AS string)), 1 + cast(id % 20 AS int)) AS fat").repartition(16)
        got = textprep.numbered(df, ["k"])
        assert got.filter("k <> n").isEmpty() and got.select("n").distinct().count() == n and "fat" in got.columns
        path = tmp_path / "lines.ids"
        path.write_text("".join(f"id-{i}\n" for i in range(n)))
        ids = text.read_ids(spark, str(path))
        assert ids.count() == n and ids.filter("id <> concat('id-', idx)").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_documents_and_questions(spark):
    docs = spark.createDataFrame([("a", "A", "one\n\ntwo", 2), ("a", "late", "x", 3), ("b", None, "  ", 1), ("c", "Poems", "three", 4), (None, "n", "n", 0)], "doc_id string, title string, text string, ord int")
    questions = spark.createDataFrame([("a", " q? ", 1), ("a", "q?", 2), ("b", "w?", 3), ("a", "", 4), ("c", "z?", 5)], "doc_id string, question string, ord int")
    first = textprep.first_documents(docs, "ord")
    assert {(r.doc_id, r.title) for r in first.collect()} == {("a", "A"), ("b", None), ("c", "Poems")}
    assert textprep.first_documents(docs, "ord", 1).first().doc_id == "b"
    assert [tuple(r) for r in textprep.distinct_questions(questions, "ord").orderBy("_id").collect()] == [("q-00000", "a", "q?"), ("q-00001", "b", "w?"), ("q-00002", "c", "z?")]
    out = textprep.prepare_corpus(docs, questions, least=1, most=5, narrative_only=True)
    assert {(r._id, r.text) for r in out["corpus"].collect()} == {("a-0000", "one"), ("a-0001", "two")}
    assert sorted(tuple(r) for r in out["qrels"].collect()) == [("q-00000", "a-0000", 1), ("q-00000", "a-0001", 1)]
    vectors = [r.vec for r in out["corpus"].collect()]
    assert np.allclose(np.linalg.norm(vectors, axis=1), 1) and [r.doc_id for r in out["queries"].collect()] == ["a"]
    assert textprep.keep_judged(out["qrels"], out["corpus"].limit(1), out["queries"]).count() == 1


def test_the_shared_folder_is_needed_on_a_cluster(spark):
    from types import SimpleNamespace as Fake

    from sparseloom import session

    def at(master, folder=None):
        conf = Fake(get=lambda *_: folder)
        return Fake(sparkContext=Fake(master=master, getConf=lambda: conf), conf=conf)

    assert session.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_folder(at("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.shared_folder(at("local[4]")) == session.shared_folder(at("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_folder(at(master))
