import gzip
import os
import struct

import numpy as np
import pytest

from sparseloom.sources import datasets, records, text


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def vecs(rows, dtype):
    return b"".join(struct.pack("<i", len(r)) + np.asarray(r).astype(dtype).tobytes() for r in rows)


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("idx").select(*cols).collect()]


def test_vector_files(spark, tmp_path, monkeypatch):
    x = np.arange(28, dtype=float).reshape(7, 4) / 2
    f = put(tmp_path / "a.fvecs", vecs(x, "<f4"))
    monkeypatch.setattr(records, "RANGE_BYTES", 50)  # several ranges
    got = records.read_records(spark, f, "fvecs")
    assert rows(got, "idx", "vec") == [(i, v.tolist()) for i, v in enumerate(x)]
    assert records.read_records(spark, f, "fvecs", 3).count() == 3
    b = put(tmp_path / "b.bvecs", vecs([[1, 255], [0, 7]], "u1"))
    assert rows(records.read_records(spark, b, "bvecs"), "vec") == [([1.0, 255.0],), ([0.0, 7.0],)]
    i = put(tmp_path / "i.ivecs", vecs([[3, -1], [2, 9]], "<i4"))
    assert rows(records.read_records(spark, i, "ivecs"), "nn") == [([3, -1],), ([2, 9],)]


def test_vector_file_ends(spark, tmp_path):
    whole = vecs([[1.0, 2.0]], "<f4")
    assert records.read_records(spark, put(tmp_path / "e.fvecs", b""), "fvecs").count() == 0
    assert records.read_records(spark, put(tmp_path / "h.fvecs", whole + b"\x02\x00"), "fvecs").count() == 1
    with pytest.raises(Exception, match="cut off"):
        records.read_records(spark, put(tmp_path / "t.fvecs", whole + whole[:8]), "fvecs").count()
    with pytest.raises(Exception, match="unknown kind"):
        records.RecordReader({"kind": "x", "path": str(tmp_path)})


@pytest.mark.parametrize("single", [True, False])
def test_written_vectors_read_back(spark, tmp_path, single):
    df = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(20)], "idx long, vec array<double>").repartition(3)
    path = str(tmp_path / "out")
    records.write_vectors(df, path, single_file=single)
    assert rows(records.read_records(spark, path, "fvecs"), "idx", "vec") == [(i, [float(i), 0.5]) for i in range(20)]


def images(n, magic=2051):
    return struct.pack(">iiii", magic, n, 2, 2) + bytes(range(4 * n))


def labels(n):
    return struct.pack(">ii", 2049, n) + bytes(i % 10 for i in range(n))


def test_idx(spark, tmp_path):
    for (im, lb), n, zipped in zip(datasets.IDX_FILES, (3, 2), (False, True)):
        for name, data in ((im, images(n)), (lb, labels(n))):
            put(tmp_path / (name + ".gz" * zipped), gzip.compress(data) if zipped else data)
    assert datasets.idx_available(str(tmp_path))
    got = rows(datasets.read_mnist(spark, str(tmp_path)), "idx", "vec", "label")
    assert len(got) == 5 and got[0] == (0, [0.0, 1 / 255, 2 / 255, 3 / 255], 0) and got[3] == (3, [0.0, 1 / 255, 2 / 255, 3 / 255], 0)
    with pytest.raises(Exception, match="magic"):
        records.read_records(spark, put(tmp_path / "bad", images(1, 7)), "idx_images").count()
    two = records.read_records(spark, put(tmp_path / "x", images(2)), "idx_images")
    with pytest.raises(ValueError, match="2 images, 3 labels"):
        datasets.labelled(two, records.read_records(spark, put(tmp_path / "y", labels(3)), "idx_labels"))


def test_cifar_and_fc7(spark, tmp_path):
    assert not datasets.cifar_available(str(tmp_path))
    raw = np.zeros((10_000, 3073), np.uint8)
    raw[:, 0] = np.arange(10_000) % 10
    raw[1, 1] = 255
    for name in datasets.CIFAR_FILES:
        put(tmp_path / name, raw.tobytes())
    df = datasets.read_cifar10(spark, str(tmp_path))
    assert df.select("idx").distinct().count() == 60_000
    assert df.filter("idx = 10001").selectExpr("vec[0]", "label").first()[:] == (1.0, 1)
    with pytest.raises(Exception, match="bytes, expected"):
        records.read_records(spark, put(tmp_path / "short.bin", b"123"), "cifar10").count()
    csv = put(tmp_path / "f.csv", b"a,b,label\n1.5,2,3\n4,5.25,6\n")
    assert rows(datasets.read_fc7_csv(spark, csv), "idx", "vec", "label") == [(0, [1.5, 2.0], 3), (1, [4.0, 5.25], 6)]
    x = np.array([[1.5, 2.0], [4.0, 5.25]])
    binary = put(tmp_path / "f.bin", struct.pack(">ii", 2, 2) + x.astype(">f8").tobytes() + np.array([3, 6]).astype(">i4").tobytes())
    assert rows(datasets.read_fc7_binary(spark, binary), "vec", "label") == [([1.5, 2.0], 3), ([4.0, 5.25], 6)]


def test_ann_collection(spark, tmp_path):
    d = tmp_path / "siftsmall"
    put(d / "siftsmall_base.fvecs", vecs(np.eye(3), "<f4"))
    put(d / "siftsmall_query.fvecs", vecs([[1, 0.1, 0]], "<f4"))
    put(d / "siftsmall_groundtruth.ivecs", vecs([[0, 1]], "<i4"))
    assert datasets.ann_available(str(tmp_path), "SIFT10K") and not datasets.ann_available(str(tmp_path), "gist1m")
    a = datasets.read_ann(spark, str(tmp_path), "SIFT10K", max_db=2)
    assert a.database.count() == 2 and a.truth.first().nn == [0, 1] and a.name == "sift10k"
    with pytest.raises(ValueError):
        datasets.read_ann(spark, str(tmp_path), "other")


def test_gzipped_records_are_all_read(spark, tmp_path):
    """The size of a compressed file says nothing about its records."""
    x = np.tile(np.arange(16.0), (3000, 1))  # compresses well
    for kind, dtype, column in (("fvecs", "<f4", "vec"), ("bvecs", "u1", "vec"), ("ivecs", "<i4", "nn")):
        got = records.read_records(spark, put(tmp_path / f"x.{kind}.gz", gzip.compress(vecs(x, dtype))), kind)
        assert got.count() == 3000 and got.filter(f"{column}[15] = 15").count() == 3000
        with pytest.raises(Exception, match="cut off"):
            records.read_records(spark, put(tmp_path / f"cut.{kind}.gz", gzip.compress(vecs(x[:3], dtype)[:-1 if kind == "bvecs" else -4])), kind).count()
    d = tmp_path / "siftsmall"
    put(d / "siftsmall_base.fvecs.gz", gzip.compress(vecs(x, "<f4")))
    put(d / "siftsmall_query.fvecs", vecs(x[:2], "<f4"))
    put(d / "siftsmall_groundtruth.ivecs.gz", gzip.compress(vecs([[0], [1]], "<i4")))
    assert datasets.read_ann(spark, f"file://{tmp_path}", "sift10k").database.count() == 3000
    raw = np.zeros((10_000, 3073), np.uint8)
    assert records.read_records(spark, put(tmp_path / "c.bin.gz", gzip.compress(raw.tobytes())), "cifar10").count() == 10_000


def test_landed_texts_in_several_encodings(spark, tmp_path):
    for name, raw in (("a.txt", "\ufeffmarked é".encode()), ("b.txt", "plain é".encode()), ("c.txt", "old é".encode("latin-1")), ("d.txt", b"")):  # an empty file gives no row
        put(tmp_path / name, raw)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in text.read_documents(spark, f"{tmp_path}/*.txt").collect()}
    assert got == {"a.txt": "marked é", "b.txt": "plain é", "c.txt": "old é"}


def test_text_formats(spark, tmp_path):
    ids = put(tmp_path / "x.ids", b" a \n\nb\nc\n")
    assert rows(text.read_ids(spark, ids), "idx", "id") == [(0, "a"), (1, "b"), (2, "c")]
    q = put(tmp_path / "q.tsv", b"Query-ID\tcorpus\tscore\nq1\td1\t1\nq1\td1\t2\nq1\td2\t0\nq2\td2\nq3\td1\t1\n")
    assert sorted(tuple(r) for r in text.read_qrels(spark, q).collect()) == [("q1", "d1", 2), ("q3", "d1", 1)]
    bare = put(tmp_path / "b.tsv", b"q1\td1\t1\n")
    assert text.read_qrels(spark, bare).count() == 1
    c = put(tmp_path / "c.jsonl", '{"_id":"d1","title":"A","text":"alph\\"a é"}\n{"title":"x"}\n{"_id":"d2"}\n'.encode())
    assert sorted(tuple(r) for r in text.read_corpus_jsonl(spark, c).select("_id", "passage").collect()) == [("d1", 'A\nalph"a é'), ("d2", "")]
    qs = put(tmp_path / "qs.jsonl", b'{"_id":"q2","text":"b"}\n{"_id":"q1","text":"a"}\n{"_id":"q0"}\n')
    found = text.read_queries_jsonl(spark, qs)
    assert [r[0] for r in text.list_query_ids(found, 1).collect()] == ["q1"]
    assert text.count_jsonl(spark, qs) == 3 and text.count_jsonl(spark, str(tmp_path / "none")) == 0
    assert text.embedding_model(str(tmp_path / "none")) == "unknown"
    p = put(tmp_path / "m.properties", b"embeddingModel=a=b\n")
    assert text.embedding_model(p) == "a=b"


def test_lines_keep_their_order_over_blocks(spark, tmp_path):
    path = put(tmp_path / "lines.txt", b"".join(b"line %06d\n" % i for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = rows(text.read_lines(spark, path), "idx", "line")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i, f"line {i:06d}") for i in range(3000)]


def test_text_benchmark_round_trip(spark, tmp_path):
    corpus = spark.createDataFrame([(0, "d1", [1.0, 0.0], "A", "alpha"), (1, "d2", [0.0, 1.0], "B", "beta")], "idx long, id string, vec array<double>, title string, text string")
    queries = spark.createDataFrame([(0, "q1", [0.9, 0.1], "find")], "idx long, id string, vec array<double>, text string")
    qrels = spark.createDataFrame([("q1", "d2", 1), ("q1", "d1", 2)], "query_id string, corpus_id string, score int")
    assert not text.text_benchmark_available(str(tmp_path), "mini")
    text.write_text_benchmark(str(tmp_path), "mini", corpus, queries, qrels, "test")
    assert text.text_benchmark_available(str(tmp_path), "mini")
    b = text.read_text_benchmark(spark, str(tmp_path), "mini")
    assert (b.model, b.dim, b.corpus.count(), b.qrels.count()) == ("test", 2, 2, 2)
    assert (tmp_path / "mini/qrels/test.tsv").read_text() == "query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td2\t1\n"
    assert text.read_corpus_jsonl(spark, str(tmp_path / "mini/corpus.jsonl")).count() == 2
    os.remove(tmp_path / "mini/corpus.ids")
    put(tmp_path / "mini/corpus.ids", b"d1\n")
    with pytest.raises(ValueError, match="2 vectors, 1 ids"):
        text.read_text_benchmark(spark, str(tmp_path), "mini")
