import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparseloom.operators.encoders import Encoder, HebbianConfig, ProjectionConfig, SignConfig, encode
from sparseloom.operators.segments import SegmentedIndex, compression, index_name, merge_candidates
from sparseloom.streaming.ingest import append_batch, ingest

CORPUS = [(0, "d1", [1.0, 0.0, 0.0]), (1, "d2", [0.9, 0.1, 0.0]), (2, "d3", [0.0, 1.0, 0.0]), (3, "d4", [0.0, 0.0, 1.0])]
QUERIES = [(0, [0.95, 0.05, 0.0]), (1, [0.05, 0.95, 0.0])]
W = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0]])
CONFIG = HebbianConfig(3, 4, 2, normalize_inputs=True, p=2.0, renormalize_weights=False)
ITEM = [(0, "d5", [0.1, 0.9, 0.0])]


def items(spark, rows):
    return spark.createDataFrame(rows, "idx long, id string, vec array<double>")


def queries(spark):
    return spark.createDataFrame(QUERIES, "idx long, vec array<double>")


def hits(df):
    return [(r.query_idx, r.doc_id, r.hamming, r["rank"]) for r in df.orderBy("query_idx", "rank").collect()]


@pytest.fixture
def index(spark, tmp_path):
    i = SegmentedIndex(spark, f"file://{tmp_path}/index")
    i.create(items(spark, CORPUS), CONFIG, "mini", "test-fixture", Encoder(CONFIG, W.copy()))
    return i


def test_create_load_search(spark, index):
    m = SegmentedIndex(spark, index.path).manifest()
    assert (m.dataset, m.method, m.vector_dim, m.embedding_model, m.items) == ("mini", "hebbian", 3, "test-fixture", 4)
    index.validate()
    restored = index.encoder(m.segments[0])
    assert restored.config == CONFIG and np.array_equal(restored.weights, W)
    got = hits(index.search(queries(spark), 2))
    assert [h[1] for h in got if h[0] == 0] == ["d1", "d2"] and got[0][2] == 0 and [h[3] for h in got] == [1, 2, 1, 2]
    with pytest.raises(ValueError):
        index.search(queries(spark), 0)


def test_append_is_exact_and_replay_is_harmless(spark, index):
    index.append(items(spark, ITEM), batch_id="b1")
    once = index.manifest()
    assert index.append(items(spark, ITEM), batch_id="b1") == once and once.items == 5
    whole = {r.id: r.code for r in encode(items(spark, CORPUS + [(4, "d5", ITEM[0][2])]), Encoder(CONFIG, W), keep=("id",)).collect()}
    assert {r.id: r.code for r in index.codes().collect()} == whole
    index.validate()
    assert index.append(items(spark, ITEM)).items == 6
    with pytest.raises(ValueError, match="already"):
        index.append(items(spark, ITEM), on_conflict="error")


def test_improve_then_consolidate(spark, index):
    m = index.improve(items(spark, ITEM))
    assert [s.items for s in m.segments] == [4, 1] and m.segments[1].steps == 1
    index.validate()
    got = hits(index.search(queries(spark), 3))
    expected = {}
    for q, v in QUERIES:
        rows = []
        for s in m.segments:
            e = index.encoder(s)
            code = set(e.encode_batch(np.array([v]))[0])
            rows += [(len(code) + len(c.code) - 2 * len(code & set(c.code)), s.segment_id, c.id) for c in index.codes(s.segment_id).collect()]
        expected[q] = [(q, x[2], x[0], n) for n, x in enumerate(sorted(rows)[:3], 1)]
    assert got == expected[0] + expected[1]
    with pytest.raises(ValueError, match="no vector"):
        index.consolidate(items(spark, CORPUS).select("id", "vec"))
    m = index.consolidate(items(spark, CORPUS + ITEM).select("id", "vec"))
    assert len(m.segments) == 1 and m.items == 5 and m.segments[0].steps == 1
    index.validate()


def test_retrain_replaces_all_segments(spark, index):
    index.improve(items(spark, ITEM))
    index.create(items(spark, CORPUS), CONFIG, "mini")
    assert len(index.manifest().segments) == 1 and index.manifest().items == 4
    index.validate()


def test_two_writers(spark, index):
    stale = index.manifest()
    index.append(items(spark, ITEM))
    with pytest.raises(RuntimeError, match="another writer"):
        index._commit(stale)


def test_projection_and_sign(spark, tmp_path):
    p = SegmentedIndex(spark, f"{tmp_path}/p")
    p.create(items(spark, CORPUS), ProjectionConfig(3, 10, 3, 0.5))
    assert p.append(items(spark, ITEM)).items == 5
    for change in (lambda: p.improve(items(spark, ITEM)), lambda: p.consolidate(items(spark, CORPUS))):
        with pytest.raises(ValueError):
            change()
    s = SegmentedIndex(spark, f"{tmp_path}/s")
    s.create(items(spark, CORPUS), SignConfig(3, 6))
    a, b = s.encoder(s.manifest().segments[0]), {r.id: r.code for r in s.codes().collect()}
    assert a.steps == 20 and b == {r[1]: c.tolist() for r, c in zip(CORPUS, a.encode_batch(np.array([r[2] for r in CORPUS])))}
    assert len(hits(s.search(queries(spark), 2))) == 4


def test_names_differ_for_every_configuration():
    names = {index_name(c) for c in (CONFIG, dataclasses.replace(CONFIG, delta=0.1), dataclasses.replace(CONFIG, learning_rate=0.2), dataclasses.replace(CONFIG, normalize_inputs=False))}
    assert len(names) == 4 and compression(10, 4, 160) == 2


def test_normalized_merge(spark, index):
    index.improve(items(spark, ITEM))
    plain = index.candidates(queries(spark), 3)
    scaled = index.candidates(queries(spark), 3, normalized=True)
    assert plain.filter("normalized is not null").isEmpty() and scaled.filter("normalized is null").isEmpty()
    # one item: its range is 0
    assert {r.normalized for r in scaled.filter("segment_id = 1").collect()} == {0.0}
    first = merge_candidates(scaled, 1).filter("query_idx = 0").first()
    assert first.normalized == 0.0 and first["rank"] == 1


def test_streaming(spark, index, tmp_path):
    source = str(tmp_path / "in")
    bad = [(9, "x1", [1.0]), (9, "x2", [float("nan"), 0.0, 0.0]), (9, "x3", None)]
    items(spark, ITEM + bad).drop("idx").write.parquet(source)
    stream = lambda: spark.readStream.schema("id string, vec array<double>").parquet(source)
    for run in range(2):  # a lost checkpoint replays the batch
        q = ingest(stream(), index, str(tmp_path / f"checkpoint{run}"))
        q.awaitTermination()
    assert index.manifest().items == 5 and index.codes().filter("id = 'd5'").count() == 1
    index.validate()
    seen = []
    append_batch(index, "other", lambda df, n: seen.extend(r.id for r in df.collect()), improve_every=1)(items(spark, ITEM + bad[:1]).drop("idx"), 0)
    assert seen == ["x1"] and len(index.manifest().segments) == 2


def test_idx_column_is_in_order(spark, index):
    index.append(items(spark, [(1, "b", [0.0, 1.0, 0.0]), (0, "a", [1.0, 0.0, 0.0])]))
    assert [(r.idx, r.id) for r in index.codes().orderBy("idx").collect()][-2:] == [(4, "a"), (5, "b")]
    assert index.codes().select(F.countDistinct("idx")).first()[0] == 6


def test_compact_and_vacuum(spark, index):
    e = Encoder(HebbianConfig(4, 8, 2), np.random.default_rng(0).standard_normal((8, 4)))
    df = spark.createDataFrame([(i, f"d{i}", np.random.default_rng(i).standard_normal(4).tolist()) for i in range(40)], "idx long, id string, vec array<double>")
    part = lambda k: df.filter(f"idx % 4 = {k}").selectExpr("cast(floor(idx / 4) AS long) AS idx", "id", "vec")
    index.create(part(0), e.config, encoder=e)
    for k in (1, 2, 3):
        index.append(part(k), batch_id=f"in-{k}")
    before = sorted(map(tuple, index.codes().select("idx", "id").collect()))
    m = index.compact()
    assert [len(s.codes) for s in m.segments] == [1] and m.batches == ("in-3",)
    assert sorted(map(tuple, index.codes().select("idx", "id").collect())) == before
    index.validate()
    assert index.append(part(3), batch_id="in-3").version == m.version  # the last batch is still known
    # four folders of codes, and the codes and weights of the index that was replaced
    assert index.vacuum(keep=1) == 6 and index.vacuum(keep=1) == 0
    assert sorted(map(tuple, index.codes().select("idx", "id").collect())) == before and index.manifest().version == m.version
