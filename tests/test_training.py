import numpy as np
import pytest

from sparseloom.operators import trainer
from sparseloom.operators.encoders import Encoder, HebbianConfig, ProjectionConfig, SignConfig, build_encoder, config_from_json, config_to_json, encode, parse_method, restore_encoder, sparse_rows

W4 = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0]])


def frame(spark, x):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "idx long, vec array<double>")


def test_configurations():
    assert HebbianConfig.with_activity(10, 8, 0.05).m == 160
    assert HebbianConfig.mnist(2).m == 40 and HebbianConfig.cifar().m == 400
    assert ProjectionConfig.paper_baseline(10, 4).m == 100
    assert SignConfig(10, 1).inner().anti_winner_rank == 1
    for bad in ({"k": 0}, {"k": 5}, {"anti_winner_rank": 9}, {"p": 0.5}):
        with pytest.raises(ValueError):
            HebbianConfig(**({"input_dim": 3, "m": 4, "k": 2} | bad))
    for c in (HebbianConfig(3, 4, 2, p=3, renormalize_weights=False), ProjectionConfig(3, 4, 2), SignConfig(3, 2)):
        assert config_from_json(config_to_json(c)) == c
    assert parse_method(" Hebbian ") == "hebbian"
    with pytest.raises(ValueError):
        parse_method("other")


def test_initial_weights():
    w = build_encoder(HebbianConfig(20, 30, 3, p=3)).weights
    assert np.allclose((np.abs(w) ** 3).sum(1), 1)
    assert np.array_equal(w, build_encoder(HebbianConfig(20, 30, 3, p=3)).weights)
    rows = sparse_rows(build_encoder(ProjectionConfig(20, 30, 3)).weights)
    assert all(len(i) == 2 and np.isclose((v**2).sum(), 1) for i, v in rows)


def test_winner_moves_to_the_input_and_stays_of_unit_length():
    c = HebbianConfig(3, 4, 2, learning_rate=0.1)
    x = np.array([0.8, 0.6, 0.0])
    e = trainer.fold(Encoder(c, W4 / np.linalg.norm(W4, axis=1, keepdims=True)), x[None], 1, shuffle=False)
    before = W4[3] / np.linalg.norm(W4[3])
    assert e.weights[3] @ x > before @ x and np.allclose(np.linalg.norm(e.weights, axis=1), 1)
    assert np.array_equal(e.weights[:3], W4[:3]) and e.steps == 1


def test_anti_winner_moves_away_by_the_scores_before():
    c = HebbianConfig(3, 4, 2, delta=0.5, learning_rate=0.1, anti_winner_rank=2, renormalize_weights=False)
    x = np.array([1.0, 0.2, 0.1])
    e = trainer.fold(Encoder(c, W4.copy()), x[None], 1, shuffle=False)
    s = W4 @ x  # best is unit 3, then unit 0
    assert np.allclose(e.weights[3], W4[3] + 0.1 * (x - s[3] * W4[3]))
    assert np.allclose(e.weights[0], W4[0] - 0.05 * (x - s[0] * W4[0]))
    same = HebbianConfig(3, 4, 2, delta=0.5, anti_winner_rank=1, learning_rate=0.1, renormalize_weights=False)
    assert np.allclose(trainer.fold(Encoder(same, W4.copy()), x[None], 1, shuffle=False).weights[3], e.weights[3])


@pytest.mark.parametrize("p", [1.5, 2.0, 3.0])
def test_spark_fold_equals_single_steps(spark, p):
    c = HebbianConfig(3, 4, 2, p=p, learning_rate=0.05, epochs=2)
    x = np.eye(3)[:2]
    start = Encoder(c, W4.copy())
    one = start
    for _ in range(2):
        for v in x:
            one = trainer.fold(one, v[None], 1, shuffle=False)
    e = trainer.train_more(frame(spark, x), start, epochs=2, shuffle=False)
    assert np.array_equal(e.weights, one.weights) and e.steps == 4


def test_same_seed_same_result_and_no_op(spark):
    x = np.random.default_rng(0).standard_normal((20, 5))
    c = HebbianConfig(5, 12, 3, epochs=2)
    a, b = trainer.train(frame(spark, x), c), trainer.train(frame(spark, x), c)
    assert np.array_equal(a.weights, b.weights) and a.steps == 40
    assert trainer.train(frame(spark, x).limit(0), c).steps == 0
    assert trainer.train_more(frame(spark, x), a, epochs=0).steps == 40


def test_restored_sign_encoder_keeps_weights_and_steps(spark):
    x = np.random.default_rng(0).standard_normal((20, 5))
    a = trainer.train(frame(spark, x), SignConfig(5, 6))
    b = restore_encoder(a.config, a.weights, a.steps)
    assert b.steps == a.steps and [c.tolist() for c in b.encode_batch(x)] == [c.tolist() for c in a.encode_batch(x)]
    with pytest.raises(ValueError):
        restore_encoder(a.config, a.weights[:2])


def test_averaged_training_is_of_unit_length(spark):
    x = np.random.default_rng(0).standard_normal((40, 5))
    e = trainer.train_averaged(frame(spark, x), HebbianConfig(5, 8, 2, epochs=2), 3)
    assert e.steps == 80 and np.allclose(np.linalg.norm(e.weights, axis=1), 1)


def test_random_projections_are_not_trained(spark):
    with pytest.raises(ValueError):
        trainer.train_more(frame(spark, np.eye(3)), build_encoder(ProjectionConfig(3, 4, 2)))


@pytest.mark.parametrize("config", [HebbianConfig(6, 20, 4, normalize_inputs=True), HebbianConfig(6, 20, 4, p=3), ProjectionConfig(6, 20, 4, 0.5), SignConfig(6, 9)])
def test_engines_agree(spark, config):
    x = np.random.default_rng(2).standard_normal((300, 6))
    e, df = build_encoder(config), frame(spark, x)
    codes = lambda engine: {r.idx: r.code for r in encode(df, e, engine=engine).collect()}
    a = codes("numpy")
    assert a == codes("hof")
    for i in (0, 299):
        s = (e.prepare(x[i : i + 1]) @ (np.sign(e.weights) * np.abs(e.weights) ** (e.p - 1)).T)[0]
        expected = np.flatnonzero(s > 0).tolist() if config.method == "sign" else sorted(sorted(range(len(s)), key=lambda j: (-s[j], j))[: config.k])
        assert a[i] == expected


def test_encode_rejects_bad_vectors(spark):
    e = build_encoder(HebbianConfig(3, 4, 2))
    for bad in ([1.0, 2.0], [1.0, 2.0, float("nan")], None):
        df = spark.createDataFrame([(0, bad)], "idx long, vec array<double>")
        with pytest.raises(Exception, match="entries|finite|null"):
            encode(df, e).collect()


def test_the_published_width_against_loops(spark):
    """Training, codes and ranking with 32 of 3,200 units, every step by hand."""
    from sparseloom.operators.retrieval import hamming_top_r

    rng = np.random.default_rng(4)
    x = rng.standard_normal((30, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = frame(spark, x)
    start = Encoder(HebbianConfig(16, 3200, 32, learning_rate=0.05), rng.standard_normal((3200, 16)))
    learned = trainer.train_more(df, start, epochs=2, shuffle=False)
    w = start.weights.copy()
    for _ in range(2):
        for v in x:
            s = w @ v
            best = int(np.argmax(s))
            w[best] += 0.05 * (v - s[best] * w[best])
            if learned.config.renormalize_weights:
                w[best] /= np.linalg.norm(w[best])
    assert np.allclose(learned.weights, w)
    codes = {r.idx: r.code for r in encode(df, learned).collect()}
    assert all(codes[i] == sorted(np.argsort(-(w @ v), kind="stable")[:32].tolist()) for i, v in enumerate(x))
    c = encode(df, learned)
    got = {}
    for r in hamming_top_r(c.filter("idx < 5"), c, 4).orderBy("qidx", "rank").collect():
        got.setdefault(r.qidx, []).append((r.distance, r.idx))
    assert got == {i: sorted((64 - 2 * len(set(codes[i]) & set(codes[j])), j) for j in codes)[:4] for i in range(5)}
