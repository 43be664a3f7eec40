"""Problems 1, 2 and 6 against brute force, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparseloom.llm import coarse, nearest, overlap, spectral

SCHEMA = "idx long, vec array<double>, list int, block int, u string, train string"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def frame(spark, rows):
    """Rows (idx, vec) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "u", "t") for i, v in rows], SCHEMA)


BAD = [None, [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [0.0] * 64]


def clustered(seed, groups, noise=0.05, dim=64):
    """Groups of given sizes around random centres; the index of each row's group."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([unit(rng.standard_normal(dim)) + noise * rng.standard_normal((n, dim)) for n in groups])
    return x, np.repeat(np.arange(len(groups)), groups)


# ---- nearest


def brute(q, c, k):
    s = np.round(unit(q) @ unit(c).T, 12)
    return [sorted(range(len(c)), key=lambda i: (-row[i], i))[:k] for row in s]


@pytest.mark.parametrize("rows_per_list", [384, 40])
def test_nearest_vectors_recall(spark, monkeypatch, rows_per_list):
    monkeypatch.setattr(coarse, "BLOCK", 50)  # long lists are cut into blocks
    monkeypatch.setattr(nearest, "fit", lambda rows, dim, **kw: coarse.fit(rows, dim, rows_per_list=rows_per_list, **kw))
    c, _ = clustered(0, [200, 5, 8, 30, 60, 1, 1, 90, 12, 40])
    q = c[::9] * 3 + 0.001
    got = nearest.nearest_vectors(frame(spark, enumerate(q)), frame(spark, enumerate(c)), 5).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_idx, set()).add(r.idx)
    hits = sum(len(found[i] & set(b)) for i, b in enumerate(brute(q, c, 5)))
    assert hits / (5 * len(q)) >= 0.95 and len(got) == 5 * len(q)


@pytest.mark.parametrize("queries_at_once", [4096, 20])
def test_scattered_neighbours_are_found_in_the_whole_corpus(spark, monkeypatch, tmp_path, queries_at_once):
    from sparseloom.llm import queries

    monkeypatch.setattr(nearest, "QUERIES_AT_ONCE", queries_at_once)
    monkeypatch.setattr(nearest, "fit", lambda rows, dim, **kw: coarse.fit(rows, dim, rows_per_list=20, **kw))
    c = np.random.default_rng(4).standard_normal((2500, 64))  # no groups: the best lie in any list
    rows = list(enumerate(c))
    frame(spark, rows + rows[:60] + [(3000 + i, b) for i, b in enumerate(BAD)]).write.parquet(f"{tmp_path}/corpus.parquet")
    found = {}
    for r in queries.p2_passages(spark, str(tmp_path)).orderBy("query_idx", "rank").collect():
        found.setdefault(r.query_idx, []).append(r.idx)
    expected = brute(c[::50], c, 6)
    hits = sum(len(set(found[50 * i]) & set(b)) for i, b in enumerate(expected))
    assert hits / (6 * len(expected)) >= 0.98 and all(len(f) == 6 for f in found.values())


def test_nearest_ties_repeats_and_bad_rows(spark):
    v = np.eye(64)
    corpus = [(9, v[0]), (3, v[0] * 2), (5, v[0]), (5, v[0]), (1, v[1]), (None, v[0])] + [(100 + i, b) for i, b in enumerate(BAD)]
    got = nearest.nearest_vectors(frame(spark, [(0, v[0]), (0, v[0]), (7, None)]), frame(spark, corpus), 3).orderBy("rank").collect()
    assert [(r.query_idx, r.idx, r["rank"]) for r in got] == [(0, 3, 1), (0, 5, 2), (0, 9, 3)]


def test_hot_lists_are_cut_on_both_sides(spark, monkeypatch):
    """Queries and corpus rows of one direction: no group holds much more than a block of either side, and every two blocks meet."""
    monkeypatch.setattr(coarse, "BLOCK", 1000)
    v = [1.0] + [0.5] * 63
    q = spark.range(20_000).select(F.col("id").alias("idx"), F.array(*(F.lit(x) for x in v)).alias("vec"))
    c = spark.range(5_000).select((F.col("id") + 100_000).alias("idx"), F.array(*(F.lit(x) if i else F.lit(x) + F.col("id") * 1e-6 for i, x in enumerate(v))).alias("vec"))
    lists = coarse.fit(c, 64, count=5_000)
    qb, cb = coarse.count_blocks(q, 20_000, lists, 2, 64), coarse.count_blocks(c, 5_000, lists, 1, 64)
    schema = "list int, own_block int, other_block int, idx long, u array<double>"
    left = q.mapInArrow(nearest._placer(lists, 2, 64, qb, cb), schema).groupBy("list", F.col("own_block").alias("q"), F.col("other_block").alias("c")).count()
    right = c.mapInArrow(nearest._placer(lists, 1, 64, cb, qb, 5), schema).groupBy("list", F.col("own_block").alias("c"), F.col("other_block").alias("q")).count()
    assert left.agg(F.max("count")).first()[0] <= 1300 and right.agg(F.max("count")).first()[0] <= 1300
    met = left.join(right, ["list", "q", "c"]).count()
    assert met == left.join(right, "list", "left_semi").count() == right.join(left, "list", "left_semi").count() >= 20


def test_copies_beyond_k_stay_behind():
    u = np.repeat(np.eye(4), [6, 1, 3, 2], axis=0)
    idx = np.array([9, 4, 7, 1, 3, 3, 20, 5, 5, 2, 8, 6])
    keep = nearest._few_copies(idx, u, 2)
    assert sorted(idx[keep].tolist()) == sorted([1, 3, 20, 2, 5, 6, 8])


def test_two_levels_of_lists(spark):
    """More lists than centres: neighbours still lie in the lists that are probed, and every row is in one."""
    c, _ = clustered(5, [20] * 120)
    rows = frame(spark, enumerate(c)).select("idx", "vec")
    lists = coarse.fit(rows, 64, rows_per_list=4, most=30)
    assert lists.count >= 500 and len(lists.centres) == 30
    u = unit(c)
    home, near = lists.nearest(u)[:, 0], lists.nearest(u, 12)
    assert (near[:, 0] == home).mean() > 0.97 and home.max() < lists.count
    best = brute(c[::7], c, 5)
    assert np.mean([home[j] in near[7 * i] for i, b in enumerate(best) for j in b]) >= 0.97


def test_more_lists_are_probed_where_neighbours_scatter(spark):
    scattered = frame(spark, enumerate(np.random.default_rng(4).standard_normal((1500, 64)))).select("idx", "vec")
    grouped = frame(spark, enumerate(clustered(1, [15] * 100)[0])).select("idx", "vec")
    probes = {}
    for name, df in (("scattered", scattered), ("grouped", grouped)):
        lists = coarse.fit(df, 64, rows_per_list=20)
        probes[name] = nearest.measured_probes(df, df, lists, 5, 64)
        assert probes[name] <= lists.count
    assert probes["grouped"] < 25 < probes["scattered"]


def test_nearest_empty(spark):
    some, none = frame(spark, [(0, np.ones(64))]), frame(spark, [])
    assert nearest.nearest_vectors(none, some).count() == 0 and nearest.nearest_vectors(some, none).count() == 0
    assert [r.idx for r in nearest.nearest_vectors(some, some).collect()] == [0]


def test_the_scan_abandons_candidates():
    c, _ = clustered(1, [20] * 60)
    q = c[::20]
    stats = {}
    a, b = nearest.adaptive_scan(unit(q), unit(c), 5, stats=stats)
    assert stats["after_first"] < 0.2 * stats["pairs"]
    for i, best in enumerate(brute(q, c, 5)):
        assert set(best) <= set(b[a == i])


@pytest.mark.parametrize("few", [0.0, 0.05, 1.0])
def test_the_scan_gives_little_more_than_the_nearest(monkeypatch, few):
    monkeypatch.setattr(nearest, "FEW_STAY", few, raising=False)
    # one list: its first columns tell little, so that most of it stays after them
    c, _ = clustered(4, [2500], noise=0.08)
    c[7] = c[1200] = c[2400]  # copies in each of its parts
    q = np.concatenate([c[::50], c[7:8]])
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((64, 64)))[0]
    stats = {}
    a, b = nearest.adaptive_scan(unit(q) @ turn, unit(c) @ turn, 5, stats=stats)
    assert stats["after_first"] > 0.2 * stats["pairs"]
    for i, best in enumerate(brute(q, c, 5)):
        assert set(best) <= set(b[a == i])
    if few == 0.05:
        # 5 of each of the 3 parts, as later ones have a limit
        assert len(a) <= len(q) * 5 * 3
    # no further than a limit that is given: the k best and copies of the k-th
    kth = np.sort(2 - 2 * unit(q) @ unit(c).T, axis=1)[:, 4]
    a, b = nearest.adaptive_scan(unit(q) @ turn, unit(c) @ turn, 5, most=kth)
    for i, best in enumerate(brute(q, c, 5)):
        assert set(best) <= set(b[a == i])
    assert len(a) <= len(q) * 7


CODES = "idx long, code array<int>, class string, first_idx int"


def code_frame(spark, rows):
    return spark.createDataFrame([(i, c, "x", 1) for i, c in rows], CODES)


def test_nearest_codes_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = [rng.choice(3200, 16, replace=False) for _ in range(12)]

    def near(b, change):
        b = b.copy()
        b[rng.choice(16, change, replace=False)] = rng.choice(np.setdiff1d(np.arange(3200), b), change, replace=False)
        return [int(x) for x in rng.permutation(b)]

    corpus = [(i, near(base[i % 12], int(rng.integers(0, 5)))) for i in range(90)] + [(500 + i, near(base[0], 0)) for i in range(9)]
    queries = [(i, near(b, 2)) for i, b in enumerate(base)] + [(50, near(base[0], 12)), (51, [int(x) for x in range(3000, 3016)]), (52, near(base[3], 2))]
    bad = [(900, None), (901, [1, 2]), (902, [5] * 16), (903, [int(x) for x in range(15)] + [None]), (904, list(range(15)) + [3200]), (None, list(range(16)))]
    got = {}
    for r in nearest.nearest_codes(code_frame(spark, queries + queries[:1] + bad), code_frame(spark, corpus + corpus[:5] + bad)).orderBy("query_idx", "rank").collect():
        got.setdefault(r.query_idx, []).append((r.hamming, r.idx))
    for i, q in queries:
        expected = sorted((32 - 2 * len(set(q) & set(c)), j) for j, c in corpus)[:5]
        assert got[i] == expected, i
    assert set(got) == {i for i, _ in queries}


@pytest.mark.parametrize(("few", "at_once", "width"), [(0.0, 2_000_000, 3200), (0.05, 3_000, 3200), (1.0, 2_000_000, 3200), (0.05, 2_000_000, 90)])
def test_the_code_scan_has_the_best(monkeypatch, few, at_once, width):
    monkeypatch.setattr(nearest, "FEW_STAY", few, raising=False)
    monkeypatch.setattr(nearest, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    # some bits in many codes, most in few
    weight = 1 / (1 + np.arange(width)[::-1])
    codes = np.sort([rng.choice(width, 16, replace=False, p=weight / weight.sum()) for _ in range(400)], axis=1)
    q, c = codes[:60].copy(), codes[40:]
    q[3] = np.setdiff1d(np.arange(width), c[:6])[:16] if width > 2000 else q[3]
    true = (q[:, None, :, None] == c[None, :, None, :]).sum((2, 3))
    for floor in (None, np.sort(true, axis=1)[:, -5]):
        a, b, shared = nearest.code_scan(q, c, 5, width, floor)
        assert (shared == true[a, b]).all()
        best = nearest.best_k(a, b, shared.astype(np.int64), 5)
        expected = [(i, j) for i, row in enumerate(true) for j in sorted(range(len(c)), key=lambda j: (-row[j], j))[:5]]
        assert list(zip(a[best].tolist(), b[best].tolist())) == expected


def test_codes_that_share_nothing_are_not_gathered():
    q, c = np.arange(16)[None, :], np.arange(16, 16 + 16 * 180).reshape(180, 16)
    a, b, shared = nearest.code_scan(q, c, 5, 3200)
    assert b.tolist() == [0, 1, 2, 3, 4] and not shared.any()


def test_nearest_codes_empty(spark):
    one, none = code_frame(spark, [(4, list(range(16)))]), code_frame(spark, [])
    assert nearest.nearest_codes(none, one).count() == 0 and nearest.nearest_codes(one, none).count() == 0
    assert [tuple(r) for r in nearest.nearest_codes(one, one).collect()] == [(4, 4, 0, 1)]


# ---- clusters


def test_clusters_are_the_groups(spark, monkeypatch):
    monkeypatch.setattr(coarse, "BLOCK", 40)
    monkeypatch.setattr(spectral, "fit", lambda rows, dim, **kw: coarse.fit(rows, dim, **(kw | {"rows_per_list": 60})))
    x, group = clustered(2, [150, 3, 4, 1, 1, 30, 7, 2], noise=0.015)
    rows = [(i, v * (1 + i % 3)) for i, v in enumerate(x)]
    out = spectral.spectral_clusters(frame(spark, rows + rows[:4] + [(1000 + i, b) for i, b in enumerate(BAD)] + [(None, x[0])])).collect()
    assert len(out) == len(x)
    first = {g: int(np.flatnonzero(group == g)[0]) for g in set(group)}
    assert {(r.idx, r.cluster, r.size) for r in out} == {(i, first[g], int((group == g).sum())) for i, g in enumerate(group)}
    assert all(r.tight for r in out)
    top = {r.cluster: r for r in spectral.describe(spark.createDataFrame(out)).collect()}
    u = unit(x[group == 0])
    mean = (u @ u.sum(0)) / len(u)
    assert top[0]["size"] == 150 and set(top[0].typical) == set(np.argsort(-mean, kind="stable")[:5].tolist()) and len(top) == 6


def test_a_chain_is_no_group(spark):
    a = np.linspace(0, 1.2, 5)  # neighbours are similar, the ends are not
    x = np.zeros((5, 64))
    x[:, 0], x[:, 1] = np.cos(a), np.sin(a)
    out = spectral.spectral_clusters(frame(spark, list(enumerate(x)))).collect()
    assert len(out) == 5 and not any(r.tight and r.isolated for r in out)


def test_a_wide_group_stays_whole(spark):
    rng = np.random.default_rng(3)
    centre = unit(rng.standard_normal(64))
    aside = rng.standard_normal((200, 64))
    x = unit(centre + 0.385 * unit(aside - np.outer(aside @ centre, centre)))
    s = x @ x.T
    assert s.min() >= 0.80 and 0.86 < s.mean() < 0.88  # nearly every record is a leader
    out = spectral.spectral_clusters(frame(spark, list(enumerate(x)))).collect()
    assert {(r.idx, r.cluster, r.size, r.tight, r.isolated) for r in out} == {(i, 0, 200, True, True) for i in range(200)}


def test_clusters_of_copies_and_of_nothing(spark):
    out = spectral.spectral_clusters(frame(spark, [(i, np.ones(64)) for i in (7, 3, 5)])).collect()
    assert {(r.idx, r.cluster, r.size, r.tight) for r in out} == {(i, 3, 3, True) for i in (7, 3, 5)}
    assert spectral.spectral_clusters(frame(spark, [])).count() == 0
    assert spectral.describe(spectral.spectral_clusters(frame(spark, [(0, np.ones(64))]))).count() == 0


def jobs_of(spark, name, make):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        return make().collect(), len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_two_tables_share_their_jobs(spark, tmp_path):
    from sparseloom.llm import queries

    # the same idx in both tables, in other groups; two of the second are where one of the first is
    groups = {"corpus": [4, 3, 1, 6], "labeled": [1, 5, 2, 3]}
    vectors = {t: clustered(5 + i, sizes, noise=0.015) for i, (t, sizes) in enumerate(groups.items())}
    vectors["labeled"][0][6:8] = vectors["corpus"][0][:2]
    for t, (x, _) in vectors.items():
        frame(spark, list(enumerate(x))).write.parquet(f"{tmp_path}/{t}.parquet")
    _, one = jobs_of(spark, "one table", lambda: spectral.spectral_clusters(spark.read.parquet(f"{tmp_path}/corpus.parquet")))
    out, two = jobs_of(spark, "two tables", lambda: queries.p1_found(spark, str(tmp_path)))
    assert {tuple(r) for r in out} == {(t, i, int(np.flatnonzero(g == g[i])[0])) for t, (_, g) in vectors.items() for i in range(len(g)) if (g == g[i]).sum() >= 3}
    assert two < 1.5 * one
    described = queries.p1_clusters(spark, str(tmp_path)).collect()
    assert {(r.table_name, r.cluster, r["size"]) for r in described} == {(t, int(np.flatnonzero(g == k)[0]), n) for t, (_, g) in vectors.items() for k, n in enumerate(groups[t]) if n >= 2}


# ---- overlap


def split(spark, rows):
    schema = "idx long, role string, source string, vec array<double>, h1 string, keys string, rep int"
    return spark.createDataFrame([(i, r, s, None if v is None else list(map(float, v)), "x", "y", 1) for i, r, s, v in rows], schema)


def test_overlap_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    train = rng.standard_normal((300, 64))
    other = np.concatenate([train[:40] * 2, train[40:80] + 0.12 * rng.standard_normal((40, 64)), train[80:110] + 0.3 * rng.standard_normal((30, 64)), rng.standard_normal((60, 64))])
    rows = [(i, "train", "a", v) for i, v in enumerate(train)] + [(1000 + i, "db" if i % 2 else "query", "b", v) for i, v in enumerate(other)]
    rows += rows[:3] + rows[-3:] + [(5000, "db", None, BAD[2]), (5001, "train", None, None), (None, "db", "b", train[0]), (5002, None, "b", np.eye(64)[0])]
    got = {(r.train_idx, r.eval_idx) for r in overlap.cross_split_pairs(split(spark, rows), F.col("role") == "train").collect()}
    s = unit(train) @ unit(other).T
    expected = {(i, 1000 + j) for i, j in zip(*np.nonzero(s >= 0.975))}
    assert got == expected and len(got) > 60


def test_overlap_of_copies_and_report(spark):
    v = np.eye(64)
    rows = [(i, "train", "a", v[0]) for i in range(4)] + [(10 + i, "db", s, v[0] * 3) for i, s in enumerate(("b", "B ", None))] + [(20, "query", "b", v[1])]
    df = split(spark, rows)
    pairs, members = overlap.class_pairs(df, F.col("role") == "train")
    assert [(r.eval_rep, r.train_rep, r.exact) for r in pairs.collect()] == [(10, 0, True)] and members.count() == 7
    assert overlap.cross_split_pairs(df, F.col("role") == "train").count() == 12
    assert {tuple(r) for r in overlap.overlap_report(df, F.col("role") == "train").collect()} == {("db", "b", 2, 2, 0, 8, 0), ("db", "unknown", 1, 1, 0, 4, 0), ("query", "b", 1, 0, 0, 0, 0)}
    none = split(spark, [])
    assert overlap.cross_split_pairs(none, F.col("role") == "train").count() == 0 and overlap.overlap_report(none, F.col("role") == "train").count() == 0


def test_overlap_of_near_classes_and_of_an_idx_with_two_vectors(spark):
    rng = np.random.default_rng(5)
    base = unit(rng.standard_normal((3, 64)))
    near = unit(base[0] + 0.02 * rng.standard_normal(64))
    rows = [(i, "train", "a", base[0] * (1 + i)) for i in range(3)] + [(3, "train", "a", base[1]), (3, "train", "a", base[2])]
    rows += [(10 + i, "db", "b", near * (1 + i)) for i in range(2)] + [(20, "query", "b", base[1] * 2), (21, "query", "b", base[2] * 2), (21, "query", "b", base[1])]
    df = split(spark, rows)
    got = {(r.eval_idx, r.train_idx, r.exact) for r in overlap.cross_split_pairs(df, F.col("role") == "train").collect()}
    assert got == {(10 + i, j, False) for i in range(2) for j in range(3)} | {(20, 3, True), (21, 3, True)}
    assert {tuple(r) for r in overlap.overlap_report(df, F.col("role") == "train").collect()} == {("db", "b", 2, 0, 2, 0, 6), ("query", "b", 2, 2, 0, 3, 0)}


def test_hashes_are_enough():
    """The share of pairs at the threshold that no hash joins."""
    rng = np.random.default_rng(9)
    a = unit(rng.standard_normal((4000, 64)))
    b = rng.standard_normal(a.shape)
    b = 0.975 * a + np.sqrt(1 - 0.975**2) * unit(b - (b * a).sum(1, keepdims=True) * a)
    frames, hashes = overlap.hash_shape(100_000, 0.975)
    met = np.zeros(len(a), bool)
    for _ in range(hashes):
        same = np.ones(len(a), bool)
        for n in frames:
            f = rng.standard_normal((64, n))
            same &= overlap.nearest_axis(a @ f) == overlap.nearest_axis(b @ f)
        met |= same
    assert met.mean() >= 0.997
    sketch = lambda x: overlap.sketched(x, overlap.sketch_frame(64))
    assert (np.abs(sketch(a) - sketch(b)).sum(1) <= overlap.sketch_reach(0.975, 64)).mean() >= 0.999
