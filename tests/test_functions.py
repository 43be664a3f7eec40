import numpy as np
import pytest
from pyspark.sql import functions as F

from sparseloom.functions import codes, text, topk, vec


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_vector_algebra(spark):
    assert one(spark, vec.dot("a", "b"), a=[1.0, 2.0, 3.0], b=[4.0, 5.0, 6.0]) == 32
    assert one(spark, vec.p_norm("a"), a=[3.0, 4.0]) == 5
    assert one(spark, vec.p_norm("a", 1), a=[-1.0, 2.0, -3.0]) == 6
    assert one(spark, vec.p_norm("a", 3), a=[1.0, 2.0]) == pytest.approx(9 ** (1 / 3))
    assert one(spark, vec.normalize("a"), a=[0.0, 0.0]) == [0, 0]
    assert one(spark, vec.squared_l2("a", "b"), a=[1.0, 2.0], b=[3.0, 5.0]) == 13
    assert one(spark, vec.cosine("a", "b"), a=[2.0, 0.0], b=[3.0, 3.0]) == pytest.approx(2**-0.5)
    # no NaN where a weight is 0 and p < 2
    assert one(spark, vec.weighted_score("a", "b", 1.5), a=[0.0, -4.0], b=[5.0, 2.0]) == -4


def test_sizes_must_agree(spark):
    for f in (vec.dot, vec.squared_l2):
        with pytest.raises(Exception, match="different size"):
            one(spark, f("a", "b"), a=[1.0], b=[1.0, 2.0])
    with pytest.raises(ValueError):
        vec.weight_matrix([[1.0], [1.0, 2.0]])


def test_finite(spark):
    assert one(spark, vec.is_finite("a"), a=[1.0, 2.0])
    for bad in ([float("nan")], [float("inf")], [1.0, None]):
        assert not one(spark, vec.is_finite(F.lit(bad) if None not in bad else F.array(F.lit(1.0), F.lit(None).cast("double"))))


def test_top_k_cases(spark):
    assert one(spark, topk.top_k_indices("s", 2), s=[1.0, 5.0, 3.0, 2.0]) == [1, 2]
    assert one(spark, topk.top_k_indices("s", 2), s=[5.0, 5.0, 1.0]) == [0, 1]
    assert one(spark, topk.rank_indices("s"), s=[1.0, 5.0, 3.0]) == [1, 2, 0]
    assert one(spark, topk.top_k_indices("s", 0), s=[1.0]) == []
    assert one(spark, topk.positive_indices("s"), s=[0.0, 1.0, -1.0, 2.0]) == [1, 3]
    with pytest.raises(Exception, match="larger"):
        one(spark, topk.top_ranked("s", 3), s=[1.0])
    with pytest.raises(ValueError):
        topk.np_top_k_indices(np.zeros(3), 4)


def test_top_k_equals_sorting(spark):
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, 4, n).astype(float) for n in rng.integers(1, 12, 60)]
    for s in rows:
        k = int(rng.integers(0, len(s) + 1))
        expected = sorted(sorted(range(len(s)), key=lambda i: (-s[i], i))[:k])
        assert topk.np_top_k_indices(s[None, :], k)[0].tolist() == expected
    table = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(rows)], "i long, s array<double>")
    for r in table.select("i", topk.rank_indices("s").alias("r")).collect():
        assert r.r == topk.np_rank_indices(rows[r.i]).tolist()


def test_codes(spark):
    assert one(spark, codes.hamming("a", "b"), a=[1, 3, 5], b=[3, 5, 7]) == 2
    assert one(spark, codes.hamming("a", "b"), a=[1, 2], b=[3, 4]) == 4
    assert one(spark, codes.hamming("a", "b"), a=[1, 2, 3], b=[3]) == 2
    assert one(spark, codes.from_units("a"), a=[3, 1, 3]) == [1, 3]
    assert one(spark, codes.is_code("a", 2), a=[1, 3]) and not one(spark, codes.is_code("a"), a=[3, 1])
    with pytest.raises(Exception, match="sorted code"):
        one(spark, codes.checked("a"), a=[1, 1])


def test_sql_functions(spark):
    codes.register(spark)
    assert spark.sql("SELECT code_hamming(array(1,3,5), array(3,5,7)) AS x").first().x == 2
    assert spark.sql("SELECT code_top_k(array(1D,5D,3D,2D), 2) AS x").first().x == [1, 2]
    assert spark.sql("SELECT vec_dot(array(1D,2D), array(3D,4D)) AS x").first().x == 11


def test_text(spark):
    assert one(spark, text.passage_text("a", "b"), a="A", b="alpha") == "A\nalpha"
    assert one(spark, text.passage_text(F.lit(None).cast("string"), F.lit(" x "))) == "x"
    assert one(spark, text.word_count("a"), a=" one\ttwo three\n") == 3
    assert one(spark, text.split_paragraphs("a"), a="a\n\nb\n \n c \n\n\n") == ["a", "b", "c"]
    assert one(spark, text.strip_boilerplate("a"), a="x\n*** START OF IT ***\nbody\n*** END OF IT ***\ny") == "body"
    assert one(spark, text.strip_boilerplate("a"), a=" plain ") == "plain"
    assert one(spark, text.strip_boilerplate("a"), a="x *** START OF") == "*** START OF"
    assert one(spark, text.strip_html("a"), a="<p>x</p>  y\n\n\n\nz") == " x y\n\nz"
    assert one(spark, text.strip_html("a"), a="x" * 250 + "<b>") == "x" * 250 + "<b>"
    assert not one(spark, text.is_narrative("a"), a="Collected Poems") and one(spark, text.is_narrative("a"), a="A Tale")
    assert one(spark, text.chunk_id("a", F.lit(7)), a="book") == "book-0007"


def chunk_oracle(pieces, least, most, joiner="\n\n"):
    chunks, current, n = [], [], 0
    for p in pieces:
        k = len(p.split())
        if current and n + k > most:
            chunks.append(joiner.join(current))
            current, n = [p], k
        else:
            current, n = [*current, p], n + k
            if n >= least:
                chunks.append(joiner.join(current))
                current, n = [], 0
    if current:
        if chunks and n < least // 2:
            chunks[-1] += joiner + joiner.join(current)
        else:
            chunks.append(joiner.join(current))
    return chunks


def test_chunking_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    docs = [[" ".join(["w"] * int(n)) for n in rng.integers(1, 40, rng.integers(0, 15))] for _ in range(60)]
    table = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i long, p array<string>")
    for r in table.select("i", text.chunk_pieces("p", 25, 35).alias("c")).collect():
        assert r.c == chunk_oracle(docs[r.i], 25, 35)
