"""Problems 3, 5, 7, 8, 9 and 10."""

import base64
import os
import re

import numpy as np
import pytest

from sparseloom.llm import chunks, garble, mix, pack, reading, tokens

needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer files")


# ---- tokens


@needs_vocabulary
def test_counts_equal_the_tokenizer():
    import tiktoken

    with open(tokens.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    e = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(0)
    alphabet = list("aab cde.,'\n\t  éüЖя日本🙂½٣ Ⅷ \x00퟿")
    texts = ["", " ", "   \n\n x", "don't we'll", "aaaaaaaaaaaaaaaa", "\r\n\r\n", "x" * 3000, "ab" * 2000, "12345 678", "naïve Straße ещё"]
    texts += ["".join(rng.choice(alphabet, int(rng.integers(1, 80)))) for _ in range(400)]
    assert tokens.PairMerger(tokens.TOKENIZER).count([*texts, None]) == [*(len(e.encode_ordinary(t)) for t in texts), 0]


def corpus(spark, rows):
    schema = "idx long, title string, text string, book_slug string, loaded_at timestamp, slug string, n int, lang string, tokens int"
    from datetime import datetime

    full = [(i, ti, te, s, None if t is None else datetime(2024, 1, t), "x", 1, "zz", 5) for i, ti, te, s, t in rows]
    return spark.createDataFrame(full, schema)


def books(spark, rows):
    return spark.createDataFrame(rows, "book_slug string, title string, lang string, domain string")


@needs_vocabulary
def test_budget(spark):
    c = corpus(spark, [(1, None, "one two", "a-b", 1), (1, None, "one two three", "A_B ", 2), (2, None, None, "a-b", 1), (3, None, "x", None, 1), (4, None, "y y", "other", None), (5, None, " ", " ", 1)])
    b = books(spark, [("a-b", "t", "en", None), ("a-b", "t", "en", "novel"), (None, "t", "fr", "x")])
    assert {tuple(r) for r in tokens.passage_tokens(c, b).collect()} == {(1, "a-b", "en", "novel", 3), (2, "a-b", "en", "novel", 0), (3, "unknown", "unknown", "unknown", 1), (4, "other", "unknown", "unknown", 2), (5, "unknown", "unknown", "unknown", 1)}
    total = {(r.slice, r.value): (r.passages, r.tokens) for r in tokens.token_budget(c, b).collect()}
    assert total["all", "all"] == (5, 7) and total["lang", "en"] == (2, 3) and total["book_slug", "unknown"] == (2, 2)
    assert tokens.token_budget(corpus(spark, []), b).count() == 0 and tokens.passage_tokens(c, books(spark, [])).count() == 5


# ---- chunks


def prose(rng, n):
    words = []
    for i in range(n):
        words.append("w%d" % rng.integers(50) + (".\n\n" if i % 61 == 60 else ". " if i % 13 == 12 else " "))
    return "".join(words)


def test_pieces_keep_all_words_in_order():
    rng = np.random.default_rng(0)
    for n in (0, 1, 349, 350, 351, 700, 3000):
        text = prose(rng, n)
        made = chunks.pieces(text)
        words = text.split()
        if n == 0:
            assert made == []
            continue
        assert all(k <= 350 for _, _, k in made) and (len(made) == 1) == (n <= 350)
        joined = made[0][0].split()
        for (before, _, _), (piece, first, k) in zip(made, made[1:]):
            w = piece.split()
            assert w[:40] == before.split()[-40:] and len(w) == k and words[first : first + k] == w
            joined += w[40:]
        assert joined == words
        ends = [p.rstrip()[-1] for p, _, _ in made[:-1]]
        assert all(e == "." for e in ends)


def test_no_boundaries_and_long_words():
    assert [k for _, _, k in chunks.pieces("word " * 400)][0] <= 350
    assert len(chunks.pieces("x" * 1_000_000)) == 1
    assert sum(k for _, _, k in chunks.pieces("\ta " * 351)) == 351 + 40 and chunks.pieces(" \n\t\r") == []


def test_an_edit_changes_only_pieces_near_it():
    text = prose(np.random.default_rng(3), 12_000)
    words = text.split(" ")
    edited = " ".join(words[:100] + ["new", "words"] + words[100:])
    a, b = ([p for p, _, _ in chunks.pieces(t)] for t in (text, edited))
    assert len(set(a) - set(b)) <= 12 < len(a)


def test_split_oversized(spark):
    rng = np.random.default_rng(0)
    long, longer = prose(rng, 500), prose(rng, 800)
    rows = [(1, None, long, "b", 1), (1, None, long, "b", 1), (2, None, longer, None, 1), (2, None, "short now", "b", 2), (3, None, None, "b", 1), (4, None, "", "b", 1), (5, None, long, "b", None), (None, None, long, "b", 1)]
    out = chunks.split_oversized(corpus(spark, rows)).orderBy("idx", "piece_no").collect()
    assert {r.idx for r in out} == {1, 5} and [(r.piece_no, r.n_words, r.piece) for r in out if r.idx == 1] == [(i, k, p) for i, (p, _, k) in enumerate(chunks.pieces(long))]
    assert chunks.split_oversized(corpus(spark, [])).count() == 0
    with pytest.raises(ValueError):
        chunks.split_oversized(corpus(spark, []), overlap=350)


# ---- packing


def test_bounds_hold_and_packing_fits():
    rng = np.random.default_rng(0)
    for _ in range(40):
        cap = int(rng.integers(1, 200))
        sizes = rng.integers(1, cap + 1, int(rng.integers(1, 80)))
        box = pack.best_fit_decreasing(sizes, cap)
        fill = np.bincount(box, weights=sizes)
        assert fill.max() <= cap and (fill > 0).all() and pack.lower_bound(sizes, cap) <= len(fill)
    assert pack.lower_bound(np.array([60] * 10), 100) == 10 and pack.lower_bound(np.array([34] * 9), 100) == 5 and pack.lower_bound(np.array([], int), 5) == 0


@pytest.mark.parametrize("per_partition", [20_000, 60])
def test_pack(spark, per_partition):
    rng = np.random.default_rng(1)
    size = np.minimum(rng.lognormal(4, 1, 400).astype(int) + 1, 3000)
    docs = spark.createDataFrame([(i, int(s), "x", 3) for i, s in enumerate(size)] + [(900, 0, "x", 3), (901, None, "x", 3), (None, 5, "x", 3)], "doc_id long, tokens long, container string, capacity int")
    specs = spark.createDataFrame([("a", 500), ("b", 100), ("b", 90), (None, 10), ("c", 0), ("d", None)], "spec_name string, capacity_tokens int")
    out = pack.pack(docs, specs, per_partition)
    rows = out.collect()
    for spec, cap in (("a", 500), ("b", 100)):
        mine = [r for r in rows if r.spec_name == spec]
        fill, whole, cut = {}, {}, {}
        for r in mine:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
            whole[r.doc_id] = whole.get(r.doc_id, 0) + r.tokens
            cut.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
        assert max(fill.values()) <= cap and whole == {i: int(s) for i, s in enumerate(size)}
        for d, parts in cut.items():
            assert len(parts) == -(-int(size[d]) // cap)
            at = 0
            for first, n in sorted(parts):
                assert first == at
                at += n
        report = {r.spec_name: r for r in pack.pack_report(out).collect()}[spec]
        assert report.containers == len(fill) and report.lower_bound <= len(fill) <= 1.05 * report.lower_bound + 1
        assert report.cut_documents == int((size > cap).sum())
    assert pack.pack(docs.limit(0), specs).count() == 0 and pack.pack(docs, specs.limit(0)).count() == 0


# ---- mixing


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


TARGETS = [("a", 0.5, 1), ("b", 0.3, 4), ("gone", 0.2, 3), (None, 0.1, 1), ("z", 0.0, 1), ("n", None, 1)]


def test_mix_shares_and_caps(spark):
    t = spark.createDataFrame(TARGETS, "source string, weight double, max_repeats int")
    s = sizes(spark, [(i, "a", 10) for i in range(4000)] + [(10_000 + i, "b", 10) for i in range(300)] + [(20_000, "other", 5), (20_001, None, 5)])
    table = {r.source: r for r in mix.rates(s, t).collect()}
    total = mix.TOTAL_SHARE * 43_000
    assert set(table) == {"a", "b", "gone"} and table["gone"].rate == 0
    assert table["a"].rate == pytest.approx(total * 0.625 / 40_000) and table["b"].rate == pytest.approx(total * 0.375 / 3_000)
    plan = mix.seeded(s, mix.rates(s, t))
    drawn = mix.draw(s, plan).collect()
    got = {"a": 0, "b": 0}
    for r in drawn:
        got[r.source] += r.tokens
    assert got["a"] / sum(got.values()) == pytest.approx(0.625, abs=0.005) and sum(got.values()) == pytest.approx(total, rel=0.01)
    assert max(r.copy_no for r in drawn) == 3
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, mix.draw(s.repartition(7), mix.seeded(s.repartition(5), mix.rates(s, t))).collect()))
    capped = {r.source: r.rate for r in mix.rates(s, t, total_tokens=10**9).collect()}
    assert capped == {"a": 1, "b": 4, "gone": 0}
    # b reaches its cap, a gives the rest
    rest = {r.source: r.rate for r in mix.rates(s, t, total_tokens=40_000).collect()}
    assert rest["b"] == 4 and rest["a"] == pytest.approx(0.7)
    none = mix.rates(s.limit(0), t)
    assert mix.draw(s.limit(0), mix.seeded(s.limit(0), none)).count() == 0 and mix.rates(s, t.limit(0)).count() == 0


def test_a_tiny_source_does_not_throttle_the_mix(spark):
    t = spark.createDataFrame([("big", 0.5, 2), ("tiny", 0.5, 2)], "source string, weight double, max_repeats int")
    s = sizes(spark, [(i, "big", 10) for i in range(2000)] + [(9000, "tiny", 10)])
    rates = {r.source: r.rate for r in mix.rates(s, t).collect()}
    assert rates["tiny"] == 2 and rates["big"] == pytest.approx((0.5 * 20_010 - 20) / 20_000)


@needs_vocabulary
def test_mix_report(spark):
    docs = spark.createDataFrame([(i, "one two three", " A-x" if i % 2 else "a_x", 1, "q") for i in range(40)] + [(50, None, "a_x", 1, "q"), (None, "x", "a_x", 1, "q"), (51, "x", None, 1, "q")], "doc_id long, text string, source string, rate int, tokens string")
    t = spark.createDataFrame([("a_x", 1.0, 2), ("b", 1.0, 1)], "source string, weight double, max_repeats int")
    r = {x.source: x for x in mix.mix_report(docs, t).collect()}
    assert abs(r["a_x"].emitted - 20) <= 1 and r["a_x"].share == 1 and r["b"].share == 0
    assert mix.mix_report(docs.limit(0), t).count() == 2


# ---- garbled text

CLEAN = {
    "es": "El párrafo está más allá del jardín y la niña leyó después una canción según él. El capítulo último comparó la búsqueda rápida. Años después, también.",
    "ru": "Следующий запрос улучшает большой указатель. Жёлтый лист видел тихий сосед у реки после второго измерения.",
    "pl": "Żółta kartka później odnalazła światło nad rzeką. Większy indeks pominął źrebię, także wśród zapytań.",
    "en": "The Café of the Lantern — a Romance. “I have not seen Zoë,” said the tutor… It’s near −3 °C and 7× more.",
    "de": "Der frühere Bericht überdeckt die müde Leserin über mehrere Größen. Der Bär hört das Öl später.",
}


def garbled(text, written, read):
    return text.encode(written).decode(read)


def garble_tables(spark):
    rows, damaged = [], {}
    langs = list(CLEAN)
    n = 0
    for lang in langs:
        for s in re.split(r"(?<=[.…]) ", CLEAN[lang]):
            for _ in range(8):
                rows.append((n, None, s, f"book-{lang}", 1))
                n += 1
    for written, read, lang in (("utf-8", "cp1252", "de"), ("utf-8", "mac_roman", "es"), ("utf-8", "cp437", "es"), ("utf-8", "cp1251", "ru"), ("cp1251", "cp1252", "ru"), ("koi8-r", "cp1251", "ru"), ("cp1252", "mac_roman", "es"), ("cp1250", "cp1252", "pl"), ("utf-8", "cp850", "en")):
        text = re.split(r"(?<=[.…]) ", CLEAN[lang])[0]
        try:
            damaged[n] = text
            rows.append((n, None, garbled(text, written, read), f"book-{lang}", 1))
        except UnicodeError:
            damaged.pop(n)
            continue
        n += 1
    twice = garbled(garbled("über mehrere Größen", "utf-8", "cp1252"), "utf-8", "cp1252")
    damaged[n] = f"Der Bär hört. {'über mehrere Größen'}"
    rows.append((n, twice.replace("Ã", "Ã"), f"Der Bär hört. {twice}", "book-de", 1))
    lost = n + 1
    rows.append((lost, None, "El p�rrafo est�", "book-es", 1))
    rows += [(lost + 1, None, None, None, None), (lost + 2, "", " ", "book-es", 1), (None, None, "Ã©", "x", 1), (lost + 3, "SÃO PAULO", "m² ±1 3½ §5 †x", "book-en", 1), (lost + 4, "plain", "x" * 200_000, "book-en", 1)]
    return corpus(spark, rows + rows[-8:]), books(spark, [(f"book-{x}", "t", x, "d") for x in langs]), damaged, lost, n


def test_garbled_values_are_found_and_restored(spark):
    c, b, damaged, lost, twice = garble_tables(spark)
    out = {(r.idx, r.field): r for r in garble.restored_values(c, b).collect()}
    assert set(out) == {(i, "text") for i in damaged} | {(lost, "text"), (twice, "title")}
    for i, text in damaged.items():
        assert out[i, "text"].restored == text, i
        assert not out[i, "text"].lost
    assert out[lost, "text"].lost


def misread(text):
    """UTF-8 read as cp1252, bytes that it leaves undefined passed on."""
    return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in text.encode())


def test_garbled_twice_over_undefined_bytes(spark):
    clean = ["He saw the “flood” there.", "The “kot.” was near.", "Íñigo left Ýmir behind.", "В… тихий Новый запрос"]
    rows = [(100 * i + j, None, t, "book-en", 1) for i, t in enumerate(clean) for j in range(8)]
    garbled_once = {1000 + i: t for i, t in enumerate(clean[:3])}
    garbled_twice = {2000 + i: t for i, t in enumerate(clean[:3])}
    only = {3000: ("It rose,Ã¢â‚¬Â\x9d they said.", "It rose,” they said.")}  # the value's only garbled word, and frequent
    rows += [(i, None, misread(t), "book-en", 1) for i, t in garbled_once.items()] + [(i, None, misread(misread(t)), "book-en", 1) for i, t in garbled_twice.items()]
    rows += [(3000 + j, None, only[3000][0], "book-en", 1) for j in range(8)]
    expected = garbled_once | garbled_twice | {3000 + j: only[3000][1] for j in range(8)}
    out = {r.idx: r.restored for r in garble.restored_values(corpus(spark, rows), books(spark, [("book-en", "t", "en", "d")])).collect()}
    assert out == expected


@pytest.mark.parametrize("text", ["καλημέρα κόσμε φίλε", "tiếng Việt rất đẹp", "שלום עולם טוב", "こんにちは世界", "مرحبا بالعالم", "Türkçe öğrenmek güzel"])
def test_other_scripts_are_restored_or_left(spark, text):
    """UTF-8 in scripts that the rest of the corpus does not have, alone and in a language of many clean words."""
    clean = [(i, None, s, "book-ru", 1) for i, s in enumerate(re.split(r"(?<=[.…]) ", CLEAN["ru"]) * 8)] + [(100 + i, None, s, "book-es", 1) for i, s in enumerate(re.split(r"(?<=[.…]) ", CLEAN["es"]) * 8)]
    own = [(500 + i, None, text, "book-x", 1) for i in range(4)]
    for rows in (clean, clean + own):
        c = corpus(spark, rows + [(1000, None, misread(text), "book-x", 1), (1001, None, text, "book-x", 1)])
        out = {r.idx: r.restored for r in garble.restored_values(c, books(spark, [("book-ru", "t", "ru", "d"), ("book-es", "t", "es", "d"), ("book-x", "t", "x", "d")])).collect()}
        assert out == {1000: text}


def test_words_that_fit_utf8_by_chance_are_left(spark):
    rows = [(i, None, w, "book-ru", 1) for i, w in enumerate(("список так чем сад", "В саду. Г. Иванов", "IRMÃ E MANHÃ", "CAFÉ» été», Fuß", "code¹ 5\xa0kg", "µs ªº"))]
    assert garble.restored_values(corpus(spark, rows), books(spark, [("book-ru", "t", "ru", "d")])).count() == 0


def test_bytes_gone_astray(spark):
    words = "à la casa de mamá, señor. El corazón está aquí."
    rows = [(i, None, words, "book-es", 1) for i in range(9)] + [(20, None, "heartÂ here", "book-es", 1), (21, None, "voy Ã la casa", "book-es", 1), (22, None, "He said â€œnoâ€ then", "book-es", 1)]
    out = {r.idx: r.restored for r in garble.restored_values(corpus(spark, rows), books(spark, [("book-es", "t", "es", "d")])).collect()}
    assert out == {20: "heart here", 21: "voy à la casa", 22: "He said “no” then"}


def test_garbled_empty(spark):
    assert garble.restored_values(corpus(spark, []), books(spark, [])).count() == 0
    one = corpus(spark, [(1, "CafÃ©", None, None, None)])
    assert [(r.field, r.restored) for r in garble.restored_values(one, books(spark, [])).collect()] == [("title", "Café")]


# ---- reading level


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", " Qa-threads", "x", 1.0, 3) for i, t in rows], "doc_id long, text string, lang string, source string, band string, score double, words int")


def sample(rng, level):
    easy = "the cat saw a red hat . a boy ran to the sun . we met her dog .".split(" ")
    hard = "notwithstanding considerable heterogeneity the asymptotic parameterization systematically underestimates multidimensional generalization , although characteristic representations necessarily presuppose regularization .".split(" ")
    middle = "the stored report was compared with an earlier index because nobody could say which of the runs had been slower , while the others waited .".split(" ")
    base = (easy, middle, hard)[level]
    return " ".join(" ".join(rng.permutation(base[:-1])) + "." for _ in range(int(rng.integers(2, 8))))


def test_reading_level_held_out(spark):
    rng = np.random.default_rng(0)
    rows = [(i, sample(rng, i % 3)) for i in range(240)]
    logs = "\n".join(f"[{i:05d}] epoch={i} lr=0.05 steps={i} ok" for i in range(20))
    extra = [(900, None), (901, " \n"), (902, logs), (903, "| 1 | 22 | 0.3 |"), (None, "the cat ran"), (904, logs + "\nThe cat saw a red hat."), (905, "the cat saw a hat. " * 20_000), (906, "\x00 odd \x00 text here")]
    labels = [(i, reading.BANDS[i % 3]) for i in range(120)] + [(0, "easy"), (1, "hard"), (3, None), (None, "easy"), (4, "other"), (5, " Hard ")]
    out = reading.reading_level(documents(spark, rows + extra), spark.createDataFrame(labels, "doc_id long, band string"))
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(range(240)) | {904, 905, 906}
    assert np.mean([got[i].band == reading.BANDS[i % 3] for i in range(120, 240)]) > 0.95
    assert got[904].band == "easy" and got[904].words == 6
    prof = reading.profile(out, documents(spark, rows + extra)).collect()
    assert {r.source for r in prof} == {"qa_threads"} and sum(r.documents for r in prof) == len(got)


def test_reading_level_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, band string")
    assert {r.band for r in reading.reading_level(documents(spark, [(1, "the cat ran home")]), labels).collect()} == {"medium"}
    assert reading.reading_level(documents(spark, []), labels).count() == 0


# ---- top N, here for its plain columns


def test_top_n(spark):
    from sparseloom.llm.topn import top_n_per_group

    rng = np.random.default_rng(0)
    rows = [("hot" if rng.random() < 0.5 else f"q{rng.integers(40)}", f"d{rng.integers(60)}", int(rng.integers(-1, 12)), 1, "s") for _ in range(6000)]
    rows += [(None, "d", 1, 1, "s"), ("q", None, 1, 1, "s"), ("only", "é", 3, 1, "s"), ("only", "z", 3, 1, "s"), ("only", "Z", 3, 1, "s"), ("none", "d", None, 1, "s")]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, hamming int, position int, s string").repartition(5)
    best = {}
    for q, d, h, *_ in rows:
        if q is not None and d is not None and h is not None and h >= 0:
            best.setdefault(q, {})[d] = min(h, best.get(q, {}).get(d, h))
    for n in (1, 5):
        got = {}
        for r in top_n_per_group(df, "query_id", "doc_id", "hamming", n).orderBy("query_id", "position").collect():
            got.setdefault(r.query_id, []).append((r.hamming, r.doc_id))
        assert got == {q: sorted(((h, d) for d, h in ds.items()), key=lambda x: (x[0], x[1].encode()))[:n] for q, ds in best.items()}
    assert top_n_per_group(df.limit(0), "query_id", "doc_id", "hamming").count() == 0
    with pytest.raises(ValueError):
        top_n_per_group(df, "query_id", "doc_id", "hamming", 0)
