"""Reading level of each document (problem 10).

Word frequencies are counted over all documents; every document's running prose gives features of lexical diversity, word
rarity, connectives, clause depth (commas and connectives per sentence) and length; a regularised ordinal regression
(proportional odds), calibrated to the bands readers gave to a sample, gives every document a score and a band.
Slopes may differ by language, which is told from function words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

BANDS = ("easy", "medium", "hard")
#: Words with a frequency of their own; the others have their mean frequency. Bounds what is broadcast.
VOCABULARY = 50_000
#: The most labelled documents the model is fitted on, chosen by a hash of doc_id.
LABELLED_ROWS = 20_000
RIDGE, TURNS = 0.003, 300
#: A line with a larger share of digits and symbols among its characters is a log, a table or figures, not prose.
SYMBOL_SHARE = 0.45
LEAST_WORDS = 2

_STOP = {
    "en": "the of and to a in is was with for on that it at",
    "fr": "le la les de des et un une du est dans pour sur avec",
    "es": "el la los de y en un una del por con mi que al",
    "de": "der die das und ein eine den von im auf mit dem des für",
    "pt": "o a os de do da e em um uma para com no na",
    "pl": "i w na z do się nie że po nad przed jest",
    "ru": "и в на не с по к что у от из",
}
_CONNECTIVES = {
    "en": "although unless whereas because while whenever before after since until though however therefore moreover furthermore nevertheless notwithstanding consequently that which who if when where so even then than",
    "fr": "que qui quand parce tandis bien alors puisque lorsque si dont où car donc cependant néanmoins tant",
    "es": "que porque mientras aunque cuando donde si pues además hasta sino quien",
    "de": "dass weil während obwohl wenn damit bevor nachdem bis denn sodass als da falls indem",
    "pt": "que porque enquanto embora quando onde se até pois mas",
    "pl": "że ponieważ podczas gdy chociaż choć aby żeby dopóki który która które zanim jeśli bo",
    "ru": "что потому пока хотя когда если чтобы который которая где так как прежде ибо поскольку",
}
#: Texts without any function word of these are of no known language, and have no slopes of their own unless some are labelled.
LANGS = (*_STOP, "und")
_stop_bits = {w: sum(1 << i for i, l in enumerate(_STOP) if w in _STOP[l].split()) for l in _STOP for w in _STOP[l].split()}
_connectives = {w for words in _CONNECTIVES.values() for w in words.split()}

_token = re.compile(r"[^\W\d_]+|,|[.!?…]+[\"”’»“)\]]*\s|[\n\r]+|\x00")
_symbol = re.compile(r"[\d=|\[\]#/\\_<>{}$%:]")
_heavy = re.compile(r"[=|\[\]]|\d{4}|\d\D{0,3}\d\D{0,3}\d")
_blank = re.compile(r"\s+")
_WORD_LENGTHS, _SENTENCE_WORD_LENGTHS, _SENTENCE_LENGTHS, _RARITIES = (7, 10, 13), (4.2, 4.8, 5.5, 6.5, 7.5, 9.0), (8, 12, 18, 25, 35), (5.0, 6.0, 7.0, 8.0, 9.0)
FEATURES = 15 + len(_WORD_LENGTHS) + len(_SENTENCE_WORD_LENGTHS) + len(_SENTENCE_LENGTHS) + len(_RARITIES) - 1


def prose(text: str | None) -> str:
    """The lines of running prose, in lower case; "" if there are none."""
    if not text:
        return ""
    if not _heavy.search(text):
        return text.lower().replace("\x00", " ")
    lines = []
    for line in re.split(r"[\n\r]+", text):
        if _heavy.search(line):
            bare = _blank.sub("", line)
            if len(_symbol.findall(bare)) > SYMBOL_SHARE * len(bare):
                continue
        lines.append(line)
    return "\n".join(lines).lower().replace("\x00", " ")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    words = re.compile(r"[^\W\d_]+").findall

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(words(prose(text)))
        if len(counts) > 300_000:
            yield out()
            counts.clear()
    if counts:
        yield out()


class _Words(dict):
    """A number for every token met, with its properties in arrays by number."""

    WORD, COMMA, END, DOCUMENT = range(4)

    def __init__(self, rarity: dict[str, float], rarest: float):
        super().__init__()
        self.rarity, self.rarest = rarity, rarest
        self.kind, self.length, self.rare, self.joins, self.stops = [], [], [], [], []

    def __missing__(self, token: str) -> int:
        c = token[0]
        kind = self.COMMA if c == "," else self.DOCUMENT if c == "\x00" else self.END if c in ".!?…\n\r" else self.WORD
        self.kind.append(kind)
        self.length.append(len(token))
        self.rare.append(self.rarity.get(token, self.rarest))
        self.joins.append(token in _connectives)
        self.stops.append(_stop_bits.get(token, 0))
        self[token] = n = len(self.kind) - 1
        return n


def features(texts: list[str | None], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of prose words, language number, features) of each text."""
    docs = len(texts)
    tokens = _token.findall("".join(f"{prose(t)} \x00" for t in texts))
    ids = np.fromiter(map(words.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    kind = np.array(words.kind)[ids]
    doc = np.cumsum(kind == words.DOCUMENT) - (kind == words.DOCUMENT)
    sentence = np.cumsum(kind >= words.END)
    is_word = kind == words.WORD
    w, d, s = ids[is_word], doc[is_word], sentence[is_word]
    length, rare, joins = np.array(words.length, float)[w], np.array(words.rare)[w], np.array(words.joins, float)[w]
    n = np.bincount(d, minlength=docs).astype(float)
    safe = np.maximum(n, 1)
    mean = lambda x: np.bincount(d, weights=x, minlength=docs) / safe
    stops = np.array(words.stops)[w]
    hits = np.stack([np.bincount(d, weights=(stops >> i) & 1, minlength=docs) for i in range(len(_STOP))], 1) if len(w) else np.zeros((docs, len(_STOP)))
    lang = np.where(hits.any(1), np.argmax(hits, axis=1), len(_STOP))
    # sentences that have words
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
    sl = np.diff(np.r_[first, len(s)]).astype(float)
    sd = d[first]
    swl = np.add.reduceat(length, first) / sl if len(first) else np.zeros(0)
    sentences = np.maximum(np.bincount(sd, minlength=docs), 1)
    by_words = lambda x: np.bincount(sd, weights=x * sl, minlength=docs) / safe
    longest = np.zeros(docs)
    np.maximum.at(longest, sd, sl)
    commas = np.bincount(doc[kind == words.COMMA], minlength=docs)[:docs] / sentences
    different = np.bincount(np.unique(d * np.int64(len(words) + 1) + w) // (len(words) + 1), minlength=docs)
    root = np.sqrt(safe)
    roots = np.maximum(np.bincount(sd, weights=np.sqrt(sl), minlength=docs), 1e-9)
    x = [
        mean(length), np.log(np.maximum(n / sentences, 0.1)), np.log1p(longest), commas, mean(joins), np.bincount(d, weights=joins, minlength=docs) / sentences,
        different / safe, different / root, mean(rare), np.log(safe), by_words(np.log(np.maximum(sl, 1))), np.bincount(sd, weights=swl * np.sqrt(sl), minlength=docs) / roots,
        mean(rare**2), mean(length**2),
        *(mean(length >= t) for t in _WORD_LENGTHS), *(by_words(swl >= t) for t in _SENTENCE_WORD_LENGTHS), *(by_words(sl >= t) for t in _SENTENCE_LENGTHS), *(mean(rare >= t) for t in _RARITIES),
    ]
    return n.astype(np.int64), lang, np.stack(x, 1)


@dataclass(frozen=True)
class OrdinalModel:
    means: np.ndarray  # languages x features
    scales: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray  # where medium and where hard begin

    def design(self, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.means[lang]) / self.scales[lang], -6, 6)
        own = np.eye(len(LANGS))[lang]
        return np.hstack([z, own, *(z * own[:, [i]] for i in range(len(LANGS)))])

    def score(self, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return self.design(x, lang) @ self.weights

    def band(self, score: np.ndarray) -> np.ndarray:
        return (score > self.cuts[0]).astype(int) + (score > self.cuts[1])


def fit_ordinal(x: np.ndarray, lang: np.ndarray, y: np.ndarray, ridge: float = RIDGE, turns: int = TURNS) -> OrdinalModel:
    """Proportional odds with a ridge penalty. Without labels every text is "medium"; a language with few labels borrows the
    means and scales of all."""
    k = len(LANGS)
    if not len(y):
        return OrdinalModel(np.zeros((k, x.shape[1])), np.ones((k, x.shape[1])), np.zeros(x.shape[1] * (k + 1) + k), np.array([-1.0, 1.0]))
    means, scales = np.repeat(x.mean(0)[None], k, 0), np.repeat(x.std(0)[None], k, 0)
    for i in range(k):
        if (lang == i).sum() >= 30:
            means[i], scales[i] = x[lang == i].mean(0), x[lang == i].std(0)
    scales = np.where(scales > 1e-9, scales, 1.0)
    model = OrdinalModel(means, scales, np.zeros(0), np.zeros(2))
    a = model.design(x, lang)
    n, p = a.shape
    w, cuts, m, v = np.zeros(p), np.array([-1.0, 1.0]), np.zeros(p + 2), np.zeros(p + 2)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for turn in range(1, turns + 1):
        s = a @ w
        c0, c1 = sigmoid(cuts[0] - s), sigmoid(cuts[1] - s)
        chance = np.maximum(np.choose(y, [c0, c1 - c0, 1 - c1]), 1e-9)
        d0, d1 = c0 * (1 - c0), c1 * (1 - c1)
        gs = np.choose(y, [d0, d1 - d0, -d1]) / chance
        g0, g1 = np.choose(y, [-d0, d0, 0 * d0]) / chance, np.choose(y, [0 * d0, -d1, d1]) / chance
        g = np.r_[a.T @ gs / n + ridge * w, g0.mean(), g1.mean()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * m / (1 - 0.9**turn) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
        w, cuts = w - step[:-2], np.sort(cuts - step[-2:])
    return OrdinalModel(means, scales, w, cuts)


def document_features(documents: DataFrame) -> DataFrame:
    """doc_id, words, lang_no, x (features) of the documents with running prose."""
    texts = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = checkpoint(texts.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total, different = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    rarity = {r.word: float(np.log(total / r.n)) for r in top}
    others, left = different - len(top), (total or 0) - sum(r.n for r in top)
    rarest = float(np.log(total / (left / others))) if others else float(np.log(max(total or 1, 1)))
    shared = documents.sparkSession.sparkContext.broadcast((rarity, rarest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(*shared.value)
        for batch in batches:
            if len(words) > 1_000_000:
                words = _Words(*shared.value)
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                n, lang, x = features(part.column(1).to_pylist(), words)
                keep = np.flatnonzero(n >= LEAST_WORDS)
                flat = pa.array(x[keep].ravel())
                offsets = pa.array(np.arange(0, len(keep) * x.shape[1] + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(n[keep]), pa.array(lang[keep].astype(np.int32)), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "words", "lang_no", "x"])

    return texts.mapInArrow(run, "doc_id long, words long, lang_no int, x array<double>")


def _labelled(labels: DataFrame, rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    known = labels.filter(F.col("doc_id").isNotNull() & F.lower(F.trim("band")).isin(*BANDS)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.lower(F.trim("band"))).alias("band"), F.countDistinct(F.lower(F.trim("band"))).alias("different")).filter("different = 1")
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    table = rows.join(known.select("doc_id", "band"), "doc_id").limit(int(most * 1.2)).toArrow().sort_by("doc_id")
    if not table.num_rows:
        return np.zeros(0, int), np.zeros((0, 1)), np.zeros(0, int), np.zeros(0, int)
    x = np.stack([np.asarray(v, float) for v in table.column("x").to_pylist()])
    return table.column("doc_id").to_numpy(), x, table.column("lang_no").to_numpy().astype(int), np.array([BANDS.index(b) for b in table.column("band").to_pylist()])


def reading_level(documents: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, band, score, words, language (as told from function words, "und" without any) of every document with running prose.

    Null and blank texts, and those of which only logs, tables or figures would be left, give no row. A document of which
    readers named more than one band, or another than easy, medium and hard, does not count as labelled; repeated labels
    count once. Documents with a null doc_id take no part; rows with the same doc_id are measured each for itself.
    """
    rows = checkpoint(document_features(documents))
    _, x, lang, y = _labelled(labels, rows, labelled_rows)
    width = rows.limit(1).select(F.size("x")).first()
    model = fit_ordinal(x if len(y) else np.zeros((0, width[0] if width else 1)), lang, y)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                lang = batch.column(2).to_numpy(zero_copy_only=False)
                score = m.score(x, lang)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([BANDS[b] for b in m.band(score)], pa.string()), pa.array(score), batch.column(1), pa.array([LANGS[i] for i in lang], pa.string())], names=["doc_id", "band", "score", "words", "language"])

    return rows.mapInArrow(run, "doc_id long, band string, score double, words long, language string")


def profile(levels: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents and words by source and band: source (tidied, "unknown" where null), band, documents, words."""
    from .mix import canonical_source

    meta = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(canonical_source(F.col("source")), F.lit("unknown")).alias("source")).groupBy("doc_id").agg(F.min("source").alias("source"))
    return levels.join(meta, "doc_id").groupBy("source", "band").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"))
