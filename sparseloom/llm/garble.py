"""Garbled text from wrong character encoding (problem 5).

The words with characters beyond ASCII are counted over the whole corpus by language; those that another decoding explains are
taken out, by joins among the words, and the frequent ones that stay make a zstandard dictionary for each language. In a value
the words that no dictionary knows are put through every candidate chain (written in one encoding, read in another), and
compressed under each decoding with the dictionary that suits it best; the decoding of the least description length, the
chain's own cost included, is taken, otherwise the value stays. That repeats, for stretches garbled in different ways and text
garbled twice. UTF-8 proves itself by its form, in any script; a decoding of single bytes needs words that are known.
Replacement characters mark what is lost: such a value is found, and restored only as far as other words can be.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint
from .tokens import canonical_slug

#: Words kept for each language, languages kept, and bytes of each dictionary: these bound what is collected and broadcast.
WORDS_PER_LANGUAGE, LANGUAGES, DICTIONARY_BYTES = 20_000, 32, 48_000
LEVEL, ROUNDS, UTF8_COST, SINGLE_BYTE_COST = 12, 4, 0.75, 1.5
#: Bytes that it costs to write a word out that is in no dictionary.
ESCAPE = 2.0
#: A word is taken for the garbled form of another one that is so many times as frequent.
RATIO = 3
LOST = "�"

#: By how many bytes a decoding of single bytes must beat every other one that gives another text.
MARGIN = 0.5
#: Times by which a word of two characters, in a form met nowhere else, must be rarer than what it decodes to.
SHORT_RATIO = 20

#: Fixed values: (encoding the bytes were written in, encoding they were read in).
CHAINS = (
    ("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp1251"), ("utf-8", "cp1250"),
    ("utf-8", "iso8859-2"), ("utf-8", "koi8-r"), ("utf-8", "cp866"), ("utf-8", "cp1253"), ("utf-8", "cp1254"), ("utf-8", "cp1255"), ("utf-8", "cp1256"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "cp1250"),
    ("cp1250", "cp1252"), ("cp1250", "iso8859-2"), ("cp1250", "cp437"), ("cp1250", "cp850"), ("cp1250", "mac_roman"),
    ("iso8859-2", "cp1252"), ("iso8859-2", "cp1250"), ("iso8859-2", "mac_roman"), ("iso8859-2", "cp437"),
    ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp1251", "mac_roman"),
    ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp866", "cp1252"), ("cp866", "cp1251"),
    ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp852", "cp1252"), ("cp852", "cp1250"),
    ("cp1253", "cp1252"), ("cp1254", "cp1252"), ("cp1255", "cp1252"), ("cp1256", "cp1252"),
    ("shift_jis", "cp1252"), ("euc_jp", "cp1252"), ("gb18030", "cp1252"), ("big5", "cp1252"), ("euc_kr", "cp1252"),
)
#: First words of the Unicode names of letters that East Asian text mixes.
EAST_ASIAN = frozenset(("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO", "KATAKANA-HIRAGANA", "HALFWIDTH", "FULLWIDTH"))

_space = re.compile(r"[ \t\n\r]+")
_beyond = re.compile("[^\x00-\x7f]+")
_c1 = re.compile("[\x80-\x9f]")
#: Control characters that no restored text has; a step on the way to it may have them.
_control = re.compile("[\x82-\x9f]")
_edges = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_NBSP = "\xa0"


def words_of(text: str | None) -> list[str]:
    """The runs between ASCII white space that have characters beyond ASCII, without ASCII punctuation around them."""
    if not text or text.isascii():
        return []
    text = text.replace("\t", " ").replace("\n", " ").replace("\r", " ")
    if len(text.encode("utf-8", "replace")) > 1.2 * len(text):
        return [w.strip(_edges) for w in text.split(" ") if not w.isascii()]
    out, at = [], 0
    while (m := _beyond.search(text, at)) is not None:
        start = max(at, text.rfind(" ", at, m.start()) + 1)
        at = text.find(" ", m.end())
        if at < 0:
            at = len(text)
        out.append(text[start:at].strip(_edges))
    return out


@lru_cache(maxsize=200_000)
def decoded(word: str, written: str, read: str) -> str | None:
    """`word` read again as it was written; None if that cannot be, changes nothing or gives characters no text has. UTF-8 may
    give C1 controls, which stand for bytes of text garbled before: they go away in a second step or the reading is wrong."""
    try:
        raw = word.encode(read)
    except UnicodeEncodeError:
        if not _c1.search(word):
            return None
        out = bytearray()
        for c in word:
            try:
                out += c.encode(read)
            except UnicodeEncodeError:
                # bytes an encoding leaves undefined are often passed on as they are
                if not 0x80 <= ord(c) <= 0x9F:
                    return None
                out.append(ord(c))
        raw = bytes(out)
    try:
        text = raw.decode(written)
    except UnicodeDecodeError:
        return None
    if text == word or any(unicodedata.category(c) in ("Cc", "Co", "Cn", "Cs") and not "\x80" <= c <= "\x9f" for c in text if c > "~"):
        return None
    if written != "utf-8" and _c1.search(text):
        return None
    return text


def completed(word: str, written: str, read: str) -> str | None:
    """`word` decoded as UTF-8 if its last byte has gone astray: a no-break space that became a space, or an undefined byte of
    a closing quote."""
    if not word or word[-1].isascii() or script(word[-1]) not in ("", "LATIN"):
        return None
    before = word[-2:-1]
    t = decoded(word + _NBSP, written, read)
    if t is not None and t[-1] == _NBSP:
        return None if before.isupper() else t[:-1]
    if t is not None and t[-1].isalpha():
        # in the same case as what stands before it
        return None if before.isupper() and t[-1].islower() else t
    t = decoded(word + "\x9d", written, read)
    return t if t is not None and t[-1] == "\u201d" else None


@lru_cache(maxsize=70_000)
def script(c: str) -> str:
    """The script of a letter, by its Unicode name; none for letters that stand as signs."""
    if c in "ªµº" or not c.isalpha():
        return ""
    name = unicodedata.name(c, "").partition(" ")[0]
    return "EAST ASIAN" if name in EAST_ASIAN else name


def scripts(text: str) -> set[str]:
    return set(map(script, text)) - {""}


def natural(word: str) -> bool:
    """Letters of one script, in lower case, in capitals or with one at the beginning."""
    return word.isalpha() and len(scripts(word)) == 1 and (word[1:] == word[1:].lower() or word == word.upper())


def plausible(text: str, source: str, attested: frozenset[str]) -> bool:
    """Whether `text`, read from `source` as UTF-8, can be text. Its letters are of one script. Characters beyond the Latin
    letters of most languages occur elsewhere in the corpus, or else there are two continuation bytes or more to prove them
    and the source is no natural word: words of one alphabet may fit UTF-8 by chance."""
    if len(scripts(text)) > 1:
        return False
    odd = [c for c in text if c > "\u017f" and c not in attested]
    return not odd or not natural(source) and sum(len(c.encode("utf-8", "replace")) - 1 for c in odd) >= 2


@dataclass(frozen=True)
class Vocabulary:
    words: dict[str, list[str]]  # by language, in order of falling frequency
    unsure: frozenset[str]  # words of a letter or two that may be another's garbled form: changed only along with others
    short: frozenset[str]  # words of two characters that are
    attested: frozenset[str]  # characters beyond ASCII of words that are no UTF-8


class Restorer:
    def __init__(self, vocabulary: Vocabulary):
        import zstandard as z

        self.known = {w for words in vocabulary.words.values() for w in words}
        self.unsure, self.short, self.attested = vocabulary.unsure, vocabulary.short, vocabulary.attested
        # for short texts: matches from three bytes on
        params = z.ZstdCompressionParameters.from_level(LEVEL, source_size=1024, dict_size=DICTIONARY_BYTES, format=z.FORMAT_ZSTD1_MAGICLESS, min_match=3, strategy=z.STRATEGY_BTULTRA, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compressors = []
        for words in vocabulary.words.values():
            body, size = [], 0
            for w in words:
                b = w.encode()
                size += len(b) + 1
                if size > DICTIONARY_BYTES:
                    break
                body.append(b)
            if size >= 8:
                content = b" ".join(reversed(body)) + b" "  # the most frequent last, at the smallest offsets
                d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                # a few words known to the dictionary go first: in so short a text the headers would else hide what a word costs
                carrier = b" ".join(body[:64:5]) + b" "
                c = z.ZstdCompressor(compression_params=params, dict_data=d)
                self.compressors.append((c, carrier, len(c.compress(carrier))))
        if not self.compressors:
            self.compressors.append((z.ZstdCompressor(compression_params=params), b"", 0))
        self.judged: dict[tuple[str, ...], dict[str, str]] = {}

    def length(self, words: list[str]) -> float:
        """Bytes of the words under the dictionary that suits them best, with an escape for each that no dictionary has."""
        data = (" ".join(words) + " ").encode("utf-8", "replace")
        return min(len(c.compress(carrier + data)) - alone for c, carrier, alone in self.compressors) + ESCAPE * sum(w not in self.known for w in words)

    def utf8_step(self, doubtful: dict[str, str], read: str) -> tuple[dict[str, str], dict[str, str]]:
        """(the doubtful words decoded as UTF-8, those of them that can be text). Words too short to prove themselves go along
        with others of their script."""
        step, sure, open_words = {}, {}, {}
        for w, now in doubtful.items():
            t = decoded(now, "utf-8", read)
            if t is None:
                t = completed(now, "utf-8", read)
                if t is None or t[-1:].isalpha() and t[-1:] > "~" and t not in self.known:
                    continue
            step[w] = t
            if _control.search(t):
                continue
            (sure if plausible(t, now, self.attested) else open_words)[w] = t
        met = {x for t in sure.values() for x in scripts("".join(c for c in t if c > "~"))}
        for w, t in open_words.items():
            if met and scripts(t) <= met and not natural(doubtful[w]):
                sure[w] = t
        return step, sure

    def candidates(self, doubtful: dict[str, str], unsure: dict[str, str]) -> Iterator[tuple[dict[str, str], float, bool]]:
        """(the doubtful words under every chain that some of them fit, the chain's cost, whether it is UTF-8), UTF-8 also read
        wrongly twice."""
        for written, read in CHAINS:
            if written == "utf-8":
                step, new = self.utf8_step(doubtful, read)
                if not step:
                    continue
                along = {w: t for w in unsure if (t := decoded(unsure[w], written, read)) in self.known}
                if new:
                    new |= along
                    yield new, UTF8_COST, True
                step |= along
                for _, second in (c for c in CHAINS if c[0] == "utf-8"):
                    twice = {w: t2 for w, t in step.items() if (t2 := decoded(t, written, second)) is not None and not _control.search(t2) and plausible(t2, t, self.attested)}
                    if twice:
                        yield new | along | twice, 2 * UTF8_COST, True
                continue
            step = {w: t for w, now in doubtful.items() if (t := decoded(now, written, read)) is not None}
            # single bytes fit too much: half of the words must be known then, and one of them longer than two letters or vetted
            known = [w for w, t in step.items() if t in self.known]
            if 2 * len(known) < len(step) or not any(len(doubtful[w]) > 2 or w in self.short for w in known):
                continue
            yield step | {w: t for w in unsure if (t := decoded(unsure[w], written, read)) in self.known}, SINGLE_BYTE_COST, False

    def mapping(self, words: tuple[str, ...]) -> dict[str, str]:
        """What becomes of each garbled one of the (different) words of a value."""
        if words in self.judged:
            return self.judged[words]
        now = {w: w for w in words}
        for _ in range(ROUNDS):
            doubtful = {w: t for w, t in now.items() if t not in self.known and LOST not in t}
            if not doubtful:
                break
            unsure = {w: t for w, t in now.items() if t == w and w in self.unsure}
            met = [(new, cost, utf8) for new, cost, utf8 in self.candidates(doubtful, unsure)]
            if not met:
                break
            # words that no candidate changes cost the same under all
            open_words = sorted({w for new, _, _ in met for w in new})
            stays = self.length([now[w] for w in open_words])
            costs = [(self.length([new.get(w, now[w]) for w in open_words]) + cost, i) for i, (new, cost, _) in enumerate(met)]
            best_cost, i = min(costs)
            best, _, utf8 = met[i]
            if best_cost >= stays:
                break
            if not utf8 and any(t not in self.known for t in best.values()) and any(c < best_cost + MARGIN and any(met[j][0].get(w, now[w]) != t for w, t in best.items()) for c, j in costs if j != i):
                break
            now |= best
        out = {w: t for w, t in now.items() if t != w}
        if len(self.judged) > 50_000:
            self.judged.clear()
        self.judged[words] = out
        return out

    def restore(self, text: str | None) -> tuple[bool, str | None]:
        """(whether the text is garbled, the text as written as far as can be)."""
        if not text or text.isascii():
            return False, text
        words = words_of(text)
        if self.known.issuperset(words):
            return False, text
        lost = LOST in text
        # words that are known and sure play no part
        changes = self.mapping(tuple(dict.fromkeys(w for w in words if w not in self.known or w in self.unsure)))
        if not changes:
            return lost, text
        parts = re.split(r"([ \t\n\r]+)", text)
        for i in range(0, len(parts), 2):
            if parts[i] and not parts[i].isascii():
                core = parts[i].strip(_edges)
                if core in changes:
                    parts[i] = parts[i].replace(core, changes[core], 1)
        return True, "".join(parts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, str]] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for c in range(1, batch.num_columns):
            for lang, text in zip(langs, batch.column(c).to_pylist()):
                if text and not text.isascii():
                    counts.update((lang, w) for w in words_of(text))
        if len(counts) > 300_000:
            yield out()
            counts.clear()
    if counts:
        yield out()


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n -> word, n, bad (damaged in any case), utf8 (what it is as UTF-8 read wrongly once or twice), ended (the same with
    its last byte put back), bytes (what it is in encodings of single bytes)."""
    kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.list_(pa.string())] * 3]
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [])
        bad = []
        for word in batch.column(0).to_pylist():
            utf8, ended, single = [], [], []
            for written, read in CHAINS:
                other = decoded(word, written, read)
                if written == "utf-8":
                    if other is not None:
                        if not _control.search(other):
                            utf8.append(other)
                        utf8 += (t for w, r in CHAINS if w == "utf-8" and (t := decoded(other, w, r)) is not None and not _control.search(t))
                    elif (other := completed(word, written, read)) is not None:
                        ended.append(other)
                elif other is not None:
                    single.append(other)
            bad.append(LOST in word or _c1.search(word) is not None)
            for r, x in zip(rows, (utf8, ended, single)):
                r.append(sorted(set(x)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bad, kinds[2]), *(pa.array(r, k) for r, k in zip(rows, kinds[3:]))], names=["word", "n", "bad", "utf8", "ended", "bytes"])


def vocabulary(corpus: DataFrame, books: DataFrame, fields: tuple[str, ...] = ("title", "text"), slug: str = "book_slug") -> Vocabulary:
    """Frequent words beyond ASCII by language of the book ("und" where it is not known), counted over all rows, without those
    that are another word's garbled form. The words are judged in tasks, by joins of words with words; the driver gets the
    most frequent of each language, the characters met (no more than Unicode has) and words of two characters."""
    b = books.select(canonical_slug(F.col("book_slug")).alias("s"), F.lower("lang").alias("lang")).filter("s is not null").groupBy("s").agg(F.min("lang").alias("lang"))
    beyond = [F.col(f).rlike(r"[^\x00-\x7F]") for f in fields]
    some = beyond[0]
    for x in beyond[1:]:
        some = F.coalesce(some, F.lit(False)) | F.coalesce(x, F.lit(False))
    rows = corpus.select(canonical_slug(F.col(slug)).alias("s"), *fields).filter(some).join(b, "s", "left")
    counted = checkpoint(rows.select(F.coalesce("lang", F.lit("und")).alias("lang"), *fields).mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    total = counted.groupBy("word").agg(F.sum("n").alias("n"))
    # many readings of each word: a task for each core, however few bytes the words are
    spread = total.repartition(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    read = checkpoint(spread.mapInArrow(_readings, "word string, n long, bad boolean, utf8 array<string>, ended array<string>, bytes array<string>"))
    whole = read.filter(~F.col("bad") & (F.size("utf8") == 0) & (F.size("ended") == 0))
    attested = frozenset(r.c for r in whole.select(F.explode(F.split("word", "")).alias("c")).filter("c > '~'").distinct().collect())
    shared = corpus.sparkSession.sparkContext.broadcast(attested)

    @F.pandas_udf("boolean")
    def some_plausible(words: pd.Series, readings: pd.Series) -> pd.Series:
        return pd.Series([any(plausible(t, w, shared.value) for t in ts) for w, ts in zip(words, readings)], dtype="bool")

    # what else a word can be, and how frequent that is
    others = read.select("word", "n", F.explode(F.array_union("ended", "bytes")).alias("other"), "ended")
    more = others.join(total.select(F.col("word").alias("other"), F.col("n").alias("n_other")), "other").filter(F.col("n_other") >= RATIO * F.col("n"))
    more = more.groupBy("word").agg(F.max("n_other").alias("n_other"), F.max(F.array_contains("ended", F.col("other"))).alias("by_end"))
    # an astray no-break space or quote leaves a word or nothing behind; the word itself in lower case shows that nothing is astray
    lower = total.select(F.col("word").alias("low"), F.lit(True).alias("lowered"))
    tail = F.exists("ended", lambda t: (t == "") | ~F.substring(t, -1, 1).rlike(r"^\p{L}$") | F.substring(t, -1, 1).rlike("^[A-Za-z]$"))
    judged = read.join(more, "word", "left").join(lower, (F.lower("word") == F.col("low")) & (F.col("low") != F.col("word")), "left")
    astray = (tail | F.coalesce("by_end", F.lit(False))) & F.col("lowered").isNull()
    n_other = F.coalesce("n_other", F.lit(0))
    bad = F.col("bad") | some_plausible("word", "utf8") | astray | ((n_other > 0) & (F.length("word") > 2))
    judged = checkpoint(judged.select("word", "n", bad.alias("bad"), ((n_other > 0) & (F.length("word") <= 2)).alias("unsure"), ((F.length("word") == 2) & (n_other >= SHORT_RATIO * F.col("n")) & F.col("lowered").isNull()).alias("short")))
    two = judged.filter("unsure and not bad").select("word", "short").collect()
    short = frozenset(r.word for r in two if r.short)
    if short:
        # pairs of neighbouring characters, the word's ends included, that occur in other words
        pairs = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(F.concat(F.lit("\x02"), "word", F.lit("\x03")), i, F.lit(2)))
        wanted = judged.filter("short and unsure and not bad").select("word", F.explode(pairs).alias("pair"))
        met = judged.filter("not bad and not unsure").select(F.explode(pairs).alias("pair")).join(wanted.select("pair").distinct(), "pair", "left_semi").distinct()
        short = frozenset(r.word for r in wanted.join(met, "pair", "left_anti").select("word").distinct().collect())
    unsure = frozenset(r.word for r in two) - short
    clean = counted.join(judged.filter("not bad").select("word"), "word", "left_semi")
    top = clean.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= WORDS_PER_LANGUAGE)
    words: dict[str, list[str]] = {}
    for r in top.orderBy("r", "lang").limit(WORDS_PER_LANGUAGE * LANGUAGES).collect():
        if r.word not in short:
            words.setdefault(r.lang, []).append(r.word)
    return Vocabulary(words, unsure, short, attested)


def restored_values(corpus: DataFrame, books: DataFrame, key: str = "idx", fields: tuple[str, ...] = ("text", "title")) -> DataFrame:
    """Garbled values: idx, field, value, restored, lost (whether characters are lost, so that it is not whole again).

    Null, empty and ASCII values are never garbled. Rows with a null key take no part; rows repeated with the same key and
    value count once (different values of one key each count). Other columns of the corpus play no part.
    """
    words = vocabulary(corpus, books, fields)
    shared = corpus.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = None
        for batch in batches:
            restorer = restorer or Restorer(shared.value)
            keys = batch.column(0).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for c, field in enumerate(fields, 1):
                for k, value in zip(keys, batch.column(c).to_pylist()):
                    found, text = restorer.restore(value)
                    if found:
                        for o, x in zip(out, (k, field, value, text, LOST in text)):
                            o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()))], names=["idx", "field", "value", "restored", "lost"])

    some = F.lit(False)
    for f in fields:
        some = some | F.coalesce(F.col(f).rlike(r"[^\x00-\x7F]"), F.lit(False))
    rows = corpus.filter(F.col(key).isNotNull()).filter(some).select(F.col(key).cast("long").alias("idx"), *fields)
    # only what was found is shuffled
    return rows.mapInArrow(run, "idx long, field string, value string, restored string, lost boolean").distinct()
