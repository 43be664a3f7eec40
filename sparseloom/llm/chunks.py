"""Splitting oversized texts at natural boundaries (problem 7).

Content-defined chunking over words. A rolling hash over the last words marks landmarks; the first landmark of the window
between the smallest and the largest piece snaps to the nearest natural boundary of that window (paragraph ends before
sentence ends). An edit moves only the cuts next to it, since later landmarks depend on the words around them alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_WORDS, OVERLAP, MIN_NEW, WINDOW, LANDMARK_EVERY = 350, 40, 120, 8, 48
#: Characters of pieces handed on at once.
CHARACTERS_AT_ONCE = 4_000_000
WORD = r"[^ \t\n\r]+"
_word = re.compile(WORD)
_blank_line = re.compile(r"\n[ \t\r]*\n|\r[ \t]*\r")
_sentence_end = re.compile(r"[.!?…。！？][\"'”’»“)\]]*$")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[str]) -> np.ndarray:
    """The rolling hash at every word: of it and the words before it, `WINDOW` in all."""
    h = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words], dtype=np.uint64) * _MIX
    total, factor = np.zeros(len(words), dtype=np.uint64), np.uint64(1)
    for back in range(WINDOW):
        if back < len(words):
            total[back:] += h[: len(words) - back] * factor
        factor = np.uint64((int(factor) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF)
    total ^= total >> np.uint64(29)
    return total * _MIX >> np.uint64(16)


def cut_points(n: int, hashes: np.ndarray, strength: np.ndarray, max_words: int, overlap: int, min_new: int) -> list[int]:
    """Ends of the pieces in words; strength[i]: 2 where a paragraph ends after word i, 1 where a sentence does, else 0."""
    ends, at = [], 0
    while True:
        most = max_words if not ends else max_words - overlap
        if n - at <= most:
            return [*ends, n]
        low, high = at + min(min_new, most) - 1, at + most - 1  # the last word of the piece lies in low..high
        window = hashes[low : high + 1]
        marks = np.flatnonzero(window % np.uint64(LANDMARK_EVERY) == 0)
        mark = int(marks[0]) if len(marks) else int(np.argmax(window))
        s = strength[low : high + 1]
        for level, reach in ((2, most // 4), (1, most), (2, most)):
            places = np.flatnonzero(s >= level)
            if len(places):
                nearest = int(places[np.argmin(np.abs(places - mark))])
                if abs(nearest - mark) <= reach:
                    mark = nearest
                    break
        at = low + mark + 1
        ends.append(at)


def pieces(text: str, max_words: int = MAX_WORDS, overlap: int = OVERLAP, min_new: int = MIN_NEW) -> list[tuple[str, int, int]]:
    """(piece, number of its first word, number of words); one piece if the text is within the limit; none without words."""
    spans = [m.span() for m in _word.finditer(text)]
    if not spans:
        return []
    if len(spans) <= max_words:
        return [(text, 0, len(spans))]
    words = [text[a:b] for a, b in spans]
    strength = np.zeros(len(spans), dtype=np.int8)
    for i in range(len(spans) - 1):
        if spans[i + 1][0] - spans[i][1] > 1 and _blank_line.search(text, spans[i][1], spans[i + 1][0]):
            strength[i] = 2
        elif _sentence_end.search(words[i][-8:]):
            strength[i] = 1
    out, start = [], 0
    for end in cut_points(len(spans), word_hashes(words), strength, max_words, overlap, min_new):
        first = max(0, start - overlap) if out else 0
        out.append((text[spans[first][0] : spans[end - 1][1]], first, end - first))
        start = end
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def split_oversized(df: DataFrame, key: str = "idx", text: str = "text", group: str = "book_slug", version: str | None = "loaded_at", max_words: int = MAX_WORDS, overlap: int = OVERLAP, min_new: int = MIN_NEW) -> DataFrame:
    """Pieces of every text of more than `max_words` words: key, group, piece_no (from 0), n_pieces, first_word, n_words, piece.

    Every piece has at most `max_words` words, and from the second on begins with the last `overlap` words of the one before.
    Texts within the limit, null and empty ones give no rows. Words are runs of characters other than space, tab, line feed
    and carriage return; a word is never cut, however long. Rows with the same key count once: the one with the greatest
    `version`, then the most words, then the greatest hash of the text. Rows with a null key take no part. Other columns play no part.
    """
    if not 0 <= overlap < max_words or not 0 < min_new <= max_words - overlap:
        raise ValueError("0 <= overlap < max_words and 0 < min_new <= max_words - overlap must hold")
    when = F.col(version) if version else F.lit(None).cast("timestamp")
    rows = df.select(F.col(key).alias("k"), F.col(group).cast("string").alias("g"), F.col(text).alias("t"), when.alias("v")).filter("k is not null")
    # versions are compared before long texts are selected, so that a shorter later text wins; only lengths are shuffled for it
    sized = rows.withColumn("n", word_count(F.col("t"))).filter(F.col("n") > max_words) if version is None else rows.withColumn("n", word_count(F.col("t")))
    if version is not None:
        seen = sized.groupBy("k").agg(F.max(F.struct("v", "n", F.xxhash64("t").alias("h"))).alias("last"), F.max("n").alias("longest"))
        seen = seen.filter((F.col("longest") > max_words) & (F.col("last.n") > max_words)).select("k", "last")
        long = sized.filter(F.col("n") > max_words)
        sized = long.join(seen, "k").filter((F.coalesce(F.col("v"), F.lit("1900-01-01").cast("timestamp")) == F.coalesce(F.col("last.v"), F.lit("1900-01-01").cast("timestamp"))) & (F.xxhash64("t") == F.col("last.h")))
    once = sized.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t"), F.desc_nulls_last("g")))).filter("r = 1").select("k", "g", "t")
    kind = dict(once.dtypes)["k"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "g", "piece_no", "n_pieces", "first_word", "n_words", "piece"]
        for batch in batches:
            source, cols, held = [], ([], [], [], [], []), 0

            def out() -> pa.RecordBatch:
                at = pa.array(source, pa.int64())  # noqa: B023
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=names)  # noqa: B023

            for i in range(batch.num_rows):
                made = pieces(batch.column(2)[i].as_py(), max_words, overlap, min_new)
                for no, (piece, first, n) in enumerate(made):
                    source.append(i)
                    held += len(piece)
                    for c, x in zip(cols, (no, len(made), first, n, piece)):
                        c.append(x)
                    if held > CHARACTERS_AT_ONCE:
                        yield out()
                        source, cols, held = [], ([], [], [], [], []), 0
            if source:
                yield out()

    made = once.mapInArrow(cut, f"k {kind}, g string, piece_no int, n_pieces int, first_word int, n_words int, piece string")
    return made.withColumnsRenamed({"k": key, "g": group})
