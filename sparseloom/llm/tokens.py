"""Token counts under an existing byte-level BPE tokenizer, and budgets per slice (problem 3).

A text is pre-split by the tokenizer's pattern. Every task keeps the distinct pieces it has met as arrays of symbol ids,
joins their adjacent pairs with the table of merge ranks (a sorted key array, so a merge join in NumPy), applies the
lowest-ranked merges of every piece and repeats until no pair has a rank; a text's tokens are the sum over its pieces.
One pass over the texts, no shuffle; the merge table's size is that of the tokenizer's file.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII only, for the faster standard module.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: Distinct pieces a task remembers; beyond, the memory starts anew (the counts stay exact).
REMEMBERED_PIECES = 400_000


class PairMerger:
    """Counts the tokens of pieces by repeated vectorised merges."""

    def __init__(self, file: str | bytes):
        """`file`: the rank file, its path or its content."""
        import regex

        ranks: dict[bytes, int] = {}
        for line in (file if isinstance(file, bytes) else content(file)).splitlines():
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = ranks.get(token[:cut])
                if a is not None:
                    b = ranks.get(token[cut:])
                    if b is not None:
                        keys.append(a << 20 | b)
                        merged.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array(merged, dtype=np.int64)[order]
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.known: dict[str, int] = {}

    def merge(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each (non-empty) piece."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        counts = np.array([len(r) for r in raw], dtype=np.int64)
        owner = np.repeat(np.arange(len(raw)), counts)
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        none = np.iinfo(np.int64).max
        while len(symbols) > 1:
            key = symbols[:-1] << 20 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.append(rank, none), starts)
            # pieces that are done leave
            active = lowest != none
            if not active.any():
                break
            per_symbol = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(symbols))))
            hit = (rank != none) & (rank == lowest[per_symbol[:-1]])
            # of touching hits (one pair overlapping the next) every second is applied, from the left
            position = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], position, -1))
            hit &= (position - run_start) % 2 == 0
            symbols[:-1][hit] = rank[hit]
            counts -= np.bincount(owner[:-1][hit], minlength=len(counts))
            keep = np.r_[True, ~hit] & active[per_symbol]
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def count(self, texts: list[str | None]) -> list[int]:
        split = [([] if not t else self.split_ascii(t) if t.isascii() else self.split(t)) for t in texts]
        if len(self.known) > REMEMBERED_PIECES:
            self.known.clear()
        new = list({p for pieces in split for p in pieces}.difference(self.known))
        if new:
            self.known.update(zip(new, self.merge(new).tolist()))
        known = self.known
        return [sum(map(known.__getitem__, pieces)) for pieces in split]


def content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_mergers: dict[str, PairMerger] = {}


def token_count(text, path: str = TOKENIZER):
    """A column with the number of tokens of a text column; null and empty texts have 0. The driver reads the rank file and
    broadcasts it (a file of less than a megabyte), so that workers need no copy of it."""
    shared = SparkSession.active().sparkContext.broadcast(content(path))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _mergers:
            _mergers[path] = PairMerger(shared.value)
        m = _mergers[path]
        for texts in batches:
            yield pd.Series(m.count([t if isinstance(t, str) else None for t in texts]), dtype="int64")

    return count(text)


def canonical_slug(slug):
    """A slug as the list of books writes it: trimmed, lower case, underscores as hyphens; blank becomes null."""
    s = F.regexp_replace(F.lower(F.regexp_replace(slug, r"^\s+|\s+$", "")), "_", "-")
    return F.when(s != "", s)


def passage_tokens(corpus: DataFrame, books: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """idx, book_slug, lang, domain, tokens of every passage.

    Of rows with the same idx the one loaded last counts (then the longest, then the greatest text). Untidy slugs are tidied
    before they are looked up; slugs that `books` does not have stay under their own name, missing ones under "unknown", and
    lang and domain are "unknown" where the book does not say. Null and blank texts count as they are (0 for null).
    A slug that `books` lists more than once takes its smallest non-null lang and domain.
    """
    from pyspark.sql import Window

    rows = corpus.select("idx", F.col("book_slug").alias("slug"), "loaded_at", token_count(F.col("text"), path).alias("tokens"), F.length("text").alias("n"))
    # only numbers and the slug are shuffled, not the text
    last = Window.partitionBy("idx").orderBy(F.desc_nulls_last("loaded_at"), F.desc_nulls_last("n"), F.desc("tokens"), F.desc_nulls_last("slug"))
    rows = rows.withColumn("r", F.row_number().over(last)).filter("r = 1").select("idx", F.coalesce(canonical_slug(F.col("slug")), F.lit("unknown")).alias("book_slug"), "tokens")
    b = books.select(canonical_slug(F.col("book_slug")).alias("book_slug"), "lang", "domain").filter("book_slug is not null")
    b = b.groupBy("book_slug").agg(F.min("lang").alias("lang"), F.min("domain").alias("domain"))
    out = rows.join(b, "book_slug", "left")
    return out.select("idx", "book_slug", *(F.coalesce(c, F.lit("unknown")).alias(c) for c in ("lang", "domain")), "tokens")


def token_budget(corpus: DataFrame, books: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Totals by book_slug, by lang, by domain and overall: slice (which of them), value, passages, tokens."""
    rows = passage_tokens(corpus, books, path)
    by_slug = rows.groupBy("book_slug", "lang", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    sliced = by_slug.select(F.explode(F.array(*(F.struct(F.lit(k).alias("slice"), F.coalesce(v, F.lit("")).alias("value")) for k, v in (("book_slug", F.col("book_slug")), ("lang", F.col("lang")), ("domain", F.col("domain")), ("lang_domain", F.concat_ws("/", "lang", "domain")), ("all", F.lit("all")))))).alias("k"), "n", "t")
    return sliced.groupBy(F.col("k.slice").alias("slice"), F.col("k.value").alias("value")).agg(F.sum("n").alias("passages"), F.sum("t").alias("tokens"))
