"""Corpus preparation: documents and queries to passages, queries and relevance judgements."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as text_fn
from ..session import checkpoint


def clean_documents(docs: DataFrame, kind: str | None = None, narrative_only: bool = False) -> DataFrame:
    """doc_id, title, text of docs (doc_id, title, text and, if `kind` is given, kind): title falls back to the id, texts lose
    boilerplate and markup; documents left blank go."""
    d = docs if kind is None else docs.filter(F.col("kind") == kind)
    if narrative_only:
        d = d.filter(text_fn.is_narrative("title"))
    body = text_fn.strip_html(text_fn.strip_boilerplate(F.coalesce("text", F.lit(""))))
    title = F.when(text_fn.strip(F.coalesce("title", F.lit(""))) != "", F.col("title")).otherwise(F.col("doc_id").cast("string"))
    return d.select("doc_id", title.alias("title"), body.alias("text")).filter(text_fn.strip("text") != "")


def first_documents(rows: DataFrame, order: str, most: int | None = None) -> DataFrame:
    """One row per doc_id, the one seen first by `order`; with `most`, the first so many documents."""
    first = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), order).alias("r"), F.min(order).alias("__first"))
    if most is not None:
        first = first.orderBy("__first").limit(most)
    return first.select("doc_id", "r.*")


def distinct_questions(rows: DataFrame, order: str, most: int | None = None, prefix: str = "q") -> DataFrame:
    """_id, doc_id, text: each (doc_id, question) once, in the order first seen; blank questions go; ids `{prefix}-%05d` from 0."""
    asked = rows.select("doc_id", text_fn.strip("question").alias("text"), F.col(order).alias("o")).filter("text is not null and text != '' and doc_id is not null")
    once = asked.groupBy("doc_id", "text").agg(F.min("o").alias("o"))
    if most is not None:
        once = once.orderBy("o", "doc_id", "text").limit(most)
    return numbered(once, ["o", "doc_id", "text"]).select(F.format_string(prefix + "-%05d", "n").alias("_id"), "doc_id", "text")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """`n` from 0 in a global order, without one task for all rows: a range sort, then offsets from the rows of each partition.

    Where a row lies is written down with it before the partitions are counted: sorted anew, from other samples or coalesced
    in another way, it might lie elsewhere."""
    where = F.monotonically_increasing_id()  # partition number and row number in it
    placed = checkpoint(df.orderBy(*order).withColumn("__at", where))
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["count"] for r in placed.groupBy(part.alias("p")).count().collect()}  # one row per partition
    start, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(start)
        start += counts.get(p, 0)
    base = F.get(F.array(*(F.lit(o).cast("long") for o in offsets)), part.cast("int")) if offsets else F.lit(0).cast("long")
    return placed.withColumn("n", base + row).drop("__at")


def corpus_rows(docs: DataFrame, key: str = "doc_id", least: int = 250, most: int = 350, max_per_corpus: int | None = None, separator: str = "paragraph") -> DataFrame:
    """_id, title, text, key, chunk_no: chunks of every document with ids `{key}-%04d`. With a cap, the first so many by
    (key, chunk_no)."""
    pieces = text_fn.split_paragraphs("text") if separator == "paragraph" else text_fn.split_sentences("text")
    joiner = "\n\n" if separator == "paragraph" else " "
    rows = docs.select(key, "title", F.posexplode(text_fn.chunk_pieces(pieces, least, most, joiner)).alias("chunk_no", "chunk"))
    out = rows.select(text_fn.chunk_id(F.col(key).cast("string"), "chunk_no").alias("_id"), "title", F.col("chunk").alias("text"), key, "chunk_no")
    return out if max_per_corpus is None else out.orderBy(key, "chunk_no").limit(max_per_corpus)


def build_qrels(queries: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, corpus_id, score 1: every query with all chunks of its document; queries without chunks fall out."""
    c = corpus.select(F.col("_id").alias("corpus_id"), key)
    return queries.select(F.col("_id").alias("query_id"), key).join(c, key).select("query_id", "corpus_id", F.lit(1).alias("score"))


def queries_with_chunks(queries: DataFrame, corpus: DataFrame, key: str = "doc_id") -> DataFrame:
    return queries.join(corpus.select(key).distinct(), key, "left_semi")


def keep_judged(qrels: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Judgements whose query and passage are both kept."""
    kept = qrels.join(corpus.select(F.col("_id").alias("corpus_id")), "corpus_id", "left_semi")
    return kept.join(queries.select(F.col("_id").alias("query_id")), "query_id", "left_semi").select("query_id", "corpus_id", "score")


def hashed_bag_of_words(texts: list[str | None], dim: int = 384) -> np.ndarray:
    """The offline default embedding: signed hashed word counts, of unit length (zero for texts without words)."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts):
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode("utf-8", "replace"))
            row[(h >> 1) % dim] += 1 if h & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 0, out / np.where(norm > 0, norm, 1), out)


def embed(df: DataFrame, text: str = "text", vec_col: str = "vec", embedder=hashed_bag_of_words) -> DataFrame:
    """`df` with a vector per text; `embedder` takes a list of texts and gives a matrix, and runs inside Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder(texts.tolist())))

    return df.withColumn(vec_col, run(F.col(text)))


def prepare_corpus(docs: DataFrame, questions: DataFrame, least: int = 250, most: int = 350, max_corpus: int | None = None, max_queries: int | None = None, kind: str | None = None, narrative_only: bool = False, embedder=hashed_bag_of_words) -> dict[str, DataFrame]:
    """The whole preparation: corpus and queries with vectors, and judgements. docs: doc_id, title, text, ord[, kind];
    questions: doc_id, question, ord."""
    cleaned = clean_documents(first_documents(docs, "ord"), kind, narrative_only)
    corpus = corpus_rows(cleaned, least=least, most=most, max_per_corpus=max_corpus)
    queries = queries_with_chunks(distinct_questions(questions, "ord", max_queries), corpus)
    passages = corpus.withColumn("passage", text_fn.passage_text("title", "text"))
    return {"corpus": embed(passages, "passage", embedder=embedder).drop("passage"), "queries": embed(queries, embedder=embedder), "qrels": build_qrels(queries, corpus)}
