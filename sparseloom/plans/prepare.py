"""Preparation of landed collections into text benchmarks: three layouts, one result.

    benchmark   corpus.jsonl, queries.jsonl and qrels/SPLIT.tsv, to be embedded as they are
    books       text files listed in books.jsonl (file, slug, title), and queries.jsonl (_id, text, book_slug): texts are cut into
                passages, and a query is judged with all passages of its book
    stories     JSON lines of documents with a question each (document.id, .kind, .text, .summary.title, question.text), a document
                in as many lines as it has questions
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as text_fn
from ..operators import textprep
from ..sources import text as source

Embedder = Callable[[list], np.ndarray]
#: Embedding models by the name that manifests carry.
EMBEDDERS: dict[str, Embedder] = {"hashed-words-384": textprep.hashed_bag_of_words}
DEFAULT_MODEL = "hashed-words-384"


def embedder(model: str) -> Embedder:
    """The embedder of a model; vectors of another one are of no use with an index, so an unknown name is an error."""
    if model not in EMBEDDERS:
        raise ValueError(f"no embedder for the model {model!r}; known are {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[model]


@dataclass(frozen=True)
class Limits:
    """The first so many of each; None for all."""

    documents: int | None = None
    passages: int | None = None
    queries: int | None = None


def _first(df: DataFrame, order: list[str], most: int | None) -> DataFrame:
    return df if most is None else df.orderBy(*order).limit(most)


def _in_file_order(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON lines file with `ord`, the number of their line."""
    lines = source.read_lines(spark, path).filter("trim(line) != ''")
    return lines.select(F.col("idx").alias("ord"), F.from_json("line", schema).alias("r")).select("ord", "r.*")


def read_benchmark_layout(spark: SparkSession, path: str, split: str = "test", limits: Limits = Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus: id, title, text, ord; queries: id, text, ord; judgements among them)."""
    corpus = _in_file_order(spark, f"{path}/corpus.jsonl", "_id string, title string, text string").filter("_id is not null")
    queries = _in_file_order(spark, f"{path}/queries.jsonl", "_id string, text string").filter("_id is not null and text is not null")
    corpus, queries = _first(corpus, ["ord"], limits.passages), _first(queries, ["ord"], limits.queries)
    qrels = textprep.keep_judged(source.read_qrels(spark, f"{path}/qrels/{split}.tsv"), corpus, queries)
    blank = F.lit("")
    return corpus.select(F.col("_id").alias("id"), F.coalesce("title", blank).alias("title"), F.coalesce("text", blank).alias("text"), F.array("ord").alias("ord")), queries.select(F.col("_id").alias("id"), "text", F.array("ord").alias("ord")), qrels


def read_books_layout(spark: SparkSession, path: str, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    books = _in_file_order(spark, f"{path}/books.jsonl", "file string, slug string, title string").filter("file is not null and slug is not null")
    books = _first(books, ["ord"], limits.documents)
    landed = source.read_documents(spark, f"{path}/*.txt").withColumn("file", F.element_at(F.split("path", "/"), -1))
    docs = landed.join(books, "file").select(F.col("slug").alias("doc_id"), "title", "text", "ord")
    asked = _in_file_order(spark, f"{path}/queries.jsonl", "_id string, text string, book_slug string").filter("_id is not null and text is not null")
    asked = asked.join(books.select(F.col("slug").alias("book_slug")), "book_slug", "left_semi").withColumnRenamed("book_slug", "doc_id")
    return _passages(docs, asked, None, False, limits)


def read_stories_layout(spark: SparkSession, path: str, kind: str | None = None, narrative_only: bool = False, limits: Limits = Limits(), prefix: str = "q") -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _in_file_order(spark, path, "document struct<id:string,kind:string,text:string,summary:struct<title:string>>, question struct<text:string>")
    docs = rows.select(F.col("document.id").alias("doc_id"), F.col("document.summary.title").alias("title"), F.col("document.text").alias("text"), F.col("document.kind").alias("kind"), "ord")
    if kind is not None:
        docs = docs.filter(F.col("kind") == kind)
    if narrative_only:
        docs = docs.filter(text_fn.is_narrative("title"))
    docs = textprep.first_documents(docs.filter(text_fn.strip(F.coalesce("text", F.lit(""))) != ""), "ord", limits.documents)
    asked = rows.select(F.col("document.id").alias("doc_id"), F.col("question.text").alias("question"), "ord").join(docs.select("doc_id"), "doc_id", "left_semi")
    queries = textprep.distinct_questions(asked, "ord", limits.queries, prefix).withColumn("ord", F.substring_index("_id", "-", -1).cast("long"))
    return _passages(docs, queries, None, False, limits)


def _passages(docs: DataFrame, asked: DataFrame, kind: str | None, narrative_only: bool, limits: Limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: doc_id, title, text, ord; asked: _id, doc_id, text, ord."""
    cleaned = textprep.clean_documents(docs, kind, narrative_only).join(docs.select("doc_id", "ord"), "doc_id")
    cut = textprep.corpus_rows(cleaned).join(cleaned.select("doc_id", "ord"), "doc_id")
    corpus = _first(cut, ["ord", "chunk_no"], limits.passages)
    queries = _first(textprep.queries_with_chunks(asked, corpus), ["ord"], limits.queries)
    qrels = textprep.build_qrels(queries, corpus)
    return corpus.select(F.col("_id").alias("id"), "title", "text", F.array(F.col("ord"), F.col("chunk_no").cast("long")).alias("ord")), queries.select(F.col("_id").alias("id"), "text", F.array("ord").alias("ord")), qrels


def prepare(spark: SparkSession, layout: str, path: str, root: str, name: str, model: str = DEFAULT_MODEL, limits: Limits = Limits(), **options) -> None:
    """Reads a landed collection, embeds passages and queries with `model` and writes the text benchmark root/name."""
    embed_with = embedder(model)
    layouts = {"benchmark": read_benchmark_layout, "books": read_books_layout, "stories": read_stories_layout}
    if layout not in layouts:
        raise ValueError(f"unknown layout {layout!r}; expected one of {', '.join(layouts)}")
    corpus, queries, qrels = layouts[layout](spark, path, limits=limits, **options)
    if corpus.isEmpty():
        raise ValueError(f"no documents in {path}")

    def rows(df: DataFrame) -> DataFrame:
        return textprep.numbered(df, ["ord", "id"]).withColumnRenamed("n", "idx").drop("ord")

    passages = textprep.embed(rows(corpus).withColumn("passage", text_fn.passage_text("title", "text")), "passage", embedder=embed_with).drop("passage")
    source.write_text_benchmark(root, name, passages, textprep.embed(rows(queries), embedder=embed_with), qrels, model)
