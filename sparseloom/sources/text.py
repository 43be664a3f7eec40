"""Text formats: ids, judgements, JSON lines, properties, and a text benchmark made of them."""

from __future__ import annotations

import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as text_fn
from .files import exists, lines_of, writing
from .records import read_records, write_vectors


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """idx (line number from 0), line. Blocks of a file are read in parallel; their line counts, one row per block, give the
    offsets, so that numbers follow the file's order."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    blocks = sorted((r.f, r.b, r["count"]) for r in rows.groupBy("f", "b").count().collect())
    start, offsets = 0, []
    for f, b, n in blocks:
        offsets.append((f, b, start))
        start += n
    if not offsets:
        return spark.createDataFrame([], "idx long, line string")
    if len(offsets) == 1:
        return rows.select((F.row_number().over(Window.partitionBy("f", "b").orderBy("m")) - 1).cast("long").alias("idx"), "line")
    base = spark.createDataFrame(offsets, "f string, b long, start long")
    return rows.join(base, ["f", "b"]).select((F.col("start") + F.row_number().over(Window.partitionBy("f", "b").orderBy("m")) - 1).alias("idx"), "line")


def _renumbered(lines: DataFrame) -> DataFrame:
    """Line numbers without the gaps of dropped lines."""
    from ..operators.textprep import numbered

    return numbered(lines, ["idx"]).drop("idx").withColumnRenamed("n", "idx")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """idx, id: one id per line, trimmed, blank lines dropped."""
    lines = read_lines(spark, path).select("idx", text_fn.strip("line").alias("id")).filter("id != ''")
    return _renumbered(lines).select("idx", "id")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, corpus_id, score of judgements above 0. A first line with "query" in it is a header; lines with fewer than
    three fields go; of a repeated pair the last line counts."""
    lines = read_lines(spark, path).filter(~((F.col("idx") == 0) & F.lower("line").contains("query")))
    f = F.split("line", "\t")
    rows = lines.filter(F.size(f) >= 3).select("idx", F.trim(f[0]).alias("query_id"), F.trim(f[1]).alias("corpus_id"), F.trim(f[2]).cast("int").alias("score")).filter("score > 0")
    return rows.groupBy("query_id", "corpus_id").agg(F.max_by("score", "idx").alias("score"))


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """_id, title, text, passage; a missing title or text is empty; rows without _id go."""
    rows = spark.read.schema("_id string, title string, text string").json(path).filter("_id is not null")
    return rows.select("_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")).withColumn("passage", text_fn.passage_text("title", "text"))


def read_queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).dropna(subset=["_id", "text"])


def list_query_ids(queries: DataFrame, limit: int = 20, key: str = "_id") -> DataFrame:
    return queries.select(key).orderBy(key).limit(limit)


def count_jsonl(spark: SparkSession, path: str) -> int:
    """Lines of a file; 0 if it is missing."""
    return spark.read.text(path).count() if exists(path) else 0


def json_field(line, field: str):
    """A field of a JSON object in a text column, as a string."""
    return F.get_json_object(line, f"$['{field}']")


def read_properties(path: str) -> dict[str, str]:
    """key=value lines of a small file on the driver; {} if it is missing."""
    if not exists(path):
        return {}
    return dict(line.split("=", 1) for line in lines_of(path) if "=" in line and not line.startswith("#"))


def embedding_model(path: str) -> str:
    return read_properties(path).get("embeddingModel", "unknown")


def write_properties(values: dict, path: str) -> None:
    with writing(path) as f:
        f.write("".join(f"{k}={v}\n" for k, v in values.items()).encode())


def _write_single(df: DataFrame, path: str, header: str | None = None) -> None:
    """Rows of one string column, in the order they are in, streamed by one task into one file."""
    def run(batches):
        from pyspark import TaskContext

        with writing(path, str(TaskContext.get().taskAttemptId())) as f:
            if header is not None:
                f.write(header.encode() + b"\n")
            for batch in batches:
                f.write("".join(line + "\n" for line in batch.column(0).to_pylist()).encode("utf-8", "replace"))
        yield from ()

    df.mapInArrow(run, df.schema).write.format("noop").mode("overwrite").save()


def write_ids(df: DataFrame, path: str, order: str = "idx", key: str = "id") -> None:
    _write_single(df.select(order, key).repartition(1).sortWithinPartitions(order).select(key), path)


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """One JSON object per line, characters as they are; null fields are left out."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("line"), *([F.col(order).alias("o")] if order else []))
    rows = rows.repartition(1).sortWithinPartitions("o") if order else rows.coalesce(1)
    _write_single(rows.select("line"), path)


def write_qrels(df: DataFrame, path: str) -> None:
    rows = df.repartition(1).sortWithinPartitions("query_id", "corpus_id").select(F.concat_ws("\t", "query_id", "corpus_id", F.col("score").cast("string")).alias("line"))
    _write_single(rows, path, "query-id\tcorpus-id\tscore")


@dataclass(frozen=True)
class TextBenchmark:
    name: str
    corpus: DataFrame  # idx, id, vec
    queries: DataFrame
    qrels: DataFrame  # query_id, corpus_id, score
    model: str
    dim: int


def text_benchmark_available(root: str, name: str) -> bool:
    d = benchmark_dir(root, name)
    return all(exists(os.path.join(d, f)) for f in ("corpus.fvecs", "corpus.ids", "query.fvecs", "query.ids", "qrels/test.tsv"))


def benchmark_dir(root: str, name: str) -> str:
    return os.path.join(root, name)


def _vectors_with_ids(spark: SparkSession, directory: str, part: str) -> tuple[DataFrame, int, int]:
    v, ids = read_records(spark, os.path.join(directory, f"{part}.fvecs"), "fvecs"), read_ids(spark, os.path.join(directory, f"{part}.ids"))
    a, b = v.count(), ids.count()
    if a != b:
        raise ValueError(f"{part}: {a} vectors, {b} ids")
    dims = [r[0] for r in v.select(F.size("vec")).distinct().limit(2).collect()]
    if len(dims) > 1:
        raise ValueError(f"{part}: vectors of different dimension")
    return ids.join(v, "idx").select("idx", "id", "vec"), a, dims[0] if dims else 0


def read_text_benchmark(spark: SparkSession, root: str, name: str) -> TextBenchmark:
    d = benchmark_dir(root, name)
    corpus, _, dim = _vectors_with_ids(spark, d, "corpus")
    queries, n, qdim = _vectors_with_ids(spark, d, "query")
    if n and qdim != dim:
        raise ValueError(f"corpus has {dim} dimensions, queries {qdim}")
    return TextBenchmark(name, corpus, queries, read_qrels(spark, os.path.join(d, "qrels", "test.tsv")), embedding_model(os.path.join(d, "manifest.properties")), dim)


def write_text_benchmark(root: str, name: str, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, model: str) -> None:
    """corpus, queries: idx, id, vec (and text columns, which go to JSON lines)."""
    d = benchmark_dir(root, name)
    for part, lines, df in (("corpus", "corpus", corpus), ("query", "queries", queries)):
        write_vectors(df, os.path.join(d, f"{part}.fvecs"))
        write_ids(df, os.path.join(d, f"{part}.ids"))
        if "text" in df.columns:
            write_jsonl(df.select(F.col("id").alias("_id"), *([c for c in ("title",) if c in df.columns]), "text", "idx"), os.path.join(d, f"{lines}.jsonl"), "idx")
    write_qrels(qrels, os.path.join(d, "qrels", "test.tsv"))
    size, qsize = corpus.count(), queries.count()
    dim = corpus.select(F.size("vec")).first()
    write_properties({"dataset": name, "embeddingModel": model, "corpusSize": size, "querySize": qsize, "vectorDim": dim[0] if dim else 0}, os.path.join(d, "manifest.properties"))


#: Encodings that landed text files are tried in, one after the other; the last fits any bytes.
ENCODINGS = ("utf-8-sig", "utf-8", "latin-1")


def decoded_text(raw: bytes) -> str:
    for encoding in ENCODINGS[:-1]:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode(ENCODINGS[-1])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text of landed text files, one row each (none for an empty one); in UTF-8 with or without a mark at the beginning, else in Latin-1."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decoded_text(b) for b in batch.column(1).to_pylist()], pa.string())], names=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")
