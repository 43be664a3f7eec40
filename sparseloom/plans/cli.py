"""python -m sparseloom.plans.cli COMMAND [options]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..operators.segments import SegmentedIndex
from ..sources import datasets
from ..sources import text as text_source
from . import jobs, prepare


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparseloom", description="Similarity search with sparse codes on Spark")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, k: int, activity: float, epochs: int, **more):
        s = sub.add_parser(name)
        s.add_argument("--k", type=int, default=k)
        s.add_argument("--activity", type=float, default=activity)
        s.add_argument("--epochs", type=int, default=epochs)
        s.add_argument("--seed", type=int, default=42)
        s.add_argument("--method", default="hebbian")
        s.add_argument("--lr", type=float, default=0.01)
        s.add_argument("--delta", type=float, default=0.0)
        s.add_argument("--anti-winner-rank", type=int, default=2)
        s.add_argument("--normalize", action=argparse.BooleanOptionalAction, default=more.get("normalize", False))
        s.add_argument("--r", type=int, default=more.get("r"))
        return s

    for name, activity in (("eval-mnist", 0.05), ("eval-fashion", 0.05), ("eval-cifar", 0.005)):
        add(name, 2, activity, 5).add_argument("data")
    s = add("sweep-mnist", 2, 0.05, 5)
    s.add_argument("data")
    s.add_argument("--ks", default="2,4,8,16,32,64")
    s = add("eval-ann", 8, 0.05, 3, normalize=True, r=100)
    s.add_argument("collection")
    s.add_argument("data")
    s.add_argument("--max-db", type=int, help="the first so many vectors; 100,000 of gist1m unless given, 0 for all")
    s.add_argument("--max-queries", type=int, help="the first so many queries; 1,000 of gist1m unless given, 0 for all")
    add("eval-synthetic-text", 8, 0.01, 3, normalize=True)
    e = sub.add_parser("embed")
    e.add_argument("text", nargs="?")
    e.add_argument("--model", default=prepare.DEFAULT_MODEL)
    e.add_argument("--manifest", help="take the model that this manifest.properties names")
    e.add_argument("--server", action="store_true", help="answer framed texts on standard input until it ends")
    r = sub.add_parser("prepare", help="a landed collection into a text benchmark")
    r.add_argument("layout", choices=("benchmark", "books", "stories"))
    r.add_argument("source")
    r.add_argument("--root", default="data/text")
    r.add_argument("--name", required=True)
    r.add_argument("--model", default=prepare.DEFAULT_MODEL)
    r.add_argument("--split", help="judgements to take (benchmark)")
    r.add_argument("--kind", help="kind of document to take (stories)")
    r.add_argument("--narrative-only", action="store_true")
    for what in ("documents", "passages", "queries"):
        r.add_argument(f"--max-{what}", type=int)
    for name in ("train-text", "query-text", "search-text"):
        s = add(name, 32, 0.01, 3, normalize=True, r=100)
        s.add_argument("dataset", nargs="?", default="scifact")
        s.add_argument("--data", default="data/text")
        s.add_argument("--index", required=name != "train-text", default="data/index")
        s.add_argument("--dense", action="store_true")
        s.add_argument("--dense-limit", type=int, default=jobs.DENSE_LIMIT, help="passages beyond which there is no dense ranking")
    return p


def _config(a, dataset: str) -> jobs.EvalConfig:
    return jobs.EvalConfig(dataset, a.method, a.k, a.activity, a.epochs, a.seed, a.lr, a.delta, a.anti_winner_rank, a.normalize, a.r)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, ask=input, out=print) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "embed":
            embedder = prepare.embedder(text_source.embedding_model(a.manifest) if a.manifest else a.model)
            if a.server:
                serve(embedder)
            else:
                out(written(embedder([a.text or ""])[0]))
            return 0
        spark = spark or SparkSession.builder.getOrCreate()
        if a.command == "prepare":
            options = {"benchmark": {"split": a.split or "test"}, "stories": {"kind": a.kind, "narrative_only": a.narrative_only}}.get(a.layout, {})
            prepare.prepare(spark, a.layout, a.source, a.root, a.name, a.model, prepare.Limits(a.max_documents, a.max_passages, a.max_queries), **options)
            out(f"wrote {text_source.benchmark_dir(a.root, a.name)}")
            return 0
        if a.command in ("eval-mnist", "eval-fashion", "sweep-mnist"):
            if not datasets.idx_available(a.data):
                raise FileNotFoundError(f"no image files in {a.data}")
            c = _config(a, "fashion" if a.command == "eval-fashion" else "mnist")
            if a.command == "sweep-mnist":
                split = jobs.splits.paper_split(datasets.read_idx_dataset(spark, a.data), "mnist", a.seed)
                for r in jobs.sweep(spark, split, c, tuple(map(int, a.ks.split(",")))):
                    out(jobs.format_result(r))
            else:
                out(jobs.format_result(jobs.evaluate_mnist(spark, a.data, c)))
        elif a.command == "eval-cifar":
            if not datasets.cifar_available(a.data):
                raise FileNotFoundError(f"no image files in {a.data}")
            out(jobs.format_result(jobs.evaluate_cifar(spark, a.data, _config(a, "cifar"))))
        elif a.command == "eval-ann":
            big = a.collection.lower() == "gist1m"
            if not datasets.ann_available(a.data, a.collection):
                raise FileNotFoundError(f"no {a.collection} files in {a.data}")
            most = [given or None if given is not None else usual if big else None for given, usual in ((a.max_db, 100_000), (a.max_queries, 1000))]
            if any(most):
                out(f"limited to {most[0] or 'all'} vectors and {most[1] or 'all'} queries")
            out(jobs.evaluate_ann(spark, datasets.read_ann(spark, a.data, a.collection, *most), _config(a, a.collection.lower())))
        elif a.command == "eval-synthetic-text":
            out(jobs.format_result(jobs.evaluate_synthetic_text(spark, _config(a, "synthetic-text"))))
        elif a.command == "train-text":
            out(jobs.format_train(jobs.train_text_benchmark(spark, text_source.read_text_benchmark(spark, a.data, a.dataset), a.index, _config(a, a.dataset))))
        elif a.command == "query-text":
            found = jobs.query_text_benchmark(spark, text_source.read_text_benchmark(spark, a.data, a.dataset), a.index, a.r, a.dense, a.dense_limit)
            for name in ("hash", "dense"):
                if name in found:
                    out(f"{name:<6}", jobs.format_metrics(found[name]))
            if "dense_left_out" in found:
                out(f"dense  left out: {found['dense_left_out']} passages, limit {a.dense_limit}")
        else:
            search_loop(spark, SegmentedIndex(spark, a.index), text_source.benchmark_dir(a.data, a.dataset), ask, out)
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def written(vector) -> str:
    return " ".join(f"{v:.8g}" for v in vector)


def serve(embedder, source=None, sink=None) -> None:
    """Frames of a length line and so many bytes, both ways: READY, then a vector (or ERR, a tab and why not) for each text, until
    the input ends or QUIT comes."""
    source, sink = source or sys.stdin.buffer, sink or sys.stdout.buffer

    def say(text: str) -> None:
        payload = text.encode()
        sink.write(f"{len(payload)}\n".encode() + payload)
        sink.flush()

    say("READY")
    while (head := source.readline().strip()) and (payload := source.read(int(head))) != b"QUIT":
        text = payload.decode("utf-8", "replace")
        try:
            say(written(embedder([text])[0]) if text else "ERR\tempty text")
        except Exception as e:  # noqa: BLE001 - the next text may be fine
            say(f"ERR\t{e}")


def search_loop(spark: SparkSession, index: SegmentedIndex, directory: str, ask=input, out=print, embedder=None) -> None:
    """:help :quit :q, :k N, :list, :use ID, or any text to search for. Texts are embedded with the model the index names."""
    embedder = embedder or prepare.embedder(index.manifest().embedding_model)
    passages = text_source.read_corpus_jsonl(spark, f"{directory}/corpus.jsonl")
    queries = text_source.read_queries_jsonl(spark, f"{directory}/queries.jsonl")
    k = 10
    while True:
        try:
            line = ask("> ").strip()
        except EOFError:
            return
        word, _, rest = line.partition(" ")
        if word in (":quit", ":q"):
            return
        if word == ":help":
            out(search_loop.__doc__)
        elif word == ":k" and rest.strip().isdigit() and int(rest) > 0:
            k = int(rest)
        elif word == ":list":
            for r in text_source.list_query_ids(queries).collect():
                out(r[0])
        elif line and (not line.startswith(":") or word == ":use"):
            if word == ":use":
                found = queries.filter(queries["_id"] == rest.strip()).first()
                if found is None:
                    out(f"no query {rest.strip()!r}")
                    continue
                line = found.text
            vector = embedder([line])[0].tolist()
            hits = index.search(spark.createDataFrame([(0, vector)], "idx long, vec array<double>"), k)
            for h in hits.join(passages.withColumnRenamed("_id", "doc_id"), "doc_id", "left").orderBy("rank").collect():  # k rows
                out(f"{h['rank']:3d}. {h.doc_id}  hamming={h.hamming}  {(h.passage or '')[:300]}")


if __name__ == "__main__":
    sys.exit(main())
