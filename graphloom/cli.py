"""Command line: index, query, inspect, export, doctor."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import graph, models, vectors
from .plans import index as indexing
from .plans import retrieval
from .plans.store import Store
from .sources import files


def doctor(spark: SparkSession, store: str) -> dict:
    """Whether each table can be read."""
    health = {}
    tables = Store(spark, store)
    reads = {name: (lambda name=name: tables.read(name)) for name in ("nodes", "edges", "vectors")} | {"batch_manifest": lambda: spark.read.parquet(f"{store}/batch_manifest")}
    for name, read in reads.items():
        try:
            rows = read()
            health[name] = "ok" if rows is not None and rows.limit(1).collect() is not None else "no table"
        except Exception as e:  # any failure to read means the table is not healthy
            health[name] = str(e).splitlines()[0][:200]
    return {"status": "healthy" if set(health.values()) == {"ok"} else "degraded", "stores": health}


def embedder(kind: str, url: str, model: str, revision: str, dim: int, fallback: bool, log: bool):
    """The embedder that the options ask for: by hash, over HTTP or a real encoder; with the hash embedder behind it, and its times logged."""
    made = {"hash": lambda: models.HashEmbedder(dim, model, revision), "http": lambda: models.HttpEmbedder(url, model, revision, dim), "encoder": lambda: models.EncoderEmbedder(model, revision, dim)}[kind]()
    made = models.FallbackEmbedder(made, models.HashEmbedder(dim, model, revision)) if fallback else made
    return models.LatencyLogged(made) if log else made


def reranker(kind: str, url: str, model: str, revision: str, fallback: bool, log: bool):
    """The reranker that the options ask for; None leaves the candidates' own scores."""
    if kind == "none":
        return None
    made = {"words": models.JaccardReranker, "http": lambda: models.HttpReranker(url, model, revision), "cross-encoder": lambda: models.CrossEncoderReranker(model, revision)}[kind]()
    made = models.FallbackReranker(made, models.JaccardReranker()) if fallback else made
    return models.LatencyLogged(made, "rerank") if log else made


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("--store", required=True)
    sub = parser.add_subparsers(dest="command", required=True)
    model = argparse.ArgumentParser(add_help=False)
    model.add_argument("--embedder", choices=("hash", "http", "encoder"), default="hash")
    model.add_argument("--embedder-url", default="")
    model.add_argument("--model", default="mock-embedder")
    model.add_argument("--revision", default="0")
    model.add_argument("--fallback", action="store_true", help="stand in for services that can't be reached")
    model.add_argument("--log-latency", action="store_true")
    p = sub.add_parser("index", parents=[model])
    p.add_argument("root")
    p.add_argument("--repo", required=True)
    p.add_argument("--parser", choices=("regex", "ast"), default="regex")
    p.add_argument("--rig", nargs="*", default=[], choices=("package-json", "pyproject", "manual-yaml", "external"))
    p.add_argument("--rig-command", help="the external exporter")
    p.add_argument("--dim", type=int, default=1024)
    p.add_argument("--batch-id")
    p.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("query", parents=[model])
    p.add_argument("text")
    p.add_argument("--root", required=True)
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--reranker", choices=("none", "words", "http", "cross-encoder"), default="none")
    p.add_argument("--reranker-url", default="")
    p.add_argument("--reranker-model", default="")
    p.add_argument("--reranker-revision", default="")
    p.add_argument("--rerank-seconds", type=float)
    p = sub.add_parser("inspect")
    p.add_argument("what", choices=("nodes", "edges", "vectors", "batches"))
    p.add_argument("--kind", default="")
    p.add_argument("--path", default="")
    p.add_argument("--run", default="")
    p.add_argument("--limit", type=int, default=20)
    p = sub.add_parser("export")
    p.add_argument("--repo", default="")
    p.add_argument("--run", default="")
    p.add_argument("--folder", help="JSON lines in two folders; else one document is printed")
    sub.add_parser("doctor")
    return parser


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    tables = Store(spark, a.store)

    def read(name: str):
        rows = tables.read(name)
        if rows is None:
            raise SystemExit(f"{a.store} has no {name}")
        return rows

    if a.command == "index":
        made = embedder(a.embedder, a.embedder_url, a.model, a.revision, a.dim, a.fallback, a.log_latency) if a.embedder != "hash" or a.log_latency else None
        config = indexing.Config(a.repo, a.parser, tuple(a.rig), a.dim, a.model, a.revision, dry_run=a.dry_run)
        out = indexing.index(spark, a.root, a.store, config, made, batch_id=a.batch_id, command=a.rig_command)
    elif a.command == "query":
        query, dim = retrieval.query_row(spark, a.text), (tables.current()["identity"] or {"dim": 1024})["dim"]
        made = embedder(a.embedder, a.embedder_url, a.model, a.revision, dim, a.fallback, a.log_latency)
        vector = S.hash_embedding(F.lit(a.text), dim) if a.embedder == "hash" else made.embed([a.text])[0]
        rank = reranker(a.reranker, a.reranker_url, a.reranker_model, a.reranker_revision, a.fallback, a.log_latency)
        found = retrieval.retrieve(read("nodes"), read("edges"), read("vectors"), files.walked(spark, a.root), query, vector, retrieval.Limits(final=a.limit), rank, a.rerank_seconds)
        out = retrieval.bundle(found, a.text).first().asDict(recursive=True)
    elif a.command == "inspect":
        if a.what == "nodes":
            rows = graph.list_nodes(read("nodes"), a.kind, a.path, run=a.run, limit=a.limit)
        elif a.what == "edges":
            rows = graph.list_edges(read("edges"), a.kind, run=a.run, limit=a.limit)
        elif a.what == "vectors":
            rows = vectors.list_by_run(read("vectors"), a.run, a.limit)
        else:
            rows = indexing.batches(spark, a.store).orderBy("created_at").limit(a.limit)
        out = [r.asDict(recursive=True) for r in rows.collect()]
    elif a.command == "export":
        if not a.folder:
            graph.export_document(read("nodes"), read("edges"), sys.stdout, a.repo, a.run)
            return 0
        out = graph.export_json(read("nodes"), read("edges"), a.folder, a.repo, a.run)
    else:
        out = doctor(spark, a.store)
    json.dump(out, sys.stdout, indent=2, default=str)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
