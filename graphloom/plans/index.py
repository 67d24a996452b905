"""Indexing a repository: files to nodes, edges and vectors, with a manifest row for each batch.

A batch is recorded as pending before anything is written.  Its rows are computed once, into a staging folder;
they are checked there, merged with the parts of the tables that they touch, and one new file of the store's log
makes all of it valid at once.  Then the batch's last event follows: committed, dry_run, or failed.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import extract, graph, manifest, models, rig, vectors
from ..sources import build_files, files
from .store import Store


@dataclass(frozen=True)
class Config:
    repo: str
    parser: str = "regex"
    rig: tuple[str, ...] = ()
    dim: int = 1024
    model: str = "mock-embedder"
    revision: str = "0"
    block_scope: str = "body"
    dry_run: bool = False


NODE = ["id", "path", "kind", "language", "qn", "signature", "start", "end", "content_hash"]


def built(spark: SparkSession, sources: DataFrame, graphs: list[build_files.Graph], config: Config) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one batch: files, declarations, imports, calls, blocks, and the merged build metadata."""
    nodes = [extract.file_nodes(sources, config.repo).select(*NODE)]
    file_id = lambda path: S.stable_id(F.lit(config.repo), path, F.lit("File"), path)
    edge = lambda rows, src, kind, dst: rows.select(src.alias("src"), F.lit(kind).alias("type"), dst.alias("dst"))
    if config.parser == "regex":
        decls = extract.regex_declarations(sources, config.repo)
        nodes.append(decls.select(*NODE))
        edges = [edge(decls, file_id(F.col("path")), "CONTAINS", F.col("id"))]
    else:
        rows = extract.scanned(sources)
        decls = extract.declarations(rows, config.repo)
        found = extract.imports(rows, config.repo)
        blocks = extract.blocks(rows, config.block_scope).join(decls.select(F.col("qn").alias("parent"), F.col("id").alias("parent_id"), "language"), "parent")
        block_id = S.stable_id(F.lit(config.repo), "path", F.lit("Block"), "qn")
        empty = S.content_id(F.lit(""), F.lit(""))
        nodes += [
            decls.select(*NODE),
            found.select("id", "path", F.lit("Import").alias("kind"), S.language_of("path").alias("language"), "qn", F.col("target").alias("signature"), "start", "end", S.content_id("target", F.lit("")).alias("content_hash")),
            blocks.select(block_id.alias("id"), "path", F.lit("Block").alias("kind"), "language", "qn", F.col("kind").alias("signature"), "start", "end", empty.alias("content_hash")),
        ]
        ids = decls.select("qn", "id")
        calls = extract.resolved_calls(rows, decls)
        calls = calls.join(ids.select(F.col("qn").alias("caller"), F.col("id").alias("a")), "caller").join(ids.select(F.col("qn").alias("callee"), F.col("id").alias("b")), "callee")
        edges = [
            edge(decls, file_id(F.col("path")), "CONTAINS", F.col("id")),
            edge(found, file_id(F.col("path")), "CONTAINS", F.col("id")),
            edge(found, file_id(F.col("path")), "IMPORTS", F.col("id")),
            edge(found.filter("file IS NOT NULL"), file_id(F.col("path")), "IMPORTS", file_id(F.col("file"))),
            edge(blocks, F.col("parent_id"), "CONTAINS", block_id),
            edge(calls, F.col("a"), "CALLS", F.col("b")),
        ]
    parts = {k: [r | {"writer": w} for w, g in enumerate(graphs) for r in g[k]] for k in ("components", "targets", "tests")}
    components = rig.merged_components(spark.createDataFrame(parts["components"], "id string, kind string, name string, path string, deps array<string>, writer int"))
    targets = rig.merged(spark.createDataFrame(parts["targets"], "id string, kind string, component_id string, writer int"))
    tests = rig.merged(spark.createDataFrame(parts["tests"], "id string, framework string, component_id string, writer int"))
    more, links = rig.materialized(components, targets, tests, config.repo)
    return reduce(DataFrame.unionByName, [*nodes, more.select(*NODE)]), reduce(DataFrame.union, [*edges, links])


def extractors(names: tuple[str, ...], external: str | None = None) -> list:
    """The named extractors of build metadata; without any, the default graph.  ``external`` is the command of the external one."""
    known = {
        "package-json": (lambda r: (r / "package.json").is_file(), build_files.package_json),
        "pyproject": (lambda r: (r / "pyproject.toml").is_file(), build_files.pyproject),
        "manual-yaml": (lambda r: (r / "rig.yaml").is_file(), lambda r: build_files.manual_yaml(r / "rig.yaml")),
        "external": (lambda r: external is not None and (r / "CMakeLists.txt").is_file(), lambda r: build_files.external(external, r)),
    }
    return [known[n] for n in names] or [(lambda r: True, lambda r: build_files.default_graph())]


BATCHES = "batch_id string, run string, repo string, source_path string, source_hash string, created_at string, node_count long, edge_count long, vector_count long, checksum string"
EVENTS = "batch_id string, to_status string, event_id long, at string"
#: ``ord`` of a batch's rows starts at this many times its number.
BATCH_ROWS = 1 << 46


def batches(spark: SparkSession, store: str) -> DataFrame:
    """The manifest: every batch with its status and, if it was committed, when."""
    tables = Store(spark, store)
    state = manifest.state(tables.appended("batch_events", EVENTS))
    return tables.appended("batch_manifest", BATCHES).join(state, "batch_id", "left")


def index(spark: SparkSession, source_root: str, store: str, config: Config, embedder=None, clock=None, batch_id: str | None = None, command: str | None = None) -> dict:
    """Indexes a repository and returns the manifest row.  A dry run does all but writing tables.

    An id that a batch had before is refused, as are vectors of another model, revision or length than the
    store's first ones; both leave the tables as they are.
    """
    clock = clock or (lambda: dt.datetime.now(dt.UTC).isoformat())
    tables, batch_id = Store(spark, store), batch_id or uuid.uuid4().hex
    before = tables.current()
    sources = files.walked(spark, source_root)
    graphs = build_files.dispatched(source_root, extractors(config.rig, command))
    first = before["batches"] * BATCH_ROWS
    staged = f"{tables.root}/staging/{uuid.uuid4().hex}"
    events = 0

    def event(status: str) -> str:
        nonlocal events
        at, events = clock(), events + 1
        tables.append("batch_events", spark.createDataFrame([(batch_id, status, events, at)], EVENTS))
        return at

    def kept(rows: DataFrame, name: str, *order: str) -> DataFrame:
        """The rows, written once in a fixed order, with the batch's columns and their places."""
        rows = rows.withColumns({"repo": F.lit(config.repo), "run": F.lit(batch_id)}).orderBy(*order).withColumn("ord", F.lit(first) + F.monotonically_increasing_id())
        rows.write.parquet(f"{staged}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{staged}/{name}")

    row = {"batch_id": batch_id, "run": batch_id, "repo": config.repo, "source_path": source_root, "created_at": clock(), "node_count": 0, "edge_count": 0, "vector_count": 0, "checksum": None}
    row["source_hash"] = S.folded_tree_hash(sources)
    manifest.recorded(tables.appended("batch_manifest", BATCHES).select("batch_id"), spark.createDataFrame([(batch_id,)], "batch_id string"))
    try:
        nodes, edges = built(spark, sources, graphs, config)
        new = {"nodes": kept(nodes, "nodes", "path", "start", "kind", "qn"), "edges": kept(edges, "edges", "src", "type", "dst")}
        texts = vectors.payloads(new["nodes"])
        made = models.embedded(texts, embedder) if embedder else texts.select("node_id", "payload_kind", S.hash_embedding("text", config.dim).alias("vector"), F.lit(config.model).alias("model"), F.lit(config.revision).alias("revision"))
        new["vectors"] = kept(made, "vectors", "node_id", "payload_kind")
        counts = {name: rows.count() for name, rows in new.items()}
        row |= {f"{name[:-1]}_count": n for name, n in counts.items()}
        row["checksum"] = spark.range(1).select(S.checksum(*(F.lit(v) for v in counts.values()))).first()[0]
        tables.append("batch_manifest", graph.validated(spark.createDataFrame([row], BATCHES), "batches"))
        event("pending")
    except Exception:
        tables.append("batch_manifest", spark.createDataFrame([row], BATCHES))
        event("pending")
        event("failed")
        tables.drop(staged)
        raise
    try:
        for name, rows in new.items():
            graph.validated(rows, name)
        identity = vectors.checked(new["vectors"], before["identity"])
        row |= {"status": "dry_run", "committed_at": None}
        if not config.dry_run:
            after = before | {"identity": identity, "batches": before["batches"] + 1}
            after = tables.merged(after, "nodes", new["nodes"], lambda a, b: graph.upsert_nodes(a, b).drop("turn"))
            after = tables.merged(after, "edges", new["edges"], lambda a, b: graph.upsert_edges(a, b).drop("turn"))
            after = tables.merged(after, "vectors", new["vectors"], vectors.upsert)
            tables.commit(before, after)
            row["status"] = "committed"
        at = event(row["status"])
        row["committed_at"] = at if row["status"] == "committed" else None
    except Exception:
        event("failed")
        raise
    finally:
        tables.drop(staged)
    return row | {"config": asdict(config)}
