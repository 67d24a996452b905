"""Property graph: nodes(id, path, kind, qn, ...; ord) and edges(src, type, dst; ord) as DataFrames.

``ord`` is a row's place in the order of insertion; every tie is broken by it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .lineage import checkpointed

# Fixed values.
NODE_KINDS = ("File", "Module", "Class", "Function", "Method", "Import", "Block", "RigComponent", "RigTarget", "RigTest")
EDGE_TYPES = ("CONTAINS", "CALLS", "IMPORTS", "IMPLEMENTS", "EXTENDS", "DEFINED_IN", "DEPENDS_ON", "DECLARED_BY")
PAYLOAD_KINDS = ("FunctionSummary", "Block", "Markdown")
COMPONENT_KINDS = ("package", "workspace", "app", "library", "binary")
TARGET_KINDS = ("build", "run", "publish")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The last row of each key, whole, at the place where the key came first.

    Both sides have ``ord``; new rows count as later than old ones.  One shuffle on the key.
    """
    rows = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    columns = [c for c in old.columns if c != "ord"]
    last = F.max_by(F.struct(*columns), F.struct("_turn", "ord")).alias("row")
    first = F.min(F.struct("_turn", "ord")).alias("at")
    return rows.groupBy(*key).agg(last, first).select("row.*", F.col("at.ord").alias("ord"), F.col("at._turn").alias("turn"))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    return upserted(old, new, ["id"])


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """With ``nodes``, edges without both end points are left out; else they stay."""
    out = upserted(old, new, ["src", "type", "dst"])
    for end in ("src", "dst") if nodes is not None else ():
        out = out.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return out


def list_nodes(nodes: DataFrame, kind: str = "", path_prefix: str = "", repo: str = "", run: str = "", limit: int = 0) -> DataFrame:
    """Nodes that meet all filters that are set (empty ones aren't), in order of insertion."""
    for column, value in (("kind", kind), ("repo", repo), ("run", run)):
        nodes = nodes.filter(F.col(column) == value) if value else nodes
    nodes = nodes.filter(F.col("path").startswith(path_prefix)) if path_prefix else nodes
    return nodes.orderBy("ord").limit(limit) if limit > 0 else nodes


def list_edges(edges: DataFrame, type_: str = "", repo: str = "", run: str = "", limit: int = 0) -> DataFrame:
    """An unknown type has no edges.  Where edges share an ``ord``, a limit takes them by src, type and dst, an edge's key."""
    for column, value in (("type", type_), ("repo", repo), ("run", run)):
        edges = edges.filter(F.col(column) == value) if value else edges
    return edges.orderBy("ord", "src", "type", "dst").limit(limit) if limit > 0 else edges


def get_node(nodes: DataFrame, id_: str | Column) -> DataFrame:
    return nodes.filter(F.col("id") == id_)


def find_by_name(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes whose qualified name is the name or ends with ``::`` and it."""
    return nodes.filter((F.col("qn") == name) | F.col("qn").endswith("::" + name))


def named(nodes: DataFrame, names: DataFrame, most: int = 20) -> DataFrame:
    """For each row of names(pos, name) the first ``most`` nodes of that name.

    A name meets the whole qualified name or one of its tails.  Tails are a column, so both are equi-joins;
    the names are one query's words, which are few.
    """
    keys = nodes.select("*", F.explode(F.array_distinct(F.array("qn", S.name_tail("qn")))).alias("_key"))
    found = keys.join(F.broadcast(names), keys["_key"] == names["name"]).dropDuplicates(["pos", "id"])
    rank = F.row_number().over(Window.partitionBy("pos").orderBy("ord"))
    return found.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_key", "_rank")


def sided(edges: DataFrame, direction: str, types: Iterable[str] = ()) -> DataFrame:
    """One row for each way that an edge may be walked: near, far and the edge.  The edges are read once; a loop is walked once."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction}")
    types = list(types)
    edges = edges.filter(F.col("type").isin(*types)) if types else edges
    edge = ["src", "type", "dst", F.col("ord").alias("edge_ord")]
    if direction != "both":
        near, far = ("src", "dst") if direction == "out" else ("dst", "src")
        return edges.select(F.col(near).alias("near"), F.col(far).alias("far"), *edge)
    way = lambda near, far: F.struct(F.col(near).alias("near"), F.col(far).alias("far"))
    ways = F.when(F.col("src") == F.col("dst"), F.array(way("src", "dst"))).otherwise(F.array(way("src", "dst"), way("dst", "src")))
    return edges.select(F.explode(ways).alias("_way"), *edge).select("_way.*", "src", "type", "dst", "edge_ord")


def neighbors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int = 1, types: Iterable[str] = (), direction: str = "both", limit: int = 0, cut=checkpointed, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Breadth-first search from seeds(id): the nodes reached, with their depth, and the edges seen.

    A layer is always completed; ``limit`` only stops the search once as many nodes besides the seeds are
    found.  End points without a node row are walked through and not returned; with ``strict`` they are
    neither, seeds included.  Each layer is one join of the frontier with the edges and one anti-join with what
    was reached; ``cut`` keeps a layer's results before the next one uses them, so that the plan does not
    double with the depth.
    """
    ways, ids = sided(edges, direction, types), nodes.select("id")
    reached = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    reached = reached.join(ids, "id", "left_semi") if strict else reached
    layers: list[DataFrame] = []
    for step in range(1, depth + 1):
        if step > 1:
            reached = cut(reached)
        frontier = reached.filter(F.col("depth") == step - 1).select(F.col("id").alias("near"))
        walked = ways.join(frontier, "near").select("far", "src", "type", "dst", "edge_ord")
        walked = walked.join(ids.withColumnRenamed("id", "far"), "far", "left_semi") if strict else walked
        walked = cut(walked) if step < depth else walked
        layers.append(walked.drop("far"))
        reached = reached.union(walked.select(F.col("far").alias("id")).distinct().join(reached, "id", "left_anti").withColumn("depth", F.lit(step)))
        if limit and reached.filter("depth > 0").join(ids, "id", "left_semi").limit(limit).count() >= limit:
            break
    seen = edges.limit(0).select("src", "type", "dst", F.col("ord").alias("edge_ord")) if not layers else reduce(DataFrame.union, layers).distinct()
    return nodes.join(reached, "id"), seen


def between(edges: DataFrame, nodes: DataFrame, types: Iterable[str] = ()) -> DataFrame:
    """Edges with both their nodes: src, type, dst and the nodes' names and kinds (src_qn, src_kind, dst_qn, dst_kind); edges without both are left out."""
    types = list(types)
    edges = edges.filter(F.col("type").isin(*types)) if types else edges
    side = lambda end: nodes.select(F.col("id").alias(end), F.col("qn").alias(f"{end}_qn"), F.col("kind").alias(f"{end}_kind"), F.col("path").alias(f"{end}_path"))
    return edges.select("src", "type", "dst").join(side("src"), "src").join(side("dst"), "dst")


def _related(edges: DataFrame, nodes: DataFrame, asked: DataFrame | None, type_: str, end: str) -> DataFrame:
    """Pairs of names over one type of edges; with asked(id), those whose ``end`` is asked for."""
    rows = edges.filter(F.col("type") == type_)
    rows = rows.join(asked.select(F.col("id").alias(end)).distinct(), end, "left_semi") if asked is not None else rows
    return between(rows, nodes)


def callers(edges: DataFrame, nodes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """caller and callee: what calls the asked nodes (without any, all calls)."""
    return _related(edges, nodes, asked, "CALLS", "dst").select(F.col("src_qn").alias("caller"), F.col("dst_qn").alias("callee"))


def callees(edges: DataFrame, nodes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """caller and callee: what the asked nodes call."""
    return _related(edges, nodes, asked, "CALLS", "src").select(F.col("src_qn").alias("caller"), F.col("dst_qn").alias("callee"))


def importers(edges: DataFrame, nodes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """importer and imported: what imports the asked nodes."""
    return _related(edges, nodes, asked, "IMPORTS", "dst").select(F.col("src_qn").alias("importer"), F.col("dst_qn").alias("imported"))


def dependents(edges: DataFrame, nodes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """dependent and dependency: what depends on the asked nodes."""
    return _related(edges, nodes, asked, "DEPENDS_ON", "dst").select(F.col("src_qn").alias("dependent"), F.col("dst_qn").alias("dependency"))


def contained(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The containment tree, a row for each node in another: path of the container, its name, and the name and kind of what it holds."""
    return between(edges, nodes, ["CONTAINS"]).select(F.col("src_path").alias("path"), F.col("src_qn").alias("container"), F.col("dst_qn").alias("qn"), F.col("dst_kind").alias("kind"))


def edge_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """How many edges of a type lead from one kind of node to another."""
    return between(edges, nodes).groupBy(F.col("src_kind").alias("a"), "type", F.col("dst_kind").alias("b")).agg(F.count("*").alias("n"))


def communities(members: DataFrame) -> DataFrame:
    """members(community, name, ord) to one title and description each: their number, and the first three names.

    The three are chosen before the shuffle (a ranking with a limit), so a large community is not gathered.
    """
    title = F.format_string("<community of %d nodes>", "n")
    n = members.groupBy("community").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy("ord", "name"))
    first = members.withColumn("_r", rank).filter("_r <= 3").groupBy("community").agg(F.array_sort(F.collect_list(F.struct("_r", "name"))).alias("_x"))
    return n.join(first, "community").select("community", title.alias("title"), F.concat_ws(" ", title, F.array_join("_x.name", ", ")).alias("description"))


def expand(base: DataFrame, edges: DataFrame, nodes: DataFrame, factor: float = 0.8) -> DataFrame:
    """Neighbours of the candidates base(node_id, score, pos) that aren't candidates, each from the first that reaches it."""
    ways = sided(edges, "both").join(F.broadcast(base.select(F.col("node_id").alias("near"), "score", "pos")), "near")
    ways = ways.join(F.broadcast(base.select(F.col("node_id").alias("far"))), "far", "left_anti")
    first = ways.groupBy("far").agg(F.min(F.struct("pos", "edge_ord", "score")).alias("x"))
    hit = first.join(nodes, first["far"] == nodes["id"])
    return hit.select("id", "path", "start", "end", F.greatest(F.lit(0.0), F.col("x.score") * factor).alias("score"), F.col("x.pos").alias("base_pos"), F.col("x.edge_ord").alias("edge_ord"))


_META = (("repo", "length(repo) = 0"), ("run", "length(run) = 0"))
#: A check for each name, true where a row breaks it; null counts as broken.
RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "nodes": (
        ("id", "NOT id RLIKE '^sym_[0-9a-f]{40}$'"),
        ("kind", f"kind NOT IN {NODE_KINDS}"),
        ("path", "length(path) = 0"),
        ("start", "start < 1"),
        ("evidence", "end < start"),
    ),
    "edges": (
        ("src", "NOT src RLIKE '^sym_[0-9a-f]{40}$'"),
        ("dst", "NOT dst RLIKE '^sym_[0-9a-f]{40}$'"),
        ("type", f"type NOT IN {EDGE_TYPES}"),
        *_META,
    ),
    "vectors": (
        ("node_id", "NOT node_id RLIKE '^sym_[0-9a-f]{40}$'"),
        ("payload_kind", f"payload_kind NOT IN {PAYLOAD_KINDS}"),
        ("model", "model IS NULL"),
        ("revision", "revision IS NULL"),
        ("vector", "size(vector) < 1 OR exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"),
        *_META,
    ),
    "batches": (
        ("batch_id", "batch_id IS NULL"),
        ("source_hash", "NOT source_hash RLIKE '^cnt_[0-9a-f]{40}$'"),
        ("counts", "node_count < 0 OR edge_count < 0 OR vector_count < 0"),
        ("created_at", "try_cast(created_at AS timestamp) IS NULL"),
    ),
    "components": (("id", "id IS NULL"), ("name", "name IS NULL"), ("kind", f"kind NOT IN {COMPONENT_KINDS}"), ("path", "path IS NULL")),
    "targets": (("id", "id IS NULL"), ("component_id", "component_id IS NULL"), ("kind", f"kind NOT IN {TARGET_KINDS}")),
    "tests": (("id", "id IS NULL"), ("component_id", "component_id IS NULL")),
}


def violations(rows: DataFrame, what: str = "nodes") -> DataFrame:
    """Rows that break a rule of their table, with the first rule broken."""
    broken = None
    for name, test in RULES[what]:
        test = F.coalesce(F.expr(test), F.lit(True))
        broken = F.when(test, name) if broken is None else broken.when(test, name)
    return rows.withColumn("rule", broken).filter(F.col("rule").isNotNull())


def validated(rows: DataFrame, what: str = "nodes") -> DataFrame:
    """The rows, or an error for the first bad one: nothing of a bad batch is written."""
    bad = violations(rows, what).limit(1).collect()
    if bad:
        raise ValueError(f"bad row of {what}, {bad[0][0]}: {bad[0]['rule']}")
    return rows


def export_nodes(nodes: DataFrame, repo: str = "", run: str = "") -> DataFrame:
    return list_nodes(nodes, repo=repo, run=run).orderBy("id")


def export_edges(edges: DataFrame, repo: str = "", run: str = "") -> DataFrame:
    return list_edges(edges, repo=repo, run=run).orderBy("src", "type", "dst")


def export_json(nodes: DataFrame, edges: DataFrame, folder: str, repo: str = "", run: str = "") -> dict:
    """Writes nodes and edges as JSON lines, sorted, to two folders, and returns their numbers."""
    export_nodes(nodes, repo, run).write.mode("overwrite").json(f"{folder}/nodes")
    export_edges(edges, repo, run).write.mode("overwrite").json(f"{folder}/edges")
    spark = nodes.sparkSession
    return {"format": "json", "nodeCount": spark.read.text(f"{folder}/nodes").count(), "edgeCount": spark.read.text(f"{folder}/edges").count()}


def export_document(nodes: DataFrame, edges: DataFrame, out, repo: str = "", run: str = "", format_: str = "json") -> None:
    """The export as one JSON document ``{format, nodeCount, edgeCount, nodes, edges}``, written to a text stream.

    Sorted rows come to the driver partition by partition, so no more than one of them is held.
    """
    parts = {"nodes": export_nodes(nodes, repo, run), "edges": export_edges(edges, repo, run)}
    out.write(f'{{"format": {json.dumps(format_)}, "nodeCount": {parts["nodes"].count()}, "edgeCount": {parts["edges"].count()}')
    for name, rows in parts.items():
        out.write(f', "{name}": [')
        for k, row in enumerate(rows.select(F.to_json(F.struct("*")).alias("x")).toLocalIterator()):
            out.write((", " if k else "") + row["x"])
        out.write("]")
    out.write("}\n")


def edge_attributes(json: str | Column) -> Column:
    """A JSON object's members that are strings, numbers or booleans, as a map of their texts; null if it is malformed."""
    value = F.from_json(json, "map<string,string>")
    return F.map_filter(value, lambda k, v: v.isNotNull() & ~v.rlike(r"^\s*[\[{]"))
