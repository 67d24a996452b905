"""Build metadata: components(id, kind, name, path, deps; writer), targets and tests, merged and put into the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def merged_components(components: DataFrame) -> DataFrame:
    """One row for each id: the first writer's fields, and all writers' dependencies, distinct and sorted."""
    fields = [c for c in components.columns if c not in ("id", "deps", "writer")]
    deps = F.array_sort(F.array_distinct(F.flatten(F.collect_list("deps"))))
    return components.groupBy("id").agg(F.min_by(F.struct(*fields), "writer").alias("x"), deps.alias("deps")).select("id", "x.*", "deps")


def merged(rows: DataFrame) -> DataFrame:
    """Targets or tests: the first writer of an id stands."""
    fields = [c for c in rows.columns if c not in ("id", "writer")]
    return rows.groupBy("id").agg(F.min_by(F.struct(*fields), "writer").alias("x")).select("id", "x.*")


def dependencies(components: DataFrame) -> DataFrame:
    """Pairs of components; names that are no component are left out."""
    pairs = components.select(F.col("id").alias("src"), F.explode("deps").alias("dst"))
    return pairs.join(components.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def children(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Targets or tests whose component is known."""
    return rows.join(components.select(F.col("id").alias("component_id")), "component_id", "left_semi")


def workspace_dependencies(packages: DataFrame) -> DataFrame:
    """packages(name, deps) with those of their dependencies that are members of the workspace, sorted."""
    pairs = packages.select("name", F.explode("deps").alias("dep"))
    inside = pairs.join(packages.select(F.col("name").alias("dep")), "dep", "left_semi")
    found = inside.groupBy("name").agg(F.array_sort(F.collect_set("dep")).alias("inside"))
    return packages.select("name").join(found, "name", "left").select("name", F.coalesce("inside", F.array().cast("array<string>")).alias("deps"))


def matched_folders(listing: DataFrame, patterns: list[str]) -> DataFrame:
    """Of a listing of folders (path) those that the patterns mean: a literal one, or the folders right below ``parent/*`` that don't start with a dot; other stars mean none."""
    hit = F.lit(False)
    for pattern in (p.rstrip("/") for p in patterns):
        parent = pattern[:-2]
        if pattern.endswith("/*") and "*" not in parent:
            below = F.substring("path", F.lit(len(parent) + 2), F.length("path"))
            hit = hit | (F.col("path").startswith(parent + "/") & ~below.contains("/") & (below != "") & ~below.startswith("."))
        elif "*" not in pattern:
            hit = hit | (F.col("path") == pattern)
    return listing.filter(hit).select("path").distinct()


#: What is read of a package file.
PACKAGE = "name string, scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"


def package_components(packages: DataFrame) -> DataFrame:
    """packages(path, text) of a workspace's members to components: those with a name, and their dependencies on one another."""
    rows = packages.withColumn("_p", F.from_json("text", PACKAGE)).filter("_p.name IS NOT NULL AND _p.name <> ''")
    keys = [F.coalesce(F.map_keys(F.col(f"_p.{c}")), F.array().cast("array<string>")) for c in ("dependencies", "devDependencies", "peerDependencies")]
    rows = rows.select("path", F.col("_p.name").alias("name"), F.array_distinct(F.concat(*keys)).alias("deps"))
    inside = workspace_dependencies(rows.select("name", "deps")).distinct()
    safe = F.transform("deps", lambda d: S.safe_id("pkg:", d))
    return rows.select("path", "name").join(inside, "name").select(S.safe_id("pkg:", "name").alias("id"), F.lit("package").alias("kind"), "name", "path", safe.alias("deps"))


def package_targets(packages: DataFrame, scripts: dict[str, str]) -> DataFrame:
    """A target for each script of a named package that stands for a kind."""
    kind = F.create_map(*(F.lit(x) for pair in scripts.items() for x in pair))
    rows = packages.withColumn("_p", F.from_json("text", PACKAGE)).filter("_p.name IS NOT NULL AND _p.name <> ''")
    rows = rows.select(S.safe_id("pkg:", F.col("_p.name")).alias("component_id"), F.explode(F.map_keys("_p.scripts")).alias("_s")).filter(F.col("_s").isin(*scripts))
    return rows.select(F.concat("component_id", F.lit(":"), "_s").alias("id"), F.element_at(kind, F.col("_s")).alias("kind"), "component_id")


def materialized(components: DataFrame, targets: DataFrame, tests: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a merged build graph."""
    where = lambda path: F.when(path == "", ".").otherwise(path)

    def nodes(rows: DataFrame, kind: str, path, body) -> DataFrame:
        return rows.select(S.stable_id(F.lit(repo), path, F.lit(kind), "id").alias("id"), path.alias("path"), F.lit(kind).alias("kind"), F.lit("unknown").alias("language"), F.col("id").alias("qn"), F.lit("").alias("signature"), F.lit(1).alias("start"), F.lit(1).alias("end"), S.content_id(F.lit(""), body).alias("content_hash"))

    known = components.select(F.col("id").alias("component_id"), where(F.col("path")).alias("at"))
    targets, tests = targets.join(known, "component_id"), tests.join(known, "component_id")
    part = nodes(components, "RigComponent", where(F.col("path")), F.concat_ws("|", "kind", "path", F.array_join(F.array_sort("deps"), ",")))
    part = part.union(nodes(targets, "RigTarget", F.col("at"), F.concat_ws("|", "kind", "component_id")))
    part = part.union(nodes(tests, "RigTest", F.col("at"), F.concat_ws("|", "framework", "component_id")))
    ids = components.select(F.col("id").alias("name"), S.stable_id(F.lit(repo), where(F.col("path")), F.lit("RigComponent"), "id").alias("node"))
    pairs = dependencies(components)
    edges = pairs.join(ids.select(F.col("name").alias("src"), F.col("node").alias("a")), "src").join(ids.select(F.col("name").alias("dst"), F.col("node").alias("b")), "dst").select(F.col("a").alias("src"), F.lit("DEPENDS_ON").alias("type"), F.col("b").alias("dst"))
    for rows, kind in ((targets, "RigTarget"), (tests, "RigTest")):
        own = rows.select(S.stable_id(F.lit(repo), "at", F.lit(kind), "id").alias("src"), F.lit("DECLARED_BY").alias("type"), F.col("component_id").alias("name"))
        edges = edges.union(own.join(ids, "name").select("src", "type", F.col("node").alias("dst")))
    return part, edges
