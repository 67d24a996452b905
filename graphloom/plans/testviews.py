"""Views that put the benchmark's relational tables into the engine's own shapes: graph, vectors, build metadata, events, code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

REPO = "r"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def nodes(self) -> DataFrame:
        """Nations are files, suppliers classes, customers functions, parts methods."""
        path = lambda key: F.concat(F.lit("src/n"), key.cast("string"), F.lit(".ts"))

        def rows(name: str, kind: str, nation, tail, signature, start, size: int, first: int, key: str) -> DataFrame:
            at = path(nation)
            qn = at if tail is None else F.concat(at, F.lit("::"), tail)
            return self.table(name).select(at.alias("path"), F.lit(kind).alias("kind"), qn.alias("qn"), signature.alias("signature"), start.cast("int").alias("start"), (start + size).cast("int").alias("end"), F.concat(F.lit("repo_"), (nation % 2).cast("string")).alias("repo"), F.concat(F.lit("run_"), (nation % 3).cast("string")).alias("run"), (F.col(key).cast("long") + first).alias("ord"))

        c = F.col
        parts = [
            rows("nation", "File", c("n_nationkey"), None, F.lit(""), F.lit(1), 9, 0, "n_nationkey"),
            rows("supplier", "Class", c("s_nationkey"), F.concat(F.lit("S"), c("s_suppkey").cast("string")), c("s_name"), 2 + c("s_suppkey") % 20, 5, 1_000_000, "s_suppkey"),
            rows("customer", "Function", c("c_nationkey"), F.concat(F.lit("c"), c("c_custkey").cast("string")), F.concat("c_name", F.lit("("), "c_mktsegment", F.lit(")")), 1 + c("c_custkey") % 30, 3, 10_000_000_000, "c_custkey"),
            rows("part", "Method", c("p_partkey") % 25, F.concat(F.lit("P.p"), c("p_partkey").cast("string")), c("p_name"), 3 + c("p_partkey") % 10, 2, 20_000_000_000, "p_partkey"),
        ]
        nodes = reduce(DataFrame.union, parts)
        return nodes.select(S.stable_id(F.lit(REPO), "path", "kind", "qn").alias("id"), F.lit("typescript").alias("language"), *nodes.columns)

    def edges(self) -> DataFrame:
        nodes = self.nodes().select("id", "path", "kind", "qn", "ord", "run")
        key = F.regexp_extract("qn", r"([0-9]+)(\.ts)?$", 1).cast("long")
        ids = lambda kind, name: nodes.filter(F.col("kind") == kind).select(key.alias(f"{name}_key"), F.col("id").alias(name))
        edge = lambda rows, kind, first: rows.select("src", F.lit(kind).alias("type"), "dst", (F.col("o").cast("long") + first).alias("ord"))
        files = nodes.filter("kind = 'File'").select("path", F.col("id").alias("src"))
        contains = nodes.filter("kind <> 'File'").select("path", F.col("id").alias("dst"), F.col("ord").alias("o")).join(files, "path")
        items = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        calls = items.join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        calls = calls.groupBy(F.col("o_custkey").alias("src_key"), F.col("l_partkey").alias("dst_key")).agg(F.min("l_orderkey").alias("o")).join(ids("Function", "src"), "src_key").join(ids("Method", "dst"), "dst_key")
        needs = items.groupBy(F.col("l_suppkey").alias("src_key"), F.col("l_partkey").alias("dst_key")).agg(F.min("l_orderkey").alias("o")).join(ids("Class", "src"), "src_key").join(ids("Method", "dst"), "dst_key")
        next_ = self.table("nation").select(F.col("n_nationkey").cast("long").alias("src_key"), ((F.col("n_nationkey") + 1) % 25).cast("long").alias("dst_key"), F.col("n_nationkey").alias("o"))
        imports = next_.join(ids("File", "src"), "src_key").join(ids("File", "dst"), "dst_key")
        return edge(contains, "CONTAINS", 0).union(edge(calls, "CALLS", 30_000_000_000)).union(edge(needs, "DEPENDS_ON", 40_000_000_000)).union(edge(imports, "IMPORTS", 50_000_000_000))

    def vectors(self) -> DataFrame:
        """Vector n belongs to customer n + 1's function; those without a customer belong to no node."""
        functions = self.nodes().filter("kind = 'Function'").select(F.regexp_extract("qn", r"([0-9]+)$", 1).cast("long").alias("key"), "id")
        rows = self.table("embeddings").withColumn("key", F.col("vec_id") + 1).join(functions, "key", "left")
        return rows.select(F.coalesce("id", F.concat(F.lit("none_"), F.col("key").cast("string"))).alias("node_id"), F.when(F.col("vec_id") % 3 == 0, "Block").otherwise("FunctionSummary").alias("payload_kind"), F.concat(F.lit("repo_"), F.col("label").cast("string")).alias("repo"), F.concat(F.lit("run_"), (F.col("vec_id") % 4).cast("string")).alias("run"), F.col("embedding").cast("array<double>").alias("vector"), F.col("vec_id").cast("long").alias("ord"))

    def files(self) -> DataFrame:
        """One file of code for each nation: an import, then a class for each supplier, then a function for each customer."""
        text = lambda key, template: F.replace(F.lit(template), F.lit("@"), key.cast("string"))
        classes = self.table("supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("ss"))
        functions = self.table("customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.array_sort(F.collect_list("c_custkey")).alias("cs"))
        rows = self.table("nation").select(F.col("n_nationkey").alias("n")).join(classes, "n", "left").join(functions, "n", "left")
        ss, cs = (F.coalesce(x, F.array().cast("array<bigint>")) for x in ("ss", "cs"))
        a = F.array_join(F.transform(ss, lambda k: text(k, "export class S@ {\n  run(a) {\n    return this.stop(a);\n  }\n  stop(a) {\n    return a;\n  }\n}\n")), "")
        first = F.get(cs, 0)
        b = F.array_join(F.transform(cs, lambda k: F.concat(text(k, "export function c@(a, b) {\n  return "), text(first, "c@(b, a);\n}\n"))), "")
        head = F.concat(F.lit('import { x } from "./n'), ((F.col("n") + 1) % 25).cast("string"), F.lit('.js";\n'))
        return rows.select(F.concat(F.lit("src/n"), F.col("n").cast("string"), F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), F.concat(head, a, b).alias("text"))

    def components(self) -> DataFrame:
        """Two writers: nations that need their region's first nations, and again all nations that need the next one (and one unknown)."""
        n = self.table("nation")
        name = lambda key: F.concat(F.lit("pkg:n"), key.cast("string"))
        one = n.select(name(F.col("n_nationkey")).alias("id"), F.lit("package").alias("kind"), F.col("n_name").alias("name"), F.concat(F.lit("p/"), F.col("n_nationkey").cast("string")).alias("path"), F.array(name(F.col("n_regionkey"))).alias("deps"), F.lit(0).alias("writer"))
        two = n.select(name(F.col("n_nationkey")).alias("id"), F.lit("app").alias("kind"), F.upper("n_name").alias("name"), F.lit("").alias("path"), F.array(name((F.col("n_nationkey") + 1) % 25), F.lit("pkg:none")).alias("deps"), F.lit(1).alias("writer"))
        return one.union(two)

    def targets(self) -> DataFrame:
        return self.table("supplier").select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "build").otherwise("run").alias("kind"), F.concat(F.lit("pkg:n"), (F.col("s_suppkey") % 30).cast("string")).alias("component_id"))

    def tests(self) -> DataFrame:
        return self.table("supplier").select(F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("pytest").alias("framework"), F.concat(F.lit("pkg:n"), (F.col("s_suppkey") % 27).cast("string")).alias("component_id"))

    def events(self) -> DataFrame:
        status = F.create_map(*(F.lit(x) for x in ("purchase", "committed", "error", "failed", "signup", "dry_run", "click", "pending")))
        return self.table("events").select(F.col("user_id").cast("string").alias("batch_id"), F.element_at(status, F.col("event_type")).alias("to_status"), "event_id", F.col("ts").alias("at"))
