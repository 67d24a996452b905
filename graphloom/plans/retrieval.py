"""The retrieval query as one plan: exact names, nearest vectors, their neighbours, merge, rerank, snippets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, models, vectors as V
from ..operators.lineage import small
from ..sources import files as sources


# Fixed values.
@dataclass(frozen=True)
class Budget:
    """Tokens of the context: of the question, the architecture, the code, and what is kept back."""

    question: int = 1000
    architecture: int = 1000
    code: int = 5500
    reserve: int = 500

    @property
    def total(self) -> int:
        return self.question + self.architecture + self.code + self.reserve


@dataclass(frozen=True)
class Limits:
    exact: int = 20
    semantic: int = 30
    graph: int = 30
    rerank: int = 60
    final: int = 10
    budget: Budget = Budget()
    graph_factor: float = 0.8


def query_row(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "query string")


def names(query: DataFrame) -> DataFrame:
    """pos and name of each word of the query that could be a name; stop words are looked up like others."""
    return query.select(F.posexplode(S.identifiers("query")).alias("pos", "name"))


def exact(nodes: DataFrame, query: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return graph.named(nodes, names(query), limits.exact).select("id", "path", "start", "end", F.lit(1.0).alias("score"), F.col("pos").cast("long").alias("a"), F.col("ord").alias("b"))


def semantic(nodes: DataFrame, vectors: DataFrame, query_vector, limits: Limits = Limits(), **filters: str) -> DataFrame:
    """The nearest vectors whose node is known."""
    hits = V.search(vectors, query_vector, limits.semantic, **filters).select("node_id", "score", "ord")
    hits = hits.withColumn("a", F.row_number().over(Window.orderBy(F.desc("score"), "ord")).cast("long"))
    return F.broadcast(hits).join(nodes.drop("ord"), F.col("node_id") == F.col("id")).select("id", "path", "start", "end", "score", "a", F.lit(0).cast("long").alias("b"))


def base(nodes: DataFrame, vectors: DataFrame, query: DataFrame, query_vector, limits: Limits = Limits(), **filters: str) -> DataFrame:
    """Exact and semantic candidates in order (source 0 and 1).

    They are fetched at once: ``limits`` bound them to some dozen rows, all later steps use them several times,
    and the vectors are searched once.
    """
    return small(exact(nodes, query, limits).withColumn("source", F.lit(0)).union(semantic(nodes, vectors, query_vector, limits, **filters).withColumn("source", F.lit(1))))


def candidates(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, query: DataFrame, query_vector, limits: Limits = Limits(), **filters: str) -> DataFrame:
    first = base(nodes, vectors, query, query_vector, limits, **filters)
    ranked = first.withColumn("pos", F.row_number().over(Window.orderBy("source", "a", "b")).cast("long"))
    # Of a candidate that came twice the first one reaches its neighbours.
    near = graph.expand(ranked.groupBy(F.col("id").alias("node_id")).agg(F.min_by("score", "pos").alias("score"), F.min("pos").alias("pos")), edges, nodes, limits.graph_factor)
    return first.union(near.select("id", "path", "start", "end", "score", F.col("base_pos").alias("a"), F.col("edge_ord").alias("b"), F.lit(2).alias("source")))


def merged(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each node: its best score (the first on ties) at the place where the node came first; cut by place, not score."""
    order = F.struct("source", "a", "b")
    best = F.max_by(F.struct("path", "start", "end", "score", "source"), F.struct("score", -F.col("source"), -F.col("a"), -F.col("b")))
    one = rows.groupBy("id").agg(best.alias("x"), F.min(order).alias("place"))
    one = one.orderBy("place", "id").limit(limits.rerank).withColumn("pos", F.row_number().over(Window.orderBy("place", "id")).cast("long"))
    return one.select("id", "x.*", "pos")


def reranked(rows: DataFrame, score=None, limits: Limits = Limits()) -> DataFrame:
    """The best by rerank score (a column; else the score itself), earlier ones first on ties."""
    rows = rows.withColumn("rerank_score", F.col("score") if score is None else score)
    return rows.orderBy(F.desc("rerank_score"), "pos").limit(limits.final).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "pos")).cast("long"))


def rerank(rows: DataFrame, files: DataFrame, reranker, query: str, seconds: float | None = None) -> DataFrame:
    """The merged rows with the reranker's score of their lines of code (an empty text where a file is missing)."""
    texts = sources.read_ranges(small(rows), files.join(F.broadcast(rows.select("path").distinct()), "path", "left_semi"))
    return models.rerank_scores(texts, reranker, query, seconds).drop("text")


def snippets(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Each ranked node with its lines of its file (empty if the file is missing) and its citation; the few rows are fetched first, and the files read once."""
    rows = small(rows)
    text = files.join(F.broadcast(rows.select("path").distinct()), "path", "left_semi")
    out = rows.join(text.select("path", F.col("text").alias("_text")), "path", "left")
    return out.select("rank", "id", "path", "start", "end", S.line_range("_text", "start", "end").alias("text"), S.citation("path", "start", "end").alias("citation"), "rerank_score")


def retrieve(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, files: DataFrame, query: DataFrame, query_vector, limits: Limits = Limits(), reranker=None, seconds: float | None = None, **filters: str) -> DataFrame:
    """Ranked snippets, one row each.  Filters hold for the vector search alone.  Without a reranker the candidates' own scores count."""
    rows = merged(candidates(nodes, edges, vectors, query, query_vector, limits, **filters), limits)
    if reranker is None:
        return snippets(reranked(rows, limits=limits), files)
    rows = rerank(small(rows), files, reranker, query.first()[0], seconds)
    return snippets(reranked(rows, F.col("rerank_score"), limits), files)


def bundle(ranked: DataFrame, query: str, limits: Limits = Limits()) -> DataFrame:
    """The snippets as one row: query, snippets, citations and token budget (of which nothing is counted as used)."""
    items = F.array_sort(F.collect_list(F.struct("rank", "id", "path", "start", "end", "text", "citation")))
    row = ranked.agg(items.alias("x"))
    return row.select(F.lit(query).alias("query"), F.col("x").alias("snippets"), F.col("x.citation").alias("citations"), F.struct(F.lit(limits.budget.total).alias("total"), F.lit(0).alias("used")).alias("token_budget"))
