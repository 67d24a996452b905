"""Vector table: vectors(node_id, payload_kind, repo, run, vector; ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


class EmbeddingCompatibilityError(ValueError):
    """A row or query does not fit the table's embedding identity."""


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of (node_id, payload_kind) that come again are replaced; of new rows with one key the last stays."""
    key = ["node_id", "payload_kind"]
    columns = [c for c in new.columns if c not in key]
    last = new.groupBy(*key).agg(F.max_by(F.struct(*columns), "ord").alias("row")).select(*key, "row.*")
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def pinned(new: DataFrame, model: str, revision: str, dim: int) -> DataFrame:
    """new, or an error if a row has another model, revision or length than the table's first write fixed."""
    bad = new.filter((F.col("model") != model) | (F.col("revision") != revision) | (F.size("vector") != dim)).limit(1).collect()
    if bad:
        raise EmbeddingCompatibilityError(f"{bad[0]['node_id']} does not fit {model}@{revision} of {dim}")
    return new


def identity_of(new: DataFrame) -> dict | None:
    """What a first write fixes: the model, revision and length of its rows (one of each, or an error); None without rows."""
    first = new.select("model", "revision", F.size("vector").alias("dim")).limit(1).collect()
    if not first:
        return None
    pinned(new, *first[0])
    return first[0].asDict()


def checked(new: DataFrame, identity: dict | None) -> dict | None:
    """The table's identity, with new rows that fit it: the stored one, or that of a first write."""
    if identity is None:
        return identity_of(new)
    pinned(new, identity["model"], identity["revision"], identity["dim"])
    return identity


def filtered(vectors: DataFrame, repo: str = "", run: str = "", payload_kind: str = "") -> DataFrame:
    for column, value in (("repo", repo), ("run", run), ("payload_kind", payload_kind)):
        vectors = vectors.filter(F.col(column) == value) if value else vectors
    return vectors


def search(vectors: DataFrame, query: list[float] | object, k: int = 30, metric: str = "cosine", **filters: str) -> DataFrame:
    """The k best rows with their score; ties by order of insertion.  Filters run before scoring; the k best are kept per task first.

    A query of another length than the vectors is an error, not a comparison of their beginnings.
    """
    vectors = filtered(vectors, **filters)
    query = F.array(*(F.lit(float(x)) for x in query)) if isinstance(query, list) else query
    fits = F.size("vector") == F.size(query)
    said = F.concat(F.lit("EmbeddingCompatibilityError: a query of "), F.size(query).cast("string"), F.lit(" numbers against vectors of "), F.size("vector").cast("string"))
    score = S.cosine(F.col("vector"), query) if metric == "cosine" else S.distance_score(F.col("vector"), query, metric)
    score = F.when(fits, score).otherwise(F.raise_error(said).cast("double"))
    return vectors.withColumn("score", score).orderBy(F.desc("score"), "ord").limit(k)


def list_by_run(vectors: DataFrame, run: str, limit: int = 0, with_vector: bool = False) -> DataFrame:
    rows = filtered(vectors, run=run)
    rows = rows if with_vector else rows.drop("vector")
    return rows.orderBy("ord").limit(limit) if limit > 0 else rows


def count_by_run(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("run").count()


def payloads(nodes: DataFrame) -> DataFrame:
    """What is embedded of each node that can be."""
    kind = S.payload_kind("kind")
    return nodes.select(F.col("id").alias("node_id"), kind.alias("payload_kind"), S.payload_text("qn", "signature").alias("text")).filter(F.col("payload_kind").isNotNull())


def with_nodes(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vector rows with their nodes' names, paths and kinds; rows without a node are left out."""
    return vectors.join(nodes.select(F.col("id").alias("node_id"), "qn", "path", "kind"), "node_id")
