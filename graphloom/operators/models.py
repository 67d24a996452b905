"""Embedders and rerankers behind one interface: by hash, by word overlap, over HTTP, with fallback, with a latency record."""

from __future__ import annotations

import hashlib
import json
import logging
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

from .vectors import EmbeddingCompatibilityError

log = logging.getLogger(__name__)


class AdapterUnavailableError(RuntimeError):
    """The service can't be reached, is too slow or breaks its contract."""


def hash_vector(text: str, dim: int) -> list[float]:
    return [int.from_bytes(hashlib.sha256(f"{text}\0{i}".encode()).digest()[:4], "big") / 0xFFFFFFFF * 2 - 1 for i in range(dim)]


@dataclass(frozen=True)
class HashEmbedder:
    dim: int = 1024
    model: str = "mock-embedder"
    revision: str = "0"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [hash_vector(t, self.dim) for t in texts]


def _post(url: str, body: dict, seconds: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return json.load(answer)
    except (OSError, ValueError, urllib.error.URLError) as e:
        raise AdapterUnavailableError(f"{url}: {e}") from e


@dataclass(frozen=True)
class HttpEmbedder:
    url: str
    model: str
    revision: str
    dim: int = 1024
    seconds: float = 30.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        """In order; no request for no texts; the answer's identity and shape are checked."""
        if not texts:
            return []
        found = _post(f"{self.url}/embed", {"inputs": texts, "model": self.model, "revision": self.revision}, self.seconds)
        if (found.get("model"), found.get("revision")) != (self.model, self.revision):
            raise EmbeddingCompatibilityError(f"{self.url} serves {found.get('model')}@{found.get('revision')}")
        if found.get("dimension", self.dim) != self.dim:
            raise EmbeddingCompatibilityError(f"{self.url} serves {found.get('dimension')} dimensions")
        vectors = found.get("vectors")
        if not isinstance(vectors, list) or len(vectors) != len(texts):
            raise AdapterUnavailableError(f"{self.url} answered with another number of vectors")
        if any(len(v) != self.dim for v in vectors):
            raise EmbeddingCompatibilityError(f"{self.url} answered with vectors of another length")
        return vectors


def identified(embedder, texts: list[str]) -> tuple[list[list[float]], str, str]:
    """The vectors, with the model and revision that made them: a fallback's are its own."""
    if hasattr(embedder, "identified"):
        return embedder.identified(texts)
    return embedder.embed(texts), embedder.model, embedder.revision


@dataclass(frozen=True)
class FallbackEmbedder:
    first: object
    second: object

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.identified(texts)[0]

    def identified(self, texts: list[str]) -> tuple[list[list[float]], str, str]:
        """Only an unavailable service is stood in for; other errors go on."""
        try:
            return identified(self.first, texts)
        except AdapterUnavailableError:
            return identified(self.second, texts)


class EncoderEmbedder:
    """An encoder of the sentence-transformers library, where that is installed, loaded once in each worker; vectors have length 1."""

    def __init__(self, model: str, revision: str, dim: int = 1024):
        if revision in ("", "0"):
            raise EmbeddingCompatibilityError("an encoder needs a fixed revision")
        self.model, self.revision, self.dim = model, revision, dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        encoder = _loaded("SentenceTransformer", self.model, self.revision)
        if encoder.get_sentence_embedding_dimension() != self.dim:
            raise EmbeddingCompatibilityError(f"{self.model} has {encoder.get_sentence_embedding_dimension()} dimensions")
        return [[float(x) for x in v] for v in encoder.encode(texts, normalize_embeddings=True)] if texts else []


@cache
def _loaded(kind: str, model: str, revision: str):
    try:
        import sentence_transformers
    except ImportError as e:
        raise AdapterUnavailableError("sentence-transformers is not installed") from e
    return getattr(sentence_transformers, kind)(model, revision=revision)


@dataclass(frozen=True)
class LatencyLogged:
    inner: object
    name: str = "embed"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._timed(self.inner.embed, texts)

    def identified(self, texts: list[str]) -> tuple[list[list[float]], str, str]:
        return self._timed(lambda t: identified(self.inner, t), texts)

    def rerank(self, query: str, texts: list[str], **options) -> list[float]:
        return self._timed(lambda t: self.inner.rerank(query, t, **options), texts)

    def _timed(self, call, texts: list):
        began = time.monotonic()
        try:
            out = call(texts)
        except Exception:
            log.warning("%s of %d failed after %.0f ms", self.name, len(texts), (time.monotonic() - began) * 1000)
            raise
        log.info("%s of %d took %.0f ms", self.name, len(texts), (time.monotonic() - began) * 1000)
        return out


def embedded(rows: DataFrame, embedder, batch: int = 64) -> DataFrame:
    """rows(node_id, payload_kind, text) with vectors and the model and revision that made them, a request for each batch, on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(0, len(part), batch):
                some = part.iloc[k : k + batch]
                vectors, model, revision = identified(embedder, some["text"].tolist())
                yield some[["node_id", "payload_kind"]].assign(vector=vectors, model=model, revision=revision)

    return rows.select("node_id", "payload_kind", "text").mapInPandas(run, "node_id string, payload_kind string, vector array<double>, model string, revision string")


@dataclass(frozen=True)
class JaccardReranker:
    def rerank(self, query: str, texts: list[str], seconds: float | None = None) -> list[float]:
        a = set(query.lower().split())
        return [len(a & b) / len(a | b) if a | b else 0.0 for b in (set(t.lower().split()) for t in texts)]


@dataclass(frozen=True)
class HttpReranker:
    url: str
    model: str
    revision: str
    seconds: float = 30.0

    def rerank(self, query: str, texts: list[str], seconds: float | None = None) -> list[float]:
        """Scores in order; ``seconds`` is this call's own limit."""
        if not texts:
            return []
        found = _post(f"{self.url}/rerank", {"query": query, "candidates": texts, "model": self.model, "revision": self.revision}, seconds or self.seconds)
        scores = found.get("scores")
        if (found.get("model"), found.get("revision")) != (self.model, self.revision) or not isinstance(scores, list) or len(scores) != len(texts):
            raise AdapterUnavailableError(f"{self.url} broke its contract")
        return [float(s) for s in scores]


class CrossEncoderReranker:
    """A cross-encoder of the sentence-transformers library, where that is installed."""

    def __init__(self, model: str, revision: str):
        self.model, self.revision = model, revision

    def rerank(self, query: str, texts: list[str], seconds: float | None = None) -> list[float]:
        return [float(x) for x in _loaded("CrossEncoder", self.model, self.revision).predict([(query, t) for t in texts])] if texts else []


@dataclass(frozen=True)
class FallbackReranker:
    first: object
    second: object

    def rerank(self, query: str, texts: list[str], seconds: float | None = None) -> list[float]:
        try:
            return self.first.rerank(query, texts, seconds=seconds)
        except AdapterUnavailableError:
            return self.second.rerank(query, texts, seconds=seconds)


def rerank_scores(rows: DataFrame, reranker, query: str, seconds: float | None = None) -> DataFrame:
    """rows(id, text, ...) of one query with rerank_score; a few dozen rows, so one task asks once.  No row goes, and none moves."""
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(rerank_score=reranker.rerank(query, part["text"].tolist(), seconds=seconds))

    return rows.coalesce(1).mapInPandas(run, schema)
