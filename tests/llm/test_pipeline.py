"""The pipeline against its stages' plain versions, and what the entry module offers."""

import hashlib
import math
import random
import zlib

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from graphloom.llm import ngram_join, secrets, toxicity

from . import brute

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    toxic = {r["doc_id"]: r["predicted"] for r in toxicity.op7_toxicity(spark, DATA).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if not toxic[r["doc_id"]]]
    rows = [(d, t) for (d, t), (_, _, group) in zip(rows, brute.ngram_join(rows), strict=True) if d == group]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(d, t) for (d, t), hit in zip(rows, brute.decontaminate(rows, items), strict=True) if not hit[-1]]
    cleaned = {d: brute.redacted(t or "", secrets.KINDS, secrets.weak_spans) for d, t in rows}
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in cleaned.items()}


def test_toxicity_stage_against_plain(spark):
    """The first stage takes out what plain models of both classes, from dictionaries, tell apart."""
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(240):
        words = [rng.choice("the of and that with from on at".split()) for _ in range(rng.randint(4, 20))]
        if k % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(("vileone", "vileword", "scum"))
        rows.append((k, " ".join(words)))
        labels.append((k, int(k % 4 == 0)))
    train = [(x, t) for (d, t), (_, x) in zip(rows, labels, strict=True) if zlib.crc32(str(d).encode()) % 3 != 1]
    plain = [brute.KneserNey([t for x, t in train if x == c], [t for _, t in rows], toxicity.words_of) for c in (0, 1)]
    best = lambda t: max(math.log(plain[1].word(w) / plain[0].word(w)) for w in toxicity.words_of(t))
    line = sorted(best(t) for x, t in train if x)[2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in toxicity.clean(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert kept == {d for d, t in rows if best(t) < line} == {d for d, _ in rows if d % 4}


def test_stages_with_odd_rows(spark, tmp_path):
    """Null and empty texts, repeated rows, null ids, a long text and clashing columns go through every stage; so does an empty table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = [(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "same words for two rows", "en", "s", 0), (9003, "same words for two rows", "en", "s", 0), (None, "same words for two rows", "en", "s", 0), (9004, "long " * 100_000, "en", "s", 0)]
    rows = docs.union(spark.createDataFrame(odd, docs.schema)).withColumn("score", F.lit("x")).withColumn("found", F.lit(1)).withColumn("_f", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, DATA)
        got = [(r["doc_id"], r["text"]) for r in rows.filter("doc_id > 9000 OR doc_id IS NULL").collect()]
        assert sorted(d for d, _ in got if d) == [9001, 9002, 9003, 9003, 9004] and len(got) == 6, name
        assert rows.columns[-3:] == ["score", "found", "_f"]
    last = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, rows, DATA).collect()}
    assert last[9001]["n_tokens"] == last[9002]["n_tokens"] == 0 and last[9004]["n_tokens"] > 100_000
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, DATA)
    assert none.count() == 0


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5 and ngram_join.SHINGLE == 5


def test_entry():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
