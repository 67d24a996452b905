"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, give each word a probability after the word before it.  Each order
takes a discount off its counts and deals what that spares by the order below (interpolated Kneser-Ney):

1. the pair of words, by the class's documents that have it,
2. the word, by the different words that it follows in the class (its continuations),
3. its longer and its shorter stem, by the different words that continue them in the class,
4. what the whole corpus has of the stem, and of the word among its stem's words: these counts are shared, so a
   rare expression that neither class knows has the same last factor in both.

A text's log-likelihood under either model is divided by its length; the differences - of the whole text, of
its most toxic passages and words - go through a logistic curve, which halves of the training rows fit on
models of the other halves.  Of a word outside the training rows the shared factors cancel exactly, so that
scoring needs only the counts of what the training rows have; the sums behind these cover the whole corpus.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, slices, stored, table, tidy

#: The class models and the curve are fitted on at most about this many labelled rows, chosen by a hash of their ids; texts are whole.
TRAINING_ROWS = 30_000
#: Taken off every count: singletons are left to the order below, as in modified Kneser-Ney.
DISCOUNT = 1.5
#: Bytes of the longer and the shorter stem, and the words of the passages looked at.
STEMS, PASSAGES = (7, 5), (1, 3, 12, 50)
#: A word's evidence beyond either counts as strong (log-likelihood ratio).
STRONG = (1.5, 3.0)
THRESHOLD = 0.7
#: Words or pairs that a task gathers before it writes them out, and words that a worker remembers.
GATHERED, REMEMBERED = 200_000, 100_000
FEATURES = 8 + len(PASSAGES)
#: Bytes of text that are scored together.
TOGETHER = 1 << 20

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: In place of the word before the first one.
START = b""


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def keys_of(words: Iterable[bytes]) -> np.ndarray:
    return np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = before * np.uint64(0x9E3779B97F4A7C15) + word
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


@tidy
def _training_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many training documents of each class and half have a pair of words."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(counts)
        columns = {"before": keys_of(k[2] for k in keys).view(np.int64), "word": keys_of(k[3] for k in keys).view(np.int64)}
        return pa.record_batch({**{k: pa.array(v) for k, v in columns.items()}, "toxic": pa.array([k[0] for k in keys], pa.int32()), "half": pa.array([k[1] for k in keys], pa.int32()), "n": pa.array(list(counts.values()), pa.int32())})

    for batch in slices(batches):
        for toxic, half, text in zip(*(batch.column(c).to_pylist() for c in ("toxic", "half", "text")), strict=True):
            words = words_of(text)
            counts.update((toxic, half, v, w) for v, w in set(zip([START, *words], words, strict=False)))
            if len(counts) > GATHERED:
                yield out()
                counts.clear()
    yield out()


@tidy
def _corpus_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents have a word; written out whenever a worker holds many, and summed after the shuffle."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        stems = {f"stem{size}": keys_of(w[:size] for w in counts).view(np.int64) for size in STEMS}
        return pa.record_batch({"word": pa.array(keys_of(counts).view(np.int64)), **{k: pa.array(v) for k, v in stems.items()}, "n": pa.array(list(counts.values()), pa.int64())})

    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            counts.update(set(words_of(text)))
            if len(counts) > GATHERED:
                yield out()
                counts.clear()
    yield out()


def _looked_up(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the asked ones are among sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Model:
    """Log-likelihood ratios (toxic to ordinary): sorted keys with a column of values, or one for each of several models.

    words: without context.  stems: of the longer and the shorter stem, for words that aren't there.  contexts: what
    the discount leaves of a first word's pairs.  pairs: of pairs with a count of 2 or more.  rest: what the
    shorter stems, the longer ones and the words spare for unknown ones.
    """

    def __init__(self, words, stems, contexts, pairs, rest):
        self.words, self.stems, self.contexts, self.pairs, self.rest = words, stems, contexts, pairs, rest

    def only(self, k: int) -> Model:
        """One of several models: the same keys, its own values."""
        pick = lambda table: (table[0], np.ascontiguousarray(table[1][:, k]))
        return Model(pick(self.words), [pick(x) for x in self.stems], pick(self.contexts), pick(self.pairs), self.rest[k])

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words their keys, their ratios without context, and what their pairs' discounts leave as contexts."""
        keys = keys_of(words)
        out, known = np.full(len(words), sum(self.rest)), np.zeros(len(words), bool)
        for k, size in enumerate(STEMS):  # the longer stem first
            at, hit = _looked_up(self.stems[k][0], keys_of(w[:size] for w in words))
            hit &= ~known
            out[hit] = self.stems[k][1][at[hit]] + sum(self.rest[len(STEMS) - k :])
            known |= hit
        at, hit = _looked_up(self.words[0], keys)
        out[hit] = self.words[1][at[hit]]
        at, hit = _looked_up(self.contexts[0], keys)
        backoff = np.zeros(len(words))
        backoff[hit] = self.contexts[1][at[hit]]
        return keys, out, backoff

    def after(self, before: np.ndarray, backoff: np.ndarray, keys: np.ndarray, ratio: np.ndarray) -> np.ndarray:
        """The words' ratios after the words before them."""
        at, hit = _looked_up(self.pairs[0], pair_keys(before, keys))
        out = ratio + backoff
        out[hit] = self.pairs[1][at[hit]]
        return out


class Scorer:
    """A model with the words that a worker has met."""

    def __init__(self, model: Model):
        self.model, self.index = model, {}
        self.clear()

    def clear(self) -> None:
        self.index.clear()
        self.keys, self.ratio, self.backoff = self.model.of([START])
        self.index[START] = 0

    def features(self, texts: list[str]) -> list[list[float]]:
        """Of each text the length-normalised differences of its log-likelihoods: with and without context, of the most
        toxic passage of each length (shorter texts are padded), of its most toxic words, and the strong evidence per word."""
        if len(self.index) > REMEMBERED:
            self.clear()
        tokens = [words_of(t) for t in texts]
        new = list({w for words in tokens for w in words} - self.index.keys())
        if new:
            self.index.update(zip(new, range(len(self.keys), len(self.keys) + len(new)), strict=True))
            more = self.model.of(new)
            self.keys, self.ratio, self.backoff = (np.concatenate(x) for x in zip((self.keys, self.ratio, self.backoff), more, strict=True))
        out = []
        for words in tokens:
            if not words:
                out.append([0.0] * FEATURES)
                continue
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            before = np.concatenate(([0], at[:-1]))
            values = self.ratio[at]
            context = self.model.after(self.keys[before], self.backoff[before], self.keys[at], values)
            total = np.concatenate(([0.0], np.cumsum(values), np.full(max(PASSAGES), values.sum())))
            best = [float((total[size:] - total[:-size]).max()) / size for size in PASSAGES]
            top = np.append(np.sort(self.ratio[np.unique(at)])[: -6 : -1], np.zeros(5))
            strong = [float(np.maximum(values - x, 0).sum()) / len(words) for x in STRONG]
            out.append([float(context.mean()), float(values.mean()), float(values.sum()) / math.sqrt(len(words)), *best, float(top[1]), float(top[2]), float(top[:5].mean()), *strong])
        return out


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve over the columns of x and a constant (Newton's method with halved steps and a ridge)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (a @ w)).sum() + (penalty * w * w).sum() / 2
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w += size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def _features(token: str, sent):
    """Features by a list of models that was sent; each row names its model."""

    def found(texts: pa.Array, which: pa.Array) -> pa.Array:
        scorers = held(("toxicity", token), lambda: [Scorer(m) for m in sent.value])
        rows: list = []
        for part in slices([pa.record_batch({"text": texts, "which": which})], "text", TOGETHER):
            some, model = [x or "" for x in part.column("text").to_pylist()], part.column("which").to_pylist()
            out: list = [None] * len(some)
            for k, scorer in enumerate(scorers):
                mine = [i for i, m in enumerate(model) if m == k]
                for i, f in zip(mine, scorer.features([some[i] for i in mine]), strict=True):
                    out[i] = f
            rows += out
        return pa.array(rows, pa.list_(pa.float64()))

    return found


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


#: The models: fitted on the second half, on the first, and on both; of each the halves that count.
HALVES = ((1,), (0,), (0, 1))
_EACH = [(m, c) for m in range(len(HALVES)) for c in (0, 1)]


def _kept(x: Column) -> Column:
    return F.greatest(x - F.lit(DISCOUNT), F.lit(0.0))


class _Order:
    """An order without context, of rows with counts l{m}{c}: by model and class their sum, and the share that the discount spares."""

    def __init__(self, rows: DataFrame):
        some = rows.agg(*(F.sum(f"l{m}{c}").alias(f"s{m}{c}") for m, c in _EACH), *(F.sum(F.least(F.col(f"l{m}{c}"), F.lit(DISCOUNT))).alias(f"d{m}{c}") for m, c in _EACH)).first()
        self.sums = {k: max(float(some[f"s{k[0]}{k[1]}"] or 0), 1.0) for k in _EACH}
        self.spare = {k: max(float(some[f"d{k[0]}{k[1]}"] or 0) / self.sums[k], 1e-6) for k in _EACH}
        self.rest = [math.log(self.spare[m, 1] / self.spare[m, 0]) for m in range(len(HALVES))]

    def dealt(self, lower, part: Column) -> list[Column]:
        """Each row's probabilities p{m}{c}: its own, and its part of the order below (of ``lower(m, c)``)."""
        return [(_kept(F.col(f"l{m}{c}")) / self.sums[m, c] + self.spare[m, c] * lower(m, c) * part).alias(f"p{m}{c}") for m, c in _EACH]


def _ratios(name: str = "p") -> list[Column]:
    return [F.ln(F.col(f"{name}{m}1") / F.col(f"{name}{m}0")).cast("float").alias(f"r{m}") for m in range(len(HALVES))]


def _sorted(rows: DataFrame, *keys: str) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table on the driver: its keys in order and a column for each model."""
    found = rows.select(*keys, *(f"r{m}" for m in range(len(HALVES)))).toArrow()
    each = [found.column(k).to_numpy().view(np.uint64) for k in keys]
    key = each[0] if len(keys) == 1 else pair_keys(*each)
    order = np.argsort(key)
    return key[order], np.column_stack([found.column(f"r{m}").to_numpy()[order] for m in range(len(HALVES))])


def _models(train: DataFrame, corpus: DataFrame) -> Model:
    """The three models of train(toxic, half, text) and corpus(text).

    Counts, probabilities and ratios are tables; what leaves the executors is a key and three numbers for
    each word, stem and repeated pair of the training rows, which bound it.
    """
    pairs = train.select("toxic", "half", "text").mapInArrow(_training_pairs, "before long, word long, toxic int, half int, n int")
    pairs = stored(pairs.groupBy("before", "word").agg(*(F.sum(F.when((F.col("toxic") == c) & (F.col("half") == h), F.col("n")).otherwise(0)).cast("int").alias(f"n{c}{h}") for c in (0, 1) for h in (0, 1))))
    count = {(m, c): sum((F.col(f"n{c}{h}") for h in HALVES[m]), F.lit(0)) for m, c in _EACH}
    shared = stored(corpus.select("text").mapInArrow(_corpus_words, f"word long, {', '.join(f'stem{s} long' for s in STEMS)}, n long").groupBy("word", *(f"stem{s}" for s in STEMS)).agg(F.sum("n").alias("n")))
    total = float(shared.agg(F.sum("n")).first()[0] or 1)
    words = pairs.groupBy("word").agg(*(F.sum((count[k] > 0).cast("int")).cast("int").alias(f"l{k[0]}{k[1]}") for k in _EACH)).join(shared, "word")
    words = stored(words)
    stems, orders, below, above = {}, [], None, F.lit(total)
    for size, longer in ((STEMS[1], False), (STEMS[0], True)):  # the shorter stem first
        stem, n = f"stem{size}", f"n{size}"
        here = words.groupBy(stem, *([f"stem{STEMS[1]}"] if longer else [])).agg(*(F.sum((F.col(f"l{m}{c}") > 0).cast("int")).alias(f"l{m}{c}") for m, c in _EACH))
        here = stored(here.join(shared.groupBy(stem).agg(F.sum("n").alias(n)), stem))
        orders.append(order := _Order(here))
        if below is not None:
            here = here.join(below, f"stem{STEMS[1]}")
        lower = (lambda m, c: F.col(f"q{m}{c}")) if below is not None else (lambda m, c: F.lit(1.0))
        stems[size] = stored(here.select(stem, n, *order.dealt(lower, F.col(n) / above)))
        below = stems[size].select(stem, n, *(F.col(f"p{m}{c}").alias(f"q{m}{c}") for m, c in _EACH))
        above = F.col(n)
    orders.append(order := _Order(words))
    words = stored(words.join(below, f"stem{STEMS[0]}").select("word", *order.dealt(lambda m, c: F.col(f"q{m}{c}"), F.col("n") / above)))
    contexts = pairs.groupBy("before").agg(*(F.sum(count[k]).alias(f"s{k[0]}{k[1]}") for k in _EACH), *(F.sum(F.least(count[k], F.lit(DISCOUNT))).alias(f"d{k[0]}{k[1]}") for k in _EACH))
    gamma = lambda m, c: F.when(F.col(f"s{m}{c}") > 0, F.greatest(F.col(f"d{m}{c}") / F.col(f"s{m}{c}"), F.lit(1e-6))).otherwise(F.lit(1.0)).alias(f"g{m}{c}")
    contexts = stored(contexts.select("before", *(F.greatest(F.col(f"s{m}{c}"), F.lit(1)).alias(f"s{m}{c}") for m, c in _EACH), *(gamma(m, c) for m, c in _EACH)))
    many = pairs.filter("n00 + n01 > 1 OR n10 + n11 > 1").join(contexts, "before").join(words, "word")
    many = many.select("before", "word", *((_kept(count[m, c]) / F.col(f"s{m}{c}") + F.col(f"g{m}{c}") * F.col(f"p{m}{c}")).alias(f"b{m}{c}") for m, c in _EACH))
    return Model(
        _sorted(words.select("word", *_ratios()), "word"),
        [_sorted(stems[s].select(f"stem{s}", *_ratios()), f"stem{s}") for s in STEMS],
        _sorted(contexts.select("before", *_ratios("g")), "before"),
        _sorted(many.select("before", "word", *_ratios("b")), "before", "word"),
        [[o.rest[m] for o in orders] for m in range(len(HALVES))],
    )


def scored(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, rows: int = TRAINING_ROWS) -> DataFrame:
    """docs with ``held_out``, ``score`` and ``predicted``; ``corpus`` (else docs) is what the shared counts are taken from.

    Training rows are the labelled documents that are not held out; beyond ``rows`` a hash of the id
    chooses.  That bounds the models, which are broadcast.  The shared counts cover every document of the
    corpus and are joined with the training words before they leave the executors.  Null and empty texts
    get the curve's value for no evidence; texts with equal words get equal scores; repeated rows each give a
    row; a row without an id is not held out and has no label; contradicting labels of a document count as
    toxic; labels without an id or a value are left out; without toxic and ordinary training rows every score
    is 0.  Columns of docs that are named like the result's are replaced, others stay.
    """
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    return _scored(docs.select(F.struct(*names).alias("_row")), labels, corpus, rows).select("_row.*", "held_out", "score", "predicted")


def _scored(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None, rows: int = TRAINING_ROWS) -> DataFrame:
    """scored() of docs(_row), each row a structure, so that a text goes through the plan once."""
    spark, doc_id, text = docs.sparkSession, F.col("_row.doc_id"), F.col("_row.text")
    corpus = docs.select(doc_id.alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")) if corpus is None else corpus.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * rows / n))
    # The training rows are at most about ``rows``, so their texts are kept.
    train = stored(corpus.join(F.broadcast(known), "doc_id").select("toxic", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int").alias("half"), "text"))
    models = _models(train, corpus)
    sent = spark.sparkContext.broadcast([models.only(0), models.only(1)])
    # The half that a model is fitted on is not the one that it scores for the curve.
    sample = train.select("toxic", F.arrow_udf(_features(uuid.uuid4().hex, sent), "array<double>")("text", "half").alias("f")).collect()
    sent.destroy()
    y = np.array([r["toxic"] for r in sample], float)
    curve = fitted(np.array([r["f"] for r in sample]), y) if 0 < y.sum() < len(y) else None
    if curve is None:
        return docs.select("_row", held_out(doc_id).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = spark.sparkContext.broadcast([models.only(len(HALVES) - 1)])
    del models, sample
    out = docs.select("_row", F.arrow_udf(_features(uuid.uuid4().hex, sent), "array<double>")(text, F.lit(0)).alias("_f"))
    z = sum((F.get("_f", k) * float(w) for k, w in enumerate(curve[:-1])), F.lit(float(curve[-1])))
    out = out.select("_row", held_out(doc_id).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted to be toxic, with their own columns."""
    return _scored(docs.select(F.struct(*docs.columns).alias("_row")), labels, None).filter("predicted = 0").select("_row.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
