"""N-gram Jaccard join: near-duplicate groups by an exact set-similarity join on word shingles, verified in a prefix tree.

1. Every document's shingles are hashed, and the least hashes - a number that grows with the set - are
   dealt to buckets.  A set that has a partner shares at least ``kept`` of those with it (all but
   ``n - ceil(3n/4)`` shingles are common), so a document with fewer hashes that occur elsewhere is done.
2. The others are reduced to one representative for each set.  Their shingles' counts give the global
   order, rarest first; of the prefix that a partner must meet (``n - ceil(3n/4) + 1`` shingles), those
   that occur twice join the documents to blocks (connected components of shared prefix shingles).
3. In a block the sets are stored in a prefix tree, their shingles in the global order, the most frequent first;
   shingles that no other set has count for a set's size but are on no path.  All sets are joined with the tree
   of the earlier ones at once, node by node: paths share their overlap, and a set leaves a subtree as soon as the
   remaining lengths can't reach the similarity, or when all the subtree's sets are linked with it already.
   The sets of a block beyond ``BLOCK`` go to a tree for each of the hubs of their shared prefix shingles instead
   (a shingle's hub is its least document, so that near copies meet in one tree and not in one for each shingle), or
   for each shingle where that compares fewer pairs; those of a tree that still has more than ``BLOCK`` go to pairs
   of parts, each pair a task.
4. Links make components; all documents with the same set share their representative's.

Counting in steps 1 and 2 combines within each task first: a hash that two documents of a task have
leaves it once, so a hash that a third of all documents have reaches its bucket once per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table, texts, tidy, workers
from .hashing import Prefixes, mixed

SHINGLE, SIMILAR = 5, 75
#: Sets that one prefix tree holds at most, and hashes that a task gathers before it writes them out.
BLOCK, GATHERED = 6_000, 1_500_000
#: Parts in which the rows of one key are joined, where a key may be a hub.
SALTS = 8

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(texts_: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles (words joined by a space, A-Z lower-cased)."""
    words = [t.encode("utf-8", "surrogatepass").translate(_FOLD).split() for t in texts_]
    lines = [b" ".join(w) for w in words]
    data = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
    sums = Prefixes(data)
    space = np.flatnonzero(data == 32)
    out, at, first = [], 0, 0
    for w, line in zip(words, lines, strict=True):
        n = len(w)
        if not n:
            out.append(np.zeros(0, np.uint64))
            at, first = at + 1, first + 1
            continue
        ends = space[first : first + n]
        starts = np.concatenate(([at], ends[:-1] + 1))
        k = min(size, n)
        out.append(np.unique(sums.of(starts[: n - k + 1], ends[k - 1 :])))
        at, first = at + len(line) + 1, first + n
    return out


def needed(n: int) -> int:
    """The least number of common shingles with any partner of a set of n."""
    return -(-SIMILAR * n // 100)


def kept(n: int) -> int:
    return -(-n // 8)


ROWS = "bucket int, task long, tokens binary, docs binary, doc_id long, n long, f1 long, f2 long, seen long, least long"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("task", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary()), *((c, pa.int64()) for c in ("doc_id", "n", "f1", "f2", "seen", "least"))])


def _dealt(buckets: int):
    """Rows of two kinds: a bucket's tokens with the documents (numbered in the task) that have them, and a document's own row."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, group, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in slices(batches):
            for doc, hashes in zip(batch.column("doc_id").to_pylist(), shingle_hashes(batch.column("text").to_pylist()), strict=True):
                n = len(hashes)
                group.append((doc, n, hashes[: n - needed(n) + kept(n)], *_fingerprint(hashes)))
                size += len(group[-1][2]) + 8
            if size > GATHERED:
                yield from _group_rows(task, group, buckets)
                task, group, size = task + (1 << 20), [], 0
        if group:
            yield from _group_rows(task, group, buckets)

    return run


def _fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    a = int(np.add.reduce(mixed(hashes))) if len(hashes) else 0
    b = int(np.bitwise_xor.reduce(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)))) if len(hashes) else 0
    return tuple(x - (1 << 64) if x >> 63 else x for x in (a, b))


def _group_rows(task: int, group: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    tokens = np.concatenate([g[2] for g in group])
    docs = np.repeat(np.arange(len(group), dtype=np.uint32), [len(g[2]) for g in group])
    bucket, tokens, docs, seen = combined(tokens, docs, len(group), buckets)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    last = np.append(first[1:], len(bucket))[: len(first)]
    b = bucket[first]
    yield pa.record_batch([pa.array(b, pa.int32()), pa.array(np.full(len(b), task), pa.int64()), pa.array([tokens[i:j].tobytes() for i, j in zip(first, last, strict=True)], pa.binary()), pa.array([docs[i:j].tobytes() for i, j in zip(first, last, strict=True)], pa.binary()), *(pa.nulls(len(b), pa.int64()),) * 6], _SCHEMA)
    k = len(group)
    column = lambda i: pa.array([g[i] for g in group], pa.int64())
    yield pa.record_batch([pa.array((task + np.arange(k)) * 2654435761 % buckets, pa.int32()), pa.array(task + np.arange(k), pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), column(0), column(1), column(3), column(4), pa.array(seen, pa.int64()), pa.array([kept(g[1]) for g in group], pa.int64())], _SCHEMA)


#: In place of a document: the token's documents know already that others have it.
MANY = np.uint32(0xFFFFFFFF)


def combined(tokens: np.ndarray, docs: np.ndarray, n_docs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each token once, by bucket, as its last 48 bits in three 16-bit numbers; its document or MANY; and how many of each document's tokens others have."""
    order = np.argsort(tokens, kind="stable")
    tokens, docs = tokens[order], docs[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, bool))
    count = np.diff(np.append(first, len(tokens)))
    seen = np.bincount(docs[np.repeat(count > 1, count)], minlength=n_docs)
    docs = np.where(count > 1, MANY, docs[first]).astype(np.uint32)
    tokens = tokens[first]
    bucket = (tokens % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    short = (tokens[order] // np.uint64(buckets)).astype("<u8").view(np.uint16).reshape(-1, 4)[:, :3]
    return bucket[order], np.ascontiguousarray(short), docs[order], seen


#: A document's own row, and how many of its tokens were met elsewhere.
OWN = np.dtype([("key", "<i8"), ("doc", "<i8"), ("has", "u1"), ("n", "<i8"), ("f1", "<i8"), ("f2", "<i8"), ("seen", "<i8"), ("least", "<i8")])
MET = np.dtype([("key", "<i8"), ("count", "<i4")])


def _target(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _by_target(records: np.ndarray, target: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(target, kind="stable")
    records, target = records[order], target[order]
    first = np.flatnonzero(np.diff(target, prepend=-1))
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(target)], strict=False):
        yield int(target[i]), records[i:j].tobytes()


def _met(buckets: int):
    """The documents' own rows, and how many of each one's tokens another task or document has as well, packed by document."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, who, owns = [], [], []
        for batch in batches:
            own = batch.filter(pa.compute.is_null(batch.column("tokens")))
            if own.num_rows:
                rows = np.zeros(own.num_rows, OWN)
                for name, column in zip(OWN.names, ("task", "doc_id", "", "n", "f1", "f2", "seen", "least"), strict=True):
                    rows[name] = own.column(column).fill_null(0).to_numpy() if column else own.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                owns.append(rows)
            for bucket, task, tokens, docs in zip(*(batch.column(c).to_pylist() for c in ("bucket", "task", "tokens", "docs")), strict=True):
                if tokens is not None:
                    short = np.zeros((len(docs) // 4, 4), np.uint16)
                    short[:, :3] = np.frombuffer(tokens, np.uint16).reshape(-1, 3)
                    keys.append(np.column_stack((short.view(np.uint64).reshape(-1), np.full(len(short), bucket, np.uint64))))
                    docs = np.frombuffer(docs, np.uint32)
                    who.append(np.where(docs == MANY, -1, task + docs.astype(np.int64)))
        met = np.zeros(0, MET)
        if keys:
            key, doc = np.concatenate(keys), np.concatenate(who)
            keys.clear()
            order = np.lexsort((key[:, 0], key[:, 1]))
            key, doc = key[order], doc[order]
            same = (key[1:] == key[:-1]).all(1)
            twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
            found, count = np.unique(doc[twice & (doc >= 0)], return_counts=True)
            met = np.zeros(len(found), MET)
            met["key"], met["count"] = found, count
        own = np.concatenate([np.zeros(0, OWN), *owns])
        for column, rows in (("own", own), ("met", met)):
            packed = list(_by_target(rows, _target(rows["key"], buckets)))
            other = pa.nulls(len(packed), pa.binary())
            data = pa.array([x for _, x in packed], pa.binary())
            yield pa.record_batch([pa.array([x for x, _ in packed], pa.int32()), data if column == "own" else other, other if column == "own" else data], ["bucket", "own", "met"])

    return run


@tidy
def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = {"own": [np.zeros(0, OWN)], "met": [np.zeros(0, MET)]}
    for batch in batches:
        for name, kind in (("own", OWN), ("met", MET)):
            parts[name] += [np.frombuffer(x, kind) for x in batch.column(name).to_pylist() if x is not None]
    own, met = np.concatenate(parts["own"]), np.concatenate(parts["met"])
    own = own[np.argsort(own["key"], kind="stable")]
    total = np.bincount(np.searchsorted(own["key"], met["key"]), met["count"], len(own)).astype(np.int64) + own["seen"]
    alive = (own["n"] > 0) & (total >= own["least"]) & (own["has"] > 0)
    yield pa.record_batch([pa.array(own["doc"], mask=own["has"] == 0), *(pa.array(own[c]) for c in ("n", "f1", "f2")), pa.array(alive)], ["doc_id", "n", "f1", "f2", "alive"])


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), f1 and f2 (fingerprint of the set) and alive: whether enough of the least hashes occur elsewhere."""
    parts = workers(docs.sparkSession)
    rows = texts(docs).mapInArrow(_dealt(8 * parts), ROWS).repartition(parts, "bucket")
    rows = rows.mapInArrow(_met(parts), "bucket int, own binary, met binary").repartition(parts, "bucket")
    return rows.mapInArrow(_summed, "doc_id long, n long, f1 long, f2 long, alive boolean")


#: A representative's token with its count among all, and the size of the representative's set.
COUNTED = np.dtype([("rep", "<i8"), ("count", "<i4"), ("n", "<i4"), ("token", "<u8")])


def _tokens_dealt(buckets: int):
    """The representatives' tokens by bucket, whole, with their representatives and these sets' sizes.

    Straight from the texts: one table function after another would keep two Python workers for each task.
    """

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            rows = np.zeros(size, COUNTED)
            rows["token"] = np.concatenate(held)
            sizes = [len(h) for h in held]
            rows["rep"], rows["n"] = np.repeat(reps, sizes), np.repeat(sizes, sizes)
            rows = list(_by_target(rows, (rows["token"] % np.uint64(buckets)).astype(np.int64)))
            return pa.record_batch({"bucket": pa.array([b for b, _ in rows], pa.int32()), "rows": pa.array([x for _, x in rows], pa.binary())})

        held, reps, size = [], [], 0
        for batch in slices(batches):
            for rep, tokens in zip(batch.column("doc_id").to_pylist(), shingle_hashes(batch.column("text").to_pylist()), strict=True):
                held.append(tokens)
                reps.append(rep)
                size += len(held[-1])
                if size > GATHERED // 4:
                    yield out()
                    held, reps, size = [], [], 0
        if size:
            yield out()

    return run


def _gathered(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([np.zeros(0, COUNTED), *(np.frombuffer(x, COUNTED) for batch in batches for x in batch.column("rows").to_pylist())])


def _frequent(buckets: int):
    """The tokens that several representatives have, with their counts, packed by representative."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gathered(batches)
        _, back, count = np.unique(rows["token"], return_inverse=True, return_counts=True)
        rows["count"] = count[back]
        rows = rows[rows["count"] > 1]
        packed = list(_by_target(rows, _target(rows["rep"], buckets)))
        yield pa.record_batch({"bucket": pa.array([b for b, _ in packed], pa.int32()), "rows": pa.array([x for _, x in packed], pa.binary())})

    return run


#: A shared token of a representative, with its count among all.
TOKEN = np.dtype([("token", "<u8"), ("count", "<i4")])


@tidy
def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Representatives that have enough tokens which others have: n, these tokens, the most frequent first, and the rarest ones, of which a partner has one."""
    rows = _gathered(batches)
    rows = rows[np.lexsort((rows["token"], -rows["count"], rows["rep"]))]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(rows)), bool), rows["rep"][1:] != rows["rep"][:-1])))
    out = []
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=False):
        n, many = int(rows["n"][i]), j - i
        if many >= needed(n):  # the n - many rarest ones are in no other set
            tokens = np.zeros(many, TOKEN)
            tokens["token"], tokens["count"] = rows["token"][i:j], rows["count"][i:j]
            out.append((int(rows["rep"][i]), n, tokens["token"][needed(n) - 1 :].astype(np.uint64).view(np.int64).tolist(), tokens.tobytes()))
    columns = list(zip(*out, strict=True)) or [[], [], [], []]
    yield pa.record_batch({"rep": pa.array(columns[0], pa.int64()), "n": pa.array(columns[1], pa.int64()), "prefix": pa.array(columns[2], pa.list_(pa.int64())), "tokens": pa.array(columns[3], pa.binary())})


def salted(rows: DataFrame, key: str, by: str, few: DataFrame) -> DataFrame:
    """rows joined with ``few`` (a row for each key) on the key; rows of one key lie in up to SALTS parts, dealt by another column."""
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(few, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of the links ``a``-``b``: least labels of neighbours, then of labels, until none changes."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    label = kept_label = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        near = salted(both, "b", "a", label.select(F.col("node").alias("b"), "component")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # Every label is a node, and so has a label itself.
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = stored(salted(new, "component", "node", jump).select("node", "old", F.least("component", "further").alias("component")), kept_label)
        changed = new.filter("old <> component").limit(1).count()
        label, kept_label = new.select("node", "component"), new
        if not changed:
            return label


def _words(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of ascending columns as 64-bit words: where a word's columns begin, its number, and the word."""
    first = np.flatnonzero(np.diff(columns >> 6, prepend=-1))
    return first, columns[first] >> 6, np.bitwise_or.reduceat(np.uint64(1) << (columns & 63).astype(np.uint64), first)


class Overlaps:
    """How many of some ranks each set has: from bits for ranks that many sets have, from lists of sets for the others."""

    def __init__(self, rows: list[np.ndarray], width: int):
        flat, who = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        count = np.bincount(flat, minlength=width)
        # A rank's bits take no more than eight bytes for each set that has it.
        many = 64 * count >= len(rows)
        self.sets, self.width = len(rows), width
        self.column = np.where(many, np.cumsum(many) - 1, -1)
        length = -(-int(many.sum()) // 64)
        self.bits = np.zeros((length, len(rows)), np.uint64)
        common = many[flat]
        if common.any():
            first, word, bits = _words(who[common] * 64 * length + self.column[flat[common]])
            self.bits[word % length, who[common][first]] = bits
        order = np.argsort(flat[~common], kind="stable")
        self.have, self.at = who[~common][order], np.concatenate(([0], np.cumsum(np.where(many, 0, count))))
        self.keys, self.ends = who * width + flat, np.cumsum([len(r) for r in rows])

    def of(self, ranks: np.ndarray, who: np.ndarray) -> np.ndarray:
        column = self.column[ranks]
        total = np.zeros(len(who), np.int64)
        if (common := column[column >= 0]).size:
            _, word, bits = _words(common)
            total += np.bitwise_count(self.bits[np.ix_(word, who)] & bits[:, None]).sum(0, dtype=np.int64)
        if (rare := ranks[column < 0]).size:
            have = np.concatenate([self.have[self.at[r] : self.at[r + 1]] for r in rare])
            total += np.bincount(have, minlength=self.sets)[who]
        return total

    def after(self, rank: int, who: np.ndarray) -> np.ndarray:
        """How many ranks beyond this one each set has."""
        return self.ends[who] - np.searchsorted(self.keys, who * self.width + rank, "right")


class PrefixTree:
    """Some of the sets (ascending arrays of ranks) in the order of their paths: a node is a run of them with a common start."""

    #: Sets of a subtree from which it pays to count what is left of the sets that are joined with it.
    COUNTED = 8

    def __init__(self, rows: list[np.ndarray], stored: list[int]):
        path = {k: rows[k].astype(">u4").tobytes() for k in stored}
        self.rows, self.sets = rows, np.array(sorted(stored, key=path.__getitem__), np.int64)
        self.length = np.array([len(rows[k]) for k in self.sets], np.int64)
        #: The length of the start that a set shares with the one before.
        self.common = np.zeros(len(stored), np.int64)
        for p in range(1, len(stored)):
            k = min(self.length[p - 1], self.length[p])
            differ = rows[self.sets[p - 1]][:k] != rows[self.sets[p]][:k]
            self.common[p] = differ.argmax() if differ.any() else k

    def groups(self, size: np.ndarray, joined: np.ndarray, width: int) -> np.ndarray:
        """Of every set the number of one that links lead to; the sets ``joined`` (ascending) are joined with those of lesser numbers.

        ``size`` counts what no other set has as well.
        """
        tokens, group = Overlaps(self.rows, width), np.arange(len(self.rows))
        stack = [(0, len(self.sets), 0, joined, np.zeros(len(joined), np.int64))]
        while stack:
            low, high, start, who, overlap = stack.pop()
            sets = self.sets[low:high]
            least, most = size[sets].min(), size[sets].max()
            n = size[who]
            keep = (who > sets.min()) & (100 * np.minimum(n, most) >= SIMILAR * np.maximum(n, least))
            if (group[sets] == group[sets[0]]).all():
                keep &= group[who] != group[sets[0]]
            who, overlap, n = who[keep], overlap[keep], n[keep]
            if not len(who):
                continue
            end = int(self.length[low] if high - low == 1 else self.common[low + 1 : high].min())
            if end > start:
                segment = self.rows[sets[0]][start:end]
                overlap = overlap + tokens.of(segment, who)
                left = int(self.length[low:high].max()) - end
                if high - low >= self.COUNTED:
                    left = np.minimum(left, tokens.after(int(segment[-1]), who))
                reach = overlap + left
                keep = 100 * reach >= SIMILAR * (n + max(end, least) - reach)
                who, overlap, n = who[keep], overlap[keep], n[keep]
                if not len(who):
                    continue
            at = low
            while at < high and self.length[at] == end:
                me = self.sets[at]
                found = who[(who > me) & (100 * overlap >= SIMILAR * (n + size[me] - overlap))]
                for other in np.unique(group[found]):
                    if other != group[me]:
                        group[group == other] = group[me]
                at += 1
            if at < high:
                cuts = [at, *(at + 1 + np.flatnonzero(self.common[at + 1 : high] == end)).tolist(), high]
                stack += [(i, j, end, who, overlap) for i, j in zip(cuts, cuts[1:], strict=False)]
        return group


def joined(reps: list[int], sizes: list[int], sets: list[np.ndarray], sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (set, another) that connect all similar sets, given as arrays of TOKEN; with sides, only links from side 1 to side 0 are looked for."""
    if len(reps) < 2:
        return []
    order = sorted(range(len(reps)), key=lambda k: (sides[k] if sides else 0, sizes[k], reps[k]))
    flat = np.concatenate([sets[k] for k in order])
    # The counts are global, so that this is the global order as far as the block has it.
    values, first, back, count = np.unique(flat["token"], return_index=True, return_inverse=True, return_counts=True)
    # What only one set of these has is on no path.
    count = np.where(count > 1, -flat["count"][first].astype(np.int64), 1)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, count))] = np.arange(len(values))
    width = int((count < 1).sum())
    rows = [np.sort(r[r < width]) for r in np.split(rank[back], np.cumsum([len(sets[k]) for k in order])[:-1])]
    split = sum(s == 0 for s in sides) if sides else 0
    if sides and not 0 < split < len(order):
        return []
    tree = PrefixTree(rows, list(range(split or len(order))))
    group = tree.groups(np.array([sizes[k] for k in order], np.int64), np.arange(split, len(order)), width)
    return [(reps[order[k]], reps[order[g]]) for k, g in enumerate(group.tolist()) if g != k]


def _block_links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    sides = rows["side"].tolist() if rows["side"].nunique() > 1 else None
    found = joined(rows["rep"].tolist(), rows["n"].tolist(), [np.frombuffer(x, TOKEN) for x in rows["tokens"]], sides)
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def links(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links a-b that connect all documents (doc_id, text), one for each set, whose sets are similar."""
    parts = workers(docs.sparkSession)
    shared = docs.mapInArrow(_tokens_dealt(2 * parts), "bucket int, rows binary").repartition(parts, "bucket")
    shared = shared.mapInArrow(_frequent(parts), "bucket int, rows binary").repartition(parts, "bucket")
    sets = stored(shared.mapInArrow(_prefixes, "rep long, n long, prefix array<long>, tokens binary"))
    prefix = sets.select("rep", F.explode("prefix").alias("token"))
    hub = prefix.groupBy("token").agg(F.min("rep").alias("b"), F.count("*").alias("c")).filter("c > 1")
    label = components(salted(prefix, "token", "rep", hub).filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct())
    size = label.groupBy("component").count()
    label = stored(salted(label, "component", "node", size))
    rows = sets.join(label, sets["rep"] == label["node"])
    row = ["rep", "n", "tokens"]
    whole = rows.filter(F.col("count") <= block).select(F.lit(0).alias("kind"), F.col("component").alias("key"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), *row)
    # A set of a larger block meets its partners at a hub of a prefix token that both have, or at the token itself.
    near = stored(salted(rows.filter(F.col("count") > block).select("rep", F.explode("prefix").alias("token")), "token", "rep", hub))
    sums = near.groupBy("b").agg(F.countDistinct("rep").alias("m"), F.sum("c").alias("pairs"))
    by_token = F.col("m") * F.col("m") > F.col("pairs")  # a token's c rows have its c each
    met = salted(near, "b", "rep", sums).select("rep", F.when(by_token, 1).otherwise(2).alias("kind"), F.when(by_token, F.col("token")).otherwise(F.col("b")).alias("key"), F.when(by_token, F.col("c")).otherwise(F.col("m")).alias("most")).distinct()
    # Every pair of parts of what still has more is a task; the part with itself included.
    parts_ = F.when(F.col("most") > block, F.ceil(F.col("most") / max(block // 2, 1))).otherwise(1).cast("int")
    pairs = met.withColumn("part", F.pmod(F.xxhash64("rep"), parts_).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts_ - 1)))
    pairs = pairs.join(sets.select(*row), "rep").select("kind", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), *row)
    return whole.union(pairs).groupBy("kind", "key", "i", "j").applyInPandas(_block_links, "a long, b long")


def grouped(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, one row for each row of docs.

    A document is linked with another if 100 times the common shingles are at least 75 times the distinct
    ones of both; component_id is the least doc_id that links reach.  Fewer than five words make one
    shingle; null texts and texts without words have none and are linked with nothing.  Rows without a
    doc_id have no component; rows that share a doc_id share a component; other columns aren't looked at.
    Shingles are compared by 64-bit fingerprints.
    """
    info = stored(described(docs))
    classes = info.filter("alive").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    classes = stored(classes)
    # The texts are dealt by a join of the same kind at every size.
    sets = texts(docs).join(classes.select(F.col("rep").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    label = components(links(sets, block))
    found = classes.join(label, classes["rep"] == label["node"], "left").select("f1", "f2", F.coalesce("component", "rep").alias("found"))
    out = info.join(found, ["f1", "f2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("alive"), F.coalesce("found", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_each(docs: DataFrame) -> DataFrame:
    """The documents whose id is their component's, with their own columns: one of each group; documents without an id stay."""
    gone = grouped(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(5, len(w)) - 1) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 75 * (ca.n + cb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN c USING (doc_id)
"""
