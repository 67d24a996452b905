"""Substring dedup over word windows by super-k-mer partitioning.

A window is 13 consecutive words.  Its minimiser is the least of its 3-word grams in a fixed order;
consecutive windows with the same minimiser travel as one packed string to the minimiser's bucket, where
the windows are sorted and counted exactly: fingerprints first, then the words of equal fingerprints.
What counts is the least doc_id that a window starts in; every document with a greater one loses it.

A task sends each distinct window of a slice of texts once, for the least of its documents; the others know
already that they lose it (there, too, the words decide).  Grams that are very frequent (a line or passage
that a large part of all documents has) come last in the order, so that a window that has any other gram
goes to that one's bucket.  Which grams those are is estimated from a part of the texts; it decides the way
that a window takes, never what becomes of it.  Lost windows travel packed by the rows' own buckets.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, texts, tidy, workers
from .hashing import Prefixes, mixed

WINDOW, GRAM = 13, 3
#: Bytes of text that are looked at together.
TOGETHER = 2_000_000
#: A gram is very frequent if it is this part of a bucket's fair share of all windows; so there are at most a bounded number.
SHARE = 0.25
#: Of so many rows one is looked at for frequent grams.
SAMPLED = 8


class Words:
    """The words of some texts, joined by spaces, with fingerprints of what lies between word starts and ends."""

    def __init__(self, texts_: list[str], bases: int = 1):
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts_]
        self.line = b" ".join(b" ".join(w) for w in words if w) + b" "
        self.count = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(self.line, np.uint8)
        self.end = np.flatnonzero(data == 32)[: self.count.sum()]
        self.start = np.concatenate(([0], self.end[:-1] + 1)) if len(self.end) else np.zeros(0, np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.sums = Prefixes(data, bases)
        doc = np.repeat(np.arange(len(texts_)), self.count)
        #: Word where each window starts, and its document.
        room = self.first[doc] + self.count[doc] - np.arange(len(doc))
        self.windows = np.flatnonzero(room >= WINDOW)
        self.doc = doc

    def grams(self) -> np.ndarray:
        """Of each word the fingerprint of the gram that starts there (grams over a document's end are in no window)."""
        n = len(self.start)
        if n < GRAM:
            return np.zeros(n, np.uint64)
        out = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        out[: n - GRAM + 1] = self.sums.of(self.start[: n - GRAM + 1], self.end[GRAM - 1 :])
        return out

    def least(self, hot: np.ndarray) -> np.ndarray:
        """Of each window the word where its minimiser starts: the leftmost of the least grams."""
        gram = self.grams()
        # Frequent grams come after all others; the place in the window breaks ties.
        rank = (gram >> np.uint64(5)) | (np.isin(gram, hot).astype(np.uint64) << np.uint64(59)) if len(hot) else gram >> np.uint64(5)
        best, at = rank[self.windows], self.windows.copy()
        for k in range(1, WINDOW - GRAM + 1):
            other = rank[self.windows + k]
            less = other < best
            best = np.where(less, other, best)
            at[less] = self.windows[less] + k
        return at


@tidy
def _frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The grams that a task sees as minimisers unusually often: at least one in 20,000 of its windows, and four times."""
    none = np.zeros(0, np.uint64)
    held, total = [], 0
    for batch in slices(batches, "text", TOGETHER):
        words = Words(batch.column("text").to_pylist())
        if len(words.windows):
            held.append(words.grams()[np.unique(words.least(none))])
            total += len(words.windows)
    if held:
        gram, count = np.unique(np.concatenate(held), return_counts=True)
        many = count >= max(4, total // 20_000)
        yield pa.record_batch({"gram": pa.array(gram[many].view(np.int64)), "n": pa.array(count[many], pa.int64()), "windows": pa.array(np.zeros(many.sum(), np.int64))})
    yield pa.record_batch({"gram": pa.nulls(1, pa.int64()), "n": pa.array([sum(map(len, held))], pa.int64()), "windows": pa.array([total], pa.int64())})


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """The very frequent grams: at most one for each ``SHARE`` of a bucket, estimated from one row in ``SAMPLED``.

    Their order in the minimisers is all that depends on it.
    """
    docs = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    found = docs.mapInArrow(_frequent, "gram long, n long, windows long").groupBy("gram").agg(F.sum("n").alias("n"))
    total = found.filter("gram IS NULL").first()
    fair = SHARE * (total["n"] if total else 0) / workers(docs.sparkSession)
    rows = found.filter(F.col("gram").isNotNull() & (F.col("n") > max(fair, 50 / SAMPLED))).collect()
    return np.sort(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))


ROWS = "bucket int, packed binary, strings binary, lost binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("packed", "strings", "lost"))])
#: Of each packed string its windows, its row, and the word where it starts; a column after the other, packed as well.
STRINGS = (("sizes", "<i4"), ("docs", "<i8"), ("keys", "<i8"), ("places", "<i4"))
#: A row of docs (its id, and a hash of its text in case rows share an id) and a word where a window starts that it loses.
LOST = np.dtype([("doc", "<i8"), ("k", "<i8"), ("at", "<i4")])
#: In place of a word: the row has windows that occur in it again, of which one stands for all.
AGAIN = -1


def _bucket_of(doc: np.ndarray, k: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ k.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _columns(data: bytes) -> dict[str, np.ndarray]:
    """The columns of some strings."""
    n, at, out = len(data) // sum(np.dtype(kind).itemsize for _, kind in STRINGS), 0, {}
    for name, kind in STRINGS:
        out[name] = np.frombuffer(data, kind, n, at)
        at += out[name].nbytes
    return out


def _packed_lost(lost: np.ndarray, buckets: int, pack) -> list[tuple[int, bytes]]:
    lost = lost[np.lexsort((lost["at"], lost["k"], lost["doc"]))]
    bucket = _bucket_of(lost["doc"], lost["k"], buckets)
    order = np.argsort(bucket, kind="stable")
    lost, bucket = lost[order], bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    return [(int(bucket[i]), pack.compress(lost[i:j].tobytes())) for i, j in zip(first, [*first[1:], len(lost)], strict=False)]


def _sent(hot: np.ndarray, parts: int, buckets: int):
    """Packed strings by bucket, and the windows that a row loses to another of the same slice, packed by the rows' own buckets."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, "text", TOGETHER):
            yield from _strings(batch.column("doc_id").to_numpy(), batch.column("k").to_numpy(), batch.column("text").to_pylist(), hot, parts, buckets, pack)

    return run


def _grouped(name: np.ndarray, doc_id: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Of each window the one that stands for all with its name: of the least document the first."""
    order = np.lexsort((windows, doc_id, name))
    new = np.concatenate(([True], name[order][1:] != name[order][:-1]))
    stands = np.empty(len(name), np.int64)
    stands[order] = order[new][np.cumsum(new) - 1]
    return stands


def _same_words(words: Words, windows: np.ndarray, stands: np.ndarray) -> bool:
    """Whether windows have the words of those that stand for them; neighbours are compared as one string."""
    i = np.flatnonzero(stands != np.arange(len(stands)))
    if not len(i):
        return True
    a, b = windows[i], windows[stands[i]]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 1) | (np.diff(b) != 1))))
    n = np.diff(np.append(first, len(a))) + WINDOW - 2
    line, starts, ends = words.line, words.start, words.end
    spans = zip(starts[a[first]].tolist(), ends[a[first] + n].tolist(), starts[b[first]].tolist(), ends[b[first] + n].tolist(), strict=True)
    return all(line[w:x] == line[y:z] for w, x, y, z in spans)


def _strings(ids: np.ndarray, keys: np.ndarray, held: list[str], hot: np.ndarray, parts: int, buckets: int, pack) -> Iterator[pa.RecordBatch]:
    words = Words(held)
    windows = words.windows
    if not len(windows):
        return
    doc = words.doc[windows]
    start, end = words.start[windows], words.end[windows + WINDOW - 1]
    stands = _grouped(words.sums.of(start, end), ids[doc], windows)
    if not _same_words(words, windows, stands):  # two fingerprints met: names by the words themselves
        names: dict[bytes, int] = {}
        stands = _grouped(np.array([names.setdefault(words.line[a:b], len(names)) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), ids[doc], windows)
    goes = stands == np.arange(len(windows))
    gone = ids[doc] > ids[doc[stands]]
    again = np.unique(doc[~goes & ~gone])
    place = windows - words.first[doc]
    lost = np.zeros(int(gone.sum()) + len(again), LOST)
    whose = np.concatenate((doc[gone], again))
    lost["doc"], lost["k"], lost["at"] = ids[whose], keys[whose], np.concatenate((place[gone], np.full(len(again), AGAIN)))
    if len(lost):
        rows = _packed_lost(lost, parts, pack)
        none = pa.nulls(len(rows), pa.binary())
        yield pa.record_batch([pa.array([b for b, _ in rows], pa.int32()), none, none, pa.array([x for _, x in rows], pa.binary())], _SCHEMA)
    least_at = words.least(hot)
    cut = np.concatenate(([True], (least_at[1:] != least_at[:-1]) | (windows[1:] != windows[:-1] + 1) | ~goes[:-1] | ~goes[1:]))
    run = np.cumsum(cut) - 1
    keep = goes[cut]
    a, n = windows[cut][keep], np.bincount(run)[keep]
    bucket = (words.grams()[least_at[cut][keep]] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    a, n, bucket = a[order], n[order], bucket[order]
    start, end = words.start[a].tolist(), words.end[a + n + WINDOW - 2].tolist()
    first = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    last = [*first[1:], len(bucket)][: len(first)]
    doc, line = words.doc[a], words.line
    packed = [pack.compress(b"\n".join([line[x:y] for x, y in zip(start[i:j], end[i:j], strict=True)])) for i, j in zip(first, last, strict=True)]
    columns = n.astype("<i4"), ids[doc].astype("<i8"), keys[doc].astype("<i8"), (a - words.first[doc]).astype("<i4")
    strings = [pack.compress(b"".join([x[i:j].tobytes() for x in columns])) for i, j in zip(first, last, strict=True)]
    yield pa.record_batch([pa.array(bucket[first], pa.int32()), pa.array(packed, pa.binary()), pa.array(strings, pa.binary()), pa.nulls(len(first), pa.binary())], _SCHEMA)


def _bounds(line: bytes, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the windows of some packed strings start and end in the line, which is also given as an array."""
    view = np.frombuffer(line, np.uint8)
    end = np.flatnonzero((view == 32) | (view == 10))
    start = np.concatenate(([0], end[:-1] + 1))
    first = np.concatenate(([0], np.cumsum(size + WINDOW - 1)[:-1]))  # of each string its first word
    window = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    return view, start[window], end[window + WINDOW - 1]


FOUND = "bucket int, doc_id long, k long, times long, packed binary, lost binary"
_FOUND = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("k", pa.int64()), ("times", pa.int64()), ("packed", pa.binary()), ("lost", pa.binary())])


def _lost_rows(buckets: pa.Array, lost: pa.Array) -> pa.RecordBatch:
    n = len(buckets)
    return pa.record_batch([buckets, *(pa.nulls(n, pa.int64()),) * 3, pa.nulls(n, pa.binary()), lost], _FOUND)


def _counted(parts: int):
    """The windows that rows lose: those that came as such, and those that sorting a bucket's windows finds.

    Of each window only the fingerprint is kept; the rest is looked up where two are equal.
    """

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        packs, names, columns = [], [], {name: [] for name, _ in STRINGS}
        for batch in batches:
            ready = batch.filter(pa.compute.is_valid(batch.column("lost")))
            if ready.num_rows:
                yield _lost_rows(ready.column("bucket"), ready.column("lost"))
            for row in batch.filter(pa.compute.is_valid(batch.column("packed"))).select(["packed", "strings"]).to_pylist():
                packs.append(row["packed"])
                for name, values in _columns(unpack.decompress(row["strings"])).items():
                    columns[name].append(values)
                view, a, b = _bounds(unpack.decompress(packs[-1]) + b"\n", columns["sizes"][-1])
                names.append(Prefixes(view).of(a, b))
        if not packs:
            return
        last = np.cumsum([len(n) for n in names])  # windows up to each pack
        name = np.concatenate(names)
        names.clear()
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        twice = np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))])
        del name, order, same
        if not len(twice):
            return
        size = np.concatenate(columns["sizes"])
        string_end = np.cumsum(size)
        string = np.searchsorted(string_end, twice, "right")
        doc, key = np.concatenate(columns["docs"])[string], np.concatenate(columns["keys"])[string]
        place = np.concatenate(columns["places"])[string] + (twice - string_end[string] + size[string])
        # Equal fingerprints only: the words themselves decide.
        pack_of = np.searchsorted(last, twice, "right")
        least: dict[bytes, int] = {}
        lose = np.zeros(len(twice), bool)
        for decide in (False, True):
            for k in np.unique(pack_of).tolist():
                mine = np.arange(*np.searchsorted(pack_of, (k, k + 1)))
                line = unpack.decompress(packs[k]) + b"\n"
                _, a, b = _bounds(line, columns["sizes"][k])
                at = twice[mine] - (last[k] - len(a))
                if decide:
                    lose[mine] = [least[line[x:y]] < d for x, y, d in zip(a[at].tolist(), b[at].tolist(), doc[mine].tolist(), strict=True)]
                else:
                    for x, y, d in zip(a[at].tolist(), b[at].tolist(), doc[mine].tolist(), strict=True):
                        words = line[x:y]
                        if least.setdefault(words, d) > d:
                            least[words] = d
        lost = np.zeros(int(lose.sum()), LOST)
        lost["doc"], lost["k"], lost["at"] = doc[lose], key[lose], place[lose]
        if len(lost):
            rows = _packed_lost(lost, parts, pack)
            yield _lost_rows(pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary()))

    return run


def _zipped(parts: int):
    """The rows' texts by their own buckets; equal rows of a slice as one."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text", TOGETHER):
            times = Counter(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "text")), strict=True))
            ids, keys, texts_ = zip(*times, strict=True)
            bucket = _bucket_of(np.array([d or 0 for d in ids], np.int64), np.array(keys, np.int64), parts)
            packed = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts_]
            yield pa.record_batch([pa.array(bucket, pa.int32()), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(times.values(), pa.int64()), pa.array(packed, pa.binary()), pa.nulls(len(ids), pa.binary())], _FOUND)

    return run


def _everywhere(line: list[bytes], places: np.ndarray) -> np.ndarray:
    """All places of the text where one of the windows at these places starts."""
    text = b" ".join(line)
    words = Words([text.decode("utf-8", "surrogatepass")])
    name = words.sums.of(words.start[words.windows], words.end[words.windows + WINDOW - 1])
    lost = {tuple(line[p : p + WINDOW]) for p in places.tolist()}
    near = words.windows[np.isin(name, name[places])]
    return np.array([p for p in near.tolist() if tuple(line[p : p + WINDOW]) in lost], np.int64)


OUT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def _finished(digest: bool):
    """A bucket's rows without what they lose."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, lost, rows = zstandard.ZstdDecompressor(), [np.zeros(0, LOST)], []
        for batch in batches:
            lost += [np.frombuffer(unpack.decompress(x), LOST) for x in batch.column("lost").to_pylist() if x is not None]
            rows += batch.filter(pa.compute.is_valid(batch.column("packed"))).select(["doc_id", "k", "times", "packed"]).to_pylist()
        every = np.concatenate(lost)
        every = every[np.lexsort((every["at"], every["k"], every["doc"]))]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), bool), (np.diff(every["doc"]) != 0) | (np.diff(every["k"]) != 0))))
        at = {(int(every["doc"][i]), int(every["k"][i])): (i, j) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(every)], strict=False)}
        out = []
        for row in rows:
            words = unpack.decompress(row["packed"]).split()
            gone = np.zeros(len(words) + 1, np.int64)
            if row["doc_id"] is not None and (found := at.get((row["doc_id"], row["k"]))):
                p = np.unique(every["at"][slice(*found)]).astype(np.int64)
                if p[0] == AGAIN:
                    p = _everywhere(words, p[1:]) if len(p) > 1 else p[1:]
                gone[p] += 1
                gone[p + WINDOW] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
            out += [(row["doc_id"], len(words), int(gone.sum()), None if digest else left.decode("utf-8", "surrogatepass"), hashlib.sha256(left).hexdigest())] * row["times"]
            if len(out) > 4096 or not digest and sum(len(x[3]) for x in out[-1:]) > 1 << 20:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema)

    return run


def deduplicated(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the remaining words, joined by a space; null with ``digest``) and kept_sha256.

    A word goes if a window that covers it starts in a document with a smaller doc_id too; windows are judged
    on the input.  Null texts have no words; rows without a doc_id lose nothing and take nothing; rows that
    share a doc_id don't take words from each other, and each loses its own; repeated rows each give a row;
    other columns aren't looked at.
    """
    docs = texts(docs)
    # Rows that share an id are told apart by their texts' hashes; mostly there are none, and the hashes needn't travel.
    shared = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    docs = docs.withColumn("k", F.xxhash64("text") if shared else F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    known = docs.filter("doc_id IS NOT NULL")
    parts = workers(docs.sparkSession)
    rows = known.mapInArrow(_sent(frequent_grams(known), parts, 4 * parts), ROWS).repartition(parts, "bucket")
    lost = rows.mapInArrow(_counted(parts), FOUND)
    return docs.mapInArrow(_zipped(parts), FOUND).union(lost).repartition(parts, "bucket").mapInArrow(_finished(digest), OUT)


def op5_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True).drop("kept")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (g) WHERE doc_id > m),
per AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""
