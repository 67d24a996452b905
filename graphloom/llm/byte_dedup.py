"""Suffix-style substring dedup over bytes by bucket-pointer refinement.

Which of all 200-byte strings start in two places?  Instead of every suffix, the places that matter are
chosen by content: in each 200-byte window the least of its 32-byte grams is the anchor, so equal windows
have equal anchors at the same offset, and consecutive windows of one anchor are handled as a run.

- Level 0: the runs are put in buckets by their anchor's gram.  A run alone in its bucket is done: none of
  its windows starts anywhere else.  Runs that are equal from end to end are done as well: all do.
- Level 1: what is left is refined by later offsets: a run is cut at fixed offsets from its anchor, and each
  piece goes to the bucket of the string that all its windows share, named by its fingerprint.
- Level 2: pieces that are still undecided go to the buckets of their single windows.

Each level only sorts what the one before left open, and what a level decides is kept.  Buckets are counted,
never gathered: a task combines equal strings first and tells their runs at once, a bucket's name reaches
the bucket once per task, and runs that only share the name are told by their own strings' buckets.  So
a passage that a third of all documents have adds a few rows per task to its bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table, texts, tidy, workers
from .hashing import Prefixes, mixed

LENGTH, GRAM = 200, 32
#: Windows in a piece of level 1.
PIECE = 13
#: Runs that a task gathers before it combines and sends them, and bytes of text looked at together.
GATHERED, TOGETHER = 600_000, 1 << 20

_SPAN = LENGTH - GRAM + 1  # grams in a window
#: Flags: the row goes by its own string; others in the task have it too, and its run is told; it is only its bucket's name.
OWN, MORE, NAME = 1, 2, 4
#: A bucket's name, 128 bits for the string itself, 96 bits for the row whose text has it (rows are told apart by id and text).
RECORD = np.dtype([("core", "<u8"), ("own", "<u8"), ("own2", "<u8"), ("k", "<i8"), ("k2", "<i4"), ("at", "<i4"), ("n", "u1"), ("r", "u1"), ("flag", "u1")])
#: A run's windows: where the first starts, how many, and the anchor's distance from it.
PLACE = np.dtype([("at", "<i4"), ("n", "u1"), ("r", "u1")])


def _runs(lengths: np.ndarray, sums: Prefixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that follow each other: first window, number of windows and anchor of each run, and its text."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    room = np.repeat(ends, lengths) - np.arange(total)
    valid = np.flatnonzero(room >= LENGTH)
    if not len(valid):
        return (np.zeros(0, np.int64),) * 4
    n = total - GRAM + 1
    gram = sums.of(np.arange(n), np.arange(GRAM, total + 1))
    # Least gram, leftmost first, of every _SPAN neighbours: least of a block's rest and of the next block's beginning.
    bits = np.uint64(max(1, int(total).bit_length()))
    key = (gram >> bits << bits) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // _SPAN) * _SPAN + _SPAN, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    block = padded.reshape(-1, _SPAN)
    begin = np.minimum.accumulate(block, axis=1).reshape(-1)
    rest = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(rest[valid], begin[valid + _SPAN - 1])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.searchsorted(ends, valid, "right")
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    return valid[first], np.diff(np.append(first, len(valid))), anchor[first], doc[first]


def _records(core: np.ndarray, own: np.ndarray, own2, k: tuple, at: np.ndarray, n: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.zeros(len(core), RECORD)
    for name, value in zip(RECORD.names, (core, own, own2, *k, at, n, r), strict=False):
        out[name] = value
    return out


def _own(sums: Prefixes, start: np.ndarray, end: np.ndarray, more: np.ndarray) -> list[np.ndarray]:
    return [mixed(sums.of(start, end, base) + more.astype(np.uint64)) for base in (0, 1)]


def _level0(keys: np.ndarray, keys2: np.ndarray, texts_: list[bytes]) -> np.ndarray:
    lengths = np.array([len(t) for t in texts_], np.int64)
    data = np.frombuffer(b"".join(texts_), np.uint8)
    if len(data) < LENGTH:
        return np.zeros(0, RECORD)
    sums = Prefixes(data, 2)
    first, n, anchor, doc = _runs(lengths, sums)
    r = anchor - first
    own = _own(sums, first, first + n - 1 + LENGTH, r * 256 + n)
    return _records(sums.of(anchor, anchor + GRAM), *own, (keys[doc], keys2[doc]), first - (np.cumsum(lengths) - lengths)[doc], n, r)


def _level1(k: tuple[int, int], data: bytes, places: np.ndarray) -> np.ndarray:
    """The runs' pieces: cut where the distance to the anchor is a multiple of PIECE."""
    sums = Prefixes(np.frombuffer(data, np.uint8), 2)
    at, n, r = places["at"].astype(np.int64), places["n"].astype(np.int64), places["r"].astype(np.int64)
    low, high = r - n + 1, r  # distances to the anchor of the last and the first window
    count = high // PIECE - low // PIECE + 1
    which = np.repeat(np.arange(len(at)), count)
    piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + (low // PIECE)[which]
    anchor = (at + r)[which]
    near, far = piece * PIECE, np.minimum(piece * PIECE + PIECE - 1, _SPAN - 1)
    core = mixed(sums.of(anchor - near, anchor - far + LENGTH) + piece.astype(np.uint64))
    near, far = np.maximum(near, low[which]), np.minimum(far, high[which])
    first, size = anchor - far, far - near + 1
    return _records(core, *_own(sums, first, first + size - 1 + LENGTH, far * 256 + size), k, first, size, far)


def _level2(k: tuple[int, int], data: bytes, places: np.ndarray) -> np.ndarray:
    sums = Prefixes(np.frombuffer(data, np.uint8), 2)
    size = places["n"].astype(np.int64)
    at = np.repeat(places["at"].astype(np.int64), size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return _records(sums.of(at, at + LENGTH), sums.of(at, at + LENGTH, 1), 0, k, at, np.ones(len(at)), np.zeros(len(at)))


ROWS = "bucket int, rows binary, k long, k2 int, places binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("rows", pa.binary()), ("k", pa.int64()), ("k2", pa.int32()), ("places", pa.binary())])
FOUND = "k long, k2 int, same boolean, places binary"
_FOUND = pa.schema([("k", pa.int64()), ("k2", pa.int32()), ("same", pa.bool_()), ("places", pa.binary())])


def _starts(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _by_text(records: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    records = records[np.lexsort((records["k2"], records["k"]))]
    first = np.flatnonzero(_starts(records["k"], records["k2"]))
    places = np.zeros(len(records), PLACE)
    for name in PLACE.names:
        places[name] = records[name]
    for i, j in zip(first.tolist(), np.append(first[1:], len(records))[: len(first)].tolist(), strict=True):
        yield int(records["k"][i]), int(records["k2"][i]), places[i:j].tobytes()


def combined(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a task sends, and the runs that it can tell to have an equal one."""
    records = records[np.lexsort((records["own2"], records["own"], records["core"]))]
    pair = np.flatnonzero(_starts(records["core"], records["own"], records["own2"]))
    count = np.diff(np.append(pair, len(records)))
    told = records[np.repeat(count > 1, count)]
    rows = records[pair].copy()
    rows["flag"][count > 1] |= MORE
    core = np.flatnonzero(_starts(rows["core"]))
    kinds = np.diff(np.append(core, len(rows)))
    names = rows[core][kinds > 1].copy()
    names["flag"], names["own"], names["own2"] = MORE | NAME, 0, 0
    rows["flag"][np.repeat(kinds > 1, kinds)] |= OWN
    return np.concatenate((rows, names)), told


def _group(records: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    rows, told = combined(np.concatenate(records))
    route = np.where(rows["flag"] & OWN, rows["own"], rows["core"])
    bucket = (route % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    first = np.flatnonzero(_starts(bucket))
    last = np.append(first[1:], len(bucket))[: len(first)]
    none = pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.int32()), pa.nulls(len(first), pa.binary())
    yield pa.record_batch([pa.array(bucket[first], pa.int32()), pa.array([rows[i:j].tobytes() for i, j in zip(first, last, strict=True)], pa.binary()), *none], _SCHEMA)
    done = list(_by_text(told))
    yield pa.record_batch([pa.array([k % buckets for k, _, _ in done], pa.int32()), pa.nulls(len(done), pa.binary()), pa.array([k for k, _, _ in done], pa.int64()), pa.array([k for _, k, _ in done], pa.int32()), pa.array([p for _, _, p in done], pa.binary())], _SCHEMA)


def _first_level(buckets: int):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "text", TOGETHER):
            data = [x.encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
            held.append(_level0(batch.column("k").to_numpy(), batch.column("k2").to_numpy(), data))
            size += len(held[-1])
            if size > GATHERED:
                yield from _group(held, buckets)
                held, size = [], 0
        if size:
            yield from _group(held, buckets)

    return run


def _next_level(level, buckets: int):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held, size = [], 0
        for batch in batches:
            for k, k2, packed, places in zip(*(batch.column(c).to_pylist() for c in ("k", "k2", "packed", "places")), strict=True):
                held.append(level((k, k2), unpack.decompress(packed), np.frombuffer(b"".join(places), PLACE)))
                size += len(held[-1])
                if size > GATHERED:
                    yield from _group(held, buckets)
                    held, size = [], 0
        if size:
            yield from _group(held, buckets)

    return run


@tidy
def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs that have an equal one elsewhere (same), and those that only share their bucket (open)."""
    held = []
    for batch in batches:
        told = batch.filter(pa.compute.is_valid(batch.column("k")))
        if told.num_rows:
            yield pa.record_batch([told.column("k"), told.column("k2"), pa.array([True] * told.num_rows), told.column("places")], _FOUND)
        held += [np.frombuffer(x, RECORD) for x in batch.column("rows").to_pylist() if x is not None]
    if not held:
        return
    rows = np.concatenate(held)
    held.clear()
    own = rows["flag"] & OWN
    rows = rows[np.lexsort((rows["own2"], rows["own"], rows["core"], own))]
    own, weight = (rows["flag"] & OWN) > 0, np.where(rows["flag"] & MORE, 2, 1)
    pair = np.cumsum(_starts(rows["core"], rows["own"], rows["own2"], own)) - 1
    core = np.cumsum(_starts(rows["core"], own)) - 1
    same = np.bincount(pair, weight)[pair] > 1
    shared = (np.bincount(core, weight)[core] > 1) | own
    run, untold = (rows["flag"] & NAME) == 0, rows["flag"] & MORE == 0
    # One of equal runs goes on beside the open ones of its bucket: they may hold some of its windows.
    new = _starts(rows["core"], rows["own"], rows["own2"], own)
    beside = same & new & ((np.bincount(core, new)[core] > 1) | own)
    for mask, what in ((same & run & untold, True), (((~same & shared) | beside) & run, False)):
        found = list(_by_text(rows[mask]))
        yield pa.record_batch([pa.array([k for k, _, _ in found], pa.int64()), pa.array([k for _, k, _ in found], pa.int32()), pa.array([what] * len(found), pa.bool_()), pa.array([p for _, _, p in found], pa.binary())], _FOUND)


@tidy
def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches):
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "k": batch.column("k"), "k2": batch.column("k2"), "packed": pa.array([pack.compress(x.encode("utf-8", "surrogatepass")) for x in batch.column("text").to_pylist()], pa.binary())})


CUT = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _cut(packed: pa.Array, places: pa.Array) -> pa.Array:
    unpack, rows = zstandard.ZstdDecompressor(), []
    for data, found in zip(packed, places, strict=True):
        data = unpack.decompress(data.as_py())
        row = {"n_bytes": len(data), "n_removed": 0, "n_spans": 0, "starts": [], "ends": []}
        if found.is_valid:
            p = np.frombuffer(b"".join(found.as_py()), PLACE)
            p = p[np.argsort(p["at"], kind="stable")]
            start, end = p["at"].astype(np.int64), np.maximum.accumulate(p["at"].astype(np.int64) + p["n"] - 1 + LENGTH)
            first = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
            starts, ends = start[first], end[np.append(first[1:] - 1, len(end) - 1)]
            row |= {"n_removed": int((ends - starts).sum()), "n_spans": len(starts), "starts": starts.tolist(), "ends": ends.tolist()}
            bounds = [0, *np.column_stack((starts, ends)).ravel().tolist(), len(data)]
            data = b"".join([data[i:j] for i, j in zip(bounds[::2], bounds[1::2], strict=True)])
        row["kept_sha256"] = hashlib.sha256(data).hexdigest()
        rows.append(row)
    return pa.array(rows, CUT)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed runs of bytes (starts, ends).

    A byte goes if it is covered by a 200-byte string (of the text in UTF-8) that also starts anywhere else, in
    the same text or another; strings are judged on the input and never cross texts.  Null texts are empty;
    texts under 200 bytes keep all; repeated rows are copies of each other like any, and each gives a row;
    rows without a doc_id are treated like others; other columns aren't looked at.  Strings are compared by
    128-bit fingerprints at every level, rows by 96 bits of their ids and texts.
    """
    row = ["k", "k2"]
    docs = texts(docs).withColumn("k", F.xxhash64("doc_id", "text")).withColumn("k2", F.hash("text", "doc_id"))
    parts = workers(docs.sparkSession)
    buckets = 4 * parts
    packed = docs.mapInArrow(_packed, "doc_id long, k long, k2 int, packed binary")
    level = docs.select(*row, "text").mapInArrow(_first_level(buckets), ROWS).repartition(parts, "bucket").mapInArrow(_counted, FOUND)
    found = [stored(level)]
    gathered = lambda what, same: what.filter(F.col("same") == same).groupBy(*row).agg(F.collect_list("places").alias("places"))
    open_ = stored(packed.select(*row, "packed").join(gathered(found[0], False).hint("merge"), row).dropDuplicates(row))
    for step in (_level1, _level2):
        level = open_.mapInArrow(_next_level(step, buckets), ROWS).repartition(parts, "bucket").mapInArrow(_counted, FOUND)
        found.append(stored(level))
        if step is _level1:
            open_ = open_.select(*row, "packed").join(gathered(found[1], False), row)
    same = gathered(found[0].union(found[1]).union(found[2]), True)
    return packed.join(same.hint("merge"), row, "left").select("doc_id", F.arrow_udf(_cut, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,starts:array<int>,ends:array<int>>")("packed", "places").alias("x")).select("doc_id", "x.*")


def op2_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("starts", "ends")
