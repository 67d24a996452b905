"""Token ids in canonical length-limited Huffman code.

The writer puts the documents in order of their ids, one file for each range of ids.  A file is a row of
blocks; a block holds whole documents up to about ``BLOCK`` ids and can be decoded by itself:

    file, block      place in order; ``base`` ids of the file come before the block
    doc_ids, sizes   the block's documents and how many ids each has, the end id included
    bits             the codes, most significant bit first
    marks            bit offset of every ``STRIDE``-th id (little-endian unsigned 32-bit): where decoding may start

Code lengths come from the counts of all ids (package-merge, at most ``LONGEST`` bits unless the vocabulary
needs more) and are kept beside the blocks; the codes follow from the lengths.  Blocks are rows of a Parquet folder, so that any store
that Spark reaches can hold them and a lost task writes its file again.  Decoding looks up the longest
code's bits in one table, in step for all marks of a block.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, held, shared_dir, slices, table, texts, tidy, workers, Remembered

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK, STRIDE, LONGEST = 1 << 16, 128, 18
#: Memory that the chunks take which a worker remembers, in each of two generations.
REMEMBERED_BYTES = 80 << 20
#: Fixed by the tokenizer's file: the steps before its model, as far as chunks between white space can be taken one by one.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    },
)

_PARTS = regex.compile(SPLIT).findall
_ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
#: ASCII that can be seen, and Latin letters up to U+02FF: what no normal form changes but for the case.
_PLAIN = re.compile(rb"(?:[!-~]|[\xc3-\xcb][\x80-\xbf])+").fullmatch
#: Byte-level models name bytes by characters: those that can be seen by themselves, the others from U+0100 on.
_SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_NAMES = {b: chr(b) if b in _SEEN else chr(256 + b - sum(x < b for x in _SEEN)) for b in range(256)}


class Tokens:
    """The tokenizer of a file.

    If its file says that it lowers letters, drops white space and splits by the rule above, chunks between
    ASCII white space have the same ids wherever they stand: they are split by that rule, the file's model
    encodes the parts, and a worker remembers them.  Chunks with other characters, and any other tokenizer's
    texts, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, special = spec["model"], [x["content"] for x in spec.get("added_tokens") or []]
        self.by_chunk = (
            (spec.get("normalizer"), spec.get("pre_tokenizer")) == STEPS
            and model.get("type") == "BPE"
            and not model.get("dropout")
            and not (spec.get("truncation") or spec.get("padding"))
            and all(x.startswith("<|") and not any(map(str.isspace, x)) for x in special)
        )
        self.tokenize = self.lib.model.tokenize
        self.chunks = Remembered(self._chunk, REMEMBERED_BYTES)

    def _whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: bytes) -> bytes:
        name = part.decode() if part.isascii() else "".join([_NAMES[b] for b in part])
        ids = [t.id for t in self.tokenize(name)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters alone are one part
            low = chunk.lower()
            return self._part(chunk) if low == chunk else self.chunks[low]
        if b"<|" in chunk or not _PLAIN(chunk):
            return self._whole(chunk.decode("utf-8", "surrogatepass"))
        parts = _ASCII_PARTS(chunk.lower()) if chunk.isascii() else [x.encode() for x in _PARTS(chunk.decode().lower())]
        return self._part(parts[0]) if parts == [chunk] else b"".join([self.chunks[x] for x in parts])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.by_chunk:
            return list(map(self._whole, texts))
        of = self.chunks.__getitem__
        return [b"".join(map(of, text.encode("utf-8", "surrogatepass").split())) for text in texts]


def tokens_of(path: str) -> Tokens:
    """The worker's tokenizer with all that it remembers."""
    return held(("tokens", path), lambda: Tokens(path))


def id_kind(path: str) -> tuple[str, int]:
    """How an id is kept while it waits for its code, and how many ids there are."""
    from tokenizers import Tokenizer

    n = max(Tokenizer.from_file(path).get_vocab_size(), END_ID + 1)
    return "<u2" if n <= 1 << 16 else "<u4", n


def _tokenised(path: str, kind: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            ids = [x + end for x in tokens_of(path).encode(batch.column("text").to_pylist())]
            yield pa.record_batch([batch.column("doc_id"), pa.array([np.frombuffer(x, "<u4").astype(kind).tobytes() for x in ids], pa.binary())], schema)

    return run


def _counted(kind: str, n: int):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=n)
        found = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(found, pa.int32()), "n": pa.array(total[found], pa.int64())})

    return run


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``longest`` bits (package-merge); 0 where the count is 0."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids don't fit codes of {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    level, leaves = weights, []
    for _ in range(longest - 1):
        half = len(level) // 2 * 2
        merged = np.concatenate((weights, level[0:half:2] + level[1:half:2]))
        order = np.argsort(merged, kind="stable")
        leaves.append(order < len(weights))
        level = merged[order]
    take, lengths = 2 * len(weights) - 2, np.zeros(len(weights), np.int64)
    for leaf in reversed(leaves):
        n = int(leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    lengths[:take] += 1
    out[used] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes that belong to these lengths: in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, before = 0, 0
    width = lengths[order]
    values = np.zeros(len(order), np.uint64)
    for size in range(1, int(width.max(initial=0)) + 1):
        n = int((width == size).sum())
        values[before : before + n] = code + np.arange(n)
        code, before = (code + n) << 1, before + n
    codes[order] = values
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """The bits of these ids and the marks."""
    width = lengths[ids]
    end = np.cumsum(width)
    start = end - width
    word, last = start >> 6, (start & 63) + width
    code = codes[ids]
    out = np.zeros((int(end[-1]) >> 6) + 2 if len(ids) else 1, np.uint64)
    over = last > 64
    shift = np.where(over, last - 64, 64 - last).astype(np.uint64)
    high = np.where(over, code >> shift, code << shift)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(ids):
        out[word[first]] = np.bitwise_or.reduceat(high, first)
    cut = np.flatnonzero(over)
    out[word[cut] + 1] |= code[cut] << (128 - last[cut]).astype(np.uint64)
    return out.byteswap().tobytes()[: -(-int(end[-1] if len(ids) else 0) // 8)], start[::STRIDE].astype("<u4").tobytes()


class Decoder:
    def __init__(self, lengths: np.ndarray, longest: int = LONGEST):
        codes, used = canonical(lengths), np.flatnonzero(lengths)
        self.longest = longest
        self.id, self.width = np.zeros(1 << longest, np.uint32), np.zeros(1 << longest, np.uint8)
        order = used[np.argsort(codes[used] << (longest - lengths[used]).astype(np.uint64), kind="stable")]
        span = 1 << (longest - lengths[order])
        self.id[: span.sum()], self.width[: span.sum()] = np.repeat(order, span), np.repeat(lengths[order], span)

    def unpack(self, bits: bytes, marks: bytes, n: int) -> np.ndarray:
        """n ids; all marks' streams advance by one id at each step."""
        if not n:
            return np.zeros(0, np.uint32)
        data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        at = np.frombuffer(marks, "<u4").astype(np.int64)
        out = np.zeros((len(at), STRIDE), np.uint32)
        drop = np.uint32(32 - self.longest)
        for step in range(min(STRIDE, n)):
            peek = (window[np.minimum(at >> 3, len(window) - 1)] << (at & 7).astype(np.uint32)) >> drop
            out[:, step] = self.id[peek]
            at += self.width[peek]
        return out.reshape(-1)[:n]


BLOCKS = "file int, block int, base long, doc_ids array<long>, sizes array<int>, bits binary, marks binary"


def _written(lengths: np.ndarray, kind: str):
    schema = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("marks", pa.binary())])

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, file = canonical(lengths), TaskContext.get().partitionId()
        block, base, docs, kept, size, wide = 0, 0, [], [], 0, np.dtype(kind).itemsize

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(kept), kind)
            bits, marks = pack(ids, codes, lengths)
            return pa.record_batch([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([base], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) // wide for x in kept]], pa.list_(pa.int32())), pa.array([bits]), pa.array([marks])], schema)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc)
                kept.append(ids)
                size += len(ids) // wide
                if size >= BLOCK:
                    yield flush()
                    block, base, docs, kept, size = block + 1, base + size, [], [], 0
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str | None = None) -> None:
    """Tokenises the documents and writes them to ``folder``: ``blocks`` and ``lengths``.

    The texts are ranged by doc_id once and tokenised in that order; the ids are kept in the shared folder
    while their counts are taken (at most one row for each id of the vocabulary reaches the driver).  Rows
    of the same doc_id stand in order of their texts; a null doc_id comes first; a null text has the end
    id alone; an empty table gives empty folders; other columns aren't kept.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    kind, n = id_kind(path)
    # Rows that share a doc_id are told apart by how their texts begin, so that they can lie in several ranges.
    ranged = texts(docs).repartitionByRange(workers(docs.sparkSession), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    ids = checkpointed(ranged.mapInArrow(_tokenised(path, kind), "doc_id long, ids binary"))
    counts = np.zeros(n, np.int64)
    for row in ids.mapInArrow(_counted(kind, n), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts, max(LONGEST, n.bit_length() + 1))
    docs.sparkSession.createDataFrame([(i, int(lengths[i])) for i in np.flatnonzero(lengths).tolist()], "id int, length int").coalesce(1).write.parquet(f"{folder}/lengths")
    ids.mapInArrow(_written(lengths, kind), BLOCKS).write.parquet(f"{folder}/blocks")


def _read(lengths: np.ndarray, digest: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("file", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))])

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths, max(1, int(lengths.max())))
        for batch in slices(batches, "bits", 1 << 20):
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], np.int64)
                end = np.cumsum(sizes)
                ids = decoder.unpack(row["bits"], row["marks"], int(end[-1]))
                data, at = ids.astype("<u4").tobytes(), [0, *(4 * end).tolist()]
                if digest:
                    value = pa.array([zlib.crc32(data[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.int64())
                else:
                    value = pa.ListArray.from_arrays(pa.array([0, *end.tolist()], pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(sizes), row["file"]), pa.int32()), pa.array(row["base"] + end - sizes), pa.array(sizes), value], schema)

    return run


def read(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the ids (or, with ``digest``, their ids_crc32)."""
    found = spark.read.parquet(f"{folder}/lengths").collect()
    lengths = np.zeros(max((r["id"] for r in found), default=0) + 1, np.int64)
    for row in found:
        lengths[row["id"]] = row["length"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    total = {r[0]: r[1] for r in blocks.groupBy("file").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).collect()}
    starts, start = [], 0
    for file in sorted(total):  # one number for each file
        starts.append((file, start))
        start += total[file]
    rows = blocks.mapInArrow(_read(lengths, digest), f"doc_id long, file int, before long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<int>'}")
    return rows.join(F.broadcast(spark.createDataFrame(starts, "file int, first long")), "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32" if digest else "ids")


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder, digest=True)
