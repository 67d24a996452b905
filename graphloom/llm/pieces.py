"""SentencePiece encoding and decoding that keeps the offsets.

Normalisation walks the text with the longest prefix found in the model's compiled character map, and
records for each normalised byte the source byte that it came from; dropped and added spaces and the escaped
ones are part of that alignment.  What it makes is what gets encoded: the library's encoder runs on the
normalised text with its own normalisation taken out of the model, and its decoder on the ids.  A piece's
bytes in the normalised text, projected through the alignment, are its span in the source.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, slices, table, tidy

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of text that are encoded together; what they become is some thirty times as large.
TOGETHER = 1 << 20


class CharacterMap:
    """A model's compiled character map: a double-array trie of byte strings, each leading to its replacement."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.strings = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.strings = blob[4 + size :]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest key that the data have at this place (0: none) and what replaces it."""
        length, found = 0, b""
        node = self._child(self.units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                length, found = k + 1 - at, self.strings[start : self.strings.index(b"\0", start)]
        return length, found


def _width(first: int) -> int:
    return 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)


def aligned(data: bytes, cmap: CharacterMap, whole: tuple[bytes, ...] = ()) -> tuple[bytes, np.ndarray]:
    """The normalised bytes and, for each of them and the end, the source byte where its replacement starts.

    Strings in ``whole`` (longer ones first) stay as they are.
    """
    if not cmap.units:
        return data, np.arange(len(data) + 1)
    out, place, at = bytearray(), [], 0
    while at < len(data):
        kept = next((x for x in whole if data.startswith(x, at)), b"")
        length, found = (len(kept), kept) if kept else cmap.longest(data, at)
        if kept or not length:
            length = length or _width(data[at])
            found = data[at : at + length]
            place += range(at, at + length)
        else:
            place += [at] * len(found)
        out += found
        at += length
    return bytes(out), np.array([*place, len(data)])


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as spm

        with open(model_file, "rb") as file:
            proto = spm.ModelProto.FromString(file.read())
        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.norm = norm = spm.NormalizerSpec.FromString(proto.normalizer_spec.SerializeToString())
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.kinds = np.array([p.type for p in proto.pieces])
        self.whole = tuple(sorted((p.piece.encode() for p in proto.pieces if p.type == 4), key=len, reverse=True))
        self.width = np.array([1 if p.type == 6 else 0 if p.type == 3 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = int(np.flatnonzero(self.kinds == 2)[0])
        #: Whether unknown characters become bytes, so that every piece's width is known from its id.
        self.bytes = int((self.kinds == 6).sum()) == 256
        #: Whether normalisation only escapes the spaces.
        self.simple = not self.map.units and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        self.decimal = [str(k) for k in range(len(proto.pieces))]
        # The same model without normalisation: it takes what normalised() makes.
        spec = proto.normalizer_spec
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The text that is encoded and, for each byte of it and the end, the source byte that it came from."""
        source = text.encode("utf-8", "surrogatepass")
        data, place = aligned(source, self.map, self.whole)
        lead = 3 if self.norm.escape_whitespaces else 1
        if self.norm.remove_extra_whitespaces:  # runs of spaces become one, and none stands at either end
            view = np.frombuffer(data, np.uint8)
            space = view == 32
            stay = ~space | np.concatenate(([False], ~space[:-1]))[: len(space)]
            if len(space) and space[-1]:
                stay[np.flatnonzero(~space)[-1] + 1 if (~space).any() else 0 :] = False
            data, place = view[stay].tobytes(), np.append(place[:-1][stay], len(source))
        wide = np.where(np.frombuffer(data, np.uint8) == 32, lead, 1)
        place = np.concatenate((np.repeat(place[:-1], wide), place[-1:]))
        line = data.decode("utf-8", "surrogatepass")
        line = line.replace(" ", SPACE) if self.norm.escape_whitespaces else line
        if self.norm.add_dummy_prefix and line:
            dummy = SPACE if self.norm.escape_whitespaces else " "
            line = line + dummy if self.suffix else dummy + line
            place = np.append(place, [len(source)] * lead) if self.suffix else np.concatenate((place[:1], [place[0]] * (lead - 1), place))
        return line, place

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[np.ndarray]]:
        """Of each text the ids and the alignment."""
        every = [self.normalised(x) for x in texts]
        return self.plain.encode([x for x, _ in every], num_threads=1), [x for _, x in every]

    def ids(self, texts: list[str]) -> list[list[int]]:
        """The ids alone: where normalisation only escapes spaces, no alignment has to be recorded for them."""
        if not self.simple:
            return self.encode(texts)[0]
        dummy = SPACE if self.norm.add_dummy_prefix else ""
        lines = [x.replace(" ", SPACE) for x in texts]
        return self.plain.encode([x and (x + dummy if self.suffix else dummy + x) for x in lines], num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode(ids, num_threads=1) if ids else []

    def spans(self, line: str, ids: list[int], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The source bytes, start and end, of every piece; a piece made of an added space alone has none."""
        found = np.array(ids, np.int64)
        width = self.width[found]
        if not self.bytes and (found == self.unknown).any():  # the library says what an unknown piece stands for
            width = np.array([1 if self.kinds[i] == 6 else len(x.encode()) for i, x in zip(ids, self.plain.encode(line, out_type=str), strict=True)], np.int64)
        end = np.cumsum(width)
        return place[end - width], place[end]

    def simple_ends(self, text: str, ids: list[int]) -> np.ndarray:
        """Where each piece ends in the source, if normalisation only escapes the spaces and puts one before the text."""
        source = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        end = np.cumsum(self.width[ids])
        at = np.concatenate((np.zeros(3, np.int64), np.repeat(np.arange(len(source)), np.where(source == 32, 3, 1)), [len(source)]))
        return at[end]


def loaded(model_file: str) -> Pieces:
    """The worker's encoder."""
    return held(("pieces", model_file), lambda: Pieces(model_file))


def _full(model_file: str):
    kind = [pa.field(n, pa.list_(pa.int32())) for n in ("ids", "starts", "ends")] + [pa.field("decoded", pa.string())]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", TOGETHER):
            model, texts = loaded(model_file), [x or "" for x in part.column("text").to_pylist()]
            lines = [model.normalised(x) for x in texts]
            ids = model.plain.encode([x for x, _ in lines], num_threads=1)
            spans = [model.spans(line, x, place) for (line, place), x in zip(lines, ids, strict=True)]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
            flat = [np.fromiter(chain.from_iterable(ids), np.int32), *(np.concatenate([s[k] for s in spans]).astype(np.int32) for k in (0, 1))]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in flat]
            found = pa.StructArray.from_arrays([*lists, pa.array(model.decode(ids), pa.string())], fields=kind)
            yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, "pieces"])

    return run


PIECES = "struct<ids:array<int>,starts:array<int>,ends:array<int>,decoded:string>"


def encode(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """docs with a column ``pieces``: ids, each piece's source bytes (starts, ends) and the decoded text.

    One pass without a shuffle, in slices of about ``TOGETHER`` bytes of text.  Null texts count as empty and
    have no pieces; repeated rows each give a row; other columns stay as they are, but for one named
    ``pieces``, which the result replaces.  ``model_file`` is read by every Python worker.
    """
    from pyspark.sql import types as T

    docs = docs.drop("pieces")
    schema = T.StructType([*docs.schema.fields, T.StructField("pieces", T._parse_datatype_string(PIECES))])
    return docs.mapInArrow(_full(model_file or public_tokenizers.path(MODEL)), schema)


def _digest(model_file: str):
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ends_crc32", pa.int64())])

    def digested(column: pa.Array) -> pa.Array:
        rows = []
        for part in slices([pa.record_batch({"text": column})], "text", TOGETHER):
            model, texts = loaded(model_file), [x or "" for x in part.column("text").to_pylist()]
            every = model.ids(texts)
            for text, ids, decoded in zip(texts, every, model.decode(every), strict=True):
                if model.simple and model.bytes and model.norm.add_dummy_prefix and not model.suffix:
                    end = model.simple_ends(text, ids)
                else:
                    line, place = model.normalised(text)
                    end = model.spans(line, ids, place)[1]
                decimal = ",".join(map(model.decimal.__getitem__, ids))
                rows.append({"n_tokens": len(ids), "ids_sha256": hashlib.sha256(decimal.encode()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), "ends_crc32": zlib.crc32(end.astype("<u4").tobytes())})
        return pa.array(rows, kind)

    return digested


def digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """As encode(), but only digests of its columns leave the workers: the ids, the decoded text, and the ends of the pieces' spans."""
    return docs.withColumn("pieces", F.arrow_udf(_digest(model_file or public_tokenizers.path(MODEL)), "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,ends_crc32:bigint>")("text"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pieces.*")
