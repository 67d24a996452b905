"""Benchmark decontamination: one Aho-Corasick automaton over all test items, each text scanned once.

The windows of an item overlap, so the automaton holds its blocks instead: every seventh word, seven words
together.  A window of 13 words has such a block whole, wherever it starts; where a text has a block, the match
grows to both sides, word by word, as far as the item goes along.  If 13 words or more are alike, all of them are
inside windows that occur.  So the automaton has about a node for each byte of the items, not thirteen.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, table

#: Fixed by the contract: what a word is (after A-Z are lower-cased) and how many words make a window.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Bytes of item texts that are sent to the workers at most; the automaton takes some forty times as much in each.
ITEM_BYTES = 16 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_WORD = re.compile(WORD)


def words_of(text: str) -> list[bytes]:
    """The words of a text, lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Scanner:
    """The automaton over (item id, text) rows; texts are matched byte by byte, as Latin-1 strings."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        self.size, block = size, (size + 1) // 2
        self.items = [(name, words) for name, text in dict.fromkeys(items) if (words := words_of(text))]
        #: Of each pattern the items that it is the whole of, and the items and places where it is a block.
        wholes: dict[bytes, set[str]] = defaultdict(set)
        blocks: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (name, words) in enumerate(self.items):
            if len(words) < size:
                wholes[b" ".join(words)].add(name)
            for at in range(0, len(words) - block + 1 if len(words) >= size else 0, block):
                blocks[b" ".join(words[at : at + block])].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for pattern in wholes.keys() | blocks.keys():
            key = f" {pattern.decode('latin-1')} "
            self.automaton.add_word(key, (len(key), pattern.count(b" ") + 1, wholes.get(pattern, ()), blocks.get(pattern, ())))
        self.any = bool(self.items)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[str]]:
        """Which words are hit (None: none), and the items found."""
        if not self.any or not words:
            return None, set()
        line = b" %b " % b" ".join(words)
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return None, set()
        before = np.cumsum(np.frombuffer(line, np.uint8) == 32)
        step, names = np.zeros(len(words) + 1, np.int64), set()
        done: dict[tuple[int, int], int] = {}  # of an item laid along the text: up to which word it is compared
        for end, (length, count, wholes, blocks) in found:
            first = int(before[end - length + 1]) - 1
            if wholes:
                step[first] += 1
                step[first + count] -= 1
                names.update(wholes)
            for k, at in blocks:
                if first < done.get((k, first - at), 0):
                    continue
                name, item = self.items[k]
                low, high = 0, count
                while at + low > 0 and first + low > 0 and item[at + low - 1] == words[first + low - 1]:
                    low -= 1
                while at + high < len(item) and first + high < len(words) and item[at + high] == words[first + high]:
                    high += 1
                done[k, first - at] = first + high
                if high - low >= self.size:
                    step[first + low] += 1
                    step[first + high] -= 1
                    names.add(name)
        return (np.cumsum(step[:-1]) > 0, names) if names else (None, names)


def runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last index of each run of true values."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


FOUND = "struct<n_words:bigint,words:array<struct<first:int,end:int>>,spans:array<struct<start:int,end:int>>,items:array<string>>"


def _scan(token: str, sent, size: int):
    def found(texts: pa.Array) -> pa.Array:
        scanner, rows = held(("decontaminate", token), lambda: Scanner(sent.value, size)), []
        for text in texts:
            text = text.as_py() or ""
            words = words_of(text)
            hit, items = scanner.scan(words)
            row = {"n_words": len(words), "words": [], "spans": [], "items": sorted(items)}
            if hit is not None:
                first, end = runs(hit)
                place = [m.span() for m in _WORD.finditer(text.translate(_UPPER))]
                row["words"] = [{"first": int(a), "end": int(b)} for a, b in zip(first, end, strict=True)]
                row["spans"] = [{"start": place[a][0], "end": place[b - 1][1]} for a, b in zip(first, end, strict=True)]
            rows.append(row)
        pair = lambda a, b: pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())]))
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("words", pair("first", "end")), ("spans", pair("start", "end")), ("items", pa.list_(pa.string()))]))

    return found


def find(docs: DataFrame, items: DataFrame, size: int = WINDOW, item_bytes: int = ITEM_BYTES, text: str = "text") -> DataFrame:
    """docs with a column ``found``: n_words, the hit runs of words, their spans in the original text (code points) and the items.

    The items make one automaton, which every Python worker builds once, and each text is scanned once; no
    shuffle.  The items' size is looked at before they are sent: it doesn't grow with the corpus, and beyond
    ``item_bytes`` it is an error, not another result.  Null texts have no words; empty items have no windows;
    repeated rows of an item count once; an item without an id counts under the name ``null``; repeated
    documents each give a row; other columns stay, but for one named ``found``, which the result replaces.
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("item_text")).distinct()
    size_now = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    if size_now > item_bytes:
        raise ValueError(f"{size_now} bytes of items; the automaton is built for up to {item_bytes}: raise item_bytes if workers have the memory")
    sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in items.collect()])
    return docs.withColumn("found", F.arrow_udf(_scan(uuid.uuid4().hex, sent, size), FOUND)(text))


def verdicts(found: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated beside the columns of find(); columns of these names are replaced."""
    n_hit = F.aggregate("found.words", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"])
    out = {"n_words": F.col("found.n_words"), "n_hit": n_hit, "n_items": F.size("found.items").cast("long"), "items_sha256": F.sha2(F.array_join("found.items", ","), 256)}
    return found.withColumns(out).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    row = docs.select(F.struct(*docs.columns).alias("row"))
    return verdicts(find(row, items, text="row.text")).filter(~F.col("contaminated")).select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return verdicts(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN iw USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
