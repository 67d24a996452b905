"""Quality rules, line first: failing lines are removed, and a document that loses too much text is rejected.

DataFrame functions only.  Everything about a document is computed within its own row, so there is no
shuffle, and neither repeated documents nor a hot source can make one task larger than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed by the contract.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 10, 20

#: A line fails if it doesn't end a sentence,
ENDING = r"[.!?:;,)\]\"'»”’…。！？][\x20\x09-\x0D]*\z"
#: if more than this share (per cent) of its words carry symbols, menu separators or piled-up marks,
MARKS = r"[#*$%&|<>»›•·]+|!!+|\?\?+"
MOST_MARKS = 20
#: or if it is one of the phrases that sites put on every page.
BOILERPLATE = (
    r"[Cc]ookies?\b|[Jj]ava[Ss]cript|[Aa]ll [Rr]ights [Rr]eserved|[Pp]rivacy [Pp]olicy|[Tt]erms (of|and) (use|Use|service|Service|conditions|Conditions)"
    r"|[Ss]ubscribe|[Ss]ign (in|up)\b|[Ll]og ?in\b|[Ll]icensed under|[Cc]opyright|©|[Ll]orem ipsum|[Cc]lick here|[Rr]ead more|[Ss]kip to (content|main)"
)
#: A document is rejected if its failing lines hold more than this share (per cent) of its words' characters.
MOST_LOST = 40


def _chars(text: Column) -> Column:
    """Code points outside white space."""
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def _bad(line: Column) -> Column:
    words = F.regexp_count(line, F.lit(WORD))
    return ~line.rlike(ENDING) | (100 * F.regexp_count(line, F.lit(MARKS)) > MOST_MARKS * words) | line.rlike(BOILERPLATE)


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars (characters of failing lines), base_failed and kept.

    Null and empty texts have no words and fail; repeated rows each give a row; other columns stay, but for
    names that the result uses.
    """
    names = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")]
    text = F.coalesce(F.col("text"), F.lit(""))
    row = docs.select(F.struct(*names).alias("_row"), text.alias("_text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("_words") - 5), lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(5))))
    row = row.withColumn("_hashes", F.when(F.size("_words") >= 5, hashes))
    # Windows are looked at one by one only where two of a document have the same hash.
    window = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), F.array_join(F.slice("_words", i + 1, 5), " ").alias("w"), i.alias("i")))
    row = row.withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.array_sort(window)))
    same = lambda x, y: (x["h"] == y["h"]) & (x["w"] == y["w"])
    twice = F.filter("_sorted", lambda x, j: F.coalesce(F.when(j > 0, same(x, F.get("_sorted", j - 1))), F.lit(False)) | F.coalesce(same(x, F.get("_sorted", j + 1)), F.lit(False)))
    row = row.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda s, p: F.struct((p + 5).alias("end"), (s["n"] + p + 5 - F.greatest(s["end"], p)).alias("n")))["n"]
    row = row.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.aggregate(F.transform(F.filter("_lines", _bad), _chars), F.lit(0), lambda s, x: s + x).cast("long").alias("lost_chars"),
    )
    row = row.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    row = row.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars")))
    return row.select("_row.*", *row.columns[1:])


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their failing lines; lines without a word stay where they are."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~_bad(x))
    return measured(docs).filter("kept").withColumn("text", F.array_join(lines, "\n")).select(*docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")


_SQL_WORD, _SQL_SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, k, t, regexp_extract_all(t, '{_SQL_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT k, i, list_slice(w, i, i + 4) AS win FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT k, unnest(list(i)) AS i FROM win GROUP BY k, win HAVING count(*) > 1),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY k),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{SYMBOL}'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(list_sum(list_transform(list_filter(lines, lambda x: NOT regexp_matches(x, '{ENDING.replace("'", "''")}')
           OR 100 * len(regexp_extract_all(x, '{MARKS}')) > {MOST_MARKS} * len(regexp_extract_all(x, '{_SQL_WORD}'))
           OR regexp_matches(x, '{BOILERPLATE}')), lambda x: length(regexp_replace(x, '{_SQL_SPACE}', '', 'g')))), 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN rep USING (k)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND 100 * lost_chars <= {MOST_LOST} * word_chars AS kept FROM b
"""
