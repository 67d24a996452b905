"""URL filter: prefix rules first, then a blocked Bloom filter of listed canonical URLs with an exact join behind it.

The filter's blocks are rows of a table (eight 64-bit words, one bit set in each per URL), built by a
group-by on the block and probed by a join on it; what passes is joined with the list itself, which
removes the false positives.  Nothing is broadcast unless its size is known to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed by the contract: verdict, and host with path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Fixed by this filter: words in a host's name whose pages are listed where no list is given.
HOST_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")
_LISTED = rf"(^|[.-])({'|'.join(HOST_WORDS)})([.-]|$)"

WORDS = 8
#: Bits of the filter for each listed URL, and the size of a filter that may be broadcast.
BITS, BROADCAST_BYTES = 16, 8 << 20
#: Parts in which the rows of one URL are joined.
SALTS = 8


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The rule that fits with the longest host and path (of equally long ones the first in code order), and its verdict; else null.

    The rules become one expression, so their number should stay in the hundreds.
    """
    rule = verdict = None
    for what, name in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        at, start = name.partition("/")[0], "/" + name.partition("/")[2]
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule = F.when(fits, F.lit(name)) if rule is None else rule.when(fits, F.lit(name))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def canonical(host: Column, path: Column) -> Column:
    """One spelling for what is most likely the same page.

    The host loses user data, port, final dots and ``www.``/``m.``; the path loses doubled slashes, a file
    ending or index page and final slashes.  Scheme, query and fragment don't count.
    """
    h = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    p = F.regexp_replace(F.regexp_replace(path, r"//+", "/"), r"(/index)?\.(html?|php|aspx?)$", "")
    return F.concat(F.regexp_replace(h, r"^(www|m)\.", ""), F.regexp_replace(p, r"/+$", ""))


def _bit(url: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(F.lit(word), url), 58).cast("int"))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), url), F.lit(blocks))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of column ``url``: block, w0 to w7.  Combined on the map side, so repeated URLs cost nothing."""
    url = F.col("url")
    rows = listed.select(_block(url, blocks).alias("block"), *(_bit(url, k).alias(f"w{k}") for k in range(WORDS)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))


def hits(urls: DataFrame, listed: DataFrame, bits: int = BITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Those of the distinct ``url`` that are listed: what passes the filter, joined with the list."""
    listed = listed.filter("url IS NOT NULL").select("url").distinct()
    blocks = max(1, -(-listed.count() * bits // (64 * WORDS)))
    table_ = bloom(listed, blocks)
    table_ = F.broadcast(table_) if blocks * 8 * (WORDS + 1) <= broadcast_bytes else table_
    url = F.col("url")
    probe = urls.select("url").distinct().withColumn("block", _block(url, blocks))
    passed = None
    for k in range(WORDS):
        one = F.col(f"w{k}").bitwiseAND(_bit(url, k)) != 0
        passed = one if passed is None else passed & one
    return probe.join(table_, "block").filter(passed).select("url").join(listed.hint("shuffle_hash"), "url", "left_semi")


def filtered(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, listed: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, verdict and listed.

    A rule's verdict stands.  Pages without a rule are blocked if their canonical URL is listed: by
    ``listed`` (a table with a column ``url`` of canonical URLs), or else as the canonical URL of a page that a
    rule blocks or whose host is named by a word of ``HOST_WORDS`` - rules compare spellings, so another
    spelling of such a page (a port, a final dot, user data) slips by them and is caught here.  Null urls and
    urls without ``://`` have neither host nor path and are allowed; repeated rows each give a row; other
    columns stay, but for names that the result uses.  Only pages without a rule are joined with the hits, a
    page that very many rows have in ``SALTS`` parts.
    """
    out = ("host", "path", "rule", "verdict", "listed")
    row = pages.select(F.struct(*(c for c in pages.columns if c not in out)).alias("_row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = judged(F.col("host"), F.col("path"), rules)
    row = row.withColumns({"rule": rule, "_verdict": verdict, "_url": F.when(F.col("host") != "", canonical(F.col("host"), F.col("path")))})
    if listed is None:
        listed = row.filter((F.col("_verdict") == "block") | F.col("host").rlike(_LISTED)).select(F.col("_url").alias("url"))
    waits = F.col("_verdict").isNull() & F.col("_url").isNotNull()
    hit = hits(row.filter(waits).select(F.col("_url").alias("url")), listed).select(F.col("url").alias("_url"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("_hit"))
    found = row.filter(waits).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(hit, ["_url", "_salt"], "left").withColumn("listed", F.coalesce("_hit", F.lit(False)))
    row = row.filter(~waits).withColumn("listed", F.lit(False)).unionByName(found.drop("_salt", "_hit"))
    row = row.withColumn("verdict", F.coalesce("_verdict", F.when(F.col("listed"), "block").otherwise("allow")))
    return row.select("_row.*", "host", "path", "rule", "verdict", "listed")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "listed")


SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (
  SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                 WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                 WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM p),
v AS (
  SELECT *, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled,
         CASE WHEN host <> '' THEN
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', ''), '^(www|m)\.', '') ||
           regexp_replace(regexp_replace(regexp_replace(path, '//+', '/', 'g'), '(/index)?\.(html?|php|aspx?)$', ''), '/+$', '') END AS url
  FROM j),
l AS (SELECT DISTINCT url FROM v WHERE (ruled = 'block' OR regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)')) AND url IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN l.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, ruled IS NULL AND l.url IS NOT NULL AS listed
FROM v LEFT JOIN l ON v.url = l.url
"""
