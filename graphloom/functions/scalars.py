"""Scalar functions on columns: identity, normalisation, paths, payloads.  All stay inside the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SPACE = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"
NOT_LINE_END = r"[^\n\r\u2028\u2029]*"
LANGUAGES = {
    "typescript": ("ts", "tsx", "mts", "cts"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "python": ("py",),
}
PAYLOADS = {"Function": "FunctionSummary", "Method": "FunctionSummary", "Class": "FunctionSummary", "Block": "Block"}
BYTES_PER_TOKEN = 3.5


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def hash_parts(*parts) -> Column:
    """Hexadecimal SHA-1 over the parts, each followed by a zero byte."""
    return F.sha1(F.concat(*(y for x in parts for y in (_col(x), F.lit("\0")))).cast("binary"))


def stable_id(repo, path, kind, qualified_name) -> Column:
    return F.concat(F.lit("sym_"), hash_parts(repo, path, kind, qualified_name))


def content_id(signature, body) -> Column:
    return F.concat(F.lit("cnt_"), hash_parts(signature, body))


def edge_hash(src, type_, dst) -> Column:
    return F.concat(F.lit("cnt_"), hash_parts(src, type_, dst))


def normalize_signature(x) -> Column:
    return F.trim(F.regexp_replace(_col(x), SPACE, " "))


def normalize_body(x) -> Column:
    """Without comments of three kinds, whatever the language, and with single spaces."""
    out = F.regexp_replace(_col(x), "//" + NOT_LINE_END, "")
    out = F.regexp_replace(out, r"/\*[\s\S]*?\*/", "")
    return normalize_signature(F.regexp_replace(out, "#" + NOT_LINE_END, ""))


def token_estimate(x) -> Column:
    return F.ceil(F.octet_length(_col(x)) / F.lit(BYTES_PER_TOKEN)).cast("long")


def strip_literal(x) -> Column:
    """A string literal's content, if both quotes are there and the same."""
    return F.regexp_replace(_col(x), r"""^(["'`])([\s\S]*)\1$""", "$2")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z0-9]+)$", 1))


def language_of(path) -> Column:
    """The language that a path's ending stands for; null for others."""
    found = None
    for language, endings in LANGUAGES.items():
        hit = extension(path).isin(*endings)
        found = F.when(hit, language) if found is None else found.when(hit, language)
    return found


def safe_id(prefix: str, name) -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(_col(name), r"[^A-Za-z0-9_./@-]", "_"))


def strip_version(spec) -> Column:
    """A requirement's name, without extras and version."""
    return F.regexp_extract(_col(spec), r"^[A-Za-z0-9_.\-]+", 0)


def payload_kind(kind) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in PAYLOADS.items() for x in pair)), _col(kind))


def payload_text(qualified_name, signature) -> Column:
    return F.concat_ws("\n", _col(qualified_name), _col(signature))


def citation(path, start, end) -> Column:
    return F.concat(_col(path), F.lit(":"), _col(start).cast("string"), F.lit("-"), _col(end).cast("string"))


def name_tail(qualified_name) -> Column:
    """What follows the last ``::``, so that looking up a suffix is an equi-join."""
    return F.substring_index(_col(qualified_name), "::", -1)


def line_range(text, start, end) -> Column:
    """Lines start to end (from 1, both included, cut to what there is), joined by newlines; empty if there are none."""
    lines = F.split(_col(text), "\r?\n", -1)
    low = F.greatest(_col(start), F.lit(1))
    high = F.least(_col(end), F.size(lines))
    return F.coalesce(F.when(high >= low, F.array_join(F.slice(lines, low, F.greatest(high - low + 1, F.lit(0))), "\n")), F.lit(""))


def resolve_import(path, specifier) -> Column:
    """The file that a relative import of TypeScript or JavaScript means, or null: bare, extensionless, or beyond the root.

    Segments are folded from the left; endings of JavaScript lead to those of TypeScript.
    """
    path, specifier = _col(path), _col(specifier)
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")
    parts = F.filter(F.split(F.concat(folder, F.lit("/"), specifier), "/"), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def step(state: Column, part: Column) -> Column:
        up = part == ".."
        empty = F.size(state["at"]) == 0
        at = F.when(up & ~empty, F.slice(state["at"], 1, F.greatest(F.size(state["at"]) - 1, F.lit(0)))).when(up, state["at"]).otherwise(F.concat(state["at"], F.array(part)))
        return F.struct(at.alias("at"), (state["out"] | (up & empty)).alias("out"))

    folded = F.aggregate(parts, start, step)
    joined = F.array_join(folded["at"], "/")
    known = specifier.rlike(r"^\.\.?/") & ~folded["out"] & specifier.rlike(r"\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$")
    return F.when(known, F.regexp_replace(joined, r"\.([mc]?)js(x?)$", ".$1ts$2"))


def hash_embedding(text, dim: int = 1024) -> Column:
    """Slot i: the first 32 bits of the SHA-256 of text, zero byte and i, spread over -1 to 1."""
    text = _col(text)
    slot = lambda i: F.conv(F.substring(F.sha2(F.concat(text, F.lit("\0"), i.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0) * F.lit(2.0) - F.lit(1.0)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), slot)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine over the shorter length; 0 if either vector is all zeros there."""
    a, b = _col(a), _col(b)
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def distance_score(a, b, metric: str = "l2") -> Column:
    """1 / (1 + distance), the distance being plain (l2) or squared (l2sq) Euclidean."""
    a, b = _col(a), _col(b)
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric not in ("l2", "l2sq"):
        raise ValueError(f"unknown metric {metric}")
    return 1 / (1 + (F.sqrt(square) if metric == "l2" else square))


def jaccard(a, b) -> Column:
    """Of the lower-cased words of two texts; 0 if both have none."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(_col(x)), r"\s+"), lambda w: w != ""))
    both = F.size(F.array_union(words(a), words(b)))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(words(a), words(b))) / both)


def identifiers(query) -> Column:
    """The words of a query that could be names, in order, repeats included."""
    return F.filter(F.split(_col(query), r"\s+"), lambda w: w.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"))


def folded_tree_hash(files) -> str:
    """One hash over all files' paths and text hashes, in path order.

    Files are hashed where they are and sorted by range; the driver takes one partition of paths and hashes
    at a time and folds them, so nothing is gathered.
    """
    rows = files.select("path", F.sha1(F.col("text").cast("binary")).alias("hash")).orderBy("path")
    fold = hashlib.sha1()
    for row in rows.toLocalIterator():
        fold.update(f"{row['path']}\0{row['hash']}\0".encode())
    return f"cnt_{fold.hexdigest()}"


def checksum(nodes, edges, vectors) -> Column:
    return F.sha2(F.concat(*(y for x in (nodes, edges, vectors) for y in (_col(x).cast("string"), F.lit("\0")))).cast("binary"), 256)
