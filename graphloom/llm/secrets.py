"""Secret scan with multipart credential linking.

Strong findings (assignments, access keys, long hexadecimal strings) stand alone.  Weak candidates -
short account names, unlabelled random-looking strings, endpoints - say nothing by themselves; they are
reported only where the parts that would complete a credential occur within the same scope:

- ``ident``    (an account or client name, or an e-mail address) beside any secret,
- ``opaque``   (an unlabelled random-looking string) beside any access identifier,
- ``endpoint`` (a URL, host:port or IPv4 address) beside an access identifier and a secret.

A scope is a block of text without an empty line; a part reaches all of it.  Parts join by their intervals: the
complement starts in the candidate's scope and overlaps it nowhere, found by binary search among sorted
positions, document by document.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
BASE = KINDS[:3]

# Fixed by the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 6
#: Runs of the contract's classes that are long enough (20 and 24 characters in all).
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

IDENT = re.compile(r"""(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})""", re.ASCII | re.IGNORECASE)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]+|(?<![A-Za-z0-9.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}(?![0-9])""", re.ASCII)
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.ASCII)
ADDRESS = re.compile(r"(?<![0-9A-Za-z.:/@-])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?(?![0-9A-Za-z]|\.[0-9])", re.ASCII)
BLANK = re.compile(r"\n[ \t\r]*\n")
_LABELS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAMES = ("user", "login", "account", "client", "access")
_WORDY = re.compile(r"[A-Z][a-z]+|[a-z]+|[A-Z]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the strong findings; a kind's matches are leftmost and don't overlap."""
    out = []
    low = text.lower()
    if any(x in low for x in _LABELS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def random_looking(value: str) -> bool:
    """Digits and letters mixed, and no long run of letters in one case such as words have."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and max(map(len, _WORDY.findall(value)), default=0) <= 7


def weak_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the weak candidates, each span of a kind once."""
    out = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        out += [(m.start(1), 3, m.end(1)) for m in IDENT.finditer(text)]
    out += [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text) if random_looking(m.group())]
    if "@" in text:
        out += [(m.start(), 3, m.end()) for m in EMAIL.finditer(text)]
    if ":" in text:
        out += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    out += [(m.start(), 5, m.end()) for m in ADDRESS.finditer(text)]
    return sorted(set(out))


def linked(text: str, base: list[tuple[int, int, int]], weak: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The weak candidates that complementary parts complete, each found by two binary searches in the sorted parts.

    Weak candidates that overlap a strong finding are left out: that finding reports them already.
    """
    strong = sorted((s, e) for s, _, e in base)
    starts, ends = [s for s, _ in strong], []
    for _, e in strong:
        ends.append(max(e, ends[-1] if ends else 0))
    free = []
    for s, kind, e in weak:
        k = bisect_left(starts, e) - 1
        if k < 0 or ends[k] <= s:
            free.append((s, kind, e))
    if not free:
        return []
    cuts = [m.start() for m in BLANK.finditer(text)]

    def kept(kinds: set[int]) -> tuple[list[tuple[int, int]], list[int]]:
        """The parts of these kinds by start, and the least end from each on."""
        parts = sorted((s, e) for s, k, e in [*base, *free] if k in kinds)
        ends = [e for _, e in parts]
        for k in range(len(ends) - 2, -1, -1):
            ends[k] = min(ends[k], ends[k + 1])
        return parts, ends

    identifiers, secrets = kept({1, 3}), kept({0, 2, 4})

    def near(found: tuple[list[tuple[int, int]], list[int]], start: int, end: int) -> bool:
        parts, least = found
        k = bisect_right(cuts, start)
        low, high = cuts[k - 1] if k else 0, cuts[k] if k < len(cuts) else len(text)
        at = bisect_left(parts, (end, 0))
        if at < len(parts) and parts[at][0] < high:
            return True
        before = bisect_left(parts, (low, 0))  # those that end before the candidate also start before it
        return before < len(parts) and least[before] <= start

    asks = {3: (secrets,), 4: (identifiers,), 5: (identifiers, secrets)}
    return [(s, kind, e) for s, kind, e in free if all(near(parts, s, e) for parts in asks[kind])]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Strong spans and all spans of a text, by start and then kind."""
    base = base_spans(text)
    weak = weak_spans(text)
    if weak and (base or len(weak) > 1):
        return sorted(base), sorted(base + linked(text, base, weak))
    return sorted(base), sorted(base)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SECRETS = pa.struct(
    [*((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_linked", pa.int64()), ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]
)
SECRETS_DDL = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string,n_linked:bigint,found:array<struct<kind:string,start:int,end:int>>>"


def _scanned(column: pa.Array) -> pa.Array:
    rows = []
    for text in column:
        base, spans = scan(text.as_py() or "")
        row = {f"n_{k}": sum(x[1] == i for x in base) for i, k in enumerate(BASE)}
        rows.append(row | {"base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(spans), "n_linked": len(spans) - len(base), "found": [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]})
    return pa.array(rows, SECRETS)


def find(docs: DataFrame) -> DataFrame:
    """docs with a column ``secrets``: counts, digest and the spans (code points, end exclusive).

    One pass without a shuffle; each text is scanned whole.  Null and empty texts have no spans, repeated
    rows each give a row, rows without a doc_id are treated like others, and other columns stay as they are,
    but for one named ``secrets``, which the result replaces.
    """
    return docs.withColumn("secrets", F.arrow_udf(_scanned, SECRETS_DDL)("text"))


def _redacted(column: pa.Array) -> pa.Array:
    out = []
    for text in column:
        text = text.as_py()
        if text:
            done, parts = 0, []
            for s, k, e in scan(text)[1]:
                if e > done:
                    parts += [text[done : max(s, done)], f"[{KINDS[k]}]"] if s >= done else []
                    done = e
            text = "".join([*parts, text[done:]])
        out.append(text)
    return pa.array(out, pa.string())


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each reported span replaced by its kind in brackets; where spans overlap, the first names them all."""
    return docs.withColumn("text", F.arrow_udf(_redacted, "string")("text"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked")))
