"""Source text to declarations, calls, imports and blocks.

Regular-expression declarations stay in the JVM.  Parsed ones are table functions over whole files:
Python by its own ``ast`` module, TypeScript and JavaScript by a scanner that blanks out strings, comments
and regular expressions and then matches brackets.  Names are resolved by joins afterwards.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: A body beyond either is cut into blocks.
BLOCK_LINES, BLOCK_TOKENS = 60, 512

# What starts a declaration.  (?d): only a newline ends a line.
DECLARATIONS = {
    "ts": (("Function", r"(?dm)^(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*(\([^)]*\))"), ("Class", r"(?dm)^(?:export\s+)?class\s+([A-Za-z_$][\w$]*)()")),
    "py": (("Function", r"(?dm)^def\s+([A-Za-z_]\w*)\s*(\([^)]*\))"), ("Class", r"(?dm)^class\s+([A-Za-z_]\w*)()")),
}


def file_nodes(files: DataFrame, repo: str) -> DataFrame:
    """One node for each file(path, language, text): its lines are its newlines and one."""
    end = F.greatest(F.lit(1), F.size(F.split("text", "\n", -1)))
    return files.select(S.stable_id(F.lit(repo), "path", F.lit("File"), "path").alias("id"), "path", F.lit("File").alias("kind"), "language", F.col("path").alias("qn"), F.lit("").alias("signature"), F.lit(1).alias("start"), end.alias("end"), S.content_id(F.lit(""), S.normalize_body("text")).alias("content_hash"))


def regex_declarations(files: DataFrame, repo: str) -> DataFrame:
    """Functions and classes that start a line, with the line: the newlines between matches and in them are counted up, file by file."""
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n")))
    found = None
    for family, rules in DECLARATIONS.items():
        rows = files.filter(F.col("language") == "python" if family == "py" else F.col("language").isin("typescript", "javascript"))
        for place, (kind, pattern) in enumerate(rules):
            whole, name, params = (F.regexp_extract_all("text", F.lit(pattern), F.lit(k)) for k in range(3))
            between = F.split("text", pattern, -1)
            part = rows.select("path", "language", F.arrays_zip(name.alias("name"), params.alias("params"), F.transform(between, newlines).alias("before"), F.transform(whole, newlines).alias("inside")).alias("_x"), F.size(name).alias("_n"))
            part = part.filter("_n > 0").select("path", "language", F.posexplode(F.slice("_x", 1, F.col("_n"))).alias("_i", "_x")).select("path", "language", F.lit(kind).alias("kind"), F.lit(place).alias("_place"), "_i", "_x.*")
            found = part if found is None else found.union(part)
    before = Window.partitionBy("path", "kind").orderBy("_i")
    line = F.lit(1) + F.sum("before").over(before) + F.sum("inside").over(before) - F.col("inside")
    found = found.withColumn("start", line.cast("int"))
    qn = F.concat("path", F.lit("::"), "name")
    signature = F.concat("name", "params")
    return found.select(S.stable_id(F.lit(repo), "path", "kind", qn).alias("id"), "path", "kind", "language", qn.alias("qn"), signature.alias("signature"), "start", F.col("start").alias("end"), S.content_id(S.normalize_signature(signature), S.normalize_body(signature)).alias("content_hash"), (F.col("_place") * 1_000_000 + F.col("_i") + 1).alias("turn"))


# --- scanners: rows (what, kind, name, owner, signature, start, end, body, target) in order -----------------

ROW = "path string, language string, what string, kind string, name string, owner string, signature string, start int, end int, body string, target string, turn int"

_ROW = pa.schema([(c.split(" ")[0], pa.string() if c.endswith("string") else pa.int32()) for c in ROW.split(", ")])

_TS_SKIP = re.compile(r"""//[^\n]*|/\*[\s\S]*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:!&|?{};\n])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/[a-z]*""")
_TS_DECL = re.compile(r"(?<![\w$.])(?:(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\s*\(|(?<!abstract\s)class\s+([A-Za-z_$][\w$]*)[^{]*\{)")
_TS_METHOD = re.compile(r"(?:^|[;{}\n])\s*(?:(?:public|private|protected|static|override|readonly|async|get|set)\s+)*(#?[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\s*\(")
_TS_CALL = re.compile(r"(?<![\w$.])(?:this\.([A-Za-z_$][\w$]*)|([A-Za-z_$][\w$]*))\s*\(")
_TS_IMPORT = re.compile(r"""(?m)^[ \t]*(?:import\s+(?:[^"';]*?\sfrom\s*)?|export\s+[^"';]*?\sfrom\s*)(["'])([^"'\n]+)\1""")
_TS_NOT_CALLS = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "super", "await", "new", "constructor", "import", "do", "else", "void", "delete", "in", "of", "instanceof"}
# The kinds of blocks in both languages.
_TS_BLOCKS = re.compile(r"(?<![\w$.#])(?:(if|else|for|while|do|switch|try|catch|finally)\b(?!\s*:)|(?:async\s+)?(function)\b(?!\s*\*)|(?<!abstract\s)(class)\b(?!\s*:))|(=>)")
_TS_KINDS = {"if": "if_statement", "else": "else_clause", "while": "while_statement", "switch": "switch_statement", "try": "try_statement", "catch": "catch_clause", "finally": "finally_clause"}
_TS_PARAMETERS = re.compile(r"(?:(?<![\w$.])async\s*)?(?:<[^<>()]*>\s*)?(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)(?:\s*:[^=;{}()]+)?|(?<![\w$.])[A-Za-z_$][\w$]*)\s*$")
_PY_BLOCKS = {"If": "if_statement", "For": "for_statement", "AsyncFor": "for_statement", "While": "while_statement", "Try": "try_statement", "TryStar": "try_statement", "With": "with_statement", "AsyncWith": "with_statement", "Match": "match_statement", "ExceptHandler": "except_clause", "match_case": "case_clause", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition"}


def blanked(text: str) -> str:
    """The text with strings, comments and regular expressions as spaces; newlines and lengths stay."""
    return _TS_SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


@lru_cache(maxsize=4)
def _brackets(text: str) -> dict[int, int]:
    """Where each bracket that opens closes; the kinds are matched apart from each other, in one pass."""
    opened: dict[str, list[int]] = {"(": [], "{": [], "[": []}
    kinds, found = {")": "(", "}": "{", "]": "["}, {}
    for m in re.finditer(r"[(){}\[\]]", text):
        if m.group() in opened:
            opened[m.group()].append(m.start())
        elif stack := opened[kinds[m.group()]]:
            found[stack.pop()] = m.start()
    return found


@lru_cache(maxsize=4)
def _places(text: str, char: str) -> list[int]:
    return [m.start() for m in re.finditer(re.escape(char), text)]


def closing(text: str, at: int, pair: str) -> int:
    """Where the bracket that opens at this place, or next, closes (the end, if it doesn't)."""
    if not 0 <= at < len(text) or text[at] != pair[0]:
        at = text.find(pair[0], max(at, 0))
    return _brackets(text).get(at, len(text) - 1)


def _too_long(body: str) -> bool:
    return body.count("\n") + 1 > BLOCK_LINES or -(-len(body.encode()) * 2 // 7) > BLOCK_TOKENS


def _after(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _before(text: str, at: int, place: int) -> int:
    """The last place before this one, but not before ``at``, that isn't white space."""
    place -= 1
    while place >= at and text[place].isspace():
        place -= 1
    return place


def _expression_end(text: str, at: int, stops: str = ";") -> int:
    """The last place of an expression: before a stop, a bracket that closes around it, or a line's end that nothing carries on."""
    depth, last = 0, at
    for k in range(at, len(text)):
        c = text[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return last
        elif not depth and c in stops:
            return k if c == ";" else last
        elif not depth and c == "\n" and k > at and text[last] not in "=+-*/%&|?:,<>!^~(." and text[_after(text, k) : _after(text, k) + 1] not in set(".?:+-*/%&|=,<>^(["):
            return last
        if not c.isspace():
            last = k
    return last


def _statement_end(text: str, at: int) -> int:
    """The last place of the statement that starts here, in blanked text."""
    at = _after(text, at)
    if text[at : at + 1] == "{":
        return closing(text, at, "{}")
    m = re.compile(r"(if|for|while|do|switch|try)\b(?:\s+await\b)?").match(text, at)
    if not m:
        return _expression_end(text, at)
    at = _after(text, m.end())
    if m.group(1) == "do":
        end = _statement_end(text, at)
        m = re.compile(r"\s*while\s*(?=\()").match(text, end + 1)
        return closing(text, m.end(), "()") if m else end
    if m.group(1) != "try":
        at = closing(text, at, "()") + 1
    end = _statement_end(text, at)
    more = {"if": r"\s*else\b", "try": r"\s*(?:catch\s*(?:\((?:[^()]|\([^()]*\))*\))?|finally)(?=\s*\{)"}.get(m.group(1))
    while more and (x := re.compile(more).match(text, end + 1)):
        end = _statement_end(text, x.end())
    return end


def _ts_blocks(text: str, at: int, end: int) -> list[tuple[int, int, str]]:
    """(first place, last place, type) of the blocks between two places of blanked text, outer ones first."""
    found, tails = [], set()
    for m in _TS_BLOCKS.finditer(text, at, end):
        start, word = m.start(), m.group(1)
        last_char = _before(text, at, start)
        before = text[last_char : last_char + 1] if last_char >= at else ""
        if word == "do":
            last = _statement_end(text, m.end())
            if x := re.compile(r"\s*(?=while\b)").match(text, last + 1):
                tails.add(x.end())
        elif word == "for":
            head = text.find("(", start)
            heading = text[head : closing(text, head, "()") + 1]
            flat = re.sub(r"\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\]|\{[^}]*\}", "", heading[1:-1])
            found.append((start, _statement_end(text, start), "for_in_statement" if ";" not in flat and re.search(r"\s(?:of|in)\b|\b(?:of|in)\s", flat) else "for_statement"))
        elif word in ("else", "finally"):
            found.append((start, _statement_end(text, m.end()), _TS_KINDS[word]))
        elif word == "catch":
            k = _after(text, m.end())
            k = closing(text, k, "()") + 1 if text[k : k + 1] == "(" else k
            if before == "}" and text[_after(text, k) : _after(text, k) + 1] == "{":
                found.append((start, _statement_end(text, k), _TS_KINDS[word]))
        elif word and start not in tails:
            found.append((start, _statement_end(text, start), _TS_KINDS[word]))
        elif m.group(2) or m.group(3):
            own_line = "\n" in text[last_char + 1 : start] and before not in set("=(,:?[!&|+-~>")
            declared = not before or before in "{};" or own_line
            opened = closing(text, text.find("(", start), "()") if m.group(2) else start
            if declared == bool(m.group(3)):
                found.append((start, closing(text, text.find("{", opened), "{}"), "class_declaration" if m.group(3) else "function_expression"))
        elif m.group(4):
            p = _TS_PARAMETERS.search(text, at, start)
            lead = text[at : p.start()].rstrip() if p else ""
            typed = re.search(r"\b(?:type\s+[\w$]+(?:<[^=]*>)?\s*=|(?:const|let|var)\s+[\w$]+\s*:)$", lead) or lead.endswith(":") and _inside(text, at, p.start()) == "("
            if p and not typed:
                k = _after(text, m.end())
                last = closing(text, k, "{}") if text[k : k + 1] == "{" else _expression_end(text, k, ";,")
                found.append((p.start(), last, "arrow_function"))
    return sorted(found, key=lambda x: (x[0], -x[1]))


def _inside(text: str, at: int, place: int) -> str:
    """The bracket that is open last before a place."""
    opened: list[str] = []
    for c in text[at:place]:
        if c in "([{":
            opened.append(c)
        elif c in ")]}" and opened:
            opened.pop()
    return opened[-1] if opened else ""


def scan_ts(text: str) -> Iterator[dict]:
    plain = blanked(text)
    newlines, opened, closed = (_places(plain, c) for c in "\n{}")
    line = lambda at: bisect_left(newlines, at) + 1
    for m in _TS_IMPORT.finditer(text):
        if bisect_left(opened, m.start(2) - 1) <= bisect_left(closed, m.start(2) - 1) or "}" in m.group():
            yield {"what": "import", "target": m.group(2), "start": line(m.start()), "end": line(m.end())}

    def function(kind: str, name: str, owner: str | None, start: int, paren: int) -> Iterator[dict]:
        close = closing(plain, paren, "()")
        brace = plain.find("{", close)
        end = closing(plain, brace, "{}") if brace >= 0 else len(plain) - 1
        body = text[start : end + 1]
        yield {"what": "declaration", "kind": kind, "name": name, "owner": owner, "signature": name + text[paren : close + 1], "start": line(start), "end": line(end), "body": body}
        me = f"{owner}.{name}" if owner else name
        for c in _TS_CALL.finditer(plain, close, end):
            if c.group(1) or c.group(2) not in _TS_NOT_CALLS:
                yield {"what": "call", "kind": "self" if c.group(1) else "bare", "name": c.group(1) or c.group(2), "owner": owner, "target": me, "start": line(c.start()), "end": line(c.end())}
        if _too_long(body):
            for first, last, what in _ts_blocks(plain, brace + 1 if brace >= 0 else close, end):
                yield {"what": "block", "kind": what, "target": me, "owner": owner, "start": line(first), "end": line(last)}

    at = 0
    while m := _TS_DECL.search(plain, at):
        if m.group(1):
            yield from function("Function", m.group(1), None, m.start(), m.end() - 1)
            brace = plain.find("{", closing(plain, m.end() - 1, "()"))
            at = closing(plain, brace, "{}") + 1 if brace >= 0 else m.end()
            continue
        end = closing(plain, m.end() - 1, "{}")
        yield {"what": "declaration", "kind": "Class", "name": m.group(2), "signature": m.group(2), "start": line(m.start()), "end": line(end), "body": text[m.start() : end + 1]}
        inner = m.end()
        while inner < end and (x := _TS_METHOD.search(plain, inner - 1, end)):
            close = closing(plain, x.end() - 1, "()")
            after = re.compile(r"\s*(?::[^{;=]*)?\{").match(plain, close + 1)
            if after and x.group(1) not in _TS_NOT_CALLS - {"constructor"}:
                yield from function("Method", x.group(1), m.group(2), x.start(1), x.end() - 1)
                inner = closing(plain, after.end() - 1, "{}") + 1
            else:
                inner = close + 1
        at = end + 1


def _py_blocks(nodes: list[ast.AST], lines: list[str]) -> Iterator[tuple[str, int, int]]:
    """(type, first line, last line) of the blocks in these nodes, outer ones first."""
    for x in nodes:
        name, last = type(x).__name__, getattr(x, "end_lineno", None)
        first = x.pattern.lineno if name == "match_case" else getattr(x, "lineno", None)
        chained = name == "If" and lines[first - 1].encode()[x.col_offset :].startswith(b"elif")
        if name == "match_case":
            first = _keyword_line(lines, first, "case")
            last = x.body[-1].end_lineno
        if chained:  # a clause ends before the next one
            yield "elif_clause", first, x.body[-1].end_lineno
        elif name in _PY_BLOCKS:
            yield _PY_BLOCKS[name], first, last
        for field, value in ast.iter_fields(x):
            inner = [y for y in (value if isinstance(value, list) else [value]) if isinstance(y, ast.AST)]
            if inner and field in ("orelse", "finalbody") and isinstance(x, ast.stmt):
                word = "else" if field == "orelse" else "finally"
                at = inner[0]
                if not (name == "If" and isinstance(at, ast.If) and lines[at.lineno - 1].encode()[at.col_offset :].startswith(b"elif")):
                    yield f"{word}_clause", _keyword_line(lines, at.lineno, word), inner[-1].end_lineno
            yield from _py_blocks(inner, lines)


def _keyword_line(lines: list[str], at: int, word: str) -> int:
    """The line, here or above, that starts with a clause's keyword."""
    rule = re.compile(rf"\s*{word}\b")
    return next((k for k in range(at, 0, -1) if rule.match(lines[k - 1])), at)


def scan_py(text: str) -> Iterator[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # not Python, or beyond what the parser can hold
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from ({"what": "import", "target": a.name, "start": node.lineno, "end": node.end_lineno} for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            yield {"what": "import", "target": "." * node.level + (node.module or ""), "start": node.lineno, "end": node.end_lineno}
    lines = text.split("\n")

    def walk(node: ast.AST, owner: str | None) -> Iterator[dict]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                yield {"what": "declaration", "kind": "Class", "name": child.name, "signature": child.name, "start": child.lineno, "end": child.end_lineno, "body": "\n".join(lines[child.lineno - 1 : child.end_lineno])}
                yield from walk(child, child.name)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                body = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                head = re.search(r"\(", body)
                params = body[head.start() : closing(body, head.start(), "()") + 1] if head else "()"
                me = f"{owner}.{child.name}" if owner else child.name
                yield {"what": "declaration", "kind": "Method" if owner else "Function", "name": child.name, "owner": owner, "signature": child.name + params, "start": child.lineno, "end": child.end_lineno, "body": body}
                for x in ast.walk(child):
                    if isinstance(x, ast.Call):
                        f = x.func
                        if isinstance(f, ast.Name):
                            yield {"what": "call", "kind": "bare", "name": f.id, "owner": owner, "target": me, "start": x.lineno, "end": x.end_lineno}
                        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "self":
                            yield {"what": "call", "kind": "self", "name": f.attr, "owner": owner, "target": me, "start": x.lineno, "end": x.end_lineno}
                if _too_long(body):
                    for kind, first, last in _py_blocks(child.body, lines):
                        yield {"what": "block", "kind": kind, "target": me, "owner": owner, "start": first, "end": last}
            else:
                yield from walk(child, owner)

    yield from walk(tree, None)


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of every file; what a row doesn't say is null."""
    for files in batches:
        for path, language, text in zip(*(files.column(c).to_pylist() for c in ("path", "language", "text")), strict=True):
            scan = scan_py if language == "python" else scan_ts
            rows = [{"path": path, "language": language, "turn": k, **r} for k, r in enumerate(scan(text or ""))]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ROW)


def scanned(files: DataFrame) -> DataFrame:
    """Declarations, calls, imports and blocks of the files(path, language, text) in languages that are parsed."""
    return files.filter(F.col("language").isin("typescript", "javascript", "python")).select("path", "language", "text").mapInArrow(_scan, ROW)


def _own(path, owner, name):
    return F.concat(path, F.lit("::"), F.when(owner.isNotNull(), F.concat(owner, F.lit("."))).otherwise(F.lit("")), name)


def declarations(rows: DataFrame, repo: str) -> DataFrame:
    qn = _own(F.col("path"), F.col("owner"), F.col("name"))
    return rows.filter("what = 'declaration'").select(S.stable_id(F.lit(repo), "path", "kind", qn).alias("id"), "path", "kind", "language", qn.alias("qn"), "signature", "start", "end", S.content_id(S.normalize_signature("signature"), S.normalize_body("body")).alias("content_hash"), "name", "owner", "turn")


def resolved_calls(rows: DataFrame, decls: DataFrame) -> DataFrame:
    """caller and callee of each call that meets a declaration of its file: a function by bare name, or a method of the same class.

    Of declarations with one name the last counts; calls of oneself and repeated ones are left out.
    """
    last = Window.partitionBy("path", "kind", "owner", "name").orderBy(F.desc("turn"))
    decls = decls.withColumn("_r", F.row_number().over(last)).filter("_r = 1").select("path", "kind", "owner", "name", "qn")
    calls = rows.filter("what = 'call'").select("path", "kind", "name", "owner", F.concat("path", F.lit("::"), "target").alias("caller"))
    bare = calls.filter("kind = 'bare'").drop("kind", "owner").join(decls.filter("kind = 'Function' AND owner IS NULL").select("path", "name", F.col("qn").alias("callee")), ["path", "name"])
    own = calls.filter("kind = 'self'").drop("kind").join(decls.filter("kind = 'Method'").select("path", "owner", "name", F.col("qn").alias("callee")), ["path", "owner", "name"])
    return bare.select("caller", "callee").union(own.select("caller", "callee")).filter("caller <> callee").distinct()


def imports(rows: DataFrame, repo: str) -> DataFrame:
    """One row for each file's import: its node id, and the file that it means (null if it is none)."""
    qn = F.concat("path", F.lit("::import:"), "target")
    first = rows.filter("what = 'import'").groupBy("path", "target").agg(F.min_by(F.struct("language", "start", "end"), "turn").alias("x"))
    file = F.when(F.col("x.language") != "python", S.resolve_import("path", "target"))
    return first.select("path", "target", S.stable_id(F.lit(repo), "path", F.lit("Import"), qn).alias("id"), qn.alias("qn"), file.alias("file"), F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def blocks(rows: DataFrame, scope: str = "body") -> DataFrame:
    """Blocks of long functions, numbered in order; with scope ``file`` each long function has all of its file's blocks."""
    found = rows.filter("what = 'block'").withColumn("parent", F.concat("path", F.lit("::"), "target"))
    if scope == "file":
        every = found.select("path", "kind", "start", "end", "turn").distinct()
        found = found.select("path", "parent").distinct().join(every, "path")
    turn = F.row_number().over(Window.partitionBy("parent").orderBy("turn")) - 1
    found = found.withColumn("ordinal", turn)
    return found.select("path", "parent", "ordinal", "kind", "start", "end", F.concat("parent", F.lit("#block:"), F.col("ordinal").cast("string"), F.lit(":"), "kind").alias("qn"))
