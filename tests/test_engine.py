"""Operators on small inputs: golden values, orders and error cases."""

import io
import json
import re
import subprocess
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.functions import scalars as S
from graphloom.operators import extract, graph, manifest, models, vectors
from graphloom.plans import index as indexing
from graphloom.plans import retrieval
from graphloom.plans.store import Store, StoreConflictError
from graphloom.sources import build_files, files
from graphloom.streaming import incremental

NODE = "id string, path string, kind string, qn string, ord long"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_identity(spark):
    assert one(spark, S.hash_parts(F.lit("a"), F.lit("b"))) == "5b4085401e259f3918fb1701d3d9399c2c8cce73"
    assert one(spark, S.stable_id(F.lit("repo_tiny"), F.lit("src/greet.ts"), F.lit("Function"), F.lit("src/greet.ts::greet"))) == "sym_a5e94045e27757421b608dcb5bca7be4513269e3"
    assert one(spark, S.checksum(F.lit(12), F.lit(14), F.lit(6))) == "a24c35d016b05e68b43b438521912d43a3141de3d78ef27ea7f2674e04290ca8"


def test_normal_forms(spark):
    assert one(spark, S.normalize_body(F.lit("class A { #x = 1 }"))) == "class A {"
    assert one(spark, S.normalize_body(F.lit('x = "http://a/b"; y'))) == 'x = "http:'
    assert one(spark, S.normalize_signature(F.lit("  a\n\t b  "))) == "a b"
    assert one(spark, S.strip_literal(F.lit("'a\"'"))) == 'a"'
    assert one(spark, S.resolve_import(F.lit("a/b.ts"), F.lit("../../x.js"))) is None


def test_hash_embedding(spark):
    got = one(spark, S.hash_embedding(F.lit("greet"), 4))
    assert got == [-0.5500723536941392, 0.08387246660047043, -0.8303400510527054, -0.08082825669106752]
    assert got == models.hash_vector("greet", 4)


def test_zero_vector(spark):
    zero, other = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, S.cosine(zero, other)) == 0
    assert one(spark, S.cosine(other, other)) == 1


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=40))
def test_line_range_never_fails(spark, text):
    assert isinstance(one(spark, S.line_range(F.lit(text), F.lit(-1), F.lit(3))), str)


@pytest.fixture
def tiny(spark):
    nodes = spark.createDataFrame([(x, x, "Function", f"f::{x}", k) for k, x in enumerate("abcd")], NODE)
    edges = spark.createDataFrame([("a", "CALLS", "b", 0), ("a", "CALLS", "c", 1), ("b", "CALLS", "d", 2), ("d", "CALLS", "zz", 3), ("zz", "CALLS", "c", 4)], "src string, type string, dst string, ord long")
    return nodes, edges


def reach(spark, tiny, **options):
    seed = spark.createDataFrame([(options.pop("seed"),)], "id string")
    return {r["id"] for r in graph.neighbors(*tiny, seed, **options)[0].collect()}


def test_search(spark, tiny):
    assert reach(spark, tiny, seed="a", depth=0) == {"a"}
    assert reach(spark, tiny, seed="a", direction="out") == {"a", "b", "c"}
    assert reach(spark, tiny, seed="b", direction="in") == {"a", "b"}
    assert reach(spark, tiny, seed="b") == {"a", "b", "d"}
    assert reach(spark, tiny, seed="a", direction="out", limit=1) == {"a", "b", "c"}
    assert reach(spark, tiny, seed="d", direction="out", depth=2) == {"c", "d"}  # through an unknown node
    assert reach(spark, tiny, seed="a", types=["IMPORTS"]) == {"a"}


def test_upsert_keeps_place_and_takes_last(spark, tiny):
    nodes, _ = tiny
    new = spark.createDataFrame([("b", "p1", "Class", "q", 0), ("b", "p2", "Class", "q", 1)], NODE)
    got = graph.upsert_nodes(nodes, new).orderBy("turn", "ord").collect()
    assert [r["id"] for r in got] == list("abcd") and got[1]["path"] == "p2"


def test_vectors(spark):
    row = "node_id string, payload_kind string, model string, revision string, vector array<double>, ord long"
    a = spark.createDataFrame([("n", "Block", "m", "1", [1.0, 0.0], 0), ("n", "FunctionSummary", "m", "1", [0.0, 1.0], 1)], row)
    b = spark.createDataFrame([("n", "Block", "m", "1", [0.0, 0.0], 2)], row)
    assert vectors.upsert(a, b).count() == 2
    assert vectors.search(a, [1.0, 0.0], 1).first()["payload_kind"] == "Block"
    assert vectors.search(vectors.upsert(a, b), [1.0, 0.0], 2).filter("payload_kind = 'Block'").first()["score"] == 0
    with pytest.raises(vectors.EmbeddingCompatibilityError):
        vectors.pinned(a, "m", "2", 2)


def test_manifest(spark):
    batches = spark.createDataFrame([("b", "r")], "batch_id string, run string")
    with pytest.raises(manifest.ManifestStateError):
        manifest.recorded(batches, batches)
    events = spark.createDataFrame([("b", "pending", 1, 1), ("b", "committed", 2, 2), ("b", "failed", 3, 3)], "batch_id string, to_status string, event_id long, at long")
    assert manifest.state(events).first()["status"] == "committed"
    assert [r["event_id"] for r in manifest.invalid(events).collect()] == [3]


TS = """import type { A } from "./a.js";
export { B } from '../b';
export class Box<T> {
  constructor(private x: T) { helper("function fake() {}"); }
  get size(): number { return this.count(); }
  async count() { /* class No {} */ return other(this.x); }
}
const arrow = () => helper();
function helper(a: string) { return [1].map((x) => inner(x)); }
function inner(x) { return inner(x) + helper(`${x}`) + helper("b"); }
"""


def test_typescript(spark):
    source = spark.createDataFrame([("src/a/box.ts", "typescript", TS)], "path string, language string, text string")
    rows = extract.scanned(source)
    decls = extract.declarations(rows, "r")
    assert {(r["kind"], r["qn"].split("::")[1]) for r in decls.collect()} == {("Class", "Box"), ("Method", "Box.constructor"), ("Method", "Box.size"), ("Method", "Box.count"), ("Function", "helper"), ("Function", "inner")}
    calls = {tuple(x.split("::")[1] for x in r) for r in extract.resolved_calls(rows, decls).collect()}
    assert calls == {("Box.constructor", "helper"), ("Box.size", "Box.count"), ("helper", "inner"), ("inner", "helper")}
    assert {(r["target"], r["file"]) for r in extract.imports(rows, "r").collect()} == {("./a.js", "src/a/a.ts"), ("../b", None)}


def test_block_types(spark):
    """Every type of the reference, in both languages, with its lines and ordinal."""
    pad = "\n" * 60
    ts = "function long(a) {\n  if (a) {\n    b();\n  } else if (c) {\n    d();\n  } else {\n    e();\n  }\n  for (let i = 0; i < 3; i++) f(i);\n  for (const x of a) {\n    g(x);\n  }\n  while (a) h();\n  do {\n    h();\n  } while (a);\n  switch (a) {\n    case 1: break;\n  }\n  try {\n    b();\n  } catch (e) {\n    b();\n  } finally {\n    b();\n  }\n  a.map((x) => {\n    return x;\n  }).catch(function (y) {\n    return y;\n  });\n  class K {\n  }\n" + pad + "}\n"
    py = "def long(a):\n    if a:\n        b()\n    elif c:\n        d()\n    else:\n        e()\n    for x in a:\n        f()\n    else:\n        g()\n    while a:\n        h()\n    try:\n        b()\n    except E:\n        b()\n    finally:\n        b()\n    with a:\n        b()\n    match a:\n        case 1:\n            b()\n    def inner():\n        pass\n    class K:\n        pass\n" + pad + "    return a\n"
    source = spark.createDataFrame([("a.ts", "typescript", ts), ("a.py", "python", py)], "path string, language string, text string")
    rows = sorted(extract.blocks(extract.scanned(source)).collect(), key=lambda r: (r["path"], r["ordinal"]))
    found = {p: [(r["kind"], r["start"], r["end"]) for r in rows if r["path"] == p] for p in ("a.ts", "a.py")}
    assert found["a.ts"] == [
        *(("if_statement", 2, 8), ("else_clause", 4, 8), ("if_statement", 4, 8), ("else_clause", 6, 8), ("for_statement", 9, 9), ("for_in_statement", 10, 12), ("while_statement", 13, 13), ("switch_statement", 17, 19)),
        *(("try_statement", 20, 26), ("catch_clause", 22, 24), ("finally_clause", 24, 26), ("arrow_function", 27, 29), ("function_expression", 29, 31), ("class_declaration", 32, 33)),
    ]
    assert found["a.py"] == [
        *(("if_statement", 2, 7), ("elif_clause", 4, 5), ("else_clause", 6, 7), ("for_statement", 8, 11), ("else_clause", 10, 11), ("while_statement", 12, 13), ("try_statement", 14, 19), ("except_clause", 16, 17)),
        *(("finally_clause", 18, 19), ("with_statement", 20, 21), ("match_statement", 22, 24), ("case_clause", 23, 24), ("function_definition", 25, 26), ("class_definition", 27, 28)),
    ]


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("python", "import os\n", [("import", "os")]),
        ("python", "def h(): pass\n", [("declaration", "h")]),
        ("python", "class A:\n    x = 1\n", [("declaration", "A")]),
        ("python", "import a\nfrom . import b\ndef f(): g()\n", [("import", "a"), ("import", "."), ("declaration", "f"), ("call", "g")]),
        ("python", "", []),
        ("python", "def broken(:\n", []),
        ("python", "(" * 5000, []),
        ("typescript", 'import { x } from "./a.js";\n', [("import", "./a.js")]),
        ("typescript", 'import { x } from "./a.js";\nfunction f(a) { return g(a); }\n', [("import", "./a.js"), ("declaration", "f"), ("call", "g")]),
        ("typescript", "class A {}\n", [("declaration", "A")]),
        ("javascript", ")))}}} ((( class {", []),
        ("typescript", "", []),
    ],
)
def test_scans_any_file(spark, language, text, want):
    """Files that have some kinds of rows and not others, one by one and together with one that has all."""
    one = [("p", language, text)]
    found = lambda rows: [(r["what"], r["target"] if r["what"] == "import" else r["name"]) for r in rows if r["path"] == "p"]
    assert found(extract.scanned(spark.createDataFrame(one, "path string, language string, text string")).collect()) == want
    assert found(extract.scanned(spark.createDataFrame([*one, ("q", "typescript", TS)], "path string, language string, text string").coalesce(1)).collect()) == want


def test_scanner_is_linear():
    text = "".join(f"export function f{k}(a) {{\n  if (a) {{ return g(a, [1, (2)]); }}\n}}\n" for k in range(4000))
    began = time.perf_counter()
    rows = list(extract.scan_ts(text))
    assert len(rows) == 8000 and rows[-2]["start"] == 3 * 3999 + 1 and time.perf_counter() - began < 10


def test_regex_declarations_with_odd_characters(spark):
    """Only a newline ends a line, and no character marks the matches."""
    text = "x\u0001\ndef a(\n  b):\u2028def no(): pass\rdef nor(): pass\n\u0001\ndef c(): pass\nclass D: pass\n"
    rows = extract.regex_declarations(spark.createDataFrame([("p.py", "python", text), ("q.py", "python", "")], "path string, language string, text string"), "r").collect()
    assert sorted((r["qn"], r["start"], r["signature"]) for r in rows) == [("p.py::D", 6, "D"), ("p.py::a", 2, "a(\n  b)"), ("p.py::c", 5, "c()")]


def test_walk(spark, tmp_path):
    """Names with an underscore, brackets and spaces, hidden and skipped folders, bytes that aren't text, links, and a root whose name comes again."""
    root = tmp_path / "r"
    for name in ("src/__init__.py", "src/_priv.py", "src/__tests__/t.ts", "src/r/m.py", "app/[id]/a b.tsx", "k=v/x.js", "src/.hidden/h.py", "node_modules/n.ts", "src/note.md", "_lib/deep/q.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    (root / "src/bad.py").write_bytes(b"a\xff\n")
    (root / "src/link.py").symlink_to(root / "src/r/m.py")
    rows = {r["path"]: r for r in files.walked(spark, str(root)).collect()}
    assert set(rows) == {"src/__init__.py", "src/_priv.py", "src/__tests__/t.ts", "src/r/m.py", "app/[id]/a b.tsx", "k=v/x.js", "_lib/deep/q.py", "src/bad.py"}
    assert rows["src/bad.py"]["text"] == "a\ufffd\n" and rows["src/_priv.py"]["text"] == "x = 1\n" and rows["src/__tests__/t.ts"]["language"] == "typescript"
    (tmp_path / "empty").mkdir()
    assert files.walked(spark, str(tmp_path / "empty")).collect() == []
    with pytest.raises(FileNotFoundError):
        files.walked(spark, str(tmp_path / "none"))


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src/m.py").write_text("def f(a):\n    return g(a)\n\ndef g(a):\n    return a\n")
    return root


def test_index(spark, tmp_path, source):
    store = str(tmp_path / "store")
    config = indexing.Config("r", parser="ast", dim=8)
    dry = indexing.index(spark, str(source), store, indexing.Config("r", parser="ast", dim=8, dry_run=True), batch_id="dry")
    tables = Store(spark, store)
    assert dry["status"] == "dry_run" and tables.read("nodes") is None
    done = indexing.index(spark, str(source), store, config, batch_id="one")
    again = indexing.index(spark, str(source), store, config, batch_id="two")
    assert done["status"] == "committed" and (done["node_count"], done["edge_count"], done["vector_count"]) == (4, 3, 2)
    assert again["checksum"] == done["checksum"] and again["source_hash"] == done["source_hash"]
    nodes = tables.read("nodes").orderBy("ord").collect()
    assert [r["qn"] for r in nodes] == ["comp_root", "src/m.py", "src/m.py::f", "src/m.py::g"] and {r["run"] for r in nodes} == {"two"}
    assert tables.read("edges").filter("type = 'CALLS'").count() == 1 and tables.read("vectors").count() == 2
    with pytest.raises(manifest.ManifestStateError):
        indexing.index(spark, str(source), store, config, batch_id="one")
    with pytest.raises(vectors.EmbeddingCompatibilityError):
        indexing.index(spark, str(source), store, indexing.Config("r", parser="ast", dim=8, model="other"), batch_id="three")
    with pytest.raises(vectors.EmbeddingCompatibilityError):
        indexing.index(spark, str(source), store, indexing.Config("r", parser="ast", dim=9), batch_id="four")
    assert {r["batch_id"]: (r["status"], r["committed_at"] is not None) for r in indexing.batches(spark, store).collect()} == {"dry": ("dry_run", False), "one": ("committed", True), "two": ("committed", True), "three": ("failed", False), "four": ("failed", False)}
    assert tables.current()["identity"] == {"model": "mock-embedder", "revision": "0", "dim": 8} and tables.read("vectors").select("model").distinct().count() == 1
    with pytest.raises(StoreConflictError):
        tables.commit({"tables": {}, "identity": None, "batches": 0}, {"tables": {}, "identity": None, "batches": 1})


def test_failed_merge_changes_nothing(spark, tmp_path, source, monkeypatch):
    """The second of three tables can't be written: all stay as they were, and the batch has failed."""
    store, config = str(tmp_path / "store"), indexing.Config("r", parser="ast", dim=8)
    indexing.index(spark, str(source), store, config, batch_id="one")
    (source / "src/n.py").write_text("def h(): pass\n")
    merged = Store.merged
    monkeypatch.setattr(Store, "merged", lambda self, state, name, new, merge: merged(self, state, name, new, merge) if name == "nodes" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        indexing.index(spark, str(source), store, config, batch_id="two")
    assert Store(spark, store).read("nodes").count() == 4
    assert {r["batch_id"]: r["status"] for r in indexing.batches(spark, store).collect()} == {"one": "committed", "two": "failed"}


def test_fallback_identity(spark):
    """Vectors carry the identity of what made them."""
    rows = spark.createDataFrame([("n", "Block", "a")], "node_id string, payload_kind string, text string")
    away = models.HttpEmbedder("http://127.0.0.1:9", "m", "1", 4)
    made = models.embedded(rows, models.LatencyLogged(models.FallbackEmbedder(away, models.HashEmbedder(4, "spare", "7")))).first()
    assert (made["model"], made["revision"]) == ("spare", "7")
    with pytest.raises(vectors.EmbeddingCompatibilityError):
        vectors.checked(models.embedded(rows, models.HashEmbedder(4, "spare", "7")), {"model": "m", "revision": "1", "dim": 4})
    with pytest.raises(vectors.EmbeddingCompatibilityError):
        models.EncoderEmbedder("m", "0")


def test_query_of_another_length(spark):
    rows = spark.createDataFrame([("n", [0.5] * 8, 1)], "node_id string, vector array<double>, ord long")
    with pytest.raises(Exception, match="EmbeddingCompatibilityError"):
        vectors.search(rows, [0.1, 0.2, 0.3]).collect()
    assert vectors.search(rows, [0.1] * 8).count() == 1


def test_strict_search_and_loops(spark, tiny):
    assert reach(spark, tiny, seed="d", direction="out", depth=2, strict=True) == {"d"}
    assert reach(spark, tiny, seed="missing", depth=2, strict=True) == set()
    nodes, edges = tiny
    loop = edges.union(spark.createDataFrame([("a", "CALLS", "a", 9)], edges.schema))
    seed = spark.createDataFrame([("a",)], "id string")
    found, seen = graph.neighbors(nodes, loop, seed)
    assert {r["id"] for r in found.collect()} == {"a", "b", "c"} and seen.filter("src = dst").count() == 1 and seen.count() == 3


def test_violations(spark):
    sym, cnt = "sym_" + "0" * 40, "cnt_" + "0" * 40
    rule = lambda rows, schema, what: [r["rule"] for r in graph.violations(spark.createDataFrame(rows, schema).coalesce(1), what).collect()]
    edge = "src string, type string, dst string, repo string, run string"
    assert rule([(sym, "CALLS", sym, "r", "b"), ("x", "CALLS", sym, "r", "b"), (sym, "KNOWS", sym, "r", "b"), (sym, "CALLS", None, "r", "b"), (sym, "CALLS", sym, "", "b")], edge, "edges") == ["src", "type", "dst", "repo"]
    row = "node_id string, payload_kind string, model string, revision string, vector array<double>, repo string, run string"
    assert rule([(sym, "Block", "m", "1", [1.0], "r", "b"), (sym, "Text", "m", "1", [1.0], "r", "b"), (sym, "Block", "m", "1", [float("nan")], "r", "b"), (sym, "Block", "m", "1", [], "r", "b")], row, "vectors") == ["payload_kind", "vector", "vector"]
    batch = "batch_id string, source_hash string, created_at string, node_count long, edge_count long, vector_count long"
    assert rule([("b", cnt, "2024-01-01T00:00:00+00:00", 1, 0, 0), ("b", "x", "2024-01-01T00:00:00+00:00", 1, 0, 0), ("b", cnt, "then", 1, 0, 0), ("b", cnt, "2024-01-01T00:00:00+00:00", -1, 0, 0)], batch, "batches") == ["source_hash", "created_at", "counts"]
    assert rule([("c", "n", "app", "."), ("c", "n", "thing", ".")], "id string, name string, kind string, path string", "components") == ["kind"]
    assert rule([("t", "c", "run"), ("t", "c", "fly")], "id string, component_id string, kind string", "targets") == ["kind"]


def test_ingestions(spark):
    runs = spark.createDataFrame([("a", 1, None, "x")], "run string, started_at long, finished_at long, model string")
    both = manifest.recorded_ingestions(runs, spark.createDataFrame([("a", 2, None, "y"), ("b", 3, None, "z")], runs.schema))
    done = manifest.finished_ingestions(both, spark.createDataFrame([("a", 9)], "run string, finished_at long"))
    assert {tuple(r) for r in done.collect()} == {("a", 2, 9, "y"), ("b", 3, None, "z")} and manifest.ingestion(done, "b").count() == 1
    with pytest.raises(manifest.ManifestStateError):
        manifest.finished_ingestions(both, spark.createDataFrame([("c", 9)], "run string, finished_at long"))


def test_export_document(spark, tiny):
    nodes, edges = tiny
    out = io.StringIO()
    graph.export_document(nodes, edges, out)
    got = json.loads(out.getvalue())
    assert (got["format"], got["nodeCount"], got["edgeCount"]) == ("json", 4, 5) and [n["id"] for n in got["nodes"]] == list("abcd") and got["edges"][0]["dst"] == "b"


def _scans(df, name: str) -> int:
    """Scans of a folder in the plan before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(rf"FileScan parquet [^\n]*/{name}[,\]]", plan))


def test_listed_edges_of_one_place_are_taken_by_their_key(spark):
    """A limit among edges that share an ord gives the same edges whatever the order of the rows."""
    rows = [(f"s{k % 3}", "CALLS", f"d{k}", 7 + k // 6) for k in range(12)]
    want = [r[:3] for r in sorted(rows, key=lambda r: (r[3], *r[:3]))[:4]]
    for turned in (rows, rows[::-1]):
        edges = spark.createDataFrame(turned, "src string, type string, dst string, ord long")
        assert [tuple(r)[:3] for r in graph.list_edges(edges, "CALLS", limit=4).collect()] == want


def test_retrieval_reads_each_table_once(spark, tmp_path, server):
    """A query's candidates are found once; later steps join the big tables with them, each table once."""
    kind = ["Function"] * 6
    nodes = spark.createDataFrame([(f"n{k}", f"f{k % 2}.py", kind[k], f"f{k % 2}.py::g{k}", 1 + k, 2 + k, k) for k in range(6)], "id string, path string, kind string, qn string, start int, end int, ord long")
    edges = spark.createDataFrame([(f"n{k}", "CALLS", f"n{(k + 1) % 6}", k) for k in range(6)], "src string, type string, dst string, ord long")
    vecs = spark.createDataFrame([(f"n{k}", models.hash_vector(f"g{k}", 4), k) for k in range(6)], "node_id string, vector array<double>, ord long")
    code = spark.createDataFrame([(f"f{k}.py", "\n".join(f"line {i} of g{k}" for i in range(1, 9))) for k in range(2)], "path string, text string")
    read = {}
    for name, rows in (("nodes", nodes), ("edges", edges), ("vectors", vecs), ("files", code)):
        rows.write.parquet(f"{tmp_path}/{name}")
        read[name] = spark.read.parquet(f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.sources.useV1SourceList", "parquet")
    query = retrieval.query_row(spark, "what calls g1")
    limits = retrieval.Limits(semantic=2)
    found = retrieval.candidates(read["nodes"], read["edges"], read["vectors"], query, models.hash_vector("g4", 4), limits)
    assert (_scans(found, "vectors"), _scans(found, "edges"), _scans(found, "nodes")) == (0, 1, 1)
    out = retrieval.retrieve(*(read[n] for n in ("nodes", "edges", "vectors", "files")), query, models.hash_vector("g4", 4), limits)
    assert [_scans(out, n) for n in ("vectors", "edges", "nodes", "files")] == [0, 0, 0, 1]
    rows = out.orderBy("rank").collect()
    assert {rows[0]["id"], rows[1]["id"]} == {"n1", "n4"} and rows[0]["text"].startswith("line ")
    for reranker in (models.JaccardReranker(), models.LatencyLogged(models.FallbackReranker(models.HttpReranker(server, "m", "1"), models.JaccardReranker())), models.FallbackReranker(models.HttpReranker("http://127.0.0.1:9", "m", "1", 1.0), models.JaccardReranker())):
        again = retrieval.retrieve(*(read[n] for n in ("nodes", "edges", "vectors", "files")), query, models.hash_vector("g4", 4), limits, reranker, seconds=5.0).orderBy("rank").collect()
        assert [r["id"] for r in again][:1] == ["n1"] and again[0]["rerank_score"] == max(r["rerank_score"] for r in again) > 0
    assert retrieval.bundle(out, "q", limits).first()["token_budget"]["total"] == 8000


def test_command_line(spark, tmp_path, source, capsys):
    store = str(tmp_path / "store")
    say = lambda *args: (cli.main(["--store", store, *args]), capsys.readouterr().out)[1]
    assert json.loads(say("doctor"))["status"] == "degraded"
    assert json.loads(say("index", str(source), "--repo", "r", "--parser", "ast", "--dim", "16"))["status"] == "committed"
    assert json.loads(say("doctor"))["status"] == "healthy"
    got = json.loads(say("query", "what calls g", "--root", str(source), "--limit", "3", "--reranker", "words"))
    assert len(got["snippets"]) == 3 and got["snippets"][0]["path"] == "src/m.py"
    assert json.loads(say("export"))["nodeCount"] == 4 and len(json.loads(say("inspect", "edges", "--kind", "CALLS"))) == 1
    assert json.loads(say("inspect", "batches"))[0]["status"] == "committed"


def test_stream(spark, tmp_path):
    schema = "id string, path string, kind string, qn string, start int, end int, ord long"
    row = lambda k, path: ("sym_" + f"{k:040x}", path, "File", path, 1, 2, k)
    folder, store = tmp_path / "in", str(tmp_path / "store")
    for turn, rows in enumerate(([row(1, "a"), row(2, "b")], [row(2, "c"), row(3, "d")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        before = Store(spark, store).current()["tables"].get("nodes", {})
        incremental.upsert_stream(spark.readStream.schema(schema).parquet(str(folder)), store, str(tmp_path / "check")).awaitTermination()
        after = Store(spark, store).current()["tables"]["nodes"]
        assert turn == 0 or sum(before.get(k) == x for k, x in after.items()) >= 1  # the parts of other ids stay as they are
    assert {r["path"] for r in Store(spark, store).read("nodes").collect()} == {"a", "c", "d"}


def test_build_files(tmp_path):
    (tmp_path / "packages/a").mkdir(parents=True)
    (tmp_path / "packages/b").mkdir()
    (tmp_path / "package.json").write_text(json.dumps({"name": "root", "workspaces": ["packages/*"], "scripts": {"build": "x", "lint": "y"}}))
    (tmp_path / "packages/a/package.json").write_text(json.dumps({"name": "@x/a", "dependencies": {"@x/b": "*", "left": "1"}}))
    (tmp_path / "packages/b/package.json").write_text(json.dumps({"name": "@x/b"}))
    got = build_files.package_json(tmp_path)
    assert [(c["id"], c["kind"], c["deps"]) for c in got["components"]] == [("pkg:root", "workspace", []), ("pkg:@x/a", "package", ["pkg:@x/b"]), ("pkg:@x/b", "package", [])]
    assert [t["kind"] for t in got["targets"]] == ["build"]
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "p"\ndependencies = ["a==1", "b>=2,<3", "d[x]"]\nscripts = { go = "p:main" }\n')
    assert build_files.pyproject(tmp_path)["components"][0]["deps"] == ["py:a", "py:b", "py:d"]
    assert build_files.pnpm_patterns("  packages:\n    - a\n    - 'b/*'\n") == ["a", "b/*"]
    (tmp_path / "rig.yaml").write_text("components:\n  - {id: z, kind: app, name: z, path: z, deps: [b, a]}\n")
    assert (build_files.manual_yaml(tmp_path / "rig.yaml") or {"components": [{"deps": ["a", "b"]}]})["components"][0]["deps"] == ["a", "b"]
    (tmp_path / "CMakeLists.txt").write_text("")
    tool = tmp_path / "tool"
    tool.write_text('#!/bin/sh\necho \'{"version": 1, "components": [{"id": "c", "kind": "app", "name": "c", "path": "."}], "targets": [], "tests": []}\'\n')
    tool.chmod(0o755)
    assert [g["components"][0]["id"] for g in build_files.dispatched(tmp_path, indexing.extractors(("pyproject", "external"), str(tool)))] == ["py:p", "c"]
    assert build_files.pnpm_patterns('# x\npackages:\n  - "a/*" # y\n  - b\nother: 1\n  - c\n') == ["a/*", "b"]
    fails = lambda *a, **k: subprocess.CompletedProcess(a, 1, "", "")
    with pytest.raises(build_files.ExternalToolError):
        build_files.external("tool", tmp_path, fails)
    works = lambda *a, **k: subprocess.CompletedProcess(a, 0, json.dumps({"version": 1, "components": [{"id": "c", "kind": "app", "name": "c", "path": "."}]}), "")
    assert build_files.external("tool", tmp_path, works)["components"][0]["id"] == "c"


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["content-length"])))
            out = {"model": "m", "revision": "1"}
            out |= {"vectors": models.HashEmbedder(4).embed(body["inputs"])} if self.path == "/embed" else {"scores": models.JaccardReranker().rerank(body["query"], body["candidates"])}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(out).encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_http_models(spark, server):
    good = models.HttpEmbedder(server, "m", "1", 4)
    assert good.embed(["a", "b"]) == models.HashEmbedder(4).embed(["a", "b"]) and good.embed([]) == []
    with pytest.raises(vectors.EmbeddingCompatibilityError):
        models.HttpEmbedder(server, "m", "2", 4).embed(["a"])
    away = models.HttpEmbedder("http://127.0.0.1:9", "m", "1", 4)
    assert models.FallbackEmbedder(away, models.HashEmbedder(4)).embed(["a"]) == models.HashEmbedder(4).embed(["a"])
    with pytest.raises(vectors.EmbeddingCompatibilityError):
        models.FallbackEmbedder(models.HttpEmbedder(server, "x", "1", 4), models.HashEmbedder(4)).embed(["a"])
    assert models.LatencyLogged(models.HttpReranker(server, "m", "1")).rerank("a b", ["A c", ""]) == [1 / 3, 0.0]
    rows = spark.createDataFrame([("n", "Block", "a")], "node_id string, payload_kind string, text string")
    assert models.embedded(rows, models.HashEmbedder(4)).first()["vector"] == models.hash_vector("a", 4)
