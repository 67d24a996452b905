"""The engine's operators as queries over the benchmark's tables, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import extract, graph, manifest, rig, vectors
from ..sources import build_files, files
from . import retrieval
from .testviews import REPO, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUERY_TEXT = "what calls c7 and S3 or p11 but-not c7"
DIM = 64

# --- the same views in SQL ----------------------------------------------------------------------------------

_ID = "'sym_' || sha1('r' || chr(0) || path || chr(0) || kind || chr(0) || qn || chr(0))"
NODES = f"""nodes AS (SELECT {_ID} AS id, 'typescript' AS language, * FROM (
  SELECT 'src/n' || n_nationkey || '.ts' AS path, 'File' AS kind, 'src/n' || n_nationkey || '.ts' AS qn, '' AS signature, 1 AS s, 10 AS e, 'repo_' || (n_nationkey % 2) AS repo, 'run_' || (n_nationkey % 3) AS run, n_nationkey::BIGINT AS ord, n_nationkey::BIGINT AS key FROM nation
  UNION ALL SELECT 'src/n' || s_nationkey || '.ts', 'Class', 'src/n' || s_nationkey || '.ts::S' || s_suppkey, s_name, 2 + s_suppkey % 20, 7 + s_suppkey % 20, 'repo_' || (s_nationkey % 2), 'run_' || (s_nationkey % 3), 1000000 + s_suppkey, s_suppkey FROM supplier
  UNION ALL SELECT 'src/n' || c_nationkey || '.ts', 'Function', 'src/n' || c_nationkey || '.ts::c' || c_custkey, c_name || '(' || c_mktsegment || ')', 1 + c_custkey % 30, 4 + c_custkey % 30, 'repo_' || (c_nationkey % 2), 'run_' || (c_nationkey % 3), 10000000000 + c_custkey, c_custkey FROM customer
  UNION ALL SELECT 'src/n' || (p_partkey % 25) || '.ts', 'Method', 'src/n' || (p_partkey % 25) || '.ts::P.p' || p_partkey, p_name, 3 + p_partkey % 10, 5 + p_partkey % 10, 'repo_' || (p_partkey % 25 % 2), 'run_' || (p_partkey % 25 % 3), 20000000000 + p_partkey, p_partkey FROM part))"""
EDGES = """edges AS (
  SELECT f.id AS src, 'CONTAINS' AS type, n.id AS dst, n.ord FROM nodes n JOIN nodes f ON f.path = n.path AND f.kind = 'File' AND n.kind <> 'File'
  UNION ALL SELECT a.id, 'CALLS', b.id, o + 30000000000 FROM (SELECT o_custkey AS x, l_partkey AS y, min(l_orderkey) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
    JOIN nodes a ON a.kind = 'Function' AND a.key = x JOIN nodes b ON b.kind = 'Method' AND b.key = y
  UNION ALL SELECT a.id, 'DEPENDS_ON', b.id, o + 40000000000 FROM (SELECT l_suppkey AS x, l_partkey AS y, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2)
    JOIN nodes a ON a.kind = 'Class' AND a.key = x JOIN nodes b ON b.kind = 'Method' AND b.key = y
  UNION ALL SELECT a.id, 'IMPORTS', b.id, n_nationkey + 50000000000 FROM nation JOIN nodes a ON a.kind = 'File' AND a.key = n_nationkey JOIN nodes b ON b.kind = 'File' AND b.key = (n_nationkey + 1) % 25)"""
VECTORS = """vectors AS (SELECT coalesce(n.id, 'none_' || (vec_id + 1)) AS node_id, CASE WHEN vec_id % 3 = 0 THEN 'Block' ELSE 'FunctionSummary' END AS payload_kind,
  'repo_' || label AS repo, 'run_' || (vec_id % 4) AS run, embedding::DOUBLE[] AS vector, vec_id::BIGINT AS ord FROM embeddings LEFT JOIN nodes n ON n.kind = 'Function' AND n.key = vec_id + 1)"""
FILES = """files AS (SELECT 'src/n' || n_nationkey || '.ts' AS path, 'import { x } from "./n' || ((n_nationkey + 1) % 25) || '.js";' || chr(10) || coalesce(a, '') || coalesce(b, '') AS text
  FROM nation LEFT JOIN (SELECT s_nationkey, string_agg('export class S' || s_suppkey || ' {' || chr(10) || '  run(a) {' || chr(10) || '    return this.stop(a);' || chr(10) || '  }' || chr(10) || '  stop(a) {' || chr(10) || '    return a;' || chr(10) || '  }' || chr(10) || '}' || chr(10), '' ORDER BY s_suppkey) AS a FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey
  LEFT JOIN (SELECT c_nationkey, string_agg('export function c' || c_custkey || '(a, b) {' || chr(10) || '  return c' || m || '(b, a);' || chr(10) || '}' || chr(10), '' ORDER BY c_custkey) AS b
    FROM customer JOIN (SELECT c_nationkey AS k, min(c_custkey) AS m FROM customer GROUP BY 1) ON k = c_nationkey GROUP BY 1) ON c_nationkey = n_nationkey)"""
COMPONENTS = """components AS (
  SELECT 'pkg:n' || n_nationkey AS id, 'package' AS kind, n_name AS name, 'p/' || n_nationkey AS path, ['pkg:n' || n_regionkey] AS deps, 0 AS writer FROM nation
  UNION ALL SELECT 'pkg:n' || n_nationkey, 'app', upper(n_name), '', ['pkg:n' || ((n_nationkey + 1) % 25), 'pkg:none'], 1 FROM nation),
targets AS (SELECT 't' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'build' ELSE 'run' END AS kind, 'pkg:n' || (s_suppkey % 30) AS component_id FROM supplier)"""
EVENTS = """ev AS (SELECT user_id::VARCHAR AS batch_id, CASE event_type WHEN 'purchase' THEN 'committed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'dry_run' WHEN 'click' THEN 'pending' END AS to_status, event_id, ts AS seen FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY seen, event_id) AS turn FROM ev),
f AS (SELECT *, turn > 1 AND to_status <> 'pending' AS final FROM t),
g AS (SELECT *, sum(final::INT) OVER (PARTITION BY batch_id ORDER BY seen, event_id) AS finals FROM f),
v AS (SELECT *, turn = 1 OR (final AND finals = 1) AS valid FROM g)"""
_WITH = f"WITH {NODES}, {EDGES} "
QVEC = f"list_transform(range({DIM}), lambda i: ('0x' || substr(sha256('{QUERY_TEXT}' || chr(0) || i), 1, 8))::BIGINT::DOUBLE / 4294967295.0 * 2 - 1)"
QVEC_BIT = QVEC
SEED = "src/n3.ts"


def query(name: str, sql: str | None = None):
    def kept(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return kept


def _cosine(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a})) / sqrt(list_dot_product({b}, {b})))"


# --- scans, sources, scalars --------------------------------------------------------------------------------

_PATHS = "('doc', '.ts'), ('doc', '.MTS'), ('doc', '.jsx'), ('doc', '.py'), ('doc', '.md'), ('doc', '')"


@query("s2_lang", """SELECT doc_id, 'd' || doc_id || e AS path, CASE lower(substr(e, 2)) WHEN 'ts' THEN 'typescript' WHEN 'mts' THEN 'typescript' WHEN 'jsx' THEN 'javascript' WHEN 'py' THEN 'python' END AS language
FROM (SELECT doc_id, ['.ts', '.MTS', '.jsx', '.py', '.md'][(doc_id % 5 + 1)::INT] AS e FROM documents) WHERE e <> '.md'""")
def _(v):
    ends = F.array(*(F.lit(x) for x in (".ts", ".MTS", ".jsx", ".py", ".md")))
    rows = v.table("documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.element_at(ends, (F.col("doc_id") % 5 + 1).cast("int"))).alias("path"))
    return rows.withColumn("language", S.language_of("path")).filter("language IS NOT NULL")


@query("s4_read_range", """SELECT doc_id, array_to_string(list_slice(regexp_split_to_array(coalesce(text, ''), '\r?\n'), greatest(1, doc_id % 4 - 1)::INT, (doc_id % 6)::INT), chr(10)) AS text FROM documents""")
def _(v):
    rows = v.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", S.line_range("text", (F.col("doc_id") % 4 - 1).cast("int"), (F.col("doc_id") % 6).cast("int")).alias("text"))


@query("s5_mock_range", "SELECT p_partkey, '<mock source: ' || p_name || ':' || p_size || '-' || (p_size + 2) || '>' AS text FROM part")
def _(v):
    ranges = v.table("part").select("p_partkey", F.col("p_name").alias("path"), F.col("p_size").alias("start"), (F.col("p_size") + 2).alias("end"))
    return files.mock_ranges(ranges).select("p_partkey", "text")


@query("u1_ids", """SELECT c_custkey, 'sym_' || sha1('r' || chr(0) || c_mktsegment || chr(0) || 'Function' || chr(0) || c_name || chr(0)) AS stable, 'cnt_' || sha1(c_name || chr(0) || c_mktsegment || chr(0)) AS content,
'cnt_' || sha1(c_name || chr(0) || 'CALLS' || chr(0) || c_mktsegment || chr(0)) AS edge FROM customer""")
def _(v):
    return v.table("customer").select("c_custkey", S.stable_id(F.lit("r"), "c_mktsegment", F.lit("Function"), "c_name").alias("stable"), S.content_id("c_name", "c_mktsegment").alias("content"), S.edge_hash("c_name", F.lit("CALLS"), "c_mktsegment").alias("edge"))


_SP = r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_NL = r"[^\n\r\x{2028}\x{2029}]*"


@query("u2_norm_sig", f"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '{_SP}', ' ', 'g'))) AS norm FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.md5(S.normalize_signature(F.coalesce("text", F.lit(""))).cast("binary")).alias("norm"))


@query("u3_norm_body", f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '//{_NL}', '', 'g'), '/\\*[\\s\\S]*?\\*/', '', 'g'), '#{_NL}', '', 'g'), '{_SP}', ' ', 'g'))) AS norm
FROM (SELECT doc_id, replace(replace(coalesce(text, ''), ' th', ' // th'), ' on', ' /* on */ ') AS t FROM documents)""")
def _(v):
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(" th"), F.lit(" // th")), F.lit(" on"), F.lit(" /* on */ "))
    return v.table("documents").select("doc_id", F.md5(S.normalize_body(text).cast("binary")).alias("norm"))


@query("u4_tokens", "SELECT doc_id, ceil(strlen(coalesce(text, '')) / 3.5)::BIGINT AS tokens FROM documents")
def _(v):
    return v.table("documents").select("doc_id", S.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


@query("u5_strip_literal", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE '"' || p_name || chr(39) END AS bare FROM part""")
def _(v):
    q = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit('"'), "p_name", F.lit("'")))
    return v.table("part").select("p_partkey", S.strip_literal(q).alias("bare"))


@query("u7_summary", """SELECT n_regionkey AS region, '<community of ' || count(*) || ' nodes>' AS title, '<community of ' || count(*) || ' nodes> ' || array_to_string(list_slice(list(n_name ORDER BY n_nationkey), 1, 3), ', ') AS description FROM nation GROUP BY 1""")
def _(v):
    members = v.table("nation").select(F.col("n_regionkey").alias("community"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"))
    return graph.communities(members).withColumnRenamed("community", "region")


@query("x9_resolve", """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'a/n' || n_nationkey || '.ts' WHEN 1 THEN 'a/b/m.mts' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'a/b/c/d/x.tsx' END AS file FROM nation""")
def _(v):
    k = F.col("n_nationkey")
    spec = F.when(k % 5 == 0, F.concat(F.lit("../n"), k.cast("string"), F.lit(".js"))).when(k % 5 == 1, "./m.mjs").when(k % 5 == 2, "../../../x.ts").when(k % 5 == 3, F.when(k % 2 == 0, "react").otherwise("./x")).otherwise("./c/../c/d/./x.jsx")
    return v.table("nation").select("n_nationkey", S.resolve_import(F.lit("a/b/f.ts"), spec).alias("file"))


@query("a3_safe_id", "SELECT c_custkey, 'pkg:' || regexp_replace(c_name || ' +' || c_mktsegment, '[^A-Za-z0-9_./@-]', '_', 'g') AS id FROM customer")
def _(v):
    return v.table("customer").select("c_custkey", S.safe_id("pkg:", F.concat("c_name", F.lit(" +"), "c_mktsegment")).alias("id"))


@query("a4_strip_spec", "SELECT p_partkey, 'p' || p_partkey AS name FROM part")
def _(v):
    specs = F.array(*(F.lit(x) for x in ("==1", ">=2,<3", "~=1", "[x]", " ; extra")))
    return v.table("part").select("p_partkey", S.strip_version(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.element_at(specs, (F.col("p_partkey") % 5 + 1).cast("int")))).alias("name"))


@query("f9_identifiers", r"""SELECT doc_id, p - 1 AS pos, ws[p] AS name FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]*$')) AS ws FROM documents))""")
def _(v):
    return v.table("documents").select("doc_id", F.posexplode(S.identifiers(F.coalesce("text", F.lit("")))).alias("pos", "name")).withColumn("pos", F.col("pos").cast("long"))


# --- graph store --------------------------------------------------------------------------------------------


def _old_new(v):
    n = v.nodes()
    return n.filter("kind <> 'Method'"), n.filter("kind IN ('Class', 'Method')").withColumn("signature", F.concat("signature", F.lit("!")))


@query("k1_upsert_nodes", f"WITH {NODES} SELECT id, kind, CASE WHEN kind IN ('Class', 'Method') THEN signature || '!' ELSE signature END AS signature FROM nodes")
def _(v):
    return graph.upsert_nodes(*_old_new(v)).select("id", "kind", "signature")


def _edge_halves(v):
    e = v.edges()
    again = e.filter("type = 'CALLS'").withColumn("ord", F.col("ord") + 7)
    return e, again.union(e.filter("type = 'IMPORTS'").withColumn("dst", F.concat("dst", F.lit("x"))))


@query("k2_upsert_edges", _WITH + "SELECT src, type, dst FROM edges UNION ALL SELECT src, type, dst || 'x' FROM edges WHERE type = 'IMPORTS'")
def _(v):
    return graph.upsert_edges(*_edge_halves(v)).select("src", "type", "dst")


@query("k2_strict_edges", _WITH + "SELECT src, type, dst FROM edges")
def _(v):
    return graph.upsert_edges(*_edge_halves(v), nodes=v.nodes()).select("src", "type", "dst")


@query("k3_upsert_vectors", f"WITH {NODES}, {VECTORS} SELECT node_id, payload_kind, CASE WHEN payload_kind = 'Block' THEN 'new' ELSE repo END AS repo FROM vectors")
def _(v):
    x = v.vectors()
    return vectors.upsert(x, x.filter("payload_kind = 'Block'").withColumn("repo", F.lit("new"))).select("node_id", "payload_kind", "repo")


@query("k5_export_nodes", f"WITH {NODES} SELECT id, kind, path, qn FROM nodes WHERE repo = 'repo_1'")
def _(v):
    return graph.export_nodes(v.nodes(), repo="repo_1").select("id", "kind", "path", "qn")


@query("k5_export_edges", _WITH + "SELECT src, type, dst FROM edges")
def _(v):
    return graph.export_edges(v.edges()).select("src", "type", "dst")


@query("k7_edge_attrs", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1 END::BIGINT AS n FROM events")
def _(v):
    wide = F.when(F.col("event_id") % 3 == 0, F.lit("{bad")).otherwise(F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "nested": {"a": 1}, "list": [1]}')))
    row = v.table("events").select("event_id", graph.edge_attributes(wide).alias("a"))
    return row.select("event_id", F.col("a")["k"].alias("k"), F.when(F.col("a").isNotNull() & F.col("a")["k"].isNotNull(), F.size("a")).cast("long").alias("n"))


@query("f1_list_nodes", f"WITH {NODES} SELECT id, qn FROM (SELECT * FROM nodes WHERE kind = 'Function' AND starts_with(path, 'src/n1') AND repo = 'repo_1' ORDER BY ord LIMIT 25)")
def _(v):
    return graph.list_nodes(v.nodes(), "Function", "src/n1", "repo_1", limit=25).select("id", "qn")


@query("f2_list_edges", _WITH + "SELECT src, dst FROM (SELECT * FROM edges WHERE type = 'DEPENDS_ON' ORDER BY ord LIMIT 40)")
def _(v):
    return graph.list_edges(v.edges(), "DEPENDS_ON", limit=40).select("src", "dst")


@query("f3_get_node", f"WITH {NODES} SELECT id, qn, kind FROM nodes WHERE kind = 'File' AND key = 3")
def _(v):
    return graph.get_node(v.nodes(), S.stable_id(F.lit(REPO), F.lit(SEED), F.lit("File"), F.lit(SEED))).select("id", "qn", "kind")


@query("f4_find_qn", f"WITH {NODES} SELECT id, qn FROM nodes WHERE qn = 'c7' OR ends_with(qn, '::c7')")
def _(v):
    return graph.find_by_name(v.nodes(), "c7").select("id", "qn")


@query("f5_vec_filter", f"WITH {NODES}, {VECTORS} SELECT node_id, ord FROM vectors WHERE repo = 'repo_1' AND run = 'run_2' AND payload_kind = 'FunctionSummary'")
def _(v):
    return vectors.filtered(v.vectors(), "repo_1", "run_2", "FunctionSummary").select("node_id", "ord")


@query("f6_vec_summary", f"WITH {NODES}, {VECTORS} SELECT node_id, payload_kind, repo, run FROM vectors WHERE run = 'run_1'")
def _(v):
    return vectors.list_by_run(v.vectors(), "run_1").select("node_id", "payload_kind", "repo", "run")


@query("f7_payloads", f"WITH {NODES} SELECT id AS node_id, 'FunctionSummary' AS payload_kind, qn || chr(10) || signature AS text FROM nodes WHERE kind <> 'File'")
def _(v):
    return vectors.payloads(v.nodes())


@query("f8_violations", f"WITH {NODES} SELECT id, CASE WHEN key % 4 = 1 THEN 'kind' ELSE 'evidence' END AS rule FROM nodes WHERE key % 4 IN (1, 2)")
def _(v):
    key = F.regexp_extract("qn", r"([0-9]+)(\.ts)?$", 1).cast("long")
    bad = v.nodes().withColumn("kind", F.when(key % 4 == 1, "Thing").otherwise(F.col("kind"))).withColumn("end", F.when(key % 4 == 2, F.lit(0)).otherwise(F.col("end")))
    return graph.violations(bad).select("id", "rule")


_EXACT = f"""ids AS (SELECT pos, name FROM (VALUES (0, 'what'), (1, 'calls'), (2, 'c7'), (3, 'and'), (4, 'S3'), (5, 'or'), (6, 'p11'), (7, 'c7')) t(pos, name)),
ex AS (SELECT id, path, s, e, 1.0::DOUBLE AS score, pos::BIGINT AS a, ord AS b FROM (SELECT n.*, pos, row_number() OVER (PARTITION BY pos ORDER BY ord) AS r FROM ids JOIN nodes n ON qn = name OR ends_with(qn, '::' || name)) WHERE r <= 20)"""
_SEM = f"""hits AS (SELECT node_id, score, row_number() OVER (ORDER BY score DESC, ord) AS a FROM (SELECT *, {_cosine('vector', QVEC)} AS score FROM vectors) ORDER BY score DESC, ord LIMIT 30),
se AS (SELECT n.id, n.path, n.s, n.e, score, a::BIGINT AS a, 0::BIGINT AS b FROM hits JOIN nodes n ON n.id = node_id)"""
_CAND = f"""{_EXACT}, {_SEM}, ba AS (SELECT *, 0 AS source FROM ex UNION ALL SELECT *, 1 FROM se),
bp AS (SELECT *, row_number() OVER (ORDER BY source, a, b) AS pos FROM ba),
b1 AS (SELECT id, arg_min(score, pos) AS score, min(pos) AS pos FROM bp GROUP BY id),
ways AS (SELECT src AS near, dst AS far, ord FROM edges UNION ALL SELECT dst, src, ord FROM edges WHERE src <> dst),
gr0 AS (SELECT far, pos, ord, score, row_number() OVER (PARTITION BY far ORDER BY pos, ord) AS r FROM ways JOIN b1 ON near = b1.id WHERE far NOT IN (SELECT id FROM b1)),
gr AS (SELECT n.id, n.path, n.s, n.e, greatest(0.0, score * 0.8) AS score, pos::BIGINT AS a, gr0.ord::BIGINT AS b, 2 AS source FROM gr0 JOIN nodes n ON n.id = far WHERE r = 1),
ca AS (SELECT * FROM ba UNION ALL SELECT * FROM gr),
me0 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, source, a, b) AS r, row_number() OVER (PARTITION BY id ORDER BY source, a, b) AS q FROM ca),
pl AS (SELECT id, row_number() OVER (ORDER BY source, a, b, id) AS pos FROM me0 WHERE q = 1),
me AS (SELECT x.id, path, s, e, score, source, pl.pos FROM me0 x JOIN pl ON pl.id = x.id WHERE r = 1 AND pl.pos <= 60),
rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, pos) AS rank FROM me)"""
_WITH_ALL = f"WITH {NODES}, {EDGES}, {VECTORS}, {FILES}, {_CAND} "


def _query_vector(v):
    return S.hash_embedding(F.lit(QUERY_TEXT), DIM)


def _parts(v):
    return v.nodes(), v.edges(), v.vectors(), retrieval.query_row(v.spark, QUERY_TEXT), _query_vector(v)


@query("j1_exact", f"WITH {NODES}, {_EXACT} SELECT id, a AS pos FROM ex")
def _(v):
    return retrieval.exact(v.nodes(), retrieval.query_row(v.spark, QUERY_TEXT)).select("id", F.col("a").alias("pos"))


@query("j2_hits_nodes", f"WITH {NODES}, {VECTORS}, {_SEM} SELECT id, path, a AS pos FROM se")
def _(v):
    return retrieval.semantic(v.nodes(), v.vectors(), _query_vector(v)).select("id", "path", F.col("a").alias("pos"))


@query("r4_semantic", f"WITH {NODES}, {VECTORS}, {_SEM} SELECT id, round(score, 6) AS score FROM se")
def _(v):
    return retrieval.semantic(v.nodes(), v.vectors(), _query_vector(v)).select("id", F.round("score", 6).alias("score"))


@query("r5_graph", _WITH_ALL + "SELECT id, round(score, 6) AS score FROM gr")
def _(v):
    n, e, x, q, qv = _parts(v)
    return retrieval.candidates(n, e, x, q, qv).filter("source = 2").select("id", F.round("score", 6).alias("score"))


@query("r6_merge", _WITH_ALL + "SELECT id, source, round(score, 6) AS score FROM me0 WHERE r = 1")
def _(v):
    n, e, x, q, qv = _parts(v)
    return retrieval.merged(retrieval.candidates(n, e, x, q, qv), retrieval.Limits(rerank=1_000_000)).select("id", "source", F.round("score", 6).alias("score"))


@query("r7_cap60", _WITH_ALL + "SELECT id, pos FROM me")
def _(v):
    n, e, x, q, qv = _parts(v)
    return retrieval.merged(retrieval.candidates(n, e, x, q, qv)).select("id", "pos")


@query("r9_ranked", _WITH_ALL + "SELECT id, rank, round(score, 6) AS rerank_score FROM rk WHERE rank <= 10")
def _(v):
    n, e, x, q, qv = _parts(v)
    return retrieval.reranked(retrieval.merged(retrieval.candidates(n, e, x, q, qv))).select("id", "rank", F.round("rerank_score", 6).alias("rerank_score"))


_SNIP = "array_to_string(list_slice(regexp_split_to_array(f.text, '\r?\n'), greatest(1, s)::INT, e::INT), chr(10))"


@query("r10_bundle", _WITH_ALL + f"SELECT rank, rk.id, rk.path, s::INT AS line_start, e::INT AS line_end, coalesce({_SNIP}, '') AS text, rk.path || ':' || s || '-' || e AS citation FROM rk LEFT JOIN files f ON f.path = rk.path WHERE rank <= 10")
def _(v):
    n, e, x, q, qv = _parts(v)
    out = retrieval.retrieve(n, e, x, v.files(), q, qv)
    return out.select("rank", "id", "path", F.col("start").alias("line_start"), F.col("end").alias("line_end"), "text", "citation")


@query("r11_jaccard", r"""SELECT a.conv_id, a.turn, CASE WHEN len(u) = 0 THEN 0.0 ELSE round(len(list_intersect(x, y))::DOUBLE / len(u), 6) END AS score
FROM (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(role || ' the of and a'), '\s+'), lambda w: w <> '')) AS y, list_distinct(list_concat(x, y)) AS u FROM conversations) a""")
def _(v):
    return v.table("conversations").select("conv_id", "turn", F.round(S.jaccard(F.coalesce("text", F.lit("")), F.concat("role", F.lit(" the of and a"))), 6).alias("score"))


# --- search -------------------------------------------------------------------------------------------------


def _seed(v):
    return v.spark.range(1).select(S.stable_id(F.lit(REPO), F.lit(SEED), F.lit("File"), F.lit(SEED)).alias("id"))


def _bfs_sql(depth: int, direction: str, types: str = "", out: str = "nodes") -> str:
    where = f"WHERE type IN ({types})" if types else ""
    ways = {"out": f"SELECT src AS near, dst AS far FROM edges {where}", "in": f"SELECT dst AS near, src AS far FROM edges {where}"}
    way = ways.get(direction) or f"{ways['out']} UNION ALL {ways['in']}"
    layers = "".join(f", l{k} AS (SELECT DISTINCT far AS id FROM ways JOIN l{k - 1} ON near = l{k - 1}.id WHERE far NOT IN ({' UNION '.join(f'SELECT id FROM l{j}' for j in range(k))}))" for k in range(1, depth + 1))
    every = " UNION ALL ".join(f"SELECT id, {k} AS depth FROM l{k}" for k in range(depth + 1))
    return _WITH + f", ways AS ({way}), l0 AS (SELECT id FROM nodes WHERE kind = 'File' AND key = 3){layers} SELECT n.id, depth FROM nodes n JOIN ({every}) x ON x.id = n.id"


def _bfs(v, **options):
    return graph.neighbors(v.nodes(), v.edges(), _seed(v), **options)[0].select("id", "depth")


query("g1_bfs_out2", _bfs_sql(2, "out"))(lambda v: _bfs(v, depth=2, direction="out"))
query("g1_bfs_in2", _bfs_sql(2, "in"))(lambda v: _bfs(v, depth=2, direction="in"))
query("g1_bfs_both2", _bfs_sql(2, "both"))(lambda v: _bfs(v, depth=2))
query("g1_bfs_types", _bfs_sql(3, "out", "'IMPORTS'"))(lambda v: _bfs(v, depth=3, direction="out", types=["IMPORTS"]))
query("g1_bfs_limit", _bfs_sql(2, "both", "'IMPORTS'"))(lambda v: _bfs(v, depth=5, types=["IMPORTS"], limit=3))
_NO_CLASS = "NOT IN (SELECT id FROM nodes WHERE kind = 'Class')"
query("g1_bfs_strict", _bfs_sql(2, "both").replace("FROM edges ", f"FROM (SELECT * FROM edges WHERE src {_NO_CLASS} AND dst {_NO_CLASS}) "))(
    lambda v: graph.neighbors(v.nodes().filter("kind <> 'Class'"), v.edges(), _seed(v), depth=2, strict=True)[0].select("id", "depth")
)
query("g6_contains", _WITH + "SELECT f.path, f.qn AS container, n.qn, n.kind FROM edges e JOIN nodes f ON f.id = src JOIN nodes n ON n.id = dst WHERE type = 'CONTAINS'")(lambda v: graph.contained(v.edges(), v.nodes()))


@query("g2_loops", _WITH + "SELECT id, depth FROM (SELECT id, 0 AS depth FROM nodes WHERE kind = 'File' UNION ALL SELECT n.id, 1 FROM nodes n WHERE kind <> 'File')")
def _(v):
    """Every node has a loop: the loops add edges and no nodes."""
    loops = v.nodes().select(F.col("id").alias("src"), F.lit("CONTAINS").alias("type"), F.col("id").alias("dst"), "ord")
    seeds = v.nodes().filter("kind = 'File'").select("id")
    return graph.neighbors(v.nodes(), v.edges().union(loops), seeds, types=["CONTAINS"])[0].select("id", "depth")


@query("g1_bfs_edges", _WITH + "SELECT DISTINCT src, type, dst FROM edges JOIN nodes n ON (n.id = src OR n.id = dst) WHERE n.kind = 'File' AND n.key = 3")
def _(v):
    return graph.neighbors(v.nodes(), v.edges(), _seed(v))[1].select("src", "type", "dst")


@query("g4_expand", _WITH_ALL + "SELECT id, round(score, 6) AS score FROM gr")
def _(v):
    n, e, x, q, qv = _parts(v)
    place = F.row_number().over(Window.orderBy("source", "a", "b"))
    base = retrieval.base(n, x, q, qv).withColumn("pos", place.cast("long")).groupBy(F.col("id").alias("node_id")).agg(F.min_by("score", "pos").alias("score"), F.min("pos").alias("pos"))
    return graph.expand(base, e, n).select("id", F.round("score", 6).alias("score"))


_RELATED = _WITH + "SELECT s.qn AS {}, d.qn AS {} FROM edges e JOIN nodes d ON d.id = dst JOIN nodes s ON s.id = src WHERE type = '{}'"
query("g5_callers", _RELATED.format("caller", "callee", "CALLS"))(lambda v: graph.callers(v.edges(), v.nodes()))
query("g5_callees", _RELATED.format("caller", "callee", "CALLS") + " AND ends_with(s.qn, '::c7')")(lambda v: graph.callees(v.edges(), v.nodes(), graph.find_by_name(v.nodes(), "c7")))
query("g5_importers", _RELATED.format("importer", "imported", "IMPORTS"))(lambda v: graph.importers(v.edges(), v.nodes()))
query("g5_dependents", _RELATED.format("dependent", "dependency", "DEPENDS_ON"))(lambda v: graph.dependents(v.edges(), v.nodes()))
query("j10_edge_ends", _WITH + "SELECT s.kind AS a, type, d.kind AS b, count(*) AS n FROM edges JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst GROUP BY 1, 2, 3")(lambda v: graph.edge_ends(v.edges(), v.nodes()))


# --- vectors ------------------------------------------------------------------------------------------------

_ONE = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _first_vector(v):
    return [float(x) for x in v.table("embeddings").filter("vec_id = 0").first()["embedding"]]


@query("v1_cosine", f"SELECT vec_id, round({_cosine('embedding::DOUBLE[]', _ONE)}, 6) AS score FROM embeddings")
def _(v):
    q = F.array(*(F.lit(x) for x in _first_vector(v)))
    return v.table("embeddings").select("vec_id", F.round(S.cosine("embedding", q), 6).alias("score"))


@query("v2_topk", f"WITH {NODES}, {VECTORS} SELECT ord, round({_cosine('vector', _ONE)}, 6) AS score FROM vectors ORDER BY {_cosine('vector', _ONE)} DESC, ord LIMIT 30")
def _(v):
    return vectors.search(v.vectors(), _first_vector(v)).select("ord", F.round("score", 6).alias("score"))


@query("v2_topk_filtered", f"WITH {NODES}, {VECTORS} SELECT ord, round({_cosine('vector', _ONE)}, 6) AS score FROM vectors WHERE repo = 'repo_1' AND payload_kind = 'Block' ORDER BY {_cosine('vector', _ONE)} DESC, ord LIMIT 10")
def _(v):
    return vectors.search(v.vectors(), _first_vector(v), 10, repo="repo_1", payload_kind="Block").select("ord", F.round("score", 6).alias("score"))


@query("v3_l2_score", f"SELECT vec_id, round(1 / (1 + list_distance(embedding::DOUBLE[], {_ONE})), 6) AS score FROM embeddings")
def _(v):
    q = F.array(*(F.lit(x) for x in _first_vector(v)))
    return v.table("embeddings").select("vec_id", F.round(S.distance_score("embedding", q), 6).alias("score"))


@query("v5_count_by_run", f"WITH {NODES}, {VECTORS} SELECT run, count(*) AS count FROM vectors GROUP BY run")
def _(v):
    return vectors.count_by_run(v.vectors())


@query("s12_list_by_run", f"WITH {NODES}, {VECTORS} SELECT node_id, ord FROM (SELECT * FROM vectors WHERE run = 'run_3' ORDER BY ord LIMIT 20)")
def _(v):
    return vectors.list_by_run(v.vectors(), "run_3", 20).select("node_id", "ord")


@query("v6_hash_embed", "SELECT s_suppkey, i, ('0x' || substr(sha256(s_name || chr(0) || i), 1, 8))::BIGINT::DOUBLE / 4294967295.0 * 2 - 1 AS x FROM supplier, range(1024) t(i)")
def _(v):
    return v.table("supplier").select("s_suppkey", F.posexplode(S.hash_embedding("s_name")).alias("i", "x")).withColumn("i", F.col("i").cast("long"))


@query("k4_pin", f"WITH {NODES}, {VECTORS} SELECT repo, count(*) AS n, 'm1' AS model, 'r' AS revision, min(len(vector))::INT AS dim FROM vectors GROUP BY repo")
def _(v):
    """The identity that a first write fixes, beside the rows that it holds for."""
    rows = v.vectors().withColumns({"model": F.lit("m1"), "revision": F.lit("r")})
    identity = vectors.checked(rows, vectors.identity_of(rows))
    return rows.groupBy("repo").agg(F.count("*").alias("n")).withColumns({k: F.lit(x) for k, x in identity.items()})


query("j4_embed_join", f"WITH {NODES}, {VECTORS} SELECT n.qn, v.payload_kind FROM vectors v JOIN nodes n ON n.id = v.node_id")(lambda v: vectors.with_nodes(v.vectors().select("node_id", "payload_kind"), v.nodes()).select("qn", "payload_kind"))


# --- extraction ---------------------------------------------------------------------------------------------

_LINES = """sup AS (SELECT s_nationkey AS n, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS c FROM supplier),
cus AS (SELECT c_nationkey AS n, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, min(c_custkey) OVER (PARTITION BY c_nationkey) AS m, coalesce((SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey), 0) AS c FROM customer)"""


@query("x1_file_nodes", f"WITH {FILES} SELECT path, len(string_split(text, chr(10))) AS line_end, 'cnt_' || sha1('' || chr(0) || trim(regexp_replace(text, '[\\s]+', ' ', 'g')) || chr(0)) AS content_hash FROM files")
def _(v):
    return extract.file_nodes(v.files(), REPO).select("path", F.col("end").cast("long").alias("line_end"), "content_hash")


@query("x2_regex_decls", f"WITH {_LINES} SELECT 'src/n' || n || '.ts::S' || k AS qn, 'Class' AS kind, 'S' || k AS signature, 2 + 8 * (r - 1) AS line FROM sup UNION ALL SELECT 'src/n' || n || '.ts::c' || k, 'Function', 'c' || k || '(a, b)', 2 + 8 * c + 3 * (r - 1) FROM cus")
def _(v):
    return extract.regex_declarations(v.files(), REPO).select("qn", "kind", "signature", F.col("start").cast("long").alias("line"))


@query("x3_ts_decls", f"""WITH {_LINES} SELECT 'src/n' || n || '.ts::S' || k || m AS qn, kind, 1 + 8 * (r - 1) + a AS line_start, 1 + 8 * (r - 1) + b AS line_end FROM sup, (VALUES ('', 'Class', 1, 8), ('.run', 'Method', 2, 4), ('.stop', 'Method', 5, 7)) t(m, kind, a, b)
UNION ALL SELECT 'src/n' || n || '.ts::c' || k, 'Function', 2 + 8 * c + 3 * (r - 1), 4 + 8 * c + 3 * (r - 1) FROM cus""")
def _(v):
    return extract.declarations(extract.scanned(v.files()), REPO).select("qn", "kind", F.col("start").cast("long").alias("line_start"), F.col("end").cast("long").alias("line_end"))


@query("j5_call_resolution", f"WITH {_LINES} SELECT 'src/n' || n || '.ts::S' || k || '.run' AS caller, 'src/n' || n || '.ts::S' || k || '.stop' AS callee FROM sup UNION ALL SELECT 'src/n' || n || '.ts::c' || k, 'src/n' || n || '.ts::c' || m FROM cus WHERE k <> m")
def _(v):
    rows = extract.scanned(v.files())
    return extract.resolved_calls(rows, extract.declarations(rows, REPO))


@query("x6_calls", f"WITH {_LINES} SELECT 'src/n' || n || '.ts' AS path, 'self' AS kind, 'stop' AS name, 'S' || k || '.run' AS target FROM sup UNION ALL SELECT 'src/n' || n || '.ts', 'bare', 'c' || m, 'c' || k FROM cus")
def _(v):
    return extract.scanned(v.files()).filter("what = 'call'").select("path", "kind", "name", "target")


@query("x7_imports", "SELECT 'src/n' || n_nationkey || '.ts' AS path, './n' || ((n_nationkey + 1) % 25) || '.js' AS target, 'src/n' || ((n_nationkey + 1) % 25) || '.ts' AS file FROM nation")
def _(v):
    return extract.imports(extract.scanned(v.files()), REPO).select("path", "target", "file")


_PY_HEADS = ("while a:", "if a > 1:", "for x in a:", "with a:")
_PY_KINDS = ("while_statement", "if_statement", "for_statement", "with_statement")
_TS_HEADS = ("while (a) {", "if (a) {", "for (const x of a) {", "for (let i = 0; i < a; i++) {")
_TS_KINDS = ("while_statement", "if_statement", "for_in_statement", "for_statement")


def _long_files(v):
    """For each nation a file of Python and one of TypeScript with declarations and a long function of 64 blocks of four kinds."""
    name = F.col("n_nationkey").cast("string")
    pick = lambda heads, i: F.element_at(F.array(*(F.lit(x) for x in heads)), (i % 4 + 1).cast("int"))
    lines = lambda heads, row: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: row(pick(heads, i))), "")
    py = F.concat(F.lit("import os, json as j\nfrom .core import x\n\ndef helper(a):\n    return a\n\nclass K"), name, F.lit(":\n    def go(self, a):\n        return self.stop(a)\n\n    def stop(self, a):\n        return helper(a)\n\ndef long(a):\n"), lines(_PY_HEADS, lambda h: F.concat(F.lit("    "), h, F.lit("\n        a = helper(a)\n"))), F.lit("    return a\n"))
    ts = F.concat(F.lit("export function long(a) {\n"), lines(_TS_HEADS, lambda h: F.concat(F.lit("  "), h, F.lit("\n    a = helper(a);\n  }\n"))), F.lit("  return a;\n}\n"))
    n = v.table("nation")
    files_ = n.select(F.concat(F.lit("py/m"), name, F.lit(".py")).alias("path"), F.lit("python").alias("language"), py.alias("text"))
    return files_.union(n.select(F.concat(F.lit("ts/m"), name, F.lit(".ts")), F.lit("typescript"), ts))


@query("x4_py_decls", """SELECT 'py/m' || n_nationkey || '.py::' || replace(m, '@', 'K' || n_nationkey) AS qn, kind, a AS line_start, b AS line_end FROM nation, (VALUES ('helper', 'Function', 4, 5), ('@', 'Class', 7, 12), ('@.go', 'Method', 8, 9), ('@.stop', 'Method', 11, 12), ('long', 'Function', 14, 143)) t(m, kind, a, b)""")
def _(v):
    return extract.declarations(extract.scanned(_long_files(v).filter("language = 'python'")), REPO).select("qn", "kind", F.col("start").cast("int").alias("line_start"), F.col("end").cast("int").alias("line_end"))


@query("x8_blocks", f"""SELECT 'py/m' || n_nationkey || '.py::long#block:' || i || ':' || {list(_PY_KINDS)}[i % 4 + 1] AS qn, (15 + 2 * i)::INT AS line_start, (16 + 2 * i)::INT AS line_end FROM nation, range(64) t(i)
UNION ALL SELECT 'ts/m' || n_nationkey || '.ts::long#block:' || i || ':' || {list(_TS_KINDS)}[i % 4 + 1], (2 + 3 * i)::INT, (4 + 3 * i)::INT FROM nation, range(64) t(i)""")
def _(v):
    return extract.blocks(extract.scanned(_long_files(v))).select("qn", F.col("start").cast("int").alias("line_start"), F.col("end").cast("int").alias("line_end"))


# --- build metadata -----------------------------------------------------------------------------------------

_MERGED = f"WITH {COMPONENTS}, m AS (SELECT id, arg_min(kind, writer) AS kind, arg_min(name, writer) AS name, arg_min(path, writer) AS path, list_sort(list_distinct(flatten(list(deps)))) AS deps FROM components GROUP BY id) "


@query("a7_merge", _MERGED + "SELECT id, kind, name, path, array_to_string(deps, ',') AS deps FROM m")
def _(v):
    return rig.merged_components(v.components()).withColumn("deps", F.array_join("deps", ","))


@query("j6_rig_deps", _MERGED + "SELECT DISTINCT m.id AS src, d AS dst FROM (SELECT id, unnest(deps) AS d FROM m) m WHERE d IN (SELECT id FROM components)")
def _(v):
    return rig.dependencies(rig.merged_components(v.components()))


@query("j7_rig_children", _MERGED + "SELECT id, kind, component_id FROM targets WHERE component_id IN (SELECT id FROM m)")
def _(v):
    return rig.children(v.targets(), rig.merged_components(v.components())).select("id", "kind", "component_id")


@query("j8_workspace_deps", "SELECT n_name AS name, CASE WHEN n_regionkey = 0 THEN '' ELSE (SELECT n_name FROM nation b WHERE b.n_nationkey = a.n_regionkey) END AS deps FROM nation a")
def _(v):
    n = v.table("nation")
    dep = n.select(F.col("n_nationkey").alias("n_regionkey"), F.col("n_name").alias("d"))
    rows = n.join(dep, "n_regionkey").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 0, F.array(F.lit("left-pad"))).otherwise(F.array("d", F.lit("left-pad"))).alias("deps"))
    return rig.workspace_dependencies(rows).select("name", F.array_join("deps", ",").alias("deps"))


@query("a2_globs", "SELECT DISTINCT 'packages/' || n_name AS path FROM nation WHERE n_regionkey IN (0, 1) UNION ALL SELECT DISTINCT 'libs/' || n_name FROM nation WHERE n_regionkey = 3 AND n_nationkey = 6")
def _(v):
    """Folders right below one parent, a hidden one, deeper ones, and one that is named."""
    where = F.when(F.col("n_regionkey") == 2, "packages/.").when(F.col("n_regionkey") == 4, "packages/deep/").when(F.col("n_regionkey") == 3, "libs/").otherwise("packages/")
    listing = v.table("nation").select(F.concat(where, "n_name").alias("path"))
    named = v.table("nation").filter("n_nationkey = 6").first()["n_name"]
    return rig.matched_folders(listing, ["packages/*", f"libs/{named}/", "libs/**", "other*"])


@query("a9_default", "SELECT 'comp_root' AS id, 'package' AS kind, '.' AS path")
def _(v):
    return v.spark.createDataFrame([(c["id"], c["kind"], c["path"]) for c in build_files.default_graph()["components"]], "id string, kind string, path string")


_PACKAGES = """pk AS (SELECT c_custkey AS k, 'pkg:c' || c_custkey AS id, 'c' || c_custkey AS name, 'c ' || (c_custkey + 1) AS dep FROM customer WHERE c_custkey % 7 <> 0)"""


def _packages(v):
    """A package for each customer, a seventh of them broken, that needs the next customer's and a foreign one."""
    k = F.col("c_custkey")
    text = F.when(k % 7 == 0, "{broken").otherwise(F.concat(F.lit('{"name": "c'), k.cast("string"), F.lit('", "scripts": {"build": "x", "lint": "y", "dev": "z"}, "devDependencies": {"c'), (k + 1).cast("string"), F.lit('": "*", "left-pad": "1"}}')))
    return v.table("customer").select(F.concat(F.lit("packages/c"), k.cast("string")).alias("path"), text.alias("text"))


@query("a1_package_json", f"WITH {_PACKAGES} SELECT a.id, 'package' AS kind, a.name, 'packages/' || a.name AS path, coalesce(b.id, '') AS deps FROM pk a LEFT JOIN pk b ON b.k = a.k + 1")
def _(v):
    return rig.package_components(_packages(v)).withColumn("deps", F.array_join("deps", ","))


@query("a1_package_targets", f"WITH {_PACKAGES} SELECT id || ':' || s AS id, kind, id AS component_id FROM pk, (VALUES ('build', 'build'), ('dev', 'run')) t(s, kind)")
def _(v):
    return rig.package_targets(_packages(v), build_files.SCRIPTS)


_RIG_ID = "'sym_' || sha1('r' || chr(0) || p || chr(0) || {kind} || chr(0) || {id} || chr(0))"


@query("g7_materialize", _MERGED + f""", tests AS (SELECT 'x' || s_suppkey AS id, 'pkg:n' || (s_suppkey % 27) AS component_id FROM supplier), wh AS (SELECT *, CASE WHEN path = '' THEN '.' ELSE path END AS p FROM m),
c AS (SELECT id, p, {_RIG_ID.format(kind="'RigComponent'", id='id')} AS node FROM wh),
k AS (SELECT 'RigTarget' AS kind, t.id, p, node AS of, {_RIG_ID.format(kind="'RigTarget'", id='t.id')} AS node FROM targets t JOIN c ON c.id = component_id
  UNION ALL SELECT 'RigTest', t.id, p, node, {_RIG_ID.format(kind="'RigTest'", id='t.id')} FROM tests t JOIN c ON c.id = component_id)
SELECT 'RigComponent' AS kind, id AS qn, p AS path, node AS id FROM c UNION ALL SELECT kind, id, p, node FROM k
UNION ALL SELECT 'DEPENDS_ON', a.node, b.node, '' FROM (SELECT id, unnest(deps) AS d FROM m) x JOIN c a ON a.id = x.id JOIN c b ON b.id = d
UNION ALL SELECT 'DECLARED_BY', node, of, '' FROM k""")
def _(v):
    """Nodes, and edges in the same columns: type, both ends, nothing."""
    nodes, edges = rig.materialized(rig.merged_components(v.components()), v.targets(), v.tests(), REPO)
    return nodes.select("kind", "qn", "path", "id").union(edges.select("type", "src", "dst", F.lit("")))


# --- manifest -----------------------------------------------------------------------------------------------

query("m2_state", f"WITH {EVENTS} SELECT batch_id, CASE arg_max(turn, turn) WHEN 1 THEN 'pending' ELSE arg_max(to_status, turn) END AS status, max(CASE WHEN turn > 1 AND to_status = 'committed' THEN seen END) AS committed_at FROM v WHERE valid GROUP BY batch_id")(lambda v: manifest.state(v.events()))
query("m2_invalid", f"WITH {EVENTS} SELECT event_id, batch_id FROM v WHERE NOT valid")(lambda v: manifest.invalid(v.events()).select("event_id", "batch_id"))
query("m4_events", f"WITH {EVENTS} SELECT event_id, batch_id, CASE WHEN turn > 1 THEN 'pending' END AS from_status, CASE WHEN turn = 1 THEN 'pending' ELSE to_status END AS to_status FROM v WHERE valid")(lambda v: manifest.log(v.events()))
query("m1_dup_batches", f"WITH {EVENTS} SELECT batch_id, count(*) AS n FROM ev GROUP BY 1 HAVING count(*) > 1")(lambda v: manifest.refused(v.events().select("batch_id").limit(0), v.events()))


@query("m3_runs", "SELECT user_id::VARCHAR AS batch_id, min(ts) AS created_at FROM events WHERE user_id % 10 = 3 GROUP BY user_id")
def _(v):
    batches = v.events().groupBy("batch_id").agg(F.min("at").alias("created_at")).withColumn("run", (F.col("batch_id").cast("long") % 10).cast("string"))
    return manifest.batches_for_run(batches, "3").select("batch_id", "created_at")


@query("m5_ingestion", "SELECT user_id % 10 AS run, max(ts) FILTER (WHERE event_type = 'signup') AS started_at, max(ts) AS finished_at, max(event_id) FILTER (WHERE event_type = 'signup') >= 0 AS replaced FROM events GROUP BY 1")
def _(v):
    """Runs are recorded at every event, again at every signup (which replaces the row whole), and finished by the last event."""
    rows = v.table("events").select((F.col("user_id") % 10).alias("run"), F.col("ts").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(False).alias("replaced"), "event_type")
    runs = manifest.recorded_ingestions(rows.drop("event_type"), rows.filter("event_type = 'signup'").drop("event_type").withColumn("replaced", F.lit(True)))
    return manifest.finished_ingestions(runs, rows.select("run", F.col("started_at").alias("finished_at")))


@query("m3_batch", "SELECT user_id::VARCHAR AS batch_id, min(ts) AS created_at FROM events WHERE user_id = 13 GROUP BY user_id")
def _(v):
    return manifest.batch(v.events().groupBy("batch_id").agg(F.min("at").alias("created_at")), "13")


@query("m6_tree_hash", f"WITH {FILES} SELECT 'cnt_' || sha1(string_agg(path || chr(0) || sha1(text) || chr(0), '' ORDER BY path)) AS hash FROM files")
def _(v):
    return v.spark.createDataFrame([(S.folded_tree_hash(v.files()),)], "hash string")


@query("m7_checksum", "SELECT user_id % 10 AS run, sha256(count(*) || chr(0) || count(DISTINCT user_id) || chr(0) || count(DISTINCT event_type) || chr(0)) AS checksum FROM events GROUP BY 1")
def _(v):
    rows = v.table("events").groupBy((F.col("user_id") % 10).alias("run")).agg(F.count("*").alias("a"), F.countDistinct("user_id").alias("b"), F.countDistinct("event_type").alias("c"))
    return rows.select("run", S.checksum("a", "b", "c").alias("checksum"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retrieval query, end to end."""
    return QUERIES["r10_bundle"](spark, sf_dir)
