"""Queries for readers, writers, inspection, validation and column functions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import build as B
from ..operators import classify as L
from ..operators import inspect as I
from ..operators import validate as V
from ..runtime import checkpoint_root
from ..sources import csv_export as C
from ..sources import documents as D
from ..sources import text_files as X
from . import facts as K
from . import graphs as G
from .registry import query


def scratch(spark):
    """A fresh folder beside the cut tables."""
    return f"{checkpoint_root(spark)}/out-{uuid.uuid4().hex}"


FNV = (
    "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda x: unicode(x)::BIGINT)), "
    "lambda h, x: (xor(h, x) * 16777619) % 4294967296)"
)
HUNDREDTHS = (
    "({0} // 100 || CASE WHEN {0} % 100 = 0 THEN '' WHEN {0} % 10 = 0 THEN '.' || {0} % 100 // 10 ELSE '.' || lpad(({0} % 100)::VARCHAR, 2, '0') END)"
)


def _fnv(c):
    return f"CASE WHEN {c} = '' THEN 2166136261 ELSE {FNV.format(c)} END"


# --- graph documents: one document per order with its customer ---------------------------------

def _documents(spark, d):
    place = G.places(spark, d)
    c = F.col("c_custkey").cast("string")
    o = F.col("o_orderkey").cast("string")

    def source(line):
        return F.struct(F.lit("f1").alias("file"), line.cast("int").alias("line"))

    node = [
        F.struct(F.concat(F.lit("c"), c).alias("id"), F.lit("source").alias("kind"), F.col("c_name").alias("label"),
                 F.col("function"), F.array("c_name").alias("names"), F.lit(0.0).alias("order"), source(F.lit(3)).alias("source")),
        F.struct(F.concat(F.lit("o"), o).alias("id"), F.lit("machine").alias("kind"), F.col("o_orderpriority").alias("label"),
                 F.col("function"), F.array().cast("array<string>").alias("names"), F.lit(1.0).alias("order"),
                 source(F.col("o_orderkey") % 40).alias("source")),
    ]
    graph = F.struct(
        F.lit(1).alias("version"), F.concat(F.lit("r"), o).alias("revision"),
        F.array(F.struct(F.lit("/src").alias("path"), F.lit("trade").alias("module"))).alias("projects"),
        F.array(F.struct(F.col("function").alias("id"), F.col("n_name").alias("name"), "package")).alias("functions"),
        F.array(*node).alias("nodes"),
        F.array(F.struct(F.lit("e1").alias("id"), node[0]["id"].alias("from"), node[1]["id"].alias("to"), F.lit("belt").alias("kind"),
                         F.col("o_orderstatus").alias("type"))).alias("edges"),
        F.create_map(F.lit("f1"), F.concat(F.lit("/src/"), o)).alias("files"),
    )
    return (
        G.table(spark, d, "orders").join(G.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(place, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_custkey", "o_orderstatus", "function", "package", graph.alias("graph"))
    )


def _graph_tables(spark, d):
    path = scratch(spark)
    _documents(spark, d).select(F.to_json("graph").alias("value")).write.text(path)
    return D.read_graph(spark, path, multi_line=False)


@query("read_graph_nodes", """
SELECT 'r' || o_orderkey AS rev, 'c' || c_custkey AS id, 'source' AS kind, c_name AS label, '' AS detail, c_name AS names, 0.0::DOUBLE AS ord, false AS helper, 3 AS line, 0 AS seq
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'r' || o_orderkey, 'o' || o_orderkey, 'machine', o_orderpriority, '', '', 1.0, false, (o_orderkey % 40)::INT, 1 FROM orders""")
def _(spark, d):
    return _graph_tables(spark, d)["nodes"].select(
        "rev", "id", "kind", "label", "detail", F.array_join("names", ",").alias("names"), "ord", "helper", F.col("source.line").alias("line"),
        F.col("seq").cast("int").alias("seq"),
    )


@query("read_graph_edges", """
SELECT 'r' || o_orderkey AS rev, 'e1' AS id, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'belt' AS kind, '' AS label, o_orderstatus AS type FROM orders""")
def _(spark, d):
    return _graph_tables(spark, d)["edges"].drop("seq")


@query("read_graph_files", "SELECT 'r' || o_orderkey AS rev, 'f1' AS file_id, '/src/' || o_orderkey AS path, 'trade' AS module, 'static-ssa' AS mode FROM orders")
def _(spark, d):
    t = _graph_tables(spark, d)
    return t["files"].join(t["projects"], "rev").join(t["snapshots"], "rev").select("rev", "file_id", t["files"]["path"].alias("path"), "module", "mode")


# --- snapshot documents: every third order is a bare graph, every 50th is damaged --------------

FORMAT = "flow-snapshot"


def _snapshot_path(spark, d):
    path = scratch(spark)
    k = F.col("o_orderkey")
    o = k.cast("string")
    view = F.struct(F.when(k % 5 == 0, "nowhere").otherwise(F.col("function")).alias("fn"), F.lit(0).alias("part"),
                    F.create_map(F.lit("train"), F.lit(False), F.lit("belt"), F.lit(True)).alias("layers"))
    record = F.struct(
        view.alias("view"), F.array(F.struct(F.concat(F.lit("o"), o).alias("id"), (k % 90 * 32 + 16.0).alias("x"), F.lit(16.0).alias("y"))).alias("nodes"),
        F.array(F.struct(F.lit("e1").alias("id"), F.transform(
            F.sequence(F.lit(0), (k % 4 + 1).cast("int")), lambda i: F.struct(i.alias("x"), F.lit(2).alias("y"), F.lit(0).alias("layer"))
        ).alias("cells"), F.lit(0).alias("startDir"), F.lit(2).alias("endDir"))).alias("edges"),
    )
    whole = F.struct(
        F.when(k % 50 == 1, "other").otherwise(FORMAT).alias("format"), F.lit(1).alias("version"), "graph",
        F.create_map(F.when(k % 7 == 0, "f9").otherwise("f1"), F.lit("text")).alias("sources"),
        F.when(k % 11 == 0, F.array(record, record)).otherwise(F.array(record)).alias("layouts"), view.alias("view"),
        F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.when(k % 13 == 0, 9.0).otherwise(1.0).alias("zoom")).alias("camera"),
        F.when(k % 17 == 0, 3.0).otherwise(2.0).alias("speed"),
    )
    docs = _documents(spark, d).select(
        F.concat(F.lit("\ufeff"), F.when(k % 3 == 0, F.to_json("graph")).otherwise(F.to_json(whole))).alias("value")
    )
    docs.write.text(path)
    return path


@query("read_snapshot", """
SELECT 'r' || o_orderkey AS rev, CASE WHEN o_orderkey % 3 = 0 THEN 'legacy' WHEN o_orderkey % 50 = 1 THEN 'other' ELSE 'flow-snapshot' END AS format,
  CASE WHEN o_orderkey % 3 = 0 THEN 1.0 WHEN o_orderkey % 17 = 0 THEN 3.0 ELSE 2.0 END::DOUBLE AS speed,
  2 AS nodes, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS sources FROM orders""")
def _(spark, d):
    t = D.read_snapshot(spark, _snapshot_path(spark, d), one_per_file=False)
    nodes = t["nodes"].groupBy("rev").agg(F.count(F.lit(1)).cast("int").alias("nodes"))
    sources = t["sources"].groupBy("rev").agg(F.count(F.lit(1)).cast("int").alias("sources"))
    return t["snapshots"].join(nodes, "rev").join(sources, "rev", "left").select(
        "rev", F.coalesce("format", F.lit("legacy")).alias("format"), "speed", "nodes", F.coalesce("sources", F.lit(0)).alias("sources")
    )


@query("validate_snapshot", """
WITH s AS (SELECT 'r' || o_orderkey AS rev, o_orderkey AS k FROM orders WHERE o_orderkey % 3 <> 0)
SELECT 'format' AS rule, 'snapshots' AS "table", rev AS key FROM s WHERE k % 50 = 1
UNION ALL SELECT 'fn', 'snapshots', 'nowhere' FROM s WHERE k % 5 = 0
UNION ALL SELECT 'fn', 'layouts', 'nowhere' FROM s, (VALUES (0), (1)) v(i) WHERE k % 5 = 0 AND (i = 0 OR k % 11 = 0)
UNION ALL SELECT 'layout_key', 'layouts', '{"fn":"' || CASE WHEN k % 5 = 0 THEN 'nowhere' ELSE 'trade/region/' || r_name || '.' || n_name END || '","pkg":"","part":0,"compact":true,"query":"","layers":{"train":false}}'
  FROM s JOIN orders ON o_orderkey = k JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE k % 11 = 0
UNION ALL SELECT 'source', 'sources', 'f9' FROM s WHERE k % 7 = 0
UNION ALL SELECT 'camera', 'snapshots', rev FROM s WHERE k % 13 = 0
UNION ALL SELECT 'playback', 'snapshots', rev FROM s WHERE k % 17 = 0""")
def _(spark, d):
    from ..operators.selection import normalize_view

    t = D.read_snapshot(spark, _snapshot_path(spark, d), one_per_file=False)
    layouts = normalize_view(t["layouts"].select("rev", "view.*"))
    return V.validate_snapshot(t["snapshots"], layouts, t["functions"], t["sources"], t["files"], FORMAT).drop("message")


@query("read_layouts", """
SELECT 'r' || o_orderkey AS rev, 'e1' AS edge_id, i::INT AS pos, i::INT AS x, 2 AS y, 0 AS layer, 0 AS start_dir, 2 AS end_dir
FROM (SELECT o_orderkey, unnest(range(o_orderkey % 4 + 2)) AS i FROM orders WHERE o_orderkey % 3 <> 0), (VALUES (0), (1)) v(n)
WHERE n = 0 OR o_orderkey % 11 = 0""")
def _(spark, d):
    t = D.read_layouts(D.read_snapshot(spark, _snapshot_path(spark, d), one_per_file=False)["layouts"])
    return t["layout_cells"].join(t["layout_edges"], ["layout_id", "edge_id"]).select(
        F.split("layout_id", r"\|")[0].alias("rev"), "edge_id", "pos", "x", "y", "layer", "start_dir", "end_dir"
    )


# --- tables written and read back ----------------------------------------------------------------

@query("write_graph", G.with_trade("SELECT package AS rev, id, kind, label, type, array_to_string(names, ',') AS names, helper, ord FROM nodes"))
def _(spark, d):
    path = scratch(spark)
    nodes = G.trade_nodes(spark, d).withColumnRenamed("package", "rev")
    D.write_graph({"nodes": nodes}, path)
    back = D.read_tables(spark, path, {"nodes": "rev STRING, id STRING, kind STRING, label STRING, type STRING, names ARRAY<STRING>, helper BOOLEAN, ord DOUBLE"})
    return back["nodes"].withColumn("names", F.array_join("names", ","))


@query("save_snapshot", G.with_trade("SELECT id, kind, 'a' AS saved FROM nodes WHERE NOT helper UNION ALL SELECT id, kind, 'b' FROM nodes"))
def _(spark, d):
    path = scratch(spark)
    nodes = G.trade_nodes(spark, d)
    D.save_snapshot({"nodes": nodes}, path, "a")
    D.save_snapshot({"nodes": nodes}, path, "b")
    D.save_snapshot({"nodes": nodes.filter("NOT helper")}, path, "a")
    parts = [D.load_snapshot(spark, path, k)["nodes"].select("id", "kind", F.lit(k).alias("saved")) for k in ("a", "b")]
    return parts[0].unionByName(parts[1])


CELL = "'\"' || replace({0}, '\"', '\"\"') || '\"'"


def _q(expr):
    return CELL.format(f"({expr})")


@query("export_csv", G.with_trade(f"""
nk AS (SELECT *, CASE WHEN method <> '' THEN method ELSE function END AS key FROM nodes),
keys AS (SELECT key, {_fnv('key')} AS h FROM (SELECT DISTINCT key FROM nk)),
colors AS (SELECT key, 'hsl(' || {HUNDREDTHS.format('(h % 36000)')} || ' ' || (55 + (h >> 12) % 14) || '% ' || (61 + (h >> 20) % 9) || '%)' AS color FROM keys),
tk AS (SELECT type, {_fnv('type')} AS h FROM (SELECT DISTINCT type FROM edges)),
ts AS (SELECT type, ['hexagon', 'pentagon', 'octagon', 'shield'][h % 4 + 1] AS shape,
  'hsl(' || {HUNDREDTHS.format('(h % 36000)')} || ' ' || (60 + (h >> 12) % 13) || '% ' || (62 + (h >> 20) % 9) || '%)' AS color FROM tk)
SELECT 'record,id,kind,label,function,method,package,type,cargo_types,from,to,x,y,width,height,tile_size,length_tiles,bridge_count,points,cells,source_file,source_line,protocol,names,color,cargo_colors,cargo_shapes,original_edges,connection_count,detail' AS line
UNION ALL
SELECT concat_ws(',', '"node"', {_q('id')}, {_q('kind')}, {_q('label')}, {_q('function')}, {_q('method')}, {_q('package')}, {_q('type')}, '', '', '',
  '', '', '', '', '', '', '', '', '', '', '', '', {_q("CASE WHEN len(names) = 0 THEN '[]' ELSE '[' || array_to_string(list_transform(names, lambda x: chr(34) || x || chr(34)), ',') || ']' END")},
  {_q('color')}, '', '', '', '', '')
FROM nk JOIN colors USING (key)
UNION ALL
SELECT concat_ws(',', '"edge"', {_q('id')}, {_q('kind')}, {_q('label')}, '', '', '', {_q('type')}, {_q("'[' || chr(34) || type || chr(34) || ']'")}, {_q('src')}, {_q('dst')},
  '', '', '', '', '', '', '', '', '', '', '', '', '', '', {_q("'[' || chr(34) || color || chr(34) || ']'")}, {_q("'[' || chr(34) || shape || chr(34) || ']'")},
  {_q("'[' || chr(34) || id || chr(34) || ']'")}, '"1"', '')
FROM edges JOIN ts USING (type)"""))
def _(spark, d):
    path = scratch(spark)
    files = spark.range(0).select(F.lit("").alias("file_id"), F.lit("").alias("path"))
    C.export_csv(G.trade_nodes(spark, d), G.trade_edges(spark, d), files, path, scope="project")
    back = spark.read.text(path, lineSep="\r\n")
    return back.select(F.regexp_replace("value", "^\uFEFF", "").alias("line"))


# --- source files ---------------------------------------------------------------------------------

@query("module_manifest", """
SELECT DISTINCT '/src/' || lang || '/' || source AS path, 'example.com/' || lang || '/' || source AS module FROM documents
UNION ALL SELECT 'version', greatest('1.' || max(substr(source, 4)::INT) + 5 || '.0', '1.18.0') FROM documents""")
def _(spark, d):
    manifest = F.concat(
        F.lit("// root\nmodule example.com/"), "lang", F.lit("/"), "source", F.lit("\n\ngo 1."), F.substring("source", 4, 9).cast("int") + 5, F.lit("\n")
    )
    files = G.table(spark, d, "documents").select(F.concat_ws("/", F.lit("/src"), "lang", "source").alias("path"), manifest.alias("content"))
    modules, top = X.module_manifest(files)
    version = top.select(F.lit("version").alias("path"), F.concat_ws(".", "major", "minor", "patch").alias("module"))
    return modules.unionByName(version)


@query("read_sources", "SELECT lang, source, (sum(length(text)) + count(*))::BIGINT AS chars FROM documents GROUP BY lang, source")
def _(spark, d):
    path = scratch(spark)
    G.table(spark, d, "documents").select("text", "lang", "source").write.partitionBy("lang", "source").text(path)
    read = X.read_sources(spark, path).filter("path LIKE '%.txt'")
    return read.groupBy(
        F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"), F.regexp_extract("path", "source=([^/]+)", 1).alias("source")
    ).agg(F.sum(F.length("content")).alias("chars"))


@query("read_lines", """
SELECT lang, source, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(len(string_split(text, chr(10))))::BIGINT AS numbered,
  sum(length(replace(text, chr(10), '')))::BIGINT AS chars FROM documents GROUP BY lang, source""")
def _(spark, d):
    """Lines of files read in byte ranges: their number, the sum of each file's last number, and their characters."""
    path = scratch(spark)
    G.table(spark, d, "documents").select("text", "lang", "source").write.partitionBy("lang", "source").text(path)
    files, lines = X.read_lines(spark, path)
    home = files.select(
        "file_id", F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"), F.regexp_extract("path", "source=([^/]+)", 1).alias("source")
    )
    per_file = lines.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("lines"), F.max("line").alias("numbered"), F.sum(F.length("text")).alias("chars")
    )
    return per_file.join(home, "file_id").groupBy("lang", "source").agg(*[F.sum(c).alias(c) for c in ("lines", "numbered", "chars")])


def _doc_sources(spark, d):
    docs = G.table(spark, d, "documents").select(
        F.concat(F.lit("f"), "doc_id").alias("file_id"), F.concat_ws("/", F.lit("/src"), "source", "doc_id").alias("path"), F.col("text").alias("content")
    )
    return docs.select("file_id", "content"), docs.select("file_id", "path")


REVISION_SQL = """
WITH h AS (SELECT sha256('f' || doc_id || chr(0) || '/src/' || source || '/' || doc_id || chr(0) || text || chr(0)) AS h FROM documents),
s AS (SELECT sum(('0x' || substr(h, 1, 15))::BIGINT) AS s0, sum(('0x' || substr(h, 16, 15))::BIGINT) AS s1,
  sum(('0x' || substr(h, 31, 15))::BIGINT) AS s2, sum(('0x' || substr(h, 46, 15))::BIGINT) AS s3 FROM h)
"""


@query("revision", REVISION_SQL + "SELECT left(sha256(concat_ws(',', s0, s1, s2, s3)), 20) AS revision FROM s")
def _(spark, d):
    return X.revision(*_doc_sources(spark, d))


@query("lookup_source", "SELECT '/src/' || source || '/' || doc_id AS path, text AS content FROM documents WHERE doc_id = 7")
def _(spark, d):
    return X.lookup_source(*_doc_sources(spark, d), "f7", "now", "now")


@query("assign_project", """
WITH f AS (SELECT page_id, '/' || regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages),
p AS (SELECT DISTINCT '/' || split_part(path, '/', 2) AS root, 'host.' || split_part(path, '/', 2) AS module FROM f
      UNION SELECT DISTINCT '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3), 'area.' || split_part(path, '/', 3) FROM f WHERE split_part(path, '/', 3) <> '')
SELECT page_id, f.path, coalesce(min(module), '') AS module FROM f LEFT JOIN p ON f.path = root OR starts_with(f.path, root || '/') GROUP BY page_id, f.path""")
def _(spark, d):
    path = F.concat(F.lit("/"), F.regexp_extract("url", "^https?://([^?#]*)", 1))
    files = G.table(spark, d, "pages").select(F.col("page_id").alias("file_id"), path.alias("path"))
    part = F.split("path", "/")
    host, area = F.try_element_at(part, F.lit(2)), F.coalesce(F.try_element_at(part, F.lit(3)), F.lit(""))
    hosts = files.select(F.concat(F.lit("/"), host).alias("path"), F.concat(F.lit("host."), host).alias("module"))
    areas = files.filter(area != "").select(F.concat(F.lit("/"), host, F.lit("/"), area).alias("path"), F.concat(F.lit("area."), area).alias("module"))
    return X.assign_project(files, hosts.unionByName(areas).distinct()).select(F.col("file_id").alias("page_id"), "path", "module")


@query("source_window", """
WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
p AS (SELECT doc_id, quality * 3 + toxic + 1 AS here FROM labels)
SELECT p.doc_id, line::INT AS line, text, line = here AS active FROM p JOIN ln ON ln.doc_id = p.doc_id AND line BETWEEN here - 2 AND here + 3""")
def _(spark, d):
    places = G.table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("f"), "doc_id").alias("file_id"), (F.col("quality") * 3 + F.col("toxic") + 1).alias("line")
    )
    return X.source_window(places, _doc_sources(spark, d)[0]).select(F.col("id").alias("doc_id"), "line", "text", "active")


@query("inspect_node", G.with_trade("""
SELECT n.id, n.kind, f.name AS about FROM nodes n JOIN functions f ON f.id = n.function WHERE n.id = 'p42'
UNION ALL SELECT id, kind, CASE WHEN dst = 'p42' THEN 'in' ELSE 'out' END FROM edges WHERE 'p42' IN (src, dst)"""))
def _(spark, d):
    files = spark.range(0).select(F.lit("").alias("file_id"), F.lit("").alias("path"))
    node, links = I.inspect_node(G.trade_nodes(spark, d), G.trade_edges(spark, d), G.trade_functions(spark, d), files, "p42")
    return node.select("id", "kind", F.col("function_name").alias("about")).unionByName(
        links.select("id", "kind", F.col("direction").alias("about"))
    )


BROKEN_SQL = """
bad AS (SELECT id, CASE WHEN type = 'PROMO' THEN 'mystery' ELSE kind END AS kind, CASE WHEN kind = 'warehouse' THEN 'gone' ELSE function END AS function FROM nodes WHERE NOT (kind = 'station' AND helper)),
found AS (
SELECT 'kind' AS rule, 'nodes' AS "table", id AS key FROM bad WHERE kind = 'mystery'
UNION ALL SELECT 'function', 'nodes', id FROM bad WHERE function = 'gone'
UNION ALL SELECT 'repeated_id', 'edges', id FROM raw_edges GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'src', 'edges', id FROM raw_edges WHERE src NOT IN (SELECT id FROM bad)
UNION ALL SELECT 'dst', 'edges', id FROM raw_edges WHERE dst NOT IN (SELECT id FROM bad))
"""


def _violations(spark, d):
    nodes = G.trade_nodes(spark, d).filter("NOT (kind = 'station' AND helper)").withColumns({
        "function": F.when(F.col("kind") == "warehouse", "gone").otherwise(F.col("function")),
        "kind": F.when(F.col("type") == "PROMO", "mystery").otherwise(F.col("kind")),
    })
    return V.validate_graph({"nodes": nodes, "edges": G.trade_raw_edges(spark, d), "functions": G.trade_functions(spark, d)}).drop("message")


@query("validate_graph", G.with_trade(BROKEN_SQL + 'SELECT rule, "table", key FROM found'))
def _(spark, d):
    return _violations(spark, d)


@query("capped_violations", G.with_trade(BROKEN_SQL + 'SELECT rule, "table", key FROM found ORDER BY rule, "table", key LIMIT 15'))
def _(spark, d):
    return V.capped_violations(_violations(spark, d))


# --- column functions -------------------------------------------------------------------------------

TYPE_FORMS = [
    "untyped  {0}", "[]byte", "map[string]rune", " any ", "interface  {{ }}", "*{0}", "[8]{0}", "chan {0}", "func({0})", "({0}, byte)",
    "struct{{{0}}}", "{0}", "<-chan int", "anybyte", "channel", "error", "float64", "", "uint", "mybyte rune",
]


def _types(spark, d):
    def form(f):
        before, *after = f.split("{0}")
        parts = [F.lit(p.replace("{{", "{").replace("}}", "}")) for p in (before, *after)]
        return F.concat(parts[0], "p_name", parts[1]) if after else parts[0]

    raw = F.element_at(F.array(*[form(f) for f in TYPE_FORMS]), (F.col("p_partkey") % len(TYPE_FORMS) + 1).cast("int"))
    return G.table(spark, d, "part").select("p_partkey", "p_type", raw.alias("raw"))


def _raw_sql():
    forms = []
    for f in TYPE_FORMS:
        before, after = (f.split("{0}") if "{0}" in f else [f, None])
        fix = lambda s: s.replace("{{", "{").replace("}}", "}")
        forms.append(f"'{fix(before)}'" + ("" if after is None else f" || p_name || '{fix(after)}'"))
    return f"[{', '.join(forms)}][p_partkey % {len(TYPE_FORMS)} + 1]"


TYPE_SQL = f"""
WITH t0 AS (SELECT p_partkey, {_raw_sql()} AS raw FROM part),
t1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(raw), '\\s+', ' ', 'g'), '^untyped ', ''), '\\bbyte\\b', 'uint8', 'g') AS a FROM t0),
t2 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(a, '\\brune\\b', 'int32', 'g'), '^any$', 'interface{{}}'), 'interface\\s*\\{{\\s*\\}}', 'interface{{}}', 'g') AS type FROM t1),
k AS (FROM (VALUES ('bool', 'diamond', 145), ('string', 'capsule', 47), ('int', 'square', 208), ('uint', 'square', 188), ('uint8', 'square', 172),
  ('int32', 'square', 240), ('float64', 'circle', 8), ('error', 'cross', 355)) v(name, shape, hue)),
h AS (SELECT t2.*, k.shape AS kshape, k.hue, {_fnv('type')} AS h FROM t2 LEFT JOIN k ON name = type)
"""


@query("normalize_type", TYPE_SQL + "SELECT p_partkey, type FROM h")
def _(spark, d):
    return _types(spark, d).select("p_partkey", S.normalize_type("raw").alias("type"))


@query("fnv1a32", f"SELECT p_partkey, {_fnv('p_name')} AS h, {_fnv(chr(39) + 'é' + chr(39) + ' || p_type')} AS g FROM part")
def _(spark, d):
    return G.table(spark, d, "part").select("p_partkey", S.fnv1a32("p_name").alias("h"), S.fnv1a32(F.concat(F.lit("é"), "p_type")).alias("g"))


@query("type_shape", TYPE_SQL + """
SELECT p_partkey, CASE WHEN kshape IS NOT NULL THEN kshape WHEN type = '' THEN 'hexagon' WHEN starts_with(type, '*') THEN 'arrow'
  WHEN starts_with(type, '[]') THEN 'stack' WHEN regexp_matches(type, '^\\[\\d+\\]') THEN 'grid' WHEN starts_with(type, 'map[') THEN 'map'
  WHEN regexp_matches(type, '^(<-chan|chan\\b)') THEN 'channel' WHEN starts_with(type, 'func(') THEN 'triangle' WHEN starts_with(type, 'interface') THEN 'ring'
  WHEN starts_with(type, '(') THEN 'pair' WHEN starts_with(type, 'struct{') OR starts_with(type, 'struct {') THEN 'hexagon'
  ELSE ['hexagon', 'pentagon', 'octagon', 'shield'][h % 4 + 1] END AS shape FROM h""")
def _(spark, d):
    return _types(spark, d).select("p_partkey", S.type_shape("raw").alias("shape"))


@query("type_color", TYPE_SQL + f"""
SELECT p_partkey, 'hsl(' || coalesce(hue::VARCHAR, {HUNDREDTHS.format('(h % 36000)')}) || ' ' ||
  CASE WHEN type = '' THEN 10 WHEN hue IS NOT NULL THEN 65 ELSE 60 + (h >> 12) % 13 END || '% ' ||
  CASE WHEN type = '' THEN 62 WHEN hue IS NOT NULL THEN 65 ELSE 62 + (h >> 20) % 9 END || '%)' AS color FROM h""")
def _(spark, d):
    return _types(spark, d).select("p_partkey", S.type_color("raw").alias("color"))


@query("type_legend", TYPE_SQL + f"""
SELECT DISTINCT type, CASE WHEN type = '' THEN 'Без типа / управление' ELSE type END AS label,
  'hsl(' || coalesce(hue::VARCHAR, {HUNDREDTHS.format('(h % 36000)')}) || ' ' ||
  CASE WHEN type = '' THEN 10 WHEN hue IS NOT NULL THEN 65 ELSE 60 + (h >> 12) % 13 END || '% ' ||
  CASE WHEN type = '' THEN 62 WHEN hue IS NOT NULL THEN 65 ELSE 62 + (h >> 20) % 9 END || '%)' AS color FROM h""")
def _(spark, d):
    from ..operators.aggregate import type_legend

    return type_legend(_types(spark, d).withColumnRenamed("raw", "type")).drop("shape")


KEY_SQL = G.TRADE_SQL.strip() + f""",
r AS (SELECT *, CASE WHEN kind = 'station' THEN ['package', 'portal', 'section', 'junction', NULL][ord::BIGINT % 5 + 1] END AS role FROM nodes),
ks AS (SELECT id, CASE WHEN role = 'package' THEN package WHEN role IS NOT NULL THEN function WHEN method <> '' THEN method ELSE function END AS key FROM r),
kh AS (SELECT id, key, {_fnv('key')} AS h FROM ks)
"""


def _roles(spark, d):
    roles = F.array(*[F.lit(x) for x in ("package", "portal", "section", "junction")], F.lit(None).cast("string"))
    return G.trade_nodes(spark, d).withColumn(
        "role", F.when(F.col("kind") == "station", F.element_at(roles, (F.col("ord").cast("bigint") % 5 + 1).cast("int")))
    )


@query("identity_key", f"WITH {KEY_SQL} SELECT id, key FROM kh")
def _(spark, d):
    return _roles(spark, d).select("id", S.identity_key().alias("key"))


@query("identity_color", f"WITH {KEY_SQL} SELECT id, 'hsl(' || {HUNDREDTHS.format('(h % 36000)')} || ' ' || (55 + (h >> 12) % 14) || '% ' || (61 + (h >> 20) % 9) || '%)' AS color FROM kh")
def _(spark, d):
    return _roles(spark, d).select("id", S.identity_color().alias("color"))


@query("csv_cell", """
SELECT doc_id, '"' || CASE WHEN doc_id % 4 = 0 THEN chr(39) || ' =' ELSE '' END || replace(text, '"', '""') || '"' AS cell,
  CASE WHEN n_chars % 2 = 0 THEN '' ELSE '"' || -n_chars || '"' END AS number
FROM documents""")
def _(spark, d):
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" ="), "text")).otherwise(F.col("text"))
    number = F.when(F.col("n_chars") % 2 == 1, -F.col("n_chars"))
    return G.table(spark, d, "documents").select("doc_id", S.csv_cell(text).alias("cell"), S.csv_cell(number, is_text=False).alias("number"))


@query("safe_name", """
WITH t AS (SELECT doc_id, left(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 90) AS n FROM documents)
SELECT doc_id, CASE WHEN n = '' THEN 'factory' ELSE n END || '.csv' AS name FROM t""")
def _(spark, d):
    return G.table(spark, d, "documents").select("doc_id", S.safe_name("text", "csv", compose=False).alias("name"))


@query("safe_name_composed", """
WITH t AS (SELECT doc_id, left(regexp_replace(regexp_replace(nfc_normalize(text), '[^\\p{L}\\p{N}._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 90) AS n FROM documents)
SELECT doc_id, CASE WHEN n = '' THEN 'factory' ELSE n END || '.csv' AS name FROM t""")
def _(spark, d):
    """Titles written with full-width letters: composed, they are the texts themselves."""
    wide = F.translate("text", "aeot", "ａｅｏｔ")
    return G.table(spark, d, "documents").select("doc_id", S.safe_name(wide, "csv").alias("name"))


@query("kind_title", G.with_events("""
SELECT id, CASE kind WHEN 'source' THEN 'Источник груза' WHEN 'machine' THEN 'Сборочный станок' WHEN 'trash' THEN 'Утилизация'
  WHEN 'warehouse' THEN 'Склад · запись в БД' WHEN 'splitter' THEN 'Разветвитель' END AS title FROM enodes"""))
def _(spark, d):
    return G.event_nodes(spark, d).select("id", S.kind_title("kind").alias("title"))


@query("natural_key", """
SELECT p_partkey, row_number() OVER (ORDER BY lower(p_brand[1:6]), substr(p_brand, 7)::INT, p_partkey) AS place FROM part""")
def _(spark, d):
    from ..functions.numbering import number_rows

    key = S.natural_key(F.concat_ws("-", "p_brand", "p_partkey"))
    return number_rows(G.table(spark, d, "part").select("p_partkey", key.alias("k")), [], [F.col("k")], "place").select("p_partkey", "place")


@query("snap", "SELECT event_id, (floor((value - 25) * 7 / 32) + 0.5) * 32 AS x FROM events")
def _(spark, d):
    return G.table(spark, d, "events").select("event_id", S.snap((F.col("value") - 25) * 7).alias("x"))


@query("short_names", G.with_trade("""
SELECT id, array_to_string(string_split(package, '/')[-2:], '/') AS package, string_split(function, '.')[-1] AS function FROM nodes"""))
def _(spark, d):
    return G.trade_nodes(spark, d).select("id", S.short_package("package").alias("package"), S.short_function("function").alias("function"))


@query("tile_size", G.with_trade("""
deg AS (SELECT id, count(e) AS degree FROM nodes LEFT JOIN (SELECT src AS e FROM edges UNION ALL SELECT dst FROM edges) ON e = id GROUP BY id)
SELECT id, CASE WHEN kind = 'trash' THEN 1 ELSE (SELECT min(s) FROM range(3, 20001, 2) r(s) WHERE 4 * (2 * ((s - 1) // 4) + 1) >= degree)::INT END AS size
FROM nodes JOIN deg USING (id)"""))
def _(spark, d):
    ends = G.trade_edges(spark, d).select(F.explode(F.array("src", "dst")).alias("id"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    nodes = G.trade_nodes(spark, d).select("id", "kind").join(degree, "id", "left").na.fill({"degree": 0})
    return nodes.select("id", S.tile_size("kind", "degree").alias("size"))


# --- the whole build over the derived facts ---------------------------------------------------------

SKIPPED = "event_id % 20 NOT IN (16, 17)"  # events that are a jump or a debug mark, see facts.OPS


def _program(spark, d):
    """Functions, sources and projects: a file per supplier and a root per nation; every fifth function is marked by hand."""
    supplier = G.table(spark, d, "supplier")
    marked = F.col("s_suppkey") % 5 == 0
    path = F.concat_ws("/", F.lit("/src"), "s_nationkey", F.concat("s_suppkey", F.lit(".go")))
    functions = supplier.select(
        F.concat(F.lit("fn."), "s_suppkey").alias("function"), F.concat(F.lit("f"), "s_suppkey").alias("name"), F.lit("trade").alias("package"),
        path.alias("path"), F.when(marked, 4).otherwise(3).alias("line"), F.col("s_suppkey").cast("bigint").alias("seq"),
    )
    nowhere = [F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line")]
    user = F.concat(F.lit("user."), "user_id")
    users = G.table(spark, d, "events").select("user_id").distinct().select(
        user.alias("function"), user.alias("name"), F.lit("trade").alias("package"), *nowhere, (F.col("user_id") + 1000000).cast("bigint").alias("seq")
    )
    main = spark.range(1).select(
        F.lit("main").alias("function"), F.lit("main").alias("name"), F.lit("trade").alias("package"), *nowhere, F.lit(-1).cast("bigint").alias("seq")
    )
    body = F.concat(F.lit("package trade\n\n"), F.when(marked, "//flow:warehouse sql\n").otherwise(""), F.lit("func f"), "s_suppkey", F.lit("() {\n}\n"))
    sources = supplier.select(F.concat(F.lit("f"), "s_suppkey").alias("file_id"), path.alias("path"), body.alias("content"))
    projects = G.table(spark, d, "nation").filter("n_regionkey < 3").select(
        F.concat(F.lit("/src/"), "n_nationkey").alias("path"), F.concat(F.lit("mod/"), "n_name").alias("module")
    )
    return functions.unionByName(users).unionByName(main), sources, projects


def _facts(spark, d):
    lines = K.lines(spark, d)
    no, trade, fn = F.lit(False), F.lit("trade"), F.concat(F.lit("fn."), "l_suppkey")
    string = F.lit(None).cast("string")
    result = F.concat(F.lit("r."), "instr_id")
    functions = _program(spark, d)[0]
    params = K.params(spark, d).withColumn("value_id", F.col("node"))
    free_vars = G.table(spark, d, "supplier").filter("s_suppkey % 4 = 0").select(
        F.concat(F.lit("fn."), "s_suppkey").alias("function"), F.lit(0).alias("idx"), F.concat(F.lit("fn."), "s_suppkey", F.lit(".f0")).alias("value_id"),
        F.lit("env").alias("name"),
    )
    events = K.instructions(spark, d)
    own = events.filter(F.col("op").isin("makechan", "phi", "slice")).select(
        F.concat(F.lit("v."), "instr_id").alias("value_id"), F.lit("t1").alias("name"), F.lit("chan").alias("type"), (F.col("op") != "slice").alias("is_channel"),
        "function", "op",
    )
    main = F.lit("main").alias("function")
    chans = K.channel_values(spark, d).select("value_id", F.col("label").alias("name"), "type", "is_channel", main)
    addresses = K.addr_values(spark, d).select("value_id", F.col("value_id").alias("name"), F.lit("*addr").alias("type"), no.alias("is_channel"), main)
    rest = [
        K.values(spark, d).select("value_id", F.col("label").alias("name"), "type", no.alias("is_channel"), main), chans,
        lines.select(result.alias("value_id"), F.lit("t0").alias("name"), F.col("l_linestatus").alias("type"), no.alias("is_channel"), fn.alias("function")),
        params.select("value_id", "name", F.lit("param").alias("type"), no.alias("is_channel"), "function"),
        free_vars.select("value_id", "name", F.lit("order").alias("type"), no.alias("is_channel"), "function"), own.drop("op"),
    ]
    values = addresses.withColumn("is_pointer", F.lit(True))
    for part in rest:
        values = values.unionByName(part.withColumn("is_pointer", no))
    values = values.withColumns({"is_global": no, "is_const": no, "package": trade})
    calls = K.calls(spark, d).withColumns({
        "callee_pkg": F.lit("net/http"), "callee_name": F.when(F.col("mode") == "go", "Post").otherwise("Close"), "signature": F.lit(""),
        "dispatch": F.lit("static"), "const_args": F.array().cast("array<string>"), "receiver_type": F.lit(""),
    })
    rets = K.returns(spark, d)
    nowhere = [F.lit("").alias("detail"), string.alias("path"), F.lit(None).cast("int").alias("line")]
    at_call = lines.select(
        "instr_id", fn.alias("function"), F.col("l_linenumber").alias("block"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
        F.lit("call").alias("op"), result.alias("value_id"), F.col("l_linestatus").alias("type"), F.concat(F.lit("call "), fn).alias("detail"),
    ).join(functions.select("function", "path"), "function").withColumn("line", F.col("block") + 10)
    at_return = rets.select("instr_id", "function").distinct().select(
        "instr_id", "function", F.lit(99).alias("block"), F.lit(0).cast("bigint").alias("pos"), F.lit("return").alias("op"),
        string.alias("value_id"), F.lit("").alias("type"), *nowhere,
    )
    valued = F.col("op").isin("makechan", "phi", "slice")
    at_event = events.select(
        "instr_id", "function", "block", "pos", "op", F.when(valued, F.concat(F.lit("v."), "instr_id")).alias("value_id"),
        F.when(valued, "chan").otherwise("").alias("type"), *nowhere,
    )
    instructions = at_call.unionByName(at_return).unionByName(at_event).withColumns({"operator": F.lit("+"), "package": trade})
    second = lines.filter("l_linenumber = 2")
    spoken = second.select(result.alias("value_id"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(i).cast("bigint").alias("seq")) for i, n in enumerate(("_", "sum", "total", "sum"))
    ])).alias("r")).select("value_id", "r.*")
    refs = spoken.unionByName(own.filter("op <> 'phi'").select("value_id", F.lit("box").alias("name"), F.lit(0).cast("bigint").alias("seq"))).unionByName(
        G.table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("value_id"), F.col("p_name").alias("name"), F.lit(0).cast("bigint").alias("seq"))
    )
    exits = rets.select("instr_id", "function").distinct()
    used = params.filter("idx = 0").select("function", "value_id", F.lit(0).alias("idx")).unionByName(
        second.select(fn.alias("function"), result.alias("value_id"), F.lit(1).alias("idx"))
    ).join(exits, "function").select("instr_id", "idx", "value_id")
    captures = lines.filter("l_linenumber = 1 AND l_suppkey % 4 = 0").select(
        "instr_id", fn.alias("function"), F.lit(0).alias("idx"), F.concat(F.lit("o"), "l_orderkey").alias("value_id")
    )
    id_ = F.substring("instr_id", 2, 20).cast("bigint").alias("event_id")
    return B.Facts(
        values=values, instructions=instructions, operands=K.call_args(spark, d).unionByName(used), calls=calls, call_args=K.call_args(spark, d),
        params=params, returns=rets, extracts=K.extracts(spark, d), captures=captures, free_vars=free_vars,
        channel_ops=K.channel_ops(spark, d).withColumn("event_id", id_).filter(SKIPPED).drop("event_id"),
        mem_ops=K.mem_ops(spark, d), addr_paths=K.addr_paths(spark, d), alias_links=K.channel_links(spark, d), debug_refs=refs,
        map_values=second.filter("l_quantity > 25").select(result.alias("value_id")),
    )


def _build(spark, d):
    functions, sources, projects = _program(spark, d)
    located = B.program_functions(functions, sources, projects)
    directives = L.directive_functions(L.parse_directives(sources), located)
    return B.build_graph(_facts(spark, d), directives, functions=functions)


BUILD_SQL = f"""WITH RECURSIVE {K.CALL_SQL.strip()},
{K.MEMORY_SQL.split("FROM lineitem),", 1)[1].strip()},
{K.CHANNEL_SQL.strip()},
troots AS (SELECT ops.*, root, 'queue ' || user_id % 3 AS label FROM ops JOIN roots ON value_id = channel WHERE substr(instr_id, 2)::BIGINT % 20 NOT IN (16, 17)),
tlive AS (SELECT root FROM troots GROUP BY root HAVING bool_or(dir = 'send') AND bool_or(dir = 'recv')),
evs AS (
  SELECT 'i' || event_id AS instr_id, 'user.' || user_id AS function, 1000000 + user_id AS turn, datediff('day', DATE '2024-01-01', ts::DATE) AS block,
    event_id AS pos, {K.OPS}[event_id % {len(K.OPS)} + 1] AS op FROM events),
ins AS (
  SELECT instr_id, 'fn.' || l_suppkey AS function, l_suppkey AS turn, l_linenumber AS block, l_orderkey * 8 + l_linenumber AS pos, 'call' AS op,
    'r.' || instr_id AS value_id, l_linestatus AS type, 'call fn.' || l_suppkey AS detail, '/src/' || s_nationkey || '/' || s_suppkey || '.go' AS path,
    l_linenumber + 10 AS line FROM lines JOIN supplier ON s_suppkey = l_suppkey
  UNION ALL SELECT DISTINCT function || '.ret', function, substr(function, 4)::BIGINT, 99, 0, 'return', NULL, '', '', NULL, NULL FROM rets
  UNION ALL SELECT instr_id, function, turn, block, pos, op, CASE WHEN op IN ('makechan', 'phi', 'slice') THEN 'v.' || instr_id END,
    CASE WHEN op IN ('makechan', 'phi', 'slice') THEN 'chan' ELSE '' END, '', NULL, NULL FROM evs),
place AS (
  SELECT *, row_number() OVER (PARTITION BY function ORDER BY block, pos, instr_id) - 1 AS ord FROM ins WHERE op NOT IN ('jump', 'debugref')),
values_ AS (
  SELECT 'p' || p_partkey AS value_id, p_name AS label, p_name AS names, p_type AS type, 'main' AS function, p_partkey NOT IN (SELECT l_partkey FROM lineitem) AS may_end FROM part
  UNION ALL SELECT 'o' || o_orderkey, o_orderpriority, '', 'order', 'main', false FROM orders
  UNION ALL SELECT DISTINCT 'a.' || l_partkey || '.f' || l_linenumber, 'a.' || l_partkey || '.f' || l_linenumber, '', '*addr', 'main', false FROM lineitem
  UNION ALL SELECT 'a.' || k, 'a.' || k, '', '*addr', 'main', false FROM (SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part WHERE p_size > 10)
  UNION ALL SELECT DISTINCT 'brand.' || p_brand, 'brand.' || p_brand, '', '*addr', 'main', false FROM part WHERE p_size > 10
  UNION ALL SELECT 'ch.' || u, 'queue ' || u % 3, '', 'chan', 'main', false FROM users
  UNION ALL SELECT DISTINCT 'x.' || event_type, event_type, '', 'msg.' || event_type, 'main', false FROM events
  UNION ALL SELECT 'r.' || instr_id, CASE l_linenumber WHEN 2 THEN 'sum, total' ELSE 't0' END, CASE l_linenumber WHEN 2 THEN 'sum,total' ELSE '' END,
    l_linestatus, 'fn.' || l_suppkey, l_linenumber = 2 AND l_quantity <= 25 FROM lines
  UNION ALL SELECT function || '.p' || idx, 'arg' || idx, 'arg' || idx, 'param', function, true FROM params
  UNION ALL SELECT 'fn.' || s_suppkey || '.f0', 'env', 'env', 'order', 'fn.' || s_suppkey, true FROM supplier WHERE s_suppkey % 4 = 0
  UNION ALL SELECT 'v.' || instr_id, CASE op WHEN 'phi' THEN 't1' ELSE 'box' END, CASE op WHEN 'phi' THEN '' ELSE 'box' END, 'chan', function, op = 'slice'
    FROM evs WHERE op IN ('makechan', 'phi', 'slice')),
noded AS (
  SELECT v.value_id, v.label, v.names, v.type, v.function, may_end, coalesce(i.instr_id, v.value_id) AS node, coalesce(i.block, 0) AS block,
    coalesce(i.ord, -1) AS ord, i.path, i.line FROM values_ v LEFT JOIN place i ON i.value_id = v.value_id),
args AS (
  SELECT * FROM call_args
  UNION ALL SELECT function || '.ret', 0, function || '.p0' FROM params WHERE idx = 0
  UNION ALL SELECT 'fn.' || l_suppkey || '.ret', 1, 'r.' || instr_id FROM lines WHERE l_linenumber = 2 AND l_suppkey % 4 > 0),
last AS (
  SELECT n.value_id, max({{'ord': i.ord, 'instr_id': i.instr_id, 'block': i.block, 'path': i.path, 'line': i.line}}) AS x
  FROM noded n JOIN args USING (value_id) JOIN place i ON i.instr_id = args.instr_id AND i.function = n.function AND i.ord > n.ord WHERE may_end GROUP BY 1),
ending AS (
  SELECT n.*, coalesce(x.instr_id, node) AS src, coalesce(x.block, block) AS last_block, coalesce(x.ord, ord) + 1 AS last_ord,
    CASE WHEN x IS NULL THEN path ELSE x.path END AS last_path, CASE WHEN x IS NULL THEN line ELSE x.line END AS last_line
  FROM noded n LEFT JOIN last USING (value_id) WHERE may_end)
"""
LINKS_SQL = BUILD_SQL + """,
entries AS (SELECT function AS callee, instr_id AS entry FROM place WHERE ord = 0),
spot AS (SELECT instr_id, turn, function, ord FROM place),
e AS (
  SELECT node AS src, a.instr_id AS dst, 'belt' AS kind, label, type, 0 AS phase, spot.turn, spot.function, spot.ord, 0 AS step, a.idx
    FROM args a JOIN noded USING (value_id) JOIN spot ON spot.instr_id = a.instr_id
  UNION ALL SELECT 'o' || l_orderkey, 'fn.' || l_suppkey || '.f0', 'call', o_orderpriority, 'order', 0, turn, function, ord, 1, 0
    FROM lines JOIN orders ON o_orderkey = l_orderkey JOIN spot USING (instr_id) WHERE l_linenumber = 1 AND l_suppkey % 4 = 0
  UNION ALL SELECT node, callee || '.p' || p.idx, 'call', label || ' → arg' || p.idx, n.type, 0, spot.turn, spot.function, spot.ord, 2, a.idx
    FROM calls c JOIN call_args a USING (instr_id) JOIN params p ON p.function = c.callee AND p.idx = a.idx JOIN noded n USING (value_id)
    JOIN spot ON spot.instr_id = c.instr_id
  UNION ALL SELECT instr_id, entry, 'call', 'вызов', '', 0, turn, function, ord, 3, 0 FROM calls JOIN entries USING (callee) JOIN spot USING (instr_id)
    WHERE instr_id <> entry AND callee NOT IN (SELECT function FROM params)
  UNION ALL SELECT DISTINCT callee || '.ret', calls.instr_id, 'return', 'результат', type, 0, turn, spot.function, ord, 4, 0
    FROM calls JOIN rets ON rets.function = callee JOIN spot ON spot.instr_id = calls.instr_id WHERE mode = 'call'
  UNION ALL SELECT DISTINCT CASE WHEN into_ THEN instr_id ELSE 'memory:' || key END, CASE WHEN into_ THEN 'memory:' || key ELSE instr_id END,
    CASE WHEN into_ THEN 'memory' ELSE 'belt' END, CASE WHEN into_ THEN 'память' ELSE '' END, CASE WHEN into_ THEN type END, 1, 0, '', 0, 0, 0 FROM live
  UNION ALL SELECT DISTINCT CASE dir WHEN 'send' THEN instr_id ELSE 'train:' || root END, CASE dir WHEN 'send' THEN 'train:' || root ELSE instr_id END,
    CASE dir WHEN 'send' THEN 'train' ELSE 'belt' END, CASE dir WHEN 'send' THEN label ELSE '' END, CASE dir WHEN 'send' THEN 'msg.' || event_type END,
    2, 0, '', 0, 0, 0 FROM troots JOIN tlive USING (root)
  UNION ALL SELECT src, 'trash:' || value_id, 'disposal', label, type, 3, 0, '', 0, 0, 0 FROM ending),
firsts AS (
  SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src, dst, kind, label ORDER BY phase, turn, function, ord, step, idx, type) = 1)
SELECT kind || ':' || src || '>' || dst || CASE label WHEN '' THEN '' ELSE ':' || label END AS id, src, dst, kind, label, type,
  row_number() OVER (ORDER BY phase, turn, function, ord, step, idx, src, dst, kind, label) - 1 AS seq FROM firsts"""


@query("build_graph_edges", LINKS_SQL)
def _(spark, d):
    """Every link of the build with its place: operands, captures, arguments, invocations, returns, memory, channels, ends of use."""
    return _build(spark, d)[1]


NODES_SQL = BUILD_SQL + f""",
texts AS (FROM (VALUES
  ('alloc', 'machine', 'Выделение памяти', true), ('binop', 'machine', '+', false), ('recv', 'station', 'Получить · ', false),
  ('unop', 'machine', 'Обработка', true), ('makechan', 'station', 'Канал · ', false), ('send', 'station', 'Отправить · ', false),
  ('select', 'station', 'Развязка select', false), ('phi', 'splitter', 'Слияние · ', false), ('if', 'splitter', 'Условие', false),
  ('return', 'output', 'Возврат', false), ('store', 'memory', 'Запись в память', true), ('mapupdate', 'memory', 'Запись в map', false),
  ('panic', 'trash', 'panic', false), ('extract', 'machine', 'Обработка', true), ('fieldaddr', 'machine', 'Обработка', true),
  ('convert', 'machine', 'Обработка', true), ('slice', 'machine', 'box', false), ('call', 'machine', 'Обработка', false)) t(op, kind, label, helper)),
told AS (
  SELECT c.instr_id, callee, mode, CASE WHEN l_suppkey % 5 = 0 THEN 'warehouse' WHEN mode = 'go' THEN 'rocket' ELSE 'machine' END AS kind,
    CASE WHEN l_suppkey % 5 = 0 THEN 'sql' WHEN mode = 'go' THEN 'http' ELSE '' END AS protocol,
    CASE WHEN l_suppkey % 5 = 0 THEN 'Явная аннотация //flow:warehouse sql' WHEN mode = 'go' THEN 'Типизированный вызов net/http' ELSE '' END AS reason
  FROM calls c JOIN lines USING (instr_id)),
n AS (
  SELECT i.instr_id AS id, coalesce(told.kind, t.kind) AS kind,
    CASE WHEN told.callee IS NOT NULL THEN CASE mode WHEN 'go' THEN 'go · ' WHEN 'defer' THEN 'defer · ' ELSE '' END || told.callee
      ELSE t.label || CASE WHEN i.op IN ('recv', 'send') THEN coalesce('queue ' || user_id % 3, '') WHEN i.op IN ('makechan', 'phi') THEN v.label ELSE '' END END AS label,
    i.function, coalesce(told.callee, '') AS method, 'trade' AS package, i.type, coalesce(v.names, '') AS names, coalesce(protocol, '') AS protocol,
    coalesce(told.reason, CASE i.op WHEN 'panic' THEN 'Аварийное завершение пути исполнения' ELSE '' END) AS reason, t.helper, i.block, i.ord::DOUBLE AS ord,
    NULL AS role, i.detail, i.path, i.line
  FROM place i JOIN texts t USING (op) LEFT JOIN told USING (instr_id) LEFT JOIN values_ v ON v.value_id = i.value_id LEFT JOIN ops ON ops.instr_id = i.instr_id
  UNION ALL SELECT value_id, 'source', label, function, '', 'trade', type, names, '', '', false, 0, -1, NULL, '', NULL, NULL FROM noded WHERE node = value_id
  UNION ALL SELECT DISTINCT 'memory:' || key, 'memory', key, '', '', '', '', '', '', '', true, 0, 0, 'hub', '', NULL, NULL FROM live
  UNION ALL SELECT 'train:' || root, 'station', root, '', '', '', '', '', '', '', true, 0, 0, 'hub', '', NULL, NULL FROM tlive
  UNION ALL SELECT 'trash:' || value_id, 'trash', 'Утилизация · ' || label, function, '', 'trade', type, '', '', '{B.END_REASON}', false, last_block, last_ord, NULL,
    '{B.END_DETAIL}' || label, last_path, last_line FROM ending)
SELECT * REPLACE (coalesce(path, '') AS path, coalesce(line, 0) AS line) FROM n"""


@query("build_graph_nodes", NODES_SQL)
def _(spark, d):
    return _build(spark, d)[0].withColumn("names", F.array_join("names", ",")).na.fill({"path": "", "line": 0})


@query("program_functions", """
SELECT 'fn.' || s_suppkey AS id, 'f' || s_suppkey AS name, 'trade' AS package, CASE WHEN n_regionkey < 3 THEN 'mod/' || n_name ELSE '' END AS project,
  'f' || s_suppkey AS file, CASE WHEN s_suppkey % 5 = 0 THEN 4 ELSE 3 END AS line, s_suppkey::BIGINT AS seq
FROM supplier JOIN nation ON n_nationkey = s_nationkey
UNION ALL SELECT DISTINCT 'user.' || user_id, 'user.' || user_id, 'trade', '', '', 0, 1000000 + user_id FROM events
UNION ALL SELECT 'main', 'main', 'trade', '', '', 0, -1""")
def _(spark, d):
    return B.program_functions(*_program(spark, d)).select("id", "name", "package", "project", "source.file", "source.line", "seq")


@query("build_document_check", """
SELECT 'nodes' AS part, count(*) AS n FROM ({nodes}) UNION ALL SELECT 'edges', count(*) FROM ({edges})
UNION ALL SELECT 'files', count(*) FROM supplier UNION ALL SELECT 'projects', count(*) FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'violations', 0
""".format(nodes=NODES_SQL, edges=LINKS_SQL))
def _(spark, d):
    """The document of the whole program: rows per table, and that no rule of validate_graph is broken."""
    functions, sources, projects = _program(spark, d)
    tables = B.build_document(_facts(spark, d), functions, sources, projects)
    counts = [tables[t].groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("part"), "n") for t in ("nodes", "edges", "files", "projects")]
    faults = V.validate_graph(tables).groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("violations").alias("part"), "n")
    return reduce(lambda a, b: a.unionByName(b), [*counts, faults])
