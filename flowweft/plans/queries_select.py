"""Queries for filters, aggregations, listings and set operations (trade and event graphs)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.numbering import number_rows
from ..functions import scalars as S
from ..operators import aggregate as A
from ..operators import selection as P
from ..runtime import checkpoint_root
from . import graphs as G
from .registry import query

PLAIN = "id, kind, label, function, package, type, helper, seq"


def _plain(nodes):
    return nodes.select("id", "kind", "label", "function", "package", "type", "helper", "seq")


SEARCH_SQL = "lower(concat_ws(' ', label, function, type, array_to_string(names, ' ')))"


@query("layer_filter_nodes", G.with_trade(f"SELECT {PLAIN} FROM nodes WHERE kind NOT IN ('station')"))
def _(spark, d):
    return _plain(P.layer_filter(G.trade_nodes(spark, d), G.trade_edges(spark, d), ["station", "train"])[0])


@query("layer_filter_edges", G.with_trade("SELECT * FROM edges WHERE kind <> 'train'"))
def _(spark, d):
    return P.layer_filter(G.trade_nodes(spark, d), G.trade_edges(spark, d), ["station", "train"])[1]


@query("drop_helpers", G.with_trade(f"SELECT {PLAIN} FROM nodes WHERE NOT helper"))
def _(spark, d):
    return _plain(P.drop_helpers(G.trade_nodes(spark, d)))


FOUND_SQL = G.with_trade(f"""
hits AS (SELECT id FROM nodes WHERE contains({SEARCH_SQL}, 'red w')),
found AS (
  SELECT id FROM hits
  UNION SELECT dst FROM edges JOIN hits ON src = hits.id
  UNION SELECT src FROM edges JOIN hits ON dst = hits.id)
SELECT {PLAIN} FROM nodes WHERE id IN (FROM found)
""")


@query("search_nodes", FOUND_SQL)
def _(spark, d):
    return _plain(P.search_nodes(G.trade_nodes(spark, d), G.trade_edges(spark, d), "  Red W"))


@query("search_indexed", FOUND_SQL)
def _(spark, d):
    nodes, path = G.trade_nodes(spark, d), f"{checkpoint_root(spark)}/text-{uuid.uuid4().hex}"
    P.write_text_index(nodes, path)
    return _plain(P.search_indexed(nodes, G.trade_edges(spark, d), P.read_text_index(spark, path), "  Red W"))


FOCUS_SQL = """
own AS (SELECT id FROM nodes WHERE function = 'trade/parts.Brand#7'),
kept AS (
  SELECT id FROM own
  UNION SELECT dst FROM edges JOIN own ON src = own.id
  UNION SELECT src FROM edges JOIN own ON dst = own.id)
"""


@query("focus_function_nodes", G.with_trade(f"{FOCUS_SQL} SELECT {PLAIN} FROM nodes WHERE id IN (FROM kept)"))
def _(spark, d):
    return _plain(P.focus_function(G.trade_nodes(spark, d), G.trade_edges(spark, d), "trade/parts.Brand#7")[0])


@query("focus_function_edges", G.with_trade(
    f"{FOCUS_SQL} SELECT * FROM edges WHERE src IN (FROM kept) AND dst IN (FROM kept)"))
def _(spark, d):
    return P.focus_function(G.trade_nodes(spark, d), G.trade_edges(spark, d), "trade/parts.Brand#7")[1]


@query("function_catalog", G.with_trade(f"""
SELECT id, name, package, project, seq FROM functions
WHERE package = 'trade/parts' AND (contains(lower(concat_ws(' ', name, id)), 'widget')
  OR id IN (SELECT function FROM nodes WHERE contains({SEARCH_SQL}, 'widget')))
"""))
def _(spark, d):
    return P.function_catalog(G.trade_functions(spark, d), G.trade_nodes(spark, d), "trade/parts", "Widget").select(
        "id", "name", "package", "project", "seq"
    )


@query("normalize_view", """
WITH options AS (
  SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE 'user.' || user_id END AS fn,
         CASE WHEN event_type = 'click' THEN 'events' END AS pkg, (event_id % 7 - 1)::INT AS part,
         CASE WHEN event_type = 'error' THEN false END AS compact, event_type AS query,
         value > 20 AS station, value > 10 AS belt
  FROM events)
SELECT event_id, '{"fn":"' || coalesce(fn, '') || '","pkg":"' || coalesce(pkg, '') || '","part":' || part ||
  ',"compact":' || coalesce(compact, true) || ',"query":"' || query || '","layers":{' ||
  concat_ws(',', CASE WHEN NOT station THEN '"station":false' END, CASE WHEN NOT belt THEN '"belt":false' END) || '}}' AS view_key
FROM options
""")
def _(spark, d):
    e = F.col("event_type")
    options = G.table(spark, d, "events").select(
        "event_id",
        F.when(e != "view", F.concat(F.lit("user."), "user_id")).alias("fn"),
        F.when(e == "click", "events").alias("pkg"),
        (F.col("event_id") % 7 - 1).cast("int").alias("part"),
        F.when(e == "error", False).alias("compact"),
        e.alias("query"),
        F.create_map(F.lit("belt"), F.col("value") > 10, F.lit("station"), F.col("value") > 20).alias("layers"),
    )
    return P.normalize_view(options).select("event_id", P.view_key().alias("view_key"))


@query("default_view", G.with_trade("""
SELECT CASE WHEN (SELECT count(*) FROM nodes) <= 1200 THEN
  coalesce((SELECT id FROM functions WHERE name IN ('Run', 'main') ORDER BY name <> 'Run', seq LIMIT 1), '') ELSE '' END AS fn
"""))
def _(spark, d):
    return P.default_view(G.trade_functions(spark, d), G.trade_nodes(spark, d))


ENTRY = "CASE WHEN seq % 7 = 3 THEN 'main' WHEN seq % 7 = 5 THEN 'Run' ELSE name END"


@query("default_view_entry", G.with_trade(f"SELECT coalesce(arg_min(id, (n <> 'Run', seq)), '') AS fn FROM (SELECT *, {ENTRY} AS n FROM functions) WHERE n IN ('Run', 'main')"))
def _(spark, d):
    """A graph shown whole at any size: of several entries the first Run."""
    return P.default_view(G.trade_functions(spark, d).withColumn("name", F.expr(ENTRY)), G.trade_nodes(spark, d), whole_nodes=None)


@query("dedup_edges", G.with_trade("SELECT * FROM edges"))
def _(spark, d):
    return A.dedup_edges(G.trade_raw_edges(spark, d))


@query("function_counts", G.with_trade("""
SELECT f.package, f.id, f.name, count(n.id) AS n FROM functions f LEFT JOIN nodes n ON n.function = f.id
GROUP BY f.package, f.id, f.name"""))
def _(spark, d):
    return A.function_counts(G.trade_nodes(spark, d), G.trade_functions(spark, d))


@query("graph_summary", G.with_trade("""
SELECT (SELECT count(DISTINCT project) FROM functions) AS projects, (SELECT count(*) FROM functions) AS functions,
  (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE kind = 'warehouse') AS warehouses,
  (SELECT count(*) FROM nodes WHERE kind = 'rocket') AS rockets, (SELECT count(*) FROM edges) AS edges,
  (SELECT count(*) FROM edges WHERE kind = 'train') AS trains"""))
def _(spark, d):
    return A.graph_summary(
        G.trade_projects(spark, d), G.trade_functions(spark, d), G.trade_nodes(spark, d), G.trade_edges(spark, d)
    )


PACKAGES_SQL = G.with_trade("""
SELECT a.package AS src_package, b.package AS dst_package, CASE e.kind WHEN 'train' THEN 'train' ELSE 'call' END AS kind,
  count(*) AS n, array_to_string(list_sort(list_distinct(list(e.type))), '|') AS types
FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst
WHERE a.package <> b.package GROUP BY ALL""")


@query("package_overview", PACKAGES_SQL)
def _(spark, d):
    _nodes, links = A.package_overview(G.trade_functions(spark, d), G.trade_nodes(spark, d), G.trade_edges(spark, d))
    return links.withColumn("types", F.array_join("types", "|"))


@query("package_nodes", G.with_trade("""
SELECT 'package:' || package AS id, array_to_string(string_split(package, '/')[-2:], '/') AS label, package, count(*) AS n
FROM functions GROUP BY package"""))
def _(spark, d):
    return A.package_nodes(G.trade_functions(spark, d))


@query("merge_types", G.with_trade("""
SELECT src, kind, array_to_string(list_sort(list(DISTINCT type)), '|') AS types FROM edges GROUP BY src, kind"""))
def _(spark, d):
    return A.merge_types(G.trade_edges(spark, d), ["src", "kind"]).withColumn("types", F.array_join("types", "|"))


@query("contact_graph", G.with_trade("""
SELECT id, other, count(*)::DOUBLE AS weight
FROM (SELECT src AS id, dst AS other FROM raw_edges UNION ALL SELECT dst, src FROM raw_edges) GROUP BY id, other"""))
def _(spark, d):
    return A.contact_graph(G.trade_nodes(spark, d), G.trade_raw_edges(spark, d))


STRENGTH_SQL = """
contact AS (
  SELECT id, other, count(*) AS weight
  FROM (SELECT src AS id, dst AS other FROM raw_edges UNION ALL SELECT dst, src FROM raw_edges) GROUP BY id, other),
strength AS (
  SELECT n.id, count(other) AS degree, coalesce(sum(1 + log2(weight)), 0) AS strength
  FROM nodes n LEFT JOIN contact c ON c.id = n.id GROUP BY n.id)
"""


def _strength(spark, d):
    nodes = G.trade_nodes(spark, d)
    return A.node_strength(nodes, A.contact_graph(nodes, G.trade_raw_edges(spark, d)))


@query("node_strength", G.with_trade(STRENGTH_SQL + "SELECT id, degree, round(strength, 4) AS strength FROM strength"))
def _(spark, d):
    return _strength(spark, d).withColumn("strength", F.round("strength", 4))


@query("rank_hubs", G.with_trade(STRENGTH_SQL + """
SELECT id, degree, round(strength, 4) AS strength FROM strength
ORDER BY degree DESC, round(strength, 6) DESC, left(id, 1), substr(id, 2)::BIGINT LIMIT 25"""))
def _(spark, d):
    return A.rank_hubs(_strength(spark, d), 25).withColumn("strength", F.round("strength", 4))


@query("method_calls", G.with_trade("SELECT method, count(*) AS calls FROM nodes WHERE method <> '' GROUP BY method"))
def _(spark, d):
    return A.method_calls(G.trade_nodes(spark, d))


@query("function_graph", G.with_trade("""
f AS (SELECT a.function AS a, b.function AS b FROM raw_edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst
      WHERE a.function <> b.function)
SELECT id, other, count(*)::DOUBLE AS weight FROM (SELECT a AS id, b AS other FROM f UNION ALL SELECT b, a FROM f)
GROUP BY id, other"""))
def _(spark, d):
    return A.function_graph(G.trade_nodes(spark, d), G.trade_raw_edges(spark, d))


@query("size_limits", G.with_trade("""
SELECT 'nodes' AS "table", count(*) AS n, 0 AS cap FROM nodes UNION ALL SELECT 'edges', count(*), 0 FROM edges"""))
def _(spark, d):
    return A.size_limits(G.trade_nodes(spark, d), G.trade_edges(spark, d))


@query("size_limits_exceeded", G.with_trade("SELECT 'edges: ' || count(*) || ' rows, limit 10' AS message FROM edges"))
def _(spark, d):
    edges = G.trade_edges(spark, d)
    try:
        return A.size_limits(G.trade_nodes(spark, d), edges, 0, 10)
    except A.SizeLimitError as e:
        return edges.limit(1).select(F.lit(str(e)).alias("message"))


@query("first_objects", G.with_trade(f"SELECT {PLAIN} FROM nodes ORDER BY seq LIMIT 200"))
def _(spark, d):
    return _plain(P.first_objects(G.trade_nodes(spark, d)))


@query("order_functions", G.with_trade("SELECT id, name, package, project, seq FROM functions ORDER BY id, seq"))
def _(spark, d):
    return P.order_functions(G.trade_functions(spark, d))


@query("all_edges", G.with_trade("""
u AS (SELECT 0 AS family, * FROM raw_edges WHERE kind = 'call'
      UNION ALL SELECT 1, id, 'c' || o_custkey, 'p' || l_partkey, 'call', 'line', 'direct', l_orderkey
        FROM (SELECT '' AS id, * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      UNION ALL SELECT 2, * FROM raw_edges WHERE kind = 'train')
SELECT src, dst, kind, label, type, family FROM u
QUALIFY row_number() OVER (PARTITION BY src, dst, kind, label ORDER BY family, seq, type) = 1"""))
def _(spark, d):
    raw = G.trade_raw_edges(spark, d)
    direct = G.table(spark, d, "lineitem").join(
        G.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).select(
        F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"),
        F.lit("call").alias("kind"), F.lit("line").alias("label"), F.lit("direct").alias("type"),
        F.col("l_orderkey").alias("seq"),
    )
    merged = A.all_edges([raw.filter(F.col("kind") == "call"), direct, raw.filter(F.col("kind") == "train")])
    return merged.select("src", "dst", "kind", "label", "type", F.col("seq.family").alias("family"))


@query("intersect_selection", G.with_trade(f"""
SELECT {PLAIN} FROM nodes WHERE NOT helper AND id IN (SELECT src FROM edges WHERE type = 'R')"""))
def _(spark, d):
    returned = G.trade_edges(spark, d).filter(F.col("type") == "R").select(F.col("src").alias("id")).distinct()
    return _plain(P.intersect_selection(P.drop_helpers(G.trade_nodes(spark, d)), returned))


@query("graph_diff", G.with_trade("""
SELECT src, dst, kind, sum(s)::BIGINT AS surplus FROM (
  SELECT src, dst, kind, 1 AS s FROM raw_edges UNION ALL SELECT src, dst, kind, -1 FROM edges)
GROUP BY src, dst, kind HAVING sum(s) <> 0"""))
def _(spark, d):
    def ends(df):
        return df.select("src", "dst", "kind")

    return P.graph_diff(ends(G.trade_raw_edges(spark, d)), ends(G.trade_edges(spark, d)))


@query("assign_ids", G.with_trade("""
SELECT id, 'n' || row_number() OVER (ORDER BY function, seq) AS new_id FROM nodes"""))
def _(spark, d):
    numbered = number_rows(G.trade_nodes(spark, d).select("id", "function", "seq"), [], [F.col("function"), F.col("seq")])
    return numbered.select("id", F.concat(F.lit("n"), "rn").alias("new_id"))


@query("natural_order", G.with_trade("""
SELECT id, row_number() OVER (PARTITION BY function ORDER BY left(id, 1), substr(id, 2)::BIGINT) AS rn FROM nodes"""))
def _(spark, d):
    return number_rows(
        G.trade_nodes(spark, d).select("id", "function"), ["function"], [S.natural_key("id")]
    ).select("id", "rn")
