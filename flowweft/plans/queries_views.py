"""Queries for contraction, portals, sections, closures and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import closure as C
from ..operators import selection as P
from ..operators import views as V
from ..runtime import materialize
from . import graphs as G
from .queries_select import PACKAGES_SQL
from .registry import query

FN = "trade/region/AFRICA.NATION_0"

# Paths through pending orders and small parts: at most two helpers in a row.
VISIBLE_SQL = """
h AS (SELECT e.*, a.helper AS sh, b.helper AS dh FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst),
states AS (
  SELECT src, dst, kind, type, dh, 1 AS hops, seq AS first, label FROM h WHERE NOT sh
  UNION
  SELECT s.src, n.dst, CASE n.kind WHEN 'belt' THEN s.kind ELSE n.kind END, n.type, n.dh, s.hops + 1, s.first, s.label
  FROM states s JOIN h n ON n.src = s.dst WHERE s.dh AND n.dst <> s.src),
links AS (
  SELECT src, dst, kind, array_to_string(list_sort(list_distinct(list(type))), '|') AS types,
    arg_min(label, (hops, first, label)) AS label, arg_min(first, (hops, first, label)) AS seq
  FROM states WHERE NOT dh GROUP BY src, dst, kind)
"""


def _visible(spark, d, **options):
    return V.visible_graph(G.trade_nodes(spark, d), G.trade_edges(spark, d), **options)


@query("visible_graph", G.with_trade(VISIBLE_SQL + "SELECT src, dst, kind, label, types, seq FROM links"))
def _(spark, d):
    links = _visible(spark, d)[1]
    return links.select("src", "dst", "kind", "label", F.array_join("types", "|").alias("types"), "seq")


HIDDEN_SQL = G.with_trade("""
keep AS (FROM nodes WHERE kind <> 'station')""" + "," + VISIBLE_SQL.replace("JOIN nodes a", "JOIN keep a").replace("JOIN nodes b", "JOIN keep b") + """
SELECT src, dst, kind, label, types FROM links WHERE kind <> 'train'""")


@query("visible_graph_hidden", HIDDEN_SQL)
def _(spark, d):
    links = _visible(spark, d, hidden=["station", "train"])[1]
    return links.select("src", "dst", "kind", "label", F.array_join("types", "|").alias("types"))


@query("visible_graph_cycles", G.with_events("""
h AS (SELECT e.*, a.helper AS sh, b.helper AS dh FROM eedges e JOIN enodes a ON a.id = src JOIN enodes b ON b.id = dst),
states AS (
  SELECT src, dst, kind, type, dh, seq AS first, label FROM h WHERE NOT sh
  UNION
  SELECT s.src, n.dst, CASE n.kind WHEN 'belt' THEN s.kind ELSE n.kind END, n.type, n.dh, s.first, s.label
  FROM states s JOIN h n ON n.src = s.dst WHERE s.dh AND n.dst <> s.src)
SELECT src, dst, kind, array_to_string(list_sort(list_distinct(list(type))), '|') AS types, min(label) AS label
FROM states WHERE NOT dh GROUP BY src, dst, kind"""))
def _(spark, d):
    links = V.visible_graph(G.event_nodes(spark, d), G.event_edges(spark, d))[1]
    return links.select("src", "dst", "kind", "label", F.array_join("types", "|").alias("types"))


FOCUSED_SQL = VISIBLE_SQL + f""",
shown AS (FROM nodes WHERE NOT helper),
own AS (SELECT id FROM shown WHERE function = '{FN}'),
focused AS (
  SELECT * FROM shown WHERE id IN (
    SELECT id FROM own UNION SELECT dst FROM links JOIN own ON src = own.id UNION SELECT src FROM links JOIN own ON dst = own.id)),
flinks AS (SELECT src || '|' || dst || '|' || kind AS id, * FROM links WHERE src IN (SELECT id FROM focused) AND dst IN (SELECT id FROM focused)),
stops AS (SELECT src AS id FROM flinks WHERE kind = 'train' UNION SELECT dst FROM flinks WHERE kind = 'train'),
ranked AS (
  SELECT p.*, p.id IN (FROM stops) AS train, p.id IN (SELECT id FROM focused) AS vis,
    CASE kind WHEN 'warehouse' THEN 1 WHEN 'rocket' THEN 2 WHEN 'station' THEN 3 WHEN 'machine' THEN 4 WHEN 'output' THEN 5 ELSE 6 END AS rk
  FROM nodes p WHERE function IN (SELECT function FROM focused WHERE function <> '{FN}')),
rep AS (
  SELECT function, id AS representative, CASE WHEN bool_or(train) OVER (PARTITION BY function) THEN 'station' ELSE kind END AS kind
  FROM ranked WHERE train OR rk < 6 OR vis
  QUALIFY row_number() OVER (PARTITION BY function ORDER BY train DESC, CASE WHEN train THEN 0 ELSE rk END, seq) = 1),
fnodes AS (
  SELECT id, kind, function, label, ord, NULL::VARCHAR AS role FROM focused WHERE function = '{FN}'
  UNION ALL
  SELECT 'portal:' || rep.function, rep.kind, rep.function, coalesce(name, rep.function) || ' ↗', 100000.0, 'portal'
  FROM rep LEFT JOIN functions f ON f.id = rep.function),
moved AS (
  SELECT l.id, l.label, l.types, l.seq, l.kind,
    CASE WHEN a.function = '{FN}' THEN l.src ELSE 'portal:' || a.function END AS src,
    CASE WHEN b.function = '{FN}' THEN l.dst ELSE 'portal:' || b.function END AS dst
  FROM flinks l JOIN focused a ON a.id = l.src JOIN focused b ON b.id = l.dst),
folded AS (
  SELECT src, dst, kind, count(*) AS n, arg_min(label, (seq, id)) AS label, arg_min(id, (seq, id)) AS id, min(seq) AS seq,
    list_sort(list_distinct(flatten(list(string_split(types, '|'))))) AS types
  FROM moved WHERE src <> dst GROUP BY src, dst, kind)
"""


def _folded(spark, d):
    nodes, functions = materialize(G.trade_nodes(spark, d)), G.trade_functions(spark, d)
    shown, links = P.focus_function(*V.visible_graph(nodes, G.trade_edges(spark, d), around=FN), FN, focused=True)
    return V.fold_portals(nodes, functions, shown, links, FN)


@query("portal_representative", G.with_trade(FOCUSED_SQL + "SELECT function, representative AS id, kind FROM rep"))
def _(spark, d):
    nodes = materialize(G.trade_nodes(spark, d))
    shown, links = P.focus_function(*V.visible_graph(nodes, G.trade_edges(spark, d), around=FN), FN, focused=True)
    return V.portal_representative(nodes, shown.filter(F.col("function") != FN), links).select("function", "id", "kind")


@query("fold_portals_nodes", G.with_trade(FOCUSED_SQL + "SELECT id, kind, function, label, ord, role FROM fnodes"))
def _(spark, d):
    return _folded(spark, d)[0].select("id", "kind", "function", "label", "ord", "role")


@query("fold_portals_edges", G.with_trade(
    FOCUSED_SQL + "SELECT id, src, dst, kind, n, label, array_to_string(types, '|') AS types FROM folded"))
def _(spark, d):
    return _folded(spark, d)[1].select("id", "src", "dst", "kind", "n", "label", F.array_join("types", "|").alias("types"))


SECTION_SQL = FOCUSED_SQL + f""",
ops AS (
  SELECT *, row_number() OVER (ORDER BY ord, left(id, 1), substr(id, 2)::BIGINT) - 1 AS pos
  FROM fnodes WHERE function = '{FN}' AND role IS NULL),
sized AS (SELECT *, (pos // 24)::INT AS section, ceil(count(*) OVER () / 24) AS total FROM ops),
pick AS (SELECT *, section = least(1, total - 1) AS here FROM sized),
touched AS (
  SELECT f.*, coalesce(a.here, false) AS sin, coalesce(b.here, false) AS din,
    CASE WHEN a.here THEN f.src WHEN a.id IS NULL THEN 'portal:' || na.function
         WHEN a.total > 5 THEN 'section-hub:{FN}:true' ELSE 'section:{FN}:' || a.section END AS s2,
    CASE WHEN b.here THEN f.dst WHEN b.id IS NULL THEN 'portal:' || nb.function
         WHEN b.total > 5 THEN 'section-hub:{FN}:false' ELSE 'section:{FN}:' || b.section END AS d2
  FROM folded f JOIN fnodes na ON na.id = f.src JOIN fnodes nb ON nb.id = f.dst
  LEFT JOIN pick a ON a.id = f.src LEFT JOIN pick b ON b.id = f.dst
  WHERE a.here OR b.here)
"""


SECTION_LINKS_SQL = G.with_trade(SECTION_SQL + """
SELECT s2 AS src, d2 AS dst, kind, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(types)))), '|') AS types
FROM touched GROUP BY s2, d2, kind""")


@query("section_view_edges", SECTION_LINKS_SQL)
def _(spark, d):
    view = V.section_view(*_folded(spark, d), FN, 1)
    return view.edges.select("src", "dst", "kind", "n", F.array_join("types", "|").alias("types"))


@query("section_view_nodes", G.with_trade(SECTION_SQL + """
SELECT id FROM pick WHERE here UNION SELECT s2 FROM touched UNION SELECT d2 FROM touched"""))
def _(spark, d):
    return V.section_view(*_folded(spark, d), FN, 1).nodes.select("id")


@query("section_view_members", G.with_trade(SECTION_SQL + """
SELECT s2 || '|' || d2 || '|' || kind AS link, id AS edge_id FROM touched"""))
def _(spark, d):
    return V.section_view(*_folded(spark, d), FN, 1).members


@query("section_catalog", G.with_trade(SECTION_SQL + f"""
SELECT 'section:{FN}:' || section AS id, 'Участок ' || (section + 1) AS label, section, arg_min(id, pos) AS first_id,
  count(*) AS operations FROM sized GROUP BY section"""))
def _(spark, d):
    return V.section_catalog(_folded(spark, d)[0], FN)


@query("project_view", G.with_trade("""
SELECT id, name, package FROM functions
WHERE package = 'trade/parts' AND (contains(lower(concat_ws(' ', name, id)), 'ring')
  OR id IN (SELECT function FROM nodes WHERE contains(lower(concat_ws(' ', label, function, type, array_to_string(names, ' '))), 'ring')))
"""))
def _(spark, d):
    options = V.ViewOptions(pkg="trade/parts", query="ring")
    view = V.project_view(G.trade_functions(spark, d), G.trade_nodes(spark, d), G.trade_edges(spark, d), options)
    return view.nodes.select("id", "name", "package")


def _view(spark, d, **options):
    whole = options.pop("whole_nodes", 1200)
    return V.project_view(G.trade_functions(spark, d), G.trade_nodes(spark, d), G.trade_edges(spark, d), V.ViewOptions(**options), whole_nodes=whole)


@query("project_view_packages", PACKAGES_SQL)
def _(spark, d):
    """A large graph without a chosen function: flows between packages."""
    return _view(spark, d).edges.withColumn("types", F.array_join("types", "|"))


@query("project_view_whole", HIDDEN_SQL)
def _(spark, d):
    """Shown whole: every operation of the layers that are on."""
    links = _view(spark, d, hidden=("station", "train"), whole_nodes=None).edges
    return links.select("src", "dst", "kind", "label", F.array_join("types", "|").alias("types"))


@query("project_view_function", SECTION_LINKS_SQL)
def _(spark, d):
    """One function, its neighbours folded into portals, its second section."""
    return _view(spark, d, fn=FN, part=1).edges.select("src", "dst", "kind", "n", F.array_join("types", "|").alias("types"))


@query("trace", G.with_trade("""
seeds AS (SELECT id FROM nodes WHERE kind = 'station' AND type = 'PROMO' AND list_contains(names, 'red')),
down AS (SELECT id FROM seeds UNION SELECT dst FROM down JOIN edges ON src = down.id),
up AS (SELECT id FROM seeds UNION SELECT src FROM up JOIN edges ON dst = up.id)
SELECT id FROM down UNION SELECT id FROM up"""))
def _(spark, d):
    seeds = G.trade_nodes(spark, d).filter(
        (F.col("kind") == "station") & (F.col("type") == "PROMO") & F.array_contains("names", "red")
    )
    return C.trace(G.trade_edges(spark, d), seeds.select("id"))


@query("bfs_levels", G.with_trade("""
ends AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk AS (
  SELECT id, 0 AS level FROM nodes WHERE package = 'trade/region/ASIA' AND kind = 'warehouse'
  UNION
  SELECT b, level + 1 FROM walk JOIN ends ON a = id WHERE level < 9)
SELECT id, min(level) AS level FROM walk GROUP BY id"""))
def _(spark, d):
    seeds = G.trade_nodes(spark, d).filter((F.col("package") == "trade/region/ASIA") & (F.col("kind") == "warehouse"))
    return C.bfs_levels(G.trade_edges(spark, d), seeds.select("id"))


COMPONENT_SQL = """
ends AS (SELECT src AS a, dst AS b FROM eedges UNION SELECT dst, src FROM eedges),
reach AS (SELECT id AS root, id FROM enodes UNION SELECT root, b FROM reach JOIN ends ON a = id),
member AS (SELECT id, min(root) AS component FROM reach GROUP BY id)
"""


@query("components", G.with_events(COMPONENT_SQL + "SELECT id, component FROM member"))
def _(spark, d):
    return C.components(G.event_nodes(spark, d), G.event_edges(spark, d))


@query("component_seeds", G.with_events(COMPONENT_SQL + """,
pairs AS (SELECT a, b, count(*) AS w FROM (SELECT src AS a, dst AS b FROM eedges UNION ALL SELECT dst, src FROM eedges) GROUP BY a, b),
strength AS (SELECT n.id, count(b) AS degree, coalesce(sum(1 + log2(w)), 0) AS s FROM enodes n LEFT JOIN pairs ON a = n.id GROUP BY n.id)
SELECT component, arg_min(id, (-degree, -round(s, 6), substr(id, 2)::BIGINT)) AS seed, count(*) AS size
FROM member JOIN strength USING (id) GROUP BY component"""))
def _(spark, d):
    nodes, edges = G.event_nodes(spark, d), G.event_edges(spark, d)
    strength = A.node_strength(nodes, A.contact_graph(nodes, edges))
    return C.component_seeds(C.components(nodes, edges), strength)
