"""Queries for hub splitting, hierarchies, polylines and layout checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import hierarchy as H
from ..operators import hubs as U
from ..operators import layout as L
from ..operators import validate as V
from ..runtime import materialize
from . import graphs as G
from .registry import query

SPACING = 36.0


def points(spark, d):
    """One polyline per user through (value, event id mod 100)."""
    return G.table(spark, d, "events").select(
        F.concat(F.lit("user."), "user_id").alias("path_id"), F.col("event_id").alias("pos"),
        F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"),
    )


PATH_SQL = """
WITH pts AS (SELECT 'user.' || user_id AS path_id, event_id AS pos, value AS x, (event_id % 100)::DOUBLE AS y FROM events),
st AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM pts WINDOW w AS (PARTITION BY path_id ORDER BY pos)),
dist AS (SELECT *, sum(coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0)) OVER (PARTITION BY path_id ORDER BY pos) AS distance FROM st),
seg AS (SELECT path_id, pos, px, py, x, y, lag(distance) OVER (PARTITION BY path_id ORDER BY pos) AS d0, distance AS d1 FROM dist),
len AS (SELECT path_id, max(distance) AS length FROM dist GROUP BY path_id)
"""
ON_SQL = "round(px + (x - px) * (d - d0) / (d1 - d0), 3) AS x, round(py + (y - py) * (d - d0) / (d1 - d0), 3) AS y, round(atan2(y - py, x - px), 3) AS angle"


def _rounded(df, *keys):
    return df.select(*keys, *[F.round(c, 3).alias(c) for c in ("x", "y", "angle")])


@query("measure_paths", PATH_SQL + "SELECT path_id, pos, round(distance, 3) AS distance FROM dist")
def _(spark, d):
    return L.measure_paths(points(spark, d)).select("path_id", "pos", F.round("distance", 3).alias("distance"))


@query("path_lengths", PATH_SQL + "SELECT path_id, round(length, 3) AS length FROM len")
def _(spark, d):
    return L.path_lengths(L.measure_paths(points(spark, d))).select("path_id", F.round("length", 3).alias("length"))


def _positions(spark, d):
    return G.table(spark, d, "events").select(
        F.concat(F.lit("user."), "user_id").alias("path_id"), F.col("event_id").alias("q"),
        (F.col("value") * 37 + 0.123 - 500).alias("distance"),
    )


def _locate_sql(inside):
    return PATH_SQL + f""", pos AS (
  SELECT path_id, event_id AS q, {inside} AS d FROM (
    SELECT 'user.' || user_id AS path_id, event_id, value * 37 + 0.123 - 500 AS distance FROM events) JOIN len USING (path_id) WHERE length > 0)
SELECT path_id, q, {ON_SQL} FROM pos JOIN seg USING (path_id) WHERE d <= d1 AND (d > d0 OR (d = 0 AND d0 = 0 AND d1 > 0))"""


@query("locate_on_path_wrap", _locate_sql("distance - length * floor(distance / length)"))
def _(spark, d):
    return _rounded(L.locate_on_path(points(spark, d), _positions(spark, d)), "path_id", "q")


@query("locate_on_path_clamp", _locate_sql("greatest(0, least(length, distance))"))
def _(spark, d):
    return _rounded(L.locate_on_path(points(spark, d), _positions(spark, d), wrap=False), "path_id", "q")


@query("path_markers", PATH_SQL + f""", n AS (SELECT path_id, length, ceil(length / {SPACING})::BIGINT AS n FROM len WHERE length > 0),
marks AS (SELECT path_id, i, (i + 0.5) * (length / n) AS d FROM (SELECT *, unnest(range(n)) AS i FROM n))
SELECT path_id, i, {ON_SQL} FROM marks JOIN seg USING (path_id) WHERE d > d0 AND d <= d1""")
def _(spark, d):
    return _rounded(L.path_markers(points(spark, d), SPACING), "path_id", "i")


# One layout per supplier: a station per line and a target at the end of its straight
# route; odd lines of ten or more units run on an upper deck for a stretch.
def _lines(spark, d):
    part, q = F.col("l_partkey"), F.col("l_quantity").cast("int")
    return G.table(spark, d, "lineitem").select(
        F.concat(F.lit("S"), "l_suppkey").alias("layout_id"),
        F.concat_ws(
            ".", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")
        ).alias("edge_id"),
        (part % 97 * 6).cast("int").alias("tx"), (F.floor(part / 97) % 61 * 3 + F.col("l_orderkey") % 2).cast("int").alias("ty"),
        F.greatest(q, F.lit(1)).alias("q"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


def layout(spark, d):
    lines = _lines(spark, d)
    trash = F.col("flag") == "R"
    starts = lines.select(
        "layout_id", F.concat(F.lit("a"), "edge_id").alias("id"), F.lit("station").alias("kind"), "status",
        ((F.col("tx") + 0.5) * 32).alias("x"), ((F.col("ty") + 0.5) * 32).alias("y"), F.lit(3).alias("tile_size"),
    )
    targets = lines.select(
        "layout_id", F.concat(F.lit("b"), "edge_id").alias("id"), F.when(trash, "trash").otherwise("machine").alias("kind"), "status",
        ((F.col("tx") + F.col("q") + 3.5) * 32).alias("x"), ((F.col("ty") + 0.5) * 32).alias("y"),
        F.when(trash & (F.col("line") > 2), 1).otherwise(3).alias("tile_size"),
    )
    edges = lines.select(
        "layout_id", "edge_id", F.concat(F.lit("a"), "edge_id").alias("src"), F.concat(F.lit("b"), "edge_id").alias("dst"),
        F.when(F.col("status") == "F", "train").otherwise("belt").alias("kind"), F.lit(0).alias("start_dir"), F.lit(2).alias("end_dir"),
        F.col("q").cast("double").alias("length"),
    )
    i = F.col("pos")
    cells = lines.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).select(
        "layout_id", "edge_id", "pos", (F.col("tx") + 2 + i).alias("x"), F.col("ty").alias("y"),
        F.when((F.col("line") % 2 == 1) & (F.col("q") >= 10) & i.between(3, 6), 1).otherwise(0).alias("layer"),
    )
    return starts.unionByName(targets), edges, cells


LAYOUT_SQL = """
WITH ln AS (
  SELECT 'S' || l_suppkey AS layout_id, concat_ws('.', 'l', l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * 100)::BIGINT) AS edge_id,
    (l_partkey % 97 * 6)::INT AS tx, (l_partkey // 97 % 61 * 3 + l_orderkey % 2)::INT AS ty, greatest(l_quantity::INT, 1) AS q,
    l_linenumber AS line, l_returnflag = 'R' AS trash, l_linestatus AS status FROM lineitem),
nds AS (
  SELECT layout_id, 'a' || edge_id AS id, 'station' AS kind, status, tx AS cx, ty AS cy, 3 AS size FROM ln
  UNION ALL SELECT layout_id, 'b' || edge_id, CASE WHEN trash THEN 'trash' ELSE 'machine' END, status, tx + q + 3, ty, CASE WHEN trash AND line > 2 THEN 1 ELSE 3 END FROM ln),
cells AS (
  SELECT layout_id, edge_id, i AS pos, tx + 2 + i AS x, ty AS y, q, status,
    CASE WHEN line % 2 = 1 AND q >= 10 AND i BETWEEN 3 AND 6 THEN 1 ELSE 0 END AS layer
  FROM (SELECT *, unnest(range(q))::INT AS i FROM ln)),
occ AS (
  SELECT layout_id, x, y, count(*) AS n FROM (
    SELECT layout_id, x, unnest(range(cy - (size - 1) // 2, cy + (size - 1) // 2 + 1))::INT AS y FROM (
      SELECT *, unnest(range(cx - (size - 1) // 2, cx + (size - 1) // 2 + 1))::INT AS x FROM nds)) GROUP BY ALL),
steps AS (SELECT *, lead(layer) OVER w AS nl, lag(layer) OVER w AS pl FROM cells WINDOW w AS (PARTITION BY layout_id, edge_id ORDER BY pos)),
bridge AS (SELECT layout_id, edge_id, tx, ty FROM ln WHERE line % 2 = 1 AND q >= 10),
env AS (
  SELECT layout_id, x, y, count(*) AS n FROM (
    SELECT layout_id, edge_id, x, unnest(range(ty - 1, ty + 2))::INT AS y FROM (SELECT *, unnest(range(tx + 3, tx + 11))::INT AS x FROM bridge)) GROUP BY ALL),
meets AS (SELECT u.layout_id, u.edge_id, u.x, u.y FROM cells u SEMI JOIN (SELECT layout_id, x, y FROM cells WHERE layer = 0 GROUP BY ALL) g ON g.layout_id = u.layout_id AND g.x = u.x AND g.y = u.y WHERE u.layer = 1)
"""


# Scenes for the layout checks: a lot per event, a layout per user, every other scene turned on its diagonal. A route
# e runs on a bridge over a route g, a route h has a bend. Most scenes are sound; what number event_id % 101 is from
# 1 to 22 changes one thing. The expressions below are read by Spark and by DuckDB.
SCENE_NODES = [("a", "station", 0, 0), ("b", "machine", 14, 0), ("c", "machine", 7, -8), ("d", "machine", 7, 8),
               ("s", "machine", 20, 0), ("t", "machine", 42, 8), ("z", "machine", 0, 0)]
SCENE_ROUTES = [("e", "a", "b", 0, 2, 10), ("g", "c", "d", 1, 3, 12), ("h", "s", "t", 0, 3, 26)]
LOTS = ["concat('user.', user_id) AS layout_id", "event_id", "event_id % 101 AS v", "event_id % 2 = 1 AS turned",
        "event_id % 512 * 64 AS lot_x", "CAST(floor(event_id / 512) AS BIGINT) * 64 AS lot_y"]
SCENE = {
    "moved": "CASE v WHEN 9 THEN 40 WHEN 21 THEN -3 ELSE 0 END",
    "node_x": "CASE WHEN n IN ('c', 'd') THEN cx + {moved} WHEN n = 'z' THEN CASE v WHEN 1 THEN 1 WHEN 11 THEN 9 ELSE 30 END ELSE cx END",
    "node_y": "CASE WHEN n = 'z' AND v = 11 THEN 2 ELSE cy END",
    "node_kind": "CASE WHEN n = 'b' AND v = 2 THEN 'trash' ELSE kind END",
    "node_there": "n <> 'z' OR v IN (1, 11, 19)",
    "src": "CASE WHEN r = 'e' AND v = 4 THEN 'd' ELSE src END",
    "dst": "CASE WHEN r = 'h' AND v = 20 THEN 'a' ELSE dst END",
    "route_kind": "CASE WHEN r = 'e' AND v = 3 THEN 'train' ELSE 'belt' END",
    "start": "CASE WHEN r = 'h' AND v = 18 THEN 1 ELSE start_dir END",
    "end": "CASE WHEN r = 'e' AND v = 5 THEN 0 ELSE end_dir END",
    "cell_x": "CASE r WHEN 'e' THEN 2 + pos WHEN 'g' THEN 7 + {moved} ELSE least(22 + pos, 42) END",
    "cell_y": "CASE WHEN r = 'e' THEN CASE WHEN v = 6 AND pos = 1 THEN 5 ELSE 0 END WHEN r = 'g' THEN pos - 6 "
              "WHEN v = 13 AND pos = 26 THEN 4 ELSE greatest(pos - 20, 0) END",
    "cell_layer": "CASE WHEN v = 14 AND r = 'h' AND pos = 3 THEN 2 "
                  "WHEN r = 'e' AND pos BETWEEN 3 AND 7 AND NOT (v = 7 AND pos = 5) THEN 1 WHEN v = 8 AND r = 'e' AND pos = 10 THEN 1 "
                  "WHEN v = 10 AND r = 'g' AND pos BETWEEN 3 AND 5 THEN 1 WHEN v = 15 AND r = 'h' AND pos BETWEEN 17 AND 23 THEN 1 "
                  "WHEN v = 16 AND r = 'h' AND pos BETWEEN 2 AND 18 THEN 1 WHEN v = 17 AND r = 'h' AND pos IN (2, 3, 4, 6, 7, 8) THEN 1 "
                  "WHEN v = 22 AND r = 'h' AND pos BETWEEN 22 AND 24 THEN 1 ELSE 0 END",
    "cell_there": "NOT (v = 12 AND r = 'e' AND pos > 0)",
}
SCENE = {k: text.replace("{moved}", SCENE["moved"]) for k, text in SCENE.items()}


def _placed(x: str, y: str) -> list[str]:
    """Tile columns x and y in the layout: turned where the scene is, then moved to its lot."""
    return [f"CAST(lot_x + CASE WHEN turned THEN {y} ELSE {x} END AS INT) AS x", f"CAST(lot_y + CASE WHEN turned THEN {x} ELSE {y} END AS INT) AS y"]


def _heading(direction: str) -> str:
    """Turning swaps right with down and left with up."""
    return f"CASE WHEN turned THEN {direction} + 1 - 2 * (({direction}) % 2) ELSE {direction} END"


_id = lambda c: f"concat(event_id, '.', {c})"
SCENE_TABLES = {
    "nodes": ["layout_id", f"{_id('n')} AS id", f"{SCENE['node_kind']} AS kind", *_placed(SCENE["node_x"], SCENE["node_y"])],
    "routes": ["layout_id", f"{_id('r')} AS edge_id", f"{_id(SCENE['src'])} AS src", f"{_id(SCENE['dst'])} AS dst",
               f"{SCENE['route_kind']} AS kind", f"{_heading(SCENE['start'])} AS start_dir", f"{_heading(SCENE['end'])} AS end_dir"],
    "cells": ["layout_id", f"{_id('r')} AS edge_id", "CAST(pos AS INT) AS pos", *_placed(SCENE["cell_x"], SCENE["cell_y"]),
              f"{SCENE['cell_layer']} AS layer"],
}


def scenes(spark, d):
    """(nodes, edges, cells) of the layouts above."""
    base = G.table(spark, d, "events").selectExpr(*LOTS)
    struct = lambda names, row: "struct(" + ", ".join(f"{v!r} AS {n}" for n, v in zip(names, row, strict=True)) + ")"
    each = lambda names, rows: f"inline(array({', '.join(struct(names, row) for row in rows)}))"
    nodes = base.selectExpr("*", each(("n", "kind", "cx", "cy"), SCENE_NODES)).filter(SCENE["node_there"]).selectExpr(*SCENE_TABLES["nodes"])
    routes = base.selectExpr("*", each(("r", "src", "dst", "start_dir", "end_dir", "last"), SCENE_ROUTES))
    cells = routes.selectExpr("*", "explode(sequence(0, last)) AS pos").filter(SCENE["cell_there"])
    centre = lambda c: ((F.col(c) + 0.5) * 32).alias(c)
    return (
        nodes.select("layout_id", "id", "kind", centre("x"), centre("y"), F.lit(3).alias("tile_size")),
        routes.selectExpr(*SCENE_TABLES["routes"]), cells.selectExpr(*SCENE_TABLES["cells"]),
    )


SCENE_SQL = f"""
WITH base AS (SELECT {', '.join(LOTS)} FROM events),
nds AS (SELECT {', '.join(SCENE_TABLES['nodes'])} FROM base, (VALUES {', '.join(map(str, SCENE_NODES))}) AS t(n, kind, cx, cy) WHERE {SCENE['node_there']}),
lines AS (SELECT * FROM base, (VALUES {', '.join(map(str, SCENE_ROUTES))}) AS t(r, src, dst, start_dir, end_dir, last)),
eds AS (SELECT {', '.join(SCENE_TABLES['routes'])} FROM lines),
cls AS (SELECT {', '.join(SCENE_TABLES['cells'])} FROM (SELECT *, unnest(range(last + 1)) AS pos FROM lines) WHERE {SCENE['cell_there']}),
near(i) AS (VALUES (-1), (0), (1)),
occ AS (SELECT layout_id, n.x + a.i AS x, n.y + b.i AS y, count(*) AS n FROM nds n, near a, near b GROUP BY ALL),
way(dir, dx, dy) AS (VALUES (0, 1, 0), (1, 0, 1), (2, -1, 0), (3, 0, -1)),
w AS (
  SELECT c.*, e.kind, e.src, e.dst, s.dx AS sdx, s.dy AS sdy, t.dx AS edx, t.dy AS edy,
    lag(c.x) OVER o AS px, lag(c.y) OVER o AS py, lag(layer) OVER o AS pl, lead(c.x) OVER o AS nx, lead(c.y) OVER o AS ny, lead(layer) OVER o AS nl
  FROM cls c JOIN eds e USING (layout_id, edge_id) JOIN way s ON s.dir = start_dir JOIN way t ON t.dir = end_dir
  WINDOW o AS (PARTITION BY layout_id, edge_id ORDER BY pos)),
-- A bridge is a stretch of upper cells; how many lower cells lie before a cell names the stretch.
up AS (SELECT *, pos - row_number() OVER (PARTITION BY layout_id, edge_id ORDER BY pos) AS stretch FROM w WHERE layer = 1),
span AS (
  SELECT *, row_number() OVER (PARTITION BY layout_id, edge_id ORDER BY stretch) AS run FROM (
    SELECT layout_id, edge_id, stretch, min(pos) - 1 AS a, max(pos) + 1 AS b, count(DISTINCT x) = 1 AS same_x, count(DISTINCT y) = 1 AS same_y
    FROM up GROUP BY layout_id, edge_id, stretch)),
feet AS (
  SELECT s.*, f.layer = 0 AND g.layer = 0 AS grounded, same_x AND f.x = g.x OR same_y AND f.y = g.y AS flat
  FROM span s LEFT JOIN cls f ON f.layout_id = s.layout_id AND f.edge_id = s.edge_id AND f.pos = a
  LEFT JOIN cls g ON g.layout_id = s.layout_id AND g.edge_id = s.edge_id AND g.pos = b),
deck AS (SELECT c.layout_id, c.edge_id, run, x, y FROM cls c JOIN span s ON c.layout_id = s.layout_id AND c.edge_id = s.edge_id AND pos BETWEEN a AND b),
env AS (SELECT layout_id, x, y, count(DISTINCT (edge_id, run)) AS n FROM (SELECT layout_id, edge_id, run, x + p.i AS x, y + q.i AS y FROM deck, near p, near q) GROUP BY ALL),
axis AS (
  SELECT *, CASE WHEN coalesce(px, x - sdx) = coalesce(nx, x - edx) THEN 'v' WHEN coalesce(py, y - sdy) = coalesce(ny, y - edy) THEN 'h' ELSE 'turn' END AS way
  FROM w),
meets AS (
  SELECT o.layout_id, o.edge_id, o.pos, o.x, o.y, o.way = 'turn' OR u.way = 'turn' OR u.way = o.way OR coalesce(u.nl = 1, false) OR coalesce(u.pl = 1, false) AS odd
  FROM axis o JOIN axis u ON u.layout_id = o.layout_id AND u.x = o.x AND u.y = o.y WHERE o.layer = 1 AND u.layer = 0),
tips AS (
  SELECT layout_id, edge_id, 'start' AS tip, src AS id, x - sdx AS hx, y - sdy AS hy, layer, coalesce(nx = x + sdx AND ny = y + sdy AND nl = 0, false) AS straight FROM w WHERE px IS NULL
  UNION ALL SELECT layout_id, edge_id, 'end', dst, x - edx, y - edy, layer, coalesce(px = x + edx AND py = y + edy AND pl = 0, false) FROM w WHERE nx IS NULL)
"""


@query("validate_layout", SCENE_SQL + """
SELECT layout_id, 'overlap' AS rule, x || ',' || y AS key FROM occ WHERE n > 1
UNION ALL SELECT layout_id, 'trash_size', id FROM nds WHERE kind = 'trash'
UNION ALL SELECT layout_id, 'short_route', edge_id FROM eds LEFT JOIN cls USING (layout_id, edge_id) GROUP BY ALL HAVING count(pos) < 2
UNION ALL SELECT layout_id, tip || '_approach', edge_id FROM tips WHERE NOT straight
UNION ALL SELECT t.layout_id, tip || '_port', edge_id FROM tips t JOIN nds n ON n.layout_id = t.layout_id AND n.id = t.id
  WHERE NOT (abs(hx - n.x) <= 1 AND abs(hy - n.y) <= 1 AND layer = 0)
UNION ALL SELECT layout_id, 'on_building', edge_id || '@' || x || ',' || y FROM cls SEMI JOIN occ USING (layout_id, x, y)
UNION ALL SELECT layout_id, 'shared_cell', x || ',' || y || ',' || layer FROM cls GROUP BY layout_id, x, y, layer HAVING count(DISTINCT edge_id) > 1
UNION ALL SELECT layout_id, 'revisited', edge_id || '@' || x || ',' || y FROM cls GROUP BY layout_id, edge_id, x, y HAVING count(*) > 1
UNION ALL SELECT layout_id, 'gap', edge_id || '@' || pos FROM w WHERE abs(x - px) + abs(y - py) <> 1
UNION ALL SELECT layout_id, 'layer', edge_id || '@' || pos FROM cls WHERE layer > 1
UNION ALL SELECT layout_id, 'raised_rail', edge_id || '@' || pos FROM w WHERE kind = 'train' AND layer <> 0
UNION ALL SELECT layout_id, 'loose_bridge', edge_id || '#' || run FROM feet WHERE NOT coalesce(grounded, false)
UNION ALL SELECT layout_id, 'bridge_length', edge_id || '#' || run FROM feet WHERE grounded AND b - a NOT BETWEEN 2 AND 16
UNION ALL SELECT layout_id, 'bent_bridge', edge_id || '#' || run FROM feet WHERE grounded AND NOT flat
UNION ALL SELECT layout_id, 'close_bridges', x || ',' || y FROM env WHERE n > 1
UNION ALL SELECT layout_id, 'bridge_at_building', x || ',' || y FROM env SEMI JOIN occ USING (layout_id, x, y)
UNION ALL SELECT layout_id, 'crossing', x || ',' || y FROM meets GROUP BY layout_id, x, y HAVING bool_or(odd)
UNION ALL SELECT f.layout_id, 'idle_bridge', f.edge_id || '#' || run FROM feet f
  WHERE grounded AND NOT EXISTS (SELECT 1 FROM meets m WHERE m.layout_id = f.layout_id AND m.edge_id = f.edge_id AND m.pos BETWEEN a AND b)""")
def _(spark, d):
    """Every broken rule of the scenes; all rules fire, in upright and in turned scenes."""
    return V.validate_layout(*scenes(spark, d))


METRIC_SQL = LAYOUT_SQL + """,
box AS (
  SELECT layout_id, cx - (size - 1) // 2 AS x0, cx + (size - 1) // 2 AS x1, cy - (size - 1) // 2 AS y0, cy + (size - 1) // 2 AS y1 FROM nds
  UNION ALL SELECT layout_id, x, x, y, y FROM cells),
m AS (
  SELECT layout_id, max(x1) - min(x0) + 1 AS width, max(y1) - min(y0) + 1 AS height FROM box GROUP BY layout_id),
metrics AS (
  SELECT layout_id, width, height, width::BIGINT * height AS area, (SELECT sum(q)::DOUBLE FROM ln WHERE ln.layout_id = m.layout_id) AS length,
    (SELECT count(*) FROM bridge WHERE bridge.layout_id = m.layout_id) AS bridges FROM m)
"""


def _metrics(spark, d):
    nodes, edges, cells = layout(spark, d)
    return L.layout_metrics(nodes, cells, edges)


@query("layout_metrics", METRIC_SQL + "SELECT layout_id, width::BIGINT AS width, height::BIGINT AS height, area, length, bridges FROM metrics")
def _(spark, d):
    m = _metrics(spark, d)
    return m.withColumns({"width": F.col("width").cast("bigint"), "height": F.col("height").cast("bigint")})


@query("compare_metrics", METRIC_SQL + """,
shrunk AS (
  SELECT layout_id, CASE WHEN length % 2 = 0 THEN area * 3 // 4 ELSE area END AS area, length * 0.9 AS length,
    CASE WHEN bridges % 3 = 0 THEN bridges + 1 ELSE bridges END AS bridges FROM metrics)
SELECT layout_id, floor(greatest(0, (a.area - b.area) / a.area * 100) + 0.5)::INT AS area_cut,
  floor(greatest(0, (a.length - b.length) / a.length * 100) + 0.5)::INT AS length_cut,
  CASE WHEN a.bridges = 0 THEN 0 ELSE floor(greatest(0, (a.bridges - b.bridges) / a.bridges * 100) + 0.5) END::INT AS bridges_cut,
  b.bridges <= a.bridges AS better
FROM metrics a JOIN shrunk b USING (layout_id)""")
def _(spark, d):
    before = materialize(_metrics(spark, d))  # a row a layout, read twice
    after = before.withColumns({
        "area": F.when(F.col("length") % 2 == 0, F.expr("area * 3 div 4")).otherwise(F.col("area")),
        "length": F.col("length") * 0.9,
        "bridges": F.when(F.col("bridges") % 3 == 0, F.col("bridges") + 1).otherwise(F.col("bridges")),
    })
    return L.compare_metrics(before, after)


@query("district_bounds", LAYOUT_SQL + """
SELECT layout_id, status, ((min(cx - (size - 1) // 2) - 1) * 32)::BIGINT AS x, ((min(cy - (size - 1) // 2) - 3) * 32)::BIGINT AS y,
  ((max(cx + (size - 1) // 2) + 2 - min(cx - (size - 1) // 2) + 1) * 32)::BIGINT AS w,
  ((max(cy + (size - 1) // 2) + 2 - min(cy - (size - 1) // 2) + 3) * 32)::BIGINT AS h, count(*) AS n
FROM nds GROUP BY layout_id, status""")
def _(spark, d):
    out = L.district_bounds(layout(spark, d)[0], "status")
    return out.withColumns({c: F.col(c).cast("bigint") for c in "xywh"})


@query("scene_bounds", LAYOUT_SQL + """
SELECT layout_id, ((min(cx - (size - 1) // 2) - 3) * 32)::DOUBLE AS x, ((min(cy - (size - 1) // 2) - 5) * 32)::DOUBLE AS y,
  ((max(cx + (size - 1) // 2) - min(cx - (size - 1) // 2) + 7) * 32)::DOUBLE AS w,
  ((max(cy + (size - 1) // 2) - min(cy - (size - 1) // 2) + 9) * 32)::DOUBLE AS h
FROM nds GROUP BY layout_id""")
def _(spark, d):
    nodes = layout(spark, d)[0]
    return L.scene_bounds(nodes, L.district_bounds(nodes, "status"))


def _bent(cells):
    """The same routes with every second step back, so they end half as far away."""
    pos = F.col("pos")
    return cells.withColumn("x", (F.col("x") - pos + F.floor(pos / 2) + pos % 2).cast("int"))


@query("path_detour", LAYOUT_SQL + """
SELECT layout_id, edge_id, (q - 1 - (q - 1) // 2 - (q - 1) % 2)::BIGINT AS detour FROM ln""")
def _(spark, d):
    return L.path_detour(_bent(layout(spark, d)[2]))


@query("top_detours", LAYOUT_SQL + """
SELECT layout_id, edge_id, (q - 1 - (q - 1) // 2 - (q - 1) % 2)::BIGINT AS detour, q::DOUBLE AS length FROM ln
WHERE detour > 0 ORDER BY detour DESC, length DESC, edge_id, layout_id LIMIT 12""")
def _(spark, d):
    _nodes, edges, cells = layout(spark, d)
    return L.top_detours(_bent(cells), edges)


@query("match_layout", LAYOUT_SQL + """
SELECT 'coordinate' AS rule, 'nodes' AS "table", id AS key FROM nds WHERE kind = 'trash'
UNION ALL SELECT 'unexpected', 'edges', edge_id FROM ln WHERE status = 'F'
UNION ALL SELECT 'absent', 'edges', 'x' || edge_id FROM ln WHERE status = 'F'
UNION ALL SELECT 'cell_count', 'edges', edge_id FROM ln WHERE q < 2
UNION ALL SELECT 'direction', 'edges', edge_id FROM ln WHERE q > 45
UNION ALL SELECT 'repeated_id', 'nodes', id FROM nds GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'repeated_id', 'edges', edge_id FROM ln GROUP BY edge_id HAVING count(*) > 1""".replace(
    "FROM ln WHERE q < 2", "FROM ln WHERE edge_id IN (SELECT edge_id FROM ln GROUP BY edge_id HAVING sum(q) < 2)"))
def _(spark, d):
    nodes, edges, cells = layout(spark, d)
    moved = nodes.withColumn("x", F.when(F.col("kind") == "trash", F.col("x") + 3).otherwise(F.col("x")))
    turned = edges.withColumn("end_dir", F.when(F.col("length") > 45, 7).otherwise(F.col("end_dir")))
    wanted = edges.select(F.when(F.col("kind") == "train", F.concat(F.lit("x"), "edge_id")).otherwise(F.col("edge_id")).alias("id"))
    return V.match_layout(moved, turned, cells, nodes.select("id"), wanted).drop("message")


# Hubs: the preorder numbers of a halving tree, computed level by level in SQL.
HUB_SQL = """
deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
busy AS (SELECT n.* FROM nodes n JOIN deg USING (id) WHERE degree > 4),
ends AS (SELECT id AS eid, dst AS hub, 'in' AS side, seq, type FROM edges WHERE kind <> 'train'
         UNION ALL SELECT id, src, 'out', seq, type FROM edges WHERE kind <> 'train'),
rk AS (SELECT *, row_number() OVER (PARTITION BY hub, side ORDER BY seq, eid) - 1 AS pos, count(*) OVER (PARTITION BY hub, side) AS n
       FROM ends WHERE hub IN (SELECT id FROM busy) QUALIFY n >= 2),
tree AS (
  SELECT DISTINCT hub, side, 0::BIGINT AS num, 0::BIGINT AS lo, n::BIGINT AS size, -1::BIGINT AS up FROM rk
  UNION ALL
  SELECT hub, side, CASE WHEN part = 0 THEN num + 1 ELSE num + (size + 1) // 2 END, CASE WHEN part = 0 THEN lo ELSE lo + (size + 1) // 2 END,
    CASE WHEN part = 0 THEN (size + 1) // 2 ELSE size // 2 END, num
  FROM tree, (VALUES (0), (1)) p(part) WHERE size > 2 AND CASE WHEN part = 0 THEN (size + 1) // 2 ELSE size // 2 END >= 2),
named AS (SELECT *, 'junction:' || hub || ':' || side || ':' || num AS jid, CASE WHEN up < 0 THEN hub ELSE 'junction:' || hub || ':' || side || ':' || up END AS par FROM tree),
leafof AS (SELECT rk.*, jid FROM rk JOIN named t ON t.hub = rk.hub AND t.side = rk.side AND rk.pos >= lo AND rk.pos < lo + size
           QUALIFY row_number() OVER (PARTITION BY eid, rk.side ORDER BY size) = 1)
"""


def _split(spark, d):
    nodes = materialize(G.trade_nodes(spark, d))
    links = materialize(G.trade_edges(spark, d).withColumn("types", A.edge_types()))
    return U.split_hubs(nodes, links)


@query("split_hubs_edges", G.with_trade(HUB_SQL + """
SELECT e.id, coalesce(o.jid, src) AS src, coalesce(i.jid, dst) AS dst, kind, type AS types FROM edges e
LEFT JOIN (FROM leafof WHERE side = 'out') o ON o.eid = e.id LEFT JOIN (FROM leafof WHERE side = 'in') i ON i.eid = e.id
UNION ALL
SELECT 'link:' || jid, CASE WHEN t.side = 'in' THEN jid ELSE par END, CASE WHEN t.side = 'in' THEN par ELSE jid END, 'belt',
  array_to_string(list_sort(list(DISTINCT r.type)), '|')
FROM named t JOIN rk r ON r.hub = t.hub AND r.side = t.side AND r.pos >= lo AND r.pos < lo + size GROUP BY jid, t.side, par""".replace(
    "SELECT e.id, coalesce(o.jid, src) AS src, coalesce(i.jid, dst) AS dst, kind, type AS types",
    "SELECT e.id, coalesce(o.jid, src) AS src, coalesce(i.jid, dst) AS dst, kind, e.type AS types")))
def _(spark, d):
    return _split(spark, d)[1].select("id", "src", "dst", "kind", F.array_join("types", "|").alias("types"))


@query("split_hubs_nodes", G.with_trade(HUB_SQL + """
SELECT id, kind, label, ord FROM nodes UNION ALL
SELECT jid, 'splitter', CASE WHEN side = 'in' THEN 'Сбор · ' ELSE 'Делитель · ' END || label,
  ord + CASE WHEN side = 'in' THEN -0.1::DOUBLE ELSE 0.1::DOUBLE END + num * 0.001::DOUBLE FROM named JOIN nodes ON id = hub"""))
def _(spark, d):
    return _split(spark, d)[0].select("id", "kind", "label", "ord")


def _hierarchy(spark, d):
    return H.contract_groups(G.event_nodes(spark, d), G.event_edges(spark, d))


# Which merges happen depends on the round rule; what must hold is that the groups are
# the components and that their inner edges are all edges.
GROUP_SQL = """
ends AS (SELECT src AS a, dst AS b FROM eedges UNION SELECT dst, src FROM eedges),
reach AS (SELECT id AS root, id FROM enodes UNION SELECT root, b FROM reach JOIN ends ON a = id),
member AS (SELECT id, min(root) AS first FROM reach GROUP BY id)
"""


@query("contract_groups", G.with_events(GROUP_SQL + """
SELECT m.first, count(DISTINCT m.id) AS nodes, count(DISTINCT e.id) AS edges FROM member m LEFT JOIN eedges e ON e.src = m.id GROUP BY m.first"""))
def _(spark, d):
    h = _hierarchy(spark, d)
    nodes = h.groups.groupBy("group_id").agg(F.min("node_id").alias("first"), F.count(F.lit(1)).alias("nodes"))
    edges = h.group_edges.groupBy("group_id").agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(edges, "group_id", "left").select("first", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


# Every rule at events of one type, so that the rows follow from the events whatever the rounds were.
@query("validate_hierarchy", G.with_events("""
SELECT 'group_edges' AS rule, id AS key FROM eedges WHERE kind = 'train'
UNION ALL SELECT 'merge_edges', id FROM eedges WHERE label = 'click'
UNION ALL SELECT 'members', id FROM enodes, (VALUES (1), (2)) AS sides(n) WHERE label = 'signup'
UNION ALL SELECT 'degree', 'block:' || src FROM eedges, (VALUES (1), (2)) AS sides(n) WHERE label = 'error'
UNION ALL SELECT 'merged_twice', 'block:' || src FROM eedges WHERE label = 'view'
UNION ALL SELECT 'order', 'late:' || id FROM enodes WHERE label = 'signup'
UNION ALL SELECT 'ring', 'loop:' || id FROM enodes WHERE label = 'error'
UNION ALL SELECT 'ring', 'pool:' || id FROM enodes WHERE label = 'error'
UNION ALL SELECT 'open_edge', 'open:' || id FROM enodes WHERE label = 'purchase'"""))
def _(spark, d):
    """A stored hierarchy that is wrong in every way.

    It lost the train links of its groups and the click links of its merges, has signups in another group, counts a link too
    many at errors and merges views twice. Beside the events stand pairs of nodes that come together in different rounds
    (at signups), pairs that never do though they are linked (at purchases), and groups that are their own parents (at errors).
    """
    nodes, edges = materialize(G.event_nodes(spark, d)), materialize(G.event_edges(spark, d))
    h = H.contract_groups(nodes, edges)
    at = lambda label: nodes.filter(F.col("label") == label)
    name = lambda first: F.concat(F.lit(first), "id")
    blocks = lambda label: at(label).select(name("block:").alias("group"))
    text, none = (lambda v: F.lit(v)), F.lit(None).cast("string")
    pairs = at("signup").select(name("left:").alias("a"), name("right:").alias("b"), name("late:").alias("e"))
    apart = at("purchase").select(name("left:").alias("a"), name("right:").alias("b"), name("open:").alias("e"))
    every = pairs.unionByName(apart)
    more_nodes = every.select(F.explode(F.array("a", "b")).alias("id"))
    more_edges = every.select(F.col("e").alias("id"), F.col("a").alias("src"), F.col("b").alias("dst"))
    row = lambda n, group, parent, degree: F.struct(
        F.lit(n).alias("round"), group.alias("group"), none.alias("partner"), parent.alias("parent"), F.lit(degree).cast("long").alias("degree"))
    block = lambda c: F.concat(text("block:"), c)
    late = pairs.select(F.explode(F.array(row(5, block("a"), F.col("e"), 1), row(7, block("b"), F.col("e"), 1))).alias("m")).select("m.*")
    loops = at("error").select(F.explode(F.array(
        row(0, name("loop:"), name("pool:"), 1), row(1, name("pool:"), name("loop:"), 1))).alias("m")).select("m.*")
    again = h.merges.join(blocks("view"), "group", "left_semi").withColumn("round", F.col("round") + 1000)
    counted = h.merges.join(blocks("error").withColumn("one", F.lit(1)), "group", "left").withColumn(
        "degree", F.col("degree") + F.coalesce("one", F.lit(0))).drop("one")
    merges = counted.unionByName(again).unionByName(late).unionByName(loops)
    ids = lambda where: edges.filter(where).select(F.col("id").alias("edge_id"))
    merge_edges = h.merge_edges.join(ids("label = 'click'"), "edge_id", "left_anti").unionByName(
        pairs.select(F.lit(7).alias("round"), F.col("e").alias("parent"), F.col("e").alias("edge_id")))
    moved = at("signup").select(F.col("id").alias("node_id"), text("elsewhere").alias("other"))
    groups = h.groups.join(moved, "node_id", "left").select(F.coalesce("other", "group_id").alias("group_id"), "node_id")
    for side in ("a", "b"):
        groups = groups.unionByName(pairs.select(F.col("e").alias("group_id"), F.col(side).alias("node_id")))
        groups = groups.unionByName(apart.select(block(side).alias("group_id"), F.col(side).alias("node_id")))
    group_edges = h.group_edges.join(ids("kind = 'train'"), "edge_id", "left_anti").unionByName(
        pairs.select(F.col("e").alias("group_id"), F.col("e").alias("edge_id")))
    return H.validate_hierarchy(
        nodes.select("id").unionByName(more_nodes), edges.select("id", "src", "dst").unionByName(more_edges),
        H.Hierarchy(merges, merge_edges, groups, group_edges))
