import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from flowweft.operators import selection as P
from flowweft.operators import views as V


def links_of(df):
    return {(r.src, r.dst, r.kind): tuple(r.types) for r in df.collect()}


def brute(nodes, edges, compact=True, hidden=()):
    """Plain queue walk per visible node: (src, dst, kind) -> (types, label)."""
    kind = {n["id"]: n.get("kind", "machine") for n in nodes}
    helper = {n["id"]: n.get("helper", False) for n in nodes}
    shown = {i for i in kind if kind[i] not in hidden and not (compact and helper[i])}
    out = {}
    for s, d, *rest in edges:
        out.setdefault(s, []).append((d, *rest))
    found = {}
    for origin in shown:
        queue = deque((d, k, t, lab) for d, k, t, lab in out.get(origin, []))
        seen = set()
        while queue:
            at, k, t, lab = queue.popleft()
            if at == origin or (at, k, t) in seen:
                continue
            seen.add((at, k, t))
            if at in shown:
                if ("train" if k == "train" else "belt") not in hidden:
                    types, first = found.setdefault((origin, at, k), (set(), lab))
                    types.add(t)
            elif compact and helper[at] and kind[at] not in hidden:
                queue.extend((d, k if k2 == "belt" else k2, t2, lab) for d, k2, t2, _ in out.get(at, []))
    return {key: (tuple(sorted(types)), label) for key, (types, label) in found.items()}


def random_graph(seed, n=16, m=34):
    rng = random.Random(seed)
    nodes = [{"id": f"n{i}", "kind": rng.choice(["machine", "station", "memory"]), "helper": rng.random() < 0.5} for i in range(n)]
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(["belt", "call", "train"]), rng.choice(["int", "string"]), f"l{j}") for j in range(m)]
    return nodes, [e for e in edges if e[0] != e[1]]


@pytest.mark.parametrize("seed,hidden", [(1, ()), (2, ("memory",)), (3, ("train",)), (4, ("belt", "station"))])
def test_contraction_matches_a_plain_walk(spark, make_nodes, make_edges, seed, hidden):
    nodes, edges = random_graph(seed)
    links = V.visible_graph(make_nodes(nodes), make_edges(edges), hidden=hidden)[1]
    assert {(r.src, r.dst, r.kind): (tuple(r.types), r.label) for r in links.collect()} == brute(nodes, edges, hidden=hidden)


def test_uncompacted_graph_keeps_helpers(spark, make_nodes, make_edges):
    nodes, edges = random_graph(7)
    shown, links = V.visible_graph(make_nodes(nodes), make_edges(edges), compact=False)
    assert shown.count() == len(nodes)
    assert set(links_of(links)) == set(brute(nodes, edges, compact=False))


def test_hidden_sink_makes_no_bypass(spark, make_nodes, make_edges):
    nodes = make_nodes(["a", {"id": "b", "kind": "warehouse"}, "c"])
    assert V.visible_graph(nodes, make_edges([("a", "b"), ("b", "c")]), hidden=["warehouse"])[1].count() == 0


def test_train_kind_survives_a_helper(spark, make_nodes, make_edges):
    nodes = make_nodes(["a", {"id": "h", "helper": True}, "b"])
    links = V.visible_graph(nodes, make_edges([("a", "h", "train", "T", "q"), ("h", "b", "belt", "U", "")]))[1]
    assert links_of(links) == {("a", "b", "train"): ("U",)}


@pytest.mark.parametrize("seed", [1, 5])
def test_busy_helpers_stay_as_junctions_with_equal_reach(spark, make_nodes, make_edges, seed):
    nodes, edges = random_graph(seed)
    want = {(a, b) for a, b, _ in brute(nodes, edges)}
    shown, links = V.visible_graph(make_nodes(nodes), make_edges(edges), linear=True)
    junctions = {r.id for r in shown.filter("role = 'junction'").collect()}
    assert junctions
    out = {}
    for r in links.collect():
        out.setdefault(r.src, set()).add(r.dst)
    got = set()
    for origin in {n["id"] for n in nodes if not n["helper"]}:
        queue, seen = list(out.get(origin, ())), set()
        while queue:
            at = queue.pop()
            if at in seen:
                continue
            seen.add(at)
            if at in junctions:
                queue.extend(out.get(at, ()))
            elif at != origin:
                got.add((origin, at))
    assert got == want


def test_around_gives_the_focused_part(spark, make_nodes, make_edges):
    rng = random.Random(11)
    nodes, edges = random_graph(11, 30, 60)
    for n in nodes:
        n["function"] = rng.choice(["f", "g", "h"])
    a = P.focus_function(*V.visible_graph(make_nodes(nodes), make_edges(edges)), "f")
    b = P.focus_function(*V.visible_graph(make_nodes(nodes), make_edges(edges), around="f"), "f")
    assert {r.id for r in a[0].collect()} == {r.id for r in b[0].collect()}
    assert links_of(a[1]) == links_of(b[1])


def test_focus_and_portals(spark, make_nodes, make_edges):
    nodes = make_nodes([
        {"id": "a", "function": "x.F"}, {"id": "b", "function": "x.G", "kind": "source"}, {"id": "c", "function": "x.G", "kind": "warehouse"},
        {"id": "d", "function": "x.H"},
    ])
    edges = make_edges([("a", "b", "call", "int", ""), ("a", "c", "call", "string", ""), ("a", "d", "train", "int", ""), ("b", "d")])
    functions = spark.createDataFrame([("x.F", "F"), ("x.G", "G")], "id string, name string")
    shown, links = P.focus_function(*V.visible_graph(nodes, edges), "x.F")
    folded, merged = V.fold_portals(nodes, functions, shown, links, "x.F")
    assert {(r.id, r.kind, r.label) for r in folded.collect()} == {
        ("a", "machine", "a"), ("portal:x.G", "warehouse", "G ↗"), ("portal:x.H", "station", "H ↗")}
    assert links_of(merged) == {
        ("a", "portal:x.G", "call"): ("int", "string"), ("a", "portal:x.H", "train"): ("int",), ("portal:x.G", "portal:x.H", "belt"): ("",)}


def test_sections_cover_every_node_and_edge(spark, make_nodes, make_edges):
    nodes = make_nodes([{"id": f"n{i}", "function": "f"} for i in range(210)])
    edges = make_edges([("n0", f"n{i}") for i in range(2, 210)])
    shown, links = V.visible_graph(nodes, edges)
    seen, stood_for = set(), set()
    for part in range(9):
        view = V.section_view(shown, links, "f", part)
        assert view.sections == 9 and view.operations == 210
        assert view.edges.agg(F.sum("n")).first()[0] == view.members.count()
        seen |= {r.id for r in view.nodes.collect() if r.role is None}
        stood_for |= {r.edge_id for r in view.members.collect()}
        ends = {r.id for r in view.nodes.collect()}
        assert all(r.src in ends and r.dst in ends for r in view.edges.collect())
    assert len(seen) == 210 and len(stood_for) == 208
    assert V.section_view(shown, links, "f", -1).nodes.count() == 9
    assert V.section_view(shown, links, "f", 99).section == 8


def test_large_graphs_open_as_packages(spark):
    n = spark.range(1300).select(
        F.concat(F.lit("n"), "id").alias("id"), F.lit("machine").alias("kind"), F.lit("x").alias("label"),
        F.concat(F.lit("f"), F.col("id") % 4).alias("function"), F.concat(F.lit("p"), F.col("id") % 2).alias("package"), F.lit("").alias("type"),
        F.array().cast("array<string>").alias("names"), F.lit(False).alias("helper"), F.col("id").alias("seq"), F.col("id").cast("double").alias("ord"))
    e = spark.range(1299).select(
        F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"),
        F.when(F.col("id") % 11 == 0, "train").otherwise("belt").alias("kind"), F.lit("").alias("label"), F.lit("int").alias("type"), F.col("id").alias("seq"))
    f = spark.createDataFrame([(f"f{i}", f"f{i}", f"p{i % 2}", i) for i in range(4)], "id string, name string, package string, seq bigint")
    view = V.project_view(f, n, e, V.ViewOptions())
    assert view.mode == "packages" and view.nodes.count() == 2
    assert view.edges.agg(F.sum("n")).first()[0] == 1299
    assert V.project_view(f, n, e, V.ViewOptions(pkg="p1")).nodes.count() == 2
    focused = V.project_view(f, n, e, V.ViewOptions(fn="f1", part=2))
    assert focused.mode == "operations" and focused.section == 2 and focused.operations == 325


def test_view_keys_ignore_what_is_on(spark):
    df = spark.createDataFrame([
        (1, "f", None, None, None, "", {"train": False, "belt": True}), (2, "f", "", 0, True, None, {"train": False}), (3, "f", "", 1, True, "", {})],
        "i int, fn string, pkg string, part int, compact boolean, query string, layers map<string,boolean>")
    keys = {r.i: r.k for r in P.normalize_view(df).select("i", P.view_key().alias("k")).collect()}
    assert keys[1] == keys[2] != keys[3]
    bad = spark.createDataFrame([("f", "", -2, True, "", {})], "fn string, pkg string, part int, compact boolean, query string, layers map<string,boolean>")
    assert P.normalize_view(bad).first().part == -2  # validate_snapshot reports it


def test_ended_links_of_a_hub_are_neither_written_nor_kept_as_states(spark, make_nodes, make_edges, monkeypatch):
    from flowweft.operators import views as V

    written, write = [], V.write_table

    def counted(df):
        table, n = write(df)
        written.append(n)
        return table, n

    monkeypatch.setattr(V, "write_table", counted)
    nodes = make_nodes([{"id": "h", "helper": True}, *[f"a{i}" for i in range(20)], *[f"b{i}" for i in range(20)]])
    edges = make_edges([(f"a{i}", "h") for i in range(20)] + [("h", f"b{i}") for i in range(20)])
    assert V.visible_graph(nodes, edges)[1].count() == 400
    assert sum(written) == 20  # the paths into the helper, not the 400 that leave it


def test_links_around_a_function_fold_as_links_that_meet_the_nodes(spark, make_nodes, make_edges):
    from flowweft.operators import selection as P
    from flowweft.operators import views as V

    rows = [
        {"id": "a", "function": "f"}, {"id": "h", "function": "f", "helper": True}, {"id": "x", "function": "g"}, {"id": "y", "function": "k"},
        {"id": "y", "function": "k"}, {"id": "z", "function": "k"}, {"id": "x", "function": "f"},
    ]
    nodes, edges = make_nodes(rows), make_edges([("a", "h"), ("h", "x"), ("h", "y"), ("x", "y"), ("y", "z")])
    functions = spark.createDataFrame([("f", "f"), ("g", "g"), ("k", "k")], "id string, name string")
    shown, links = V.visible_graph(nodes, edges, around="f")
    plain = links.drop("src_at", "dst_at")
    near, kept = P.focus_function(shown, links, "f", focused=True)
    far, joined = P.focus_function(shown, plain, "f")
    sort = lambda df: sorted(map(str, df.collect()))
    assert sort(near) == sort(far) and sort(kept.select(plain.columns)) == sort(joined.select(plain.columns))
    with_homes, by_joins = V.fold_portals(nodes, functions, near, kept, "f"), V.fold_portals(nodes, functions, far, joined, "f")
    assert sort(with_homes[0]) == sort(by_joins[0]) and sort(with_homes[1]) == sort(by_joins[1])
    assert with_homes[1].count() > 1
