import random

import pytest
from pyspark.sql import functions as F

from flowweft.operators import aggregate as A
from flowweft.operators import closure as C
from flowweft.operators import hierarchy as H
from flowweft.operators import hubs as U


def test_trace_has_no_sibling_branches(spark, make_edges):
    edges = make_edges([("a", "b"), ("b", "c"), ("c", "e"), ("e", "c"), ("a", "d")])
    seeds = spark.createDataFrame([("b",)], "id string")
    assert {r.id for r in C.trace(edges, seeds).collect()} == {"a", "b", "c", "e"}
    with pytest.raises(RuntimeError):
        C.trace(edges, seeds, max_rounds=1)


def closure_of(pairs, seeds):
    """Names that pairs lead to from the seeds, by going from one to the next."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    seen, todo = set(seeds), list(seeds)
    while todo:
        for b in out.get(todo.pop(), []):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", range(2))
def test_trace_of_deep_graphs(spark, make_edges, seed):
    """Long ladders, rings and side branches, beyond the rounds of plain hops; ids may hold the marks used inside."""
    rng = random.Random(seed)
    pairs = [(f"down:{i}", f"down:{i + rng.choice([1, 1, 1, 2, 3, -1])}") for i in range(90) for _ in range(2)]
    pairs += [(f"down:{rng.randrange(90)}", f"side{i}") for i in range(30)] + [(f"side{i}", f"side{i + 1}") for i in range(0, 28, 2)]
    pairs += [(f"ring{i}", f"ring{(i + 1) % 20}") for i in range(20)] + [("ring3", "down:40"), ("down:60", "deep0"), ("", "ring0")]
    pairs += [(f"deep{i}", f"deep{i + 1}") for i in range(50)] + [("deep50", "deep25")]
    seeds = ["down:3", "side5", "nowhere"]
    got = {r.id for r in C.trace(make_edges(pairs), spark.createDataFrame([(s,) for s in seeds], "id string")).collect()}
    assert got == closure_of(pairs, seeds) | closure_of([(b, a) for a, b in pairs], seeds)


@pytest.mark.parametrize("shape", ["chain", "ring"])
def test_long_paths_take_few_rounds(spark, shape):
    n = 10_000
    ids = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    edges = ids if shape == "chain" else ids.withColumn("dst", F.col("dst") % n)
    traced = C.trace(edges, spark.createDataFrame([(n // 2,)], "id long"), max_rounds=11)
    assert traced.count() == n + (shape == "chain") and dict(traced.dtypes) == {"id": "bigint"}


def test_links_stay_in_place_during_levels(spark):
    """A round's plan moves the frontier, never the links; hubs have several buckets."""
    pairs = spark.createDataFrame([("hub", f"leaf{i}") for i in range(300)] + [("leaf7", "x"), ("x", "y"), ("y", None)], "src string, dst string")
    seen, real = [], C._hop
    C._hop = lambda *a: seen.append(real(*a)) or seen[-1]
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        levels = {r.id: r.level for r in C.bfs_levels(pairs, spark.createDataFrame([("y",)], "id string"), hub_links=40).collect()}
        plan = seen[1]._jdf.queryExecution().executedPlan().toString()
    finally:
        C._hop = real
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert levels == {"y": 0, "x": 1, "leaf7": 2, "hub": 3, **{f"leaf{i}": 4 for i in range(300) if i != 7}}
    assert "Bucketed: true" in plan
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    scan_depth = lines[at].index("FileScan")
    above = next(line for line in reversed(lines[:at]) if "SortMergeJoin" in line or "Exchange" in line)
    assert "SortMergeJoin" in above and scan_depth > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_levels(spark, make_nodes, make_edges, seed):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(60)]
    pairs = [(rng.choice(ids[:40]), rng.choice(ids[:40])) for _ in range(30)] + [(f"n{i}", f"n{i + 1}") for i in range(40, 58)]
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.id: r.component for r in C.components(make_nodes(ids), make_edges(pairs)).collect()}
    assert got == label
    levels = {r.id: r.level for r in C.bfs_levels(make_edges(pairs), spark.createDataFrame([("n40",)], "id string")).collect()}
    assert levels == {f"n{i}": i - 40 for i in range(40, 59)}


def test_contact_weights(spark, make_nodes):
    edges = spark.createDataFrame(
        [("a", "b", None), ("b", "a", None), ("a", "b", 7.0), ("a", "a", 3.0), ("b", "c", -1.0), ("c", "gone", 5.0)], "src string, dst string, count double")
    contact = A.contact_graph(make_nodes(["a", "b", "c", "alone"]), edges)
    assert {(r.id, r.other): r.weight for r in contact.collect()} == {("a", "b"): 9, ("b", "a"): 9, ("b", "c"): 1, ("c", "b"): 1}
    strength = {r.id: (r.degree, round(r.strength, 6)) for r in A.node_strength(make_nodes(["a", "b", "c", "alone"]), contact).collect()}
    assert strength == {"a": (1, 4.169925), "b": (2, 5.169925), "c": (1, 1.0), "alone": (0, 0.0)}


def test_size_limits(spark, make_nodes, make_edges):
    nodes, edges = make_nodes(["a", "b"]), make_edges([("a", "b")])
    assert A.size_limits(nodes, edges, 2, 1).count() == 2
    with pytest.raises(A.SizeLimitError):
        A.size_limits(nodes, edges, 1)
    with pytest.raises(ValueError):
        A.size_limits(nodes, edges, -1)


def test_groups_are_components(spark, make_nodes, make_edges):
    k4 = [(f"k{i}", f"k{j}") for i in range(4) for j in range(i)]
    edges = make_edges([("p", "q"), ("q", "r"), ("t0", "t1"), ("t1", "t2"), ("t2", "t0"), *k4])
    nodes = make_nodes(["p", "q", "r", "t0", "t1", "t2", "k0", "k1", "k2", "k3", "alone"])
    h = H.contract_groups(nodes, edges)
    assert sorted(r["count"] for r in h.groups.groupBy("group_id").count().collect()) == [1, 3, 3, 4]
    assert h.group_edges.count() == edges.count()
    first = {r.group: r.degree for r in h.merges.filter("group LIKE 'block:%'").collect()}
    assert first["block:p"] == 1 and first["block:t0"] == 2 and first["block:k1"] == 3 and "block:alone" not in first
    assert H.validate_hierarchy(nodes, edges, h).count() == 0
    worse = H.Hierarchy(h.merges.withColumn("degree", h.merges.degree + 1), h.merge_edges, h.groups, h.group_edges)
    assert {r.rule for r in H.validate_hierarchy(nodes, edges, worse).collect()} == {"degree"}


def test_a_chain_of_rising_degrees_takes_few_rounds(spark):
    """10,000 nodes, each with one more parallel link to the next than to the one before (as far as 60)."""
    n = 10_000
    nodes = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"))
    many = F.explode(F.sequence(F.lit(0), F.least(F.lit(60), F.col("id") % 61)))
    edges = spark.range(n - 1).select("id", many.alias("k")).select(
        F.concat_ws("-", "id", "k").alias("id"), F.concat(F.lit("n"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") + 1).alias("dst"))
    h = H.contract_groups(nodes, edges)
    assert h.merges.agg(F.max("round")).first()[0] < 40
    assert h.groups.select("group_id").distinct().count() == 1 and h.group_edges.count() == edges.count() == h.merge_edges.count()


def replayed(nodes, edges, merges, merge_edges):
    """Degrees and inner links as the rounds give them, one after the other."""
    at = {f"block:{n}": f"block:{n}" for n in nodes}
    bad = set()
    for r in sorted({m.round for m in merges}):
        now = [m for m in merges if m.round == r]
        for m in now:
            n = sum((at[f"block:{a}"] == m.group) != (at[f"block:{b}"] == m.group) for _, a, b in edges)
            if n != m.degree:
                bad.add(("degree", m.group))
        apart = [e for e in edges if at[f"block:{e[1]}"] != at[f"block:{e[2]}"]]
        to = {m.group: m.parent for m in now}
        at = {k: to.get(v, v) for k, v in at.items()}
        want = {(at[f"block:{e[1]}"], e[0]) for e in apart if at[f"block:{e[1]}"] == at[f"block:{e[2]}"]}
        bad |= {("merge_edges", e) for _, e in want ^ {(m.parent, m.edge_id) for m in merge_edges if m.round == r}}
    return bad | {("open_edge", e) for e, a, b in edges if at[f"block:{a}"] != at[f"block:{b}"]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hierarchies_as_by_replay(spark, make_nodes, make_edges, seed):
    """Also deep ones, two groups at a time, with wrong degrees, lost inner links and links that stay open."""
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(30)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(45)]
    nodes, edges = make_nodes(ids), make_edges(pairs)
    linked = [(f"e{i}", a, b) for i, (a, b) in enumerate(pairs) if a != b]
    rows, inner, r = [], [], 0
    at = {i: f"block:{i}" for i in ids}
    for e, a, b in rng.sample(linked, len(linked) - 2):
        x, y = at[a], at[b]
        if x != y:
            for g, o in ((x, y), (y, x)):
                n = sum((at[c] == g) != (at[d] == g) for _, c, d in linked)
                rows.append((r, g, o, f"group:{r}", n + (rng.random() < 0.1)))
            apart = [k for k, c, d in linked if {at[c], at[d]} == {x, y}]
            inner += [(r, f"group:{r}", k) for k in apart if rng.random() < 0.9]
            at = {i: f"group:{r}" if g in (x, y) else g for i, g in at.items()}
            r += 1
    members = spark.createDataFrame([(g, i) for i, g in at.items()], "group_id string, node_id string")
    stored = H.Hierarchy(
        spark.createDataFrame(rows, "round int, group string, partner string, parent string, degree long"),
        spark.createDataFrame(inner, "round int, parent string, edge_id string"), members, H.internal_edges(members, edges))
    got = {(v.rule, v.key) for v in H.validate_hierarchy(nodes, edges, stored).collect()}
    assert got == replayed(ids, linked, stored.merges.collect(), stored.merge_edges.collect())


def test_hierarchies_that_are_no_forest(spark, make_nodes, make_edges):
    nodes, edges = make_nodes(["a", "b", "c", "d"]), make_edges([("a", "b")])
    rows = [
        (0, "block:a", None, "group:x", 1), (2, "block:b", None, "group:x", 1), (1, "group:x", None, "top", 0), (5, "block:a", None, "other", 9),
        (0, "block:c", None, "loop", 0), (1, "loop", None, "block:c", 0),
    ]
    stored = H.Hierarchy(
        spark.createDataFrame(rows, "round int, group string, partner string, parent string, degree long"),
        spark.createDataFrame([(2, "group:x", "e0")], "round int, parent string, edge_id string"),
        spark.createDataFrame([("top", "a"), ("top", "b"), ("block:c", "c"), ("block:d", "d")], "group_id string, node_id string"),
        spark.createDataFrame([("top", "e0")], "group_id string, edge_id string"))
    got = sorted((v.rule, v.key) for v in H.validate_hierarchy(nodes, edges, stored).collect())
    # a group that merges without any link to others is told by its degree, which a merge cannot have as 0
    assert got == [("degree", "group:x"), ("merged_twice", "block:a"), ("order", "group:x"), ("ring", "block:c"), ("ring", "loop")]


def test_rings_end_the_doubling_when_only_they_are_left(spark):
    """As many lifts as the deepest chain needs, whatever the number of groups in and below rings."""
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)]
    rings = [pair for i in range(200) for pair in ((f"x{i}", f"y{i}"), (f"y{i}", f"x{i}"), (f"below{i}", f"x{i}"))]
    merges = spark.createDataFrame([(0, g, p) for g, p in chain + rings], "round int, group string, parent string")
    forest = H.Forest(merges)
    assert len(forest.lifts) == 4
    assert {(r.group, r.top, r.depth) for r in forest.roots.collect()} == {(f"c{i}", "c9", 9 - i) for i in range(9)}
    assert sorted(r.group for r in forest.rings.collect()) == sorted(g for g, _ in rings)
    assert len(H.Forest(merges.filter("NOT startswith(group, 'c')")).lifts) == 0


def test_names_of_groups_do_not_grow_with_the_rounds(spark, make_nodes, make_edges):
    ids = [f"n{i}" for i in range(40)]
    h = H.contract_groups(make_nodes(ids), make_edges(list(zip(ids, ids[1:], strict=False))))
    merges = h.merges.collect()
    assert max(m.round for m in merges) > 1
    assert all(m.parent in {f"group:{m.round}:{i}" for i in ids} for m in merges)
    made = {m.parent for m in merges}
    assert all(g in made or g in {f"block:{i}" for i in ids} for m in merges for g in (m.group, m.partner) if g)
    assert {r.group_id for r in h.groups.collect()} == made - {m.group for m in merges}


def test_parallel_links_count_each(spark, make_nodes, make_edges):
    h = H.contract_groups(make_nodes(["a", "b"]), make_edges([("a", "b"), ("b", "a"), ("a", "a")]))
    assert {r.degree for r in h.merges.collect()} == {2}
    assert {r.edge_id for r in h.group_edges.collect()} == {"e0", "e1", "e2"}
    assert h.merges.select("parent").distinct().count() == 1


def tree(n, num=0, lo=0):
    """(number, low, size) of every junction over n leaves, in pre-order."""
    if n < 2:
        return []
    half = -(-n // 2)
    out = [(num, lo, n)]
    if n > 2:
        first = tree(half, num + 1, lo)
        out += first + tree(n - half, num + 1 + len(first), lo + half)
    return out


@pytest.mark.parametrize("n", [2, 3, 5, 8, 13])
def test_junction_trees(spark, make_nodes, make_edges, n):
    nodes = make_nodes([{"id": "hub", "kind": "trash" if n < 5 else "machine"}, *[f"s{i}" for i in range(n)]])
    edges = make_edges([(f"s{i}", "hub", "belt", f"T{i}", "") for i in range(n)]).withColumn("types", A.edge_types())
    shown, links = U.split_hubs(nodes, edges)
    rows = links.collect()
    junctions = {r.id for r in shown.filter("role = 'junction'").collect()}
    assert junctions == {f"junction:hub:in:{i}" for i in range(n - 1)}
    carried = {r.src: set(r.types) for r in rows if r.id.startswith("link:")}
    assert carried == {f"junction:hub:in:{k}": {f"T{i}" for i in range(lo, lo + size)} for k, lo, size in tree(n)}
    degree = {}
    for r in rows:
        for end in (r.src, r.dst):
            degree[end] = degree.get(end, 0) + 1
    assert all(degree[j] == 3 for j in junctions) and degree["hub"] == 1
    up = {r.src: r.dst for r in rows}
    for i in range(n):
        at = f"s{i}"
        while at != "hub":
            at = up[at]


def test_descent_to_a_leaf_names_the_junctions_of_the_halving_tree(spark):
    from pyspark.sql import functions as F

    from flowweft.operators.hubs import _descent

    def paths(size, num=0):
        """Per leaf the junctions above it, by building the tree."""
        if size < 2:
            return [[]]
        half = -(-size // 2)
        return [[num, *p] for p in paths(half, num + 1)] + [[num, *p] for p in paths(size - half, num + half)]

    rows = [(n, i) for n in (1, 2, 3, 5, 8, 13, 100) for i in range(n)]
    got = spark.createDataFrame(rows, "n long, leaf long").select("n", "leaf", _descent(F.col("n"), F.col("leaf")).alias("path")).collect()
    assert {(r.n, r.leaf): r.path for r in got} == {(n, i): p for n in {n for n, _ in rows} for i, p in enumerate(paths(n))}


def test_a_closure_leaves_its_links_where_they_are(spark):
    """The links are written by the node they leave, those of hubs in several buckets, and do not move in a round."""
    rows = [("down", f"n{i % 50}", f"m{i}") for i in range(400)] + [("down", "hub", f"h{i}") for i in range(30)]
    links = spark.createDataFrame(rows, "dir string, a string, b string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hub_links, hubs in ((1_000, False), (10, True)):
            adjacency, fans, name = C._at_origin(links, ["dir", "a"], hub_links)
            assert (fans is not None) == hubs and {tuple(r) for r in adjacency.select("dir", "a", "b").collect()} == set(rows)
            ends = C._spread(spark.createDataFrame([("down", "hub"), ("down", "n7")], "dir string, a string"), fans, ["dir", "a"])
            step = adjacency.join(ends, adjacency.columns[:-1], "left_semi")
            assert {r.b for r in step.collect()} == {b for _, a, b in rows if a in ("hub", "n7")}
            scan = step._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "Bucketed: true" in scan
            C.drop_table(spark, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
