"""Factored function graphs and the text index, against the forms that list or scan everything."""

import math

import pytest
from pyspark.sql import functions as F

from flowweft.operators import aggregate as A
from flowweft.operators import selection as P


def _hub_graph(spark):
    """Hub h: eight equal functions write and read; one only writes. Hub k joins two of them again; direct links beside."""
    ops, links = [], []
    for i in range(8):
        ops.append((f"n{i}", f"f{i}", None))
        links += [(f"n{i}", "h"), ("h", f"n{i}")]
    ops += [("n8", "f8", None), ("n9", "f9", None), ("x", "f0", None), ("h", "", "hub"), ("k", "", "hub")]
    links += [("n8", "h"), ("n0", "k"), ("x", "k"), ("k", "n1"), ("n0", "n1"), ("n1", "n0"), ("n9", "n0"), ("n2", "x"), ("n9", "n9")]
    nodes = spark.createDataFrame(ops, "id string, function string, role string")
    return nodes, spark.createDataFrame(links, "src string, dst string")


def test_strength_of_the_factored_form_is_that_of_the_pairs(spark):
    nodes, edges = _hub_graph(spark)
    functions = nodes.filter("function <> ''").select(F.col("function").alias("id")).distinct()
    want = {r.id: (r.degree, r.strength) for r in A.node_strength(functions, A.function_graph(nodes, edges)).collect()}
    classes = A.function_classes(nodes, edges)
    got = {r.id: (r.degree, r.strength) for r in A.class_strength(functions, classes).collect()}
    assert got.keys() == want.keys() and want["f9"][0] == 1
    for f, (degree, strength) in want.items():
        assert got[f][0] == degree and math.isclose(got[f][1], strength, rel_tol=1e-9)
    # f2 to f7 share a group; sides grow with groups and hubs, not with pairs.
    groups = {r.id: r.group for r in classes.members.collect()}
    assert len({groups[f"f{i}"] for i in range(2, 8)}) == 1 and len(set(groups.values())) == 4
    assert classes.sides.count() == 6


def test_a_hub_of_many_functions_stays_linear(spark):
    n = 20_000
    ids = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"), F.concat(F.lit("f"), "id").alias("function"), F.lit(None).cast("string").alias("role"))
    nodes = ids.unionByName(spark.createDataFrame([("h", "", "hub")], ids.schema))
    into = ids.select(F.col("id").alias("src"), F.lit("h").alias("dst"))
    classes = A.function_classes(nodes, into.unionByName(into.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    assert classes.sides.count() == 1 and classes.direct.isEmpty()
    strength = A.class_strength(ids.select(F.col("function").alias("id")), classes)
    assert {(r.degree, r.strength) for r in strength.select("degree", "strength").distinct().collect()} == {(n - 1, 2.0 * (n - 1))}


def test_without_hubs_only_direct_links_count(spark):
    nodes = spark.createDataFrame([("a", "f"), ("b", "g"), ("c", "h")], "id string, function string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    functions = nodes.select(F.col("function").alias("id"))
    got = {r.id: (r.degree, r.strength) for r in A.class_strength(functions, A.function_classes(nodes, edges)).collect()}
    assert got == {"f": (1, 2.0), "g": (1, 2.0), "h": (0, 0.0)}


@pytest.fixture(scope="module")
def indexed(spark, make_nodes, tmp_path_factory):
    nodes = make_nodes([
        {"id": "a", "label": "Канал · Queue"}, {"id": "b", "label": "ab", "function": "", "type": ""}, {"id": "c", "label": "", "names": ["queue", "Straße"]},
        {"id": "d", "label": "que", "type": "ue"}, {"id": "e", "label": "aaaa%_'\\"}, {"id": "g", "label": "🚂🚃🚋", "function": "x"},
        {"id": "q", "label": "queueing " * 50},
    ])
    path = str(tmp_path_factory.mktemp("index") / "text")
    P.write_text_index(nodes, path)
    return nodes, P.read_text_index(spark, path)


def test_indexed_search_equals_the_scan(indexed):
    nodes, postings = indexed
    for text in ("queue", " QUEUE ", "анал ·", "ab", "a", "straße", "aaaa", "%_'\\", "🚂🚃🚋", "🚃🚋", "queue queue", "missing", "e queue", "ueing"):
        want = {r.id for r in P.matching(nodes, text).collect()}
        assert {r.id for r in P.indexed_matching(nodes, postings, text).collect()} == want, text
    assert {r.id for r in P.indexed_matching(nodes, postings, "queue").collect()} == {"a", "c", "q"}


def test_index_reads_the_folders_of_its_grams(indexed, make_edges):
    nodes, postings = indexed
    assert postings.groupBy("gram", "id").count().filter("count > 1").isEmpty()
    plan = P.indexed_matching(nodes, postings, "queue")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(gram" in plan
    edges = make_edges([("b", "a"), ("d", "e")])
    got = {r.id for r in P.search_indexed(nodes, edges, postings, "Канал").collect()}
    assert got == {"a", "b"} == {r.id for r in P.search_nodes(nodes, edges, "Канал").collect()}
    assert P.search_indexed(nodes, edges, postings, "  ").count() == nodes.count()
