import csv
import glob
import io
import json

import pytest
from pyspark.sql import functions as F

from flowweft.operators import validate as V
from flowweft.operators.aggregate import SizeLimitError
from flowweft.operators.selection import graph_diff, normalize_view
from flowweft.sources import csv_export as C
from flowweft.sources import documents as D
from flowweft.sources import text_files as X

GRAPH = {
    "version": 1, "revision": "r1", "mode": "static-ssa", "projects": [{"path": "/src", "module": "m"}],
    "functions": [{"id": "m.F", "name": "F", "package": "m", "project": "m", "source": {"file": "f1", "line": 2}}],
    "nodes": [
        {"id": "n1", "kind": "source", "label": '=x "y"', "function": "m.F", "package": "m", "order": -1, "names": ["x", "y"], "source": {"file": "f1", "line": 3}},
        {"id": "n2", "kind": "output", "label": "цех\nдва", "function": "m.F", "package": "m", "helper": True, "source": {"file": "f1", "line": 4}},
    ],
    "edges": [{"id": "e1", "from": "n1", "to": "n2", "kind": "belt", "label": "l", "type": "byte"}],
    "warnings": [], "files": {"f1": "/src/a.go"},
}
FORMAT = "flow-snapshot"


def snapshot(**changes):
    doc = {"format": FORMAT, "version": 1, "graph": GRAPH, "sources": {"f1": "text"}, "layouts": [{"view": {"fn": "m.F"}, "nodes": [], "edges": []}],
           "view": {"fn": "m.F"}, "camera": {"x": 0, "y": 0, "zoom": 1}, "selected": "", "tracing": False, "time": 0, "speed": 2, "playing": True}
    doc.update(changes)
    return doc


def test_graph_documents(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(GRAPH, indent=1))
    t = D.read_graph(spark, str(tmp_path / "g.json"))
    nodes = t["nodes"].orderBy("seq").collect()
    assert [(n.id, n.ord, n.helper, n.names, n.type, n.source.line, n.seq) for n in nodes] == [
        ("n1", -1.0, False, ["x", "y"], "", 3, 0), ("n2", 0.0, True, [], "", 4, 1)]
    assert t["edges"].first().src == "n1" and t["files"].first().path == "/src/a.go"
    assert V.validate_graph(t).count() == 0
    D.write_graph({"nodes": t["nodes"]}, str(tmp_path / "out"))
    from flowweft.schema import NODES

    back = D.read_tables(spark, str(tmp_path / "out"), {"nodes": NODES})["nodes"]
    assert graph_diff(back.select(t["nodes"].columns), t["nodes"]).count() == 0


@pytest.mark.parametrize("change,rule", [
    ({}, None), ({"format": "x"}, "format"), ({"version": 2}, "format"), ({"view": {"fn": "gone"}}, "fn"), ({"view": {"pkg": "gone"}}, "pkg"),
    ({"sources": {"f9": "t"}}, "source"), ({"speed": 3}, "playback"), ({"time": -1}, "playback"), ({"camera": {"x": 0, "y": 0, "zoom": 9}}, "camera"),
    ({"view": {"part": -2}}, "part"), ({"layouts": [{"view": {"part": -3}}]}, "part"), ({"view": {"layers": {"belt": "no"}}}, "document"), ({"playing": "yes"}, "document"),
    ({"layouts": [{"view": {}}, {"view": {"part": 0}}]}, "layout_key"), ({"layouts": [{"view": {"fn": "gone"}}]}, "fn"),
])
def test_snapshot_mutations_are_reported(spark, tmp_path, change, rule):
    (tmp_path / "s.json").write_text("﻿" + json.dumps(snapshot(**change)), encoding="utf-8")
    t = D.read_snapshot(spark, str(tmp_path / "s.json"))
    layouts = normalize_view(t["layouts"].select("rev", "view.*"))
    views = t["snapshots"].withColumn("part", F.col("view.part"))
    found = V.validate_snapshot(views, layouts, t["functions"], t["sources"], t["files"], FORMAT)
    assert {r.rule for r in found.collect()} == ({rule} if rule else set())


def test_damaged_graphs_are_reported(spark, tmp_path):
    broken = {k: v for k, v in GRAPH.items() if k != "edges"} | {"revision": "lists"}
    typed = json.loads(json.dumps(GRAPH)) | {"revision": "types"}
    typed["nodes"][0]["source"]["line"] = "1"
    texts = [json.dumps(GRAPH), json.dumps(broken), json.dumps(typed), json.dumps(GRAPH)[:60], "{"]
    (tmp_path / "g.json").write_text("\n".join(texts))
    t = D.read_graph(spark, str(tmp_path / "g.json"), multi_line=False)
    found = V.validate_graph({k: t[k] for k in ("snapshots", "nodes", "edges", "functions")}).collect()
    assert sum(r.rule == "document" for r in found) == 3 and ("missing_list", "lists:edges") in {(r.rule, r.key) for r in found}
    assert not {r.rule for r in found} & {"repeated_id", "src", "dst"}


def test_revisions_are_checked_and_kept_apart(spark, tmp_path):
    nodes = spark.createDataFrame([("r1", "a", "machine", ""), ("r2", "a", "machine", ""), ("r2", "b", "machine", ""), ("", "a", "machine", "")], "rev string, id string, kind string, function string")
    functions = spark.createDataFrame([("r1", ""), ("r2", ""), ("", "")], "rev string, id string")
    edges = spark.createDataFrame([("r1", "e", "a", "b"), ("r2", "e", "a", "b")], "rev string, id string, src string, dst string")
    found = V.validate_graph({"nodes": nodes, "edges": edges, "functions": functions}).collect()
    assert {(r.rule, r.key) for r in found} == {("empty_id", ""), ("dst", "e")} and len(found) == 4
    path = str(tmp_path / "all")
    for rev in ("r1", "r2", ""):
        D.write_graph({"nodes": nodes.filter(F.col("rev") == rev)}, path)
    D.write_graph({"nodes": nodes.filter("rev = 'r1'")}, path)
    back = D.read_tables(spark, path, {"nodes": "rev string, id string, kind string, function string"})["nodes"]
    assert graph_diff(back, nodes).count() == 0


def test_layouts_are_matched_one_by_one(spark):
    at = "layout_id string, id string, x double, y double"
    nodes = spark.createDataFrame([("l1", "a", 16.0, 16.0), ("l2", "a", 16.0, 16.0), ("l2", "b", 16.0, 48.0)], at)
    none = spark.createDataFrame([], "layout_id string, edge_id string, start_dir int, end_dir int")
    cells = spark.createDataFrame([], "layout_id string, edge_id string, pos int, x int, y int, layer int")
    want = spark.createDataFrame([("l1", "a"), ("l1", "b"), ("l2", "a")], "layout_id string, id string")
    found = V.match_layout(nodes, none, cells, want, want.filter("false")).collect()
    assert {(r.rule, r.key) for r in found} == {("absent", "b"), ("unexpected", "b")}


def test_a_large_source_keeps_its_text(spark, tmp_path):
    (tmp_path / "big.txt").write_text("é" * 1_700_000)
    (tmp_path / "small.txt").write_text("x")
    sizes = {r.path.rpartition("/")[2]: len(r.content or "") for r in X.read_sources(spark, str(tmp_path)).collect()}
    assert sizes == {"big.txt": 1_700_000, "small.txt": 1}


def test_bare_graph_is_a_snapshot(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(GRAPH))
    t = D.read_snapshot(spark, str(tmp_path / "g.json"))
    assert t["snapshots"].first().format is None and t["nodes"].count() == 2 and t["sources"].count() == 0


def test_snapshots_are_parsed_once(spark, tmp_path):
    (tmp_path / "s.json").write_text("\n".join([json.dumps(snapshot()), json.dumps(GRAPH), "{"]))
    t = D.read_snapshot(spark, str(tmp_path / "s.json"), one_per_file=False)
    for name, df in t.items():
        assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString(), name
    assert t["snapshots"].filter("corrupt").count() == 1 and t["nodes"].count() == 4


def test_graph_violations(spark, make_nodes, make_edges):
    nodes = make_nodes([{"id": "a", "kind": "what"}, {"id": "b", "function": "gone"}, "c", "c", {"id": "d", "ord": float("nan")}])
    functions = spark.createDataFrame([("f", "F", "p")], "id string, name string, package string")
    found = V.validate_graph({"nodes": nodes, "edges": make_edges([("a", "zz"), ("b", "c")]), "functions": functions})
    assert {(r.rule, r.key) for r in found.collect()} == {("kind", "a"), ("function", "b"), ("repeated_id", "c"), ("order", "d"), ("dst", "e0")}


@pytest.mark.parametrize("delimiter", [",", ";"])
def test_csv_reads_back(spark, tmp_path, delimiter):
    (tmp_path / "g.json").write_text(json.dumps(GRAPH))
    t = D.read_graph(spark, str(tmp_path / "g.json"))
    nodes = t["nodes"].withColumns({"x": F.lit(-16.0), "y": F.lit(1.5), "w": F.lit(96), "h": F.lit(96), "tile_size": F.lit(3)})
    C.export_csv(nodes, t["edges"], t["files"], str(tmp_path / "csv"), delimiter)
    text = "".join(open(p, encoding="utf-8", newline="").read() for p in sorted(glob.glob(str(tmp_path / "csv" / "part-*"))))
    assert text.startswith("﻿record") and text.endswith("\r\n")
    rows = list(csv.DictReader(io.StringIO(text[1:], newline=""), delimiter=delimiter))
    assert [r["record"] for r in rows] == ["node", "node", "edge"] and len(rows[0]) == 30
    assert rows[0]["label"] == '\'=x "y"' and rows[1]["label"] == "цех\nдва" and rows[0]["x"] == "-16" and rows[0]["y"] == "1.5"
    assert rows[0]["names"] == '["x","y"]' and rows[0]["source_file"] == "/src/a.go" and rows[0]["color"].startswith("hsl(")
    assert rows[2]["cargo_types"] == '["uint8"]' and rows[2]["original_edges"] == '["e1"]' and rows[2]["cargo_shapes"] == '["square"]'
    with pytest.raises(ValueError):
        C.csv_lines(nodes, t["edges"], t["files"], "|")


def test_saved_state_is_replaced_by_key(spark, tmp_path):
    a, b = spark.range(3), spark.range(5)
    D.save_snapshot({"n": a}, str(tmp_path / "s"), "one")
    D.save_snapshot({"n": a}, str(tmp_path / "s"), "two")
    D.save_snapshot({"n": b}, str(tmp_path / "s"), "one")
    assert D.load_snapshot(spark, str(tmp_path / "s"), "one")["n"].count() == 5
    assert D.load_snapshot(spark, str(tmp_path / "s"), "two")["n"].count() == 3
    with pytest.raises(KeyError):
        D.load_snapshot(spark, str(tmp_path / "s"), "three")


def test_two_writers_of_a_state_get_two_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    state = lambda n: {"n": spark.range(n)}
    count = lambda version=None: D.load_snapshot(spark, path, "a/b=c", version)["n"].count()
    assert D.snapshot_version(spark, path, "a/b=c") == 0
    assert D.save_snapshot(state(1), path, "a/b=c", after=0) == 1
    # Both writers read version 1; the first to commit wins, the other reads again and retries.
    assert D.save_snapshot(state(2), path, "a/b=c", after=1) == 2
    with pytest.raises(D.SnapshotConflict):
        D.save_snapshot(state(3), path, "a/b=c", after=1)
    assert count() == 2
    assert D.save_snapshot(state(3), path, "a/b=c", after=D.snapshot_version(spark, path, "a/b=c")) == 3
    assert (count(), count(1), count(2)) == (3, 1, 2)
    # The number is taken between a writer's look at the log and its commit.
    assert not D._commit(spark, path, "a/b=c", 3, {}) and count() == 3
    with pytest.raises(KeyError):
        count(9)


def test_a_writer_that_meets_a_taken_number(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    assert D.save_snapshot({"n": spark.range(1)}, path, "k") == 1
    monkeypatch.setattr(D, "snapshot_version", lambda *a: 0)  # as if the other had not committed yet
    with pytest.raises(D.SnapshotConflict):
        D.save_snapshot({"n": spark.range(2)}, path, "k", after=0)
    assert D.save_snapshot({"n": spark.range(3)}, path, "k") == 2
    assert D.load_snapshot(spark, path, "k")["n"].count() == 3


def test_an_unfinished_commit_is_not_seen_and_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "s")
    for key, n in (("a", 1), ("a", 2), ("b", 3)):
        D.save_snapshot({"n": spark.range(n)}, path, key)
    (tmp_path / "s" / "log" / "key=a" / f"{3:012d}").write_text('{"version": "x", "tab')
    assert D.load_snapshot(spark, path, "a")["n"].count() == 2 and D.save_snapshot({"n": spark.range(4)}, path, "a") == 4
    spark.range(1).write.parquet(f"{path}/data/lost/n")  # of a writer that never committed
    assert D.clean_snapshots(spark, path) == 0, "too young"
    assert D.clean_snapshots(spark, path, older_than=-60) == 3
    assert D.load_snapshot(spark, path, "a")["n"].count() == 4 and D.load_snapshot(spark, path, "b")["n"].count() == 3
    with pytest.raises(KeyError):
        D.load_snapshot(spark, path, "a", 1)
    with pytest.raises(ValueError):
        D.clean_snapshots(spark, path, keep=0)


def test_written_files_follow_the_rows(spark, tmp_path):
    rows = spark.range(400).selectExpr("CASE WHEN id < 300 THEN 'big' WHEN id < 390 THEN 'small' END AS rev", "CAST(id AS STRING) AS id")
    files = lambda name, rev: len(list((tmp_path / name / "nodes" / f"rev={rev}").glob("*.json")))
    D.write_graph({"nodes": rows}, str(tmp_path / "many"), rows_per_file=30)
    D.write_graph({"nodes": rows}, str(tmp_path / "one"))
    assert files("many", "big") > files("many", "small") >= 1 and files("one", "big") == 1
    for name in ("many", "one"):
        back = D.read_tables(spark, str(tmp_path / name), {"nodes": "rev string, id string"})["nodes"]
        assert back.count() == 400 and back.filter("rev = 'big'").count() == 300


def test_manifests(spark):
    def files(*rows):
        return spark.createDataFrame(rows, "path string, content string")

    modules, top = X.module_manifest(files(("/b", "module z.com/b\n\ngo 1.21\n"), ("/a", "// x\nmodule a.com/a // c\ngo 1.9.7\n"), ("/b", "module z.com/b\n\ngo 1.21\n")))
    assert [(r.path, r.module) for r in modules.collect()] == [("/a", "a.com/a"), ("/b", "z.com/b")]
    assert tuple(top.first()) == (1, 21, 0)
    assert tuple(X.module_manifest(files(("/a", "module m\n")))[1].first()) == (1, 18, 0)
    for rows, limit, error in (((("/a", "module m\n"), ("/b", "module m\n")), 0, ValueError), ((("/a", "go 1.2\n"),), 0, ValueError),
                               ((("/a", "module m\n"), ("/b", "module n\n")), 1, SizeLimitError), ((("/a", "module m\n"),), -1, ValueError)):
        with pytest.raises(error):
            X.module_manifest(files(*rows), limit)


def test_sources_revision_and_lookup(spark, tmp_path):
    for name, text in (("b.go", "bb"), ("a.go", "a\nb"), ("big.go", "x" * 100)):
        (tmp_path / name).write_text(text)
    src = X.read_sources(spark, str(tmp_path), max_bytes=50)
    assert [(r.file_id, r.path.rsplit("/", 1)[1], r.content) for r in src.orderBy("file_id").collect()] == [
        ("f1", "a.go", "a\nb"), ("f2", "b.go", "bb"), ("f3", "big.go", None)]
    files = src.select("file_id", "path")
    rev = X.revision(src, files).first().revision
    assert len(rev) == 20 and rev == X.revision(src.repartition(3), files).first().revision
    assert rev != X.revision(src.withColumn("content", F.concat("content", F.lit(" "))), files).first().revision
    assert X.lookup_source(src, files, "f2", rev, rev).first().content == "bb"
    with pytest.raises(X.StaleRevisionError):
        X.lookup_source(src, files, "f2", rev, "old")
    with pytest.raises(KeyError):
        X.lookup_source(src, files, "f9", rev)


def test_projects_and_windows(spark):
    files = spark.createDataFrame([("f1", "/src/a/x.go"), ("f2", "/src/ab/x.go"), ("f3", "/other/x.go")], "file_id string, path string")
    roots = spark.createDataFrame([("/src/a", "z"), ("/src/a/", "y"), ("/src", "zz")], "path string, module string")
    assert {r.file_id: r.module for r in X.assign_project(files, roots).collect()} == {"f1": "y", "f2": "zz", "f3": ""}
    src = spark.createDataFrame([("f1", "1\n2\n3\n4\n5\n6\n7")], "file_id string, content string")
    places = spark.createDataFrame([("n", "f1", 2), ("m", "f1", 6)], "id string, file_id string, line int")
    got = {i: [(r.line, r.active) for r in X.source_window(places, src).filter(F.col("id") == i).orderBy("line").collect()] for i in "nm"}
    assert got["n"] == [(1, False), (2, True), (3, False), (4, False), (5, False)] and [x for x, _ in got["m"]] == [4, 5, 6, 7]


def test_operators_work_per_revision(spark):
    from flowweft.operators import aggregate as A
    from flowweft.operators.closure import trace
    from flowweft.schema import per_revision, plain_id, revision_of

    nodes = spark.createDataFrame([(r, i, "f" + i, "p" + i) for r in ("r1", "r2") for i in "abc"], "rev string, id string, function string, package string")
    functions = nodes.select("rev", F.col("function").alias("id"), "package")
    edges = spark.createDataFrame(
        [("r1", "e1", "a", "b"), ("r2", "e1", "b", "c"), ("r2", "e2", "c", "a")], "rev string, id string, src string, dst string"
    ).withColumns({"kind": F.lit("train"), "label": F.lit(""), "type": F.lit("T")})
    t = per_revision({"nodes": nodes, "edges": edges, "functions": functions})
    parts = lambda c: (revision_of(c), plain_id(c))
    seeds = t["nodes"].filter(plain_id("id") == "b").select("id")
    assert {tuple(r) for r in trace(t["edges"], seeds).select(*parts("id")).collect()} == {("r1", "a"), ("r1", "b"), ("r2", "a"), ("r2", "b"), ("r2", "c")}
    flows = A.package_overview(t["functions"], t["nodes"], t["edges"])[1]
    assert {tuple(r) for r in flows.select(*parts("src_package"), plain_id("dst_package"), "n").collect()} == {
        ("r1", "pa", "pb", 1), ("r2", "pb", "pc", 1), ("r2", "pc", "pa", 1)}
