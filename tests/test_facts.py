import pytest
from pyspark.sql import functions as F

from flowweft.operators import classify as K
from flowweft.operators import linking as L
from flowweft.operators import views as V

CALL = "instr_id string, callee string, callee_pkg string, callee_name string, signature string, dispatch string, mode string, const_args array<string>, receiver_type string"


def call(i, pkg, name, dispatch="static", mode="call", args=(), signature="func()"):
    return (f"i{i}", f"{pkg}.{name}", pkg, name, signature, dispatch, mode, list(args), "I")


def test_calls_by_package_and_name(spark):
    rows = [
        (call(1, "net/http", "Post"), "rocket", "http"), (call(2, "app/http", "Post"), "machine", ""),
        (call(3, "database/sql", "Exec"), "warehouse", "sql"), (call(4, "database/sql", "QueryRow", args=[" insert into t returning id"]), "warehouse", "sql"),
        (call(5, "database/sql", "QueryRow", args=["select 1"]), "machine", ""), (call(6, "", "delete", "builtin"), "trash", ""),
        (call(7, "", "close", "builtin"), "station", ""), (call(8, "", "len", "builtin"), "machine", ""),
        (call(9, "x/gen", "Save", signature="func(google.golang.org/grpc.CallOption)"), "rocket", "grpc"),
        (call(10, "x/gen", "Dial", signature="func(google.golang.org/grpc.CallOption)"), "machine", ""),
        (call(11, "github.com/redis/go-redis/v9", "Set", "invoke", "go"), "warehouse", "redis"),
        (call(12, "app", "SendToPeer", mode="defer"), "rocket", "webrtc"), (call(13, "", "fn", "dynamic"), "machine", ""),
    ]
    directives = spark.createDataFrame([("app.SendToPeer", ["rocket", "webrtc"])], "function string, words array<string>")
    done = {r.instr_id: r for r in K.classify_calls(spark.createDataFrame([r[0] for r in rows], CALL), directives=directives).collect()}
    assert [(done[r[0][0]].kind, done[r[0][0]].protocol) for r in rows] == [(k, p) for _, k, p in rows]
    assert done["i11"].label == "go · Set" and done["i12"].label == "defer · app.SendToPeer"
    assert done["i12"].reason.endswith("flow:rocket webrtc") and done["i13"].reason == K.DYNAMIC_REASON


def test_directives_belong_to_the_next_function(spark):
    text = "package x\n\n//flow:rocket webrtc\nfunc A() {}\n\n// about B\n//flow:trash\nfunc (t *T) B(x int) {}\n//flow:other\nfunc C() {}\n\n//flow:trash\n\nfunc D() {}\n"
    src = spark.createDataFrame([("f1", text)], "file_id string, content string")
    assert {(r.function, tuple(r.words)) for r in K.parse_directives(src).collect()} == {("A", ("rocket", "webrtc")), ("B", ("trash",))}


def test_directives_below_long_comments_and_with_crlf(spark):
    long = "// words\n" * 100_000 + "//flow:trash\nfunc Long() {}\n"
    src = spark.createDataFrame(
        [("f1", long), ("f2", "x\r\n//flow:rocket grpc\r\nfunc (t *T) A() {}\r\n"), ("f3", "//flow:trash\n\nfunc Gap() {}\n//flow:warehouse\n//flow:lost\nfunc A()"), ("f4", None)],
        "file_id string, content string",
    )
    found = K.parse_directives(src)
    assert {(r.file_id, r.function, tuple(r.words), r.line) for r in found.collect()} == {
        ("f1", "Long", ("trash",), 100_002), ("f2", "A", ("rocket", "grpc"), 3), ("f3", "A", ("warehouse",), 6),
    }
    functions = spark.createDataFrame(
        [("p.(*T).A", ("f2", 3)), ("q.A", ("f3", 6)), ("q.B", ("f3", 9)), ("p.Long", ("f1", 100_002))], "id string, source struct<file: string, line: int>"
    )
    marks = K.directive_functions(found, functions)
    assert {(r.function, tuple(r.words)) for r in marks.collect()} == {("p.(*T).A", ("rocket", "grpc")), ("q.A", ("warehouse",)), ("p.Long", ("trash",))}
    calls = spark.createDataFrame(
        [("i1", "q.A"), ("i2", "q.B"), ("i3", "p.(*T).A")], "instr_id string, callee string"
    ).withColumns({"callee_pkg": F.lit("q"), "callee_name": F.lit("A"), "signature": F.lit(""), "dispatch": F.lit("static"), "mode": F.lit("call"), "const_args": F.array().cast("array<string>")})
    done = K.classify_calls(calls, directives=marks.unionByName(marks))
    assert {(r.instr_id, r.kind) for r in done.collect()} == {("i1", "warehouse"), ("i2", "machine"), ("i3", "rocket")} and done.count() == 3


def values(spark, rows):
    return spark.createDataFrame(rows, "value_id string, label string, type string, is_channel boolean, is_pointer boolean").withColumn("node", F.col("value_id"))


def test_channels_by_identity_not_name(spark):
    v = values(spark, [("c1", "queue", "chan", True, False), ("c2", "queue", "chan", True, False), ("p", "alias", "chan", True, False), ("x", "x", "int", False, False)])
    roots = L.alias_roots(v, spark.createDataFrame([("c1", "p"), ("c2", "x")], "value_a string, value_b string"))
    ops = spark.createDataFrame(
        [("s1", "send", "c1", "x"), ("s2", "send", "c2", "x"), ("r1", "recv", "p", None), ("r2", "recv", "c2", None), ("r3", "recv", "c1", None), ("s3", "send", "c9", "x")],
        "instr_id string, dir string, channel string, payload string")
    hubs, edges = L.channel_routes(ops, roots, v)
    pairs = L.expand_hubs(hubs, edges)
    assert {(r.src, r.dst, r.kind, r.label, r.type) for r in pairs.collect()} == {
        ("s1", "r1", "train", "queue", "int"), ("s1", "r3", "train", "queue", "int"), ("s2", "r2", "train", "queue", "int")}
    with pytest.raises(ValueError, match="limit 2"):
        L.expand_hubs(hubs, edges, max_edges=2)


def test_contracting_hubs_gives_the_routes(spark, make_nodes, make_edges):
    v = values(spark, [("c", "q", "chan", True, False), ("x", "x", "int", False, False)])
    ops = spark.createDataFrame([("s1", "send", "c", "x"), ("s2", "send", "c", "x"), ("r1", "recv", "c", None), ("r2", "recv", "c", None)],
                                "instr_id string, dir string, channel string, payload string")
    hubs, edges = L.channel_routes(ops, v.select("value_id", F.col("value_id").alias("root")), v)
    nodes = make_nodes([*("s1", "s2", "r1", "r2"), *[{"id": r.id, "helper": True} for r in hubs.collect()]])
    links = V.visible_graph(nodes, edges.withColumn("seq", F.xxhash64("src", "dst")).withColumn("id", F.lit("")))[1]
    assert {(r.src, r.dst, r.kind) for r in links.collect()} == {(s, r, "train") for s in ("s1", "s2") for r in ("r1", "r2")}


def test_address_keys(spark):
    ids = ["s", "a", "b", "i", "d", "m"]
    roots = spark.createDataFrame([(i, i) for i in ids] + [("b2", "b")], "value_id string, root string")
    paths = spark.createDataFrame([("a", "s", ".field0"), ("b", "a", ".field1"), ("i", "b2", "[3]"), ("d", "i", ".field2"), ("m", "d", ".field4")], "value_id string, base string, step string")
    keys = {r.value_id: r.addr_key for r in L.address_keys(paths, roots).collect()}
    assert keys == {"s": "s", "a": "s.field0", "b": "s.field0.field1", "b2": "s.field0.field1", "i": "s.field0.field1[3]",
                    "d": "s.field0.field1[3].field2", "m": "s.field0.field1[3].field2.field4"}
    loop = spark.createDataFrame([("a", "b", "."), ("b", "i", "."), ("i", "a", ".")], "value_id string, base string, step string")
    with pytest.raises(ValueError):
        L.address_keys(loop, roots)


def test_memory_reaches_the_joint_fixpoint(spark):
    """p is stored in a cell and loaded as q; what is stored through p is then seen through q."""
    v = values(spark, [(i, i, "*T", False, True) for i in ("cell", "p", "q", "pf", "qf", "x", "y")])
    paths = spark.createDataFrame([("pf", "p", ".field0"), ("qf", "q", ".field0")], "value_id string, base string, step string")
    ops = spark.createDataFrame([("i1", "store", "cell", "p"), ("i2", "load", "cell", "q"), ("i3", "store", "pf", "x"), ("i4", "load", "qf", "y")],
                                "instr_id string, rw string, address string, payload string")
    none = spark.createDataFrame([], "value_a string, value_b string")
    roots, keys = L.resolve_memory(v, none, paths, ops)
    r = {x.value_id: x.root for x in roots.collect()}
    assert r["p"] == r["q"] and r["x"] == r["y"]
    hubs, edges = L.memory_edges(ops, keys, v)
    assert {(e.src, e.dst) for e in L.expand_hubs(hubs, edges).collect()} == {("i1", "i2"), ("i3", "i4")}


def test_fixpoint_can_leave_out_values_that_stand_for_themselves(spark):
    """What is left out is its own root or key; payloads that cannot alias and addresses that are no value change nothing."""
    v = values(spark, [(i, i, "*T", False, i != "a0") for i in ("cell", "p", "q", "pf", "qf", "x", "y", "alone", "a0")])
    paths = spark.createDataFrame([("pf", "p", ".field0"), ("qf", "q", ".field0"), ("far", "p", ".field1")], "value_id string, base string, step string")
    ops = spark.createDataFrame([("i1", "store", "cell", "p"), ("i2", "load", "cell", "q"), ("i3", "store", "pf", "x"), ("i4", "load", "qf", "y"),
                                 ("i5", "store", "alone", "a0"), ("i6", "load", "alone", "x"), ("i7", "load", "far", None), ("i8", "store", "far", "y")],
                                "instr_id string, rw string, address string, payload string")
    none = spark.createDataFrame([], "value_a string, value_b string")
    roots, keys = L.resolve_memory(v, none, paths, ops)
    few_roots, few_keys = L.resolve_memory(v, none, paths, ops, every=False)
    assert {tuple(r) for r in few_roots.collect()} == {(r.value_id, r.root) for r in roots.collect() if r.value_id != r.root} == {("q", "p"), ("y", "x")}
    assert {tuple(r) for r in few_keys.collect()} == {(r.value_id, r.addr_key) for r in keys.collect() if r.value_id != r.addr_key}
    whole, few = (sorted(map(str, L.memory_edges(ops, k, v)[1].collect())) for k in (keys, few_keys))
    assert whole == few and whole


def test_names_and_end_of_use(spark):
    refs = spark.createDataFrame([("v", "b", 5), ("v", "a", 3), ("v", "b", 1), ("v", "_", 0), ("w", "w", 2)], "value_id string, name string, seq bigint")
    params = spark.createDataFrame([("v", "self", 9)], "value_id string, name string, seq bigint")
    assert {r.value_id: r.names for r in L.value_names(refs, params).collect()} == {"v": ["self", "b", "a"], "w": ["w"]}
    v = spark.createDataFrame(
        [("v", "v", "f", "p", 0, -1, "v", "int", ["v"], False), ("u", "u", "f", "p", 0, -1, "u", "int", ["u"], False), ("e", "e", "f", "p", 0, -1, "e", "int", ["e"], False)],
        "value_id string, node string, function string, package string, block int, ord bigint, label string, type string, names array<string>, is_channel boolean")
    operands = spark.createDataFrame([("i1", "v"), ("i2", "v"), ("j1", "v"), ("i1", "e")], "instr_id string, value_id string")
    ins = spark.createDataFrame([("i1", "f", 0, 3), ("i2", "f", 1, 7), ("j1", "g", 0, 9)], "instr_id string, function string, block int, ord bigint")
    nodes, edges = L.end_of_use(v, operands, ins, spark.createDataFrame([("e",)], "value_id string"))
    assert {(r.id, r.ord) for r in nodes.collect()} == {("trash:v", 8), ("trash:u", 0)}
    assert {(r.src, r.dst) for r in edges.collect()} == {("i2", "trash:v"), ("u", "trash:u")}


def test_calls_link_arguments_entries_and_returns(spark):
    calls = spark.createDataFrame([("c1", "f", "call", "int", "r1"), ("c2", "f", "go", "int", "r2"), ("c3", "g", "call", "int", "r3")],
                                  "instr_id string, callee string, mode string, type string, value_id string")
    args = spark.createDataFrame([("c1", 0, "x"), ("c1", 1, "y"), ("c3", 0, "x")], "instr_id string, idx int, value_id string")
    params = spark.createDataFrame([("f", 0, "f.p0", "in")], "function string, idx int, node string, name string")
    v = values(spark, [("x", "x", "int", False, False), ("y", "y", "int", False, False)])
    assert [(r.src, r.dst, r.label) for r in L.argument_edges(calls, args, params, v).collect()] == [("x", "f.p0", "x → in")]
    ins = spark.createDataFrame([("g1", "g", 1), ("g0", "g", 0), ("f0", "f", 0)], "instr_id string, function string, ord int")
    assert [(r.src, r.dst) for r in L.invocation_edges(calls, params, ins).collect()] == [("c3", "g0")]
    returns = spark.createDataFrame([("f", "ret", 0, "a"), ("g", "ret2", 0, "b"), ("g", "ret2", 1, "c")], "function string, instr_id string, idx int, value_id string")
    assert {(r.src, r.dst) for r in L.return_edges(calls, returns).collect()} == {("ret", "c1"), ("ret2", "c3")}
    extracts = spark.createDataFrame([("c3", 1, "r3.1")], "instr_id string, idx int, value_id string")
    assert {(r.value_a, r.value_b) for r in L.return_aliases(calls, returns, extracts).collect()} == {("a", "r1"), ("c", "r3.1")}


def test_hub_links_move_once_by_key(spark):
    """Rows of a hub are made distinct where they lie: no shuffle by whole links."""
    ops = spark.createDataFrame(
        [("k", "w", True, "a", "t"), ("k", "w", True, "a", "t"), ("k", "r", False, "b", "t"), ("k", "r", None, "c", "u"), ("lone", "x", True, "a", "t")],
        "key string, node string, into boolean, label string, type string")
    hubs, edges = L._hubs(ops, "memory", F.col("label"))
    assert "hashpartitioning(src" not in edges._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, edges.collect()), key=str) == sorted(
        [("w", "memory:k", "memory", "a", "t"), ("memory:k", "r", "belt", "", None)], key=str)
    assert [(r.key, r.n_in, r.n_out) for r in hubs.collect()] == [("k", 2, 1)]
