"""A tiny program: main sends x on a channel, a worker receives it, a call returns through a cell."""

from pyspark.sql import functions as F

from flowweft.operators import aggregate as A
from flowweft.operators import validate as V_check
from flowweft.operators import views as V
from flowweft.operators.build import END_DETAIL, WARNINGS, Facts, _spots, build_document, build_graph


def facts(spark):
    def t(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    values = t(
        "value_id string, name string, type string, is_channel boolean, is_pointer boolean, is_global boolean, is_const boolean, function string, package string",
        ("ch", "t0", "chan int", True, False, False, False, "main", "m"), ("x", "x", "int", False, False, False, False, "main", "m"),
        ("one", "1", "int", False, False, False, True, "main", "m"), ("w.ch", "ch", "chan int", True, False, False, False, "worker", "m"),
        ("got", "t1", "int", False, False, False, False, "worker", "m"), ("sum", "t2", "int", False, False, False, False, "worker", "m"),
        ("cell", "cell", "*int", False, True, True, False, "main", "m"), ("back", "t3", "int", False, False, False, False, "main", "m"),
    )
    instructions = t(
        "instr_id string, function string, package string, block int, pos bigint, op string, operator string, of_label string, value_id string, type string",
        ("m0", "main", "m", 0, 0, "makechan", "", "queue", "ch", "chan int"), ("m1", "main", "m", 0, 1, "call", "", "", None, ""),
        ("m2", "main", "m", 0, 2, "send", "", "queue", None, ""), ("m3", "main", "m", 0, 3, "unop", "", "", "back", "int"),
        ("m4", "main", "m", 0, 4, "jump", "", "", None, ""), ("m5", "main", "m", 1, 0, "return", "", "", None, ""),
        ("w0", "worker", "m", 0, 0, "recv", "", "ch", "got", "int"), ("w1", "worker", "m", 0, 1, "binop", "+", "", "sum", "int"),
        ("w2", "worker", "m", 0, 2, "store", "", "", None, ""),
    )
    operands = t("instr_id string, idx int, value_id string", ("m1", 0, "ch"), ("m2", 0, "ch"), ("m2", 1, "x"), ("m3", 0, "cell"), ("m5", 0, "back"),
                 ("w0", 0, "w.ch"), ("w1", 0, "got"), ("w1", 1, "one"), ("w2", 0, "cell"), ("w2", 1, "sum"))
    calls = t("instr_id string, callee string, callee_pkg string, callee_name string, signature string, dispatch string, mode string, "
              "const_args array<string>, receiver_type string, type string, value_id string",
              ("m1", "worker", "m", "worker", "func()", "static", "go", [], "", "", "none"))
    pair = "function string, idx int, value_id string, name string"
    return Facts(
        values=values, instructions=instructions, operands=operands, calls=calls, call_args=t("instr_id string, idx int, value_id string", ("m1", 0, "ch")),
        params=t(pair, ("worker", 0, "w.ch", "ch")), returns=t("function string, instr_id string, idx int, value_id string", ("main", "m5", 0, "back")),
        extracts=t("instr_id string, idx int, value_id string"), captures=t("function string, idx int, value_id string"), free_vars=t(pair),
        channel_ops=t("instr_id string, dir string, channel string, payload string", ("m2", "send", "ch", "x"), ("w0", "recv", "w.ch", None)),
        mem_ops=t("instr_id string, rw string, address string, payload string", ("w2", "store", "cell", "sum"), ("m3", "load", "cell", "back")),
        addr_paths=t("value_id string, base string, step string"), alias_links=t("value_a string, value_b string"),
        debug_refs=t("value_id string, name string, seq bigint", ("ch", "queue", 1), ("x", "x", 2), ("got", "v", 3)), map_values=t("value_id string"),
    )


def test_program_becomes_a_graph(spark):
    nodes, edges = build_graph(facts(spark))
    kinds = {r.id: (r.kind, r.label, r.helper) for r in nodes.collect()}
    assert kinds["m0"] == ("station", "Канал · queue", False) and kinds["m1"] == ("machine", "go · worker", False)
    assert kinds["w1"] == ("machine", "+", False) and kinds["w2"] == ("memory", "Запись в память", True)
    assert kinds["one"] == ("source", "1", True) and kinds["cell"] == ("memory", "cell", False) and "m4" not in kinds
    got = {(r.src, r.dst, r.kind) for r in edges.collect()}
    assert ("m0", "w.ch", "call") in got and ("x", "m2", "belt") in got and ("w0", "w1", "belt") in got
    # x escapes through the channel; v ends at its last use.
    assert {d for s, d, k in got if k == "disposal"} == {"trash:got"} and ("w1", "trash:got", "disposal") in got
    links = V.visible_graph(nodes.withColumn("seq", F.xxhash64("id")), edges, compact=True)[1]
    shown = {(r.src, r.dst, r.kind) for r in links.collect()}
    assert ("m2", "w0", "train") in shown
    # sum -> store (helper) -> cell -> load (helper) -> return: the stored value reaches the return.
    assert ("w1", "m5", "memory") in shown


def test_routes_of_a_built_graph_roll_up(spark):
    nodes, edges = build_graph(facts(spark))
    pairs = {(r.src, r.dst) for r in V.visible_graph(nodes.withColumn("seq", F.xxhash64("id")), edges, compact=True)[1].filter("kind = 'train'").collect()}
    home = {r.id: (r.function, r.package) for r in nodes.collect()}
    functions = nodes.filter("function <> ''").select(F.col("function").alias("id"), F.col("function").alias("name"), "package").distinct()
    assert V_check.validate_graph({"nodes": nodes, "edges": edges, "functions": functions}).count() == 0
    types = {(r.src, r.dst): r.types for r in V.visible_graph(nodes.withColumn("seq", F.xxhash64("id")), edges)[1].filter("kind = 'train'").collect()}
    assert all(t != [""] for t in types.values())
    # One package: give every function its own, so that routes cross packages.
    apart = nodes.withColumn("package", F.col("function"))
    flows = A.package_overview(functions.withColumn("package", F.col("id")), apart, edges)[1].filter("kind = 'train'")
    want = {}
    for a, b in pairs:
        key = (home[a][0], home[b][0])
        if key[0] != key[1]:
            want[key] = want.get(key, 0) + 1
    assert {(r.src_package, r.dst_package): r.n for r in flows.collect()} == want and want
    contact = A.function_graph(nodes, edges)
    assert "" not in {r.id for r in contact.collect()} and {(a, b) for a, b in want} <= {(r.id, r.other) for r in contact.collect()}


def test_row_order_does_not_matter(spark):
    a = facts(spark)
    b = Facts(**{k: v.orderBy(F.rand(7)) for k, v in vars(a).items()})
    first, second = (sorted(map(str, build_graph(f)[1].drop("seq").collect())) for f in (a, b))
    assert first == second


def test_operations_are_labelled_by_what_they_work_on(spark):
    program = facts(spark)
    program.instructions = program.instructions.drop("of_label")
    labels = {r.id: r.label for r in build_graph(program)[0].collect()}
    assert labels["m0"] == "Канал · queue" and labels["m2"] == "Отправить · queue" and labels["w0"] == "Получить · ch"


def test_edges_come_in_build_order_and_the_first_of_equals_stays(spark):
    program = facts(spark)
    functions = spark.createDataFrame([("worker", "worker", "m", None, None, 0), ("main", "main", "m", None, None, 1)],
                                      "function string, name string, package string, path string, line int, seq bigint")
    # The same operand twice: one link.
    program.operands = program.operands.unionByName(program.operands.filter("instr_id = 'w1' AND idx = 0").withColumn("idx", F.lit(2)))
    edges = build_graph(program, functions=functions)[1].orderBy("seq").collect()
    assert [r.seq for r in edges] == list(range(len(edges)))
    place = {(r.src, r.dst): r.seq for r in edges}
    assert place["w.ch", "w0"] < place["w0", "w1"] < place["m0", "m1"] < place["m0", "w.ch"]  # the worker's body first
    assert [r.kind for r in edges][-1] == "disposal" and len(place) == len(edges)


def test_links_of_an_unknown_instruction_come_before_the_functions_of_turn_0(spark):
    program = facts(spark)
    lost = spark.createDataFrame([("gone", 0, "x")], "instr_id string, idx int, value_id string")
    program.operands = program.operands.unionByName(lost)
    functions = spark.createDataFrame([("worker", "worker", "m", None, None, -1)], "function string, name string, package string, path string, line int, seq bigint")
    edges = build_graph(program, functions=functions)[1].orderBy("seq").collect()
    place = {(r.src, r.dst): r.seq for r in edges}
    # worker has turn -1, main none: the lost link lies between their bodies.
    assert place["w0", "w1"] < place["x", "gone"] < place["m0", "m1"] and edges[0].dst == "w0"
    assert set(edges[0].asDict()) == {"id", "src", "dst", "kind", "label", "type", "seq"}


def test_links_carry_one_number_as_their_place(spark):
    ordered = spark.createDataFrame([("a", "f", 0), ("b", "f", 1), ("c", "g", 0), ("d", None, 0), ("e", "", 0)], "instr_id string, function string, ord bigint")
    functions = spark.createDataFrame([("f", 5), ("g", 1)], "function string, seq bigint")
    placed, unknown = _spots(ordered, functions)
    assert unknown == 0 and {r.instr_id: r.spot for r in placed.collect()} == {"d": 0, "e": 0, "c": 1, "a": 2, "b": 3}


def test_document_has_places_projects_directives_and_no_faults(spark):
    program = facts(spark)
    functions = spark.createDataFrame(
        [("main", "main", "m", "/app/main.go", 3, 0), ("worker", "worker", "m", "/app/sub/w.go", 4, 1), ("lost", "lost", "m", "/else/x.go", 1, 2)],
        "function string, name string, package string, path string, line int, seq bigint")
    program.instructions = program.instructions.withColumns({
        "path": F.when(F.col("function") == "worker", "/app/sub/w.go").otherwise("/app/main.go"), "line": F.col("pos").cast("int") + 5,
    })
    sources = spark.createDataFrame([
        ("f1", "/app/main.go", "package m\n\nfunc main() {\n}\n"), ("f2", "/app/sub/w.go", "package m\n\n//flow:rocket mqtt\nfunc worker() {\n}\n"),
        ("f3", "/app/unused.go", "package m\n"),
    ], "file_id string, path string, content string")
    projects = spark.createDataFrame([("/app", "test/app")], "path string, module string")
    t = build_document(program, functions, sources, projects)
    assert V_check.validate_graph(t).count() == 0
    head = t["snapshots"].first()
    assert tuple(head.warnings) == WARNINGS and len(head.rev) == 20 and {r.rev for r in t["nodes"].select("rev").distinct().collect()} == {head.rev}
    assert {(r.id, r.project, r.source.file, r.source.line) for r in t["functions"].collect()} == {
        ("main", "test/app", "f1", 3), ("worker", "test/app", "f2", 4), ("lost", "", "", 0)}
    assert {r.file_id for r in t["files"].collect()} == {"f1", "f2"} == {r.file_id for r in t["sources"].collect()}
    nodes = {r.id: r for r in t["nodes"].collect()}
    assert (nodes["m1"].kind, nodes["m1"].protocol, nodes["m1"].reason) == ("rocket", "mqtt", "Явная аннотация //flow:rocket mqtt")
    assert nodes["w1"].source == ("f2", 6) and nodes["ch" if "ch" in nodes else "x"].source == ("", 0)
    end = nodes["trash:got"]
    assert end.source == ("f2", 6) and end.detail == END_DETAIL + "v" and end.reason.startswith("Конец использования")
    assert sorted(r.seq for r in nodes.values()) == list(range(len(nodes))) and end.seq == len(nodes) - 1
