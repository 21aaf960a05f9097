"""Fact tables to graph: one job per edge family, joined at the end."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbering import number_rows, running_sum
from ..runtime import materialize
from ..schema import EDGES, FUNCTIONS, GRAPH_VERSION, NODES, conform
from ..sources.text_files import assign_project, revision
from .aggregate import dedup_edges
from .classify import call_identity, classify_calls, directive_functions, label_instructions, parse_directives, unhide_named
from .linking import (
    argument_edges,
    capture_edges,
    channel_routes,
    end_of_use,
    escaped_values,
    instruction_order,
    invocation_edges,
    memory_edges,
    operand_edges,
    resolve_memory,
    return_aliases,
    return_edges,
    value_label,
    value_names,
)

# Texts of end-of-use nodes, the mode and the notes every built graph carries.
END_DETAIL = "Последнее статическое использование значения "
END_REASON = "Конец использования в SSA. Не событие освобождения памяти; для ветвей и циклов точное время неизвестно."
GRAPH_MODE = "static-ssa"
WARNINGS = (
    "Анимация показывает возможные потоки SSA, а не реальное выполнение: скорость, количество грузов и расписание поездов условны.",
    "Мусорки означают завершение использования значения или delete. Они не показывают фактическую работу сборщика мусора Go.",
    "Вызовы через интерфейсы и указатели на функции, alias-анализ памяти и каналов внутри контейнеров разрешаются не полностью. "
    "Ветви и циклы показаны как возможные пути.",
)


@dataclass
class Facts:
    """What a language frontend reports; see the README for the columns."""

    values: DataFrame
    instructions: DataFrame
    operands: DataFrame
    calls: DataFrame
    call_args: DataFrame
    params: DataFrame
    returns: DataFrame
    extracts: DataFrame
    captures: DataFrame
    free_vars: DataFrame
    channel_ops: DataFrame
    mem_ops: DataFrame
    addr_paths: DataFrame
    alias_links: DataFrame
    debug_refs: DataFrame
    map_values: DataFrame


NODE_COLUMNS = [
    "id", "kind", "label", "function", "method", "package", "type", "names", "protocol", "reason", "helper", "block", "ord", "role",
    "detail", "path", "line",
]
_OWN_LABEL, _CHANNEL_LABEL = ("makechan", "phi"), ("recv", "send")


def _with_place(df: DataFrame) -> DataFrame:
    """``df`` with detail, path and line; where a frontend reports none they are empty."""
    absent = {"detail": F.lit(""), "path": F.lit(None).cast("string"), "line": F.lit(None).cast("int")}
    return df.withColumns({c: v for c, v in absent.items() if c not in df.columns})


def _turn(phase: int, step: int = 0, idx: Column | None = None, spot: Column | None = None) -> Column:
    """Place of a link in the build: phase, instruction, family, position."""
    return F.struct(
        F.lit(phase).alias("phase"), (F.lit(0) if spot is None else spot).cast("bigint").alias("spot"),
        F.lit(step).alias("step"), (F.lit(0) if idx is None else idx).cast("bigint").alias("idx"),
    ).alias("seq")


def _spots(ordered: DataFrame, functions: DataFrame | None) -> tuple[DataFrame, int]:
    """``ordered`` with ``spot``, a number that rises with (turn, function, ord), and the spot of links without an instruction.

    A link carries one number instead of the three, of which one is a name. What has no turn has turn 0, what has no
    function the empty one; a link whose instruction is not known lies at the start of these.
    """
    function, none = F.coalesce("function", F.lit("")), F.lit(0).cast("bigint")
    sizes = ordered.groupBy(function.alias("function")).agg((F.max("ord") + 1).cast("bigint").alias("n"))
    sizes = sizes.withColumn("turn", none)
    if functions is not None:
        turns = functions.groupBy("function").agg(F.min("seq").cast("bigint").alias("turn"))
        sizes = sizes.drop("turn").join(turns, "function", "left").withColumn("turn", F.coalesce("turn", none))
    start = ordered.sparkSession.range(1).select(F.lit("").alias("function"), F.lit(0).cast("bigint").alias("n"), none.alias("turn"), F.lit(True).alias("_start"))
    summed = running_sum(
        sizes.withColumn("_start", F.lit(False)).unionByName(start), [], [F.col("turn"), F.col("function"), ~F.col("_start")], "n", "upto"
    )
    bases = materialize(summed.select("function", (F.col("upto") - F.col("n")).alias("base"), "_start"))
    placed = ordered.withColumn("_function", function).join(
        bases.filter(~F.col("_start")).select(F.col("function").alias("_function"), "base"), "_function"
    )
    return placed.withColumn("spot", F.col("base") + F.col("ord")).drop("_function", "base"), bases.filter("_start").first()["base"]


def operation_labels(ordered: DataFrame, channel_ops: DataFrame, values: DataFrame) -> DataFrame:
    """(instr_id, of_label): label of the channel a send or receive works on, or of the value an instruction yields.

    ``values``: value_id, label.
    """
    channels = channel_ops.groupBy("instr_id").agg(F.min("channel").alias("channel"))
    op = F.col("op")
    about = ordered.filter(op.isin(*_OWN_LABEL, *_CHANNEL_LABEL)).join(channels, "instr_id", "left").select(
        "instr_id", F.when(op.isin(*_CHANNEL_LABEL), F.col("channel")).otherwise(F.col("value_id")).alias("value_id")
    )
    return about.join(values.select("value_id", F.col("label").alias("of_label")), "value_id").select("instr_id", "of_label")


def build_graph(
    facts: Facts, directives: DataFrame | None = None, tool: str = "flow", functions: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a program.

    Memory and channel routes keep their hub form (helper nodes), so a hot address or
    channel adds as many edges as it has operations. Ids are stable: instructions and
    values keep theirs; number them afterwards if running numbers are wanted. ``seq`` of an
    edge is its place in the build, from 0: function by function (in the order of
    ``functions``: function, seq; else by name), instruction by instruction, operands before captures,
    arguments, invocations and returns; then memory, channels and ends of use by their
    ids. Of links with the same ends, kind and label the first stays.
    """
    ordered, unknown = _spots(_with_place(instruction_order(facts.instructions)), functions)
    ordered = materialize(ordered)
    at = ordered.select("instr_id", "spot")

    def placed(df: DataFrame, step: int, idx: Column | None = None) -> DataFrame:
        return df.join(at, "instr_id", "left").withColumn("seq", _turn(0, step, idx, F.coalesce("spot", F.lit(unknown)))).drop("spot")

    params = facts.params.withColumn("seq", F.col("idx").cast("bigint"))
    first_names = params.select("value_id", "name", "seq").unionByName(
        facts.free_vars.select("value_id", "name", F.col("idx").cast("bigint").alias("seq"))
    )
    names = value_names(facts.debug_refs, first_names)
    none = F.array().cast("array<string>")
    # A value that an instruction yields is that instruction's node.
    place = ordered.filter(F.col("value_id").isNotNull()).select("value_id", "instr_id", "block", "ord")
    values = materialize(
        _with_place(facts.values).join(names, "value_id", "left").join(place, "value_id", "left").withColumns({
            "names": F.coalesce("names", none), "node": F.coalesce("instr_id", "value_id"),
            "block": F.coalesce("block", F.lit(0)), "ord": F.coalesce("ord", F.lit(-1)).cast("bigint"),
        }).withColumn("label", value_label())
    )
    links = facts.alias_links.select("value_a", "value_b")
    links = links.unionByName(return_aliases(facts.calls, facts.returns, facts.extracts))
    argument_pairs = (
        facts.calls.select("instr_id", "callee").join(facts.call_args, "instr_id")
        .join(facts.params.select(F.col("function").alias("callee"), "idx", F.col("value_id").alias("value_b")), ["callee", "idx"])
        .select(F.col("value_id").alias("value_a"), "value_b")
    )
    # Closures are made by an instruction; a frontend that does not say which leaves the order to the ids.
    made = facts.captures if "instr_id" in facts.captures.columns else facts.captures.withColumn("instr_id", F.lit(None).cast("string"))
    free_nodes = facts.free_vars.withColumn("node", F.col("value_id"))
    captured, capture_pairs = capture_edges(placed(made, 1, F.col("idx")), free_nodes, values)
    links = links.unionByName(argument_pairs).unionByName(capture_pairs)
    roots, keys = resolve_memory(values, links, facts.addr_paths, facts.mem_ops, every=False)

    memory_hubs, memory = memory_edges(facts.mem_ops, keys, values)
    train_hubs, trains = channel_routes(facts.channel_ops, roots, values)
    param_nodes = facts.params.withColumn("node", F.col("value_id"))
    escaped = escaped_values(
        facts.channel_ops.filter("dir = 'send'").select(F.col("payload").alias("value_id")),
        facts.mem_ops.filter("rw = 'store'").select(F.col("payload").alias("value_id")),
        facts.map_values, facts.returns, facts.call_args,
    )
    trash, disposals = end_of_use(values, facts.operands, ordered, escaped)
    families = [
        operand_edges(placed(facts.operands, 0, F.col("idx")), values), captured,
        argument_edges(facts.calls, placed(facts.call_args, 2, F.col("idx")), param_nodes, values),
        invocation_edges(placed(facts.calls, 3), facts.params, ordered),
        return_edges(placed(facts.calls, 4), facts.returns),
        memory.withColumn("seq", _turn(1)), trains.withColumn("seq", _turn(2)), disposals.withColumn("seq", _turn(3)),
    ]
    columns = ["src", "dst", "kind", "label", "type", "seq"]
    edges = dedup_edges(reduce(DataFrame.unionByName, [f.select(*columns) for f in families]))
    order = [F.col(f"seq.{c}") for c in ("phase", "spot", "step", "idx")] + [F.col(c) for c in columns[:4]]
    edges = number_rows(edges, [], order, "place").select(
        F.concat_ws(":", "kind", F.concat_ws(">", "src", "dst"), F.nullif("label", F.lit(""))).alias("id"),
        "src", "dst", "kind", "label", "type", (F.col("place") - 1).cast("bigint").alias("seq"),
    )

    of_labels = operation_labels(ordered, facts.channel_ops, values).withColumnRenamed("of_label", "_of")
    given = F.col("of_label") if "of_label" in ordered.columns else F.lit(None).cast("string")
    labelled = label_instructions(
        ordered.join(values.select("value_id", "names"), "value_id", "left").join(of_labels, "instr_id", "left")
        .withColumns({"names": F.coalesce("names", none), "of_label": F.coalesce(F.col("_of"), given, F.lit(""))})
    )
    called = classify_calls(facts.calls, directives=directives, tool=tool).select(
        "instr_id", call_identity().alias("method"), "protocol", F.col("kind").alias("call_kind"),
        F.col("label").alias("call_label"), F.col("reason").alias("call_reason"),
    )
    empty = F.lit("")
    where = ["detail", "path", "line"]
    operations = labelled.join(called, "instr_id", "left").select(
        F.col("instr_id").alias("id"), F.coalesce("call_kind", "kind").alias("kind"), F.coalesce("call_label", "label").alias("label"),
        "function", F.coalesce("method", empty).alias("method"), "package", "type", "names", F.coalesce("protocol", empty).alias("protocol"),
        F.coalesce("call_reason", "reason").alias("reason"), "helper", "block", F.col("ord").cast("double").alias("ord"), *where,
    )
    plain = values.filter(F.col("node") == F.col("value_id")).select(
        F.col("value_id").alias("id"), F.when(F.col("is_global"), "memory").otherwise("source").alias("kind"), "label", "function",
        empty.alias("method"), "package", "type", "names", empty.alias("protocol"), empty.alias("reason"),
        F.col("is_const").alias("helper"), F.lit(0).alias("block"), F.lit(-1.0).alias("ord"), *where,
    )
    nowhere = [empty.alias("detail"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line")]
    hubs = memory_hubs.withColumn("kind", F.lit("memory")).unionByName(train_hubs.withColumn("kind", F.lit("station"))).select(
        "id", "kind", F.col("key").alias("label"), empty.alias("function"), empty.alias("method"), empty.alias("package"), empty.alias("type"),
        none.alias("names"), empty.alias("protocol"), empty.alias("reason"), F.lit(True).alias("helper"), F.lit(0).alias("block"), F.lit(0.0).alias("ord"), F.lit("hub").alias("role"),
        *nowhere,
    )
    # An end of use lies where its last use does.
    body = operations.select("id", "path", "line").unionByName(plain.select("id", "path", "line"))
    last = disposals.select(F.col("dst").alias("end"), F.col("src").alias("id"), F.col("label").alias("of")).join(body, "id").drop("id")
    ends = trash.join(last, F.col("id") == F.col("end"), "left").select(
        "id", "kind", "label", "function", empty.alias("method"), "package", "type", none.alias("names"), empty.alias("protocol"),
        F.lit(END_REASON).alias("reason"), F.lit(False).alias("helper"), "block", F.col("ord").cast("double").alias("ord"),
        F.concat(F.lit(END_DETAIL), "of").alias("detail"), "path", "line",
    )
    plain_roles = operations.unionByName(plain).unionByName(ends).withColumn("role", F.lit(None).cast("string"))
    nodes = plain_roles.unionByName(hubs, allowMissingColumns=True).select(*NODE_COLUMNS)
    return unhide_named(nodes), edges


def _location(file_id: str, line: str) -> Column:
    """A place in a file of the graph; one outside all files is empty."""
    known = F.col(file_id).isNotNull() & F.col(line).isNotNull()
    return F.struct(
        F.when(known, F.col(file_id)).otherwise("").alias("file"), F.when(known, F.col(line)).otherwise(0).cast("int").alias("line")
    ).alias("source")


def program_functions(functions: DataFrame, sources: DataFrame, projects: DataFrame) -> DataFrame:
    """The functions table of a graph: id, name, package, project, source, seq.

    ``functions``: function, name, package, path, line, seq; ``sources``: file_id, path;
    ``projects``: path of the root, module. A function whose file is in no
    project has an empty one, a path that is no source an empty place.
    """
    owners = assign_project(sources.select("file_id", "path"), projects)
    return functions.join(owners, "path", "left").select(
        F.col("function").alias("id"), "name", "package", F.coalesce("module", F.lit("")).alias("project"), _location("file_id", "line"), "seq"
    )


def build_document(facts: Facts, functions: DataFrame, sources: DataFrame, projects: DataFrame, tool: str = "flow") -> dict[str, DataFrame]:
    """All tables of a graph document: snapshots, nodes, edges, functions, projects, files and sources.

    ``functions``: see program_functions; ``sources`` are those of ``read_sources``, ``projects`` those of
    ``module_manifest``. Directives above a function act on its calls. Files are those in which
    a function or node lies. ``rev`` is their fingerprint. Nodes are numbered by function and
    place in it, hubs and ends of use after them. The result fits ``write_graph`` and ``validate_graph``.
    """
    functions = materialize(program_functions(functions, sources, projects))
    directives = materialize(directive_functions(parse_directives(sources, tool), functions))
    nodes, edges = build_graph(facts, directives, tool, functions.select(F.col("id").alias("function"), "seq"))
    turns = functions.select(F.col("id").alias("function"), F.col("seq").cast("bigint").alias("turn"))
    file_ids = sources.select("path", "file_id")
    phase = F.when(F.col("role").isNotNull(), 1).when(F.col("reason") == END_REASON, 2).otherwise(0)
    placed = nodes.join(file_ids, "path", "left").join(turns, "function", "left").withColumns({"source": _location("file_id", "line"), "phase": phase})
    order = [F.col("phase"), F.col("turn"), F.col("function"), F.col("ord"), F.col("id")]
    nodes = materialize(number_rows(placed, [], order, "seq").withColumn("seq", F.col("seq") - 1))
    touched = nodes.select("source.file").unionByName(functions.select("source.file")).filter("file <> ''").distinct()
    kept = sources.join(touched.withColumnRenamed("file", "file_id"), "file_id", "left_semi")
    rev = revision(kept, kept.select("file_id", "path")).first()["revision"]
    note = F.array(*[F.lit(w) for w in WARNINGS])
    tables = {
        "snapshots": facts.values.sparkSession.range(1).select(
            F.lit(GRAPH_VERSION).alias("version"), F.lit(GRAPH_MODE).alias("mode"), note.alias("warnings"), F.lit(False).alias("corrupt"),
            F.array().cast("array<string>").alias("missing"),
        ),
        "nodes": conform(nodes, f"{NODES}, role STRING").withColumn("role", F.nullif("role", F.lit(""))),
        # Belts out of a hub have no type of their own (null), see linking.
        "edges": edges.select(*[f.name for f in T.StructType.fromDDL(EDGES).fields if f.name != "rev"]),
        "functions": conform(functions, FUNCTIONS),
        "projects": projects.select("path", "module"),
        "files": kept.select("file_id", "path"),
        "sources": kept.select("file_id", "content"),
    }
    return {name: df.withColumn("rev", F.lit(rev)) for name, df in tables.items()}
