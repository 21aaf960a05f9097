"""Edges between facts: operands, arguments, returns, captures, memory and channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import number_rows
from ..runtime import materialize, write_table
from .closure import component_roots

# Labels of the edges a rule names itself.
CALL_LABEL = "вызов"
RESULT_LABEL = "результат"
MEMORY_LABEL = "память"
SKIPPED_OPS = ("jump", "rundefers", "debugref")


def _edge(src: str, dst: str, kind: str, label, type) -> list[Column]:
    return [F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"), label.alias("label"), type.alias("type")]


def _place(df: DataFrame) -> list[str]:
    """The place in the build, if the rows bring one: edges keep it."""
    return ["seq"] if "seq" in df.columns else []


def value_label() -> Column:
    """Joined source names of a value, else its own name."""
    return F.when(F.size("names") > 0, F.array_join("names", ", ")).otherwise(F.col("name"))


def value_names(debug_refs: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """(value_id, names): distinct source names per value in first-seen order, ``_`` ignored.

    ``debug_refs`` and ``params``: value_id, name, seq. Parameter names come first.
    """
    refs = debug_refs.filter(F.col("name") != "_").select("value_id", "name", F.lit(1).alias("late"), "seq")
    if params is not None:
        refs = refs.unionByName(params.select("value_id", "name", F.lit(0).alias("late"), "seq"))
    first = refs.groupBy("value_id", "name").agg(F.min(F.struct("late", "seq")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "name")))
    return first.groupBy("value_id").agg(F.transform(ordered, lambda e: e["name"]).alias("names"))


def instruction_order(instructions: DataFrame) -> DataFrame:
    """Running 0-based order per function in (block, pos); jumps, deferred runs and debug marks skipped."""
    kept = instructions.filter(~F.col("op").isin(*SKIPPED_OPS))
    numbered = number_rows(kept, ["function"], [F.col("block"), F.col("pos"), F.col("instr_id")])
    return numbered.withColumn("ord", F.col("rn") - 1).drop("rn")


def operand_edges(operands: DataFrame, values: DataFrame) -> DataFrame:
    """Value -> using instruction. Functions and built-ins are not in ``values`` (value_id, node, label, type)."""
    return operands.join(values.select("value_id", "node", "label", "type"), "value_id").select(
        *_edge("node", "instr_id", "belt", F.col("label"), F.col("type")), *_place(operands)
    )


def argument_edges(calls: DataFrame, call_args: DataFrame, params: DataFrame, values: DataFrame) -> DataFrame:
    """Argument -> parameter of the same position; surplus arguments find no partner."""
    target = params.select(F.col("function").alias("callee"), "idx", F.col("node").alias("param_node"), F.col("name").alias("param"))
    return (
        calls.select("instr_id", "callee")
        .join(call_args.select("instr_id", "idx", "value_id", *_place(call_args)), "instr_id")
        .join(target, ["callee", "idx"])
        .join(values.select("value_id", "node", "label", "type"), "value_id")
        .select(*_edge("node", "param_node", "call", F.concat_ws(" → ", "label", "param"), F.col("type")), *_place(call_args))
    )


def invocation_edges(calls: DataFrame, params: DataFrame, instructions: DataFrame) -> DataFrame:
    """Call -> first instruction of a callee without parameters."""
    entry = instructions.groupBy(F.col("function").alias("callee")).agg(F.min_by("instr_id", "ord").alias("entry"))
    bare = entry.join(params.select(F.col("function").alias("callee")).distinct(), "callee", "left_anti")
    return calls.join(bare, "callee").select(*_edge("instr_id", "entry", "call", F.lit(CALL_LABEL), F.lit("")), *_place(calls))


def return_edges(calls: DataFrame, returns: DataFrame) -> DataFrame:
    """Each valued return of the callee -> the call. go and defer calls have no result.

    A callee has as many returns as its text, so the join grows with the calls.
    """
    exits = returns.select(F.col("function").alias("callee"), F.col("instr_id").alias("ret")).distinct()
    waiting = calls.filter(F.col("mode") == "call").select("instr_id", "callee", "type", *_place(calls))
    return waiting.join(exits, "callee").select(*_edge("ret", "instr_id", "return", F.lit(RESULT_LABEL), F.col("type")), *_place(calls))


def return_aliases(calls: DataFrame, returns: DataFrame, extracts: DataFrame) -> DataFrame:
    """Return value i = call result (one result) or its extract i (several)."""
    width = returns.groupBy("function", "instr_id").agg(F.count(F.lit(1)).alias("n"))
    results = returns.join(width, ["function", "instr_id"]).select(
        F.col("function").alias("callee"), "n", "idx", F.col("value_id").alias("returned")
    )
    waiting = calls.filter(F.col("mode") == "call").select(F.col("instr_id").alias("call"), "callee", F.col("value_id").alias("result"))
    matched = waiting.join(results, "callee")
    single = matched.filter("n = 1").select(F.col("returned").alias("value_a"), F.col("result").alias("value_b"))
    several = matched.filter("n > 1").join(
        extracts.select(F.col("instr_id").alias("call"), "idx", F.col("value_id").alias("part")), ["call", "idx"]
    ).select(F.col("returned").alias("value_a"), F.col("part").alias("value_b"))
    return single.unionByName(several).distinct()


def capture_edges(captures: DataFrame, free_vars: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closure binding i -> free variable i: edges and alias pairs."""
    bound = captures.join(
        free_vars.select("function", "idx", F.col("value_id").alias("free"), F.col("node").alias("free_node")), ["function", "idx"]
    )
    edges = bound.join(values.select("value_id", "node", "label", "type"), "value_id").select(
        *_edge("node", "free_node", "call", F.col("label"), F.col("type")), *_place(captures)
    )
    return edges, bound.select(F.col("value_id").alias("value_a"), F.col("free").alias("value_b"))


def _may_alias(values: DataFrame) -> DataFrame:
    return values.filter(F.col("is_channel") | F.col("is_pointer")).select("value_id")


def _aliasing(alias_links: DataFrame, may: DataFrame) -> DataFrame:
    """The links whose both ends are in ``may``."""
    return alias_links.join(may.select(F.col("value_id").alias("value_a")), "value_a", "left_semi").join(
        may.select(F.col("value_id").alias("value_b")), "value_b", "left_semi"
    ).select("value_a", "value_b")


def _merged_roots(links: DataFrame) -> DataFrame:
    """(value_id, root) of the values that another one names: the smallest id of their class."""
    classes = component_roots(links.select(F.col("value_a").alias("a"), F.col("value_b").alias("b")))
    names = classes.groupBy("root").agg(F.min("id").alias("name"))
    named = classes.join(names, "root").select(F.col("id").alias("value_id"), F.col("name").alias("root"))
    return named.filter(F.col("value_id") != F.col("root"))


def _every_root(values: DataFrame, merged: DataFrame) -> DataFrame:
    return values.select("value_id").join(merged, "value_id", "left").select("value_id", F.coalesce("root", "value_id").alias("root"))


def alias_roots(values: DataFrame, alias_links: DataFrame) -> DataFrame:
    """(value_id, root): classes over links whose both ends are channels or pointers; the smallest id names a class."""
    return _every_root(values, _merged_roots(_aliasing(alias_links, _may_alias(values))))


def address_keys(addr_paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(value_id, addr_key): root of the base, then its field and constant-index steps.

    ``addr_paths``: value_id, base, step. A value without a path is its own anchor.
    Steps are joined by doubling, so the rounds are logarithmic in the nesting. A
    class whose members were reached by several paths keeps the path of its root.
    """
    return _every_key(roots, _root_keys(addr_paths, roots))


def _every_key(roots: DataFrame, keys: DataFrame) -> DataFrame:
    return roots.join(keys, "root", "left").select("value_id", F.coalesce("addr_key", "root").alias("addr_key"))


def _root_keys(addr_paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, addr_key) of the roots that have a path. A value that ``roots`` does not list is its own root."""
    anchored = (
        addr_paths.join(roots.select("value_id", F.col("root").alias("at")), "value_id", "left")
        .withColumn("at", F.coalesce("at", "value_id"))
        .filter(F.col("at") == F.col("value_id"))
        .join(roots.select(F.col("value_id").alias("base"), F.col("root").alias("base_root")), "base", "left")
        .select("at", F.coalesce("base_root", "base").alias("up"), F.col("step").alias("path"))
    )
    paths, n = write_table(anchored)
    for _round in range(n.bit_length() + 2):
        above = paths.select(F.col("at").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        longer = paths.join(above, "up", "left").select(
            "at", F.coalesce("up2", "up").alias("up"), F.concat(F.coalesce("path2", F.lit("")), "path").alias("path"),
            F.col("up2").isNotNull().alias("moved"),
        )
        table = materialize(longer)
        paths = table.select("at", "up", "path")
        if table.filter("moved").isEmpty():
            break
    else:
        # Doubling passes any chain of n steps by now, so this one has no end.
        raise ValueError("an address path leads back to itself")
    return paths.select(F.col("at").alias("root"), F.concat("up", "path").alias("addr_key"))


def _hubs(ops: DataFrame, kind: str, label: Column) -> tuple[DataFrame, DataFrame]:
    """Hub nodes and edges for (key, node, into, label, type): writer -> hub -> reader.

    Writers times readers of one key is quadratic in a hot key, so the pairs are not
    written out: a hub node of the same key carries them in linear space. The hub is a
    helper and its outgoing belts pass kind and type on (their type is null), so
    contracting helpers gives exactly the writer -> reader edges, and roll-ups count
    them per side. Keys without both sides have no route.
    """
    ops = materialize(ops.select("key", "node", "into", F.when(F.col("into"), label).otherwise("").alias("label"), "type"))  # read twice
    sides = ops.groupBy("key").agg(
        F.count_if("into").alias("n_in"), F.count_if(~F.col("into")).alias("n_out")
    ).filter((F.col("n_in") > 0) & (F.col("n_out") > 0))
    hub = F.concat(F.lit(f"{kind}:"), "key")
    nodes = sides.select(hub.alias("id"), "key", "n_in", "n_out", (F.col("n_in") * F.col("n_out")).alias("routes"))
    # Rows are made distinct while they still lie by key, so that they need not move again.
    live = ops.join(sides.select("key"), "key", "left_semi").select(
        "key", "node", F.coalesce("into", F.lit(False)).alias("into"), "label", F.when(F.col("into"), F.col("type")).alias("type")
    ).distinct()
    edges = live.select(
        F.when(F.col("into"), F.col("node")).otherwise(hub).alias("src"),
        F.when(F.col("into"), hub).otherwise(F.col("node")).alias("dst"),
        F.when(F.col("into"), kind).otherwise("belt").alias("kind"),
        "label", "type",
    )
    return nodes, edges


def memory_edges(mem_ops: DataFrame, keys: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stores and loads of one address key, joined through a hub per key.

    ``mem_ops``: instr_id, rw (store, load), address, payload. Every load may see
    every store of its key: the conservative reading.
    """
    types = values.select(F.col("value_id").alias("payload"), "type")
    ops = (
        mem_ops.join(keys.select(F.col("value_id").alias("address"), "addr_key"), "address", "left")
        .join(types, "payload", "left")
        .select(
            F.coalesce("addr_key", "address").alias("key"), F.col("instr_id").alias("node"),
            (F.col("rw") == "store").alias("into"), F.coalesce("type", F.lit("")).alias("type"),
        )
    )
    return _hubs(ops, "memory", F.lit(MEMORY_LABEL))


def channel_routes(channel_ops: DataFrame, roots: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sends and receives of one channel identity (root, never the name), joined through a hub.

    ``channel_ops``: instr_id, dir (send, recv), channel, payload.
    """
    channels = values.select(F.col("value_id").alias("channel"), F.col("label").alias("channel_label"))
    payloads = values.select(F.col("value_id").alias("payload"), "type")
    ops = (
        channel_ops.join(roots.select(F.col("value_id").alias("channel"), "root"), "channel", "left")
        .join(channels, "channel", "left")
        .join(payloads, "payload", "left")
        .select(
            F.coalesce("root", "channel").alias("key"), F.col("instr_id").alias("node"), (F.col("dir") == "send").alias("into"),
            F.coalesce("channel_label", "channel").alias("label"), F.coalesce("type", F.lit("")).alias("type"),
        )
    )
    return _hubs(ops, "train", F.col("label"))


def expand_hubs(hubs: DataFrame, edges: DataFrame, max_edges: int | None = None, salts: int = 64) -> DataFrame:
    """Writer -> reader edges of every hub, for graphs small enough to list them.

    The exact number of pairs is known from the hubs; past ``max_edges``, if given, this
    raises and writes nothing. Readers are spread over salts so a hub fills several tasks.
    """
    total = 0 if max_edges is None else hubs.agg(F.sum(F.col("routes").cast("double"))).first()[0] or 0
    if max_edges is not None and total > max_edges:
        raise ValueError(f"{total:.0f} routes, limit {max_edges}: keep the hub form")
    ids = hubs.select(F.col("id").alias("hub"))
    into = edges.join(ids.withColumnRenamed("hub", "dst"), "dst", "left_semi").select(
        F.col("dst").alias("hub"), "src", "kind", "label", "type", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    )
    out = edges.join(ids.withColumnRenamed("hub", "src"), "src", "left_semi").select(
        F.col("src").alias("hub"), "dst", F.pmod(F.xxhash64("dst"), F.lit(salts)).cast("int").alias("salt")
    )
    return into.join(out, ["hub", "salt"]).filter(F.col("src") != F.col("dst")).select("src", "dst", "kind", "label", "type")


def resolve_memory(
    values: DataFrame, alias_links: DataFrame, addr_paths: DataFrame, mem_ops: DataFrame, every: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Alias classes (value_id, root) and address keys (value_id, addr_key) at their joint fixpoint.

    A load aliases what was stored at its address, which may merge addresses in turn.
    The rounds stop when no class changes. Within a key all payloads are linked to one
    representative: linear, not all pairs. Rounds move only what can alias, and the values that another one names;
    without ``every`` the results hold these alone (``memory_edges`` and ``channel_routes`` take a value that is not listed as itself).
    """
    may = materialize(_may_alias(values))
    known = values.select("value_id")
    able = may.distinct().select(F.col("value_id").alias("payload"), F.lit(True).alias("able"))
    ops = materialize(
        mem_ops.select("address", "payload", "rw").join(known.withColumnRenamed("value_id", "address"), "address", "left_semi")
        .join(able, "payload", "left").withColumn("able", F.coalesce("able", F.lit(False)))
    )
    links, found = write_table(_aliasing(alias_links, may).distinct())
    while True:
        merged = materialize(_merged_roots(links))
        by_root = materialize(_root_keys(addr_paths, merged))
        keys = by_root.withColumnRenamed("root", "value_id").join(merged, "value_id", "left_anti").unionByName(_every_key(merged, by_root))
        keyed = ops.join(keys.withColumnRenamed("value_id", "address"), "address", "left").select(
            F.coalesce("addr_key", "address").alias("addr_key"), "payload", "able", "rw"
        )
        first = F.min(F.when(F.col("payload").isNotNull(), F.struct("payload", "able"))).alias("first")
        met = keyed.groupBy("addr_key").agg(
            first, F.count_if(F.col("rw") == "store").alias("w"), F.count_if(F.col("rw") == "load").alias("r")
        ).filter("w > 0 AND r > 0 AND first.able").select("addr_key", F.col("first.payload").alias("value_b"))
        star = keyed.filter("able").join(met, "addr_key").select(F.col("payload").alias("value_a"), "value_b")
        more, now = write_table(links.unionByName(star.filter("value_a <> value_b")).distinct())
        if now == found:
            break
        links, found = more, now
    if not every:
        return merged, materialize(keys.join(known, "value_id", "left_semi"))
    roots = materialize(_every_root(values, merged))
    return roots, materialize(_every_key(roots, by_root))


def escaped_values(*families: DataFrame) -> DataFrame:
    """Values that were sent, stored, returned or passed: each family has a value_id."""
    merged = families[0].select("value_id")
    for f in families[1:]:
        merged = merged.unionByName(f.select("value_id"))
    return merged.filter(F.col("value_id").isNotNull()).distinct()


def end_of_use(
    values: DataFrame, operands: DataFrame, instructions: DataFrame, escaped: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """A trash node after the last use of each named, non-escaping, non-channel value.

    ``values``: value_id, node, function, package, block, ord, label, type, names,
    is_channel. The last use lies in the same function, later than the definition;
    a value never used there ends at itself.
    """
    ending = values.filter((F.size("names") > 0) & ~F.col("is_channel")).join(escaped, "value_id", "left_anti")
    # Operands meet the values first: those of values that do not end here need not meet their instructions.
    uses = operands.select("instr_id", "value_id").join(
        ending.select("value_id", "function", F.col("ord").alias("born")), "value_id"
    )
    last = (
        uses.join(instructions.select("instr_id", "function", "block", "ord"), ["instr_id", "function"])
        .filter(F.col("ord") > F.col("born"))
        .groupBy("value_id")
        .agg(F.max(F.struct("ord", "instr_id", "block")).alias("last"))
    )
    closed = ending.join(last, "value_id", "left").select(
        "value_id", "function", "package", "label", "type",
        F.coalesce("last.instr_id", "node").alias("src"),
        F.coalesce("last.block", "block").alias("block"),
        (F.coalesce("last.ord", "ord") + 1).alias("ord"),
        F.concat(F.lit("trash:"), "value_id").alias("id"),
    )
    nodes = closed.select(
        "id", F.lit("trash").alias("kind"), F.concat(F.lit("Утилизация · "), "label").alias("label"),
        "function", "package", "type", "block", "ord",
    )
    edges = closed.select("src", F.col("id").alias("dst"), F.lit("disposal").alias("kind"), "label", "type")
    return nodes, edges
