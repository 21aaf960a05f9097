"""Queries for linking and classification over the derived facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregate as A
from ..operators import classify as K
from ..operators import linking as L
from ..operators import views as V
from . import facts as D
from . import graphs as G
from .registry import query


@query("operand_edges", D.with_calls("""
SELECT v.value_id AS src, a.instr_id AS dst, 'belt' AS kind, v.label, v.type FROM call_args a JOIN vals v USING (value_id)"""))
def _(spark, d):
    return L.operand_edges(D.call_args(spark, d), D.values(spark, d))


@query("argument_edges", D.with_calls("""
SELECT a.value_id AS src, callee || '.p' || p.idx AS dst, 'call' AS kind, v.label || ' → arg' || p.idx AS label, v.type
FROM calls c JOIN call_args a USING (instr_id) JOIN params p ON p.function = c.callee AND p.idx = a.idx JOIN vals v USING (value_id)"""))
def _(spark, d):
    return L.argument_edges(D.calls(spark, d), D.call_args(spark, d), D.params(spark, d), D.values(spark, d))


@query("invocation_edges", D.with_calls("""
SELECT instr_id AS src, callee || '.i' || first AS dst, 'call' AS kind, 'вызов' AS label, '' AS type
FROM calls JOIN (SELECT 'fn.' || l_suppkey AS callee, min(l_partkey) AS first FROM lineitem GROUP BY l_suppkey) USING (callee)
WHERE callee NOT IN (SELECT function FROM params)"""))
def _(spark, d):
    return L.invocation_edges(D.calls(spark, d), D.params(spark, d), D.callee_instructions(spark, d))


@query("return_edges", D.with_calls("""
SELECT DISTINCT callee || '.ret' AS src, instr_id AS dst, 'return' AS kind, 'результат' AS label, type
FROM calls JOIN rets ON function = callee WHERE mode = 'call'"""))
def _(spark, d):
    return L.return_edges(D.calls(spark, d), D.returns(spark, d))


@query("return_aliases", D.with_calls("""
SELECT DISTINCT callee || '.v' || r.idx AS value_a, CASE WHEN n = 1 THEN 'r.' || instr_id ELSE instr_id || '#' || r.idx END AS value_b
FROM calls c JOIN rets r ON function = callee
WHERE mode = 'call' AND (n = 1 OR r.idx < 2)"""))
def _(spark, d):
    return L.return_aliases(D.calls(spark, d), D.returns(spark, d), D.extracts(spark, d))


def _captures(spark, d):
    bound = D.call_args(spark, d).join(D.calls(spark, d).select("instr_id", F.col("callee").alias("function")), "instr_id")
    free = D.params(spark, d).withColumn("value_id", F.col("node"))
    return L.capture_edges(bound, free, D.values(spark, d))


@query("capture_edges", D.with_calls("""
SELECT v.value_id AS src, callee || '.p' || p.idx AS dst, 'call' AS kind, v.label, v.type
FROM calls c JOIN call_args a USING (instr_id) JOIN params p ON p.function = c.callee AND p.idx = a.idx JOIN vals v USING (value_id)"""))
def _(spark, d):
    return _captures(spark, d)[0]


@query("capture_aliases", D.with_calls("""
SELECT a.value_id AS value_a, callee || '.p' || p.idx AS value_b
FROM calls c JOIN call_args a USING (instr_id) JOIN params p ON p.function = c.callee AND p.idx = a.idx"""))
def _(spark, d):
    return _captures(spark, d)[1]


@query("alias_roots", f"WITH RECURSIVE {D.CHANNEL_SQL} SELECT value_id, root FROM roots UNION ALL SELECT DISTINCT 'x.' || event_type, 'x.' || event_type FROM events")
def _(spark, d):
    return L.alias_roots(D.channel_values(spark, d), D.channel_links(spark, d))


def _routes(spark, d):
    values = D.channel_values(spark, d)
    return L.channel_routes(D.channel_ops(spark, d), L.alias_roots(values, D.channel_links(spark, d)), values)


ROUTE_SQL = f"""WITH RECURSIVE {D.CHANNEL_SQL},
keyed AS (SELECT ops.*, root FROM ops JOIN roots ON value_id = channel),
live AS (SELECT root, count(*) FILTER (dir = 'send') AS n_in, count(*) FILTER (dir = 'recv') AS n_out FROM keyed GROUP BY root HAVING n_in > 0 AND n_out > 0)
"""


@query("channel_routes", ROUTE_SQL + """
SELECT DISTINCT instr_id AS src, 'train:' || root AS dst, 'train' AS kind, 'queue ' || (user_id % 3) AS label, 'msg.' || event_type AS type
FROM keyed JOIN live USING (root) WHERE dir = 'send'
UNION ALL
SELECT DISTINCT 'train:' || root, instr_id, 'belt', '', NULL FROM keyed JOIN live USING (root) WHERE dir = 'recv'""")
def _(spark, d):
    return _routes(spark, d)[1]


@query("channel_hubs", ROUTE_SQL + "SELECT 'train:' || root AS id, n_in, n_out, n_in * n_out AS routes FROM live")
def _(spark, d):
    return _routes(spark, d)[0].drop("key")


def _routed_graph(spark, d):
    """Operations of the channel facts in functions and packages of their own, with the hubs of their routes."""
    hubs, edges = _routes(spark, d)
    number = F.substring("instr_id", 2, 20).cast("bigint")
    operations = D.channel_ops(spark, d).select(
        F.col("instr_id").alias("id"), F.concat(F.lit("f."), number % 50).alias("function"), F.concat(F.lit("pkg."), number % 7).alias("package"),
        F.lit(False).alias("helper"), F.lit(None).cast("string").alias("role"),
    )
    empty = F.lit("")
    nodes = operations.unionByName(hubs.select(
        "id", empty.alias("function"), empty.alias("package"), F.lit(True).alias("helper"), F.lit("hub").alias("role")
    )).withColumns({"kind": F.lit("station"), "label": F.col("id"), "seq": F.xxhash64("id")})
    return nodes, edges.withColumn("seq", F.xxhash64("src", "dst"))


PAIR_SQL = ROUTE_SQL + """,
pairs AS (
  SELECT s.instr_id AS src, r.instr_id AS dst, 'msg.' || s.event_type AS type, substr(s.instr_id, 2)::BIGINT AS a, substr(r.instr_id, 2)::BIGINT AS b
  FROM keyed s JOIN keyed r USING (root) WHERE s.dir = 'send' AND r.dir = 'recv')
"""


@query("visible_graph_routes", PAIR_SQL + "SELECT src, dst, 'train' AS kind, type AS types FROM pairs")
def _(spark, d):
    links = V.visible_graph(*_routed_graph(spark, d))[1]
    return links.select("src", "dst", "kind", F.array_join("types", ",").alias("types"))


@query("package_overview_built", PAIR_SQL + """
SELECT 'pkg.' || (a % 7) AS src_package, 'pkg.' || (b % 7) AS dst_package, 'train' AS kind, count(*) AS n, array_to_string(list_sort(list(DISTINCT type)), ',') AS types
FROM pairs WHERE a % 7 <> b % 7 GROUP BY 1, 2""")
def _(spark, d):
    nodes, edges = _routed_graph(spark, d)
    functions = nodes.filter("package <> ''").select(F.col("function").alias("id"), "package").distinct()
    return A.package_overview(functions, nodes, edges)[1].withColumn("types", F.array_join("types", ","))


@query("function_graph_built", PAIR_SQL + """
SELECT id, other, sum(n)::DOUBLE AS weight FROM (
  SELECT 'f.' || (a % 50) AS id, 'f.' || (b % 50) AS other, count(*) AS n FROM pairs WHERE a % 50 <> b % 50 GROUP BY 1, 2
  UNION ALL SELECT 'f.' || (b % 50), 'f.' || (a % 50), count(*) FROM pairs WHERE a % 50 <> b % 50 GROUP BY 1, 2) GROUP BY 1, 2""")
def _(spark, d):
    return A.function_graph(*_routed_graph(spark, d))


@query("function_strength_built", PAIR_SQL + """,
w AS (SELECT id, other, sum(n) AS n FROM (
  SELECT 'f.' || (a % 50) AS id, 'f.' || (b % 50) AS other, count(*) AS n FROM pairs WHERE a % 50 <> b % 50 GROUP BY 1, 2
  UNION ALL SELECT 'f.' || (b % 50), 'f.' || (a % 50), count(*) FROM pairs WHERE a % 50 <> b % 50 GROUP BY 1, 2) GROUP BY 1, 2)
SELECT f AS id, count(n) AS degree, round(coalesce(sum(1 + log2(n)), 0), 4) AS strength
FROM (SELECT DISTINCT 'f.' || (substr(instr_id, 2)::BIGINT % 50) AS f FROM ops) LEFT JOIN w ON id = f GROUP BY f""")
def _(spark, d):
    """Strengths of functions from the factored form: no pair of functions is listed."""
    nodes, edges = _routed_graph(spark, d)
    functions = nodes.filter("function <> ''").select(F.col("function").alias("id")).distinct()
    return A.class_strength(functions, A.function_classes(nodes, edges)).withColumn("strength", F.round("strength", 4))


@query("contact_graph_counts", PAIR_SQL + """,
flows AS (SELECT least(a % 7, b % 7) AS x, greatest(a % 7, b % 7) AS y, count(*)::DOUBLE AS weight FROM pairs WHERE a % 7 <> b % 7 GROUP BY 1, 2)
SELECT 'pkg.' || x AS id, 'pkg.' || y AS other, weight FROM flows UNION ALL SELECT 'pkg.' || y, 'pkg.' || x, weight FROM flows""")
def _(spark, d):
    nodes, edges = _routed_graph(spark, d)
    functions = nodes.filter("package <> ''").select(F.col("function").alias("id"), "package").distinct()
    flows = A.package_overview(functions, nodes, edges)[1].withColumnsRenamed({"src_package": "src", "dst_package": "dst"})
    return A.contact_graph(functions.select(F.col("package").alias("id")).distinct(), flows)


def _addresses(spark, d):
    values = D.addr_values(spark, d)
    none = values.select(F.col("value_id").alias("value_a"), F.col("value_id").alias("value_b")).filter("value_a <> value_b")
    return L.address_keys(D.addr_paths(spark, d), L.alias_roots(values, none))


@query("address_keys", f"WITH {D.MEMORY_SQL.strip()}" + """,
base AS (SELECT p_partkey, CASE WHEN p_size > 10 THEN 'brand.' || p_brand || '[' || p_size || ']' ELSE 'a.' || p_partkey END AS key, p_size, p_brand FROM part)
SELECT DISTINCT 'a.' || l_partkey || '.f' || l_linenumber AS value_id, key || '.field' || l_linenumber AS addr_key
FROM lineitem JOIN base ON p_partkey = l_partkey
UNION ALL SELECT 'a.' || p_partkey, key FROM base WHERE p_size > 10 OR p_partkey IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT DISTINCT 'brand.' || p_brand, 'brand.' || p_brand FROM base WHERE p_size > 10""")
def _(spark, d):
    return _addresses(spark, d)


@query("memory_edges", f"WITH {D.MEMORY_SQL.strip()}" + """
SELECT DISTINCT CASE WHEN into_ THEN instr_id ELSE 'memory:' || key END AS src, CASE WHEN into_ THEN 'memory:' || key ELSE instr_id END AS dst,
  CASE WHEN into_ THEN 'memory' ELSE 'belt' END AS kind, CASE WHEN into_ THEN 'память' ELSE '' END AS label, CASE WHEN into_ THEN type END AS type
FROM live""")
def _(spark, d):
    return L.memory_edges(D.mem_ops(spark, d), _addresses(spark, d), D.values(spark, d))[1]


@query("resolve_memory", f"WITH {D.MEMORY_SQL.strip()}" + """
SELECT 'a.' || l_partkey || '.f' || l_linenumber AS value_id, min(key) AS addr_key
FROM live JOIN lines USING (instr_id) GROUP BY 1""")
def _(spark, d):
    ops = D.mem_ops(spark, d)
    values = D.addr_values(spark, d)
    none = values.select(F.col("value_id").alias("value_a"), F.col("value_id").alias("value_b")).filter("value_a <> value_b")
    _roots, keys = L.resolve_memory(values, none, D.addr_paths(spark, d), ops)
    hubs, edges = L.memory_edges(ops, keys, D.values(spark, d))
    used = ops.select("address").distinct().withColumnRenamed("address", "value_id")
    return keys.join(used, "value_id").join(hubs.select(F.col("key").alias("addr_key")), "addr_key", "left_semi").select("value_id", "addr_key")


@query("classify_calls", f"WITH {D.CLASSIFIED_SQL.strip()}" + """
SELECT cl.instr_id, coalesce(best.kind, 'machine') AS kind, coalesce(best.protocol, '') AS protocol,
  CASE WHEN value > 40 THEN 'go · ' WHEN value > 30 THEN 'defer · ' ELSE '' END ||
  CASE WHEN dispatch = 'static' THEN callee WHEN dispatch = 'builtin' AND name = 'delete' THEN 'delete · удалить'
       WHEN dispatch = 'builtin' AND name = 'close' THEN 'close · закрыть станцию' ELSE name END AS label,
  CASE WHEN best.pri IS NOT NULL THEN 'rule' WHEN dispatch = 'invoke' THEN 'Вызов через интерфейс: конкретная реализация статически не определена'
       WHEN dispatch = 'dynamic' THEN 'Динамический вызов: цель статически не определена' ELSE '' END AS reason
FROM cl LEFT JOIN best USING (instr_id)""")
def _(spark, d):
    calls = D.classified(spark, d)
    marked = calls.filter(F.col("callee").endswith(".7")).select(F.col("callee").alias("function")).distinct()
    directives = marked.withColumn("words", F.array(F.lit("rocket"), F.lit("webrtc")))
    done = K.classify_calls(calls, directives=directives)
    unresolved = F.col("reason").isin(K.INVOKE_REASON, K.DYNAMIC_REASON, "")
    return done.select("instr_id", "kind", "protocol", "label", F.when(unresolved, F.col("reason")).otherwise("rule").alias("reason"))


@query("call_identity", f"WITH {D.CLASSIFIED_SQL.strip()}" + """
SELECT CASE dispatch WHEN 'static' THEN callee WHEN 'invoke' THEN 'iface.' || et || '.' || name WHEN 'builtin' THEN 'builtin.' || name ELSE '' END AS method,
  count(*) AS calls FROM cl GROUP BY 1""")
def _(spark, d):
    return D.classified(spark, d).groupBy(K.call_identity().alias("method")).agg(F.count(F.lit(1)).alias("calls"))


OPS_SQL = f"""WITH ins AS (
  SELECT 'i' || event_id AS instr_id, 'user.' || user_id AS function, datediff('day', DATE '2024-01-01', ts::DATE) AS block, event_id AS pos,
    {D._sql_pick(D.OPS, 'event_id')} AS op, event_type, user_id, event_id % 4 = 0 AS named FROM events)
"""


@query("instruction_order", OPS_SQL + """
SELECT instr_id, row_number() OVER (PARTITION BY function ORDER BY block, pos) - 1 AS ord FROM ins WHERE op NOT IN ('jump', 'debugref')""")
def _(spark, d):
    return L.instruction_order(D.instructions(spark, d)).select("instr_id", "ord")


LABEL_SQL = OPS_SQL + """,
t AS (SELECT *, CASE WHEN named THEN event_type || ', x' ELSE 'Обработка' END AS plain, 'ch.' || user_id AS ch FROM ins),
labelled AS (
SELECT instr_id, named,
  CASE WHEN op IN ('recv', 'makechan', 'send', 'select') THEN 'station' WHEN op IN ('phi', 'if') THEN 'splitter' WHEN op = 'return' THEN 'output'
       WHEN op IN ('store', 'mapupdate') THEN 'memory' WHEN op = 'panic' THEN 'trash' ELSE 'machine' END AS kind,
  CASE op WHEN 'alloc' THEN 'Выделение памяти' WHEN 'binop' THEN CASE WHEN named THEN event_type || ', x · +' ELSE '+' END
    WHEN 'recv' THEN 'Получить · ' || ch WHEN 'makechan' THEN 'Канал · ' || ch WHEN 'send' THEN 'Отправить · ' || ch
    WHEN 'select' THEN 'Развязка select' WHEN 'phi' THEN 'Слияние · ' || ch WHEN 'if' THEN 'Условие' WHEN 'return' THEN 'Возврат'
    WHEN 'store' THEN 'Запись в память' WHEN 'mapupdate' THEN 'Запись в map' WHEN 'panic' THEN 'panic' ELSE plain END AS label,
  op IN ('alloc', 'unop', 'store', 'extract', 'fieldaddr', 'convert', 'slice') AS helper,
  CASE op WHEN 'panic' THEN 'Аварийное завершение пути исполнения' ELSE '' END AS reason
FROM t)
"""


@query("label_instructions", LABEL_SQL + "SELECT instr_id, kind, label, helper, reason FROM labelled")
def _(spark, d):
    return K.label_instructions(D.instructions(spark, d)).select("instr_id", "kind", "label", "helper", "reason")


@query("unhide_named", LABEL_SQL + "SELECT instr_id, helper AND NOT named AS helper FROM labelled")
def _(spark, d):
    return K.unhide_named(K.label_instructions(D.instructions(spark, d))).select("instr_id", "helper")


@query("value_names", """
WITH refs AS (SELECT 'u' || user_id AS value_id, CASE WHEN event_type = 'error' THEN '_' ELSE event_type END AS name, 1 AS late, event_id AS seq FROM events
  UNION ALL SELECT DISTINCT 'u' || user_id, 'self', 0, user_id FROM events),
firsts AS (SELECT value_id, name, min((late, seq)) AS seen FROM refs WHERE name <> '_' GROUP BY ALL)
SELECT value_id, string_agg(name, ', ' ORDER BY seen) AS label FROM firsts GROUP BY value_id""")
def _(spark, d):
    events = G.table(spark, d, "events")
    user = F.concat(F.lit("u"), "user_id")
    refs = events.select(
        user.alias("value_id"), F.when(F.col("event_type") == "error", "_").otherwise(F.col("event_type")).alias("name"),
        F.col("event_id").alias("seq"),
    )
    params = events.select(user.alias("value_id"), F.lit("self").alias("name"), F.col("user_id").alias("seq")).distinct()
    return L.value_names(refs, params).select("value_id", F.array_join("names", ", ").alias("label"))


@query("escaped_values", D.with_calls("""
SELECT value_id FROM call_args UNION SELECT function || '.v' || idx FROM rets UNION SELECT 'p' || l_partkey FROM lineitem WHERE l_returnflag = 'R'"""))
def _(spark, d):
    stored = D.mem_ops(spark, d).filter("rw = 'store'").select(F.col("payload").alias("value_id"))
    return L.escaped_values(D.call_args(spark, d), D.returns(spark, d), stored)


USE_SQL = """WITH uses AS (
  SELECT 'o' || l_orderkey AS value_id, l_orderkey, l_suppkey * 8 + l_linenumber AS ord,
    concat_ws('.', 'l', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS instr_id, l_linenumber AS block FROM lineitem),
vals AS (
  SELECT 'o' || o_orderkey AS value_id, o_orderpriority AS label, o_orderkey % 300 AS born FROM orders
  WHERE o_orderstatus <> 'F' AND 'o' || o_orderkey NOT IN (SELECT 'o' || l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
last AS (SELECT v.value_id, max((ord, instr_id, block)) AS m FROM vals v JOIN uses u ON u.value_id = v.value_id AND ord > born GROUP BY v.value_id),
done AS (SELECT v.*, m FROM vals v LEFT JOIN last USING (value_id))
"""


def _end_of_use(spark, d):
    orders = G.table(spark, d, "orders")
    values = orders.select(
        F.concat(F.lit("o"), "o_orderkey").alias("value_id"), F.concat(F.lit("o"), "o_orderkey").alias("node"),
        F.concat(F.lit("fn.o"), "o_orderkey").alias("function"), F.lit("trade").alias("package"), F.lit(0).alias("block"),
        (F.col("o_orderkey") % 300).alias("ord"), F.col("o_orderpriority").alias("label"), F.lit("order").alias("type"),
        F.when(F.col("o_orderstatus") == "F", F.array().cast("array<string>")).otherwise(F.array("o_orderpriority")).alias("names"),
        F.lit(False).alias("is_channel"),
    )
    lines = D.lines(spark, d)
    operands = lines.select("instr_id", F.concat(F.lit("o"), "l_orderkey").alias("value_id"))
    ins = lines.select(
        "instr_id", F.concat(F.lit("fn.o"), "l_orderkey").alias("function"), F.col("l_linenumber").alias("block"),
        (F.col("l_suppkey") * 8 + F.col("l_linenumber")).alias("ord"),
    )
    returned = lines.filter("l_returnflag = 'R'").select(F.concat(F.lit("o"), "l_orderkey").alias("value_id")).distinct()
    return L.end_of_use(values, operands, ins, returned)


@query("end_of_use_nodes", USE_SQL + """
SELECT 'trash:' || value_id AS id, 'trash' AS kind, 'Утилизация · ' || label AS label, coalesce(m[3], 0)::INT AS block, coalesce(m[1], born) + 1 AS ord FROM done"""
       .replace("m[3]", "struct_extract_at(m, 3)").replace("m[1]", "struct_extract_at(m, 1)"))
def _(spark, d):
    return _end_of_use(spark, d)[0].select("id", "kind", "label", "block", "ord")


@query("end_of_use_edges", USE_SQL + """
SELECT coalesce(struct_extract_at(m, 2), value_id) AS src, 'trash:' || value_id AS dst, 'disposal' AS kind, label, 'order' AS type FROM done""")
def _(spark, d):
    return _end_of_use(spark, d)[1]


@query("sql_write_verb", """
SELECT doc_id, upper(regexp_extract(text, '^\\s*([^\\s]+)', 1)) IN
  ('INSERT', 'UPDATE', 'DELETE', 'REPLACE', 'UPSERT', 'CREATE', 'ALTER', 'DROP', 'TRUNCATE') AS plain,
  doc_id % 3 = 0 AS written FROM documents""")
def _(spark, d):
    verbs = D._pick(["update ", "Selected ", "insertion "], F.col("doc_id"))
    return G.table(spark, d, "documents").select(
        "doc_id", S.sql_write_verb("text").alias("plain"), S.sql_write_verb(F.concat(F.lit(" \n"), verbs, "text")).alias("written")
    )


@query("parse_directives", """
SELECT 'd' || doc_id AS file_id, 'Doc' || doc_id AS function,
  CASE doc_id % 4 WHEN 0 THEN 'rocket ' || lang WHEN 1 THEN 'warehouse' ELSE 'trash ' || source END AS words
FROM documents WHERE doc_id % 4 < 3""")
def _(spark, d):
    return K.parse_directives(_commented(spark, d)).select("file_id", "function", F.array_join("words", " ").alias("words"))


def _commented(spark, d):
    """A source file per document: its text as comments, a directive block of one of four kinds, a method."""
    kind = F.col("doc_id") % 4
    block = (
        F.when(kind == 0, F.concat(F.lit("//flow:rocket "), "lang", F.lit("\n// note\n")))
        .when(kind == 1, "//flow:other\n// flow:warehouse\n")
        .when(kind == 2, F.concat(F.lit("//flow:rocket x\n//flow:trash  "), "source", F.lit("\n")))
        .otherwise("//flow:rocket\n\n// a blank line ends the block\n")
    )
    body = F.concat(F.lit("// "), F.regexp_replace("text", "\n", "\n// "), F.lit("\n\n"))
    content = F.concat(body, block, F.lit("func (r *T) Doc"), F.col("doc_id"), F.lit("(x int) {\n}\n"))
    return G.table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file_id"), content.alias("content"))


@query("classify_with_directives", """
SELECT 'c' || doc_id AS instr_id, CASE doc_id % 4 WHEN 0 THEN 'rocket' WHEN 1 THEN 'warehouse' WHEN 2 THEN 'trash' ELSE 'machine' END AS kind,
  CASE doc_id % 4 WHEN 0 THEN lang WHEN 2 THEN source ELSE '' END AS protocol
FROM documents""")
def _(spark, d):
    docs, name = G.table(spark, d, "documents"), F.concat(F.lit("Doc"), F.col("doc_id"))
    # Lines of the commented text, a blank one, the block of two or three lines, then the method.
    line = F.size(F.split("text", "\n")) + 1 + F.when(F.col("doc_id") % 4 == 3, 3).otherwise(2) + 1
    functions = docs.select(
        F.concat(F.lit("p."), F.col("doc_id") % 5, F.lit("."), name).alias("id"),
        F.struct(F.concat(F.lit("d"), "doc_id").alias("file"), line.alias("line")).alias("source"), "doc_id",
    )
    marks = K.directive_functions(K.parse_directives(_commented(spark, d)), functions)
    text = lambda v: F.lit(v)
    calls = functions.select(
        F.concat(F.lit("c"), "doc_id").alias("instr_id"), F.col("id").alias("callee"), text("app/local").alias("callee_pkg"), text("Do").alias("callee_name"),
        text("").alias("signature"), text("static").alias("dispatch"), text("call").alias("mode"), F.array().cast("array<string>").alias("const_args"),
    )
    return K.classify_calls(calls, directives=marks).select("instr_id", "kind", "protocol")
