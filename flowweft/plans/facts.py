"""Fact tables derived from the driver tables: a program of calls, values and channels.

Each line item is a call of its supplier's function with the part and the order as
arguments; line items also read or write addresses inside their brand; events send
to and receive from their user's channel.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .graphs import table

# Parameters of the derived calls: every package and name a rule looks at, and some it must not.
PACKAGES = [
    "net/http", "google.golang.org/grpc", "github.com/gorilla/websocket", "github.com/pion/webrtc/v4", "database/sql",
    "github.com/jackc/pgx/v5", "gorm.io/gorm", "go.mongodb.org/mongo-driver/mongo", "github.com/redis/go-redis/v9", "app/local",
]
NAMES = ["Do", "Invoke", "WriteMessage", "SendText", "ExecContext", "QueryRow", "Save", "InsertOne", "HSet", "Send", "Close"]
BUILTIN_NAMES = ["delete", "close", "len", "append"]
QUERIES = ["  insert into t values (1)", "Select 1", "\tUPDATE t SET a = 1", "", "drop table t", "selected"]
OPS = [
    "alloc", "binop", "recv", "unop", "makechan", "send", "select", "phi", "if", "return", "store", "mapupdate", "panic",
    "extract", "fieldaddr", "call", "jump", "debugref", "convert", "slice",
]


def _pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _sql_pick(values, n):
    return "[" + ", ".join("'" + v + "'" for v in values) + f"][({n}) % {len(values)} + 1]"


def line_id():
    return F.concat_ws(".", F.lit("l"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def lines(spark, d):
    return table(spark, d, "lineitem").withColumn("instr_id", line_id())


def values(spark, d):
    """Parts and orders as values: value_id, node, label, type."""
    parts = table(spark, d, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("value_id"), F.col("p_name").alias("label"), F.col("p_type").alias("type")
    )
    orders = table(spark, d, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("value_id"), F.col("o_orderpriority").alias("label"), F.lit("order").alias("type")
    )
    return parts.unionByName(orders).withColumn("node", F.col("value_id"))


def calls(spark, d):
    flag = F.col("l_returnflag")
    return lines(spark, d).select(
        "instr_id", F.concat(F.lit("fn."), "l_suppkey").alias("callee"),
        F.when(flag == "A", "call").when(flag == "N", "go").otherwise("defer").alias("mode"),
        F.col("l_linestatus").alias("type"), F.concat(F.lit("r."), "instr_id").alias("value_id"),
    )


def call_args(spark, d):
    args = F.posexplode(F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("o"), "l_orderkey")))
    return lines(spark, d).select("instr_id", args.alias("idx", "value_id"))


def params(spark, d):
    n = (F.col("s_suppkey") % 4).cast("int")
    fn = F.concat(F.lit("fn."), "s_suppkey")
    return table(spark, d, "supplier").filter(n > 0).select(
        fn.alias("function"), F.explode(F.sequence(F.lit(0), n - 1)).alias("idx")
    ).select(
        "function", "idx", F.concat_ws(".", "function", F.concat(F.lit("p"), "idx")).alias("node"),
        F.concat(F.lit("arg"), "idx").alias("name"),
    )


def callee_instructions(spark, d):
    return lines(spark, d).select(
        F.concat(F.lit("fn."), "l_suppkey").alias("function"), F.col("l_partkey").alias("ord")
    ).distinct().withColumn("instr_id", F.concat_ws(".", "function", F.concat(F.lit("i"), "ord")))


def returns(spark, d):
    n = (F.col("s_suppkey") % 4).cast("int")
    fn = F.concat(F.lit("fn."), "s_suppkey")
    return table(spark, d, "supplier").filter(n > 0).select(
        fn.alias("function"), F.concat(fn, F.lit(".ret")).alias("instr_id"), F.explode(F.sequence(F.lit(0), n - 1)).alias("idx")
    ).withColumn("value_id", F.concat(F.col("function"), F.lit(".v"), F.col("idx")))


def extracts(spark, d):
    return lines(spark, d).select(
        "instr_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("idx")
    ).withColumn("value_id", F.concat_ws("#", "instr_id", "idx"))


CALL_SQL = f"""
lines AS (SELECT concat_ws('.', 'l', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS instr_id, * FROM lineitem),
vals AS (
  SELECT 'p' || p_partkey AS value_id, p_name AS label, p_type AS type FROM part
  UNION ALL SELECT 'o' || o_orderkey, o_orderpriority, 'order' FROM orders),
calls AS (
  SELECT instr_id, 'fn.' || l_suppkey AS callee, CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'go' ELSE 'defer' END AS mode,
    l_linestatus AS type FROM lines),
call_args AS (SELECT instr_id, 0 AS idx, 'p' || l_partkey AS value_id FROM lines UNION ALL SELECT instr_id, 1, 'o' || l_orderkey FROM lines),
params AS (SELECT 'fn.' || s_suppkey AS function, unnest(range(s_suppkey % 4)) AS idx FROM supplier),
rets AS (SELECT 'fn.' || s_suppkey AS function, s_suppkey % 4 AS n, unnest(range(s_suppkey % 4)) AS idx FROM supplier)
"""


def with_calls(sql: str) -> str:
    return f"WITH RECURSIVE {CALL_SQL.strip()}{'' if sql.lstrip().startswith('SELECT') else ','}\n{sql.strip()}"


def classified(spark, d):
    """Calls from events, covering every rule, dispatch and mode."""
    e, id_, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    builtin = e == "error"
    return table(spark, d, "events").select(
        F.concat(F.lit("call."), "event_id").alias("instr_id"),
        F.concat_ws(".", _pick(PACKAGES, id_), _pick(NAMES, user), (user % 50).cast("string")).alias("callee"),
        F.when(builtin, "").otherwise(_pick(PACKAGES, id_)).alias("callee_pkg"),
        F.when(builtin, _pick(BUILTIN_NAMES, id_)).otherwise(_pick(NAMES, user)).alias("callee_name"),
        F.when((id_ % 11 == 0) & ~builtin, "func(opts ...google.golang.org/grpc.CallOption)").otherwise("func()").alias("signature"),
        F.when(builtin, "builtin").when(e == "view", "invoke").when(e == "click", "dynamic").otherwise("static").alias("dispatch"),
        F.when(F.col("value") > 40, "go").when(F.col("value") > 30, "defer").otherwise("call").alias("mode"),
        F.array(_pick(QUERIES, id_)).alias("const_args"),
        F.concat(F.lit("iface."), "event_type").alias("receiver_type"),
    )


CLASSIFIED_SQL = f"""
ev AS (
  SELECT 'call.' || event_id AS instr_id, event_type AS et, event_id,
    {_sql_pick(PACKAGES, 'event_id')} AS p0, {_sql_pick(NAMES, 'user_id')} AS n0, user_id % 50 AS u,
    {_sql_pick(BUILTIN_NAMES, 'event_id')} AS b0, {_sql_pick(QUERIES, 'event_id')} AS q, value,
    event_id % 11 = 0 AND event_type <> 'error' AS sig
  FROM events),
cl AS (
  SELECT *, CASE WHEN et = 'error' THEN '' ELSE p0 END AS pkg, CASE WHEN et = 'error' THEN b0 ELSE n0 END AS name,
    p0 || '.' || n0 || '.' || u AS callee,
    CASE et WHEN 'error' THEN 'builtin' WHEN 'view' THEN 'invoke' WHEN 'click' THEN 'dynamic' ELSE 'static' END AS dispatch
  FROM ev),
rules AS (FROM (VALUES
  (1, 'rocket', 'http', 'net/http', ['Do']), (2, 'rocket', 'grpc', 'google.golang.org/grpc', ['Invoke', 'Send']),
  (3, 'rocket', 'websocket', 'gorilla/websocket', ['WriteMessage', 'Send']), (4, 'rocket', 'webrtc', 'pion/webrtc', ['SendText', 'Send']),
  (5, 'warehouse', 'sql', 'database/sql', ['ExecContext']), (5, 'warehouse', 'sql', 'jackc/pgx', ['ExecContext']),
  (7, 'warehouse', 'gorm', 'gorm.io/gorm', ['Save']), (8, 'warehouse', 'mongodb', 'go.mongodb.org/mongo-driver', ['InsertOne']),
  (9, 'warehouse', 'redis', 'github.com/redis/go-redis', ['HSet'])) t(pri, kind, protocol, part, names)),
hits AS (
  SELECT instr_id, pri, kind, protocol FROM cl JOIN rules ON contains(pkg, part) AND list_contains(names, name)
  UNION ALL SELECT instr_id, 2, 'rocket', 'grpc' FROM cl WHERE sig AND name <> 'Close'
  UNION ALL SELECT instr_id, 6, 'warehouse', 'sql' FROM cl
    WHERE (pkg = 'database/sql' OR contains(pkg, 'jackc/pgx')) AND name = 'QueryRow'
      AND upper(string_split_regex(regexp_replace(q, '^\\s+', ''), '\\s+')[1]) IN ('INSERT', 'UPDATE', 'DROP')
  UNION ALL SELECT instr_id, 0, 'rocket', 'webrtc' FROM cl WHERE dispatch = 'static' AND u = 7
  UNION ALL SELECT instr_id, 1, CASE name WHEN 'delete' THEN 'trash' WHEN 'close' THEN 'station' ELSE 'machine' END, '' FROM cl WHERE dispatch = 'builtin'),
best AS (SELECT instr_id, arg_min(kind, pri) AS kind, arg_min(protocol, pri) AS protocol, min(pri) AS pri FROM hits GROUP BY instr_id)
"""


def instructions(spark, d):
    """Event instructions: function = user, block = UTC day of the event, pos = event id."""
    id_ = F.col("event_id")
    op = _pick(OPS, id_)
    return table(spark, d, "events").select(
        F.concat(F.lit("i"), "event_id").alias("instr_id"), F.concat(F.lit("user."), "user_id").alias("function"),
        F.datediff("ts", F.lit("2024-01-01")).alias("block"), id_.alias("pos"), op.alias("op"), F.lit("+").alias("operator"),
        F.concat(F.lit("ch."), "user_id").alias("of_label"),
        F.when(id_ % 4 == 0, F.array("event_type", F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("names"),
    )


def channel_ops(spark, d):
    e = F.col("event_type")
    return table(spark, d, "events").filter(e != "error").select(
        F.concat(F.lit("i"), "event_id").alias("instr_id"),
        F.when(e.isin("purchase", "signup"), "send").otherwise("recv").alias("dir"),
        F.concat(F.lit("ch."), "user_id").alias("channel"), F.concat(F.lit("x."), "event_type").alias("payload"),
    )


def channel_values(spark, d):
    users = table(spark, d, "events").select("user_id").distinct()
    channels = users.select(
        F.concat(F.lit("ch."), "user_id").alias("value_id"), F.concat(F.lit("queue "), F.col("user_id") % 3).alias("label"),
        F.lit("chan").alias("type"), (F.col("user_id") % 7 != 0).alias("is_channel"), F.lit(False).alias("is_pointer"),
    )
    payloads = table(spark, d, "events").select("event_type").distinct().select(
        F.concat(F.lit("x."), "event_type").alias("value_id"), F.col("event_type").alias("label"),
        F.concat(F.lit("msg."), "event_type").alias("type"), F.lit(False).alias("is_channel"), F.lit(False).alias("is_pointer"),
    )
    return channels.unionByName(payloads)


def channel_links(spark, d):
    """Aliases chain each user's channel to the user two below, within blocks of ten."""
    users = table(spark, d, "events").select("user_id").distinct().filter(F.col("user_id") % 10 >= 2)
    return users.select(
        F.concat(F.lit("ch."), "user_id").alias("value_a"), F.concat(F.lit("ch."), F.col("user_id") - 2).alias("value_b")
    )


CHANNEL_SQL = """
ops AS (
  SELECT 'i' || event_id AS instr_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'send' ELSE 'recv' END AS dir,
    'ch.' || user_id AS channel, user_id, event_type FROM events WHERE event_type <> 'error'),
users AS (SELECT DISTINCT user_id AS u FROM events),
links AS (SELECT a.u AS x, b.u AS y FROM users a JOIN users b ON b.u = a.u - 2
          WHERE a.u % 10 >= 2 AND a.u % 7 <> 0 AND b.u % 7 <> 0),
ends AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT u AS start, u FROM users UNION SELECT start, y FROM reach JOIN ends ON x = reach.u),
roots AS (SELECT 'ch.' || start AS value_id, min('ch.' || u) AS root FROM reach GROUP BY start)
"""


def mem_ops(spark, d):
    return lines(spark, d).select(
        "instr_id", F.when(F.col("l_returnflag") == "R", "store").otherwise("load").alias("rw"),
        F.concat_ws(".", F.lit("a"), "l_partkey", F.concat(F.lit("f"), "l_linenumber")).alias("address"),
        F.concat(F.lit("p"), "l_partkey").alias("payload"),
    )


def addr_paths(spark, d):
    """Field of a part's address; large parts lie at a constant index inside their brand."""
    fields = lines(spark, d).select("l_partkey", "l_linenumber").distinct().select(
        F.concat_ws(".", F.lit("a"), "l_partkey", F.concat(F.lit("f"), "l_linenumber")).alias("value_id"),
        F.concat(F.lit("a."), "l_partkey").alias("base"), F.concat(F.lit(".field"), "l_linenumber").alias("step"),
    )
    inside = table(spark, d, "part").filter("p_size > 10").select(
        F.concat(F.lit("a."), "p_partkey").alias("value_id"), F.concat(F.lit("brand."), "p_brand").alias("base"),
        F.concat(F.lit("["), "p_size", F.lit("]")).alias("step"),
    )
    return fields.unionByName(inside)


def addr_values(spark, d):
    ids = addr_paths(spark, d)
    return ids.select("value_id").union(ids.select("base")).distinct().select(
        "value_id", F.lit(False).alias("is_channel"), F.lit(True).alias("is_pointer")
    )


MEMORY_SQL = """
lines AS (SELECT concat_ws('.', 'l', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS instr_id, * FROM lineitem),
keys AS (
  SELECT instr_id, l_returnflag = 'R' AS into_, p_type AS type,
    CASE WHEN p_size > 10 THEN 'brand.' || p_brand || '[' || p_size || ']' ELSE 'a.' || l_partkey END || '.field' || l_linenumber AS key
  FROM lines JOIN part ON l_partkey = p_partkey),
live AS (SELECT * FROM keys WHERE key IN (SELECT key FROM keys GROUP BY key HAVING bool_or(into_) AND NOT bool_and(into_)))
"""
