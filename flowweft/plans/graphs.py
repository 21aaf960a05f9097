"""Node and edge tables derived from the driver tables, in Spark and in SQL.

* trade graph: customers -> orders -> parts -> suppliers. Functions are nations and
  brands, packages are regions and the parts catalogue; pending orders and small
  parts are helpers.
* event graph: each event leads to the same user's next event of the same type, the
  last one back to the first. Many cycles, many components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numbering import with_next
from ..operators.aggregate import dedup_edges


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the file footers once per path."""
    path = f"{d}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def places(spark: SparkSession, d: str) -> DataFrame:
    package = F.concat(F.lit("trade/region/"), "r_name")
    return (
        table(spark, d, "nation")
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "n_nationkey", package.alias("package"), F.concat(package, F.lit("."), "n_name").alias("function"), "n_name"
        )
    )


def _node(id, kind, label, function, method, package, type, names, helper, seq):
    return [
        id.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), function.alias("function"),
        method.alias("method"), package.alias("package"), type.alias("type"), names.alias("names"),
        helper.alias("helper"), seq.alias("seq"), F.floor(seq / 4).cast("double").alias("ord"),
    ]


def trade_nodes(spark: SparkSession, d: str) -> DataFrame:
    place = places(spark, d)
    none, no = F.lit(""), F.lit(False)
    customer = table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    customers = customer.select(*_node(
        _key("c", "c_custkey"), "source", F.col("c_name"), F.col("function"), none, F.col("package"),
        F.col("c_mktsegment"), F.array("c_name"), no, F.col("c_custkey") * 4,
    ))
    owner = customer.select(F.col("c_custkey").alias("o_custkey"), "function", "package")
    orders = table(spark, d, "orders").join(owner, "o_custkey").select(*_node(
        _key("o", "o_orderkey"), "machine", F.col("o_orderpriority"), F.col("function"),
        F.concat(F.lit("priority."), "o_orderpriority"), F.col("package"), none, F.array().cast("array<string>"),
        F.col("o_orderstatus") == "P", F.col("o_orderkey") * 4 + 1,
    ))
    parts = table(spark, d, "part").select(*_node(
        _key("p", "p_partkey"), "station", F.col("p_name"), F.concat(F.lit("trade/parts."), "p_brand"), none,
        F.lit("trade/parts"), F.col("p_type"), F.split("p_name", " "), F.col("p_size") <= 5, F.col("p_partkey") * 4 + 2,
    ))
    suppliers = table(spark, d, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(*_node(
        _key("s", "s_suppkey"), "warehouse", F.col("s_name"), F.col("function"), none, F.col("package"),
        none, F.array("s_name"), no, F.col("s_suppkey") * 4 + 3,
    ))
    return customers.unionByName(orders).unionByName(parts).unionByName(suppliers)


def _edge(kind, src, dst, label, type, seq):
    return [
        F.concat(F.lit(f"{kind}:"), src, F.lit(">"), dst).alias("id"), src.alias("src"), dst.alias("dst"),
        F.lit(kind).alias("kind"), label.alias("label"), type.alias("type"), seq.alias("seq"),
    ]


def trade_raw_edges(spark: SparkSession, d: str) -> DataFrame:
    """One row per order and two per line, before deduplication."""
    orders = table(spark, d, "orders").select(*_edge(
        "belt", _key("c", "o_custkey"), _key("o", "o_orderkey"), F.col("o_orderpriority"), F.lit("order"),
        F.col("o_orderkey") * 16,
    ))
    line = F.col("l_orderkey") * 16 + F.col("l_linenumber") * 2
    lines = table(spark, d, "lineitem")
    calls = lines.select(*_edge(
        "call", _key("o", "l_orderkey"), _key("p", "l_partkey"), F.lit("line"), F.col("l_returnflag"), line,
    ))
    trains = lines.select(*_edge(
        "train", _key("p", "l_partkey"), _key("s", "l_suppkey"), F.lit("ship"), F.col("l_linestatus"), line + 1,
    ))
    return orders.unionByName(calls).unionByName(trains)


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges after deduplication; ids are made of what is equal then, so they need not move along."""
    raw = trade_raw_edges(spark, d)
    name = F.concat("kind", F.lit(":"), "src", F.lit(">"), "dst").alias("id")
    return dedup_edges(raw.drop("id")).withColumn("id", name).select(*raw.columns)


def trade_functions(spark: SparkSession, d: str) -> DataFrame:
    nations = places(spark, d).select(
        F.col("function").alias("id"), F.col("n_name").alias("name"), "package", F.lit("trade").alias("project"),
        F.col("n_nationkey").cast("bigint").alias("seq"),
    )
    brands = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("k")).select(
        F.concat(F.lit("trade/parts."), "p_brand").alias("id"), F.col("p_brand").alias("name"),
        F.lit("trade/parts").alias("package"), F.lit("catalogue").alias("project"), (F.col("k") + 1000).alias("seq"),
    )
    return nations.unionByName(brands)


def trade_projects(spark: SparkSession, d: str) -> DataFrame:
    return trade_functions(spark, d).select(F.col("project").alias("module")).distinct().withColumn(
        "path", F.concat(F.lit("/src/"), "module")
    )


TRADE_SQL = """
place AS (
  SELECT n_nationkey, n_name, 'trade/region/' || r_name AS package, 'trade/region/' || r_name || '.' || n_name AS function
  FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'c' || c_custkey AS id, 'source' AS kind, c_name AS label, function, '' AS method, package,
         c_mktsegment AS type, [c_name] AS names, false AS helper, c_custkey * 4 AS seq, c_custkey::DOUBLE AS ord
  FROM customer JOIN place ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'o' || o_orderkey, 'machine', o_orderpriority, function, 'priority.' || o_orderpriority, package,
         '', []::VARCHAR[], o_orderstatus = 'P', o_orderkey * 4 + 1, o_orderkey::DOUBLE
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN place ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'p' || p_partkey, 'station', p_name, 'trade/parts.' || p_brand, '', 'trade/parts',
         p_type, string_split(p_name, ' '), p_size <= 5, p_partkey * 4 + 2, p_partkey::DOUBLE
  FROM part
  UNION ALL
  SELECT 's' || s_suppkey, 'warehouse', s_name, function, '', package,
         '', [s_name], false, s_suppkey * 4 + 3, s_suppkey::DOUBLE
  FROM supplier JOIN place ON s_nationkey = n_nationkey),
raw_edges AS (
  SELECT 'belt:c' || o_custkey || '>o' || o_orderkey AS id, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst,
         'belt' AS kind, o_orderpriority AS label, 'order' AS type, o_orderkey * 16 AS seq FROM orders
  UNION ALL
  SELECT 'call:o' || l_orderkey || '>p' || l_partkey, 'o' || l_orderkey, 'p' || l_partkey, 'call', 'line',
         l_returnflag, l_orderkey * 16 + l_linenumber * 2 FROM lineitem
  UNION ALL
  SELECT 'train:p' || l_partkey || '>s' || l_suppkey, 'p' || l_partkey, 's' || l_suppkey, 'train', 'ship',
         l_linestatus, l_orderkey * 16 + l_linenumber * 2 + 1 FROM lineitem),
edges AS (
  SELECT * FROM raw_edges WHERE src <> dst
  QUALIFY row_number() OVER (PARTITION BY src, dst, kind, label ORDER BY seq, id, type) = 1),
functions AS (
  SELECT function AS id, n_name AS name, package, 'trade' AS project, n_nationkey::BIGINT AS seq FROM place
  UNION ALL
  SELECT 'trade/parts.' || p_brand, p_brand, 'trade/parts', 'catalogue', min(p_partkey) + 1000 FROM part GROUP BY p_brand)
"""

# Fixed by this derivation: what each event type stands for.
EVENT_KINDS = {"signup": "source", "view": "machine", "error": "trash", "purchase": "warehouse", "click": "splitter"}


def event_nodes(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in EVENT_KINDS.items() for x in kv])
    return table(spark, d, "events").select(
        _key("v", "event_id").alias("id"), kinds[F.col("event_type")].alias("kind"),
        F.col("event_type").alias("label"), _key("user.", "user_id").alias("function"), F.lit("").alias("method"),
        F.lit("events").alias("package"), F.lit("").alias("type"), F.array().cast("array<string>").alias("names"),
        (F.col("event_id") % 3 == 0).alias("helper"), F.col("event_id").alias("seq"),
        F.col("event_id").cast("double").alias("ord"),
    )


def event_edges(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    group = ["user_id", "event_type"]
    chained = with_next(events, group, [F.col("ts"), F.col("event_id")], {"event_id": "next_id"})
    first = events.groupBy(*group).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"))
    target = F.coalesce("next_id", "first_id")
    kind = F.when(F.col("event_type") == "purchase", "train").otherwise("belt")
    return (
        chained.join(first, group)
        .select(
            _key("t", "event_id").alias("id"), _key("v", "event_id").alias("src"),
            F.concat(F.lit("v"), target.cast("string")).alias("dst"), kind.alias("kind"),
            F.col("event_type").alias("label"), F.col("event_type").alias("type"), F.col("event_id").alias("seq"),
        )
        .filter(F.col("src") != F.col("dst"))
    )


EVENT_SQL = """
enodes AS (
  SELECT 'v' || event_id AS id,
         CASE event_type WHEN 'signup' THEN 'source' WHEN 'view' THEN 'machine' WHEN 'error' THEN 'trash'
              WHEN 'purchase' THEN 'warehouse' WHEN 'click' THEN 'splitter' END AS kind,
         event_type AS label, 'user.' || user_id AS function, 'events' AS package, '' AS type,
         event_id % 3 = 0 AS helper, event_id AS seq
  FROM events),
eedges AS (
  SELECT * FROM (
    SELECT 't' || event_id AS id, 'v' || event_id AS src,
           'v' || coalesce(lead(event_id) OVER w, first_value(event_id) OVER w) AS dst,
           CASE WHEN event_type = 'purchase' THEN 'train' ELSE 'belt' END AS kind,
           event_type AS label, event_type AS type, event_id AS seq
    FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
  WHERE src <> dst)
"""


def with_trade(sql: str) -> str:
    return f"WITH RECURSIVE {TRADE_SQL.strip()}{'' if sql.lstrip().startswith('SELECT') else ','}\n{sql.strip()}"


def with_events(sql: str) -> str:
    return f"WITH RECURSIVE {EVENT_SQL.strip()}{'' if sql.lstrip().startswith('SELECT') else ','}\n{sql.strip()}"
