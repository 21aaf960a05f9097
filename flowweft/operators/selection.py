"""Filters, searches, focus, listings and set operations on nodes and edges."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import search_text
from ..schema import LARGE_GRAPH_NODES, LAYERS, NODE_KINDS

SEARCHED = ["label", "function", "type", "names"]
INDEX_PARTS = 64


def edge_class() -> Column:
    """Layer of an edge: trains run on their own layer, all else is a belt."""
    return F.when(F.col("kind") == "train", "train").otherwise("belt")


def layer_filter(nodes: DataFrame, edges: DataFrame, hidden: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Drop nodes of hidden kinds and edges of hidden classes."""
    off = set(hidden)
    unknown = off - set(LAYERS)
    if unknown:
        raise ValueError(f"unknown layers: {sorted(unknown)}")
    kinds = sorted(off & set(NODE_KINDS))
    classes = sorted(off - set(NODE_KINDS))
    if kinds:
        nodes = nodes.filter(~F.col("kind").isin(kinds))
    if classes:
        edges = edges.filter(~edge_class().isin(classes))
    return nodes, edges


def drop_helpers(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.col("helper"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi"
    )


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids one link away, in either direction, from any of ``ids``."""
    both = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("at"), F.col("dst").alias("id")),
        F.struct(F.col("dst").alias("at"), F.col("src").alias("id")),
    )).alias("e")).select("e.*")
    return both.join(ids.select(F.col("id").alias("at")), "at", "left_semi").select("id").distinct()


def matching(nodes: DataFrame, query: str) -> DataFrame:
    return nodes.filter(search_text(SEARCHED).contains(query.strip().lower()))


def search_nodes(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """Nodes whose text holds ``query`` and their neighbours, within ``nodes``."""
    if not query.strip():
        return nodes
    hits = matching(nodes, query).select("id")
    return intersect_selection(nodes, hits.unionByName(neighbours(edges, hits)))


def _index_part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(INDEX_PARTS)).cast("int")


def write_text_index(nodes: DataFrame, path: str) -> None:
    """Postings (gram, id) of every three characters in a row of the searched text, each once per node.

    Folders by a hash of the gram, sorted by gram and id within: a search reads the folders
    of its grams, and of their files the row groups that may hold them. Ranges go by
    gram and id, so a gram that every node has fills many tasks and files.
    """
    text = F.col("_text")
    starts = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    grams = nodes.select("id", search_text(SEARCHED).alias("_text")).select(
        F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(3))))).alias("gram"), "id"
    )
    order = ["part", "gram", "id"]
    written = grams.withColumn("part", _index_part(F.col("gram"))).repartitionByRange(*order).sortWithinPartitions(*order).write
    written.option("compression", "zstd").partitionBy("part").parquet(path)


def read_text_index(spark: SparkSession, path: str) -> DataFrame:
    """The postings of ``write_text_index``: gram, id, part."""
    return spark.read.schema("gram string, id string, part int").parquet(path)


def indexed_matching(nodes: DataFrame, postings: DataFrame, query: str) -> DataFrame:
    """``matching`` by the postings of the same nodes: ids that hold every gram of the text, then compared in full.

    A text of fewer than three characters has no gram; all nodes are compared.
    """
    q = query.strip().lower()
    grams = sorted({q[i:i + 3] for i in range(len(q) - 2)})
    if not grams:
        return matching(nodes, query)
    # Both conditions are literals after folding: the first chooses folders, the second reaches the scan.
    folders = reduce(or_, [F.col("part") == _index_part(F.lit(g)) for g in grams])
    hits = postings.filter(folders & F.col("gram").isin(grams)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return matching(nodes.join(hits.filter(F.col("n") == len(grams)).select("id"), "id", "left_semi"), query)


def search_indexed(nodes: DataFrame, edges: DataFrame, postings: DataFrame, query: str) -> DataFrame:
    """``search_nodes`` with the postings of ``write_text_index`` in place of a scan of all texts."""
    if not query.strip():
        return nodes
    hits = indexed_matching(nodes, postings, query).select("id")
    return intersect_selection(nodes, hits.unionByName(neighbours(edges, hits)))


def focus_function(nodes: DataFrame, edges: DataFrame, fn: str, focused: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes of one function, their direct neighbours, and the edges among them.

    ``focused``: all ``edges`` are among these nodes already and tell whether an end is its own, as those of
    ``visible_graph`` around the function; then only the edges of the function itself move, to find its neighbours.
    """
    own = nodes.filter(F.col("function") == fn).select("id")
    if focused:
        ends = edges.filter("src_at.own OR dst_at.own").select(F.explode(F.array("src", "dst")).alias("id"))
        return nodes.join(own.unionByName(ends.distinct()), "id", "left_semi"), edges
    kept = nodes.join(own.unionByName(neighbours(edges, own)), "id", "left_semi")
    return kept, induced(kept, edges)


def function_catalog(functions: DataFrame, nodes: DataFrame, pkg: str = "", query: str = "") -> DataFrame:
    """Functions of a package whose name or id holds ``query`` or that own a node that does."""
    chosen = functions.filter(F.col("package") == pkg) if pkg else functions
    q = query.strip().lower()
    if q:
        owners = matching(nodes, q).select(F.col("function").alias("id")).distinct().withColumn("_owner", F.lit(True))
        chosen = (
            chosen.join(owners, "id", "left")
            .filter(search_text(["name", "id"]).contains(q) | F.col("_owner"))
            .drop("_owner")
        )
    return chosen


def default_view(functions: DataFrame, nodes: DataFrame, whole_nodes: int | None = LARGE_GRAPH_NODES) -> DataFrame:
    """One row with the entry function, empty when there is none or the graph has more than ``whole_nodes`` nodes."""
    rank = F.when(F.col("name") == "Run", 0).otherwise(1)
    entry = functions.filter(F.col("name").isin("Run", "main")).agg(
        F.min_by("id", F.struct(rank, "seq")).alias("entry")
    )
    size = nodes.agg(F.count(F.lit(1)).alias("n"))
    both = entry.unionByName(size, allowMissingColumns=True).agg(F.max("entry").alias("entry"), F.max("n").alias("n"))
    small = F.lit(True) if whole_nodes is None else F.col("n") <= whole_nodes
    return both.select(F.when(small, F.coalesce("entry", F.lit(""))).otherwise("").alias("fn"))


def normalize_view(options: DataFrame) -> DataFrame:
    """View options with defaults filled in; of the layers only those switched off remain, in fixed order.

    A ``part`` below -1 is kept as it is: validate_snapshot reports it.
    """
    off = F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), F.lit(False).alias("value")) for k in LAYERS]),
        lambda e: F.coalesce(F.try_element_at(F.col("layers"), e["key"]), F.lit(True)) == F.lit(False),
    )
    part = F.coalesce(F.col("part"), F.lit(0))
    return options.withColumns({
        "fn": F.coalesce("fn", F.lit("")),
        "pkg": F.coalesce("pkg", F.lit("")),
        "part": part.cast("int"),
        "compact": F.coalesce("compact", F.lit(True)),
        "query": F.coalesce("query", F.lit("")),
        "layers": F.map_from_entries(off),
    })


def view_key() -> Column:
    """Canonical text of normalised view options, equal exactly for equal views."""
    return F.to_json(F.struct("fn", "pkg", "part", "compact", "query", "layers"))


def first_objects(nodes: DataFrame, n: int = 200) -> DataFrame:
    return nodes.orderBy("seq").limit(n)


def order_functions(functions: DataFrame) -> DataFrame:
    """By qualified name, then position."""
    return functions.orderBy("id", "seq")


def intersect_selection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` whose id is in ``b``."""
    return a.join(b.select("id"), "id", "left_semi")


def graph_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows one table has more often than the other: empty exactly when both are equal.

    One pass of signed counts over the union instead of two multiset differences.
    """
    columns = a.columns
    signed = a.withColumn("_n", F.lit(1)).unionByName(b.select(*columns).withColumn("_n", F.lit(-1)))
    return (
        signed.groupBy(*columns)
        .agg(F.sum("_n").alias("surplus"))
        .filter(F.col("surplus") != 0)
    )
