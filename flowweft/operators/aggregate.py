"""Deduplication, counts, roll-ups and the undirected contact graph."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .selection import edge_class, induced


def dedup_edges(edges: DataFrame) -> DataFrame:
    """Drop empty and self links; keep the first edge per (src, dst, kind, label).

    The type is not part of the key. ``min`` over a struct led by ``seq`` combines
    map-side and, unlike dropDuplicates, always keeps the same row.
    """
    key = ["src", "dst", "kind", "label"]
    rest = [c for c in edges.columns if c not in key and c != "seq"]
    first = F.min(F.struct("seq", *rest)).alias("_first")
    return (
        edges.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy(*key)
        .agg(first)
        .select(*key, "_first.*")
        .select(*edges.columns)
    )


def edge_types() -> Column:
    """Types an edge carries, as a one-element array of the normal form; null where it passes on what came before."""
    return F.when(F.col("type").isNotNull(), F.array(S.normalize_type("type")))


def union_types(arrays: Column) -> Column:
    """Aggregate: sorted distinct union of type arrays. Grows with the distinct arrays, not with the rows."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(arrays))))


def merge_types(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct normalised types per key, sorted."""
    pairs = edges.select(*keys, S.normalize_type("type").alias("_t")).distinct()
    return pairs.groupBy(*keys).agg(F.array_sort(F.collect_list("_t")).alias("types"))


def type_legend(edges: DataFrame) -> DataFrame:
    """One styled row per distinct type; styles are computed after the distinct."""
    types = edges.filter(F.col("type").isNotNull()).select(S.normalize_type("type").alias("type")).distinct()
    return types.select(
        "type",
        S.type_label("type").alias("label"),
        S.type_shape("type").alias("shape"),
        S.type_color("type").alias("color"),
    )


def function_counts(nodes: DataFrame, functions: DataFrame) -> DataFrame:
    """Node count per function, zero for functions without nodes."""
    counts = nodes.groupBy(F.col("function").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return functions.join(counts, "id", "left").select("package", "id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def graph_summary(projects: DataFrame, functions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals: each table is reduced to one row before they meet."""
    rows = F.count(F.lit(1))
    totals = [
        projects.agg(rows.alias("projects")),
        functions.agg(rows.alias("functions")),
        nodes.agg(
            rows.alias("nodes"),
            F.count_if(F.col("kind") == "warehouse").alias("warehouses"),
            F.count_if(F.col("kind") == "rocket").alias("rockets"),
        ),
        edges.agg(rows.alias("edges"), F.count_if(F.col("kind") == "train").alias("trains")),
    ]
    # Four rows that fill different columns: their maximum is one row with all.
    merged = totals[0]
    for part in totals[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def package_nodes(functions: DataFrame) -> DataFrame:
    """One node per package with its function count."""
    return functions.groupBy("package").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("package:"), "package").alias("id"),
        S.short_package("package").alias("label"),
        "package",
        "n",
    )


def package_overview(
    functions: DataFrame, nodes: DataFrame, edges: DataFrame, hidden: Iterable[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Packages as nodes; flows between different packages by class with count and types.

    Edges are rolled up by (src package, dst package, class, type) first, so the
    normal form and the type sets are computed on few rows. Routes through a hub
    (nodes whose ``role`` is ``hub``) are counted writer by reader without listing them.
    """
    known = functions.select("package").distinct()
    owner = nodes.filter(F.col("package") != "").join(known, "package", "left_semi").select("id", "package")
    kind = F.when(edge_class() == "train", "train").otherwise("call")
    off = set(hidden)
    kept = edges.select("src", "dst", kind.alias("kind"), "type")
    if "train" in off:
        kept = kept.filter(F.col("kind") != "train")
    if "belt" in off:
        kept = kept.filter(F.col("kind") == "train")
    by_hub = _hub_routes(nodes, kept, owner.withColumnRenamed("package", "group"), ["kind", "type"])
    direct = (
        kept.join(owner.select(F.col("id").alias("src"), F.col("package").alias("src_package")), "src")
        .join(owner.select(F.col("id").alias("dst"), F.col("package").alias("dst_package")), "dst")
        .select("src_package", "dst_package", "kind", "type", F.lit(1).cast("bigint").alias("n"))
    )
    flows = (
        direct.unionByName(by_hub.withColumnsRenamed({"from": "src_package", "to": "dst_package"}))
        .filter(F.col("src_package") != F.col("dst_package"))
        .groupBy("src_package", "dst_package", "kind", "type")
        .agg(F.sum("n").alias("n"))
    )
    links = (
        flows.withColumn("type", S.normalize_type("type"))
        .groupBy("src_package", "dst_package", "kind")
        .agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("type")).alias("types"))
    )
    return package_nodes(functions), links


def _hub_routes(nodes: DataFrame, edges: DataFrame, owner: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Writer -> reader routes through hubs, counted per (from, to) group and ``keys`` of the writer's edge.

    ``owner``: id, group. Each side of a hub is counted per group first; the counts meet
    on the hub and are multiplied, so no route is listed. A node on both sides of a hub
    has no route to itself, which shows only between equal groups.
    """
    if "role" not in nodes.columns:
        text, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
        return edges.filter(F.lit(False)).select(*keys, text.alias("from"), text.alias("to"), number.alias("n"))
    hubs = nodes.filter(F.col("role") == "hub").select(F.col("id").alias("hub"))
    into = edges.join(hubs.withColumnRenamed("hub", "dst"), "dst", "left_semi").join(owner.withColumnRenamed("id", "src"), "src")
    out = edges.join(hubs.withColumnRenamed("hub", "src"), "src", "left_semi").join(owner.withColumnRenamed("id", "dst"), "dst")
    writers = into.groupBy(F.col("dst").alias("hub"), F.col("group").alias("from"), *keys).agg(F.count(F.lit(1)).alias("w"))
    readers = out.groupBy(F.col("src").alias("hub"), F.col("group").alias("to")).agg(F.count(F.lit(1)).alias("r"))
    return writers.join(readers, "hub").groupBy(*keys, "from", "to").agg(F.sum(F.col("w") * F.col("r")).alias("n"))


def contact_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected weighted neighbours (id, other, weight), both directions listed.

    Pairs are summed in one canonical direction and mirrored afterwards: half the shuffle.
    """
    inner = induced(nodes, edges.filter(F.col("src") != F.col("dst")))
    return mirrored_weights(inner)


def mirrored_weights(edges: DataFrame) -> DataFrame:
    """Sums of both directions; an edge weighs its ``n`` (or ``count``), if that is finite and positive, else 1."""
    weight = F.lit(1.0)
    counts = [c for c in ("n", "count") if c in edges.columns]
    if counts:
        c = F.col(counts[0]).cast("double")
        weight = F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c).otherwise(1.0)
    pairs = (
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), weight.alias("w"))
        .groupBy("a", "b")
        .agg(F.sum("w").alias("weight"))
    )
    sides = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.select(sides.alias("p"), "weight").select(
        F.col("p.a").alias("id"), F.col("p.b").alias("other"), "weight"
    )


def node_strength(nodes: DataFrame, contact: DataFrame) -> DataFrame:
    """Number of distinct neighbours and sum of 1 + log2(weight); zero for isolated nodes."""
    busy = contact.groupBy("id").agg(
        F.count(F.lit(1)).alias("degree"), F.sum(1 + F.log2("weight")).alias("strength")
    )
    return nodes.select("id").join(busy, "id", "left").na.fill({"degree": 0, "strength": 0.0})


def rank_hubs(strength: DataFrame, k: int) -> DataFrame:
    """The k busiest nodes: degree, strength, then id in natural order."""
    return strength.orderBy(
        F.desc("degree"), F.desc(F.round("strength", 6)), S.natural_key("id")
    ).limit(k)


def function_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Contact graph between functions: the same weights one level up, through hubs too."""
    owner = nodes.filter(F.col("role").isNull() | (F.col("role") != "hub")) if "role" in nodes.columns else nodes
    owner = owner.select("id", "function")
    routes = _hub_routes(nodes, edges, owner.withColumnRenamed("function", "group"), [])
    lifted = (
        edges.join(owner.select(F.col("id").alias("src"), F.col("function").alias("f")), "src")
        .join(owner.select(F.col("id").alias("dst"), F.col("function").alias("g")), "dst")
        .select(F.col("f").alias("src"), F.col("g").alias("dst"), F.lit(1).cast("bigint").alias("n"))
    )
    return mirrored_weights(lifted.unionByName(routes.select(F.col("from").alias("src"), F.col("to").alias("dst"), "n")))


@dataclass
class FunctionClasses:
    """The contact graph between functions with its hub routes as bicliques: linear in the sides of the hubs."""

    members: DataFrame  # id (function), group: functions with the same sides everywhere
    sides: DataFrame  # group, n (members), hub, w, r: writers and readers of one member at the hub
    direct: DataFrame  # id, other, weight: links that pass no hub, both directions


def function_classes(nodes: DataFrame, edges: DataFrame) -> FunctionClasses:
    """``function_graph`` without its pairs.

    The routes through a hub join every function that writes with every one that reads: a hub
    of a million functions has up to 10^12 pairs, but as many sides as functions. Functions
    with the same writers and readers at the same hubs have the same weights to all others,
    so they share a group, named by summed pieces of the hashes of their sides (two sums
    of 60-bit pieces; sums combine map-side and no list of sides is built).
    """
    role = F.col("role") if "role" in nodes.columns else F.lit(None).cast("string")
    marked = nodes.select("id", "function", F.coalesce(role == "hub", F.lit(False)).alias("is_hub"))
    hubs, owner = marked.filter("is_hub").select("id"), marked.filter("NOT is_hub").select("id", "function")
    one, no = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    into = edges.join(hubs.withColumnRenamed("id", "dst"), "dst", "left_semi").join(owner.withColumnRenamed("id", "src"), "src")
    out = edges.join(hubs.withColumnRenamed("id", "src"), "src", "left_semi").join(owner.withColumnRenamed("id", "dst"), "dst")
    touches = into.select(F.col("dst").alias("hub"), F.col("function").alias("id"), one.alias("w"), no.alias("r")).unionByName(
        out.select(F.col("src").alias("hub"), F.col("function").alias("id"), no.alias("w"), one.alias("r"))
    )
    own = touches.groupBy("hub", "id").agg(F.sum("w").alias("w"), F.sum("r").alias("r"))
    digest = F.sha2(F.concat_ws("\u0000", "hub", "w", "r"), 256)
    pieces = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(2)]
    members = own.groupBy("id").agg(F.concat_ws(".", *pieces).alias("group"))
    first = members.groupBy("group").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    sides = own.join(first, "id").select("group", "n", "hub", "w", "r")
    lifted = (
        edges.join(owner.select(F.col("id").alias("src"), F.col("function").alias("f")), "src")
        .join(owner.select(F.col("id").alias("dst"), F.col("function").alias("g")), "dst")
        .select(F.col("f").alias("src"), F.col("g").alias("dst"), one.alias("n"))
    )
    return FunctionClasses(members, sides, mirrored_weights(lifted))


def class_links(classes: FunctionClasses) -> DataFrame:
    """(group, other, n, weight): weight between a member of one group and each of the ``n`` members of another, or of its own."""
    a = classes.sides.select("hub", "group", F.col("w").alias("w1"), F.col("r").alias("r1"))
    b = classes.sides.select("hub", F.col("group").alias("other"), "n", "w", "r")
    routes = F.col("w1") * F.col("r") + F.col("r1") * F.col("w")
    pairs = a.join(b, "hub").groupBy("group", "other").agg(F.sum(routes).cast("double").alias("weight"), F.min("n").alias("n"))
    return pairs.filter("weight > 0").select("group", "other", "n", "weight")


def class_strength(functions: DataFrame, classes: FunctionClasses) -> DataFrame:
    """``node_strength`` of functions (id) from the factored form, without listing pairs of functions.

    Each group's links are summed once for all its members. Links that pass no hub change the
    weight of their own pair only, so they add the difference. Work grows with the
    pairs of groups that share a hub and with the direct links.
    """
    links = class_links(classes)
    others = F.col("n") - F.when(F.col("group") == F.col("other"), 1).otherwise(0)
    shared = links.groupBy("group").agg(F.sum(others).alias("d"), F.sum(others * (1 + F.log2("weight"))).alias("s"))
    by_hub = classes.members.join(shared, "group").select("id", "d", "s")
    far = classes.members.select(F.col("id").alias("other"), F.col("group").alias("far"))
    known = links.select("group", F.col("other").alias("far"), F.col("weight").alias("through"))
    direct = classes.direct.join(classes.members, "id", "left").join(far, "other", "left").join(known, ["group", "far"], "left")
    alone = F.col("through").isNull()
    more = direct.select(
        "id", F.when(alone, 1).otherwise(0).cast("bigint").alias("d"),
        F.when(alone, 1 + F.log2("weight")).otherwise(F.log2(1 + F.col("weight") / F.col("through"))).alias("s"),
    )
    busy = by_hub.unionByName(more).groupBy("id").agg(F.sum("d").alias("degree"), F.sum("s").alias("strength"))
    return functions.select("id").join(busy, "id", "left").na.fill({"degree": 0, "strength": 0.0})


def method_calls(nodes: DataFrame) -> DataFrame:
    """Calls per callee identity, whoever calls and however (go, defer)."""
    return nodes.filter(F.col("method") != "").groupBy("method").agg(F.count(F.lit(1)).alias("calls"))


def all_edges(families: Sequence[DataFrame]) -> DataFrame:
    """Edge families in build order, deduplicated: earlier families win."""
    merged = None
    for i, df in enumerate(families):
        part = df.select("src", "dst", "kind", "label", "type", F.struct(F.lit(i).alias("family"), "seq").alias("seq"))
        merged = part if merged is None else merged.unionByName(part)
    return dedup_edges(merged)


class SizeLimitError(ValueError):
    """A table is larger than the caller allows."""


def size_limits(nodes: DataFrame, edges: DataFrame, max_nodes: int = 0, max_edges: int = 0) -> DataFrame:
    """Row counts of both tables; an error past a limit (0 = none). Nothing is ever cut off."""
    if max_nodes < 0 or max_edges < 0:
        raise ValueError("limits must not be negative; 0 means no limit")
    counts = (
        nodes.agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit("nodes")).withColumn("cap", F.lit(max_nodes))
        .unionByName(
            edges.agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit("edges")).withColumn("cap", F.lit(max_edges))
        )
    )
    for row in counts.filter((F.col("cap") > 0) & (F.col("n") > F.col("cap"))).collect():  # at most two rows
        raise SizeLimitError(f"{row['table']}: {row['n']} rows, limit {row['cap']}")
    return counts
