"""Leaf-first contraction of a graph into groups, and the check of a stored hierarchy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import natural_key
from ..runtime import materialize, write_table


@dataclass
class Hierarchy:
    """Merges in rounds and the groups that remain.

    merges: round, group, partner, parent, degree (external links of ``group`` then).
    merge_edges: round, parent, edge_id for every link that became internal.
    groups: group_id, node_id. group_edges: group_id, edge_id.
    """

    merges: DataFrame
    merge_edges: DataFrame
    groups: DataFrame
    group_edges: DataFrame


# While groups merge they are numbers: that of a node, and above it the round after which the group was made (0: a node by itself).
_NODE_BITS = 54


def _node(c: str) -> Column:
    """The node that a group is named after."""
    return F.col(c).bitwiseAND(F.lit((1 << _NODE_BITS) - 1))


def _name(c: str, node_id: str) -> Column:
    made = F.shiftright(c, _NODE_BITS)
    return F.when(made == 0, F.concat(F.lit("block:"), node_id)).otherwise(F.concat(F.lit("group:"), (made - 1).cast("string"), F.lit(":"), node_id))


def _external(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, shared) mirrored contact pairs and (group, degree); parallel links count each."""
    pairs = live.groupBy(F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y")).agg(
        F.count(F.lit(1)).alias("shared")
    )
    sides = F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b"))))
    contact = pairs.select(sides.alias("p"), "shared").select("p.a", "p.b", "shared")
    return contact, contact.groupBy(F.col("a").alias("group")).agg(F.sum("shared").alias("degree"))


def _numbered(nodes: DataFrame) -> DataFrame:
    """(id, n): the nodes' ids, each once, with numbers that rise in their natural order."""
    ids = nodes.filter("id IS NOT NULL").select("id").distinct().withColumn("_key", natural_key("id"))
    ranged = ids.repartitionByRange("_key").sortWithinPartitions("_key")
    return materialize(ranged.select("id", F.monotonically_increasing_id().alias("n")))


def _live(numbers: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, ga, gb): links between two of the numbered nodes (id, n)."""
    return (
        edges.filter(F.col("src") != F.col("dst"))
        .join(numbers.select(F.col("id").alias("src"), F.col("n").alias("ga")), "src")
        .join(numbers.select(F.col("id").alias("dst"), F.col("n").alias("gb")), "dst")
        .select(F.col("id").alias("edge_id"), "ga", "gb")
    )


def _relabel(live: DataFrame, moves: DataFrame) -> DataFrame:
    """Rewrite both ends of each link from group to parent."""
    return (
        live.join(moves.select(F.col("group").alias("ga"), F.col("parent").alias("pa")), "ga", "left")
        .join(moves.select(F.col("group").alias("gb"), F.col("parent").alias("pb")), "gb", "left")
        .select("edge_id", F.coalesce("pa", "ga").alias("ga"), F.coalesce("pb", "gb").alias("gb"))
    )


def _stars(picks: DataFrame, number: int) -> DataFrame:
    """(group, parent, partner, degree) of the groups that merge in a round: centres and those that join them.

    Every group has picked a partner and draws a rank from its name and the round. It joins its partner if that ranks
    higher and does not join another itself, so long chains of picks fall into stars: at least a third of all picks are
    expected to be followed, and in each ring of picks one is. A centre has no partner.
    """
    rank = lambda c: F.xxhash64(F.lit(number), F.col(c))
    partners = picks.select(F.col("group").alias("partner"), F.col("partner").alias("beyond"), F.col("degree").alias("centre_degree"))
    joined = picks.join(partners, "partner").filter(
        (rank("group") < rank("partner")) & (rank("partner") > rank("beyond"))
    )
    none = F.lit(None).cast("bigint")
    both = F.explode(F.array(
        F.struct("group", F.col("partner").alias("centre"), F.col("partner").alias("partner"), F.col("degree")),
        F.struct(F.col("partner").alias("group"), F.col("partner").alias("centre"), none.alias("partner"), F.col("centre_degree").alias("degree")),
    ))
    rows = joined.select(both.alias("m")).select("m.*").groupBy("group", "centre").agg(F.min("partner").alias("partner"), F.min("degree").alias("degree"))
    parent = F.lit((number + 1) << _NODE_BITS).bitwiseOR(_node("centre"))
    return rows.select("group", parent.alias("parent"), "partner", "degree")


def contract_groups(nodes: DataFrame, edges: DataFrame) -> Hierarchy:
    """Merge groups until no link leaves a group.

    In each round every group with links to others picks a partner: the one it shares most links with, then the one of the
    higher degree, then the one made earlier, then that of the smaller node in natural order. Picks are followed in stars (``_stars``), so the number of rounds grows with
    the logarithm of the number of nodes, whatever their degrees; a strict global order would need one job per merge.
    ``degree`` of a merge is its group's number of external links at the time. Groups are numbers while they merge; they are named
    ``group:<round>:<node>`` after a node in them, so names do not grow with the rounds.
    """
    numbers = _numbered(nodes)
    live, left = write_table(_live(numbers, edges))
    rounds, inner = [], []
    while left:
        contact, degree = _external(live)
        picks = materialize(
            contact.join(degree.select(F.col("group").alias("b"), F.col("degree").alias("db")), "b")
            .groupBy(F.col("a").alias("group"))
            .agg(F.sum("shared").alias("degree"), F.min_by("b", F.struct(-F.col("shared"), -F.col("db"), "b")).alias("partner"))
        )
        moves = materialize(_stars(picks, len(rounds)))
        relabelled, left = write_table(_relabel(live, moves), F.count_if(F.col("ga") != F.col("gb")))
        inner.append(relabelled.filter("ga = gb").select(F.lit(len(rounds)).alias("round"), F.col("ga").alias("parent"), "edge_id"))
        live = relabelled.filter("ga <> gb")
        rounds.append(moves.select(F.lit(len(rounds)).alias("round"), "group", "partner", "parent", "degree"))
    spark = nodes.sparkSession
    empty_m = "round INT, group BIGINT, partner BIGINT, parent BIGINT, degree BIGINT"
    merges = reduce(DataFrame.unionByName, rounds) if rounds else spark.createDataFrame([], empty_m)
    merge_edges = reduce(DataFrame.unionByName, inner) if inner else spark.createDataFrame([], "round INT, parent BIGINT, edge_id STRING")
    members = materialize(_named_members(_members(nodes, numbers, Forest(merges)), numbers))
    return Hierarchy(_named_merges(merges, numbers), _named_edges(merge_edges, numbers), members, internal_edges(members, edges))


def _named_merges(merges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Merges with names; the parent is named after the node of the group's partner, a centre's after its own."""
    nodes = lambda at, id: numbers.select(F.col("n").alias(at), F.col("id").alias(id))
    return (
        merges.withColumn("_a", _node("group")).withColumn("_b", F.coalesce(_node("partner"), _node("group")))
        .join(nodes("_a", "_own"), "_a").join(nodes("_b", "_centre"), "_b")
        .select("round", _name("group", "_own").alias("group"), F.when(F.col("partner").isNotNull(), _name("partner", "_centre")).alias("partner"),
                _name("parent", "_centre").alias("parent"), "degree")
    )


def _named_edges(merge_edges: DataFrame, numbers: DataFrame) -> DataFrame:
    nodes = numbers.select(F.col("n").alias("_a"), F.col("id").alias("_own"))
    return merge_edges.withColumn("_a", _node("parent")).join(nodes, "_a").select("round", _name("parent", "_own").alias("parent"), "edge_id")


def _named_members(members: DataFrame, numbers: DataFrame) -> DataFrame:
    nodes = numbers.select(F.col("n").alias("_a"), F.col("id").alias("_own"))
    return members.withColumn("_a", _node("group_id")).join(nodes, "_a", "left").select(_name("group_id", "_own").alias("group_id"), "node_id")


class Forest:
    """Groups under their parents, with each group's ancestors at distances of powers of two (``lifts``).

    ``merges``: group, parent, round. A group's first merge counts. Groups whose parents lead back to themselves, and those
    below them, are in ``rings`` and have no place in the forest.
    """

    def __init__(self, merges: DataFrame):
        first = merges.groupBy("group").agg(F.min(F.struct("round", "parent")).alias("m"))
        up, n = write_table(first.select("group", "m.parent", "m.round"))
        self.parents, self.lifts = up, []
        state = up.select("group", F.col("parent").alias("top"), F.lit(1).cast("long").alias("steps"))
        open_, step = n, 1
        while open_:
            self.lifts.append(state.filter(F.col("steps") == step).select("group", F.col("top").alias("above")))
            beyond = state.select(F.col("group").alias("top"), F.col("top").alias("above"), F.col("steps").alias("more"))
            further = state.join(beyond, "top", "left").select(
                "group", F.coalesce("above", "top").alias("top"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
            )
            state, now = write_table(further, F.count_if(F.col("steps") == 2 * step))
            step, before, open_ = step * 2, open_, now
            if open_ == before:
                # A chain has a group at every depth. If none is as deep as the last step and less deep than this one, all
                # that are still on their way go round. The last lift has no others either.
                self.lifts.pop()
                break
        self.rings = state.filter(F.col("steps") >= step).select("group") if open_ else up.filter("false").select("group")
        self.roots = state.join(self.rings, "group", "left_anti").select("group", "top", F.col("steps").alias("depth"))


def _members(nodes: DataFrame, numbers: DataFrame, forest: Forest) -> DataFrame:
    """(group_id, node_id): each node under its outermost group, by number."""
    leaves = nodes.select(F.col("id").alias("node_id")).join(numbers.select(F.col("id").alias("node_id"), F.col("n").alias("group")), "node_id", "left")
    return leaves.join(forest.roots, "group", "left").select(F.coalesce("top", "group").alias("group_id"), "node_id")


def _meetings(live: DataFrame, forest: Forest) -> DataFrame:
    """(edge_id, round, parent): where and when the ends of links come into one group; no row for those that never do.

    Both ends are lifted to one depth, then as far as their ancestors differ, in steps of falling powers of two.
    """
    depth = forest.roots.select("group", "depth")
    at = (
        live.join(depth.toDF("ga", "da"), "ga").join(depth.toDF("gb", "db"), "gb")
        .select("edge_id", F.when(F.col("da") >= F.col("db"), F.col("ga")).otherwise(F.col("gb")).alias("x"),
                F.when(F.col("da") >= F.col("db"), F.col("gb")).otherwise(F.col("ga")).alias("y"), F.abs(F.col("da") - F.col("db")).alias("gap"))
    )
    for k in reversed(range(len(forest.lifts))):
        lifted = at.join(forest.lifts[k].toDF("x", "above"), "x", "left")
        up = F.when(F.col("gap") >= 1 << k, F.col("above")).otherwise(F.col("x"))
        at = lifted.select("edge_id", up.alias("x"), "y", F.when(F.col("gap") >= 1 << k, F.col("gap") - (1 << k)).otherwise(F.col("gap")).alias("gap"))
    at = materialize(at)
    for k in reversed(range(len(forest.lifts))):
        lifted = at.join(forest.lifts[k].toDF("x", "ax"), "x", "left").join(forest.lifts[k].toDF("y", "ay"), "y", "left")
        apart = F.coalesce(F.col("ax") != F.col("ay"), F.lit(False))
        at = lifted.select("edge_id", F.when(apart, F.col("ax")).otherwise(F.col("x")).alias("x"), F.when(apart, F.col("ay")).otherwise(F.col("y")).alias("y"))
    own = forest.parents
    return (
        at.join(own.select(F.col("group").alias("x"), F.col("parent").alias("px"), F.col("round").alias("rx")), "x")
        .join(own.select(F.col("group").alias("y"), F.col("parent").alias("py"), F.col("round").alias("ry")), "y")
        .filter("px = py").select("edge_id", F.greatest("rx", "ry").alias("round"), F.col("px").alias("parent"))
    )


def _below(own: DataFrame, forest: Forest) -> DataFrame:
    """(group, n): sums of ``own`` (group, n) over a group and all below it, by doubling the distance that is summed."""
    total = own.groupBy("group").agg(F.sum("n").alias("n"))
    for lift in forest.lifts:
        total = materialize(total)
        higher = total.join(lift, "group").select(F.col("above").alias("group"), "n")
        total = total.unionByName(higher).groupBy("group").agg(F.sum("n").alias("n"))
    return total


def internal_edges(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Links (self-links too) with both ends in one group."""
    return (
        edges.select(F.col("id").alias("edge_id"), "src", "dst")
        .join(groups.select(F.col("node_id").alias("src"), F.col("group_id").alias("g")), "src")
        .join(groups.select(F.col("node_id").alias("dst"), F.col("group_id").alias("h")), "dst")
        .filter("g = h")
        .select(F.col("g").alias("group_id"), "edge_id")
    )


def _mismatch(rule: str, want: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Rows present on one side only, as violations; rows of ``got`` with a name in ``_other`` are like none that are wanted."""
    if "_other" in got.columns:
        want = want.withColumn("_other", F.lit(None).cast("string"))
    signed = want.withColumn("_n", F.lit(1)).unionByName(got.select(*want.columns).withColumn("_n", F.lit(-1)))
    odd = signed.groupBy(*want.columns).agg(F.sum("_n").alias("s")).filter("s <> 0")
    return odd.select(F.lit(rule).alias("rule"), F.col(key).alias("key"))


def validate_hierarchy(nodes: DataFrame, edges: DataFrame, stored: Hierarchy) -> DataFrame:
    """(rule, key) for whatever a stored hierarchy says that the links do not.

    Nothing is replayed: the parents are a forest, a link becomes internal at the lowest common ancestor of its ends, and
    a group's degree is the number of link ends at its nodes less two for every link that meets in it or below.

    merged_twice: a group with several merges (the first counts). ring: a group whose parents never end. order: a group
    merged before it was whole, or a parent whose groups came in different rounds. degree, merge_edges, members,
    group_edges: what is stored and what follows differ; a row for each side. open_edge: a link that no group holds. Groups in or below a
    ring are held to nothing else.
    """
    named = materialize(stored.merges.select("round", "group", "parent", F.col("degree").cast("bigint").alias("degree")))
    book = _book(nodes, named)
    numbers = book.filter("leaf").select(F.substring("name", len("block:") + 1, _LONGEST).alias("id"), "n")
    merges = materialize(_numbers(_numbers(named, "group", book), "parent", book).select("round", "group", "parent", "degree"))
    forest = Forest(merges)
    live = materialize(_live(numbers, edges))
    met = materialize(_meetings(live, forest))
    ends = live.select(F.explode(F.array("ga", "gb")).alias("group"), F.lit(1).alias("n"))
    own = ends.unionByName(met.select(F.col("parent").alias("group"), F.lit(-2).alias("n")))
    first = merges.groupBy("group").agg(F.min(F.struct("round", "parent", "degree")).alias("m")).select("group", "m.degree")
    placed = first.join(forest.rings, "group", "left_anti")
    degree = _below(own, forest).filter("n <> 0").join(placed.select("group"), "group", "left_semi").select("group", F.col("n").alias("degree"))
    made = forest.parents.groupBy(F.col("parent").alias("group")).agg(F.min("round").alias("begun"), F.max("round").alias("whole"))
    early = made.join(forest.parents.select("group", "round"), "group", "left").filter("begun <> whole OR round <= whole")
    told = lambda rule, df, key: df.select(F.lit(rule).alias("rule"), F.col(key).alias("key"))
    members = materialize(_members(nodes, numbers, forest))
    at_groups = [
        told("merged_twice", merges.groupBy("group").count().filter("count > 1"), "group"),
        told("ring", forest.rings, "group"),
        told("order", early.join(forest.rings, "group", "left_anti"), "group"),
        _mismatch("degree", degree, placed, "group"),
    ]
    found = [
        reduce(DataFrame.unionByName, at_groups).join(book.select(F.col("n").alias("key"), "name"), "key", "left").select("rule", F.col("name").alias("key")),
        _mismatch("merge_edges", met.select("round", "parent", "edge_id"), _numbers(stored.merge_edges, "parent", book), "edge_id"),
        _mismatch("members", members, _numbers(stored.groups, "group_id", book), "node_id"),
        _mismatch("group_edges", internal_edges(members, edges), _numbers(stored.group_edges, "group_id", book), "edge_id"),
        told("open_edge", live.join(met.select("edge_id"), "edge_id", "left_anti"), "edge_id"),
    ]
    return reduce(DataFrame.unionByName, [f.select("rule", F.col("key").cast("string").alias("key")) for f in found])


_LONGEST = 2**31 - 1


def _book(nodes: DataFrame, merges: DataFrame) -> DataFrame:
    """(name, n, leaf): a number for every name of a merge or node, and whether it is a node's."""
    name = lambda df, c, leaf: df.select(c.alias("name"), F.lit(leaf).alias("leaf")).filter("name IS NOT NULL")
    every = name(nodes, F.concat(F.lit("block:"), "id"), True).unionByName(name(merges, F.col("group"), False)).unionByName(name(merges, F.col("parent"), False))
    return materialize(every.groupBy("name").agg(F.max("leaf").alias("leaf")).select("name", F.monotonically_increasing_id().alias("n"), "leaf"))


def _numbers(df: DataFrame, column: str, book: DataFrame) -> DataFrame:
    """``df`` with the numbers of the names in ``column``; a name that the book does not have stands in ``_other``."""
    known = book.select(F.col("name").alias(column), "n")
    rows = df.join(known, column, "left").withColumn("_other", F.when(F.col("n").isNull(), F.col(column)))
    return rows.withColumn(column, F.col("n")).drop("n")
