"""Reachability, breadth-first levels and connected components as loops of joins.

Each round writes its new rows below the checkpoint folder and reads them back:
the plan stays short and a lost executor costs at most one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import drop_table, materialize, write_bucketed, write_table

_COMPACT_EVERY = 8
_HUB_LINKS = 100_000  # of one node in a bucket
_HOPS = 8  # rounds of plain hops before the rest of a graph is contracted
_FROM_REACHED = ""  # stands for everything reached; other names start with their direction


def _walk(links: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, bool]:
    """(dir, at) within ``hops`` of ``seeds``, and whether there may be more.

    The links are written once, bucketed by the node they leave, and stay where they are; in a round the frontier goes to them.
    """
    keys = ["dir", "at"]
    frontier, found = write_table(seeds)
    rounds = [frontier]
    adjacency, fans, name = _at_origin(links, ["dir", "a"])
    for _ in range(hops):
        if not found:
            break
        seen = reduce(DataFrame.unionByName, rounds)
        step = (
            adjacency.join(_spread(frontier.select("dir", F.col("at").alias("a")), fans, ["dir", "a"]), adjacency.columns[:-1], "left_semi")
            .select("dir", F.col("b").alias("at")).distinct().join(seen, keys, "left_anti")
        )
        frontier, found = write_table(step)
        if found:
            rounds.append(frontier)
    drop_table(seeds.sparkSession, name)
    return reduce(DataFrame.unionByName, rounds), found > 0


def _at_origin(links: DataFrame, origin: list[str], hub_links: int = _HUB_LINKS) -> tuple[DataFrame, DataFrame | None, str]:
    """``links`` bucketed by ``origin``, nodes with more than one bucket (``fan`` more) if any, and the table's name.

    Nodes with more than ``hub_links`` links have them in several buckets, told by ``s``; without such nodes there is no ``s``, as
    a constant in the key of a join would make the links move.
    """
    fans, hubs = write_table(links.groupBy(*origin).agg((F.count(F.lit(1)) / hub_links).cast("int").alias("fan")).filter("fan > 0"))
    if hubs:
        part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("fan") + 1).cast("int"), F.lit(0))
        placed = links.join(fans, origin, "left").select(*origin, part.alias("s"), "b")
        adjacency, name = write_bucketed(placed, [*origin, "s"])
        return adjacency, fans, name
    adjacency, name = write_bucketed(links.select(*origin, "b"), origin)
    return adjacency, None, name


def _spread(ends: DataFrame, fans: DataFrame | None, origin: list[str]) -> DataFrame:
    """``ends`` (``origin``) once per bucket in which their links lie."""
    if fans is None:
        return ends
    return ends.join(fans, origin, "left").select(*origin, F.explode(F.sequence(F.lit(0), F.coalesce("fan", F.lit(0)))).alias("s"))


def _equivalent(live: DataFrame) -> DataFrame:
    """Pairs of names (a, b) of which either both are reached or neither.

    A name with one predecessor is reached as that is; of two that lead to each other each is reached as the other; and
    what something reached leads to is reached. ``live`` has no link into what is reached and no link twice.
    """
    from_reached = F.max(F.col("a") == _FROM_REACHED)
    single = live.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("a"), from_reached.alias("hit")).filter("n = 1 OR hit")
    both = live.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    return single.select("a", "b").unionByName(both.select("a", "b"))


def _contract(live: DataFrame, left: int, rounds: int, max_rounds: int | None) -> DataFrame | None:
    """Names that links (a, b) lead to from ``_FROM_REACHED``, by merging names that share their answer.

    Merged names keep the links that enter them from outside; those that nothing enters go, with their links. Chains,
    rings, trees and paths there and back become one name in one round, whatever their length, and every round
    takes at least one hop.
    """
    moves = []
    while left and live.filter(F.col("a") == _FROM_REACHED).limit(1).count():
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"not closed after {max_rounds} rounds")
        roots = component_roots(_equivalent(live))
        own = roots.filter(F.col("id") == _FROM_REACHED).first()
        root = F.when(F.col("root") == own.root, F.lit(_FROM_REACHED)).otherwise(F.col("root"))
        move = materialize(roots.filter(F.col("id") != _FROM_REACHED).select("id", root.alias("root")))
        moves.append(move)
        moved = materialize(
            live.join(move.toDF("a", "x"), "a", "left").join(move.toDF("b", "y"), "b", "left")
            .select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
            .filter((F.col("a") != F.col("b")) & (F.col("b") != _FROM_REACHED)).distinct()
        )
        entered = moved.select(F.col("b").alias("a")).distinct()
        live, left = write_table(
            moved.filter(F.col("a") == _FROM_REACHED).unionByName(moved.filter(F.col("a") != _FROM_REACHED).join(entered, "a", "left_semi"))
        )
    met = None
    for move in reversed(moves):
        hit = move.filter(F.col("root") == _FROM_REACHED).select("id")
        if met is not None:
            hit = hit.unionByName(move.join(met.toDF("root"), "root", "left_semi").select("id")).unionByName(met).distinct()
        met = hit
    return met


def reached(adjacency: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(dir, at): ``seeds`` (dir, at) and all that ``adjacency`` (dir, a, b; no row twice) leads to, per ``dir``.

    A few rounds of hops settle shallow graphs. What they leave is contracted (``_contract``), so that long chains and rings
    take a number of rounds that grows with their logarithm. Rows with a null lead nowhere.
    """
    kind = seeds.schema["at"].dataType
    links = adjacency.filter("a IS NOT NULL AND b IS NOT NULL")
    hops = _HOPS if max_rounds is None else min(_HOPS, max_rounds)
    met, more = _walk(links, seeds, hops)
    if not more:
        return met
    name = lambda c: F.concat("dir", F.lit(":"), F.col(c).cast("string"))
    met = materialize(met)
    open_ = links.join(met.withColumnRenamed("at", "b"), ["dir", "b"], "left_anti")
    known = met.withColumnRenamed("at", "a").withColumn("known", F.lit(True))
    live, left = write_table(
        open_.join(known, ["dir", "a"], "left")
        .select(F.when(F.col("known"), F.lit(_FROM_REACHED)).otherwise(name("a")).alias("a"), name("b").alias("b"))
        .filter("a != b").distinct()
    )
    names = _contract(live, left, hops, max_rounds)
    if names is None:
        return met
    parted = F.split("id", ":", 2)
    return met.unionByName(names.select(parted[0].alias("dir"), parted[1].cast(kind).alias("at")))


def trace(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Ids of ``seeds``, all that flows into them and all that flows out of them.

    Both closures run in the same rounds, kept apart by ``dir``: a node reached
    upstream never leads on downstream, so no sibling branches are included.
    """
    ends = F.explode(F.array(
        F.struct(F.lit("down").alias("dir"), F.col("src").alias("a"), F.col("dst").alias("b")),
        F.struct(F.lit("up").alias("dir"), F.col("dst").alias("a"), F.col("src").alias("b")),
    ))
    pairs = materialize(edges.select("src", "dst").distinct())  # half the rows of both ways, which are made as they are read
    adjacency = pairs.select(ends.alias("e")).select("e.*")
    start = seeds.select("id").distinct().select(F.explode(F.array(F.lit("down"), F.lit("up"))).alias("dir"), F.col("id").alias("at"))
    return reached(adjacency, start, max_rounds).select(F.col("at").alias("id")).distinct()


def _hop(adjacency: DataFrame, fans: DataFrame | None, frontier: DataFrame, earlier: list[DataFrame], level: int) -> DataFrame:
    """Neighbours of the frontier that are not among ``earlier``. Only the frontier and its neighbours move."""
    near = adjacency.join(_spread(frontier.select(F.col("at").alias("a")), fans, ["a"]), adjacency.columns[:-1]).select(F.col("b").alias("at")).distinct()
    return near.join(reduce(DataFrame.unionByName, earlier), "at", "left_anti").withColumn("level", F.lit(level))


def bfs_levels(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None, hub_links: int = _HUB_LINKS) -> DataFrame:
    """Undirected hop distance (id, level) from the nearest seed; unreachable ids are absent.

    The links are written once, bucketed by the node they leave, and stay where they are; in a round the frontier goes to
    them. Nodes with more than ``hub_links`` links have them in several buckets. As links lead both ways, a
    neighbour is new if the last two rounds do not have it.
    """
    spark = edges.sparkSession
    ends = F.explode(F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
        F.struct(F.col("dst").alias("a"), F.col("src").alias("b")),
    ))
    pairs = materialize(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(ends.alias("e")).select("e.*").distinct())
    adjacency, fans, name = _at_origin(pairs, ["a"], hub_links)
    frontier, found = write_table(seeds.select(F.col("id").alias("at")).distinct().withColumn("level", F.lit(0)))
    rounds, last, level = [frontier], [frontier.select("at")], 0
    while found:
        level += 1
        if max_rounds is not None and level > max_rounds:
            raise RuntimeError(f"not closed after {max_rounds} rounds")
        frontier, found = write_table(_hop(adjacency, fans, frontier, last, level))
        last = [last[-1], frontier.select("at")]
        if found:
            rounds.append(frontier)
        if len(rounds) > _COMPACT_EVERY:
            rounds = [materialize(reduce(DataFrame.unionByName, rounds))]
    drop_table(spark, name)
    return reduce(DataFrame.unionByName, rounds).select(F.col("at").alias("id"), "level")


def component_roots(pairs: DataFrame) -> DataFrame:
    """(id, root) for every id in ``pairs`` (a, b): equal roots exactly for connected ids.

    Randomised contraction (Boegeholz, Brand, Todor 2020): each vertex moves to the
    neighbour with the smallest hash, the edges are rewritten to the new ends, and
    the edge table shrinks geometrically whatever the diameter. Only minima are
    aggregated, so a hub costs one partial row per task.
    """
    live, left = write_table(
        pairs.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    moves = []
    while left:
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), F.col(c)).alias("h"), F.col(c).alias("to"))
        ends = F.explode(F.array(
            F.struct(F.col("a").alias("id"), F.least(rank("a"), rank("b")).alias("best")),
            F.struct(F.col("b").alias("id"), F.least(rank("a"), rank("b")).alias("best")),
        ))
        move = materialize(
            live.select(ends.alias("e")).select("e.*").groupBy("id").agg(F.min("best").alias("best"))
            .select("id", F.col("best.to").alias("root"))
        )
        moves.append(move)
        moved = (
            live.join(move.select(F.col("id").alias("a"), F.col("root").alias("x")), "a")
            .join(move.select(F.col("id").alias("b"), F.col("root").alias("y")), "b")
            .filter(F.col("x") != F.col("y"))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        live, left = write_table(moved)
    if not moves:
        return live.select(F.col("a").alias("id"), F.col("b").alias("root"))
    # Compose from the smallest map back to the first: only the last join is full size.
    roots = moves[-1]
    for move in reversed(moves[:-1]):
        later = roots.select(F.col("id").alias("root"), F.col("root").alias("final"))
        roots = move.join(later, "root", "left").select("id", F.coalesce("final", "root").alias("root"))
    return roots


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): undirected components named by their smallest id; isolated nodes stand alone."""
    roots = component_roots(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    named = roots.groupBy("root").agg(F.min("id").alias("component"))
    labels = roots.join(named, "root").select("id", "component")
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_seeds(membership: DataFrame, strength: DataFrame) -> DataFrame:
    """(component, seed, size): the busiest node per component."""
    from ..functions.scalars import natural_key

    rank = F.struct(-F.col("degree"), -F.round("strength", 6), natural_key("id"))
    return (
        membership.join(strength, "id")
        .groupBy("component")
        .agg(F.min_by("id", rank).alias("seed"), F.count(F.lit(1)).alias("size"))
    )
