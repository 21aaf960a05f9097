"""Views of a graph: helper contraction, folded neighbours, sections, dispatch."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.numbering import number_rows
from ..runtime import materialize, write_table
from ..schema import (
    LARGE_GRAPH_NODES,
    NODE_KINDS,
    PORTAL_ORDER,
    SECTION_HUB_THRESHOLD,
    SECTION_SIZE,
    SECTION_THRESHOLD,
)
from .aggregate import edge_types, package_overview, union_types
from .closure import reached
from .selection import edge_class, focus_function, function_catalog, induced, search_nodes


# Of each end of a focused view's link: is it of that function, and the other functions it stands in.
_ENDS = ["src_at", "dst_at"]


def _merged_links(edges: DataFrame, first_by: list[str], carried: Iterable[str] = ()) -> DataFrame:
    """One link per (src, dst, kind): first label, merged types, count of merged rows."""
    keep = F.struct(*first_by, "label", *carried)
    return (
        edges.groupBy("src", "dst", "kind")
        .agg(F.min(keep).alias("_first"), union_types(F.col("types")).alias("types"), F.sum("n").alias("n"))
        .select("src", "dst", "kind", "_first.label", *[f"_first.{c}" for c in (*first_by, *carried)], "types", "n")
    )


def _junctions(hops: DataFrame) -> tuple[DataFrame, int]:
    """Helpers with two or more links on both sides: contracting them would multiply links."""
    arriving = hops.filter("to_inner").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("into"))
    leaving = hops.filter("from_inner").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    return write_table(
        arriving.join(leaving, "id").filter((F.col("into") > 1) & (F.col("out") > 1)).select("id")
    )


def _near(hops: DataFrame) -> DataFrame:
    """Nodes of the focused function with links, and all that they meet through helpers."""
    both = F.explode(F.array(
        F.struct(F.lit("down").alias("dir"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("from_inner").alias("inner"), F.col("from_own").alias("own")),
        F.struct(F.lit("up").alias("dir"), F.col("dst").alias("a"), F.col("src").alias("b"), F.col("to_inner").alias("inner"), F.col("to_own").alias("own")),
    ))
    ways = hops.select(both.alias("e")).select("e.*")
    first = ways.filter("own AND NOT inner")
    start = first.select("dir", F.col("b").alias("at")).distinct()
    met = reached(materialize(ways.filter("inner").select("dir", "a", "b").distinct()), start)
    return materialize(met.select(F.col("at").alias("id")).unionByName(first.select(F.col("a").alias("id"))).distinct())


def visible_graph(
    nodes: DataFrame,
    edges: DataFrame,
    compact: bool = True,
    hidden: Iterable[str] = (),
    linear: bool = False,
    around: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Contract helper nodes: link visible nodes whose path runs through helpers only.

    A link's kind is the last kind on the path that is not a plain belt, its label
    comes from the first hop and its types from the last; links with equal (src,
    dst, kind) are merged. The edge-class filter looks at that final kind only, and
    nodes of a hidden layer are neither shown nor passed through.

    Rounds extend states (origin, helper, kind, types) by edges that leave helpers,
    so the cost per round is the frontier, not the graph. Each state keeps its first
    hop's position, hence the label of the first path found is well defined.

    Contracting a helper yields in-links x out-links pairs. With ``linear`` every helper
    with two or more links on both sides stays in the view as a junction (``role``): its
    links stand for all those pairs with the same reachability, in linear space. The rule
    is the caller's choice and does not depend on the size of the graph.

    An edge without a type (a hub's outgoing belt) passes on the types before it.

    ``around`` names a function a caller is going to focus on: links are then followed
    only among its nodes and what they reach through helpers, in either direction, and carry where their ends
    stand (``src_at``, ``dst_at``). Without hidden layers of edges these are the links that focusing keeps.
    """
    off = set(hidden)
    hidden_kinds = sorted(off & set(NODE_KINDS))
    shown_layer = ~F.col("kind").isin(hidden_kinds) if hidden_kinds else F.lit(True)
    inner = F.col("helper") if compact else F.lit(False)
    visible = nodes.filter(shown_layer & ~inner)
    ends = nodes.filter(shown_layer).select("id", inner.alias("inner"), *([(F.col("function") == around).alias("own")] if around else []))
    src, dst = (
        ends.withColumnsRenamed({"id": end, "inner": f"{way}_inner", "own": f"{way}_own"}) for end, way in (("src", "from"), ("dst", "to"))
    )
    hops = materialize(
        edges.select("src", "dst", "kind", "label", "seq", edge_types()[0].alias("type")).join(src, "src").join(dst, "dst")
    )

    visible = visible.withColumn("role", F.lit(None).cast("string"))
    if compact and linear:
        busy, found = _junctions(hops)
        if found:
            for end in ("src", "dst"):
                flag = "from_inner" if end == "src" else "to_inner"
                hops = hops.join(busy.select(F.col("id").alias(end), F.lit(True).alias("_busy")), end, "left").withColumn(
                    flag, F.col(flag) & F.col("_busy").isNull()
                ).drop("_busy")
            hops = materialize(hops)
            junctions = nodes.filter(shown_layer & inner).join(busy, "id", "left_semi")
            visible = visible.unionByName(junctions.select(*nodes.columns, F.lit("junction").alias("role")))

    near = None
    if around:
        near = _near(hops)
        visible = visible.filter(F.col("function") == around).unionByName(
            visible.filter(F.col("function") != around).join(near, "id", "left_semi")
        )

        own = F.col("function") == around
        near = materialize(near.join(visible.groupBy("id").agg(
            F.struct(F.max(own).alias("own"), F.collect_list(F.when(~own, F.col("function"))).alias("homes")).alias("at")
        ), "id"))

    def among(df: DataFrame, end: str) -> DataFrame:
        return df if near is None else df.join(near.select(F.col("id").alias(end), F.col("at").alias(f"{end}_at")), end)

    head, tail = (_ENDS[:1], _ENDS[1:]) if around else ([], [])
    key = ["src", "dst", "kind", "type"]
    columns = ["src", "dst", "kind", "type", "hops", "first", "label", *head, *tail]
    start = among(hops.filter(~F.col("from_inner") & (F.col("src") != F.col("dst"))), "src").select(
        "src", "dst", "kind", F.coalesce("type", F.lit("")).alias("type"), F.lit(1).alias("hops"),
        F.col("seq").alias("first"), "label", *head, "to_inner",
    )
    # Links that end are only gathered; the paths that go on are few and alone decide about further rounds.
    ended = [among(start.filter(~F.col("to_inner")), "dst").select(*columns)]
    if compact:
        open_ = columns[:len(columns) - len(tail)]

        def once(df: DataFrame) -> DataFrame:
            """First state per key, the way a breadth-first queue would meet it."""
            first = F.min(F.struct("first", "label", *head)).alias("f")
            return df.groupBy(*key, "hops").agg(first).select(*key, "hops", "f.*").select(*open_)

        onward = hops.filter("from_inner").select(
            F.col("src").alias("via"), "dst", F.col("kind").alias("next_kind"), F.col("type").alias("next_type"), "to_inner"
        ).distinct()
        through, out = materialize(onward.filter("to_inner")), materialize(among(onward.filter("NOT to_inner"), "dst"))

        def extended(frontier: DataFrame, by: DataFrame, *carried: str) -> DataFrame:
            return (
                frontier.join(by.withColumnRenamed("dst", "to"), F.col("dst") == F.col("via"))
                .filter(F.col("src") != F.col("to"))
                .select(
                    "src", F.col("to").alias("dst"),
                    F.when(F.col("next_kind") == "belt", F.col("kind")).otherwise(F.col("next_kind")).alias("kind"),
                    F.coalesce("next_type", "type").alias("type"), (F.col("hops") + 1).alias("hops"), "first", "label", *head, *carried,
                )
            )

        frontier, found = write_table(once(start.filter("to_inner")))
        rounds = [frontier]
        while found:
            step = once(extended(frontier, through))
            seen = reduce(DataFrame.unionByName, [r.select(*key) for r in rounds])
            frontier, found = write_table(step.join(seen, key, "left_anti").select(*open_))
            if found:
                rounds.append(frontier)
            if len(rounds) > 8:
                rounds = [materialize(reduce(DataFrame.unionByName, rounds))]
        ended.append(extended(reduce(DataFrame.unionByName, rounds), out, *tail).select(*columns))

    reached = reduce(DataFrame.unionByName, ended)
    for layer in sorted(off & {"train", "belt"}):
        reached = reached.filter(edge_class() != layer)
    # Hardly any two paths share a link, so rows move as they are and one sort where they arrive merges them.
    same = W.partitionBy("src", "dst", "kind").orderBy("hops", "first", "label")
    every = same.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    links = (
        reached.repartition("src", "dst", "kind")
        .withColumns({"_place": F.row_number().over(same), "types": F.collect_set("type").over(every)})
        .filter("_place = 1")
        .select("src", "dst", "kind", "label", F.sort_array("types").alias("types"), F.col("first").alias("seq"), *head, *tail)
    )
    if around:
        links = materialize(links)  # every further step of a focused view reads them
    return visible, links.select(link_id().alias("id"), "src", "dst", "kind", "label", "types", "seq", *head, *tail)


def link_id() -> Column:
    return F.concat_ws("|", "src", "dst", "kind")


def portal_representative(all_nodes: DataFrame, shown: DataFrame, links: DataFrame) -> DataFrame:
    """Per folded function the node that stands for it, and whether a train stops there.

    Order of preference: the first node at a train link, then the first node of the
    best kind (warehouse, rocket, station, machine, output), then the first shown node.
    """
    # Preference of kinds for a folded workshop.
    kinds = ("warehouse", "rocket", "station", "machine", "output")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")), F.lit(0))
    rank = F.when(rank == 0, len(kinds) + 1).otherwise(rank)
    stops = links.filter(F.col("kind") == "train").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    folded = shown.select("function").distinct()
    train = stops.withColumn("train", F.lit(True))
    first_shown = shown.select("id", F.lit(True).alias("shown"))
    peers = (
        all_nodes.join(folded, "function", "left_semi")
        .select("id", "function", "kind", "seq")
        .join(train, "id", "left")
        .join(first_shown, "id", "left")
        .withColumn("train", F.coalesce("train", F.lit(False)))
        .filter(F.col("train") | (rank <= len(kinds)) | F.col("shown"))
    )
    order = F.struct(~F.col("train"), F.when(F.col("train"), 0).otherwise(rank), ~F.coalesce("shown", F.lit(False)) & (rank > len(kinds)), "seq")
    return peers.groupBy("function").agg(
        F.min_by(F.struct("id", "kind"), order).alias("r"), F.max("train").alias("train")
    ).select("function", F.col("r.id").alias("id"), F.when(F.col("train"), "station").otherwise(F.col("r.kind")).alias("kind"))


def fold_portals(
    all_nodes: DataFrame, functions: DataFrame, nodes: DataFrame, links: DataFrame, fn: str
) -> tuple[DataFrame, DataFrame]:
    """Every other function of a focused view becomes one node; its links move there and merge.

    ``links`` are read twice, so a caller writes them first if they take long. Links that carry the functions of
    their ends (``visible_graph`` around ``fn``) need not meet the nodes again.
    """
    nodes = materialize(nodes)
    other = nodes.filter(F.col("function") != fn)
    portal_id = F.concat(F.lit("portal:"), F.col("function"))
    names = functions.select(F.col("id").alias("function"), "name")
    portals = (
        portal_representative(all_nodes, other, links)
        .withColumnRenamed("id", "representative")
        .join(names, "function", "left")
        .select(
            portal_id.alias("id"), "kind", "function",
            F.concat(F.coalesce("name", S.short_function("function")), F.lit(" ↗")).alias("label"),
            F.lit(float(PORTAL_ORDER)).alias("ord"), "representative", F.lit("portal").alias("role"),
        )
    )
    own = nodes.filter(F.col("function") == fn).select(
        "id", "kind", "function", "label", "ord", F.col("id").alias("representative"), F.lit(None).cast("string").alias("role")
    )
    if set(_ENDS) <= set(links.columns):
        moved = links.withColumn("src_to", F.explode_outer("src_at.homes")).withColumn("dst_to", F.explode_outer("dst_at.homes"))
        moved = moved.withColumns({c: F.concat(F.lit("portal:"), c) for c in ("src_to", "dst_to")})
    else:
        home = other.select(F.col("id").alias("at"), portal_id.alias("to"))
        moved = links.join(home.select(F.col("at").alias("src"), F.col("to").alias("src_to")), "src", "left").join(
            home.select(F.col("at").alias("dst"), F.col("to").alias("dst_to")), "dst", "left"
        )
    moved = moved.withColumns(
        {"src": F.coalesce("src_to", "src"), "dst": F.coalesce("dst_to", "dst"), "n": F.lit(1).cast("bigint")}
    ).filter(F.col("src") != F.col("dst"))
    merged = _merged_links(moved, ["seq", "id"])
    return materialize(own.unionByName(portals)), materialize(
        merged.select("id", "src", "dst", "kind", "label", "types", "seq", "n")
    )


def number_operations(nodes: DataFrame, fn: str, section_size: int = SECTION_SIZE) -> DataFrame:
    """Operations of one function with their 0-based section, in (ord, natural id) order."""
    own = nodes.filter(F.col("function") == fn)
    if "role" in nodes.columns:
        own = own.filter(F.col("role").isNull() | (F.col("role") != "portal"))
    numbered = number_rows(own, [], [F.col("ord"), S.natural_key("id")])
    return numbered.withColumn("section", F.floor((F.col("rn") - 1) / section_size).cast("int"))


def section_catalog(nodes: DataFrame, fn: str, section_size: int = SECTION_SIZE) -> DataFrame:
    """One row per section of a function with its first operation."""
    return (
        number_operations(nodes, fn, section_size)
        .groupBy("section")
        .agg(F.min_by("id", "rn").alias("first_id"), F.count(F.lit(1)).alias("operations"))
        .select(
            F.concat(F.lit(f"section:{fn}:"), F.col("section").cast("string")).alias("id"),
            F.concat(F.lit("Участок "), (F.col("section") + 1).cast("string")).alias("label"),
            "section", "first_id", "operations",
        )
    )


@dataclass
class View:
    """A projected view: what is shown and, for sections, which links stand for which edges."""

    mode: str
    nodes: DataFrame
    edges: DataFrame | None = None
    members: DataFrame | None = None
    section: int = 0
    sections: int = 0
    operations: int = 0


def section_view(
    nodes: DataFrame, links: DataFrame, fn: str, part: int = 0, undivided: int | None = SECTION_THRESHOLD,
    section_size: int = SECTION_SIZE, single_portals: int = SECTION_HUB_THRESHOLD,
) -> View:
    """One section of a large function with portals for whatever its links touch elsewhere.

    ``members`` lists the merged edge ids in long form: a hub link may stand for any
    number of edges, so they are rows and not one array.

    A function of at most ``undivided`` operations is shown whole (None: always); beyond
    ``single_portals`` sections the others share one portal a direction.
    """
    if undivided is None:
        return View("operations", nodes, links, links.select(link_id().alias("link"), F.col("id").alias("edge_id")))
    numbered = materialize(number_operations(nodes, fn, section_size))
    size = numbered.count()
    if size <= undivided:
        return View("operations", nodes, links, links.select(link_id().alias("link"), F.col("id").alias("edge_id")))
    total = -(-size // section_size)
    if part < 0:
        return View("catalog", section_catalog(nodes, fn, section_size), sections=total, operations=size)
    part = min(part, total - 1)
    here = numbered.filter(F.col("section") == part)
    # At most section_size ids, so the broadcast is bounded.
    chosen = F.broadcast(here.select("id"))
    touching = materialize(
        links.join(chosen.select(F.col("id").alias("src"), F.lit(True).alias("src_in")), "src", "left")
        .join(chosen.select(F.col("id").alias("dst"), F.lit(True).alias("dst_in")), "dst", "left")
        .filter(F.col("src_in") | F.col("dst_in"))
    )
    elsewhere = materialize(
        touching.filter(F.col("src_in").isNull() | F.col("dst_in").isNull()).select(
            F.when(F.col("src_in"), F.col("dst")).otherwise(F.col("src")).alias("id"),
            F.col("src_in").isNull().alias("inbound"), F.col("kind").alias("link_kind"), "seq",
        )
    )
    sections = numbered.select("id", "section")
    hub = total > single_portals

    def key(inbound: Column) -> Column:
        own = F.concat(F.lit(f"section-hub:{fn}:"), inbound.cast("string")) if hub else F.concat(
            F.lit(f"section:{fn}:"), F.col("section").cast("string")
        )
        return F.when(F.col("section").isNull(), F.concat(F.lit("portal:"), "function")).otherwise(own)

    def label(inbound: Column) -> Column:
        # Labels of the two hubs and of a neighbouring section.
        own = F.when(inbound, "Входы других участков ↗").otherwise("Другие участки ↗") if hub else F.concat(
            F.lit("Участок "), (F.col("section") + 1).cast("string"), F.lit(" ↗")
        )
        return F.when(F.col("section").isNull(), F.col("label")).otherwise(own)

    facts = nodes.select("id", "kind", "label", "function")
    at = elsewhere.join(facts, "id").join(sections, "id", "left")
    role = F.when(F.col("section").isNull(), "portal").otherwise("section-hub" if hub else "section")
    portals = (
        at.select(
            key(F.col("inbound")).alias("id"), "function", "seq", "link_kind",
            F.struct(
                "seq", ~F.col("inbound"), F.when(F.col("link_kind") == "train", "station").otherwise(F.col("kind")).alias("kind"),
                label(F.col("inbound")).alias("label"), role.alias("role"),
                (F.lit(float(PORTAL_ORDER)) + F.coalesce("section", F.lit(0))).alias("ord"),
            ).alias("f"),
        )
        .groupBy("id", "function")
        .agg(F.min("f").alias("f"), F.max(F.col("link_kind") == "train").alias("train"))
        .select(
            "id", F.when(F.col("train"), "station").otherwise(F.col("f.kind")).alias("kind"), F.col("f.label").alias("label"),
            "function", F.col("f.ord").alias("ord"), F.col("f.role").alias("role"),
        )
    )
    away = at.select("id", "inbound", key(F.col("inbound")).alias("portal")).distinct()
    moved = (
        touching.join(away.filter("inbound").select(F.col("id").alias("src"), F.col("portal").alias("src_to")), "src", "left")
        .join(away.filter("NOT inbound").select(F.col("id").alias("dst"), F.col("portal").alias("dst_to")), "dst", "left")
        .withColumns({
            "src": F.when(F.col("src_in"), F.col("src")).otherwise(F.col("src_to")),
            "dst": F.when(F.col("dst_in"), F.col("dst")).otherwise(F.col("dst_to")),
            "n": F.lit(1).cast("bigint"),
        })
        .select("id", "src", "dst", "kind", "label", "types", "seq", "n")
    )
    shown = here.select(
        "id", "kind", "label", "function", "ord", F.lit(None).cast("string").alias("role")
    ).unionByName(portals.select("id", "kind", "label", "function", "ord", "role"))
    merged = _merged_links(moved, ["seq", "id"]).select(link_id().alias("id"), "src", "dst", "kind", "label", "types", "n", "seq")
    members = moved.select(link_id().alias("link"), F.col("id").alias("edge_id"))
    return View("operations", shown, merged, members, part, total, size)


@dataclass
class ViewOptions:
    fn: str = ""
    pkg: str = ""
    query: str = ""
    part: int = 0
    compact: bool = True
    hidden: tuple[str, ...] = field(default_factory=tuple)


def project_view(
    functions: DataFrame, nodes: DataFrame, edges: DataFrame, options: ViewOptions, whole_nodes: int | None = LARGE_GRAPH_NODES,
    undivided: int | None = SECTION_THRESHOLD, linear: bool = False,
) -> View:
    """The view a request asks for: overview, catalogue, whole graph or one function.

    Without a function, a graph of more than ``whole_nodes`` nodes is shown by packages
    (None: always whole). ``undivided`` is that of section_view, ``linear`` that of visible_graph.
    """
    if not options.fn and whole_nodes is not None and nodes.count() > whole_nodes:
        if options.pkg or options.query:
            return View("catalog", function_catalog(functions, nodes, options.pkg, options.query))
        packages, flows = package_overview(functions, nodes, edges, options.hidden)
        return View("packages", packages, flows)
    shown, links = visible_graph(nodes, edges, options.compact, options.hidden, linear, around=options.fn)
    if options.fn:
        shown, links = focus_function(shown, links, options.fn, focused=not set(options.hidden) & {"train", "belt"})
    if options.query.strip():
        shown = search_nodes(shown, links, options.query)
        links = materialize(induced(shown, links)) if options.fn else induced(shown, links)
    if not options.fn:
        return View("operations", shown, links)
    if options.compact:
        shown, links = fold_portals(nodes, functions, shown, links, options.fn)
    return section_view(shown, links, options.fn, options.part, undivided)
