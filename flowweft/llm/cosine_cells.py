"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors are first folded into one. Spherical k-means gives every vector a home cell. A partner y of x (angle at
most theta) has its home in cell c only if the plane between the centres of c and of x's cell is no further from x
than theta: x . (c1 - c) <= sin(theta) |c1 - c|. So x visits exactly the cells beyond its own for which this holds,
and no link is lost however the centres lie. ``reach`` scales the right side: 1 is exact, less is faster.

Vectors of different lengths never meet: the length is part of a cell's name. One set of centres serves all lengths,
as the bound holds for any centres: a shorter vector counts as one with zeros behind it, a longer one meets centres
with zeros behind them.

Cells are cut into blocks of bounded size; a task multiplies one block of residents with one block of residents or
visitors. It returns link counts and a spanning forest of what it found, never the pairs themselves, so a group of m
near copies costs m rows a block. The forests together have the components of the whole link graph.
"""

from __future__ import annotations

from math import acos, sin

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import component_roots
from ..runtime import materialize, write_table
from .vectors import identity, unit_rows, usable

FOUND = "rep long, root long, n long"


def centres(folded: DataFrame, rows: int, cell_rows: int, max_cells: int, train_rows: int, seed: int) -> np.ndarray:
    """Centres of spherical k-means, at most ``max_cells``, fitted on about ``train_rows`` rows chosen by hash.

    They have the length of most vectors (ties: the longer); others are cut or filled with zeros to fit.
    """
    k = min(max_cells, -(-rows // cell_rows))
    common = folded.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    if k < 2 or common is None:
        return np.zeros((1, common.w if common else 1))
    share = F.pmod(F.xxhash64("k1", "k2"), F.lit(1_000_000)) < F.lit(max(1, int(1_000_000 * min(1.0, train_rows / rows))))
    fitted = F.slice(F.concat("v", F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(common.w) - F.col("w")))), 1, common.w)
    sample = folded.filter(share).select(fitted.alias("x")).filter(F.exists("x", lambda c: c != 0))
    sample = materialize(sample.select(array_to_vector("x").alias("features")))
    if sample.isEmpty():
        return np.zeros((1, common.w))
    model = KMeans(k=k, distanceMeasure="cosine", maxIter=8, seed=seed, initSteps=2).fit(sample)
    found = np.array(model.clusterCenters())
    size = np.linalg.norm(found, axis=1, keepdims=True)
    return found[size[:, 0] > 0] / size[size[:, 0] > 0]


def homes_and_visits(centre: np.ndarray, least: float, reach: float):
    """For batches of vectors: home cell, and the later cells that may hold a partner."""
    gap = np.linalg.norm(centre[:, None] - centre[None], axis=2) if len(centre) <= 512 else None
    slack = reach * sin(acos(least)) * (1 + 1e-9) + 1e-9

    def place(batches):
        for frame in batches:
            for _, alike in frame.groupby(frame["v"].map(len)):
                x = unit_rows(alike["v"])
                shared = min(x.shape[1], centre.shape[1])
                near = x[:, :shared] @ centre[:, :shared].T
                home = near.argmax(axis=1)
                apart = gap[home] if gap is not None else np.sqrt(np.maximum(0, 2 - 2 * centre[home] @ centre.T))
                visits = near[np.arange(len(home)), home][:, None] - near <= slack * apart
                visits &= np.arange(len(centre))[None] > home[:, None]
                yield alike.assign(home=home.astype("int32"), visits=[np.flatnonzero(row).astype("int32") for row in visits])

    return place


def _forest(rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) for both ends of the links in one block."""
    r, c = np.nonzero(linked)
    by_c = np.argsort(c, kind="stable")
    row_at, row_first = np.unique(r, return_index=True)
    column_at, column_first = np.unique(c[by_c], return_index=True)
    row_label, column_label = rows.copy(), columns.copy()
    while len(r):
        was = (row_label[row_at], column_label[column_at])
        row_label[row_at] = np.minimum(was[0], np.minimum.reduceat(column_label[c], row_first))
        column_label[column_at] = np.minimum(was[1], np.minimum.reduceat(row_label[r[by_c]], column_first))
        if (row_label[row_at] == was[0]).all() and (column_label[column_at] == was[1]).all():
            break
    return np.concatenate([rows[row_at], columns[column_at]]), np.concatenate([row_label[row_at], column_label[column_at]])


def block_links(least: float):
    """Links between one block of residents and one of residents or visitors of a cell."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        here, there = group[group.role == 0], group[group.role != 0]
        if not len(here) or not len(there):
            return pd.DataFrame({"rep": [], "root": [], "n": []}).astype("int64")
        a, b = there.rep.to_numpy(), here.rep.to_numpy()
        linked = unit_rows(there["v"]) @ unit_rows(here["v"]).T >= least
        linked &= a[:, None] != b[None]
        visiting = (there.role == 2).to_numpy()
        ids, roots = _forest(a, b, linked)
        out = [
            pd.DataFrame({"rep": ids, "root": roots, "n": 0})[ids != roots],
            pd.DataFrame({"rep": a, "root": a, "n": linked @ here.copies.to_numpy()}),
            # Residents meet each other in both roles; a visitor's links are told to the resident here.
            pd.DataFrame({"rep": b, "root": b, "n": linked[visiting].T @ there.copies.to_numpy()[visiting]}),
        ]
        found = pd.concat(out).astype("int64")
        return found[(found.n > 0) | (found.rep != found.root)]

    return compare


def near_vectors(
    vectors: DataFrame, least: float = 0.95, reach: float = 1.0, cell_rows: int = 2048, block_rows: int = 2048,
    max_cells: int = 4096, train_rows: int = 100_000, seed: int = 1,
) -> DataFrame:
    """Link counts and groups of vectors with cosine ``least`` or more, in double precision.

    Rows (one per row of ``vectors``): vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    reachable), kept (vec_id = component_id). Vectors that are null, zero, or that hold null or non-finite components
    link with nothing, and vectors of different lengths not with each other; without an id component_id is null and
    kept false. Repeated rows count as vectors of their own, and so do different vectors under one id: each has its
    links and its component. An empty table gives no rows. Other columns are not read.
    """
    keyed = materialize(usable(vectors).select("vec_id", "v", "w", *identity()))
    # Different vectors are numbered once, in a written table: an id may stand for several of them.
    folded, rows = write_table(keyed.groupBy("k1", "k2").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v"), F.any_value("w").alias("w")
    ).withColumn("rep", F.monotonically_increasing_id()))
    centre = centres(folded, rows, cell_rows, max_cells, train_rows, seed)
    placed = materialize(folded.select("rep", "copies", "v", "w").mapInPandas(
        homes_and_visits(centre, least, reach), "rep long, copies long, v array<double>, w int, home int, visits array<int>"
    ))
    stays = placed.select("w", F.col("home").alias("cell"), "rep", "copies", "v", F.lit(1).alias("role"))
    goes = placed.select("w", F.explode("visits").alias("cell"), "rep", "copies", "v", F.lit(2).alias("role"))
    probes = stays.unionByName(goes)
    blocks = lambda n: F.ceil(n / F.lit(block_rows)).cast("int")
    at = ["w", "cell"]
    sizes = placed.select("w", F.explode(F.concat(F.array("home"), "visits")).alias("cell")).groupBy(*at).agg(
        blocks(F.count(F.lit(1))).alias("there")
    ).join(placed.groupBy("w", F.col("home").alias("cell")).agg(blocks(F.count(F.lit(1))).alias("here")), at)
    sizes = materialize(sizes)  # a row per length and cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep", F.lit(n)), F.col(n)).cast("int")
    residents = stays.withColumn("role", F.lit(0)).join(sizes, at).withColumn("a", own("here")).withColumn("b", every("there"))
    others = probes.join(sizes, at).withColumn("b", own("there")).withColumn("a", every("here"))
    columns = [*at, "a", "b", "rep", "copies", "v", "role"]
    found = materialize(
        residents.select(*columns).unionByName(others.select(*columns)).groupBy(*at, "a", "b")
        .applyInPandas(block_links(least), FOUND)
    )
    counts = found.filter("n > 0").groupBy("rep").agg(F.sum("n").alias("n"))
    edges = found.filter("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    roots = materialize(component_roots(edges).withColumnRenamed("id", "rep"))
    named = roots.join(folded.select("rep", "first"), "rep").groupBy("root").agg(F.min("first").alias("component"))
    labels = roots.join(named, "root").select("rep", "component")
    classes = folded.join(counts, "rep", "left").join(labels, "rep", "left").select(
        "k1", "k2", F.coalesce("component", "first").alias("component"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    linked = keyed.select("vec_id", "k1", "k2").join(classes, ["k1", "k2"]).select(
        "vec_id", "n_links", F.col("component").alias("component_id")
    )
    return _with_rest(vectors, linked)


def _with_rest(vectors: DataFrame, linked: DataFrame) -> DataFrame:
    """Add the rows that took no part. Ids may repeat, so rows are counted per id, not joined one by one."""
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    signed = every.select("vec_id", F.lit(1).alias("n")).unionByName(linked.select("vec_id", F.lit(-1).alias("n")))
    missing = signed.groupBy("vec_id").agg(F.sum("n").alias("n")).filter("n > 0")
    alone = missing.select("vec_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    rows = linked.select("vec_id", F.col("n_links").cast("long"), "component_id").unionByName(alone)
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
