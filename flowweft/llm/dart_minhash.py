"""Near-duplicate documents by DartMinHash signatures, banded candidates and exact checks.

A document is the weighted set of its shingles (five words; the weight is how often one occurs). Every unit of weight
of a shingle is a region into which darts fall at hashed times, one per unit of time on average, each aimed at one of
the signature's coordinates. A coordinate keeps the earliest dart that hit one of the document's regions. Only the
darts up to a time at which all coordinates are expected to be hit are thrown, so the work is the number of shingles
plus k log k, and two signatures agree in a coordinate with the probability of their weighted Jaccard similarity.

Candidates share a band of coordinates. In each bucket all members are first compared with one pivot. Where a bucket's
members did not all come together, those outside its largest part are compared with all of it, in blocks that hold
the members' regions and so count exactly what each pair has in common. A block returns a spanning forest of the links it
finds, never pairs: at most a row for each member, whatever the number of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import component_roots
from ..runtime import materialize, write_table
from .common import free_name, release_memory, row_keys

SHINGLE_WORDS = 5
_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(b"place%d" % i) | 1 for i in range(SHINGLE_WORDS)], np.uint64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection whose bits look independent."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words between white space."""
    words = (text or "").lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of a document's shingles; a text of fewer words than a shingle is one shingle."""
    n = max(1, len(words) - SHINGLE_WORDS + 1) if len(words) else 0
    total = np.full(n, len(words) if len(words) < SHINGLE_WORDS else 0, np.uint64)
    for i, m in enumerate(_MULTIPLIERS[: len(words)]):
        total += words[i:i + n] * m
    return np.unique(mix(total), return_counts=True)


def regions_of(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The units of weight of a weighted set, as a plain set of 64-bit names: weighted similarity is theirs."""
    with np.errstate(over="ignore"):
        first = np.repeat(np.cumsum(counts) - counts, counts)
        unit = (np.arange(counts.sum()) - first).astype(np.uint64)
        return mix(np.repeat(elements, counts) + unit * _GOLDEN)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    every = a[1].sum() + b[1].sum() - common
    return float(common / every) if every else 0.0


def signature(elements: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """``k`` dart names (32 bits) of a weighted set that is not empty."""
    regions = regions_of(elements, counts)
    until = (log(k) + 2) * k / len(regions)
    while True:
        times, darts = _throw(regions, until)
        aim = ((darts >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        order = np.argsort(-times, kind="stable")  # the earliest is written last
        kept = np.zeros(k, np.uint64)
        hit = np.zeros(k, bool)
        kept[aim[order]] = darts[order]
        hit[aim] = True
        if hit.all():
            return (mix(kept) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        until *= 2


def _throw(regions: np.ndarray, until: float) -> tuple[np.ndarray, np.ndarray]:
    """(times, names) of the darts that hit regions up to a time. Gaps between a region's darts are exponential."""
    done, names, begun = [], [], 0
    at = np.zeros(len(regions))
    while len(regions):
        m = max(2, int(until + 3 * sqrt(until)) + 1)
        with np.errstate(over="ignore"):
            number = np.arange(begun + 1, begun + m + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
            dart = mix(regions[:, None] + number[None])
            gap = -np.log(((mix(dart ^ _GOLDEN) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        gap[:, 0] += at
        times = np.cumsum(gap, axis=1)
        good = times <= until
        done.append(times[good])
        names.append(dart[good])
        more = good[:, -1]
        regions, at, begun = regions[more], times[more, -1], begun + m
    return np.concatenate(done), np.concatenate(names)


SIGNED = "doc_id long, k1 long, k2 long, n long, fp binary, sketch binary"


def _sign(k: int):
    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                words = word_hashes(text)
                elements, counts = shingles(words)
                sketch = signature(elements, counts, k).tobytes() if len(words) else b""
                rows.append((len(words), xxhash.xxh3_128_digest(words.tobytes()), sketch))
            made = pd.DataFrame(rows, columns=["n", "fp", "sketch"])
            yield pd.concat([frame[["doc_id", "k1", "k2"]].reset_index(drop=True), made], axis=1)
        _WORDS.clear()
        release_memory()

    return sign


def _agreeing(least: int):
    @F.pandas_udf("boolean")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum() >= least for x, y in zip(a, b, strict=True)], dtype=bool)

    return agree


def _cut_regions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(rep, size, regions) of texts; the regions sorted."""
    for frame in frames:
        found = [np.sort(regions_of(*shingles(word_hashes(text)))) for text in frame["text"]]
        yield pd.DataFrame({"rep": frame["rep"], "size": [len(r) for r in found], "regions": [r.tobytes() for r in found]})
    _WORDS.clear()
    release_memory()


def common_regions(left: list[np.ndarray], right: list[np.ndarray], at_once: int = 4096) -> np.ndarray:
    """How many regions each of the left sets shares with each of the right ones."""
    common = np.zeros((len(left), len(right)), np.float32)
    x, y = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(x, y)
    rows, columns = np.repeat(np.arange(len(left)), list(map(len, left))), np.repeat(np.arange(len(right)), list(map(len, right)))
    x_in, y_in = np.isin(x, shared), np.isin(y, shared)
    x_at, rows, y_at, columns = np.searchsorted(shared, x[x_in]), rows[x_in], np.searchsorted(shared, y[y_in]), columns[y_in]
    for begin in range(0, len(shared), at_once):
        n = min(at_once, len(shared) - begin)
        a, b = np.zeros((len(left), n), np.float32), np.zeros((len(right), n), np.float32)
        here, there = (x_at >= begin) & (x_at < begin + n), (y_at >= begin) & (y_at < begin + n)
        a[rows[here], x_at[here] - begin] = 1
        b[columns[there], y_at[there] - begin] = 1
        common += a @ b.T  # counts below 2**24 are exact
    return common


def _similar(least: float):
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(common / (len(x) + len(y) - common) >= least)
        return pd.Series(out, dtype=bool)

    return similar


def _stars(left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each component of the links one left member, with every other member of the component."""
    new_left, new_right = np.ones(len(left), bool), np.ones(len(right), bool)
    first, other = [], []
    for i in np.flatnonzero(linked.any(axis=1)):
        if not new_left[i]:
            continue
        rows = np.array([i])
        while len(rows):
            new_left[rows] = False
            columns = np.flatnonzero(linked[rows].any(axis=0) & new_right)
            new_right[columns] = False
            other += [left[rows], right[columns]]
            first.append(np.full(len(rows) + len(columns), left[i]))
            rows = np.flatnonzero(linked[:, columns].any(axis=1) & new_left)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *other])


def _blocks(least: float):
    """Stars (a, b) over the components of the links between different components in one pair of blocks."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group.side == 0], group[group.side == 1]
        a = b = np.zeros(0, np.int64)
        if len(left) and len(right):
            xs, ys = ([np.frombuffer(r, np.uint64) for r in side.regions] for side in (left, right))
            common = common_regions(xs, ys).astype(np.float64)
            every = np.array(list(map(len, xs)))[:, None] + np.array(list(map(len, ys)))[None] - common
            linked = (common / every >= least) & (left.component.to_numpy()[:, None] != right.component.to_numpy()[None])
            a, b = _stars(left.rep.to_numpy(), right.rep.to_numpy(), linked)
        return pd.DataFrame({"a": a, "b": b})[a != b].astype("int64")

    return compare


def near_duplicates(
    docs: DataFrame, least: float = 0.8, bands: int = 25, rows: int = 5, block_rows: int = 512, block_units: int = 1_000_000,
    doubt: float = 4.5,
) -> DataFrame:
    """Classes of documents whose shingles have a weighted Jaccard similarity of ``least`` or more, and all that
    such links connect.

    Rows (one per row of ``docs``): doc_id, class_id (smallest doc_id of the class), kept (true for one row of each
    class, the first by doc_id; null ids last), and the row's keys k1 and k2. Equal word sequences are folded first, so
    a group of copies is one row from then on. Null, empty and blank texts have no shingles: each is a class of its own.
    ``block_rows``, ``block_units``: members and regions that a block of a bucket holds about. ``doubt``: by how many standard
    errors the signatures' agreement with a pivot may lie below ``least`` before that pair is ruled out unread; all that does not
    come together with its bucket's largest part that way is compared exactly. Other columns are not read.
    """
    k = bands * rows
    enough = int(k * (least - doubt * sqrt(least * (1 - least) / k)))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_keys())
    signed = materialize(source.mapInPandas(_sign(k), SIGNED).withColumn("row", F.monotonically_increasing_id()))
    folded = materialize(signed.filter("n > 0").groupBy("fp").agg(
        F.min(F.struct("row", "k1", "k2", "sketch")).alias("m")
    ).select("fp", F.col("m.row").alias("rep"), "m.k1", "m.k2", "m.sketch"))
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(
        b, F.substring(F.col("sketch"), b * (4 * rows) + 1, F.lit(4 * rows))
    )))
    banded = folded.select("rep", band.alias("bucket"))
    buckets = materialize(banded.groupBy("bucket").agg(
        F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size")
    ).filter("size > 1"))
    members = materialize(banded.join(buckets, "bucket"))
    stars = members.filter("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    sketches = folded.select("rep", "sketch")
    likely = stars.join(sketches.toDF("b", "y"), "b").join(sketches.toDF("a", "x"), "a").filter(_agreeing(enough)("x", "y"))
    tried = materialize(likely.select("a", "b"))
    # The regions of all that shares a bucket with another, from one pass over the texts.
    places = folded.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "k1", "k2")
    texts = docs.select("text", *row_keys()).join(places, ["k1", "k2"]).dropDuplicates(["rep"]).select("rep", "text")
    cut = materialize(texts.mapInPandas(_cut_regions, "rep long, size long, regions binary"))
    sides = [cut.select(F.col("rep").alias(c), F.col("regions").alias(f"regions_{c}")) for c in "ab"]
    links = materialize(
        tried.join(sides[1], "b").join(sides[0], "a").filter(_similar(least)("regions_a", "regions_b")).select("a", "b")
    )
    roots = materialize(component_roots(links))

    # In buckets whose members are in several components, all but the largest are held against every member.
    labelled = materialize(
        members.filter("size > 2").select("bucket", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        .join(cut.select("rep", "size"), "rep").select("bucket", "rep", F.coalesce("root", "rep").alias("component"), "size")
    )
    shares = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("units"))
    main = shares.groupBy("bucket").agg(F.max(F.struct("n", "component", "units")).alias("m"), F.sum("n").alias("n"), F.sum("units").alias("units"))
    blocks = lambda n, units: F.ceil(F.greatest(n / block_rows, units / block_units)).cast("int")
    split = main.filter("n > m.n").select(
        "bucket", F.col("m.component").alias("main"), blocks(F.col("n"), F.col("units")).alias("wide"),
        blocks(F.col("n") - F.col("m.n"), F.col("units") - F.col("m.units")).alias("narrow"),
    )
    parts = labelled.select("bucket", "rep", "component").join(split, "bucket")
    place = lambda of, n: F.pmod(F.xxhash64(F.lit(of), "rep", "bucket"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    few = parts.filter("component != main").withColumn("side", F.lit(0)).withColumn("p", place(0, F.col("narrow"))).withColumn("q", each(F.col("wide")))
    all_ = parts.withColumn("side", F.lit(1)).withColumn("q", place(1, F.col("wide"))).withColumn("p", each(F.col("narrow")))
    columns = ["bucket", "p", "q", "side", "rep", "component"]
    both = few.select(*columns).unionByName(all_.select(*columns)).join(cut.select("rep", "regions"), "rep")
    more, n = write_table(both.groupBy("bucket", "p", "q").applyInPandas(_blocks(least), "a long, b long"))
    if n:
        roots = materialize(component_roots(links.unionByName(more)))

    classes = folded.select("fp", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left").select(
        "fp", F.coalesce("root", "rep").alias("component")
    )
    told = materialize(signed.filter("n > 0").select("doc_id", "k1", "k2", "row", "fp").join(classes, "fp").drop("fp"))
    first = told.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    )
    grouped = told.join(first, "component").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), (F.col("row") == F.col("first.row")).alias("kept"), "k1", "k2"
    )
    alone = signed.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), "k1", "k2")
    return grouped.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but one document of each class. Columns stay; of equal rows one stays."""
    a, b = free_name(docs, "k1"), free_name(docs, "k2")
    kept = near_duplicates(docs, **options).filter("kept").select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    hashed = docs.select("*", *row_keys(names=(a, b)))
    return hashed.join(kept, [a, b], "left_semi").dropDuplicates([a, b]).select(*docs.columns)
