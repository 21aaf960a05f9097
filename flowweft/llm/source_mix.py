"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's target asks each of its documents for some expected number of copies. The whole part is certain. For
the rest a document has the inclusion odds p / (1 - p) of its fraction p and draws random odds u / (1 - u); documents
are ranked by random odds divided by inclusion odds, and the first in that order are taken until the source's words
are used up. This gives a sample of fixed size (in words) with unequal probabilities. A document too long for the
words left would end the order early, so the order is swept again over those that still fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbering import running_sum
from ..runtime import materialize
from .common import free_name, row_keys

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: Sequence[float], share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Add ``target`` (words) to one row per source (source, source_size).

    Sources in code point order, null last, weigh ``weights``, repeating. They share ``share`` of all words; a target
    stops at ``most`` times the source's words and the excess is reshared by weight until no target is above.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")  # one row per source
    weighed = sources.withColumn("_w", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    )).withColumn("_top", F.col("source_size") * F.lit(float(most)))
    # Sources reach their top in the order of top / weight: find the first that does not.
    filling = W.orderBy(F.col("_top") / F.col("_w"), F.col("source").isNull(), "source")
    earlier, later = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_top").over(earlier), F.lit(0.0))) / F.sum("_w").over(later)
    level_at = weighed.withColumn("_level", level).withColumn("_place", F.row_number().over(filling))
    free = F.when(F.col("_top") > F.col("_w") * F.col("_level"), F.struct("_place", "_level"))
    first = level_at.withColumn("_free", F.min(free).over(everything))
    target = F.when(F.col("_place") < F.coalesce(F.col("_free._place"), F.col("_place") + 1), F.col("_top")).otherwise(
        F.col("_w") * F.col("_free._level")
    )
    return first.select("source", "source_size", target.alias("target"))


def _uniform(seed: int):
    """A number in (0, 1) from the document id's md5: the same on every run and in every engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, seed: int = 7,
    size: str | None = None, doc_weight: str | None = None, keep: Sequence[str] = (), sweeps: int = 3,
) -> DataFrame:
    """Copies of every document for a mix with given source weights.

    Rows (one per row of ``docs``, none dropped): doc_id, source, size, source_size, target (of its source), copies,
    taken (copies times size) and the columns named in ``keep``. ``size`` names a column of words, else they are
    counted in ``text`` (null: 0). ``doc_weight`` names a column of relative weights inside a source (null: 1, all
    1 if unset): expected copies are in proportion, at most ``most``.

    Null sources form one source. Documents without words are never taken. The last document of a source's order is
    chosen so that its words come nearest to the target. Equal rows share their random number and are told apart by
    their place in a written table. An empty table gives no rows.
    """
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)) if size is None else F.col(size)
    weight = F.lit(1.0) if doc_weight is None else F.coalesce(F.col(doc_weight).cast("double"), F.lit(1.0))
    rows = materialize(docs.select(
        *dict.fromkeys(["doc_id", "source", *keep]), words.cast("long").alias("size"), weight.alias("_dw"),
        _uniform(seed).alias("_u"), F.monotonically_increasing_id().alias("_row"),
    ))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_dw")).alias("_mass"))
    targets = materialize(
        source_targets(sums.select("source", "source_size"), weights, share, most).alias("t")
        .join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")))
        .select(F.col("t.source").alias("_source"), "t.source_size", "t.target", "_mass")
    )
    expected = F.when(
        F.col("_mass") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("_mass") * F.col("_dw"))
    ).otherwise(0.0)
    drawn = (
        rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_expected", expected)
        .withColumn("_whole", F.floor("_expected").cast("long"))
        .withColumn("_p", F.col("_expected") - F.col("_whole"))
    )
    odds = F.col("_u") / (1 - F.col("_u")) / (F.col("_p") / (1 - F.col("_p")))
    state = drawn.withColumn("_open", (F.col("_p") > 0) & (F.col("size") > 0)).withColumn(
        "_q", F.when(F.col("_open"), odds).otherwise(F.lit(float("inf")))
    ).withColumn("_extra", F.lit(False))
    used = F.col("_whole") * F.col("size")
    for _ in range(sweeps):
        left = state.groupBy("source").agg((F.max("target") - F.sum(used)).alias("_left")).select(F.col("source").alias("_s"), "_left")
        told = state.join(left, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        fits = F.col("_open") & ~F.col("_extra") & (F.col("size") <= F.col("_left"))
        ranked = running_sum(
            told.withColumn("_ask", F.when(fits, F.col("size")).otherwise(0)),
            ["source"], [F.col("_q"), F.col("doc_id"), F.col("_row")], "_ask", "_sum",
        )
        first = (F.col("_ask") > 0) & (F.col("_sum") <= F.col("_left"))
        state = ranked.withColumn("_extra", F.col("_extra") | first).drop("_left", "_ask", "_sum")
        used = (F.col("_whole") + F.col("_extra").cast("long")) * F.col("size")
    gaps = state.groupBy("source").agg((F.max("target") - F.sum(used)).alias("_gap")).select(F.col("source").alias("_s"), "_gap")
    near = state.join(gaps, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    miss = F.abs(F.col("size") - F.col("_gap"))
    last = near.filter(F.col("_open") & ~F.col("_extra") & (miss < F.col("_gap"))).groupBy("source").agg(
        F.min(F.struct(miss.alias("m"), F.col("_q"), F.col("doc_id"), F.col("_row"))).alias("_last")
    ).select(F.col("source").alias("_s"), F.col("_last._row").alias("_last"))
    done = near.join(last, F.col("source").eqNullSafe(F.col("_s")), "left")
    copies = F.col("_whole") + (F.col("_extra") | F.coalesce(F.col("_row") == F.col("_last"), F.lit(False))).cast("long")
    return done.select(
        *dict.fromkeys(["doc_id", "source", *keep]), "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def draw_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as ``mix_sources`` says, columns unchanged.

    Only ids, sources, sizes and row hashes go through the ranking; texts move once, to meet their copies.
    """
    a, b, n, copy = (free_name(docs, x) for x in ("k1", "k2", "copies", "copy"))
    narrow = docs.select("doc_id", "source", "text", *row_keys("source"))
    copies = mix_sources(narrow, keep=["k1", "k2"], **options).groupBy(F.col("k1").alias(a), F.col("k2").alias(b)).agg(
        F.sum("copies").alias(n)
    )
    hashed = docs.select("*", *row_keys("source", names=(a, b)))
    each = F.explode(F.sequence(F.lit(1), F.col(n)))
    return (
        hashed.join(copies.filter(F.col(n) > 0), [a, b]).dropDuplicates([a, b]).withColumn(copy, each).select(*docs.columns)
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w, 3.0::DOUBLE * source_size AS top FROM s),
l AS (
  SELECT *, row_number() OVER f AS place,
    ((SELECT sum(source_size) FROM s) - coalesce(sum(top) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW f AS (ORDER BY top / w, source IS NULL, source)),
x AS (SELECT min(place) AS place, min_by(level, place) AS level FROM l WHERE top > w * level),
t AS (SELECT l.source, l.source_size, CASE WHEN l.place < coalesce(x.place, l.place + 1) THEN l.top ELSE l.w * x.level END AS target FROM l, x),
e AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(3.0, t.target / t.source_size) ELSE 0 END AS expected
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p FROM e),
o AS (SELECT *, p > 0 AND size > 0 AS open, CASE WHEN p > 0 AND size > 0 THEN u / (1 - u) / (p / (1 - p)) ELSE 'inf'::DOUBLE END AS q FROM p),
s0 AS (SELECT *, false AS extra FROM o),
SWEEPS
g AS (SELECT *, target - sum((whole + extra::BIGINT) * size) OVER (PARTITION BY source) AS gap FROM s3),
z AS (
  SELECT *, CASE WHEN open AND NOT extra AND abs(size - gap) < gap THEN row_number() OVER (
    PARTITION BY source, open AND NOT extra AND abs(size - gap) < gap ORDER BY abs(size - gap), q, doc_id) END AS near
  FROM g)
SELECT doc_id, size, source_size, target, ((whole + (extra OR coalesce(near = 1, false))::BIGINT) * size)::BIGINT AS taken FROM z
""".replace("SWEEPS", "".join(f"""
l{k} AS (SELECT *, target - sum((whole + extra::BIGINT) * size) OVER (PARTITION BY source) AS words FROM s{k - 1}),
a{k} AS (SELECT *, CASE WHEN open AND NOT extra AND size <= words THEN size ELSE 0 END AS ask FROM l{k}),
f{k} AS (SELECT *, sum(ask) OVER (PARTITION BY source ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) AS filled FROM a{k}),
s{k} AS (SELECT * EXCLUDE (extra, words, ask, filled), extra OR (ask > 0 AND filled <= words) AS extra FROM f{k}),""" for k in (1, 2, 3)))
