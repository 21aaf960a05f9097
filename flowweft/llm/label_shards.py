"""Sharding by balanced label propagation. DataFrame functions only.

Documents that belong together (members of one group) should share a shard, and shards should hold the same number
of bytes. Every document starts in the shard its hash names. In each round a group votes for the shard that holds
most of its bytes, and members elsewhere move there with the probability that keeps the shard within its quota.
Groups stand between their members, so no pair of members is ever listed and a group of any size is one row of
votes. At the end every shard keeps linked documents first, gives away what is above an equal share, and the rest is
laid out over the free places in one sweep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbering import number_rows, running_sum
from ..runtime import materialize


def _chance(*parts):
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / F.lit(1_000_003.0)


def propagate(items: DataFrame, members: DataFrame, shards: int, rounds: int = 6, slack: float = 0.3) -> DataFrame:
    """(item, size, shard) after ``rounds`` rounds of label propagation.

    ``items``: item (unique), size. ``members``: item, hub; an edge is a hub with two members, a clique a hub with
    many. ``slack``: how far above an equal share a shard may grow meanwhile. Items without hubs never move.

    An item wishes to be in the shard where most of its neighbours' bytes are; a hub passes on the two shards that hold
    most of its bytes, so that a member can leave its own bytes out. Between two shards moves go one way a round, by
    a coin, or pairs would change places for ever.
    """
    state = materialize(items.select("item", "size", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard")))
    total = state.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first().t
    limit = total / shards * (1 + slack)
    for k in range(rounds):
        placed = members.join(state, "item")
        votes = placed.groupBy("hub", "shard").agg(F.sum("size").alias("w"))
        vote = F.struct("w", F.xxhash64("hub", "shard").alias("tie"), F.col("shard").alias("to"))
        best = materialize(votes.groupBy("hub").agg(  # at most ``shards`` rows a hub are collected
            F.slice(F.sort_array(F.collect_list(vote), False), 1, 2).alias("best")
        ))
        ballots = placed.join(best, "hub").select("item", "size", "shard", "hub", F.explode("best").alias("v")).select(
            "item", "size", "shard", "hub", "v.to",
            (F.col("v.w") - F.when(F.col("v.to") == F.col("shard"), F.col("size")).otherwise(0)).alias("w"),
        ).filter("w > 0")
        choice = ballots.groupBy("item", "size", "shard", "to").agg(F.sum("w").alias("w"), F.min("hub").alias("hub")).groupBy(
            "item", "size", "shard"
        ).agg(F.max(F.struct("w", F.col("to") == F.col("shard"), F.xxhash64("hub", "to").alias("tie"), "to", "hub")).alias("c"))
        coin = (F.pmod(F.xxhash64(F.least("shard", "to"), F.greatest("shard", "to")), F.lit(2)) + k) % 2 == 0
        wishes = materialize(
            choice.select("item", "size", "shard", "c.to", "c.hub").filter("to != shard").filter((F.col("to") < F.col("shard")) == coin)
        )
        load = state.groupBy("shard").agg(F.sum("size").alias("load"))
        leaving = wishes.groupBy("shard").agg(F.sum("size").alias("out"))
        coming = wishes.groupBy(F.col("to").alias("shard")).agg(F.sum("size").alias("in"))
        room = F.greatest(F.lit(0.0), F.lit(limit) - F.coalesce("load", F.lit(0))) + F.coalesce("out", F.lit(0)) / 2
        quota = coming.join(load, "shard", "left").join(leaving, "shard", "left").select(
            F.col("shard").alias("to"), (room / F.col("in")).alias("p")
        )
        moved = wishes.join(quota, "to").filter(_chance("hub", "shard", F.lit(k)) < F.col("p")).select("item", F.col("to").alias("_to"))
        state = materialize(
            state.join(moved, "item", "left").select("item", "size", F.coalesce("_to", "shard").alias("shard"))
        )
    return state


def level_out(state: DataFrame, linked: DataFrame, shards: int) -> DataFrame:
    """(item, shard) with nearly equal sums of size: what exceeds an equal share fills the free places.

    A shard keeps linked items first and larger ones before smaller; what it gives away, groups together and
    small items last, is laid over the free places of the other shards in order.
    """
    marked = state.join(linked.select("item", F.lit(1).alias("_linked"), "hub"), "item", "left").na.fill(0, ["_linked"])
    kept = materialize(running_sum(
        marked, ["shard"], [F.desc("_linked"), F.desc("size"), F.col("hub"), F.col("item")], "size", "_sum"
    ))
    share = (kept.agg(F.sum("size").alias("t")).first().t or 0) / shards
    told = kept.withColumn("_stays", F.col("_sum") <= F.lit(share))
    full = told.filter("_stays").groupBy("shard").agg(F.sum("size").alias("load"))
    every = state.sparkSession.range(shards).select(F.col("id").cast("int").alias("to"))
    free = every.join(full, F.col("to") == F.col("shard"), "left").select(
        "to", (F.lit(share) - F.coalesce("load", F.lit(0))).alias("room")
    )
    up_to = W.orderBy("to")  # one row per shard
    spans = free.withColumn("end", F.sum("room").over(up_to)).withColumn("begin", F.col("end") - F.col("room")).withColumn(
        "last", F.max("to").over(W.partitionBy(F.lit(0)))
    )
    over = running_sum(
        told.filter(~F.col("_stays")).select("item", "size", "hub"), [],
        [F.col("hub").isNull(), F.col("hub"), F.desc("size"), F.col("item")], "size", "_sum",
    ).withColumn("_mid", F.col("_sum") - F.col("size") / 2)
    here = (F.col("_mid") >= F.col("begin")) & ((F.col("_mid") < F.col("end")) | (F.col("to") == F.col("last")))
    given = over.join(F.broadcast(spans), here).groupBy("item").agg(F.min("to").alias("shard"))  # spans: ``shards`` rows
    return told.filter("_stays").select("item", "shard").unionByName(given)


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 6, slack: float = 0.3) -> DataFrame:
    """Shard and slot of every document; documents with equal texts are linked.

    Rows (one per row of ``docs``): doc_id, size (UTF-8 bytes of the text plus 8; null has no bytes), text_crc32 (of
    those bytes, 0 for none), law, shard, slot (gapless from 0, by doc_id), grown_shard (null: under this law a
    further shard redistributes). Null texts are linked with nothing, empty texts are equal. Equal rows are told apart
    by their place in a written table. A group larger than a shard fills several. Other columns are not read.
    """
    raw = F.col("text").cast("binary")
    rows = materialize(docs.select(
        F.monotonically_increasing_id().alias("item"), "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).alias("text_crc32"), F.md5(raw).alias("hub"),
    ))
    groups = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("hub IS NOT NULL AND n > 1").select("hub")
    members = materialize(rows.select("item", "hub").join(groups, "hub", "left_semi").select("item", "hub"))
    state = propagate(rows.select("item", "size"), members, shards, rounds, slack)
    placed = rows.drop("hub").join(level_out(state, members, shards), "item")
    slots = number_rows(placed, ["shard"], [F.col("doc_id"), F.col("item")], "_rn")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_rn") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
