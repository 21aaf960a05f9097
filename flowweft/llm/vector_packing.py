"""Packing of documents into sequences under several capacities (vector best-fit decreasing).

A piece asks for tokens, one document place and attention cost (its length squared). All three follow from its
length, so pieces of one length are alike and the packing is worked out on counts per length: at most as many
numbers as a sequence has tokens, whatever the size of the corpus. Lengths are taken in falling order; for each,
the open sequences are those grouped by what they have left, and the group that fits best takes as many pieces as
it holds. The plan says which ranks of a length go where, and one join by length and rank gives every piece its
place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import number_rows
from ..runtime import materialize
from .common import release_memory
from .encode import encoder

PLAN = "length long, rank0 long, rank1 long, per long, sequence0 long, offset0 long"


def demand(length: int) -> tuple[int, int, int]:
    """Tokens, documents and attention cost of one piece."""
    return length, 1, length * length


def plan_packing(
    counts: Mapping[int, int], capacity: Sequence[int], weights: Sequence[float] = (1.0, 0.01, 0.01), score: str = "norm",
) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: rows of ``PLAN``.

    Ranks rank0 to rank1 - 1 of a length fill sequences sequence0, sequence0 + 1, ... with ``per`` pieces each, the
    first at offset0. ``score`` chooses among sequences that satisfy every capacity: ``norm`` takes the smallest
    weighted norm of what would be left, ``dot`` the largest weighted product of what is left and what is asked for.
    """
    cap = np.array(capacity, float)
    left: dict[tuple[int, ...], list[list[int]]] = {}  # what is left -> runs of [first sequence, how many]
    plan, following = [], 0
    for length in sorted(counts, reverse=True):
        ask = demand(length)
        if any(a > c for a, c in zip(ask, capacity, strict=True)):
            raise ValueError(f"a piece of {length} tokens fits into no sequence of {tuple(capacity)}")
        rank, n = 0, counts[length]
        want = np.array(ask, float)
        states = list(left)
        room = np.array(states, float).reshape(len(states), len(capacity))
        fits = (room >= want).all(axis=1)
        while rank < n:
            if fits.any():
                if score == "norm":
                    cost = ((((room - want) / cap) ** 2) * np.array(weights)).sum(axis=1)
                else:
                    cost = -(room * want / cap**2 * np.array(weights)).sum(axis=1)
                at = int(np.argmin(np.where(fits, cost, np.inf)))
                state = states[at]
            else:
                at, state = -1, tuple(capacity)
                left[state] = [[following, n - rank]]
            runs = left[state]
            per = min(have // a for have, a in zip(state, ask, strict=True) if a)
            while runs and rank < n:
                first, many = runs[-1]
                todo = n - rank
                whole = min(many, todo // per)
                used = whole + (whole < many and whole * per < todo and todo < (whole + 1) * per)
                for bins, each, start in ((whole, per, first), (used - whole, todo - whole * per, first + whole)):
                    if bins:
                        after = tuple(have - each * a for have, a in zip(state, ask, strict=True))
                        plan.append((length, rank, rank + bins * each, each, start, capacity[0] - state[0]))
                        rank += bins * each
                        left.setdefault(after, []).append([start, bins])
                        if at < 0:
                            following = start + bins
                if used == many:
                    runs.remove([first, many])
                else:
                    runs[runs.index([first, many])] = [first + used, many - used]
            if at < 0:
                left.pop(state)
            elif not runs:
                left.pop(state)
                fits[at] = False
        least = min((x for x in counts if x < length), default=0)
        for state in [s for s in left if s[0] < least or not all(s)]:
            del left[state]
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int = 1024) -> DataFrame:
    """Encode every whole text and cut what is longer than ``most`` tokens.

    Rows: doc_id, piece, start, length, ids_crc32. Pieces of a long document have ``most`` tokens, but for the
    first, which may be shorter. A null text counts as empty and still has its end id, so every row of the table
    gives a piece. Other columns are not read.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(tokenizer)
        for batch in batches:
            rows: list[list[int | None]] = [[], [], [], [], []]
            encoded = one.encode_all(batch.column(1).to_pylist())
            for doc, raw in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids = raw + tail
                n = len(ids) // 4
                start, end = 0, n % most or min(n, most)
                piece = 0
                while start < n:
                    values = (doc, piece, start, end - start, zlib.crc32(ids[4 * start:4 * end]))
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                    start, end, piece = end, end + most, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, [pa.int64(), pa.int32(), *[pa.int64()] * 3], strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack_pieces(
    pieces: DataFrame, most: int = 1024, most_documents: int | None = None, most_cost: int | None = None,
    weights: Sequence[float] = (1.0, 0.01, 0.01), score: str = "norm",
) -> DataFrame:
    """Add sequence_id and offset (gapless in a sequence) to pieces with a ``length`` from 1 to ``most``.

    Capacities of a sequence: ``most`` tokens, ``most_documents`` pieces (default: as many as tokens) and
    ``most_cost`` (default: most squared); neither default can bind before the tokens do. Pieces of equal length
    are ranked by (doc_id, piece, start): equal rows are alike, so their order does not matter. No rows give no
    sequences. Starts jobs: the pieces are ranked through a written table and counted by length.
    """
    spark = pieces.sparkSession
    ranked = materialize(number_rows(pieces, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_rank"))
    counts = {r.length: r.n for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= most rows
    capacity = (most, most_documents or most, most_cost or most * most)
    plan = spark.createDataFrame(plan_packing(counts, capacity, weights, score), PLAN)
    at = F.col("_rank") - 1 - F.col("rank0")
    ours = plan.select(F.col("length").alias("_length"), "rank0", "rank1", "per", "sequence0", "offset0")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") > F.col("rank0")) & (F.col("_rank") <= F.col("rank1"))
    return ranked.join(ours, on).select(
        *pieces.columns,
        (F.col("sequence0") + F.floor(at / F.col("per")).cast("long")).alias("sequence_id"),
        (F.col("offset0") + (at % F.col("per")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, most: int = 1024, **limits) -> DataFrame:
    """Pieces of all documents with their sequences; the tokens are made once, in a written table."""
    return pack_pieces(materialize(token_pieces(docs, tokenizer, end_id, most)), most, **limits)
