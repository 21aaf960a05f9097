"""Row numbers, neighbours and running sums for groups of any size.

Rows are range-partitioned by (group, order): a large group fills many ranges, a
small one shares its range with others. Inside a range a window does the work;
between ranges only one row per (group, range) is summed up or handed on. The
plan is the same whatever the size of a group. ``order`` should be total: rows
that are equal in group and order cannot be told apart and stay in one range.

Every function writes the ranged rows once (the ranges come from a sample), so
it starts a job when it is called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import materialize, write_table

_OWN = ("_pos", "_slice")


def _by_slices(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Sorted rows with ``_slice`` (range number) and ``_pos`` (position, rising in order)."""
    keys = [F.col(g) for g in group]
    ranges = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = materialize(ranges.withColumn("_pos", F.monotonically_increasing_id()))
    return rows.withColumn("_slice", F.shiftright("_pos", 33))


def _per_slice(rows: DataFrame, group: Sequence[str], carried: dict[str, Column], handed: dict[str, Column], all_groups: bool = False) -> DataFrame:
    """Join to each row what its group's other slices hand on.

    ``carried`` aggregates a slice; ``handed`` are window expressions over the
    slices of one group, in order. Only groups that reach into several slices are handed anything, at most two per
    slice, so this is broadcast and the rows stay where they are; rows of the others get nulls. With ``all_groups`` every
    group is, and what is handed on is written first, so that its size is known.
    """
    parts = rows.groupBy(*group, "_slice").agg(*[c.alias(n) for n, c in carried.items()])
    given = parts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_slice").alias("_s"),
        *[c.alias(n) for n, c in handed.items()],
        F.count(F.lit(1)).over(W.partitionBy(*group)).alias("_slices"),
    )
    given = write_table((given if all_groups else given.filter("_slices > 1")).drop("_slices"))[0]
    on = rows["_slice"] == given["_s"]
    for i, g in enumerate(group):
        on = on & rows[g].eqNullSafe(given[f"_g{i}"])
    joined = rows.join(given, on) if all_groups else rows.join(F.broadcast(given), on, "left")
    return joined.drop("_s", *[f"_g{i}" for i in range(len(group))])


def _earlier(group: Sequence[str]):
    return W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    """1-based position of each row within its group (or the whole table)."""
    before = F.coalesce(F.sum("_n").over(_earlier(group)), F.lit(0))
    rows = _per_slice(
        _by_slices(df, group, order), group, {"_first": F.min("_pos"), "_n": F.count(F.lit(1))},
        {"_shift": before - F.col("_first") + 1}, all_groups=True,
    )
    return rows.withColumn(name, F.col("_pos") + F.col("_shift")).drop(*_OWN, "_shift")


def with_previous(df: DataFrame, group: Sequence[str], order: Sequence[Column], columns: dict[str, str]) -> DataFrame:
    """Add the preceding row's values: ``columns`` maps a column to its new name."""
    return with_neighbours(df, group, order, columns, {})


def with_next(df: DataFrame, group: Sequence[str], order: Sequence[Column], columns: dict[str, str]) -> DataFrame:
    """Add the following row's values: ``columns`` maps a column to its new name."""
    return with_neighbours(df, group, order, {}, columns)


def with_neighbours(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], previous: dict[str, str], following: dict[str, str],
    keep_slices: bool = False,
) -> DataFrame:
    """Add the preceding and the following row's values in one ranging of the rows. ``keep_slices`` is for ``sum_in_slices``."""
    rows, edges, beyond, sides = _by_slices(df, group, order), {}, {}, []
    over = W.partitionBy(*group).orderBy("_slice")
    for side, columns, offset in (("p", previous, 1), ("n", following, -1)):
        if columns:
            rows = rows.withColumn(f"_values_{side}", F.struct(*[F.col(c).alias(new) for c, new in columns.items()]))
            edges[f"_edge_{side}"] = (F.max_by if offset > 0 else F.min_by)(f"_values_{side}", "_pos")
            beyond[f"_beyond_{side}"] = F.lag(f"_edge_{side}", offset).over(over)
            sides.append((side, columns, offset))
    rows = _per_slice(rows, group, edges, beyond)
    here = W.partitionBy(*group, "_slice").orderBy("_pos")
    near = rows.withColumns({
        f"_near_{side}": F.coalesce(F.lag(f"_values_{side}", offset).over(here), F.col(f"_beyond_{side}")) for side, _, offset in sides
    })
    return near.withColumns({new: F.col(f"_near_{side}")[new] for side, columns, _ in sides for new in columns.values()}).drop(
        *(() if keep_slices else _OWN), *[f"{c}_{side}" for c in ("_values", "_beyond", "_near") for side, _, _ in sides]
    )


def next_filled(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """The first value that is not null at or after each row of its group."""
    after = W.partitionBy(*group).orderBy("_slice").rowsBetween(1, W.unboundedFollowing)
    rows = _per_slice(
        _by_slices(df, group, order), group, {"_head": F.min_by(value, F.when(F.col(value).isNotNull(), F.col("_pos")))},
        {"_beyond": F.first("_head", ignorenulls=True).over(after)},
    )
    here = W.partitionBy(*group, "_slice").orderBy("_pos").rowsBetween(0, W.unboundedFollowing)
    return rows.withColumn(name, F.coalesce(F.first(value, ignorenulls=True).over(here), F.col("_beyond"))).drop(*_OWN, "_beyond")


def running_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and including each row of its group."""
    rows = _per_slice(_by_slices(df, group, order), group, {"_sum": F.sum(value)}, _sums_before(group))
    return rows.withColumn(name, F.coalesce("_before", F.lit(0)) + _sum_here(group, value)).drop(*_OWN, "_before")


def sum_in_slices(rows: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """``running_sum`` of rows that ``with_neighbours`` left in their slices, in the same order: they are not ranged again."""
    rows = materialize(rows.withColumn(name, _sum_here(group, value)))
    rows = _per_slice(rows, group, {"_sum": F.sum(value)}, _sums_before(group))
    return rows.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col(name)).drop(*_OWN, "_before")


def _sums_before(group: Sequence[str]) -> dict[str, Column]:
    return {"_before": F.coalesce(F.sum("_sum").over(_earlier(group)), F.lit(0))}


def _sum_here(group: Sequence[str], value: str) -> Column:
    w = W.partitionBy(*group, "_slice").orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.sum(value).over(w)
