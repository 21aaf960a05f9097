"""Cleaning of vector tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, v, w) of rows that can take part: an id, and a vector without null or non-finite components that is not
    zero. ``w`` is the vector's length; vectors of different lengths have no cosine and never meet.
    """
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("w"))
    return rows.filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.col("w") > 0) & F.forall("v", _finite) & F.exists("v", lambda x: x != 0)
    )


def identity() -> list:
    """Two independent 64-bit hashes of ``v`` that stand for the vector as a grouping key."""
    return [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), F.col("v"), F.lit(2)).alias("k2")]


def unit_rows(column: pd.Series) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    x = np.stack(column.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
