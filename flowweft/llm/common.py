"""Session settings and reading shared by the operators of this package."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpoint_root, configure


def prepare(spark: SparkSession) -> SparkSession:
    """AQE settings of the library, and Arrow batches small enough for long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"


def part_of(column: str, parts: int):
    """crc32 of an id's text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def row_keys(*columns: str, names: tuple[str, str] = ("k1", "k2")) -> list:
    """Two hashes that stand for a row's id, text and further columns."""
    return [
        F.xxhash64("doc_id", "text", *columns).alias(names[0]),
        F.xxhash64(F.lit(1), *columns, F.col("text"), F.col("doc_id")).alias(names[1]),
    ]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release_memory() -> None:
    """Hand freed memory back at the end of a task: idle Python workers stay, and several share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)
