"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: dict[str, str] = {}
_PACKED = "zstd"


def configure(spark: SparkSession) -> SparkSession:
    """Turn on the run-time settings the operators count on.

    AQE splits a shuffle partition that one hot key fills, and it may add a
    shuffle to do so: most joins here feed an aggregation, and without the
    second flag AQE would keep the skewed plan in exactly those cases. They hold for the
    session from then on; nothing else of it is changed.
    """
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut tables: the session's ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so that is an error.
    """
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return f"{named.rstrip('/')}/flowweft-{app}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = tempfile.mkdtemp(prefix="flowweft-")
    return _OWN_ROOT[app]


def write_table(df: DataFrame, counted: Column | None = None) -> tuple[DataFrame, int]:
    """Write ``df`` once below the checkpoint folder; return it and its row count, or what ``counted`` aggregates.

    A written table costs one pass, where an eager reliable checkpoint computes
    its input twice, and the count comes from the same job. Cut tables are packed with zstd: they
    stay on disk as long as the session.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, (F.count(F.lit(1)) if counted is None else counted).alias("n")).write.option("compression", _PACKED).parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(seen.get["n"])


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a written table."""
    return write_table(df)[0]


def write_bucketed(df: DataFrame, by: list[str]) -> tuple[DataFrame, str]:
    """Write ``df`` once as a table bucketed by ``by``; return it and its name, for ``drop_table``.

    Joins on ``by`` then move the other side only. As many buckets as shuffle partitions, one file each.
    """
    spark = df.sparkSession
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"flowweft_{uuid.uuid4().hex}"
    path = f"{checkpoint_root(spark)}/{name}"
    df.repartition(parts, *by).write.bucketBy(parts, *by).sortBy(*by).options(path=path, compression=_PACKED).format("parquet").saveAsTable(name)
    return spark.table(name), name


def drop_table(spark: SparkSession, name: str) -> None:
    """Forget a bucketed table; its files stay until ``clear_tables``."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def clear_tables(spark: SparkSession) -> None:
    """Delete the cut tables of this session. DataFrames built on them stop working."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(checkpoint_root(spark))
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
