"""One node with everything around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inspect_node(
    nodes: DataFrame, edges: DataFrame, functions: DataFrame, files: DataFrame, node_id: str
) -> tuple[DataFrame, DataFrame]:
    """The node with function name and file path, and its links as rows with a direction.

    Links stay rows: a hub has more of them than one cell should hold.
    """
    names = functions.select(F.col("id").alias("function"), F.col("name").alias("function_name"))
    node = nodes.filter(F.col("id") == node_id).join(names, "function", "left").withColumn(
        "function_name", F.coalesce("function_name", "function")
    )
    if "source" in nodes.columns:
        paths = files.select(F.col("file_id").alias("_file"), "path")
        node = node.withColumn("_file", F.col("source.file")).join(paths, "_file", "left").drop("_file").withColumn(
            "path", F.coalesce("path", F.lit(""))
        )
    links = edges.filter((F.col("src") == node_id) | (F.col("dst") == node_id)).withColumn(
        "direction", F.when(F.col("dst") == node_id, "in").otherwise("out")
    )
    return node, links
