"""Graph and snapshot documents, table folders and saved states."""

from __future__ import annotations

import json
import time
import uuid
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize
from ..schema import EDGES, FUNCTIONS, NODES, conform

_NODE = (
    "id STRING, kind STRING, label STRING, detail STRING, `function` STRING, method STRING, package STRING, block INT, "
    "`order` DOUBLE, type STRING, names ARRAY<STRING>, protocol STRING, reason STRING, helper BOOLEAN, "
    "source STRUCT<file: STRING, line: INT>"
)
_EDGE = "id STRING, `from` STRING, `to` STRING, kind STRING, label STRING, type STRING"
_FUNCTION = "id STRING, name STRING, package STRING, project STRING, source STRUCT<file: STRING, line: INT>"
_VIEW = "fn STRING, pkg STRING, query STRING, part INT, compact BOOLEAN, layers MAP<STRING, BOOLEAN>"


def _struct(ddl: str) -> str:
    """STRUCT<...> form of a column list."""
    return T.StructType.fromDDL(ddl).simpleString()


def graph_schema() -> str:
    return (
        f"version INT, revision STRING, mode STRING, projects ARRAY<STRUCT<path: STRING, module: STRING>>, "
        f"functions ARRAY<{_struct(_FUNCTION)}>, nodes ARRAY<{_struct(_NODE)}>, edges ARRAY<{_struct(_EDGE)}>, "
        f"warnings ARRAY<STRING>, files MAP<STRING, STRING>"
    )


def snapshot_schema() -> str:
    layout = (
        f"STRUCT<view: {_struct(_VIEW)}, manual: BOOLEAN, assembly: STRING, nodes: ARRAY<STRUCT<id: STRING, x: DOUBLE, y: DOUBLE>>, "
        "edges: ARRAY<STRUCT<id: STRING, cells: ARRAY<STRUCT<x: INT, y: INT, layer: INT>>, startDir: INT, endDir: INT>>>"
    )
    return (
        f"format STRING, version INT, graph {_struct(graph_schema())}, sources MAP<STRING, STRING>, layouts ARRAY<{layout}>, "
        f"view {_struct(_VIEW)}, camera STRUCT<x: DOUBLE, y: DOUBLE, zoom: DOUBLE>, selected STRING, tracing BOOLEAN, "
        "time DOUBLE, speed DOUBLE, playing BOOLEAN"
    )


def _tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Explode documents (rev, graph) into the graph tables; ``seq`` is the place in its list."""
    def rows(name: str, schema: str) -> DataFrame:
        items = docs.select("rev", F.posexplode(f"graph.{name}").alias("seq", "item"))
        return conform(
            items.select("rev", "seq", "item.*").withColumnsRenamed({"order": "ord", "from": "src", "to": "dst"}), schema
        )

    return {
        "snapshots": docs.select(
            "rev", "graph.version", F.coalesce("graph.mode", F.lit("static-ssa")).alias("mode"),
            F.coalesce("graph.warnings", F.array().cast("array<string>")).alias("warnings"), "corrupt", missing_lists(),
        ),
        "nodes": rows("nodes", NODES),
        "edges": rows("edges", EDGES),
        "functions": rows("functions", FUNCTIONS),
        "projects": docs.select("rev", F.inline("graph.projects")),
        "files": docs.select("rev", F.explode("graph.files").alias("file_id", "path")),
    }


def missing_lists():
    """Names of the lists that a document's graph lacks."""
    lists = ("projects", "functions", "nodes", "edges")
    return F.filter(
        F.array(*[F.when(F.col(f"graph.{x}").isNull(), x) for x in lists]), lambda x: x.isNotNull()
    ).alias("missing")


def read_graph(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """Graph JSON documents as tables. ``multi_line=False`` reads one document per line.

    A document that is damaged or holds values of other types is marked ``corrupt`` in
    snapshots; validate_graph reports it.
    """
    # Parsed from text: the JSON source would parse, and so check, only the columns a query asks for.
    text = spark.read.text(path, wholetext=multi_line).filter(F.trim("value") != "")
    parsed = F.from_json("value", f"{graph_schema()}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    docs = text.select(parsed.alias("graph"))
    return _tables(docs.select(
        F.coalesce("graph.revision", F.lit("")).alias("rev"), (F.col("graph").isNull() | F.col("graph._corrupt").isNotNull()).alias("corrupt"), "graph"
    ))


def read_snapshot(spark: SparkSession, path: str, one_per_file: bool = True) -> dict[str, DataFrame]:
    """Versioned snapshot documents, or bare graphs, one per file or one per line.

    A leading byte-order mark is ignored. Both forms are read with one schema that has
    the fields of either. Damaged documents are marked ``corrupt``, see read_graph.
    Texts are parsed once and written as a table: parsing costs far more than what the tables below take from it.
    """
    text = F.regexp_replace("value", "^\uFEFF", "")
    own = [f for f in T.StructType.fromDDL(graph_schema()).fields if f.name != "version"]
    both = T.StructType([*T.StructType.fromDDL(snapshot_schema()).fields, *own, T.StructField("_corrupt", T.StringType())])
    docs = spark.read.text(path, wholetext=one_per_file).select(
        F.from_json(text, both, {"columnNameOfCorruptRecord": "_corrupt"}).alias("s")
    )
    bare = F.col("s.format").isNull()
    alone = F.struct("s.version", *[f"s.{f.name}" for f in own])
    whole = F.struct("s.graph.version", *[f"s.graph.{f.name}" for f in own])
    docs = docs.select(
        F.when(bare, alone).otherwise(whole).alias("graph"), "s.format", (F.col("s").isNull() | F.col("s._corrupt").isNotNull()).alias("corrupt"),
        F.coalesce("s.tracing", F.lit(False)).alias("tracing"), F.coalesce("s.playing", F.lit(False)).alias("playing"),
        F.when(~bare, F.col("s.version")).alias("doc_version"), "s.view", "s.layouts", "s.sources", "s.camera", "s.selected",
        F.coalesce("s.time", F.lit(0.0)).alias("time"), F.coalesce("s.speed", F.lit(1.0)).alias("speed"),
    ).withColumn("rev", F.coalesce("graph.revision", F.lit("")))
    docs = materialize(docs)
    tables = _tables(docs)
    view = F.coalesce("view.fn", F.lit("")).alias("fn"), F.coalesce("view.pkg", F.lit("")).alias("pkg")
    tables["snapshots"] = docs.select(
        "rev", "graph.version", "format", "doc_version", *view, "view", "camera", "selected", "time", "speed",
        "tracing", "playing", "corrupt", missing_lists(),
    )
    tables["sources"] = docs.select("rev", F.explode("sources").alias("file_id", "content"))
    tables["layouts"] = docs.select("rev", F.posexplode("layouts").alias("layout", "l")).select("rev", "layout", "l.*")
    return tables


def read_layouts(layouts: DataFrame) -> dict[str, DataFrame]:
    """Layout records (rev, layout, view, nodes, edges) as node, edge and cell tables keyed by place and view."""
    from ..operators.selection import normalize_view, view_key

    keyed = normalize_view(layouts.select("rev", "layout", "view.*", "manual", "assembly", "nodes", "edges")).withColumn(
        "layout_id", F.concat_ws("|", "rev", F.col("layout").cast("string"), view_key())
    )
    routes = keyed.select("layout_id", F.inline("edges")).withColumnsRenamed(
        {"id": "edge_id", "startDir": "start_dir", "endDir": "end_dir"}
    )
    return {
        "views": keyed.drop("nodes", "edges"),
        "layout_nodes": keyed.select("layout_id", F.inline("nodes")),
        "layout_edges": routes.drop("cells"),
        "layout_cells": routes.select("layout_id", "edge_id", F.posexplode("cells").alias("pos", "c")).select(
            "layout_id", "edge_id", "pos", "c.*"
        ),
    }


def write_graph(tables: dict[str, DataFrame], path: str, files_per_revision: int | None = None, rows_per_file: int = 1_000_000) -> None:
    """JSON lines per table, partitioned by ``rev``; other revisions in the folder stay.

    One array document per revision would gather a whole graph in one row; a revision's lines are spread over as many
    tasks and files as it has ``rows_per_file`` rows, or over ``files_per_revision``. The rows are counted first, so
    a table that is dear to compute should be a written one.
    """
    for name, df in tables.items():
        rows = F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)) if files_per_revision is None else F.max(F.lit(files_per_revision))
        sizes = materialize(df.groupBy(F.col("rev").alias("_rev")).agg(rows.cast("long").alias("_files")))
        total = sizes.agg(F.sum("_files")).first()[0] or 1
        spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != "rev"]), F.col("_files"))
        # A stated number of tasks: they grow with the rows, and are not merged because files are small.
        df.join(sizes, F.col("rev").eqNullSafe(F.col("_rev"))).repartition(total, "rev", spread).select(*df.columns).write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "dynamic").partitionBy("rev").json(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables written by :func:`write_graph`; filters on ``rev`` prune folders. The empty revision's folder reads as null."""
    return {n: spark.read.schema(s).json(f"{path}/{n}").na.fill("", ["rev"]) for n, s in schemas.items()}


class SnapshotConflict(RuntimeError):
    """Another writer has saved since the version that this one started from."""


def _log(spark: SparkSession, path: str, key: str):
    """File system and folder of the commits of ``key``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log/key={quote(key, safe='')}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _commits(spark: SparkSession, path: str, key: str) -> dict[int, dict]:
    """Finished commits of ``key`` by number. A file without its end is still being written and does not count."""
    fs, folder = _log(spark, path, key)
    found = {}
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        stream = fs.open(status.getPath())
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.endswith("\n"):
            found[int(status.getPath().getName())] = json.loads(text)
    return found


def _commit(spark: SparkSession, path: str, key: str, number: int, entry: dict) -> bool:
    """Write commit ``number`` unless there is one; whether it was written."""
    fs, folder = _log(spark, path, key)
    file = spark._jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}")
    try:
        stream = fs.create(file, False)
    except Py4JJavaError:
        if fs.exists(file):
            return False
        raise
    stream.write(bytearray(json.dumps(entry) + "\n", "utf-8"))
    stream.close()
    return True


def snapshot_version(spark: SparkSession, path: str, key: str) -> int:
    """Number of the state saved last under ``key``; 0 if there is none."""
    return max(_commits(spark, path, key), default=0)


def save_snapshot(tables: dict[str, DataFrame], path: str, key: str, after: int | None = None) -> int:
    """Save a state under ``key``; its version number.

    The tables go to a folder of their own first; a numbered commit file, created only if it is absent, makes them the
    state, so a reader sees the old state or the new one, never a mixture. Of two writers of one number one wins. The other
    takes the next number, or, if it names the version it started from (``after``), gets ``SnapshotConflict`` and can
    read again. That needs a file system whose creation of a file fails if it exists (HDFS and local folders do).
    """
    version = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/data/{version}/{name}")
    entry = {"version": version, "tables": list(tables)}
    last = snapshot_version(spark, path, key)
    if after is not None and last != after:
        raise SnapshotConflict(f"{key}: version {last} has been saved since version {after}")
    number = last + 1
    while not _commit(spark, path, key, number, entry):
        if after is not None:
            raise SnapshotConflict(f"{key}: another writer has saved version {number}")
        number += 1
    return number


def load_snapshot(spark: SparkSession, path: str, key: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables saved under ``key``, last or as ``version``; KeyError if there are none."""
    commits = _commits(spark, path, key)
    entry = commits.get(max(commits, default=0) if version is None else version)
    if entry is None:
        raise KeyError(key if version is None else (key, version))
    return {n: spark.read.parquet(f"{path}/data/{entry['version']}/{n}") for n in entry["tables"]}


def clean_snapshots(spark: SparkSession, path: str, keep: int = 1, older_than: float = 86_400.0) -> int:
    """Delete all but the last ``keep`` commits of every key, and table folders that no commit names; the folders deleted.

    Only what is older than ``older_than`` seconds goes: a younger folder may belong to a writer that has not committed, a
    younger commit may still be read.
    """
    if keep < 1:
        raise ValueError("the last state of a key stays")
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    before = (time.time() - older_than) * 1000
    children = lambda name: list(fs.listStatus(at)) if fs.exists(at := spark._jvm.org.apache.hadoop.fs.Path(root, name)) else []
    # Folders are listed before commits: one that is committed in between is then seen as named.
    folders = [s.getPath() for s in children("data") if s.getModificationTime() <= before]
    named = set()
    for log in children("log"):
        key = unquote(log.getPath().getName().removeprefix("key="))
        commits = _commits(spark, path, key)
        kept = set(sorted(commits)[-keep:])
        for status in fs.listStatus(log.getPath()):
            number = int(status.getPath().getName())
            if number in commits and number not in kept and status.getModificationTime() <= before:
                fs.delete(status.getPath(), False)
            elif number in commits:
                named.add(commits[number]["version"])
    gone = [f for f in folders if f.getName() not in named]
    return sum(fs.delete(f, True) for f in gone)
