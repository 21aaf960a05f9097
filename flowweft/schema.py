"""Table schemas and the fixed value domains of the graph model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The node kinds, the layer names and the view thresholds.
NODE_KINDS = ("machine", "source", "station", "warehouse", "rocket", "trash", "output", "splitter", "memory")
LAYERS = NODE_KINDS + ("belt", "train")
LARGE_GRAPH_NODES = 1200
SECTION_SIZE = 24
SECTION_THRESHOLD = 48
SECTION_HUB_THRESHOLD = 5
PORTAL_ORDER = 100000
GRAPH_VERSION = 1
TILE = 32

NODES = (
    "rev STRING, id STRING, kind STRING, label STRING, detail STRING, function STRING, method STRING, "
    "package STRING, block INT, ord DOUBLE, type STRING, names ARRAY<STRING>, protocol STRING, reason STRING, "
    "helper BOOLEAN, source STRUCT<file: STRING, line: INT>, seq BIGINT"
)
EDGES = (
    "rev STRING, id STRING, src STRING, dst STRING, kind STRING, label STRING, type STRING, seq BIGINT"
)
FUNCTIONS = (
    "rev STRING, id STRING, name STRING, package STRING, project STRING, "
    "source STRUCT<file: STRING, line: INT>, seq BIGINT"
)

_DEFAULTS = {
    "names": lambda: F.array().cast("array<string>"),
    "helper": lambda: F.lit(False),
    "block": lambda: F.lit(0),
    "ord": lambda: F.lit(0.0),
    "seq": lambda: F.monotonically_increasing_id(),
}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Fill in absent columns and nulls the way the model reads them.

    Absent strings are empty, ``ord``/``block`` zero, ``names`` an empty list and
    ``helper`` true only where it is literally true.
    """

    def column(field: T.StructField) -> Column:
        default = _DEFAULTS.get(field.name)
        if default is None:
            default = (lambda: F.lit("")) if isinstance(field.dataType, T.StringType) else (lambda: F.lit(None))
        if field.name not in df.columns:
            return default().cast(field.dataType).alias(field.name)
        value = F.col(field.name).cast(field.dataType)
        if field.name != "seq" and not isinstance(field.dataType, T.StructType):
            value = F.coalesce(value, default().cast(field.dataType))
        return value.alias(field.name)

    return df.select(*[column(f) for f in T.StructType.fromDDL(schema).fields])


# Column names, by table, that hold ids of the same revision.
_OF_REVISION = {
    "nodes": ("id", "function", "package"), "edges": ("id", "src", "dst"), "functions": ("id", "package"),
}
_MARK = "\x1f"


def per_revision(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The graph tables of several revisions with ids that carry their ``rev``.

    Equal ids of different revisions stay apart from then on, so every operator on nodes,
    edges and functions works per revision in one run. Empty ids stay empty. ``plain_id``
    and ``revision_of`` take the parts of an id again.
    """

    def marked(c: str) -> Column:
        return F.when(F.col(c) == "", "").otherwise(F.concat("rev", F.lit(_MARK), c)).alias(c)

    return {
        name: df.select(*[marked(c) if c in _OF_REVISION.get(name, ()) else c for c in df.columns]) for name, df in tables.items()
    }


def plain_id(c: str) -> Column:
    return F.element_at(F.split(F.col(c), _MARK), -1)


def revision_of(c: str) -> Column:
    return F.when(F.contains(F.col(c), F.lit(_MARK)), F.split(F.col(c), _MARK)[0]).otherwise("")
