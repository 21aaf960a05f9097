"""Column functions. Everything stays inside JVM code generation except NFKC."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space the text rules strip (a regular-expression class body).
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# Shape and hue of the basic types.
BASIC_TYPES = {
    "bool": ("diamond", 145),
    "string": ("capsule", 47),
    "int": ("square", 208),
    "uint": ("square", 188),
    "int8": ("square", 216),
    "int16": ("square", 227),
    "int32": ("square", 240),
    "int64": ("square", 258),
    "uint8": ("square", 172),
    "uint16": ("square", 182),
    "uint32": ("square", 195),
    "uint64": ("square", 273),
    "uintptr": ("arrow", 283),
    "float32": ("circle", 22),
    "float64": ("circle", 8),
    "complex64": ("pair", 310),
    "complex128": ("pair", 328),
    "error": ("cross", 355),
}

# Shape by leading text of a composite type, first hit wins.
SHAPE_PATTERNS = (
    (r"^\z", "hexagon"),
    (r"^\*", "arrow"),
    (r"^\[\]", "stack"),
    (r"^\[[0-9]+\]", "grid"),
    (r"^map\[", "map"),
    (r"^(<-chan|chan(?![A-Za-z0-9_]))", "channel"),
    (r"^func\(", "triangle"),
    (r"^interface", "ring"),
    (r"^\(", "pair"),
    (r"^struct ?\{", "hexagon"),
)
HASHED_SHAPES = ("hexagon", "pentagon", "octagon", "shield")

# Display name per node kind.
KIND_TITLES = {
    "machine": "Сборочный станок",
    "source": "Источник груза",
    "station": "Железнодорожная станция",
    "warehouse": "Склад · запись в БД",
    "rocket": "Ракета · отправка данных",
    "trash": "Утилизация",
    "output": "Выход из цеха",
    "splitter": "Разветвитель",
    "memory": "Рабочая память",
}

# The words that make a query text a write.
WRITE_VERBS = ("INSERT", "UPDATE", "DELETE", "REPLACE", "UPSERT", "CREATE", "ALTER", "DROP", "TRUNCATE")


def text(c) -> Column:
    """Null reads as empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def trimmed(c) -> Column:
    return F.regexp_replace(text(c), f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def normalize_type(c) -> Column:
    """One spelling per type name, so equal types compare equal."""
    t = F.regexp_replace(trimmed(c), f"[{SPACE}]+", " ")
    t = F.regexp_replace(t, "^untyped ", "")
    for word, canonical in (("byte", "uint8"), ("rune", "int32")):
        t = F.regexp_replace(t, f"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])", canonical)
    return F.regexp_replace(t, r"^any\z|interface *\{ *\}", "interface{}")


def normalize_types(c) -> Column:
    """Sorted distinct normal forms of an array of type names."""
    return F.array_sort(F.array_distinct(F.transform(c, normalize_type)))


def fnv1a32(c) -> Column:
    """32-bit FNV-1a over code points, as an unsigned value in a BIGINT."""
    return F.aggregate(
        F.regexp_extract_all(text(c), F.lit("(?s)."), F.lit(0)),
        F.lit(2166136261).cast("bigint"),
        lambda h, ch: h.bitwiseXOR(F.ascii(ch)) * F.lit(16777619).cast("bigint") % F.lit(4294967296).cast("bigint"),
    )


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def type_shape(c) -> Column:
    """Icon family of a type: basic types by name, others by their leading text."""
    name = normalize_type(c)
    shape = F.coalesce(_lookup({k: v[0] for k, v in BASIC_TYPES.items()}, name), F.lit(None).cast("string"))
    for pattern, family in SHAPE_PATTERNS:
        shape = F.coalesce(shape, F.when(name.rlike(pattern), family))
    hashed = F.element_at(F.array(*[F.lit(s) for s in HASHED_SHAPES]), (fnv1a32(name) % 4 + 1).cast("int"))
    return F.coalesce(shape, hashed)


def _hundredths(n: Column) -> Column:
    """Shortest decimal text of n/100 (no trailing zeros)."""
    whole, rest = F.floor(n / 100).cast("string"), n % 100
    return F.concat(
        whole,
        F.when(rest == 0, "")
        .when(rest % 10 == 0, F.concat(F.lit("."), F.floor(rest / 10).cast("string")))
        .otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 2, "0"))),
    )


def _hsl(hue: Column, saturation: Column, lightness: Column) -> Column:
    return F.concat(
        F.lit("hsl("), hue, F.lit(" "), saturation.cast("string"), F.lit("% "), lightness.cast("string"), F.lit("%)")
    )


def type_color(c) -> Column:
    """Stable colour text of a type."""
    name = normalize_type(c)
    h = fnv1a32(name)
    known = _lookup({k: v[1] for k, v in BASIC_TYPES.items()}, name)
    empty = name == ""
    return _hsl(
        F.coalesce(known.cast("string"), _hundredths(h % 36000)),
        F.when(empty, 10).when(known.isNotNull(), 65).otherwise(60 + F.shiftrightunsigned(h, 12) % 13),
        F.when(empty, 62).when(known.isNotNull(), 65).otherwise(62 + F.shiftrightunsigned(h, 20) % 9),
    )


def type_label(c) -> Column:
    # Fixed value: the label of an untyped or control edge.
    return F.when(normalize_type(c) == "", "Без типа / управление").otherwise(normalize_type(c))


def _filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def identity_key(role: str = "role") -> Column:
    """What a node's colour stands for: package, workshop or called method.

    ``role`` names the column that marks view-made nodes (package, portal,
    section, section-hub, junction); it is null for plain nodes.
    """
    return (
        F.when(F.col(role) == "package", F.coalesce(_filled("package"), F.col("id")))
        .when(
            F.col(role).isin("portal", "section", "section-hub", "junction"),
            F.coalesce(_filled("function"), F.col("id")),
        )
        .otherwise(F.coalesce(_filled("method"), _filled("function"), _filled("kind"), F.lit("factory")))
    )


def key_color(key) -> Column:
    """Stable colour text of an identity key."""
    h = fnv1a32(key)
    return _hsl(
        _hundredths(h % 36000),
        55 + F.shiftrightunsigned(h, 12) % 14,
        61 + F.shiftrightunsigned(h, 20) % 9,
    )


def identity_color(role: str = "role") -> Column:
    return key_color(identity_key(role))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))


def csv_cell(c, is_text: bool = True) -> Column:
    """One quoted CSV cell; null is empty. Text that a spreadsheet would run as a
    formula gets a leading apostrophe, numbers never do."""
    value = F.col(c) if isinstance(c, str) else c
    if is_text:
        value = F.when(value.rlike(f"^[{SPACE}]*[=+\\-@]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.coalesce(quoted(value.cast("string")), F.lit(""))


def _composed(s: str | None) -> str | None:
    return None if s is None else unicodedata.normalize("NFKC", s)


# Row by row: an Arrow batch of long texts is held whole, in several forms, by each worker.
_compose = F.udf(_composed, T.StringType(), useArrow=False)


def nfkc(c: Column) -> Column:
    """Compatibility composition; the one step Spark has no function for. ASCII text stays as it is and is not sent to Python."""
    return F.coalesce(_compose(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def safe_name(c, extension: str = "", prefix: str = "", fallback: str = "factory", compose: bool = True) -> Column:
    """File name from a title: runs of other characters become one dash, at most 90 characters."""
    title = F.coalesce(F.nullif(text(c), F.lit("")), F.lit(fallback))
    name = F.regexp_replace(nfkc(title) if compose else title, r"[^\p{L}\p{N}._-]+", "-")
    name = F.substring(F.regexp_replace(name, r"^-+|-+\z", ""), 1, 90)
    name = F.when(name == "", fallback).otherwise(name)
    return F.concat(F.lit(prefix), name, F.lit(f".{extension}" if extension else ""))


def kind_title(c) -> Column:
    return _lookup(KIND_TITLES, F.col(c) if isinstance(c, str) else c)


def natural_key(c) -> Column:
    """Text whose plain order is number-aware: n2 sorts before n10.

    Each digit run becomes its length and its digits without leading zeros. Letters
    compare by lower case first; ties fall back to the text itself.
    """
    part = F.regexp_extract_all(F.lower(text(c)), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def piece(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(
            p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
        ).otherwise(p)

    return F.concat(F.array_join(F.transform(part, piece), ""), F.lit("\u0001"), text(c))


def snap(c) -> Column:
    """Centre of the 32-unit tile that holds a coordinate."""
    return (F.floor((F.col(c) if isinstance(c, str) else c) / 32) + 0.5) * 32


def short_package(c) -> Column:
    """Last two path segments."""
    parts = F.split(text(c), "/")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), "/")


def short_function(c) -> Column:
    """Text after the last dot."""
    return F.element_at(F.split(text(c), r"\."), -1)


def tile_size(kind, degree) -> Column:
    """Side of the square footprint that has a free port for each of ``degree`` links."""
    k = F.col(kind) if isinstance(kind, str) else kind
    d = F.col(degree) if isinstance(degree, str) else degree
    grown = 4 * F.ceil((d - 4) / 8) + 1
    return F.when(k == "trash", 1).when(d <= 4, 3).otherwise(grown).cast("int")


def sql_write_verb(c) -> Column:
    """True where the first word of a query text changes data."""
    first = F.regexp_extract(F.upper(trimmed(c)), f"^([^{SPACE}]+)", 1)
    return first.isin(*WRITE_VERBS)


def search_text(fields: list[str]) -> Column:
    """Lower-case text that a search looks into; arrays contribute every element."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) if f != "names" else F.col(f) for f in fields]))
