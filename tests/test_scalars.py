import pytest
from pyspark.sql import functions as F

from flowweft.functions import scalars as S


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def fnv(text):
    h = 2166136261
    for ch in text:
        h = (h ^ ord(ch)) * 16777619 % 2**32
    return h


def test_type_names(spark):
    got = values(spark, S.normalize_type("c"), [" byte ", "[]rune", "untyped  int", "any", "interface { }", "mybyte", None, "many any", " x y"])
    assert got == ["uint8", "[]int32", "int", "interface{}", "interface{}", "mybyte", "", "many any", "x y"]


def test_hash_matches_definition(spark):
    texts = ["", "a", "поток", "😀x", "github.com/x/y.(*T).Do"]
    assert values(spark, S.fnv1a32("c"), texts) == [fnv(t) for t in texts]


def test_shapes(spark):
    texts = ["bool", "int", "float64", "string", "[]byte", "[8]byte", "map[string]int", "*Item", "chan Item", "func(int)", "interface{}", "error", "any", ""]
    assert values(spark, S.type_shape("c"), texts) == [
        "diamond", "square", "circle", "capsule", "stack", "grid", "map", "arrow", "channel", "triangle", "ring", "cross", "ring", "hexagon"]
    assert values(spark, S.type_color("c"), ["byte", "uint8"]) == ["hsl(172 65% 65%)"] * 2


def test_csv_cells(spark):
    got = values(spark, S.csv_cell("c"), ['a"b', "=1+1", " ﻿@x", "-5", None, "", "строка\nдва"])
    assert got == ['"a""b"', '"\'=1+1"', '"\' ﻿@x"', '"\'-5"', "", '""', '"строка\nдва"']
    df = spark.createDataFrame([(-5.0,)], "c double")
    assert df.select(S.csv_cell("c", is_text=False).alias("v")).first().v == '"-5.0"'


def test_file_names(spark):
    assert values(spark, S.safe_name("c", "csv"), ["Run · цех №1", "///", "", "ﬁle", "a" * 200]) == [
        "Run-цех-No1.csv", "factory.csv", "factory.csv", "file.csv", "a" * 90 + ".csv"]


def test_names_are_composed_row_by_row(spark):
    """No Arrow batch of whole texts; ASCII, null and composed texts keep their places."""
    df = spark.createDataFrame([(1, "ａb"), (2, "plain"), (3, None), (4, "e\u0301")], "i int, c string").select("i", S.nfkc(F.col("c")).alias("v"))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.i: r.v for r in df.collect()} == {1: "ab", 2: "plain", 3: None, 4: "é"}


def test_natural_order(spark):
    texts = ["n10", "n2", "n02", "n1", "a100b20", "a100b3", "n"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    assert [r.c for r in df.orderBy(S.natural_key("c")).collect()] == ["a100b3", "a100b20", "n", "n1", "n02", "n2", "n10"]


def test_write_verbs(spark):
    got = values(spark, S.sql_write_verb("c"), ["  insert into t", "SELECT 1", "\n\tDrop table", "inserted", ""])
    assert got == [True, False, True, False, False]


@pytest.mark.parametrize("degree", [0, 4, 5, 12, 13, 20, 21, 1000])
def test_tile_sizes(spark, degree):
    size = 3
    while 4 * (2 * ((size - 1) // 4) + 1) < degree:
        size += 2
    row = spark.range(1).select(S.tile_size(F.lit("machine"), F.lit(degree)).alias("a"), S.tile_size(F.lit("trash"), F.lit(degree)).alias("b")).first()
    assert (row.a, row.b) == (size, 1)


def test_snap(spark):
    df = spark.createDataFrame([(0.0,), (31.9,), (32.0,), (-1.0,)], "c double")
    assert [r.v for r in df.select(S.snap("c").alias("v")).collect()] == [16.0, 16.0, 48.0, -16.0]
