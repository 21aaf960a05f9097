import random

from pyspark.sql import functions as F

from flowweft.functions import numbering
from flowweft.functions.numbering import next_filled, number_rows, running_sum, sum_in_slices, with_neighbours, with_next, with_previous
from flowweft.runtime import materialize


def _data(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(20)}", i, float(rng.randrange(9))) for i in range(2000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, t bigint, v double").repartition(5)


def _by_group(rows):
    groups = {}
    for g, t, v in sorted(rows):
        groups.setdefault(g, []).append((t, v))
    return groups


def test_hot_groups_give_the_same_numbers(spark):
    rows, df = _data(spark)
    want = {(g, t): (i + 1, sum(v for _, v in items[: i + 1]), items[i - 1][0] if i else None, items[i + 1][0] if i + 1 < len(items) else None)
            for g, items in _by_group(rows).items() for i, (t, _) in enumerate(items)}
    order = [F.col("t")]
    rn = {(r.g, r.t): r.rn for r in number_rows(df, ["g"], order).collect()}
    total = {(r.g, r.t): r.s for r in running_sum(df, ["g"], order, "v", "s").collect()}
    before = {(r.g, r.t): r.p for r in with_previous(df, ["g"], order, {"t": "p"}).collect()}
    after = {(r.g, r.t): r.n for r in with_next(df, ["g"], order, {"t": "n"}).collect()}
    assert {k: (rn[k], total[k], before[k], after[k]) for k in want} == want
    assert len(rn) == len(rows)


def test_whole_table_numbers(spark):
    rows, df = _data(spark)
    got = [r.t for r in number_rows(df, [], [F.col("t")]).orderBy("rn").collect()]
    assert got == sorted(t for _, t, _ in rows)


def test_next_value_that_is_not_null(spark):
    rows, df = _data(spark)
    marked = df.withColumn("m", F.when(F.col("t") % 7 == 0, F.col("t")))
    got = {(r.g, r.t): r.f for r in next_filled(marked, ["g"], [F.col("t")], "m", "f").collect()}
    for g, items in _by_group(rows).items():
        ts = [t for t, _ in items]
        for i, t in enumerate(ts):
            assert got[g, t] == next((x for x in ts[i:] if x % 7 == 0), None)


def test_both_neighbours_in_one_ranging(spark, monkeypatch):
    rows = [(g, t, t * 10 if t % 3 else None) for g, n in ((None, 3), ("a", 400), ("b", 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "g string, t int, v int").repartition(5)
    written = []
    monkeypatch.setattr(numbering, "materialize", lambda rows: written.append(1) or materialize(rows))
    both = with_neighbours(df, ["g"], [F.col("t")], {"t": "p", "v": "pv"}, {"t": "n", "v": "nv"})
    assert len(written) == 1 and both.columns == ["g", "t", "v", "p", "pv", "n", "nv"]
    value = {(g, t): v for g, t, v in rows}
    got = {(r.g, r.t): (r.v, r.p, r.pv, r.n, r.nv) for r in both.collect()}
    at = lambda g, t: (t, value[g, t]) if (g, t) in value else (None, None)
    assert got == {(g, t): (v, *at(g, t - 1), *at(g, t + 1)) for g, t, v in rows} and both.count() == len(rows)


def test_rows_stay_where_few_groups_hand_on(spark):
    _, df = _data(spark)
    for group in ([], ["g"]):
        plan = number_rows(df, group, [F.col("t")])._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_sums_go_on_in_the_slices_of_the_neighbours(spark):
    rows, df = _data(spark)
    near = with_neighbours(df, ["g"], [F.col("t")], {"t": "p"}, {"t": "n"}, keep_slices=True)
    got = sum_in_slices(near.withColumn("one", F.lit(1)), ["g"], "one", "s")
    assert got.columns == ["g", "t", "v", "p", "n", "one", "s"]
    want = {(g, t): i + 1 for g, items in _by_group(rows).items() for i, (t, _) in enumerate(items)}
    assert {(r.g, r.t): r.s for r in got.collect()} == want and got.count() == len(rows)


def test_rows_stay_whatever_the_number_of_groups(spark):
    """Only groups in several slices are handed something; the rows join that without a shuffle, and one window follows."""
    df = spark.range(20_000).select((F.col("id") % 5_000).alias("g"), "id").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        plan = running_sum(df, ["g"], [F.col("id")], "id", "s")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("hashpartitioning") == 1 and "SortMergeJoin" not in plan
