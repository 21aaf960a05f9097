"""The registered queries, and some of them against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from flowweft.plans.catalog import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "package_overview", "dedup_edges", "contact_graph", "trace", "components", "classify_calls", "channel_routes", "memory_edges",
    "read_graph_nodes", "revision", "type_color", "locate_on_path_wrap", "split_hubs_edges",
])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got, want = entry.queries()[name](spark, D).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(frame):
        return sorted(tuple(map(str, r)) for r in frame[columns].itertuples(index=False, name=None))

    assert rows(got) == rows(want)
