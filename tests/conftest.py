import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from flowweft import configure

    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


NODE = "id string, kind string, label string, function string, package string, type string, names array<string>, helper boolean, seq bigint, ord double"


@pytest.fixture(scope="session")
def make_nodes(spark):
    def make(rows):
        """rows: dicts with at least id; everything else has a default."""
        out = []
        for i, r in enumerate(rows):
            r = {"id": r} if isinstance(r, str) else r
            out.append((
                r["id"], r.get("kind", "machine"), r.get("label", r["id"]), r.get("function", "f"), r.get("package", "p"), r.get("type", ""),
                r.get("names", []), r.get("helper", False), i, float(r.get("ord", i)),
            ))
        return spark.createDataFrame(out, NODE)

    return make


@pytest.fixture(scope="session")
def make_edges(spark):
    def make(rows):
        """rows: (src, dst[, kind[, type[, label]]])."""
        out = []
        for i, r in enumerate(rows):
            src, dst, kind, type_, label = (*r, "belt", "", "")[:5] if len(r) == 2 else (*r, *("", "")[: 5 - len(r)])
            out.append((f"e{i}", src, dst, kind, label, type_, i))
        return spark.createDataFrame(out, "id string, src string, dst string, kind string, label string, type string, seq bigint")

    return make
