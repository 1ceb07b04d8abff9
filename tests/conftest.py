"""One small local session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{name}')")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Rows of a DataFrame and of a DuckDB relation, columns by name, order aside."""

    def plain(v):
        if v is None or v != v:
            return None
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    def compare(df, relation):
        names = sorted(df.columns)
        assert names == sorted(relation.columns)
        got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
        at = [relation.columns.index(n) for n in names]
        want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
        assert got == want

    return compare
