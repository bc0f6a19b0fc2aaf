"""One local Spark session for all tests; workers find the package by PYTHONPATH."""

import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])
os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, HERE)
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    """DuckDB with the tables of the smallest scale."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows(frame):
    """Rows of a pandas frame as sorted tuples of texts, columns by name."""
    import math

    def said(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, float):
            return f"{x:.6g}" if not math.isinf(x) else str(x)
        try:
            if x == int(x) and not isinstance(x, str | bool):
                return f"{float(x):.6g}"
        except (TypeError, ValueError):
            pass
        return str(x)

    cols = sorted(frame.columns)
    return cols, sorted(tuple(said(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))
