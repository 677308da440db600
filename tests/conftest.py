import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("spark")
    b = SparkSession.builder.master("local[4]").appName("tests")
    for k, v in {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(work / "shared"), "spark.sql.warehouse.dir": str(work / "warehouse"),
    }.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with a view for each table of the smallest size."""
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def cell(x):
    import pandas as pd

    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "~"
    kind = type(x).__name__
    if kind in ("bool", "bool_"):
        return str(bool(x))
    if kind in ("int", "float", "int32", "int64", "float32", "float64"):
        return repr(round(float(x), 6) + 0.0)
    return str(pd.Timestamp(x)) if kind in ("Timestamp", "date", "datetime", "datetime64") else str(x)


def rows(frame, cols=None):
    """Sorted rows of a pandas frame as text, columns by name."""
    cols = sorted(cols or frame.columns)
    return sorted(tuple(map(cell, r)) for r in frame[cols].itertuples(index=False))
