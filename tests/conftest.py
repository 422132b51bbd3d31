import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-warehouse-", dir="/tmp"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def oracle():
    """Runs SQL on the standard tables of a scale in DuckDB."""
    import duckdb

    def run(sql: str, sf: str = "sf0.001"):
        con = duckdb.connect()
        folder = f"{TESTDATA}/{sf}"
        for name in os.listdir(folder):
            con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
        return con.execute(sql).fetchdf()

    return run


def normal(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype == float:
            frame[c] = frame[c].round(6)
    return sorted(map(tuple, frame.astype(str).values.tolist()))


@pytest.fixture(scope="session")
def same():
    def check(got, wanted):
        assert sorted(got.columns) == sorted(wanted.columns)
        assert normal(got) == normal(wanted)

    return check
