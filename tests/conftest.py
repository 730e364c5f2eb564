"""One local session for all tests, and the check tables in DuckDB."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def tables():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(tables):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(tables):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{tables}/{name}'")
    return con


@pytest.fixture(scope="session")
def same():
    def compare(got, want):
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        tidy = lambda df: df[columns].astype(str).replace({"None": "nan", "<NA>": "nan"}).sort_values(columns).reset_index(drop=True)
        assert tidy(got).equals(tidy(want))

    return compare
