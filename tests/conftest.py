import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return ""
    return f"{x:.8g}" if isinstance(x, float) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same_as_sql():
    def check(frame, sql, sf_dir=SF, **tables):
        c = duckdb.connect()
        c.sql("set timezone = 'UTC'")
        for t in TABLES:
            c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        for name, table in tables.items():
            c.sql(f"drop view {name}")
            c.register(name, table)
        assert rows(frame) == rows(c.sql(sql).df())

    return check
