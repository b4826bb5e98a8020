import os
import sys

import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Whether a query and its SQL give the same rows, in any order."""

    def norm(frame):
        def cell(v):
            if pd.api.types.is_scalar(v) and pd.isna(v):
                return None
            return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

        return sorted(repr([cell(v) for v in row]) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))

    def check(query, sql):
        got, want = query(spark, DATA).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert norm(got) == norm(want)

    return check
