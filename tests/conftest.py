import os
import sys
import tempfile

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for n in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{sf}/{n}.parquet')")
    return con


@pytest.fixture(scope="session")
def same():
    """Equal rows in any order; numbers as numbers."""

    def plain(v):
        if v is None or pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or type(v).__module__ == "numpy" else str(v)

    def check(df, frame):
        cols = sorted(df.columns)
        assert cols == sorted(frame.columns)
        a = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
        b = sorted(str([plain(v) for v in r]) for r in frame[cols].astype(object).itertuples(index=False, name=None))
        assert a == b

    return check
