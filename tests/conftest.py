import os
import sys

import pytest
from hypothesis import settings

# Machines under load are slow; no example is judged by its time.
settings.register_profile("calm", deadline=None)
settings.load_profile("calm")

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The tables that the oracle tests read.
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def same_rows(df, con, sql):
    """Whether a DataFrame and a DuckDB query have the same rows, whatever their order."""
    import collections
    import math

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return v.isoformat() if hasattr(v, "isoformat") else repr(v) if isinstance(v, float) else str(v)

    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    theirs = collections.Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
    ours = collections.Counter(tuple(plain(x) for x in r) for r in df.collect())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
