import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
sys.path.insert(0, ROOT)

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoints-")).config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql():
    """Compare a query's rows with those of its SQL in DuckDB."""
    import glob
    from collections import Counter

    import duckdb

    def compare(df, sql, sf_dir):
        con = duckdb.connect()
        for f in glob.glob(f"{sf_dir}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns)
        rows = Counter(got.fetchall())
        assert rows == Counter(tuple(r[c] for c in names) for r in df.collect())
        return sum(rows.values())

    return compare
