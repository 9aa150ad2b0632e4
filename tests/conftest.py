import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse"}
    builder = SparkSession.builder.master("local[8]").config(map=conf)
    yield builder.getOrCreate()


def compared(name, spark, sf="sf0.01"):
    """Runs a query and its SQL; both results as sorted lists of rows, columns by name."""
    import glob

    import duckdb

    import __spark_entry__ as entry

    folder = f"{DATA}/{sf}"
    got = entry.queries()[name](spark, folder)
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    key = lambda row: tuple((x is not None, x) for x in row)
    return sorted((tuple(r[c] for c in names) for r in got.collect()), key=key), sorted(want.select(*names).fetchall(), key=key)
