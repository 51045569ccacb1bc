import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("shared").as_uri())
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL over the smallest tables and compares them as multisets."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")

    def text(x):
        if x is None or x != x:
            return "NULL"
        return repr(float(x)) if isinstance(x, float) else str(x)

    def rows(t):
        names = sorted(t.column_names)
        return sorted(tuple(text(v) for v in r) for r in zip(*[t.column(n).to_pylist() for n in names], strict=True)), names

    def run(query, sql):
        got, names = rows(query(spark, folder).toArrow())
        want, wanted = rows(con.sql(sql).to_arrow_table())
        assert names == wanted
        assert got == want

    return run
