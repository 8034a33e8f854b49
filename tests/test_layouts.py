"""The same answers when tables are spread over many files, in key order or in no order."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import difference
from netseq.session import staging_path

TABLES = {
    "events": "event_id",
    "orders": "o_orderkey",
    "customer": "c_custkey",
    "lineitem": "l_orderkey",
}
QUERIES = [
    "head_rows",
    "split_random",
    "split_flag",
    "log_minmax",
    "preprocess",
    "windows_ordered",
    "batch_windows",
    "windows_random_ctx",
    "metrics",
    "temporal_bias",
    "early_stop",
    "elapsed",
    "drift_report",
    "sanitize",
]


@pytest.fixture(scope="module", params=["ordered", "scattered"])
def layout(request, spark, small):
    folder = staging_path(spark, request.param)
    con = duckdb.connect()
    for name, key in TABLES.items():
        df = spark.read.parquet(f"{small}/{name}.parquet")
        if request.param == "ordered":
            df = df.repartitionByRange(9, key).sortWithinPartitions(key)
        else:
            df = df.repartition(9, key).sortWithinPartitions(df.columns[-1])
        path = f"{folder}/{name}.parquet"
        df.write.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return folder, con


@pytest.mark.parametrize("name", QUERIES)
def test_layout(spark, layout, name):
    folder, con = layout
    got = entry.queries()[name](spark, folder).toPandas()
    assert difference(got, con.sql(entry.oracle_sql()[name]).df()) == ""
