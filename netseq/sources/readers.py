"""Flow table sources: a DataFrame, or a path told apart by its suffix."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netseq.operators.order import ROW, Indexed, head, index_by_place, index_rows
from netseq.session import stage
from netseq.sources import feather
from netseq.spec import FlowSpec, quoted


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Parquet table of a folder of tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, types: T.StructType, positions: bool = False) -> DataFrame:
    """CSV with a header; columns are typed by name without a pass over the data to infer types.

    Columns without a type are not read. A value that is not of its column's type is an error, as is a file
    whose header names other columns or another order. ``positions`` adds file, block start and a number that
    rises along each block; it follows the split of the files, so stage the frame before using it.
    """
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f.dataType for f in types.fields}
    missing = [c for c in known if c not in header]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    in_file = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])
    strict = {"header": True, "mode": "FAILFAST", "enforceSchema": False, "escape": '"'}
    scan = spark.read.schema(in_file).options(**strict).csv(path)
    extra = []
    if positions:
        extra = [
            F.col("_metadata.file_path").alias(feather.FILE),
            F.col("_metadata.file_block_start").alias(feather.BATCH),
            F.monotonically_increasing_id().alias(feather.PLACE),
        ]
    return scan.select(*[quoted(c) for c in known], *extra)


def read_flows(
    spark: SparkSession,
    dataset: DataFrame | pd.DataFrame | str,
    spec: FlowSpec,
    types: T.StructType | None = None,
    n_rows: int = 0,
) -> Indexed:
    """Columns with a role, indexed, limited to the first ``n_rows`` rows if that is positive.

    The order is ``spec.order_by`` if given, else the order of the rows in the files. A pandas frame,
    already in memory, keeps its own order.
    """
    if isinstance(dataset, pd.DataFrame):
        rows = dataset[[c for c in spec.columns() if c in dataset.columns]]
        placed = spark.createDataFrame(rows.assign(**{ROW: range(len(rows))}))
        return head(Indexed(placed, len(rows)), n_rows)
    if isinstance(dataset, DataFrame):
        return head(index_rows(spec.project(dataset, _has_test(spec, dataset)), spec.order_by), n_rows)
    if not isinstance(dataset, str):
        raise ValueError("a dataset is a frame or a path to a CSV, feather or parquet file")
    suffix = dataset.lower().rstrip("/")
    if suffix.endswith(".csv"):
        scan = read_csv(spark, dataset, types or spec.read_schema(), positions=not spec.order_by)
        if not spec.order_by:
            return head(_by_position(stage(scan, "csv")), n_rows)
    elif suffix.endswith(".feather"):
        if not spec.order_by:
            return head(feather.index_feather(spark, dataset, spec.columns()), n_rows)
        scan = feather.read_feather(spark, dataset, spec.columns())
    elif suffix.endswith(".parquet"):
        scan = spark.read.parquet(dataset)
        scan = spec.project(scan, _has_test(spec, scan))
    else:
        raise ValueError(f"unrecognised dataset file type: {dataset}")
    return head(index_rows(scan, spec.order_by), n_rows)


def _by_position(df: DataFrame) -> Indexed:
    """Index by the position columns of a scan and drop them."""
    segment = [F.col(feather.FILE), F.col(feather.BATCH)]
    indexed = index_by_place(df, segment, feather.PLACE)
    return Indexed(indexed.df.drop(feather.FILE, feather.BATCH), indexed.n_rows)


def _has_test(spec: FlowSpec, df: DataFrame) -> bool:
    return spec.test_column is not None and spec.test_column in df.columns
