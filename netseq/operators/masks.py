"""Labels, selectable positions and candidate sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netseq.functions.scalars import is_malicious
from netseq.operators.order import ROW
from netseq.operators.split import TRAIN
from netseq.spec import quoted

LABEL = "y"


def add_label(df: DataFrame, class_column: str, benign_label: object) -> DataFrame:
    """``y`` is true for every class other than the benign one."""
    return df.withColumn(LABEL, is_malicious(F.col(quoted(class_column)), benign_label))


def selectable(n_rows: int, window: int) -> Column:
    """Positions that may be drawn for training: one window away from both ends."""
    return (F.col(ROW) >= window) & (F.col(ROW) < n_rows - window)


def add_candidate_sets(df: DataFrame, n_rows: int, window: int) -> DataFrame:
    """Flags of the four index sets a study uses; evaluation rows are not trimmed."""
    drawable = F.col(TRAIN) & selectable(n_rows, window)
    return df.select(
        "*",
        (drawable & F.col(LABEL)).alias("train_malicious"),
        (drawable & ~F.col(LABEL)).alias("train_benign"),
        F.col(TRAIN).alias("train_any"),
        (~F.col(TRAIN)).alias("evaluation"),
    )


def training_candidates(df: DataFrame, n_rows: int, window: int) -> DataFrame:
    """(row_idx, y) of rows that may end a training window."""
    return df.filter(F.col(TRAIN) & selectable(n_rows, window)).select(ROW, LABEL)
