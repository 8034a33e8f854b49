"""Confusion counts and the quality figures computed from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netseq.functions.scalars import predicted_positive, ratio

RESULT_COLUMNS = ["P", "N", "pred_P", "pred_N", "TP", "FP", "TN", "FN", "bal_acc", "f1"]


def class_counts(df: DataFrame, label: str = "y") -> DataFrame:
    """Positive and negative rows of the evaluation set."""
    return df.agg(F.count_if(label).alias("P"), F.count_if(~F.col(label)).alias("N"))


def confusion(
    df: DataFrame,
    predicted: Column,
    label: str = "y",
    by: Sequence[str] = (),
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """P, N, pred_P, pred_N, TP, FP, TN, FN and ``extra`` aggregates in one pass, per group of ``by``."""
    y = F.col(label)
    cells = {
        "P": y,
        "N": ~y,
        "pred_P": predicted,
        "pred_N": ~predicted,
        "TP": predicted & y,
        "FP": predicted & ~y,
        "TN": ~predicted & ~y,
        "FN": ~predicted & y,
    }
    wanted = {**{n: F.count_if(c) for n, c in cells.items()}, **(extra or {})}
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in wanted.items()])


def rates(counts: DataFrame) -> DataFrame:
    """Add sensitivity, specificity, bal_acc, precision, recall and f1; 0 where undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("TP", "FP", "TN", "FN"))
    rated = counts.select(
        "*",
        ratio(tp, tp + fn).alias("sensitivity"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumns(
        {
            "bal_acc": (F.col("sensitivity") + F.col("specificity")) / F.lit(2.0),
            "f1": ratio(F.lit(2.0) * p * r, p + r),
        }
    )


def evaluate(
    df: DataFrame, probability: str = "p", label: str = "y", threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """Result rows: the ``by`` columns and RESULT_COLUMNS."""
    counts = confusion(df, predicted_positive(F.col(probability), threshold), label, by)
    return rates(counts).select(*by, *RESULT_COLUMNS)
