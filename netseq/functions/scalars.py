"""Scalar expressions used by the preprocessing and metric operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value: bool | int | float | str) -> str:
    """SQL text of a BIGINT, DOUBLE or STRING constant.

    Wide tables need thousands of constants; one parsed text per column is far quicker to build than a
    Column object for every constant and operator.
    """
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        if math.isfinite(value):
            return f"{value!r}D"
        return f"double('{value}')"
    return f"{int(value)}L"


def sanitise(value: Column, limit: float = 1e9, as_type: str = "double") -> Column:
    """Value if its magnitude is at most ``limit``, else 0.

    One predicate covers NULL (comparison is NULL), NaN (ordered above every number) and infinities.
    """
    v = value.cast("double")
    return F.when(F.abs(v) <= F.lit(float(limit)), v).otherwise(F.lit(0.0)).cast(as_type)


def is_finite(value: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    v = value.cast("double")
    return F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False))


def log_minmax(value: Column, minimum: Column, spread: Column) -> Column:
    """ln(value - min + 1) / ln(range + 1); 0 for a constant column.

    Values below the fitted minimum follow IEEE rules (-Infinity at 0, NaN under 0), where
    Spark's ``ln`` alone would give NULL.
    """
    shifted = value - minimum + F.lit(1.0)
    return (
        F.when(spread == 0, F.lit(0.0))
        .when(shifted > 0, F.ln(shifted) / F.ln(spread + F.lit(1.0)))
        .when(shifted == 0, F.lit(float("-inf")))
        .otherwise(F.lit(float("nan")))
    )


def clip_unit(value: Column) -> Column:
    """Limit to [0, 1]; NaN stays NaN."""
    return F.when(F.isnan(value), value).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 when the denominator is 0."""
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(0.0))


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def is_malicious(label: Column, benign_label: object) -> Column:
    """Label differs from the benign one, compared as text; a missing label counts as different."""
    return ~label.cast("string").eqNullSafe(F.lit(str(benign_label)))


def predicted_positive(probability: Column, threshold: float = 0.5) -> Column:
    """Strictly above the threshold; NaN and NULL are negative."""
    return F.coalesce(~F.isnan(probability) & (probability > F.lit(float(threshold))), F.lit(False))
