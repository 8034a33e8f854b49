"""Numeric preprocessing: clean, fit on training rows, scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netseq.functions import scalars
from netseq.operators.split import TRAIN
from netseq.spec import quoted

NUMERIC_LIMIT = 1e9


def sanitise(
    df: DataFrame, columns: Sequence[str], limit: float = NUMERIC_LIMIT, as_type: str = "double"
) -> DataFrame:
    """Replace missing, non-finite and out-of-range numbers by 0."""
    bound = scalars.literal(float(limit))
    rule = "CAST(CASE WHEN abs(CAST({c} AS DOUBLE)) <= {b} THEN CAST({c} AS DOUBLE) ELSE 0D END AS {t})"
    return df.withColumns({c: F.expr(rule.format(c=quoted(c), b=bound, t=as_type)) for c in columns})


def nonfinite_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, nonfinite) in one pass."""
    counts = df.agg(
        *[F.count_if(~scalars.is_finite(F.col(quoted(c)))).alias(f"n{i}") for i, c in enumerate(columns)]
    )
    return _unpivot(counts, columns, {"nonfinite": "n"})


def require_finite(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise if any of the columns holds a value that is not a finite number."""
    bad = {r["feature"]: r["nonfinite"] for r in nonfinite_counts(df, columns).collect() if r["nonfinite"]}
    if bad:
        raise ValueError(f"values that are not finite numbers: {bad}")


def fit_minmax_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, min, range) over training rows, all columns in one aggregation."""
    ends = df.filter(TRAIN).agg(
        *[F.min(quoted(c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(quoted(c)).alias(f"hi{i}") for i, c in enumerate(columns)],
    )
    table = _unpivot(ends, columns, {"min": "lo", "max": "hi"})
    return table.select("feature", "min", (F.col("max") - F.col("min")).alias("range"))


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """The same table as a dictionary; one small row per feature."""
    return {r["feature"]: (r["min"], r["range"]) for r in fit_minmax_table(df, columns).collect()}


def scaled(column: str, fit: tuple[float, float], clip: bool = False) -> Column:
    """Log min-max expression with the fitted constants."""
    if fit[0] is None:
        raise ValueError(f"no training row to fit {column!r} on")
    low, spread = float(fit[0]), float(fit[1])
    if spread == 0:
        return F.lit(0.0)
    shifted = f"({quoted(column)} - {scalars.literal(low)} + 1D)"
    value = F.expr(
        f"CASE WHEN {shifted} > 0D THEN ln({shifted}) / ln({scalars.literal(spread)} + 1D) "
        f"WHEN {shifted} = 0D THEN double('-Infinity') ELSE double('NaN') END"
    )
    return scalars.clip_unit(value) if clip else value


def scale(df: DataFrame, fits: dict[str, tuple[float, float]], clip: bool = False) -> DataFrame:
    """Apply a fit to its columns."""
    return df.withColumns({c: scaled(c, fit, clip) for c, fit in fits.items()})


def _unpivot(row: DataFrame, columns: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Turn one wide aggregate row into a row per feature."""
    items = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{p}{i}").alias(n) for n, p in values.items()])
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*items)))
