"""Expressions on vectors (ARRAY<DOUBLE>) and windows (ARRAY<ARRAY<DOUBLE>>)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from netseq.functions.scalars import literal
from netseq.spec import quoted


def doubles(values: Sequence[float]) -> Column:
    """Constant vector."""
    return F.expr(doubles_text(values))


def doubles_text(values: Sequence[float]) -> str:
    """SQL text of a constant vector."""
    return f"array({', '.join(literal(float(v)) for v in values)})"


def dot(vector: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """Inner product with constant weights, plus bias."""
    products = F.zip_with(vector, doubles(weights), lambda a, b: a * b)
    return F.aggregate(products, F.lit(float(bias)), lambda acc, v: acc + v)


def dot_text(columns: Sequence[str], weights: Sequence[float], bias: float = 0.0) -> str:
    """SQL text of the inner product of plain columns with constant weights; stays in generated code."""
    terms = [
        f"CAST({quoted(c)} AS DOUBLE) * {literal(float(w))}" for c, w in zip(columns, weights, strict=True)
    ]
    return " + ".join([literal(float(bias)), *terms])


def mean_over_time(window: Column, width: int) -> Column:
    """Mean of each of ``width`` dimensions over the steps of a window."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda d: F.aggregate(window, F.lit(0.0), lambda acc, v: acc + F.get(v, d)) / F.size(window),
    )
