"""Categorical preprocessing: top levels of the training rows, integer codes, one-hot columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netseq.functions.scalars import literal
from netseq.operators.split import TRAIN
from netseq.session import small_side
from netseq.spec import quoted

# Longest list of levels that is searched as a constant; above it codes come from a join.
LITERAL_LEVELS = 1_000

_SLOTS = {"n": "bigint", "x": "double", "s": "string"}


def _slot(kind: T.DataType) -> str:
    """Native sort key of a level: whole numbers, other numbers, or text."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "n"
    return "x" if isinstance(kind, T.NumericType) else "s"


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n, x, s, cnt): how often each level of every feature occurs in the training rows.

    All features are counted in one pass, and counts are combined before the shuffle.
    """
    items = []
    for c in columns:
        kind = df.schema[c].dataType
        value, slot = F.col(quoted(c)), _slot(kind)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value + F.lit(0.0))
        items.append(
            F.struct(
                F.lit(c).alias("feature"),
                *[
                    (value.cast(t) if name == slot else F.lit(None).cast(t)).alias(name)
                    for name, t in _SLOTS.items()
                ],
            )
        )
    levels = df.filter(TRAIN).select(F.inline(F.array(*items))).filter("coalesce(n, x) is not null or s is not null")
    return levels.groupBy("feature", *_SLOTS).agg(F.count("*").alias("cnt"))


def ranked_levels(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent levels of every feature with their code.

    Ties go to the smaller level in its native type. The rank limit prunes each partition to ``k`` levels, so
    a feature with very many levels does not load one task.
    """
    order = Window.partitionBy("feature").orderBy(F.desc("cnt"), *_SLOTS)
    ranked = counts.withColumn("code", F.row_number().over(order)).filter(F.col("code") <= int(k))
    return ranked.select("feature", *_SLOTS, "cnt", "code")


def top_levels(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """(feature, n, x, s, cnt, code): the ``k`` most frequent training levels of every feature."""
    return ranked_levels(level_counts(df, columns), k)


def fit_levels(df: DataFrame, columns: Sequence[str], k: int) -> dict[str, list]:
    """Levels of each feature in code order; at most ``k`` values per feature reach the driver."""
    if not columns:
        return {}
    fitted: dict[str, list] = {c: [] for c in columns}
    for r in sorted(top_levels(df, columns, k).collect(), key=lambda r: r["code"]):
        fitted[r["feature"]].append(r[_slot(df.schema[r["feature"]].dataType)])
    return fitted


def code_of(column: str, kind: T.DataType, levels: Sequence, unseen_code: int = 1) -> Column:
    """1-based rank of the value among the levels, ``unseen_code`` for any other value."""
    if not levels:
        return F.lit(unseen_code)
    constants = ", ".join(literal(v) for v in levels)
    value = f"CAST({quoted(column)} AS {_SLOTS[_slot(kind)]})"
    place = f"CAST(array_position(array({constants}), {value}) AS INT)"
    return F.expr(f"coalesce(nullif({place}, 0), {int(unseen_code)})")


def encode(
    df: DataFrame, levels: dict[str, list], unseen_code: int = 1, suffix: str = ""
) -> DataFrame:
    """Integer codes for every fitted feature, in place or under ``suffix``."""
    short = {c: v for c, v in levels.items() if len(v) <= LITERAL_LEVELS}
    out = df.withColumns(
        {c + suffix: code_of(c, df.schema[c].dataType, v, unseen_code) for c, v in short.items()}
    )
    for c in levels.keys() - short.keys():
        out = _encode_by_join(out, c, levels[c], unseen_code, c + suffix)
    return out


def one_hot(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Replace code columns by 0/1 columns ``feature_code`` for codes 1..width."""
    added = [
        F.expr(f"CAST({quoted(c)} = {j} AS INT)").alias(f"{c}_{j}")
        for c, n in widths.items()
        for j in range(1, n + 1)
    ]
    kept = [quoted(c) for c in df.columns if c not in widths]
    return df.select(*kept, *added)


def levels_per_feature(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, levels): distinct codes of each feature; codes are combined before the shuffle."""
    items = [F.struct(F.lit(c).alias("feature"), F.col(quoted(c)).alias("code")) for c in columns]
    codes = df.select(F.inline(F.array(*items))).groupBy("feature", "code").agg(F.lit(1).alias("one"))
    return codes.groupBy("feature").agg(F.count("*").alias("levels"))


def _encode_by_join(
    df: DataFrame, column: str, levels: Sequence, unseen_code: int, target: str
) -> DataFrame:
    kind = df.schema[column].dataType
    key = _SLOTS[_slot(kind)]
    table = df.sparkSession.createDataFrame(
        [(v, i) for i, v in enumerate(levels, 1)], f"__level {key}, __code int"
    )
    value = F.col(quoted(column)).cast(key)
    joined = df.join(small_side(table, len(levels)), value == F.col("__level"), "left")
    return joined.withColumn(target, F.coalesce("__code", F.lit(unseen_code))).drop("__level", "__code")
