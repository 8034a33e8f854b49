"""The preprocessed table: training flag, raw label, scaled numbers, encoded categories."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netseq.operators import categorical
from netseq.operators.numeric import NUMERIC_LIMIT, sanitise
from netseq.operators.order import ROW
from netseq.operators.preprocessing import Fitted, Preprocessing, fit
from netseq.operators.split import TRAIN
from netseq.spec import CategoricalFormat, FlowSpec, ModelInput, quoted

RAW_LABEL = "y_raw"


class Preprocessed(NamedTuple):
    """Preprocessed rows, the model's view of them, and the fit that made them."""

    df: DataFrame
    model_input: ModelInput
    fitted: Fitted


def preprocess(
    df: DataFrame,
    spec: FlowSpec,
    preprocessing: Preprocessing,
    categorical_format: CategoricalFormat = CategoricalFormat.INTEGERS,
    numerical_filter: float = NUMERIC_LIMIT,
    as_type: str = "double",
    training: DataFrame | None = None,
) -> Preprocessed:
    """Clean, fit on training rows and transform a split frame in one projection.

    ``training`` may name the same training rows by a cheaper scan, such as one that skips files.
    """
    spec.check(df)
    numerics, categoricals = spec.numeric_fields, list(spec.categorical_fields)
    features = [quoted(c) for c in [*numerics, *categoricals]]
    label = F.col(quoted(spec.class_column)).cast("string").alias(RAW_LABEL)
    clean = sanitise(df.select(ROW, TRAIN, label, *features), numerics, numerical_filter, as_type)
    source = df if training is None else training
    fitted = fit(
        sanitise(source.select(TRAIN, *features), numerics, numerical_filter, as_type),
        preprocessing,
        numerics,
        categoricals,
    )
    out = fitted.transform(clean)
    if as_type != "double":
        out = out.withColumns({c: F.col(quoted(c)).cast(as_type) for c in numerics})
    widths = fitted.code_counts()
    if categorical_format is CategoricalFormat.ONE_HOT:
        out = categorical.one_hot(out, widths)
    model_input = ModelInput(numerics, categoricals, [widths[c] for c in categoricals], categorical_format)
    return Preprocessed(
        out.select(ROW, TRAIN, RAW_LABEL, *[quoted(c) for c in model_input.columns]), model_input, fitted
    )


def detach(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, labels and training flags as three frames that share ``row_idx``."""
    features = df.drop(TRAIN, RAW_LABEL)
    return features, df.select(ROW, RAW_LABEL), df.select(ROW, TRAIN)


def shape_report(source: DataFrame, result: DataFrame) -> DataFrame:
    """Rows and columns before and after preprocessing, as one row; ``row_idx`` is not counted."""

    def size(df: DataFrame, side: str) -> DataFrame:
        columns = len([c for c in df.columns if c != ROW])
        return df.agg(
            F.count("*").alias(f"{side}_rows"), F.lit(columns).cast("bigint").alias(f"{side}_columns")
        )

    both = size(source, "in").unionByName(size(result, "out"), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
