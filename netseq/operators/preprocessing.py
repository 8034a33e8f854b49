"""Preprocessing components: the standard one and the base class for custom ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netseq.operators import categorical, numeric
from netseq.operators.split import TRAIN
from netseq.spec import quoted


class Preprocessing:
    """Override the four methods to change how columns are fitted and transformed.

    Fits are aggregates over training rows; transforms are columns, so a custom component stays one
    pass over the data. A pandas UDF column is accepted as well.
    """

    name = "Preprocessing"

    @property
    def parameters(self) -> dict:
        return {}

    def numeric_statistics(self, column: str) -> dict[str, Column]:
        """Aggregates to compute for a numeric column."""
        raise NotImplementedError

    def numeric_value(self, column: str, statistics: dict[str, float]) -> Column:
        """Transformed numeric column."""
        raise NotImplementedError

    def fit_levels(self, df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
        """Levels of each categorical column, in code order."""
        raise NotImplementedError

    def codes(self, df: DataFrame, levels: dict[str, list]) -> DataFrame:
        """Frame with the categorical columns replaced by codes."""
        raise NotImplementedError


@dataclass(frozen=True)
class StandardPreprocessing(Preprocessing):
    """Log min-max numbers; the most frequent levels of each category."""

    n_categorical_levels: int = 32
    clip_numerical_values: bool = False
    unseen_code: int = 1

    name = "Standard Preprocessing"

    @property
    def parameters(self) -> dict:
        return {
            "n_categorical_levels": self.n_categorical_levels,
            "clip_numerical_values": self.clip_numerical_values,
            "unseen_code": self.unseen_code,
        }

    def numeric_statistics(self, column: str) -> dict[str, Column]:
        c = quoted(column)
        return {"min": F.min(c), "range": F.max(c) - F.min(c)}

    def numeric_value(self, column: str, statistics: dict[str, float]) -> Column:
        return numeric.scaled(
            column, (statistics["min"], statistics["range"]), self.clip_numerical_values
        )

    def fit_levels(self, df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
        return categorical.fit_levels(df, columns, self.n_categorical_levels)

    def codes(self, df: DataFrame, levels: dict[str, list]) -> DataFrame:
        return categorical.encode(df, levels, self.unseen_code)


@dataclass(frozen=True)
class Fitted:
    """State of a fitted preprocessing: one entry per feature."""

    preprocessing: Preprocessing
    statistics: dict[str, dict[str, float]]
    levels: dict[str, list]

    def transform(self, df: DataFrame) -> DataFrame:
        """Scaled numbers and integer codes; a projection without shuffles, also usable on a stream."""
        scaled = df.withColumns(
            {c: self.preprocessing.numeric_value(c, s) for c, s in self.statistics.items()}
        )
        return self.preprocessing.codes(scaled, self.levels)

    def code_counts(self) -> dict[str, int]:
        return {c: max(len(v), 1) for c, v in self.levels.items()}


def fit(
    df: DataFrame, preprocessing: Preprocessing, numerics: Sequence[str], categoricals: Sequence[str]
) -> Fitted:
    """Fit on training rows: one aggregation for all numbers, one for all categories."""
    statistics: dict[str, dict[str, float]] = {c: {} for c in numerics}
    wanted = [
        (c, name, column)
        for c in numerics
        for name, column in preprocessing.numeric_statistics(c).items()
    ]
    if wanted:
        row = df.filter(TRAIN).agg(*[column.alias(f"s{i}") for i, (_, _, column) in enumerate(wanted)]).first()
        for i, (c, name, _) in enumerate(wanted):
            statistics[c][name] = row[i]
    return Fitted(preprocessing, statistics, preprocessing.fit_levels(df, categoricals))
