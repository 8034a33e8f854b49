"""Dataset roles, model-input description and study parameters."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class CategoricalFormat(Enum):
    """How categorical features reach the model."""

    INTEGERS = "integers"
    ONE_HOT = "one_hot"


class EvalSampling(Enum):
    """How evaluation rows are chosen."""

    LAST_ROWS = "last_rows"
    RANDOM_ROWS = "random_rows"
    FILTER_COLUMN = "filter_column"


@dataclass(frozen=True)
class FlowSpec:
    """Column roles of a flow table.

    ``order_by`` names a total order of the rows; left empty, file order is the order.
    """

    include_fields: tuple[str, ...]
    categorical_fields: tuple[str, ...]
    class_column: str
    benign_label: str
    test_column: str | None = None
    order_by: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("include_fields", "categorical_fields", "order_by"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if self.class_column in self.categorical_fields:
            raise ValueError(f"class column {self.class_column!r} cannot be a categorical feature")
        if len(set(self.include_fields)) != len(self.include_fields):
            raise ValueError("include_fields holds a column twice")

    @property
    def numeric_fields(self) -> list[str]:
        """Included fields that are not categorical, in declared order."""
        categorical = set(self.categorical_fields)
        return [f for f in self.include_fields if f not in categorical]

    def columns(self, with_test: bool = True) -> list[str]:
        """Columns a scan has to read, each once."""
        wanted = [*self.include_fields, *self.categorical_fields, self.class_column, *self.order_by]
        if with_test and self.test_column:
            wanted.append(self.test_column)
        return list(dict.fromkeys(wanted))

    def check(self, df: DataFrame, with_test: bool = False) -> None:
        """Raise before any job runs if a column is missing or a numeric one is not a number."""
        missing = [c for c in self.columns(with_test) if c not in df.columns]
        if missing:
            raise ValueError(f"columns missing from the flow table: {missing}")
        types = {f.name: f.dataType for f in df.schema.fields}
        wrong = [
            c for c in self.numeric_fields if not isinstance(types[c], (T.NumericType, T.BooleanType))
        ]
        if wrong:
            raise ValueError(f"numeric fields that are not numbers: {wrong}")

    def project(self, df: DataFrame, with_test: bool = True) -> DataFrame:
        """Only the columns with a role."""
        return df.select(*[quoted(c) for c in self.columns(with_test)])

    def read_schema(self, text_fields: Sequence[str] = ()) -> T.StructType:
        """Explicit schema for a text source: numbers as DOUBLE, categories as BIGINT unless named text."""
        text = {*text_fields, self.class_column}
        fields = []
        for name in self.columns():
            if name in text:
                kind = T.StringType()
            elif name in self.categorical_fields or name == self.test_column:
                kind = T.LongType()
            else:
                kind = T.DoubleType()
            fields.append(T.StructField(name, kind))
        return T.StructType(fields)

    def with_order(self, *keys: str) -> FlowSpec:
        return replace(self, order_by=keys)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


@dataclass(frozen=True)
class ModelInput:
    """Features the model sees: numeric first, then categorical with their level counts."""

    numeric_features: tuple[str, ...]
    categorical_features: tuple[str, ...]
    levels: tuple[int, ...]
    categorical_format: CategoricalFormat

    def __post_init__(self):
        for name in ("numeric_features", "categorical_features", "levels"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if len(self.levels) != len(self.categorical_features):
            raise ValueError("one level count per categorical feature is needed")

    @property
    def feature_names(self) -> list[str]:
        return [*self.numeric_features, *self.categorical_features]

    def feature_columns(self) -> dict[str, list[str]]:
        """Exact table columns behind each feature."""
        columns = {f: [f] for f in self.numeric_features}
        for f, n in zip(self.categorical_features, self.levels):
            if self.categorical_format is CategoricalFormat.ONE_HOT:
                columns[f] = [f"{f}_{code}" for code in range(1, n + 1)]
            else:
                columns[f] = [f]
        return columns

    @property
    def columns(self) -> list[str]:
        """All feature columns in model order."""
        return [c for cs in self.feature_columns().values() for c in cs]

    @property
    def width(self) -> int:
        """Numbers per flow once features are concatenated."""
        return len(self.columns)

    def window_schema(self) -> T.StructType:
        """One array per feature: values over time, or level vectors over time for one-hot features."""
        fields = [T.StructField(f, T.ArrayType(T.DoubleType())) for f in self.numeric_features]
        if self.categorical_format is CategoricalFormat.ONE_HOT:
            kind = T.ArrayType(T.ArrayType(T.IntegerType()))
        else:
            kind = T.ArrayType(T.IntegerType())
        fields += [T.StructField(f, kind) for f in self.categorical_features]
        return T.StructType(fields)

    def input_shapes(self, window: int) -> dict[str, tuple[int, int]]:
        """(steps, values per step) of each model input."""
        return {f: (window, len(cs)) for f, cs in self.feature_columns().items()}

    def to_json(self) -> str:
        return json.dumps(
            {**asdict(self), "categorical_format": self.categorical_format.value}, sort_keys=True
        )

    @classmethod
    def from_json(cls, text: str) -> ModelInput:
        fields = json.loads(text)
        fields["categorical_format"] = CategoricalFormat(fields["categorical_format"])
        return cls(**fields)


@dataclass(frozen=True)
class StudyParams:
    """Window length, classifier layers, and how training batches are drawn."""

    window_size: int = 8
    mlp_layer_sizes: tuple[int, ...] = (128,)
    mlp_dropout: float = 0.1
    ordered_within_window: bool = True
    sequential_draw: bool = False
    seed: int = 42


def quoted(name: str) -> str:
    """Column reference that is safe for names with spaces, dots or slashes."""
    return f"`{name.replace('`', '``')}`"
