"""Input encodings: from preprocessed columns to one vector ``x`` per flow.

Encodings work flow by flow, so they are applied before windowing: each flow is encoded once instead
of once per window it belongs to.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netseq.functions.vectors import dot_text, doubles, doubles_text
from netseq.operators.categorical import LITERAL_LEVELS
from netseq.session import small_side
from netseq.spec import CategoricalFormat, ModelInput, quoted

VECTOR = "x"

# Column x dimension products that are written out as one expression; larger maps use matrices.
EXPRESSION_TERMS = 256
Matrix = Sequence[Sequence[float]]


class InputEncoding:
    """Base class: override ``apply``, ``width`` and, if needed, ``required_format``."""

    name = "Input Encoding"
    required_format = CategoricalFormat.INTEGERS

    @property
    def parameters(self) -> dict:
        return {}

    def width(self, model_input: ModelInput) -> int:
        """Length of the vector."""
        raise NotImplementedError

    def apply(self, df: DataFrame, model_input: ModelInput) -> DataFrame:
        """Add the vector column."""
        raise NotImplementedError


class ConcatEncoding(InputEncoding):
    """No encoding: numbers, then one-hot columns (or codes, cast to numbers)."""

    name = "No Input Encoding"
    required_format = CategoricalFormat.ONE_HOT

    def width(self, model_input: ModelInput) -> int:
        return model_input.width

    def apply(self, df: DataFrame, model_input: ModelInput) -> DataFrame:
        return df.withColumn(VECTOR, F.array(*_numbers(model_input.columns)))


@dataclass(frozen=True)
class RecordEmbed(InputEncoding):
    """Linear map of the concatenated flow; ``project`` leaves out the bias.

    ``weights`` maps a numeric feature to one row of the matrix and a categorical feature to one row
    per code. A one-hot vector times its rows picks the row of the code, so codes suffice and the
    table stays narrow.
    """

    dimension: int
    weights: dict[str, Matrix]
    bias: Sequence[float] = ()
    project: bool = False

    @property
    def name(self) -> str:
        return "Record Level Projection" if self.project else "Record Level Embedding"

    @property
    def parameters(self) -> dict:
        return {"dimensions_per_feature": self.dimension, "project": self.project}

    def width(self, model_input: ModelInput) -> int:
        return self.dimension

    def apply(self, df: DataFrame, model_input: ModelInput) -> DataFrame:
        numerics = model_input.numeric_features
        bias = [0.0] * self.dimension if self.project or not self.bias else list(self.bias)
        categories = list(model_input.feature_columns().items())[len(numerics) :]
        one_hot = model_input.categorical_format is CategoricalFormat.ONE_HOT
        if self.dimension * len(model_input.columns) > EXPRESSION_TERMS:
            return df.withColumn(VECTOR, self._by_matrix(numerics, categories, bias, one_hot))
        dims = []
        for d in range(self.dimension):
            terms = [dot_text(numerics, [self.weights[f][0][d] for f in numerics], bias[d])]
            for feature, names in categories:
                rows = [row[d] for row in self.weights[feature]]
                terms.append(dot_text(names, rows[: len(names)]) if one_hot else _pick_text(feature, rows))
            dims.append(" + ".join(terms))
        return df.withColumn(VECTOR, F.expr(f"array({', '.join(dims)})"))

    def _by_matrix(
        self, numerics: Sequence[str], categories: list, bias: Sequence[float], one_hot: bool
    ) -> Column:
        """The same map for wide tables, as one matrix product per Arrow batch.

        Long sums of columns make generated methods the JVM does not compile.
        """
        dense = [self.weights[f][0] for f in numerics]
        columns = list(numerics)
        if one_hot:
            for feature, names in categories:
                columns += names
                dense += self.weights[feature][: len(names)]
        matrix = np.array(dense, dtype="float64").reshape(len(columns), self.dimension)
        tables = [] if one_hot else [np.vstack([np.zeros(self.dimension), self.weights[f]]) for f, _ in categories]
        codes = [] if one_hot else [f for f, _ in categories]
        offset, size = np.array(bias), self.dimension

        @F.arrow_udf("array<double>")
        def embed(*arrays: pa.Array) -> pa.Array:
            numbers = [a.to_numpy(zero_copy_only=False) for a in arrays]
            out = np.tile(offset, (len(numbers[0]), 1))
            if columns:
                out += np.column_stack(numbers[: len(columns)]) @ matrix
            for table, code in zip(tables, numbers[len(columns) :]):
                out += table[code]
            ends = pa.array(np.arange(len(out) + 1) * size, pa.int32())
            return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

        return embed(*_numbers(columns), *[F.col(quoted(c)).cast("int") for c in codes])


@dataclass(frozen=True)
class CategoryEmbed(InputEncoding):
    """Numbers followed by a learnt vector per categorical feature.

    kind ``dense``: weight row of the code plus bias; ``projection``: the row alone; ``lookup``: a
    table whose row 0 belongs to code 0.
    """

    kind: str
    dimension: int
    tables: dict[str, Matrix]
    biases: dict[str, Sequence[float]] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in ("dense", "projection", "lookup"):
            raise ValueError(f"unknown embedding kind {self.kind!r}")

    @property
    def name(self) -> str:
        return f"Categorical Feature Embed - {self.kind.capitalize()}"

    @property
    def parameters(self) -> dict:
        return {"dimensions_per_feature": self.dimension, "kind": self.kind}

    def width(self, model_input: ModelInput) -> int:
        return len(model_input.numeric_features) + self.dimension * len(model_input.categorical_features)

    def apply(self, df: DataFrame, model_input: ModelInput) -> DataFrame:
        if model_input.categorical_format is not CategoricalFormat.INTEGERS:
            raise ValueError("category embeddings read integer codes")
        for feature, levels in zip(model_input.categorical_features, model_input.levels):
            n_vectors = len(self._rows(feature)) - 1
            if n_vectors < levels:
                raise ValueError(f"{feature!r} has {levels} codes but vectors for {n_vectors}")
        out, parts, helpers = df, [F.array(*_numbers(model_input.numeric_features))], []
        for i, feature in enumerate(model_input.categorical_features):
            rows = self._rows(feature)
            code = F.col(quoted(feature))
            if len(rows) <= LITERAL_LEVELS:
                table = F.array(*[doubles(r) for r in rows])
                parts.append(F.element_at(table, (code + 1).cast("int")))
            else:
                helper = f"__e{i}"
                vectors = df.sparkSession.createDataFrame(
                    list(enumerate(rows)), f"__code int, {helper} array<double>"
                )
                out = out.join(small_side(vectors, len(rows)), code == F.col("__code"), "left").drop("__code")
                parts.append(F.col(helper))
                helpers.append(helper)
        return out.withColumn(VECTOR, F.concat(*parts)).drop(*helpers)

    def _rows(self, feature: str) -> list[list[float]]:
        """Vector of every code from 0 upwards."""
        table = [[float(v) for v in row] for row in self.tables[feature]]
        if self.kind == "lookup":
            return table
        bias = list(self.biases.get(feature, ())) if self.kind == "dense" else []
        bias = bias or [0.0] * self.dimension
        return [[w + b for w, b in zip(row, bias)] for row in [[0.0] * self.dimension, *table]]


@dataclass(frozen=True)
class EncodingChain(InputEncoding):
    """Steps applied one after the other; the last one decides the vector."""

    steps: tuple[InputEncoding, ...]

    name = "Chain"

    def __post_init__(self):
        if not self.steps:
            raise ValueError("a chain needs at least one step")

    @property
    def required_format(self) -> CategoricalFormat:
        return self.steps[0].required_format

    @property
    def parameters(self) -> dict:
        return {f"step_{i}": {"name": s.name, **s.parameters} for i, s in enumerate(self.steps)}

    def width(self, model_input: ModelInput) -> int:
        return self.steps[-1].width(model_input)

    def apply(self, df: DataFrame, model_input: ModelInput) -> DataFrame:
        for step in self.steps:
            df = df.transform(step.apply, model_input)
        return df


def _numbers(columns: Sequence[str]) -> list[Column]:
    return [F.col(quoted(c)).cast("double") for c in columns]


def _pick_text(feature: str, rows: Sequence[float]) -> str:
    """Weight of a 1-based code; 0 for code 0, as for an all-zero one-hot vector."""
    code = quoted(feature)
    return f"CASE WHEN {code} > 0 THEN element_at({doubles_text(rows)}, CAST({code} AS INT)) ELSE 0D END"
