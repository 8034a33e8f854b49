"""Input encodings whose weights are a table of any size, kept where it is.

Weights never pass the driver and are never broadcast. Rows are cut into chunks; a chunk asks once for each
(feature, code) it holds, the asked weights are joined to it, and a task maps the rows of one chunk at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netseq.operators.encode import VECTOR, InputEncoding
from netseq.operators.order import ROW, chunk_of
from netseq.operators.windows import chunk_length
from netseq.session import dealt
from netseq.spec import CategoricalFormat, ModelInput, quoted

# Bytes of weights that one chunk may ask for; with wider vectors chunks become shorter.
ASKED_BYTES = 64 << 20

# Bytes that a row and the vectors it asks for may take before it counts as more than one row when tasks are dealt.
ROW_BYTES = 256

# Chunks that fetch one weight vector from the same place. With more of them, groups of chunks fetch it first.
FAN_OUT = 4_096

# The code under which a numeric feature's vector is kept.
NUMERIC_CODE = 1


@dataclass(frozen=True, eq=False)
class TableEmbed(InputEncoding):
    """Record or category embedding by a table of weights (feature, code, w ARRAY<DOUBLE>).

    A numeric feature has its vector under code 1, a categorical one under each of its codes. ``concat=False``
    adds the vectors up, numbers times theirs, plus ``bias``: a linear map of the concatenated flow.
    ``concat=True`` puts the categorical vectors behind the plain numbers; bias, if any, belongs into the table.

    A null code counts as 0. Code 0 without a vector is a zero vector; another code without one, or with two,
    and a vector of another length than ``dimension`` are errors. A null number gives NaN, where it is mapped.
    Vectors of features that the model does not have are left alone. An empty frame gives no rows.
    """

    dimension: int
    weights: DataFrame
    bias: Sequence[float] = ()
    concat: bool = False

    def __post_init__(self):
        if self.bias and (self.concat or len(self.bias) != self.dimension):
            raise ValueError("a bias needs one number per dimension and summed vectors")

    @property
    def name(self) -> str:
        return "Categorical Feature Embed - Table" if self.concat else "Record Level Embedding - Table"

    @property
    def parameters(self) -> dict:
        return {"dimensions_per_feature": self.dimension, "concat": self.concat}

    def width(self, model_input: ModelInput) -> int:
        if not self.concat:
            return self.dimension
        return len(model_input.numeric_features) + self.dimension * len(model_input.categorical_features)

    def apply(self, df: DataFrame, model_input: ModelInput) -> DataFrame:
        """Add the vector column. ``df`` is read twice, so it should be a staged table."""
        if model_input.categorical_format is not CategoricalFormat.INTEGERS:
            raise ValueError("table embeddings read integer codes")
        if VECTOR in df.columns or "__chunk" in df.columns:
            raise ValueError(f"the frame has a column {VECTOR} or __chunk already")
        n_rows = (df.agg(F.max(ROW)).first()[0] or 0) + 1
        features = model_input.feature_names
        most = ASKED_BYTES // (8 * self.dimension * max(len(features), 1))
        size = max(1, min(chunk_length(df, n_rows, 1), most))
        chunked = df.withColumn("__chunk", chunk_of(size))
        n_dealt = n_rows * math.ceil(len(features) * (8 * self.dimension + 64) / ROW_BYTES)
        asked = _asked(chunked, model_input, self.concat, n_dealt)
        found = fetch(asked, _numbered(self.weights, features), math.ceil(n_rows / size), n_dealt)
        schema = T.StructType([*df.schema.fields, T.StructField(VECTOR, T.ArrayType(T.DoubleType()))])
        task = _mapped(model_input, self.dimension, list(self.bias), self.concat, df.columns)
        rows, vectors = dealt(chunked, n_dealt, "__chunk"), dealt(found, n_dealt, "place")
        return rows.groupBy("__chunk").cogroup(vectors.groupBy("place")).applyInArrow(task, schema)


def fetch(asked: DataFrame, weights: DataFrame, n_places: int, n_dealt: int = 0) -> DataFrame:
    """(place, feature, code, w): the weights each of ``n_places`` places asks for.

    ``asked`` holds (place, feature, code), each once. A vector that all places want would make one join key
    as long as the table, so groups of FAN_OUT places fetch it first, and groups of groups before them: no
    key of any join has more than FAN_OUT rows. Joins are dealt to as many tasks as ``n_dealt`` rows need.
    """

    def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        return dealt(left, n_dealt, *keys).join(dealt(right, n_dealt, *keys), keys)

    levels = [asked]
    while n_places > FAN_OUT:
        n_places = math.ceil(n_places / FAN_OUT)
        above = levels[-1].select(chunk_of(FAN_OUT, "place").alias("place"), "feature", "code")
        levels.append(dealt(above, n_dealt, "place", "feature", "code").distinct())
    found = joined(levels.pop(), weights, ["feature", "code"])
    while levels:
        group = found.withColumnRenamed("place", "__group")
        below = levels.pop().withColumn("__group", chunk_of(FAN_OUT, "place"))
        found = joined(below, group, ["__group", "feature", "code"]).drop("__group")
    return found.select("place", "feature", "code", "w")


def _numbered(weights: DataFrame, features: Sequence[str]) -> DataFrame:
    """Weights with the feature's position for its name."""
    place = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("int") - 1
    rows = weights.select(
        place.alias("feature"), F.col("code").cast("bigint").alias("code"), F.col("w").cast("array<double>").alias("w")
    )
    return rows.filter(F.col("feature") >= 0)


def _asked(chunked: DataFrame, model_input: ModelInput, concat: bool, n_dealt: int) -> DataFrame:
    """(place, feature, code) once per chunk; of many rows, the codes of a chunk meet in one task, which drops repeats."""
    n = len(model_input.numeric_features)
    items = [] if concat else [F.struct(F.lit(i).alias("feature"), F.lit(NUMERIC_CODE).cast("bigint").alias("code")) for i in range(n)]
    for i, feature in enumerate(model_input.categorical_features, n):
        code = F.coalesce(F.col(quoted(feature)).cast("bigint"), F.lit(0).cast("bigint"))
        items.append(F.struct(F.lit(i).alias("feature"), code.alias("code")))
    if not items:
        empty = chunked.select(F.col("__chunk").alias("place"), F.lit(0).alias("feature"), F.lit(0).cast("bigint").alias("code"))
        return empty.limit(0)
    return dealt(chunked, n_dealt, "__chunk").select(F.col("__chunk").alias("place"), F.inline(F.array(*items))).distinct()


def _mapped(
    model_input: ModelInput, dimension: int, bias: list[float], concat: bool, columns: list[str]
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    numerics, categories = model_input.numeric_features, model_input.categorical_features

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        feature = found["feature"].to_numpy()
        code = found["code"].to_numpy()
        vectors = found["w"].combine_chunks()
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        if not (lengths == dimension).all():
            raise ValueError(f"a weight vector has not {dimension} numbers")
        values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(found), dimension)

        def table(position: int, name: str, codes: np.ndarray) -> np.ndarray:
            """Vectors of the codes of one feature."""
            own = np.flatnonzero(feature == position)
            own = own[np.argsort(code[own], kind="stable")]
            known = code[own]
            if len(np.unique(known)) != len(known):
                raise ValueError(f"two weight vectors for one code of {name!r}")
            if not len(known) or known[0] > 0:
                known, matrix = np.append(0, known), np.vstack([np.zeros(dimension), values[own]])
            else:
                matrix = values[own]
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            wrong = known[at] != codes
            if wrong.any():
                raise ValueError(f"no weight vector for code {codes[wrong][0]} of {name!r}")
            return matrix[at]

        numbers = [rows[c].cast(pa.float64()).to_numpy() for c in numerics]
        picked = [
            table(i, c, rows[c].cast(pa.int64()).fill_null(0).to_numpy())
            for i, c in enumerate(categories, len(numerics))
        ]
        if concat:
            plain = [np.column_stack(numbers)] if numbers else []
            out = np.hstack([*plain, *picked]) if plain or picked else np.zeros((len(rows), 0))
        else:
            out = np.tile(np.array(bias or [0.0] * dimension), (len(rows), 1))
            with np.errstate(invalid="ignore"):
                for i, (c, v) in enumerate(zip(numerics, numbers)):
                    out += v[:, None] * table(i, c, np.array([NUMERIC_CODE]))
            for p in picked:
                out += p
        ends = pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32())
        return rows.select(columns).append_column(VECTOR, pa.ListArray.from_arrays(ends, pa.array(out.ravel())))

    return run
