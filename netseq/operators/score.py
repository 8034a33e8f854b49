"""Scoring windows with a sequence model: Spark spreads the windows, NumPy scores each Arrow batch."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netseq.operators.order import ROW, chunk_of
from netseq.operators.pool import Head
from netseq.operators.windows import chunk_length, with_halo
from netseq.spec import quoted

NORM_EPSILON = 1e-6

# Windows are scored in blocks whose largest intermediate array has about this many numbers, so that
# it stays in a core's cache; wide models still get a few windows at a time.
BLOCK_NUMBERS = 1 << 18
MIN_BLOCK = 32

# Windows gathered from a chunk of flows at a time.
SLIDE_BLOCK = 4096

# Numbers of a weights table that an executor's Python worker is taken to hold (2 GiB of doubles, and as much
# again on the driver). A larger model does not fit into a task and is refused.
WEIGHT_LIMIT = 1 << 28

Weights = dict[str, np.ndarray]


class SequenceModel:
    """Base class: a model from (windows, steps, width) to an array of the same shape.

    Override ``weight_shapes`` and ``transform``; instances must be picklable.
    """

    name = "Sequence Model"

    @property
    def parameters(self) -> dict:
        return {}

    def weight_shapes(self, width: int) -> dict[str, tuple[int, ...]]:
        return {}

    def window_numbers(self, steps: int, width: int) -> int:
        """Numbers per window in the largest intermediate array."""
        return steps * width

    def transform(self, windows: np.ndarray, weights: Weights) -> np.ndarray:
        return windows


@dataclass(frozen=True)
class BasicTransformer(SequenceModel):
    """Stack of attention blocks without mask or positions, encoder or decoder style."""

    n_layers: int
    internal_size: int
    n_heads: int
    dropout_rate: float = 0.1
    use_conv: bool = False
    is_decoder: bool = False
    title: str = ""

    def __post_init__(self):
        if self.is_decoder and self.use_conv:
            raise ValueError("decoder blocks have no convolution variant")

    @property
    def name(self) -> str:
        style = "decoder" if self.is_decoder else "encoder"
        return self.title or f"{self.n_layers}-layer {'convolution' if self.use_conv else 'dense'} {style}"

    @property
    def parameters(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "title"}

    def _key_size(self, width: int) -> int:
        return width if self.is_decoder else self.internal_size

    def weight_shapes(self, width: int) -> dict[str, tuple[int, ...]]:
        h, k, inner = self.n_heads, self._key_size(width), self.internal_size
        block = {
            **{f"{p}_w": (width, h, k) for p in ("query", "key", "value")},
            **{f"{p}_b": (h, k) for p in ("query", "key", "value")},
            "out_w": (h, k, width),
            "out_b": (width,),
            "norm1_scale": (width,),
            "norm1_shift": (width,),
            "norm2_scale": (width,),
            "norm2_shift": (width,),
            "inner_w": (width, inner),
            "inner_b": (inner,),
            "outer_w": (inner, width),
            "outer_b": (width,),
        }
        return {f"block_{i}_{n}": s for i in range(self.n_layers) for n, s in block.items()}

    def window_numbers(self, steps: int, width: int) -> int:
        return steps * max(self.n_heads * max(self._key_size(width), steps), self.internal_size, width)

    def transform(self, windows: np.ndarray, weights: Weights) -> np.ndarray:
        x = windows
        block = _decoder_block if self.is_decoder else _encoder_block
        for i in range(self.n_layers):
            prefix = f"block_{i}_"
            x = block(x, {n[len(prefix) :]: w for n, w in weights.items() if n.startswith(prefix)})
        return x


# Layers, inner size, heads and dropout of the two named stacks.
GPT_SMALL = BasicTransformer(12, 768, 12, dropout_rate=0.02, is_decoder=True, title="GPT Model")
BERT_SMALL = BasicTransformer(12, 768, 12, dropout_rate=0.02, title="BERT Model")


@dataclass(frozen=True)
class Scorer:
    """Head, sequence model and output layers: one probability per window.

    ``mlp`` lists the hidden layer sizes (ReLU); a sigmoid unit follows.
    """

    model: SequenceModel
    head: Head
    mlp: tuple[int, ...] = ()
    weights: Weights = field(default_factory=dict, compare=False)

    def weight_shapes(self, steps: int, width: int) -> dict[str, tuple[int, ...]]:
        model_steps, model_width = self.head.model_shape(steps, width)
        sizes = [self.head.output_width(model_steps, model_width), *self.mlp, 1]
        shapes = self.model.weight_shapes(model_width)
        for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
            shapes[f"mlp_{i}_w"], shapes[f"mlp_{i}_b"] = (a, b), (b,)
        return shapes

    def with_weights(self, weights: Weights) -> Scorer:
        return Scorer(self.model, self.head, self.mlp, weights)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Probability per window of a (windows, steps, width) array."""
        if not len(windows):
            return np.zeros(0)
        _, steps, width = windows.shape
        per_window = self.model.window_numbers(*self.head.model_shape(steps, width))
        block = max(MIN_BLOCK, BLOCK_NUMBERS // per_window)
        return np.concatenate(
            [self._block(windows[i : i + block]) for i in range(0, len(windows), block)]
        )

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """The head's vector of each window over the sequence model."""
        return self.head.array(self.model.transform(self.head.before_array(windows), self.weights))

    def _block(self, windows: np.ndarray) -> np.ndarray:
        x = self.pooled(windows)
        for i in range(len(self.mlp)):
            x = np.maximum(x @ self.weights[f"mlp_{i}_w"] + self.weights[f"mlp_{i}_b"], 0.0)
        i = len(self.mlp)
        logits = (x @ self.weights[f"mlp_{i}_w"] + self.weights[f"mlp_{i}_b"])[:, 0]
        return 1.0 / (1.0 + np.exp(-logits))


def patterned_weights(shapes: dict[str, tuple[int, ...]], scale: float = 0.1) -> Weights:
    """Untrained, reproducible weights; scales start at 1, shifts and biases at 0."""
    out = {}
    for salt, (name, shape) in enumerate(sorted(shapes.items())):
        if name.endswith("_scale"):
            out[name] = np.ones(shape)
        elif name.endswith(("_shift", "_b")):
            out[name] = np.zeros(shape)
        else:
            n = np.arange(math.prod(shape))
            out[name] = (((n * 31 + salt * 17) % 13 - 6) / 10.0 * scale).reshape(shape)
    return out


def weights_table(spark: SparkSession, weights: Weights) -> DataFrame:
    """Weights as rows (name, shape, numbers)."""
    rows = [(n, list(w.shape), [float(v) for v in w.ravel()]) for n, w in sorted(weights.items())]
    return spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>")


def load_weights(table: DataFrame) -> Weights:
    """Weights from their table, after a check of its size."""
    total = table.agg(F.sum(F.size("numbers"))).first()[0] or 0
    if total > WEIGHT_LIMIT:
        raise ValueError(f"{total} weights are too many to broadcast")
    return {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in table.collect()}


def score_windows(
    df: DataFrame,
    probabilities: Callable[[np.ndarray], np.ndarray],
    steps: int,
    width: int,
    keep: Sequence[str],
    window: str = "win",
) -> DataFrame:
    """(keep…, p) for windows held as ARRAY<ARRAY<DOUBLE>>; any picklable callable can score.

    The callable is part of the task's function, which Spark broadcasts when it is large.
    """
    kept = df.select(*[quoted(c) for c in keep], window)
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("p", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            windows = _dense(arrays[-1], batch.num_rows, steps, width)
            p = pa.array(np.asarray(probabilities(windows), dtype="float64"))
            yield pa.RecordBatch.from_arrays([*arrays[:-1], p], names=schema.names)

    return kept.mapInArrow(run, schema)


def pool_windows(
    df: DataFrame,
    pool: Callable[[np.ndarray], np.ndarray],
    steps: int,
    width: int,
    keep: Sequence[str],
    window: str = "win",
) -> DataFrame:
    """(keep…, pooled) for windows held as ARRAY<ARRAY<DOUBLE>>, in blocks of a few windows."""
    kept = df.select(*[quoted(c) for c in keep], window)
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("pooled", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, MIN_BLOCK):
                part = batch.slice(start, MIN_BLOCK)
                found = np.asarray(pool(_dense(part.columns[-1], part.num_rows, steps, width)), dtype="float64")
                ends = pa.array(np.arange(part.num_rows + 1) * found.shape[1], pa.int32())
                vectors = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], vectors], names=schema.names)

    return kept.mapInArrow(run, schema)


def score_flows(
    df: DataFrame,
    probabilities: Callable[[np.ndarray], np.ndarray],
    window: int,
    n_rows: int,
    width: int,
    keep: Sequence[str] = (),
    vector: str = "x",
    ends: Column | None = None,
    first_end: int = 0,
    chunk_rows: int | None = None,
) -> DataFrame:
    """(row_idx, keep…, p) for the full window ending at every row, or at the rows ``ends`` selects.

    Equal to scoring the rows of ``ordered_windows``, but each flow reaches Python once: a task gets
    a chunk of flows with its halo and slides over it, instead of one copy of every window.
    """
    start = max(first_end - (window - 1), 0)
    rows = df.filter(F.col(ROW) >= start) if start else df
    size = chunk_rows or chunk_length(df, n_rows - start, window)
    wanted = F.lit(True) if ends is None else F.coalesce(ends, F.lit(False))
    kept = rows.select(
        ROW, *[quoted(c) for c in keep], wanted.alias("__end"), F.col(vector).alias("__vector")
    )
    spread = with_halo(kept, window, size)
    spread = spread.withColumn(
        "__end", F.col("__end") & (F.col("__chunk") == chunk_of(size)) & (F.col(ROW) >= max(first_end, window - 1))
    )
    schema = T.StructType([*[kept.schema[c] for c in [ROW, *keep]], T.StructField("p", T.DoubleType())])
    names = schema.names

    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by(ROW).combine_chunks()
        vectors = chunk["__vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = vectors.reshape(chunk.num_rows, width).astype("float64", copy=False)
        at = np.flatnonzero(chunk["__end"].to_numpy())
        p = np.zeros(len(at))
        for i in range(0, len(at), SLIDE_BLOCK):
            block = at[i : i + SLIDE_BLOCK]
            places = block[:, None] + np.arange(1 - window, 1)
            p[i : i + SLIDE_BLOCK] = probabilities(vectors[places])
        out = chunk.select(names[:-1]).take(pa.array(at))
        return out.append_column("p", pa.array(p))

    # one task per chunk, as scoring is dear and merging small partitions would serialise it
    tasks = max(1, math.ceil((n_rows - start) / size))
    return spread.repartition(tasks, "__chunk").groupBy("__chunk").applyInArrow(run, schema)


def time_scoring(
    batch_rows: DataFrame,
    probabilities: Callable[[np.ndarray], np.ndarray],
    steps: int,
    width: int,
    n_repeats: int = 4,
) -> DataFrame:
    """(step, repeat, seconds): wall time of scoring each batch ``n_repeats`` times.

    ``batch_rows`` holds one window per row with its step; a group is one batch.
    """

    def run(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks()
        windows = _dense(batch["win"].combine_chunks(), batch.num_rows, steps, width)
        taken = []
        for _ in range(n_repeats):
            begin = time.perf_counter()
            probabilities(windows)
            taken.append(time.perf_counter() - begin)
        step = [batch["step"][0].as_py()] * n_repeats
        return pa.table(
            {"step": pa.array(step, pa.int64()), "repeat": pa.array(range(n_repeats), pa.int32()), "seconds": taken}
        )

    return batch_rows.select("step", "win").groupBy("step").applyInArrow(
        run, "step long, repeat int, seconds double"
    )


def _dense(windows: pa.Array, n: int, steps: int, width: int) -> np.ndarray:
    """Nested Arrow lists to one array without a Python loop."""
    flat = windows.flatten().flatten().to_numpy(zero_copy_only=False)
    if flat.size != n * steps * width:
        raise ValueError(f"windows are not all {steps} x {width}")
    return flat.reshape(n, steps, width).astype("float64", copy=False)


def _norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    centred = x - x.mean(axis=-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + NORM_EPSILON) * scale + shift


def _attention(x: np.ndarray, source: np.ndarray, w: Weights) -> np.ndarray:
    """Scaled dot-product attention of ``x`` over ``source``, all heads at once."""
    query, key, value = (
        np.tensordot(a, w[f"{p}_w"], axes=1) + w[f"{p}_b"]
        for a, p in ((x, "query"), (source, "key"), (source, "value"))
    )
    grades = np.matmul(query.transpose(0, 2, 1, 3), key.transpose(0, 2, 3, 1)) / math.sqrt(query.shape[-1])
    grades = np.exp(grades - grades.max(axis=-1, keepdims=True))
    grades /= grades.sum(axis=-1, keepdims=True)
    seen = np.matmul(grades, value.transpose(0, 2, 1, 3)).transpose(0, 2, 1, 3)
    return np.tensordot(seen, w["out_w"], axes=2) + w["out_b"]


def _encoder_block(x: np.ndarray, w: Weights) -> np.ndarray:
    """The closing norm takes the attention output, not the normed sum, as its residual."""
    a = _attention(x, x, w)
    f = _norm(x + a, w["norm1_scale"], w["norm1_shift"])
    f = np.maximum(f @ w["inner_w"] + w["inner_b"], 0.0)
    f = np.maximum(f @ w["outer_w"] + w["outer_b"], 0.0)
    return _norm(a + f, w["norm2_scale"], w["norm2_shift"])


def _decoder_block(x: np.ndarray, w: Weights) -> np.ndarray:
    """Cross attention looks back at the block input with the same weights; the second norm is shared."""
    y = _norm(x + _attention(x, x, w), w["norm1_scale"], w["norm1_shift"])
    y = _norm(y + _attention(y, x, w), w["norm2_scale"], w["norm2_shift"])
    f = np.maximum(y @ w["inner_w"] + w["inner_b"], 0.0) @ w["outer_w"] + w["outer_b"]
    return _norm(y + f, w["norm2_scale"], w["norm2_shift"])
