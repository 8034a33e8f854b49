"""Windows of consecutive flows: a global trailing frame computed chunk by chunk."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from netseq.operators.order import ROW, chunk_of
from netseq.session import BROADCAST_ROWS, NARROW_BROADCAST_ROWS, dealt, small_side
from netseq.spec import CategoricalFormat, ModelInput, quoted

CHUNK_ROWS = 65_536
MIN_CHUNK_ROWS = 1_024


def chunk_length(df: DataFrame, n_rows: int, window: int) -> int:
    """Rows per chunk: enough chunks for all cores on small input, a fixed size on large input."""
    share = math.ceil(n_rows / (4 * df.sparkSession.sparkContext.defaultParallelism))
    return max(window - 1, 1, min(CHUNK_ROWS, max(MIN_CHUNK_ROWS, share)))


def with_halo(df: DataFrame, window: int, size: int) -> DataFrame:
    """Add ``__chunk``; the last window-1 rows of each chunk also appear in the next one."""
    if size < window - 1:
        raise ValueError("a chunk must hold at least window - 1 rows")
    own = chunk_of(size)
    if window == 1:
        return df.withColumn("__chunk", own)
    shared = F.col(ROW) % size >= size - (window - 1)
    places = F.when(shared, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("__chunk", F.explode(places))


def trailing(
    df: DataFrame,
    window: int,
    n_rows: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    chunk_rows: int | None = None,
) -> DataFrame:
    """Add columns computed over the ``window`` rows ending at each row, in ``row_idx`` order.

    A global frame would gather all rows in one task. Here every chunk of rows also gets the last
    window-1 rows of the chunk before it, so its frames are complete; those copies (a share of
    (window-1)/chunk) are dropped afterwards.
    """
    size = chunk_rows or chunk_length(df, n_rows, window)
    spread, own = dealt(with_halo(df, window, size), n_rows, "__chunk"), chunk_of(size)
    frame = Window.partitionBy("__chunk").orderBy(ROW).rowsBetween(-(window - 1), Window.currentRow)
    added = [c.alias(name) for name, c in columns(frame).items()]
    return spread.select("*", *added).filter(F.col("__chunk") == own).drop("__chunk")


def ordered_windows(
    df: DataFrame,
    window: int,
    n_rows: int,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    ends: Column | None = None,
    first_end: int = 0,
    chunk_rows: int | None = None,
) -> DataFrame:
    """(row_idx, keep…, win) with ``win`` the ARRAY<STRUCT> of the rows ending at ``row_idx``.

    Only full windows are kept. ``ends`` selects the end rows; when they all lie at or after
    ``first_end``, rows that no window reaches are dropped before the shuffle.
    """
    start = max(first_end - (window - 1), 0)
    rows = df.filter(F.col(ROW) >= start) if start else df
    fields = list(dict.fromkeys([ROW, *keep, *columns]))
    rows = rows.select(*[quoted(c) for c in fields], *([ends.alias("__end")] if ends is not None else []))
    item = F.struct(*[quoted(c) for c in columns])
    out = trailing(
        rows, window, n_rows - start, lambda frame: {"win": F.collect_list(item).over(frame)}, chunk_rows
    )
    out = out.filter(F.col(ROW) >= max(first_end, window - 1))
    if ends is not None:
        out = out.filter("__end")
    return out.select(*[quoted(c) for c in dict.fromkeys([ROW, *keep])], "win")


def trailing_mean(
    df: DataFrame,
    window: int,
    n_rows: int,
    columns: dict[str, str],
    first_end: int = 0,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Mean of columns over each full window, without building the windows."""
    start = max(first_end - (window - 1), 0)
    rows = df.filter(F.col(ROW) >= start) if start else df
    out = trailing(
        rows,
        window,
        n_rows - start,
        lambda frame: {name: F.avg(quoted(c)).over(frame) for name, c in columns.items()},
        chunk_rows,
    )
    return out.filter(F.col(ROW) >= max(first_end, window - 1))


def long_form(windows: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (window end, position in the window)."""
    exploded = windows.select(ROW, *keep, F.posexplode("win").alias("pos", "flow"))
    return exploded.select(
        F.col(ROW).alias("end_idx"), *keep, "pos", *[F.col("flow")[c].alias(c) for c in columns]
    )


def featurewise(windows: DataFrame, model_input: ModelInput, keep: Sequence[str] = ()) -> DataFrame:
    """One array per feature from ``win``; one-hot features become arrays of level vectors."""
    arrays = []
    for feature, columns in model_input.feature_columns().items():
        if feature in model_input.numeric_features:
            value = _series(columns[0], "double")
        elif model_input.categorical_format is CategoricalFormat.ONE_HOT:
            value = _level_series(columns)
        else:
            value = _series(feature, "int")
        arrays.append(value.alias(feature))
    return windows.select(ROW, *keep, *arrays)


def windows_at(
    ends: DataFrame,
    flows: DataFrame,
    window: int,
    columns: Sequence[str],
    keep: Sequence[str],
    n_ends: int,
) -> DataFrame:
    """Windows for ``n_ends`` chosen end rows: each asks for its ``window`` positions by equi-join.

    Cheaper than windowing the whole table when the ends are few: up to the broadcast limit the flows
    are not shuffled, and beyond it only the blocks of flows that some window touches are: a block is as
    long as a window, so at most two of them for each end. ``keep`` identifies an end row together with
    ``row_idx``.
    """
    key = [ROW, *keep]
    wanted = ends.filter(F.col(ROW) >= window - 1).select(
        F.col(ROW).alias("__end"),
        *keep,
        F.explode(F.sequence(F.col(ROW) - (window - 1), F.col(ROW))).alias("__at"),
    )
    rows = flows.select(F.col(ROW).alias("__at"), *[quoted(c) for c in columns])
    if n_ends * window > BROADCAST_ROWS:
        block = chunk_of(window, "__at")
        touched = wanted.select(block.alias("__block")).distinct()
        touched = small_side(touched, 2 * n_ends, NARROW_BROADCAST_ROWS)
        rows = rows.withColumn("__block", block).join(touched, "__block", "left_semi").drop("__block")
    item = F.struct("__at", *[quoted(c) for c in columns])
    gathered = (
        rows.join(small_side(wanted, n_ends * window), "__at")
        .withColumnRenamed("__end", ROW)
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(item)).alias("win"))
    )
    bare = F.transform("win", lambda f: F.struct(*[f[c].alias(c) for c in columns]))
    return gathered.select(*key, bare.alias("win"))


def _series(column: str, kind: str) -> Column:
    """One field of the window's flows over time."""
    return F.transform("win", lambda flow: flow[column].cast(kind))


def _level_series(columns: Sequence[str]) -> Column:
    """The level vector of a one-hot feature over time."""
    return F.transform("win", lambda flow: F.array(*[flow[c].cast("int") for c in columns]))
