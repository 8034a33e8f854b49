"""Training / evaluation split."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netseq.functions.hashing import HASH_BITS, hash60
from netseq.operators.order import ROW, Indexed
from netseq.operators.windows import trailing
from netseq.spec import EvalSampling, quoted

TRAIN = "is_train"

# Below this many rows the boundary bucket of an exact sample is sorted and taken directly.
BOUNDARY_ROWS = 10_000
LEVEL_BITS = 16


def eval_count(n_rows: int, fraction: float) -> int:
    """Number of evaluation rows, truncated; none at all is an error."""
    n = int(n_rows * fraction)
    if n <= 0:
        raise ValueError(f"{fraction} of {n_rows} rows leaves no evaluation row")
    return n


def first_eval_row(n_rows: int, fraction: float) -> int:
    """Where the evaluation rows start when they are the last ones."""
    return n_rows - eval_count(n_rows, fraction)


def split_last(indexed: Indexed, fraction: float) -> DataFrame:
    """Last rows evaluate."""
    return indexed.df.withColumn(TRAIN, F.col(ROW) < first_eval_row(indexed.n_rows, fraction))


def training_rows(indexed: Indexed, fraction: float) -> DataFrame:
    """The training rows of ``split_last`` alone, read from only the files that hold them."""
    return indexed.between(0, first_eval_row(indexed.n_rows, fraction)).withColumn(TRAIN, F.lit(True))


def split_random(indexed: Indexed, fraction: float, window: int, seed: int) -> DataFrame:
    """An exact number of random rows evaluates, none of them among the first ``window`` rows."""
    n = eval_count(indexed.n_rows, fraction)
    if n > indexed.n_rows - window:
        raise ValueError("more evaluation rows asked for than there are after the first window")
    drawn = hash60(seed, F.col(ROW))
    pool = indexed.df.filter(F.col(ROW) >= window).select(ROW, drawn.alias("h"))
    top_hash, top_row = _nth_smallest(pool, n)
    chosen = (drawn < top_hash) | ((drawn == top_hash) & (F.col(ROW) <= top_row))
    return indexed.df.withColumn(TRAIN, ~((F.col(ROW) >= window) & chosen))


def split_flag(indexed: Indexed, test_column: str, window: int) -> DataFrame:
    """Rows with the rarer flag value evaluate (ties: the smaller value), past the first window.

    The flag column is dropped.
    """
    if test_column not in indexed.df.columns:
        raise ValueError(f"test column {test_column!r} is not in the table")
    flag = F.col(quoted(test_column))
    rarest = (
        indexed.df.groupBy(flag.alias("flag"))
        .agg(F.count("*").alias("n"))
        .orderBy("n", "flag")
        .limit(1)
        .collect()
    )
    value = F.lit(rarest[0]["flag"] if rarest else None)
    chosen = flag.eqNullSafe(value) & (F.col(ROW) > window)
    return indexed.df.withColumn(TRAIN, ~chosen).drop(test_column)


def split(
    indexed: Indexed,
    sampling: EvalSampling,
    fraction: float = 0.2,
    window: int = 8,
    seed: int = 42,
    test_column: str | None = None,
) -> DataFrame:
    """Add ``is_train`` by the chosen sampling."""
    if sampling is EvalSampling.LAST_ROWS:
        return split_last(indexed, fraction)
    warnings.warn("evaluation rows may be context of training windows; leak_audit counts them", stacklevel=2)
    if sampling is EvalSampling.RANDOM_ROWS:
        return split_random(indexed, fraction, window, seed)
    if test_column is None:
        raise ValueError("the dataset names no test column")
    return split_flag(indexed, test_column, window)


def leak_audit(df: DataFrame, n_rows: int, window: int) -> DataFrame:
    """How many training windows hold an evaluation row as context."""
    seen = trailing(
        df.select(ROW, TRAIN),
        window,
        n_rows,
        lambda frame: {"pure": F.min(TRAIN).over(frame), "size": F.count("*").over(frame)},
    )
    full = seen.filter((F.col("size") == window) & F.col(TRAIN))
    return full.agg(
        F.count("*").alias("train_windows"),
        F.count_if(~F.col("pure")).alias("leaky_windows"),
    )


def context_report(df: DataFrame, window: int) -> DataFrame:
    """(is_train, rows, windows, left_out): rows of each part, and those that end no window for lack of earlier rows."""
    ends = F.col(ROW) >= window - 1
    return df.groupBy(TRAIN).agg(
        F.count("*").alias("rows"), F.count_if(ends).alias("windows"), F.count_if(~ends).alias("left_out")
    )


def _nth_smallest(pool: DataFrame, n: int) -> tuple[int, int]:
    """The n-th smallest (h, row_idx) pair by narrowing a histogram of h; no sort of the pool."""
    shift, left = HASH_BITS, n
    while True:
        shift = max(shift - LEVEL_BITS, 0)
        buckets = pool.groupBy(F.shiftright("h", shift).alias("b")).agg(F.count("*").alias("n"))
        for bucket in sorted(buckets.collect()):
            if left <= bucket.n:
                break
            left -= bucket.n
        pool = pool.filter(F.shiftright("h", shift) == bucket.b)
        if bucket.n <= BOUNDARY_ROWS or shift == 0:
            last = pool.orderBy("h", ROW).limit(left).orderBy(F.desc("h"), F.desc(ROW)).first()
            return last.h, last[ROW]
