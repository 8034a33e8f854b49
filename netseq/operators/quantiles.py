"""Percentiles from mergeable sketches, which are tables of counts.

A sketch counts values in cells whose ends have a fixed ratio, so sketches of parts, steps or days merge by adding
counts, in any order, and give the same percentiles as one sketch of all rows. The percentile ``q`` of n values is the
one with rank floor(q * (n - 1)) from 0; what a sketch gives for it is at most ``accuracy`` away, relatively. A sketch
has at most 1,490 / log((1 + accuracy) / (1 - accuracy)) cells a sign, 75,000 for one percent, however many rows it
counts. Values that are null, NaN or infinite are not counted; without any value there is no row.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netseq.operators.order import chunk_of
from netseq.spec import quoted

ACCURACY = 0.01

# Steps that one task walks along; each such chunk begins with the counts of all steps before it.
CHUNK_STEPS = 1_024

# No logarithm of a positive double is below -745.
_LEAST_LOG = 745


def cell_width(accuracy: float) -> float:
    """Logarithm of the ratio between the ends of a cell."""
    if not 0 < accuracy < 1:
        raise ValueError("accuracy must lie between 0 and 1")
    return math.log((1 + accuracy) / (1 - accuracy))


def cell_shift(accuracy: float) -> int:
    """What makes the numbers of all cells of positive values positive."""
    return math.ceil(_LEAST_LOG / cell_width(accuracy)) + 1


def cell_of(value: Column, accuracy: float = ACCURACY) -> Column:
    """Number of a value's cell; cells are numbered in the order of their values, 0 holds 0 alone."""
    size = F.ceil(F.ln(F.abs(value)) / F.lit(cell_width(accuracy))) + F.lit(cell_shift(accuracy))
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("bigint") * size).cast("bigint")


def value_of(cell: Column, accuracy: float = ACCURACY) -> Column:
    """The value that is relatively nearest to all values of a cell."""
    width = cell_width(accuracy)
    size = F.exp((F.abs(cell) - F.lit(cell_shift(accuracy))) * F.lit(width)) * F.lit(2 / (math.exp(width) + 1))
    return F.signum(cell) * F.least(size, F.lit(sys.float_info.max))


def sketch(df: DataFrame, value: str, by: Sequence[str] = (), accuracy: float = ACCURACY) -> DataFrame:
    """(by…, cell, n): how many values fall into each cell, combined before the shuffle."""
    number = F.col(quoted(value)).cast("double")
    finite = df.filter(F.abs(number) < F.lit(float("inf")))
    cells = finite.select(*[quoted(c) for c in by], cell_of(number, accuracy).alias("cell"))
    return cells.groupBy(*[quoted(c) for c in by], "cell").agg(F.count("*").alias("n"))


def percentiles(
    sketches: DataFrame, shares: dict[str, float], by: Sequence[str] = (), accuracy: float = ACCURACY
) -> DataFrame:
    """(by…, a column per share) after merging all sketches with equal ``by``; a task sees cells, never rows."""
    keys, shares = [quoted(c) for c in by], _checked(shares)
    merged = sketches.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys)
    so_far = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = merged.select(*keys, "cell", F.sum("n").over(so_far).alias("__upto"), F.sum("n").over(group).alias("__all"))
    reached = {name: F.col("__upto") > F.lit(float(q)) * (F.col("__all") - 1) for name, q in shares.items()}
    picked = ranked.groupBy(*keys).agg(*[F.min(F.when(hit, F.col("cell"))).alias(name) for name, hit in reached.items()])
    if not by:
        picked = picked.filter(F.col(quoted(next(iter(shares)))).isNotNull())
    return picked.select(*keys, *[value_of(F.col(quoted(name)), accuracy).alias(name) for name in shares])


def running_percentiles(
    sketches: DataFrame, n_steps: int, shares: dict[str, float], step: str = "step", accuracy: float = ACCURACY,
    chunk_steps: int = CHUNK_STEPS,
) -> DataFrame:
    """(step, a column per share): percentiles of all values up to each step of 0 … n_steps-1 that has a sketch.

    Counts before a chunk of steps come from the totals of the chunks, cell by cell; a task then adds the steps
    of its chunk one after the other. Sketches without a step have no place and are left out.
    """
    merged = sketches.filter(F.col(quoted(step)).isNotNull()).groupBy(F.col(quoted(step)).cast("bigint").alias("step"), "cell")
    own = merged.agg(F.sum("n").alias("n")).withColumn("chunk", chunk_of(chunk_steps, "step"))
    along = Window.partitionBy("cell").orderBy("chunk")
    totals = own.groupBy("chunk", "cell").agg(F.sum("n").alias("n")).select(
        "cell",
        F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("n"),
        (F.col("chunk") + 1).alias("low"),
        F.coalesce(F.lead("chunk").over(along), F.lit((n_steps - 1) // chunk_steps)).alias("high"),
    )
    carried = totals.filter("low <= high").select(
        F.lit(None).cast("bigint").alias("step"), "cell", "n", F.explode(F.sequence("low", "high")).alias("chunk")
    )
    fields = ", ".join(["step bigint", *[f"`{name}` bigint" for name in shares]])
    walked = own.unionByName(carried).groupBy("chunk").applyInArrow(_walk(_checked(shares)), fields)
    return walked.select("step", *[value_of(F.col(quoted(name)), accuracy).alias(name) for name in shares])


def _checked(shares: dict[str, float]) -> dict[str, float]:
    if not shares or not all(0 <= q <= 1 for q in shares.values()):
        raise ValueError("name at least one share between 0 and 1")
    return shares


def _walk(shares: dict[str, float]) -> Callable[[pa.Table], pa.Table]:
    """Cells of the percentiles after each step of a chunk; memory follows the cells, not steps times cells."""

    def walk(rows: pa.Table) -> pa.Table:
        before = rows["step"].is_null().to_numpy()
        cells, at = np.unique(rows["cell"].to_numpy(), return_inverse=True)
        n, steps = rows["n"].to_numpy(), rows["step"].fill_null(-1).to_numpy()
        counts = np.zeros(len(cells), dtype=np.int64)
        counts[at[before]] = n[before]
        order = np.argsort(steps, kind="stable")[int(before.sum()):]
        names, starts = np.unique(steps[order], return_index=True)
        found = {name: np.zeros(len(names), dtype=np.int64) for name in shares}
        for i, (lo, hi) in enumerate(zip(starts, [*starts[1:], len(order)])):
            here = order[lo:hi]
            counts[at[here]] += n[here]
            upto = np.cumsum(counts)
            for name, q in shares.items():
                found[name][i] = cells[np.searchsorted(upto, q * (upto[-1] - 1), side="right")]
        return pa.table({"step": names.astype(np.int64), **found})

    return walk
