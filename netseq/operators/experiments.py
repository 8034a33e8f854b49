"""Data experiments: temporal bias, transferability, concept drift, experiment grid."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netseq.functions.hashing import HASH_RANGE, hash60
from netseq.functions.scalars import log_minmax, predicted_positive, sanitise
from netseq.operators.masks import LABEL
from netseq.operators.metrics import confusion, evaluate, rates
from netseq.operators.numeric import fit_minmax, scaled
from netseq.operators.order import ROW, Indexed, Ranked, chunk_of, index_by_keys
from netseq.operators.split import TRAIN, eval_count
from netseq.operators.windows import trailing, trailing_mean
from netseq.session import small_side, stage

# Fits that a window meets at once in a transfer matrix.
FITS_AT_ONCE = 64


def temporal_bias(
    indexed: Indexed, value: str, fractions: Sequence[float], window: int, threshold: float = 0.5
) -> DataFrame:
    """Train on the first f of the rows, evaluate on the last f, for each f: quality against the gap.

    All fits share one aggregation and all evaluations one windowing. ``indexed`` carries ``y``.
    """
    n = indexed.n_rows
    df = indexed.df.select(ROW, LABEL, sanitise(F.col(value)).alias("v"))
    sizes = [eval_count(n, f) for f in fractions]
    ends = df.agg(
        *[F.min(F.when(F.col(ROW) < m, F.col("v"))).alias(f"lo{i}") for i, m in enumerate(sizes)],
        *[F.max(F.when(F.col(ROW) < m, F.col("v"))).alias(f"hi{i}") for i, m in enumerate(sizes)],
    ).first()
    fits = [(ends[f"lo{i}"], ends[f"hi{i}"] - ends[f"lo{i}"]) for i in range(len(sizes))]
    rows = df.select(ROW, LABEL, *[scaled("v", fit).alias(f"s{i}") for i, fit in enumerate(fits)])
    means = trailing_mean(
        rows, window, n, {f"p{i}": f"s{i}" for i in range(len(sizes))}, first_end=n - max(sizes)
    )
    studies = [
        F.struct(
            F.lit(float(f)).alias("fraction"),
            F.lit(n - 2 * m).cast("bigint").alias("gap"),
            (F.col(ROW) >= n - m).alias("is_eval"),
            F.col(f"p{i}").alias("p"),
        )
        for i, (f, m) in enumerate(zip(fractions, sizes))
    ]
    scored = means.select(LABEL, F.inline(F.array(*studies))).filter("is_eval")
    return evaluate(scored, "p", LABEL, threshold, by=["fraction", "gap"])


def transfer_matrix(
    indexed: Indexed, value: str, class_column: str, window: int, threshold: float = 0.5
) -> DataFrame:
    """Fit on the rows of one class, evaluate on the windows ending in every class; F1 against home.

    ``indexed`` carries ``y``. One fit per class, kept as a table whose rows are numbered and grouped to blocks of
    bounded length. Every window meets every block by its number, so the work is rows times classes, as the matrix
    asks, and no row holds more than a block of fits.
    """
    n = indexed.n_rows
    df = indexed.df.select(
        ROW, LABEL, F.col(class_column).alias("eval_on"), sanitise(F.col(value)).alias("v")
    )
    fits = df.groupBy(F.col("eval_on").alias("fit_on")).agg(F.min("v").alias("lo"), (F.max("v") - F.min("v")).alias("spread"))
    numbered = index_by_keys(stage(fits, "class-fits"), ["fit_on"])
    blocks = numbered.df.groupBy(chunk_of(FITS_AT_ONCE).alias("block")).agg(F.collect_list(F.struct("fit_on", "lo", "spread")).alias("fits"))
    n_blocks = -(-numbered.n_rows // FITS_AT_ONCE)
    windows = trailing(df, window, n, lambda frame: {"vs": F.collect_list("v").over(frame)})
    every_block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(n_blocks, 1) - 1).cast("bigint")))
    met = windows.filter(F.col(ROW) >= window - 1).select(LABEL, "eval_on", "vs", every_block.alias("block"))
    met = met.join(small_side(blocks, numbered.n_rows), "block")

    def mean_under(fit: Column) -> Column:
        total = F.aggregate("vs", F.lit(0.0), lambda s, v: s + log_minmax(v, fit["lo"], fit["spread"]))
        return F.struct(fit["fit_on"].alias("fit_on"), (total / F.size("vs")).alias("p"))

    scored = met.select(LABEL, "eval_on", F.inline(F.transform("fits", mean_under)))
    results = evaluate(scored, "p", LABEL, threshold, by=["fit_on", "eval_on"])
    at_home = F.when(F.col("fit_on").eqNullSafe(F.col("eval_on")), F.col("f1"))
    home = F.max(at_home).over(Window.partitionBy("fit_on"))
    return results.withColumn("f1_change", F.col("f1") - home)


def drift_mix(indexed: Indexed, is_second: Column, seed: int) -> Indexed:
    """Phase from one set of rows to another: position r holds the second set's r-th row with chance r/N.

    Both sets are ranked in order; each row then decides alone whether its rank belongs to its set,
    so no join is needed. N is the shorter length. The result is indexed by rank.
    """
    tagged = indexed.df.withColumn("from_second", is_second)
    ranked = Ranked(tagged, indexed.n_rows, "from_second")
    n = min(ranked.sizes.get(False, 0), ranked.sizes.get(True, 0))
    if n == 0:
        raise ValueError("both sets need rows")
    chance = hash60(seed, F.col("rank")).cast("double") / F.lit(float(HASH_RANGE))
    second_here = chance < F.col("rank").cast("double") / F.lit(float(n))
    mixed = ranked.all().filter((F.col("rank") < n) & (F.col("from_second") == second_here))
    return Indexed(mixed.drop(ROW).withColumnRenamed("rank", ROW), n)


def drift_mix_tables(first: Indexed, second: Indexed, seed: int) -> Indexed:
    """The same phase from one table to another: position r holds row r of ``second`` with chance r/N.

    Both tables have the same columns and are indexed each for itself; every row decides alone whether its position
    belongs to its table, so the two are neither joined nor shuffled. N is the shorter length; of a longer table only
    the files that hold its first N rows are read.
    """
    n = min(first.n_rows, second.n_rows)
    if n == 0:
        raise ValueError("both tables need rows")
    chance = hash60(seed, F.col(ROW)).cast("double") / F.lit(float(HASH_RANGE))
    second_here = chance < F.col(ROW).cast("double") / F.lit(float(n))
    parts = [
        t.between(0, n).filter(second_here == F.lit(here)).withColumn("from_second", F.lit(here))
        for t, here in ((first, False), (second, True))
    ]
    return Indexed(parts[0].unionByName(parts[1]), n)


def drift_report(
    mixed: Indexed, value: str, fit: tuple[float, float], window: int, threshold: float = 0.5
) -> DataFrame:
    """Quality per tenth of a mixed stream under a fit made before the drift."""
    rows = mixed.df.select(
        ROW, LABEL, "from_second", scaled(value, fit).alias("scaled")
    )
    means = trailing_mean(rows, window, mixed.n_rows, {"p": "scaled"})
    tenths = means.withColumn("tenth", F.expr(f"{ROW} * 10 div {mixed.n_rows}"))
    second = {"second_rows": F.count_if("from_second")}
    counts = confusion(tenths, predicted_positive(F.col("p"), threshold), LABEL, ["tenth"], second)
    return rates(counts).select(
        "tenth", "second_rows", "P", "N", "TP", "FP", "TN", "FN", "bal_acc", "f1"
    )


def grid(components: dict[str, Sequence]) -> list[dict]:
    """Every combination of the named component lists; values need ``name`` and ``parameters``."""
    runs: list[dict] = [{}]
    for kind, choices in components.items():
        runs = [{**run, kind: choice} for run in runs for choice in choices]
    return runs


def grid_table(df: DataFrame, components: dict[str, Sequence]) -> DataFrame:
    """The grid as a run plan: run number and one column per component."""
    runs = grid(components)
    rows = [
        (i, *[json.dumps({"name": c.name, **c.parameters}, sort_keys=True) for c in run.values()])
        for i, run in enumerate(runs)
    ]
    fields = ", ".join(["run int", *[f"{kind} string" for kind in components]])
    return df.sparkSession.createDataFrame(rows, fields)


def pooled_grid(
    df: DataFrame,
    n_rows: int,
    window: int,
    encodings: dict[str, str],
    thresholds: Sequence[float],
    first_end: int = 0,
) -> DataFrame:
    """Evaluate every encoding x head x threshold over one windowing of the table.

    ``encodings`` names score columns. Heads are the mean and the last step of a window. The
    combinations are attached to each window as a constant list, so the grid costs one shuffle.
    """
    start = max(first_end - (window - 1), 0)
    rows = df.filter(F.col(ROW) >= start) if start else df
    seen = trailing(
        rows,
        window,
        n_rows,
        lambda frame: {f"m_{name}": F.avg(c).over(frame) for name, c in encodings.items()},
    ).filter(F.col(ROW) >= max(first_end, window - 1))
    runs = [
        F.struct(
            F.lit(name).alias("encoding"),
            F.lit(head).alias("head"),
            F.lit(float(t)).alias("threshold"),
            F.col(f"m_{name}" if head == "average" else column).alias("p"),
        )
        for name, column in encodings.items()
        for head in ("average", "last")
        for t in thresholds
    ]
    scored = seen.filter(~F.col(TRAIN)).select(LABEL, F.inline(F.array(*runs)))
    predicted = F.coalesce(~F.isnan("p") & (F.col("p") > F.col("threshold")), F.lit(False))
    counts = confusion(scored, predicted, LABEL, by=["encoding", "head", "threshold"])
    return rates(counts).select(
        "encoding", "head", "threshold", "P", "N", "TP", "FP", "TN", "FN", "bal_acc", "f1"
    )


def before_drift_fit(indexed: Indexed, value: str, is_second: Column) -> tuple[float, float]:
    """Fit on the first set only."""
    first = indexed.df.select(value, (~is_second).alias(TRAIN))
    return fit_minmax(first, [value])[value]
