"""Data experiments over trained scorers: a logistic unit over pooled windows, trained once per fraction or class.

Windows are pooled and staged once; every training run and the one evaluation pass read that table. Features are the
mean and the last value of each column over a window, after a signed logarithm, which needs no fit; the learner
standardises them on its own training windows, so nothing of an evaluation part reaches a fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netseq.functions.scalars import sanitise
from netseq.operators.masks import LABEL
from netseq.operators.metrics import evaluate
from netseq.operators.order import ROW, Indexed
from netseq.operators.split import eval_count
from netseq.operators.windows import trailing
from netseq.session import stage
from netseq.spec import quoted

# Every fit is a training run of its own, so their number is a matter of time, not of data; more are refused.
MOST_FITS = 256

ITERATIONS = 100
STRENGTHS = (0.01,)


class Fit(NamedTuple):
    """A logistic unit: what it was trained on, the strength of its regularisation, its weights."""

    fit_on: object
    strength: float
    weights: tuple[float, ...]
    bias: float

    def score(self, vector: str = "x") -> Column:
        """Probability of the malicious class."""
        total = F.lit(self.bias)
        for i, w in enumerate(self.weights):
            total = total + F.lit(w) * F.col(vector)[i]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def pooled_windows(
    indexed: Indexed, columns: Sequence[str], window: int, keep: Sequence[str] = (), staged: bool = True
) -> DataFrame:
    """(row_idx, y, keep…, x) of every full window; ``x`` has the means, then the last values.

    ``indexed`` carries ``y``. Null, NaN, infinite and very large values count as 0. Windows that are read once need
    not be ``staged``.
    """
    values = [sanitise(F.col(quoted(c))) for c in columns]
    logs = [(F.signum(v) * F.log1p(F.abs(v))).alias(f"__v{i}") for i, v in enumerate(values)]
    rows = indexed.df.select(ROW, LABEL, *[quoted(c) for c in keep], *logs)
    means = trailing(
        rows, window, indexed.n_rows,
        lambda frame: {f"__m{i}": F.avg(f"__v{i}").over(frame) for i in range(len(columns))},
    )
    parts = [F.col(f"__{kind}{i}") for kind in "mv" for i in range(len(columns))]
    full = means.filter(F.col(ROW) >= window - 1)
    pooled = full.select(ROW, LABEL, *[quoted(c) for c in keep], F.array(*parts).alias("x"))
    return stage(pooled, "pooled-windows") if staged else pooled


def train(
    windows: DataFrame, members: dict[object, Column], strengths: Sequence[float] = STRENGTHS, iterations: int = ITERATIONS
) -> list[Fit]:
    """One fit per member and strength, each on the windows its condition selects.

    A member without windows has no fit; one whose windows are all of one class predicts that class.
    """
    if len(members) * len(strengths) > MOST_FITS:
        raise ValueError(f"{len(members) * len(strengths)} fits asked for; at most {MOST_FITS} are trained")
    if not members:
        return []
    names = list(members)
    sizes = windows.agg(*[F.count_if(members[m]).alias(f"n{i}") for i, m in enumerate(names)]).first()
    learner = LogisticRegression(featuresCol="features", labelCol="label", maxIter=iterations, tol=1e-7)
    fits = []
    for name in (m for m, n in zip(names, sizes) if n):
        rows = windows.filter(members[name]).select(
            array_to_vector("x").alias("features"), F.col(LABEL).cast("double").alias("label")
        )
        found = dict(learner.fitMultiple(rows, [{learner.regParam: float(s)} for s in strengths]))
        for i, strength in enumerate(strengths):
            weights = tuple(float(w) for w in found[i].coefficients)
            fits.append(Fit(name, float(strength), weights, float(found[i].intercept)))
    return fits


def temporal_bias(
    indexed: Indexed, columns: Sequence[str], fractions: Sequence[float], window: int,
    strengths: Sequence[float] = STRENGTHS, threshold: float = 0.5,
) -> DataFrame:
    """Train on the windows in the first f of the rows, evaluate on those in the last f, for each f and strength.

    All evaluations are one pass. A part without rows is an error; one too small to hold a window has no fit.
    """
    n = indexed.n_rows
    windows = pooled_windows(indexed, columns, window)
    sizes = {float(f): eval_count(n, f) for f in fractions}
    fits = train(windows, {f: F.col(ROW) < m for f, m in sizes.items()}, strengths)
    studies = [
        F.struct(
            F.lit(fit.fit_on).alias("fraction"), F.lit(fit.strength).alias("strength"),
            F.lit(n - 2 * sizes[fit.fit_on]).cast("bigint").alias("gap"),
            (F.col(ROW) >= n - sizes[fit.fit_on]).alias("is_eval"), fit.score().alias("p"),
        )
        for fit in fits
    ]
    kind = "array<struct<fraction:double,strength:double,gap:bigint,is_eval:boolean,p:double>>"
    scored = windows.select(LABEL, F.inline(F.array(*studies).cast(kind))).filter("is_eval")
    return evaluate(scored, "p", LABEL, threshold, by=["fraction", "strength", "gap"])


def transfer_matrix(
    indexed: Indexed, columns: Sequence[str], class_column: str, window: int,
    strengths: Sequence[float] = STRENGTHS, threshold: float = 0.5,
) -> DataFrame:
    """Train on the windows that end in one class, evaluate on those of every class, null being a class too."""
    windows = pooled_windows(indexed, columns, window, [class_column])
    key = F.col(quoted(class_column))
    found = [r[0] for r in windows.select(key).distinct().limit(MOST_FITS + 1).collect()]
    fits = train(windows, {c: key.eqNullSafe(F.lit(c)) for c in found}, strengths)
    return evaluate_fits(windows, fits, class_column, threshold)


def evaluate_fits(windows: DataFrame, fits: Sequence[Fit], class_column: str, threshold: float = 0.5) -> DataFrame:
    """(fit_on, strength, eval_on, counts and rates): every fit on the windows of every class, in one pass."""
    kind = windows.schema[class_column].dataType.simpleString()
    studies = [
        F.struct(F.lit(f.fit_on).cast(kind).alias("fit_on"), F.lit(f.strength).alias("strength"), f.score().alias("p"))
        for f in fits
    ]
    every = F.array(*studies).cast(f"array<struct<fit_on:{kind},strength:double,p:double>>")
    scored = windows.select(LABEL, F.col(quoted(class_column)).alias("eval_on"), F.inline(every))
    return evaluate(scored, "p", LABEL, threshold, by=["fit_on", "strength", "eval_on"])
