"""Queries on experiments over trained scorers and on the ledger of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netseq.functions.scalars import predicted_positive
from netseq.operators import trained
from netseq.operators.masks import LABEL, add_label
from netseq.operators.metrics import confusion, rates
from netseq.operators.order import ROW, Indexed
from netseq.operators.run_ledger import RunLedger
from netseq.operators.split import first_eval_row
from netseq.plans.common import (
    BAL_ACC,
    CONFUSION,
    EVENTS,
    F1,
    FRACTION,
    LINE_CLEAN,
    LINEITEM,
    ORDERS,
    WINDOW,
    events,
    lineitem,
    orders,
    rounded,
    trailing_avg,
)
from netseq.session import staging_path

FRACTIONS = [0.5, 0.3, 0.1]
STRENGTHS = (0.001, 0.1)
LINE_COLUMNS = ["l_quantity", "l_extendedprice"]

# Weights for the means and the last values of LINE_COLUMNS, by the class they stand for.
GIVEN = [
    trained.Fit("F", 0.0, (1.5, -0.5, 0.25, 0.125), -0.75),
    trained.Fit("O", 0.0, (-0.75, 0.5, 0.5, -0.25), -1.0),
]

# The grid: columns by data set and encoding; places in a pooled vector of two columns by head.
DATA = {"events": (events, EVENTS, "value", "user_id"), "orders": (orders, ORDERS, "o_totalprice", "o_custkey")}
ENCODINGS = {"number": (0,), "number and key": (0, 1)}
HEADS = {"average": (0,), "average and last": (0, 2)}
RESULT = (
    "data string, encoding string, head string, strength double, P bigint, N bigint, TP bigint, FP bigint, "
    "TN bigint, FN bigint, bal_acc double, f1 double"
)


def _labelled(indexed: Indexed, spec) -> Indexed:
    return Indexed(add_label(indexed.df, spec.class_column, spec.benign_label), indexed.n_rows)


def temporal_bias_trained(spark: SparkSession, folder: str) -> DataFrame:
    """A classifier per fraction of the events, evaluated as far from its training rows as it goes."""
    rows = _labelled(events(spark, folder), EVENTS)
    out = trained.temporal_bias(rows, ["value", "user_id"], FRACTIONS, WINDOW, STRENGTHS)
    return rounded(out, "bal_acc", "f1")


def transfer_trained(spark: SparkSession, folder: str) -> DataFrame:
    """A classifier per line status, evaluated on the windows of each."""
    rows = _labelled(lineitem(spark, folder), LINEITEM)
    return rounded(trained.transfer_matrix(rows, LINE_COLUMNS, "l_linestatus", WINDOW, STRENGTHS), "bal_acc", "f1")


def transfer_weights(spark: SparkSession, folder: str) -> DataFrame:
    """The same evaluation under given weights."""
    rows = _labelled(lineitem(spark, folder), LINEITEM)
    windows = trained.pooled_windows(rows, LINE_COLUMNS, WINDOW, ["l_linestatus"], staged=False)
    out = trained.evaluate_fits(windows, GIVEN, "l_linestatus").drop("strength")
    return rounded(out, "bal_acc", "f1")


def grid_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Data sets x encodings x heads x models, each run committed to a ledger; windows are pooled once a data set."""
    plan = [
        {"data": data, "encoding": encoding, "head": head, "strength": strength}
        for data in DATA for encoding in ENCODINGS for head in HEADS for strength in STRENGTHS
    ]
    pooled: dict[str, tuple[DataFrame, int]] = {}

    def windows_of(data: str) -> tuple[DataFrame, int]:
        if data not in pooled:
            table, spec, *columns = DATA[data]
            rows = _labelled(table(spark, folder), spec)
            pooled[data] = trained.pooled_windows(rows, columns, WINDOW), first_eval_row(rows.n_rows, FRACTION)
        return pooled[data]

    def execute(run: dict) -> DataFrame:
        windows, first = windows_of(run["data"])
        places = [h + e for h in HEADS[run["head"]] for e in ENCODINGS[run["encoding"]]]
        chosen = windows.select(ROW, LABEL, F.array(*[F.col("x")[i] for i in places]).alias("x"))
        evaluated = chosen.filter(F.col(ROW) >= first)
        fits = trained.train(chosen, {run["data"]: F.col(ROW) < first}, [run["strength"]], iterations=20)
        predicted = predicted_positive(fits[0].score(), 0.5)
        names = [F.lit(v).alias(k) for k, v in run.items()]
        counts = rates(confusion(evaluated, predicted, LABEL))
        return counts.select(*names, "P", "N", "TP", "FP", "TN", "FN", "bal_acc", "f1")

    ledger = RunLedger(spark, staging_path(spark, "grid"), RESULT)
    return rounded(ledger.work_off(plan, execute).drop("run", "settings"), "bal_acc", "f1")


QUERIES = {
    "temporal_bias_trained": temporal_bias_trained,
    "transfer_trained": transfer_trained,
    "transfer_weights": transfer_weights,
    "grid_runs": grid_runs,
}

_WEIGHTS = ", ".join(f"('{f.fit_on}', {', '.join(f'{w}::DOUBLE' for w in (*f.weights, f.bias))})" for f in GIVEN)
_LOGS = ", ".join(f"sign({c}) * ln(1 + abs({c})) AS v{i}" for i, c in enumerate(LINE_COLUMNS))

ORACLE = {
    "transfer_weights": f"WITH {LINE_CLEAN}, w(fit_on, w0, w1, w2, w3, b) AS (VALUES {_WEIGHTS}), "
    f"l AS (SELECT row_idx, l_linestatus AS eval_on, l_returnflag IS DISTINCT FROM 'N' AS y, {_LOGS} FROM c), "
    f"m AS (SELECT *, {trailing_avg('v0')} AS m0, {trailing_avg('v1')} AS m1 FROM l), "
    "g AS (SELECT fit_on, eval_on, y, 1 / (1 + exp(-(b + w0 * m0 + w1 * m1 + w2 * v0 + w3 * v1))) > 0.5 AS pred "
    f"FROM m CROSS JOIN w WHERE row_idx >= {WINDOW - 1}), "
    f"k AS (SELECT fit_on, eval_on, {CONFUSION} FROM g GROUP BY 1, 2) "
    f"SELECT fit_on, eval_on, P, N, pred_P, pred_N, TP, FP, TN, FN, {BAL_ACC} AS bal_acc, {F1} AS f1 FROM k",
}
