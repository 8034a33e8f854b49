"""Queries on quality figures, run logs and data experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netseq.functions.hashing import HASH_RANGE
from netseq.functions.scalars import predicted_positive
from netseq.operators import experiments, quantiles, runlog
from netseq.operators.categorical import encode, fit_levels
from netseq.operators.masks import LABEL, add_label
from netseq.operators.metrics import RESULT_COLUMNS, class_counts, confusion, evaluate, rates
from netseq.operators.numeric import fit_minmax, sanitise, scaled
from netseq.operators.order import ROW, Indexed
from netseq.operators.split import TRAIN, first_eval_row, training_rows
from netseq.operators.windows import trailing_mean
from netseq.plans.common import (
    BAL_ACC,
    CONFUSION,
    EVENT_ENCODED,
    EVENT_LABELS,
    EVENT_ROWS,
    EVENT_SCALED,
    EVENTS,
    F1,
    FRACTION,
    LEVELS,
    LINE_ROWS,
    LINEITEM,
    SEED,
    WINDOW,
    clean,
    events,
    h60,
    labelled_events,
    lineitem,
    minmax,
    orders,
    rd,
    rounded,
    trailing_avg,
)

THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]
GRID_THRESHOLDS = [0.4, 0.5, 0.6]
TEMPORAL_FRACTIONS = [0.5, 0.4, 0.3, 0.2, 0.1]
STEPS_PER_EPOCH = 500
PATIENCE = 3
REPEATS = 4
SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    """(y, p) of the evaluation windows; the score is the mean scaled value of the window.

    The fit reads only the files with training rows, the scores only those with evaluation rows and
    the few rows before them.
    """
    indexed = events(spark, folder)
    n, first = indexed.n_rows, first_eval_row(indexed.n_rows, FRACTION)
    training = sanitise(training_rows(indexed, FRACTION).select(TRAIN, "value"), ["value"])
    fit = fit_minmax(training, ["value"])["value"]
    rows = add_label(indexed.between(first - (WINDOW - 1)), EVENTS.class_column, EVENTS.benign_label)
    rows = sanitise(rows.select(ROW, LABEL, "value"), ["value"])
    scores = rows.select(ROW, LABEL, scaled("value", fit).alias("scaled"))
    return trailing_mean(scores, WINDOW, n, {"p": "scaled"}, first_end=first).select(LABEL, "p")


def eval_counts(spark: SparkSession, folder: str) -> DataFrame:
    df, _ = labelled_events(spark, folder)
    return class_counts(df.filter(~F.col(TRAIN)))


def confusion_counts(spark: SparkSession, folder: str) -> DataFrame:
    return confusion(scored_events(spark, folder), predicted_positive(F.col("p")))


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: split, clean, fit, scale, window, score, threshold, evaluate."""
    return rounded(evaluate(scored_events(spark, folder)), "bal_acc", "f1")


def all_rates(spark: SparkSession, folder: str) -> DataFrame:
    names = ["sensitivity", "specificity", "precision", "recall"]
    counts = confusion(scored_events(spark, folder), predicted_positive(F.col("p")))
    return rounded(rates(counts).select(*names), *names)


def epoch_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """One result row per epoch; each epoch stands for a threshold."""
    epochs = [F.struct(F.lit(i).alias("epoch"), F.lit(t).alias("threshold")) for i, t in enumerate(THRESHOLDS)]
    scored = scored_events(spark, folder).select(LABEL, "p", F.inline(F.array(*epochs)))
    predicted = F.coalesce(~F.isnan("p") & (F.col("p") > F.col("threshold")), F.lit(False))
    results = rates(confusion(scored, predicted, by=["epoch"]))
    return rounded(results.select("epoch", *RESULT_COLUMNS), "bal_acc", "f1")


def run_log(spark: SparkSession, folder: str) -> Indexed:
    """Events as a training log: (epoch, step, loss, seconds) in step order."""
    indexed = events(spark, folder)
    log = indexed.df.select(
        ROW,
        F.expr(f"{ROW} div {STEPS_PER_EPOCH}").alias("epoch"),
        (F.col(ROW) % STEPS_PER_EPOCH).alias("step"),
        F.col("value").alias("loss"),
        (F.sqrt("value") / F.lit(1000.0)).alias("seconds"),
    )
    return Indexed(log, indexed.n_rows)


def _epochs(n_rows: int) -> int:
    return -(-n_rows // STEPS_PER_EPOCH)


def early_stop(spark: SparkSession, folder: str) -> DataFrame:
    log = run_log(spark, folder)
    verdicts = runlog.epoch_verdicts(log.df, _epochs(log.n_rows), PATIENCE)
    return verdicts.select("epoch", "min_loss", "improved", "counter", "stop")


def final_epoch(spark: SparkSession, folder: str) -> DataFrame:
    log = run_log(spark, folder)
    return runlog.final_epoch(runlog.epoch_verdicts(log.df, _epochs(log.n_rows), PATIENCE))


def eval_schedule(spark: SparkSession, folder: str) -> DataFrame:
    log = run_log(spark, folder)
    epochs = _epochs(log.n_rows)
    return runlog.eval_schedule(runlog.epoch_verdicts(log.df, epochs, 0), epochs - 1)


def elapsed(spark: SparkSession, folder: str) -> DataFrame:
    log = run_log(spark, folder)
    timed = runlog.elapsed(log.df, log.n_rows, ROW)
    return rounded(timed.select("epoch", "step", "elapsed"), "elapsed")


def _timings(spark: SparkSession, folder: str) -> Indexed:
    log = run_log(spark, folder)
    return Indexed(log.df.select(F.expr(f"{ROW} div {REPEATS}").alias("step"), "seconds"), log.n_rows)


def latency_running(spark: SparkSession, folder: str) -> DataFrame:
    timings = _timings(spark, folder)
    out = runlog.latency_by_step(timings.df, -(-timings.n_rows // REPEATS))
    return rounded(out, "mean_s", "running_mean_s")


def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(runlog.latency_summary(_timings(spark, folder).df), "mean_s", "min_s", "max_s")


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of each epoch, merged from the sketches of its steps."""
    log = run_log(spark, folder)
    steps = quantiles.sketch(log.df, "seconds", ["epoch", "step"])
    return rounded(quantiles.percentiles(steps, SHARES, ["epoch"]), *SHARES)


def latency_running_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of all timings up to each step."""
    timings = _timings(spark, folder)
    steps = quantiles.sketch(timings.df, "seconds", ["step"])
    return rounded(quantiles.running_percentiles(steps, -(-timings.n_rows // REPEATS), SHARES), *SHARES)


def temporal_bias(spark: SparkSession, folder: str) -> DataFrame:
    df, n = labelled_events(spark, folder)
    out = experiments.temporal_bias(Indexed(df, n), "value", TEMPORAL_FRACTIONS, WINDOW)
    return rounded(out, "bal_acc", "f1")


def transfer_matrix(spark: SparkSession, folder: str) -> DataFrame:
    indexed = lineitem(spark, folder)
    df = add_label(indexed.df, LINEITEM.class_column, LINEITEM.benign_label)
    out = experiments.transfer_matrix(Indexed(df, indexed.n_rows), "l_quantity", "l_linestatus", WINDOW, 0.8)
    return rounded(out, "bal_acc", "f1", "f1_change")


def _drift(spark: SparkSession, folder: str):
    df, n = labelled_events(spark, folder)
    second = F.col("user_id") % 2 == 1
    return Indexed(df, n), second, experiments.drift_mix(Indexed(df, n), second, SEED)


def drift_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = _drift(spark, folder)[2]
    return mixed.df.select(ROW, "event_id", "user_id", "from_second")


def drift_two_tables(spark: SparkSession, folder: str) -> DataFrame:
    """From order totals to the values of events, each table in its own order."""
    first, second = orders(spark, folder), events(spark, folder)
    totals = Indexed(first.df.select(ROW, F.col("o_totalprice").alias("value")), first.n_rows)
    values = Indexed(second.df.select(ROW, "value"), second.n_rows)
    return experiments.drift_mix_tables(totals, values, SEED).df


def drift_report(spark: SparkSession, folder: str) -> DataFrame:
    indexed, second, mixed = _drift(spark, folder)
    fit = experiments.before_drift_fit(indexed, "value", second)
    return rounded(experiments.drift_report(mixed, "value", fit, WINDOW), "bal_acc", "f1")


def experiment_grid(spark: SparkSession, folder: str) -> DataFrame:
    df, n = labelled_events(spark, folder)
    fit = fit_minmax(df, ["value"])["value"]
    coded = encode(df, fit_levels(df, ["user_id"], LEVELS), suffix="_code")
    rows = coded.select(
        ROW,
        TRAIN,
        LABEL,
        scaled("value", fit).alias("value"),
        (F.col("user_id_code") / F.lit(float(LEVELS))).alias("user"),
    )
    out = experiments.pooled_grid(
        rows, n, WINDOW, {"value": "value", "user": "user"}, GRID_THRESHOLDS, first_eval_row(n, FRACTION)
    )
    return rounded(out, "bal_acc", "f1")


QUERIES = {
    "eval_counts": eval_counts,
    "confusion": confusion_counts,
    "metrics": metrics,
    "all_rates": all_rates,
    "epoch_metrics": epoch_metrics,
    "early_stop": early_stop,
    "final_epoch": final_epoch,
    "eval_schedule": eval_schedule,
    "elapsed": elapsed,
    "latency_summary": latency_summary,
    "latency_running": latency_running,
    "latency_percentiles": latency_percentiles,
    "latency_running_percentiles": latency_running_percentiles,
    "temporal_bias": temporal_bias,
    "transfer_matrix": transfer_matrix,
    "drift_mix": drift_mix,
    "drift_two_tables": drift_two_tables,
    "drift_report": drift_report,
    "experiment_grid": experiment_grid,
}

_SCORED = (
    EVENT_SCALED
    + f", w AS (SELECT *, {trailing_avg('scaled')} AS p FROM s)"
    + f", g AS (SELECT y, p, p > 0.5 AND NOT isnan(p) AS pred FROM w WHERE NOT is_train AND row_idx >= {WINDOW - 1})"
)
_RESULT = f"P, N, pred_P, pred_N, TP, FP, TN, FN, {BAL_ACC} AS bal_acc, {F1} AS f1"
_CELLS = "TP, FP, TN, FN"
_LOG = (
    EVENT_ROWS
    + f", g AS (SELECT row_idx, row_idx // {STEPS_PER_EPOCH} AS epoch, row_idx % {STEPS_PER_EPOCH} AS step, "
    "value AS loss, sqrt(value) / 1000.0::DOUBLE AS seconds FROM o)"
)

# Cells of a sketch in SQL; timings are never negative.
_WIDTH, _SHIFT = quantiles.cell_width(quantiles.ACCURACY), quantiles.cell_shift(quantiles.ACCURACY)
_CELL = (
    f"CASE WHEN seconds = 0 THEN 0 ELSE CAST(ceil(ln(seconds) / CAST({_WIDTH!r} AS DOUBLE)) AS BIGINT) + {_SHIFT} END"
)


def _percentile_sql(key: str) -> str:
    """Percentiles per key from a CTE r (key, cell, upto, total) of cells with counts so far."""
    picked = ", ".join(
        f"min(CASE WHEN upto > CAST({q} AS DOUBLE) * (total - 1) THEN cell END) AS {name}" for name, q in SHARES.items()
    )
    middle = f"CAST(2 AS DOUBLE) / (exp(CAST({_WIDTH!r} AS DOUBLE)) + 1)"
    values = ", ".join(
        rd(f"CASE WHEN {name} = 0 THEN 0.0::DOUBLE ELSE exp(({name} - {_SHIFT}) * CAST({_WIDTH!r} AS DOUBLE)) * {middle} END")
        + f" AS {name}"
        for name in SHARES
    )
    return f"SELECT {key}, {values} FROM (SELECT {key}, {picked} FROM r GROUP BY {key})"


def _verdict_sql(patience: int) -> str:
    return (
        _LOG
        + ", e AS (SELECT epoch, min(loss) AS min_loss FROM g GROUP BY epoch)"
        + ", b AS (SELECT *, min_loss < least(100.0::DOUBLE, coalesce(min(min_loss) OVER (ORDER BY epoch ROWS BETWEEN "
        + "UNBOUNDED PRECEDING AND 1 PRECEDING), 100.0)) AS improved FROM e)"
        + ", v0 AS (SELECT *, epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch), -1) "
        + "AS counter FROM b)"
        + f", v AS (SELECT *, {patience} > 0 AND counter > {patience} AS stop FROM v0)"
    )


_FRACTIONS = ", ".join(f"({f}::DOUBLE)" for f in TEMPORAL_FRACTIONS)
_DRIFT = (
    EVENT_LABELS
    + ", r AS (SELECT *, user_id % 2 = 1 AS from_second, "
    "row_number() OVER (PARTITION BY user_id % 2 = 1 ORDER BY row_idx) - 1 AS rank FROM c)"
    + ", l AS (SELECT min(k) AS m FROM (SELECT count(*) AS k FROM r GROUP BY from_second))"
    + ", x AS (SELECT r.*, m FROM r CROSS JOIN l WHERE rank < m AND from_second = "
    + f"(CAST({h60(f'{SEED!s}' + ' || chr(58) || rank')} AS DOUBLE) / CAST(1152921504606846976 AS DOUBLE) "
    + "< CAST(rank AS DOUBLE) / CAST(m AS DOUBLE)))"
)

ORACLE = {
    "eval_counts": f"WITH {EVENT_LABELS} SELECT count(*) FILTER (WHERE y) AS P, count(*) FILTER (WHERE NOT y) AS N "
    "FROM c WHERE NOT is_train",
    "confusion": f"WITH {_SCORED} SELECT {CONFUSION} FROM g",
    "metrics": f"WITH {_SCORED}, k AS (SELECT {CONFUSION} FROM g) SELECT {_RESULT} FROM k",
    "all_rates": f"WITH {_SCORED}, k AS (SELECT {CONFUSION} FROM g) SELECT "
    + ", ".join(
        f"{rd(f'CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE 0 END')} AS {name}"
        for name, n, d in [
            ("sensitivity", "TP", "TP + FN"),
            ("specificity", "TN", "TN + FP"),
            ("precision", "TP", "TP + FP"),
            ("recall", "TP", "TP + FN"),
        ]
    )
    + " FROM k",
    "epoch_metrics": f"WITH {_SCORED}, t(epoch, threshold) AS (VALUES "
    + ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(THRESHOLDS))
    + "), h AS (SELECT epoch, y, p > threshold AS pred FROM g CROSS JOIN t), "
    f"k AS (SELECT epoch, {CONFUSION} FROM h GROUP BY epoch) SELECT epoch, {_RESULT} FROM k",
    "early_stop": f"WITH {_verdict_sql(PATIENCE)} SELECT epoch, min_loss, improved, counter, stop FROM v",
    "final_epoch": f"WITH {_verdict_sql(PATIENCE)} SELECT coalesce(min(CASE WHEN stop THEN epoch END), max(epoch)) "
    "AS final_epoch, bool_or(stop) AS stopped_early FROM v",
    "eval_schedule": f"WITH {_verdict_sql(0)} SELECT epoch FROM v WHERE epoch = 6 OR "
    "epoch = (SELECT max(epoch) FROM v)",
    "elapsed": f"WITH {_LOG}, t AS (SELECT *, CASE WHEN row_idx = 0 THEN 0 WHEN row_idx = 1 THEN 2 * seconds "
    f"ELSE seconds END AS counted FROM g) SELECT epoch, step, {rd('sum(counted) OVER (ORDER BY row_idx)')} "
    "AS elapsed FROM t",
    "latency_summary": f"WITH {_LOG} SELECT count(*) AS timings, {rd('avg(seconds)')} AS mean_s, "
    f"{rd('min(seconds)')} AS min_s, {rd('max(seconds)')} AS max_s FROM g",
    "latency_running": f"WITH {_LOG}, t AS (SELECT row_idx // {REPEATS} AS step, sum(seconds) AS total, count(*) AS k "
    f"FROM g GROUP BY 1) SELECT step, {rd('total / k')} AS mean_s, "
    f"{rd('sum(total) OVER (ORDER BY step) / sum(k) OVER (ORDER BY step)')} AS running_mean_s FROM t",
    "latency_percentiles": f"WITH {_LOG}, k AS (SELECT epoch, {_CELL} AS cell, count(*) AS n FROM g "
    "WHERE seconds IS NOT NULL GROUP BY 1, 2), r AS (SELECT epoch, cell, sum(n) OVER (PARTITION BY epoch ORDER BY cell) "
    f"AS upto, sum(n) OVER (PARTITION BY epoch) AS total FROM k) {_percentile_sql('epoch')}",
    "latency_running_percentiles": f"WITH {_LOG}, k AS (SELECT row_idx // {REPEATS} AS step, {_CELL} AS cell, count(*) AS n "
    "FROM g WHERE seconds IS NOT NULL GROUP BY 1, 2), d AS (SELECT s.step, c.cell, coalesce(k.n, 0) AS n FROM "
    "(SELECT DISTINCT step FROM k) s CROSS JOIN (SELECT DISTINCT cell FROM k) c LEFT JOIN k ON k.step = s.step AND "
    "k.cell = c.cell), u AS (SELECT step, cell, sum(n) OVER (PARTITION BY cell ORDER BY step) AS n FROM d), "
    "r AS (SELECT step, cell, sum(n) OVER (PARTITION BY step ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY step) AS total "
    f"FROM u) {_percentile_sql('step')}",
    "temporal_bias": f"WITH {EVENT_LABELS}, fr(fraction) AS (VALUES {_FRACTIONS}), "
    "z AS (SELECT fraction, row_idx, n, y, v, CAST(floor(n * fraction) AS BIGINT) AS m FROM c CROSS JOIN fr), "
    "f AS (SELECT fraction, min(v) AS mn, max(v) - min(v) AS rg FROM z WHERE row_idx < m GROUP BY fraction), "
    f"s AS (SELECT z.*, {minmax('v', 'mn', 'rg')} AS scaled FROM z JOIN f USING (fraction)), "
    f"w AS (SELECT *, avg(scaled) OVER (PARTITION BY fraction ORDER BY row_idx ROWS BETWEEN {WINDOW - 1} PRECEDING "
    "AND CURRENT ROW) AS p FROM s), g AS (SELECT fraction, n - 2 * m AS gap, y, p > 0.5 AS pred FROM w "
    f"WHERE row_idx >= n - m), k AS (SELECT fraction, gap, {CONFUSION} FROM g GROUP BY fraction, gap) "
    f"SELECT fraction, gap, {_RESULT} FROM k",
    "transfer_matrix": f"WITH {LINE_ROWS}, c AS (SELECT row_idx, l_linestatus AS eval_on, "
    f"l_returnflag IS DISTINCT FROM 'N' AS y, {clean('l_quantity')} AS v FROM o), "
    "f AS (SELECT eval_on AS fit_on, min(v) AS mn, max(v) - min(v) AS rg FROM c GROUP BY 1), "
    f"s AS (SELECT fit_on, row_idx, eval_on, y, {minmax('v', 'mn', 'rg')} AS scaled FROM c CROSS JOIN f), "
    f"w AS (SELECT *, avg(scaled) OVER (PARTITION BY fit_on ORDER BY row_idx ROWS BETWEEN {WINDOW - 1} PRECEDING "
    f"AND CURRENT ROW) AS p FROM s), g AS (SELECT fit_on, eval_on, y, p > 0.8 AS pred FROM w "
    f"WHERE row_idx >= {WINDOW - 1}), k AS (SELECT fit_on, eval_on, {CONFUSION} FROM g GROUP BY fit_on, eval_on), "
    "q AS (SELECT *, CASE WHEN TP > 0 THEN CAST(2 * TP AS DOUBLE) / (2 * TP + FP + FN) ELSE 0 END AS f FROM k) "
    f"SELECT a.fit_on, a.eval_on, a.P, a.N, a.pred_P, a.pred_N, a.TP, a.FP, a.TN, a.FN, "
    f"{BAL_ACC.replace('TP', 'a.TP').replace('FN', 'a.FN').replace('TN', 'a.TN').replace('FP', 'a.FP')} AS bal_acc, "
    f"{rd('a.f')} AS f1, {rd('a.f - b.f')} AS f1_change "
    "FROM q a JOIN q b ON a.fit_on = b.fit_on AND b.fit_on = b.eval_on",
    "drift_mix": f"WITH {_DRIFT} SELECT rank AS row_idx, event_id, user_id, from_second FROM x",
    "drift_two_tables": "WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_totalprice AS value, false AS "
    "from_second FROM orders), b AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx, value, true AS from_second "
    "FROM events), n AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS n), "
    "t AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT row_idx, value, from_second FROM t, n WHERE row_idx < n "
    f"AND from_second = (CAST({h60(f'{SEED!s}' + ' || chr(58) || row_idx')} AS DOUBLE) / {HASH_RANGE}.0::DOUBLE < row_idx / CAST(n AS DOUBLE))",
    "drift_report": f"WITH {_DRIFT}, f AS (SELECT min(v) AS mn, max(v) - min(v) AS rg FROM c WHERE user_id % 2 <> 1), "
    f"s AS (SELECT x.*, {minmax('v', 'mn', 'rg')} AS scaled FROM x CROSS JOIN f), "
    f"w AS (SELECT *, {trailing_avg('scaled', 'rank')} AS p FROM s), "
    "g AS (SELECT rank * 10 // m AS tenth, y, from_second, p > 0.5 AS pred FROM w "
    f"WHERE rank >= {WINDOW - 1}), k AS (SELECT tenth, count(*) FILTER (WHERE from_second) AS second_rows, "
    f"{CONFUSION} FROM g GROUP BY tenth) SELECT tenth, second_rows, P, N, {_CELLS}, {BAL_ACC} AS bal_acc, "
    f"{F1} AS f1 FROM k",
    "experiment_grid": f"WITH {EVENT_ENCODED}, u AS (SELECT row_idx, is_train, y, scaled, "
    f"code / {LEVELS}.0::DOUBLE AS usr FROM e), w AS (SELECT *, {trailing_avg('scaled')} AS ms, "
    f"{trailing_avg('usr')} AS mu FROM u), "
    "r AS (SELECT y, 'value' AS encoding, 'average' AS head, ms AS p FROM w WHERE NOT is_train UNION ALL "
    "SELECT y, 'value', 'last', scaled FROM w WHERE NOT is_train UNION ALL "
    "SELECT y, 'user', 'average', mu FROM w WHERE NOT is_train UNION ALL "
    "SELECT y, 'user', 'last', usr FROM w WHERE NOT is_train), "
    "t(threshold) AS (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in GRID_THRESHOLDS) + "), "
    "g AS (SELECT encoding, head, threshold, y, p > threshold AS pred FROM r CROSS JOIN t), "
    f"z AS (SELECT encoding, head, threshold, {CONFUSION} FROM g GROUP BY ALL) "
    f"SELECT encoding, head, threshold, P, N, {_CELLS}, {BAL_ACC} AS bal_acc, {F1} AS f1 FROM z",
}
