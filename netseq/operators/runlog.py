"""Run logs: early stopping, evaluation schedule, elapsed time, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netseq.operators.order import running

# The loss every run starts from, and the one epoch that is always evaluated.
START_LOSS = 100.0
FIXED_EVAL_EPOCH = 6


def epoch_verdicts(log: DataFrame, n_epochs: int, patience: int) -> DataFrame:
    """(epoch, min_loss, improved, counter, stop) for each epoch of a log (epoch, step, loss).

    An epoch improves if any of its steps goes below the lowest loss before it. ``counter`` is the
    number of epochs since the last improvement. The running minimum is computed in two levels, so a
    log of any length is not gathered in one task.
    """
    # a missing or NaN loss improves on nothing, so it is left out of the minimum
    usable = F.when(~F.isnan("loss"), F.col("loss"))
    epochs = log.groupBy(F.col("epoch").cast("bigint").alias("epoch")).agg(
        F.coalesce(F.min(usable), F.lit(float("inf"))).alias("min_loss")
    )
    # the smallest (loss, epoch) pair so far is the last improvement: equal losses keep the earlier epoch
    pair = F.struct("min_loss", "epoch")
    marked = running(epochs, n_epochs, {"lowest": ("min", pair)}, position="epoch")
    gain = F.when(F.col("lowest.min_loss") < F.lit(START_LOSS), F.col("lowest.epoch")).otherwise(F.lit(-1))
    counter = F.col("epoch") - gain
    return marked.select(
        "epoch",
        "min_loss",
        (gain == F.col("epoch")).alias("improved"),
        counter.alias("counter"),
        (F.lit(patience > 0) & (counter > patience)).alias("stop"),
    )


def final_epoch(verdicts: DataFrame) -> DataFrame:
    """One row: the first epoch that stops the run, else the last epoch."""
    return verdicts.agg(
        F.coalesce(F.min(F.when(F.col("stop"), F.col("epoch"))), F.max("epoch")).alias("final_epoch"),
        F.coalesce(F.max("stop"), F.lit(False)).alias("stopped_early"),
    )


def eval_schedule(verdicts: DataFrame, last_epoch: int) -> DataFrame:
    """Epochs at which the model is evaluated: the fixed one, the last planned one, and the stop."""
    final = final_epoch(verdicts).first()["final_epoch"]
    return verdicts.filter((F.col("epoch") <= F.lit(final)) & _is_evaluated(last_epoch)).select("epoch")


def elapsed(log: DataFrame, n_rows: int, position: str, seconds: str = "seconds") -> DataFrame:
    """Add ``elapsed``: seconds trained so far.

    The first step of a run is not timed; from the second step on the second step's time stands in
    for it. A run whose first epoch has one step never gets that correction.
    """
    first = (F.col("epoch") == 0) & (F.col("step") == 0)
    second = (F.col("epoch") == 0) & (F.col("step") == 1)
    counted = (
        F.when(first, F.lit(0.0)).when(second, F.lit(2.0) * F.col(seconds)).otherwise(F.col(seconds))
    )
    return running(log, n_rows, {"elapsed": ("sum", counted)}, position=position)


def latency_by_step(timings: DataFrame, n_steps: int) -> DataFrame:
    """(step, mean_s, running_mean_s) from (step, repeat, seconds)."""
    steps = timings.groupBy(F.col("step").cast("bigint").alias("step")).agg(
        F.avg("seconds").alias("mean_s"), F.sum("seconds").alias("total"), F.count("seconds").alias("n")
    )
    so_far = running(
        steps,
        n_steps,
        {"total_so_far": ("sum", F.col("total")), "n_so_far": ("sum", F.col("n"))},
        position="step",
    )
    return so_far.select(
        "step", "mean_s", (F.col("total_so_far") / F.col("n_so_far")).alias("running_mean_s")
    )


def latency_summary(timings: DataFrame) -> DataFrame:
    """One row: number of timings, mean, minimum, maximum."""
    return timings.agg(
        F.count("seconds").alias("timings"),
        F.avg("seconds").alias("mean_s"),
        F.min("seconds").alias("min_s"),
        F.max("seconds").alias("max_s"),
    )


def save_log(log: DataFrame, run: str, path: str) -> None:
    """Append a run's log to a table of logs, one partition per run."""
    log.withColumn("run", F.lit(run)).write.partitionBy("run").mode("append").parquet(path)


def _is_evaluated(last_epoch: int) -> Column:
    return F.col("epoch").isin(FIXED_EVAL_EPOCH, last_epoch) | F.col("stop")
