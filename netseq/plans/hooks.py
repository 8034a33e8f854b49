"""Queries that run user-written components through the hooks: preprocessing, encoding, head, draw modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netseq.operators import batching, runlog
from netseq.operators.assemble import preprocess
from netseq.operators.categorical import encode
from netseq.operators.encode import VECTOR, ConcatEncoding, EncodingChain, InputEncoding
from netseq.operators.masks import LABEL, training_candidates
from netseq.operators.order import ROW, Ranked
from netseq.operators.pool import AverageHead, Head
from netseq.operators.preprocessing import Preprocessing
from netseq.operators.split import TRAIN, split_last, training_rows
from netseq.plans import common, evaluation, sequences
from netseq.plans.common import EVENTS, FRACTION, SEED, WINDOW, rd, rounded
from netseq.spec import CategoricalFormat, ModelInput, quoted

LOWEST = 5


class ShareOfLargest(Preprocessing):
    """Numbers divided by the largest training value; the first few levels in native order, else code 0."""

    name = "Share of largest"

    def numeric_statistics(self, column: str) -> dict[str, Column]:
        return {"largest": F.max(quoted(column))}

    def numeric_value(self, column: str, statistics: dict[str, float]) -> Column:
        return F.col(quoted(column)) / F.lit(statistics["largest"])

    def fit_levels(self, df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
        known = df.filter(TRAIN)
        return {
            c: [r[0] for r in known.filter(F.col(quoted(c)).isNotNull()).select(quoted(c)).distinct().orderBy(quoted(c)).take(LOWEST)]
            for c in columns
        }

    def codes(self, df: DataFrame, levels: dict[str, list]) -> DataFrame:
        return encode(df, levels, 0)


class Halved(InputEncoding):
    """First step of a chain: halves the numbers."""

    name = "Halved"

    def width(self, model_input: ModelInput) -> int:
        return model_input.width

    def apply(self, df: DataFrame, model_input: ModelInput) -> DataFrame:
        return df.withColumns({c: F.col(quoted(c)) / 2 for c in model_input.numeric_features})


class LargestHead(Head):
    """Largest number of each vector position over time."""

    name = "Largest"

    def output_width(self, steps: int, width: int) -> int:
        return width

    def column(self, window: Column, steps: int, width: int) -> Column:
        def series(j: int) -> Column:
            return F.transform(window, lambda v: v[j])

        return F.array(*[F.array_max(series(j)) for j in range(width)])

    def array(self, windows):
        return windows.max(axis=1)


def custom_preprocessing(spark: SparkSession, folder: str) -> DataFrame:
    indexed = common.events(spark, folder)
    done = preprocess(
        split_last(indexed, FRACTION), EVENTS, ShareOfLargest(), CategoricalFormat.INTEGERS,
        training=training_rows(indexed, FRACTION),
    )
    return rounded(done.df.select(ROW, "value", F.col("user_id").alias("code")), "value")


def encoding_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Two steps under one name; the first decides the format, the last the vector."""
    indexed = common.events(spark, folder)
    done = common.preprocessed(indexed, EVENTS)
    out = EncodingChain((Halved(), ConcatEncoding())).apply(done.df, done.model_input)
    return rounded(out.select(ROW, F.posexplode(VECTOR).alias("dim", "v")), "v")


def custom_head(spark: SparkSession, folder: str) -> DataFrame:
    return sequences._pooled(spark, folder, LargestHead())


def sequential_context(spark: SparkSession, folder: str) -> DataFrame:
    """Targets walk through each class, their context is drawn at random."""
    df, n = common.labelled_events(spark, folder)
    ranked = Ranked(training_candidates(df, n, WINDOW), n, LABEL)
    size, steps = sequences.BATCH, sequences.CONTEXT_STEPS
    chosen = batching.batches(ranked, size, steps, SEED, sequential=True)
    windows = batching.random_context(chosen, df, n, size, steps, WINDOW, SEED, ["value"])
    return windows.select("step", "batch_pos", "pos", LABEL, ROW, "value")


def pooled_batches(spark: SparkSession, folder: str) -> DataFrame:
    """What the output layers are trained on: windows of balanced batches, pooled by a head."""
    df, n = sequences._encoded(spark, folder)
    ranked = Ranked(training_candidates(df, n, WINDOW), n, LABEL)
    size, steps = sequences.BATCH, sequences.CONTEXT_STEPS
    chosen = batching.random_batches(ranked, size, steps, SEED)
    windows = batching.batch_windows(chosen, df, WINDOW, [VECTOR], size * steps)
    pooled = AverageHead().column(F.col("win")[VECTOR], WINDOW, sequences.WIDTH)
    return rounded(windows.select("step", "batch_pos", LABEL, F.posexplode(pooled).alias("dim", "v")), "v")


def eval_schedule_stop(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluated epochs of a run that ends where patience runs out."""
    log = evaluation.run_log(spark, folder)
    epochs = evaluation._epochs(log.n_rows)
    return runlog.eval_schedule(runlog.epoch_verdicts(log.df, epochs, evaluation.PATIENCE), epochs - 1)


QUERIES = {
    "custom_preprocessing": custom_preprocessing,
    "encoding_chain": encoding_chain,
    "custom_head": custom_head,
    "sequential_context": sequential_context,
    "pooled_batches": pooled_batches,
    "eval_schedule_stop": eval_schedule_stop,
}

_BATCH_VECTORS = (
    f"WITH {sequences._EVAL_VECTORS}{sequences._batch_sql(sequences.CONTEXT_STEPS).removeprefix(common.EVENT_LABELS)}, "
    f"w AS (SELECT step, batch_pos, b.y, avg(x0) AS m0, avg(x1) AS m1 FROM b CROSS JOIN range({WINDOW}) t(pos) "
    f"JOIN x ON x.row_idx = b.row_idx - {WINDOW - 1} + t.pos GROUP BY ALL)"
)

ORACLE = {
    "custom_preprocessing": f"WITH {common.EVENT_LABELS}, f AS (SELECT max(v) AS largest FROM c WHERE is_train), "
    "k AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS code FROM (SELECT DISTINCT user_id FROM c WHERE is_train "
    f"AND user_id IS NOT NULL) QUALIFY code <= {LOWEST}) SELECT row_idx, {rd('v / largest')} AS value, "
    "CAST(coalesce(k.code, 0) AS INTEGER) AS code FROM c CROSS JOIN f LEFT JOIN k USING (user_id)",
    "encoding_chain": f"WITH {common.EVENT_ENCODED} SELECT row_idx, 0 AS dim, {rd('scaled / 2')} AS v FROM e "
    f"UNION ALL SELECT row_idx, 1, {rd('CAST(code AS DOUBLE)')} FROM e",
    "custom_head": f"WITH {sequences._EVAL_STEPS} SELECT end_idx, 0 AS dim, {rd('max(x0)')} AS v FROM w GROUP BY end_idx "
    f"UNION ALL SELECT end_idx, 1, {rd('max(x1)')} FROM w GROUP BY end_idx",
    "sequential_context": sequences.context_sql(sequences._SEQUENTIAL_CONTEXT),
    "pooled_batches": f"{_BATCH_VECTORS} SELECT step, batch_pos, y, 0 AS dim, {rd('m0')} AS v FROM w "
    f"UNION ALL SELECT step, batch_pos, y, 1, {rd('m1')} FROM w",
    "eval_schedule_stop": f"WITH {evaluation._verdict_sql(evaluation.PATIENCE)}, f AS (SELECT min(epoch) FILTER (WHERE stop) AS first FROM v) "
    "SELECT epoch FROM v CROSS JOIN f WHERE (first IS NULL OR epoch <= first) AND "
    "(epoch = 6 OR stop OR epoch = (SELECT max(epoch) FROM v))",
}
