"""Queries on windows, batches, pooling heads, scoring and training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netseq.functions.scalars import sigmoid
from netseq.functions.vectors import dot
from netseq.operators import batching
from netseq.operators.encode import VECTOR, ConcatEncoding
from netseq.operators.masks import LABEL, add_label, training_candidates
from netseq.operators.metrics import evaluate
from netseq.operators.order import ROW, Ranked
from netseq.operators.pool import AverageHead, ClsHead, FeaturewiseHead, FlattenHead, Head, LastHead
from netseq.operators.preprocessing import StandardPreprocessing
from netseq.operators.score import BasicTransformer, Scorer, SequenceModel, patterned_weights, score_flows
from netseq.operators.split import TRAIN, first_eval_row
from netseq.operators.windows import featurewise, long_form, ordered_windows, trailing_mean
from netseq.plans.common import (
    EVENT_ENCODED,
    EVENT_LABELS,
    EVENT_SCALED,
    EVENTS,
    FRACTION,
    ORDER_ENCODED,
    ORDERS,
    SEED,
    WINDOW,
    events,
    h60,
    labelled_events,
    orders,
    preprocessed,
    r6,
    rd,
    rounded,
    scaled_events,
    trailing_avg,
    window_join,
)
from netseq.plans.features import PRIORITIES, weight, weight_sql
from netseq.session import staging_path
from netseq.sources.readers import read_table
from netseq.spec import CategoricalFormat, StudyParams
from netseq.study import FlowStudy

BATCH = 32
STEPS = 50
CONTEXT_STEPS = 10
WIDTH = 2  # scaled value and user code


def windows_ordered(spark: SparkSession, folder: str) -> DataFrame:
    df, n, _ = scaled_events(spark, folder)
    windows = ordered_windows(df, WINDOW, n, ["scaled"])
    return rounded(long_form(windows, ["scaled"]), "scaled")


def featurewise_orders(spark: SparkSession, folder: str) -> DataFrame:
    indexed = orders(spark, folder)
    done = preprocessed(indexed, ORDERS, CategoricalFormat.ONE_HOT)
    windows = ordered_windows(done.df, WINDOW, indexed.n_rows, done.model_input.columns)
    arrays = featurewise(windows, done.model_input)
    zipped = arrays.select(
        F.col(ROW).alias("end_idx"), F.posexplode(F.arrays_zip("o_totalprice", "o_orderpriority")).alias("pos", "f")
    )
    return zipped.select(
        "end_idx",
        "pos",
        r6(F.col("f.o_totalprice")).alias("price"),
        *[F.element_at("f.o_orderpriority", j).alias(f"level_{j}") for j in range(1, PRIORITIES + 1)],
    )


def _candidates(spark: SparkSession, folder: str):
    df, n = labelled_events(spark, folder)
    return df, n, Ranked(training_candidates(df, n, WINDOW), n, LABEL)


def batch_random(spark: SparkSession, folder: str) -> DataFrame:
    return batching.random_batches(_candidates(spark, folder)[2], BATCH, STEPS, SEED)


def batch_sequential(spark: SparkSession, folder: str) -> DataFrame:
    return batching.sequential_batches(_candidates(spark, folder)[2], BATCH, STEPS)


def batch_windows(spark: SparkSession, folder: str) -> DataFrame:
    df, n, ranked = _candidates(spark, folder)
    chosen = batching.sequential_batches(ranked, BATCH, STEPS)
    windows = batching.batch_windows(chosen, df, WINDOW, ["value"], BATCH * STEPS)
    return long_form(windows, ["value"], ["step", "batch_pos", LABEL])


def windows_random_ctx(spark: SparkSession, folder: str) -> DataFrame:
    df, n, ranked = _candidates(spark, folder)
    chosen = batching.random_batches(ranked, BATCH, CONTEXT_STEPS, SEED)
    windows = batching.random_context(chosen, df, n, BATCH, CONTEXT_STEPS, WINDOW, SEED, ["value"])
    return windows.select("step", "batch_pos", "pos", LABEL, ROW, "value")


def _encoded(spark: SparkSession, folder: str):
    """Flows with the vector (scaled value, code scaled to at most 1), and their number."""
    indexed = events(spark, folder)
    done = preprocessed(indexed, EVENTS)
    df = ConcatEncoding().apply(done.df, done.model_input)
    df = add_label(df, "y_raw", EVENTS.benign_label).withColumn(
        VECTOR, F.transform(VECTOR, lambda v, i: F.when(i == 1, v / F.lit(32.0)).otherwise(v))
    )
    return df.select(ROW, TRAIN, LABEL, VECTOR), indexed.n_rows


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation windows of those vectors."""
    df, n = _encoded(spark, folder)
    windows = ordered_windows(
        df, WINDOW, n, [VECTOR], keep=[LABEL], ends=~F.col(TRAIN), first_end=first_eval_row(n, FRACTION)
    )
    return windows.withColumn("win", F.col("win")[VECTOR])


def _pooled(spark: SparkSession, folder: str, head: Head) -> DataFrame:
    windows = _vectors(spark, folder)
    before = head.before_column(F.col("win"), WINDOW, WIDTH)
    vector = head.column(before, *head.model_shape(WINDOW, WIDTH))
    out = windows.select(F.col(ROW).alias("end_idx"), F.posexplode(vector).alias("dim", "v"))
    return rounded(out, "v")


def pool_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return _pooled(spark, folder, FlattenHead())


def pool_featurewise(spark: SparkSession, folder: str) -> DataFrame:
    return _pooled(spark, folder, FeaturewiseHead([weight(0, 0), weight(1, 0)], 0.05))


def pool_featurewise_projection(spark: SparkSession, folder: str) -> DataFrame:
    return _pooled(spark, folder, FeaturewiseHead([weight(0, 0), weight(1, 0)], 0.05, project=True))


def pool_avg(spark: SparkSession, folder: str) -> DataFrame:
    return _pooled(spark, folder, AverageHead())


def pool_avg_all(spark: SparkSession, folder: str) -> DataFrame:
    df, n, _ = scaled_events(spark, folder)
    means = trailing_mean(df, WINDOW, n, {"mean": "scaled"})
    return rounded(means.select(F.col(ROW).alias("end_idx"), "mean"), "mean")


def pool_last(spark: SparkSession, folder: str) -> DataFrame:
    """The last flow of a window is the flow that ends it, so the rows themselves do."""
    df, _ = _encoded(spark, folder)
    ends = df.filter(~F.col(TRAIN) & (F.col(ROW) >= WINDOW - 1))
    out = ends.select(F.col(ROW).alias("end_idx"), F.posexplode(VECTOR).alias("dim", "v"))
    return rounded(out, "v")


def pool_cls(spark: SparkSession, folder: str) -> DataFrame:
    """The extended windows themselves: the appended step is the last position."""
    before = ClsHead().before_column(F.col("win"), WINDOW, WIDTH)
    steps = _vectors(spark, folder).select(
        F.col(ROW).alias("end_idx"), F.posexplode(before).alias("pos", "step_vector")
    )
    out = steps.select("end_idx", "pos", F.posexplode("step_vector").alias("dim", "v"))
    return rounded(out, "v")


def score_linear(spark: SparkSession, folder: str) -> DataFrame:
    """Flattened window, one sigmoid unit."""
    windows = _vectors(spark, folder)
    weights = [weight(i, 0) for i in range(WINDOW * WIDTH)]
    p = sigmoid(dot(F.flatten("win"), weights, 0.25))
    return windows.select(F.col(ROW).alias("end_idx"), LABEL, r6(p).alias("p"))


def _scored(df: DataFrame, n: int, width: int, scorer: Scorer) -> DataFrame:
    out = score_flows(
        df,
        scorer.probabilities,
        WINDOW,
        n,
        width,
        [LABEL],
        ends=~F.col(TRAIN),
        first_end=first_eval_row(n, FRACTION),
    )
    return rounded(out.withColumnRenamed(ROW, "end_idx"), "p")


def _attention(spark: SparkSession, folder: str, model: BasicTransformer, head: Head) -> DataFrame:
    """Orders as one-hot vectors under an attention model with patterned weights."""
    indexed = orders(spark, folder)
    done = preprocessed(indexed, ORDERS, CategoricalFormat.ONE_HOT)
    df = add_label(ConcatEncoding().apply(done.df, done.model_input), "y_raw", ORDERS.benign_label)
    width = done.model_input.width
    scorer = Scorer(model, head, (128,))
    weights = patterned_weights(scorer.weight_shapes(WINDOW, width), scale=0.5)
    return _scored(df, indexed.n_rows, width, scorer.with_weights(weights))


def score_mlp(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over time, one hidden layer of two units, one sigmoid unit."""
    scorer = Scorer(BasicTransformer(0, 2, 1), AverageHead(), (2,))
    weights = {
        "mlp_0_w": [[weight(i, j) for j in range(2)] for i in range(WIDTH)],
        "mlp_0_b": [0.1, 0.2],
        "mlp_1_w": [[weight(j, 2)] for j in range(2)],
        "mlp_1_b": [0.3],
    }
    df, n = _encoded(spark, folder)
    return _scored(df, n, WIDTH, scorer.with_weights({k: np.array(v) for k, v in weights.items()}))


def score_encoder(spark: SparkSession, folder: str) -> DataFrame:
    return _attention(spark, folder, BasicTransformer(2, 128, 2), LastHead())


def score_decoder(spark: SparkSession, folder: str) -> DataFrame:
    return _attention(spark, folder, BasicTransformer(2, 128, 2, is_decoder=True), ClsHead())


SMALL_ENCODER = Scorer(BasicTransformer(1, WIDTH, 1), LastHead())
SMALL_DECODER = Scorer(BasicTransformer(1, WIDTH, 1, is_decoder=True), LastHead())


def _small_weights(scorer: Scorer) -> dict[str, np.ndarray]:
    return patterned_weights(scorer.weight_shapes(WINDOW, WIDTH), scale=2.0)


def score_encoder_small(spark: SparkSession, folder: str) -> DataFrame:
    """One attention block with one head over windows of events, small enough for SQL to follow."""
    df, n = _encoded(spark, folder)
    return _scored(df, n, WIDTH, SMALL_ENCODER.with_weights(_small_weights(SMALL_ENCODER)))


def score_decoder_small(spark: SparkSession, folder: str) -> DataFrame:
    df, n = _encoded(spark, folder)
    return _scored(df, n, WIDTH, SMALL_DECODER.with_weights(_small_weights(SMALL_DECODER)))


def _study(spark: SparkSession, folder: str, head: Head, model: SequenceModel | None = None) -> FlowStudy:
    study = FlowStudy(
        spark,
        StandardPreprocessing(),
        ConcatEncoding(),
        model or BasicTransformer(2, 128, 2),
        head,
        StudyParams(window_size=WINDOW, mlp_layer_sizes=(128,), seed=SEED),
    )
    kept = staging_path(spark, "study")
    study.load_dataset("orders", read_table(spark, folder, "orders"), ORDERS, cache_path=kept)
    return study


def train_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """A linear classifier on flattened windows of balanced batches, evaluated on the last orders."""
    study = _study(spark, folder, FlattenHead(), SequenceModel())
    _, outcome = study.fit(batch_size=128, steps_per_epoch=16, epochs=2, hidden=())
    return outcome.eval_results


def train_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Epoch-wise training of the output layers with early stopping: the evaluation rows."""
    study = _study(spark, folder, FlattenHead(), SequenceModel())
    _, outcome = study.fit(batch_size=128, steps_per_epoch=16, epochs=3, hidden=(8,))
    return outcome.eval_results


def study_score(spark: SparkSession, folder: str) -> DataFrame:
    """The attention model with untrained weights on the evaluation windows of orders."""
    study = _study(spark, folder, LastHead())
    scorer = study.build_model(patterned_weights(study.weight_shapes()))
    return study.evaluate(scorer)


def scoring_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds taken to score each training batch, four times over."""
    study = _study(spark, folder, LastHead())
    scorer = study.build_model(patterned_weights(study.weight_shapes()))
    return study.time(scorer, 128, n_steps=8, n_repeats=4)


QUERIES = {
    "windows_ordered": windows_ordered,
    "windows_random_ctx": windows_random_ctx,
    "featurewise": featurewise_orders,
    "batch_random": batch_random,
    "batch_sequential": batch_sequential,
    "batch_windows": batch_windows,
    "pool_flatten": pool_flatten,
    "pool_featurewise": pool_featurewise,
    "pool_featurewise_projection": pool_featurewise_projection,
    "pool_avg": pool_avg,
    "pool_avg_all": pool_avg_all,
    "pool_last": pool_last,
    "pool_cls": pool_cls,
    "score_linear": score_linear,
    "score_mlp": score_mlp,
    "score_encoder": score_encoder,
    "score_decoder": score_decoder,
    "score_encoder_small": score_encoder_small,
    "score_decoder_small": score_decoder_small,
    "train_classifier": train_classifier,
    "train_epochs": train_epochs,
    "study_score": study_score,
    "scoring_latency": scoring_latency,
}

MALICIOUS = BATCH // 2
BENIGN = BATCH - MALICIOUS
_RANKED = (
    EVENT_LABELS
    + ", q AS (SELECT row_idx, y, row_number() OVER (PARTITION BY y ORDER BY row_idx) - 1 AS rank FROM c "
    + f"WHERE is_train AND row_idx >= {WINDOW} AND row_idx < n - {WINDOW})"
    + ", l AS (SELECT y, count(*) AS pool FROM q GROUP BY y)"
)


def _draw_sql(name: str, tag: str, pool: str, n: int, steps: int) -> str:
    """``n`` different ranks per step: the first below the pool of a keyed permutation of the places."""
    most = batching.TRIES * n + batching.SPARE_TRIES
    sql = (
        f"{name}p AS (SELECT pool, greatest(1, (length(ltrim(bin(pool - 1), '0')) + 1) // 2) AS half FROM (SELECT ({pool}) AS pool)), "
        f"{name}x AS (SELECT step, j, pool, half, CAST(j AS BIGINT) >> half AS l, CAST(j AS BIGINT) & ((1::BIGINT << half) - 1) AS r "
        f"FROM {name}p CROSS JOIN range({steps}) a(step) CROSS JOIN range({most}) b(j) WHERE j < (1::BIGINT << 2 * half)), "
    )
    before = f"{name}x"
    for turn in range(batching.ROUNDS):
        key = h60(f"'{SEED}:{tag}:' || step || ':{turn}:' || r")
        sql += (
            f"{name}{turn} AS (SELECT step, j, pool, half, r AS l, xor(l, {key} % (1::BIGINT << half)) AS r FROM {before}), "
        )
        before = f"{name}{turn}"
    rank = "((l << half) | r)"
    turn = "row_number() OVER (PARTITION BY step ORDER BY j)"
    return sql + (
        f"{name} AS (SELECT step, {rank} AS rank, {turn} - 1 AS slot FROM {before} WHERE {rank} < pool QUALIFY {turn} <= {n})"
    )


def _batch_sql(steps: int) -> str:
    return (
        _RANKED
        + ", "
        + _draw_sql("dm", "malicious", "SELECT pool FROM l WHERE y", MALICIOUS, steps)
        + ", "
        + _draw_sql("db", "benign", "SELECT pool FROM l WHERE NOT y", BENIGN, steps)
        + ", b AS (SELECT step, slot AS batch_pos, y, row_idx FROM dm JOIN q ON q.y AND q.rank = dm.rank UNION ALL "
        + f"SELECT step, slot + {MALICIOUS}, y, row_idx FROM db JOIN q ON NOT q.y AND q.rank = db.rank)"
    )


def _sequential_sql(steps: int) -> str:
    return (
        _RANKED
        + f", z AS (SELECT step, y, pool, CASE WHEN y THEN {MALICIOUS} ELSE {BENIGN} END AS quota "
        + f"FROM l CROSS JOIN range({steps}) t(step))"
        + ", u AS (SELECT *, (step * quota) % (pool - quota) AS cursor FROM z)"
        + f", b AS (SELECT step, rank - cursor + CASE WHEN q.y THEN 0 ELSE {MALICIOUS} END AS batch_pos, q.y, row_idx "
        + "FROM u JOIN q ON q.y = u.y AND q.rank >= cursor AND q.rank < cursor + quota)"
    )


def context_sql(batches: str) -> str:
    """Windows whose last flow is a batch row and whose other flows are drawn training rows."""
    return (
        f"WITH {batches}, tr AS (SELECT row_idx, row_number() OVER (ORDER BY row_idx) - 1 AS rank FROM c WHERE is_train), "
        + _draw_sql("dc", "context", "SELECT count(*) FROM tr", BATCH * WINDOW, CONTEXT_STEPS)
        + f", p AS (SELECT dc.step, slot // {WINDOW} AS batch_pos, slot % {WINDOW} AS pos, tr.row_idx FROM dc "
        f"JOIN tr USING (rank) WHERE slot % {WINDOW} < {WINDOW - 1} UNION ALL "
        f"SELECT step, batch_pos, {WINDOW - 1}, row_idx FROM b) "
        "SELECT p.step, p.batch_pos, CAST(p.pos AS INTEGER) AS pos, b.y, p.row_idx, c.v AS value FROM p "
        "JOIN b ON b.step = p.step AND b.batch_pos = p.batch_pos JOIN c ON c.row_idx = p.row_idx"
    )


_SEQUENTIAL = _sequential_sql(STEPS)
_SEQUENTIAL_CONTEXT = _sequential_sql(CONTEXT_STEPS)
_EVAL_VECTORS = EVENT_ENCODED + ", x AS (SELECT row_idx, is_train, y, scaled AS x0, code / 32.0::DOUBLE AS x1 FROM e)"
_EVAL_STEPS = (
    _EVAL_VECTORS + ", w AS (" + window_join("x", "e.y, x.x0, x.x1", "NOT e.is_train") + ")"
)
_FEATUREWISE_DOT = f"x0 * {weight_sql('0', '0')} + x1 * {weight_sql('1', '0')}"
_HIDDEN = [
    f"greatest(0.0, m0 * {weight_sql('0', str(j))} + m1 * {weight_sql('1', str(j))} + {b}::DOUBLE)"
    for j, b in enumerate((0.1, 0.2))
]



def _linear(x: list[str], weight: np.ndarray, bias: np.ndarray) -> list[str]:
    """SQL of x @ weight + bias."""
    weight, bias = weight.reshape(len(x), -1), bias.ravel()
    return [
        "(" + " + ".join([f"{v} * {float(weight[i, j])!r}::DOUBLE" for i, v in enumerate(x)] + [f"{float(bias[j])!r}::DOUBLE"]) + ")"
        for j in range(weight.shape[1])
    ]


def _normed(x: list[str], w: dict[str, np.ndarray], number: int) -> list[str]:
    mean = f"(({' + '.join(x)}) / {len(x)})"
    spread = "(" + " + ".join(f"power({v} - {mean}, 2)" for v in x) + f") / {len(x)}"
    scale, shift = w[f"norm{number}_scale"], w[f"norm{number}_shift"]
    return [
        f"(({v} - {mean}) / sqrt({spread} + 1e-6::DOUBLE) * {float(a)!r}::DOUBLE + {float(b)!r}::DOUBLE)"
        for v, a, b in zip(x, scale, shift)
    ]


def _named(values: list[str], *names: str) -> str:
    return ", ".join(f"{v} AS {n}" for v, n in zip(values, names))


def _attention_ctes(name: str, asked: str, w: dict[str, np.ndarray]) -> str:
    """CTE ``name`` (end_idx, a0, a1): attention of the one step (z0, z1) in ``asked`` over its window."""
    step = ["x0", "x1"]
    key, value = (_linear(step, w[f"{p}_w"], w[f"{p}_b"]) for p in ("key", "value"))
    query = _linear(["z0", "z1"], w["query_w"], w["query_b"])
    out = _linear(["h0", "h1"], w["out_w"], w["out_b"])
    return (
        f"{name}k AS (SELECT end_idx, {_named(key, 'k0', 'k1')}, {_named(value, 'v0', 'v1')} FROM w), "
        f"{name}q AS (SELECT end_idx, {_named(query, 'q0', 'q1')} FROM {asked}), "
        f"{name}g AS (SELECT end_idx, v0, v1, (q0 * k0 + q1 * k1) / sqrt(2::DOUBLE) AS g FROM {name}k JOIN {name}q USING (end_idx)), "
        f"{name}e AS (SELECT end_idx, v0, v1, exp(g - max(g) OVER (PARTITION BY end_idx)) AS e FROM {name}g), "
        f"{name}h AS (SELECT end_idx, sum(e * v0) / sum(e) AS h0, sum(e * v1) / sum(e) AS h1 FROM {name}e GROUP BY end_idx), "
        f"{name} AS (SELECT end_idx, {_named(out, 'a0', 'a1')} FROM {name}h)"
    )


def _small_sql(scorer: Scorer) -> str:
    every = _small_weights(scorer)
    w = {n.removeprefix("block_0_"): v for n, v in every.items()}
    relu = lambda values: [f"greatest(0.0, {v})" for v in values]
    feed = lambda x: _linear(relu(_linear(x, w["inner_w"], w["inner_b"])), w["outer_w"], w["outer_b"])
    plus = lambda x, y: [f"({a} + {b})" for a, b in zip(x, y)]
    f, y = ["f0", "f1"], ["y0", "y1"]
    sql = f"WITH {_EVAL_STEPS}, zl AS (SELECT end_idx, y, x0 AS z0, x1 AS z1 FROM w WHERE pos = {WINDOW - 1}), "
    sql += _attention_ctes("za", "zl", w) + ", "
    first = _normed(plus(["z0", "z1"], ["a0", "a1"]), w, 1)
    if scorer.model.is_decoder:
        sql += f"zb AS (SELECT end_idx, y, {_named(first, 'z0', 'z1')} FROM zl JOIN za USING (end_idx)), "
        sql += _attention_ctes("zc", "zb", w)
        sql += f", zd AS (SELECT end_idx, y, {_named(_normed(plus(['z0', 'z1'], ['a0', 'a1']), w, 2), *y)} FROM zb JOIN zc USING (end_idx)), "
        sql += f"ze AS (SELECT *, {_named(feed(y), *f)} FROM zd), "
        sql += f"zo AS (SELECT end_idx, y, {_named(_normed(plus(y, f), w, 2), 'o0', 'o1')} FROM ze)"
    else:
        sql += f"zd AS (SELECT end_idx, y, a0 AS y0, a1 AS y1, {_named(first, 'n0', 'n1')} FROM zl JOIN za USING (end_idx)), "
        sql += f"ze AS (SELECT *, {_named(relu(feed(['n0', 'n1'])), *f)} FROM zd), "
        sql += f"zo AS (SELECT end_idx, y, {_named(_normed(plus(y, f), w, 2), 'o0', 'o1')} FROM ze)"
    logit = _linear(["o0", "o1"], every["mlp_0_w"], every["mlp_0_b"])[0]
    return f"{sql} SELECT end_idx, y, {rd(f'1 / (1 + exp(-{logit}))')} AS p FROM zo"


ORACLE = {
    "score_encoder_small": _small_sql(SMALL_ENCODER),
    "score_decoder_small": _small_sql(SMALL_DECODER),
    "windows_ordered": f"WITH {EVENT_SCALED} " + window_join("s", f"{rd('x.scaled')} AS scaled", "true"),
    "windows_random_ctx": context_sql(_batch_sql(CONTEXT_STEPS)),
    "featurewise": f"WITH {ORDER_ENCODED} "
    + window_join(
        "e",
        f"{rd('x.price')} AS price, "
        + ", ".join(f"CAST(x.code = {j} AS INTEGER) AS level_{j}" for j in range(1, PRIORITIES + 1)),
        "true",
    ),
    "batch_random": f"WITH {_batch_sql(STEPS)} SELECT step, batch_pos, y, row_idx FROM b",
    "batch_sequential": f"WITH {_SEQUENTIAL} SELECT step, batch_pos, y, row_idx FROM b",
    "batch_windows": f"WITH {_SEQUENTIAL} SELECT b.step, b.batch_pos, b.y, b.row_idx AS end_idx, "
    f"CAST(t.pos AS INTEGER) AS pos, c.v AS value FROM b CROSS JOIN range({WINDOW}) t(pos) "
    f"JOIN c ON c.row_idx = b.row_idx - {WINDOW - 1} + t.pos",
    "pool_flatten": f"WITH {_EVAL_STEPS} SELECT end_idx, CAST(pos * 2 AS INTEGER) AS dim, {rd('x0')} AS v FROM w "
    f"UNION ALL SELECT end_idx, CAST(pos * 2 + 1 AS INTEGER), {rd('x1')} FROM w",
    "pool_featurewise": f"WITH {_EVAL_STEPS} SELECT end_idx, pos AS dim, "
    f"{rd(_FEATUREWISE_DOT + ' + 0.05::DOUBLE')} AS v FROM w",
    "pool_featurewise_projection": f"WITH {_EVAL_STEPS} SELECT end_idx, pos AS dim, {rd(_FEATUREWISE_DOT)} AS v FROM w",
    "pool_avg": f"WITH {_EVAL_STEPS} SELECT end_idx, 0 AS dim, {rd('avg(x0)')} AS v FROM w GROUP BY end_idx "
    f"UNION ALL SELECT end_idx, 1, {rd('avg(x1)')} FROM w GROUP BY end_idx",
    "pool_avg_all": f"WITH {EVENT_SCALED}, w AS (SELECT row_idx AS end_idx, {trailing_avg('scaled')} AS mean FROM s) "
    f"SELECT end_idx, {rd('mean')} AS mean FROM w WHERE end_idx >= {WINDOW - 1}",
    "pool_last": f"WITH {_EVAL_VECTORS} SELECT row_idx AS end_idx, 0 AS dim, {rd('x0')} AS v FROM x WHERE NOT is_train "
    f"UNION ALL SELECT row_idx, 1, {rd('x1')} FROM x WHERE NOT is_train",
    "pool_cls": f"WITH {_EVAL_STEPS}, v AS (SELECT end_idx, pos, 0 AS dim, x0 AS v FROM w UNION ALL "
    "SELECT end_idx, pos, 1, x1 FROM w UNION ALL SELECT end_idx, pos, 2, 0.0 FROM w UNION ALL "
    f"SELECT row_idx, {WINDOW}, CAST(j AS INTEGER), CASE WHEN j = 2 THEN 1.0 ELSE 0.0 END FROM x "
    f"CROSS JOIN range(3) t(j) WHERE NOT is_train) SELECT end_idx, pos, dim, {rd('v')} AS v FROM v",
    "score_linear": f"WITH {_EVAL_STEPS}, d AS (SELECT end_idx, any_value(y) AS y, 0.25::DOUBLE + "
    f"sum(x0 * {weight_sql('pos * 2', '0')} + x1 * {weight_sql('pos * 2 + 1', '0')}) AS z FROM w GROUP BY end_idx) "
    f"SELECT end_idx, y, {rd('1 / (1 + exp(-z))')} AS p FROM d",
    "score_mlp": f"WITH {_EVAL_STEPS}, a AS (SELECT end_idx, any_value(y) AS y, avg(x0) AS m0, avg(x1) AS m1 FROM w "
    f"GROUP BY end_idx), d AS (SELECT end_idx, y, 0.3::DOUBLE + {_HIDDEN[0]} * {weight_sql('0', '2')} + "
    f"{_HIDDEN[1]} * {weight_sql('1', '2')} AS z FROM a) SELECT end_idx, y, {rd('1 / (1 + exp(-z))')} AS p FROM d",
}
