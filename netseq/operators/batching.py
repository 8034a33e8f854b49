"""Class-balanced training batches of window ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netseq.functions.hashing import hash60
from netseq.operators.masks import LABEL
from netseq.operators.order import ROW, Ranked
from netseq.operators.split import TRAIN
from netseq.operators.windows import windows_at
from netseq.session import small_side
from netseq.spec import quoted

# Places tried per wanted rank, and some more for short draws. At least a quarter of the places of a
# permutation lie below the pool, so four times the draws would do on average.
TRIES, SPARE_TRIES = 16, 128
ROUNDS = 4


def quotas(batch_size: int) -> dict[bool, int]:
    """Rows per class in a batch: half malicious, the rest benign."""
    malicious = int(0.5 * batch_size)
    return {True: malicious, False: batch_size - malicious}


def half_bits(pool: int) -> int:
    """Bits of each half of a place, so that all places number at least ``pool`` and below four times that."""
    return max(1, ((pool - 1).bit_length() + 1) // 2)


def n_tries(pool: int, n: int) -> int:
    return min(1 << 2 * half_bits(pool), TRIES * n + SPARE_TRIES)


def draws(spark: SparkSession, tag: str, pool: int, n: int, steps: int, seed: int) -> DataFrame:
    """(step, slot, rank): for each step ``n`` different ranks below ``pool``, steps independent.

    The ranks are the first ``n`` values below ``pool`` of a permutation of the places 0, 1, 2, ... that
    a hash keys by seed, tag and step (a Feistel network). Nothing is drawn twice, and the work follows the
    draws, not the pool; the rule is the same for all pools.
    """
    if pool < n:
        raise ValueError(f"cannot draw {n} different rows out of {pool} ({tag})")
    step = spark.range(steps).select(F.col("id").alias("step"))
    if n == 0:
        return step.select("step", F.lit(0).cast("bigint").alias("slot"), F.col("step").alias("rank")).limit(0)
    half = half_bits(pool)
    places = step.select("step", F.explode(_up_to(n_tries(pool, n))).alias("j"))
    left, right = F.shiftright("j", half), F.col("j").bitwiseAND(F.lit((1 << half) - 1))
    places = places.select("step", "j", left.alias("l"), right.alias("r"))
    for turn in range(ROUNDS):
        mixed = F.col("l").bitwiseXOR(hash60(seed, tag, F.col("step"), turn, F.col("r")) % F.lit(1 << half))
        places = places.select("step", "j", F.col("r").alias("l"), mixed.alias("r"))
    ranks = places.select("step", "j", F.shiftleft("l", half).bitwiseOR(F.col("r")).alias("rank")).filter(F.col("rank") < pool)
    turn = F.row_number().over(Window.partitionBy("step").orderBy("j"))
    slots = ranks.withColumn("turn", turn).filter(F.col("turn") <= n)
    return slots.select("step", (F.col("turn") - 1).cast("bigint").alias("slot"), "rank")


def random_batches(candidates: Ranked, batch_size: int, steps: int, seed: int) -> DataFrame:
    """(step, batch_pos, y, row_idx): random balanced batches, no repeats inside a step."""
    spark = candidates.rows.sparkSession
    parts = []
    for label, n in quotas(batch_size).items():
        tag = "malicious" if label else "benign"
        drawn = draws(spark, tag, candidates.sizes.get(label, 0), n, steps, seed)
        parts.append(drawn.withColumn(LABEL, F.lit(label)))
    return _at_ranks(candidates, parts[0].unionByName(parts[1]), batch_size, steps)


def sequential_batches(candidates: Ranked, batch_size: int, steps: int) -> DataFrame:
    """Balanced batches that walk through each class: step s starts at s*n mod (L - n)."""
    spark = candidates.rows.sparkSession
    parts = []
    for label, n in quotas(batch_size).items():
        pool = candidates.sizes.get(label, 0)
        if pool <= n:
            raise ValueError(f"sequential batches need more than {n} candidates of each class, got {pool}")
        cursor = (F.col("id") * n) % F.lit(pool - n)
        parts.append(
            spark.range(steps)
            .select(
                F.col("id").alias("step"),
                cursor.alias("cursor"),
                F.explode(_up_to(n)).alias("slot"),
            )
            .select("step", "slot", (F.col("cursor") + F.col("slot")).alias("rank"))
            .withColumn(LABEL, F.lit(label))
        )
    return _at_ranks(candidates, parts[0].unionByName(parts[1]), batch_size, steps)


def batches(
    candidates: Ranked, batch_size: int, steps: int, seed: int, sequential: bool = False
) -> DataFrame:
    """Batches in the chosen draw mode."""
    if sequential:
        return sequential_batches(candidates, batch_size, steps)
    return random_batches(candidates, batch_size, steps, seed)


def batch_windows(
    batch_rows: DataFrame, flows: DataFrame, window: int, columns: list[str], n_ends: int
) -> DataFrame:
    """Ordered windows of every batch row: (step, batch_pos, y, row_idx, win)."""
    return windows_at(batch_rows, flows, window, columns, ["step", "batch_pos", LABEL], n_ends)


def random_context(
    batch_rows: DataFrame,
    flows: DataFrame,
    n_rows: int,
    batch_size: int,
    steps: int,
    window: int,
    seed: int,
    columns: list[str],
) -> DataFrame:
    """(step, batch_pos, y, pos, row_idx, columns…): windows whose context rows are random training rows.

    Within a step all batch_size * window context draws differ; the target takes the last place.
    """
    training = Ranked(flows.filter(TRAIN).select(ROW, TRAIN), n_rows, TRAIN)
    drawn = draws(
        flows.sparkSession, "context", training.sizes.get(True, 0), batch_size * window, steps, seed
    ).select(
        "step",
        F.expr(f"slot div {int(window)}").alias("batch_pos"),
        (F.col("slot") % window).cast("int").alias("pos"),
        "rank",
        F.lit(True).alias(TRAIN),
    )
    size = batch_size * window * steps
    context = training.at(drawn.filter(F.col("pos") < window - 1), size)
    labels = small_side(batch_rows.select("step", "batch_pos", LABEL), batch_size * steps)
    context = context.select("step", "batch_pos", "pos", ROW).join(labels, ["step", "batch_pos"])
    targets = batch_rows.withColumn("pos", F.lit(window - 1))
    places = context.unionByName(targets.select(*context.columns))
    return flows.select(ROW, *[quoted(c) for c in columns]).join(small_side(places, size), ROW)


def _up_to(n: int) -> Column:
    """Array 0..n-1 of BIGINT."""
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _at_ranks(candidates: Ranked, wanted: DataFrame, batch_size: int, steps: int) -> DataFrame:
    malicious_first: Column = F.when(F.col(LABEL), F.col("slot")).otherwise(
        F.col("slot") + quotas(batch_size)[True]
    )
    rows = candidates.at(wanted, batch_size * steps)
    return rows.select("step", malicious_first.alias("batch_pos"), LABEL, ROW)
