"""Training a window classifier on balanced batches with Spark ML, epoch by epoch."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netseq.operators.masks import LABEL
from netseq.operators.runlog import FIXED_EVAL_EPOCH, START_LOSS

# Columns of a run log: one row per optimiser step; elapsed counts seconds from the start of the run.
LOG = "epoch int, step int, loss double, accuracy double, elapsed double"


class Classifier(NamedTuple):
    """A fitted Spark ML model."""

    model: object

    def score(self, df: DataFrame, keep: Sequence[str], vector: str = "x") -> DataFrame:
        """(keep…, p): probability of the malicious class."""
        rows = df.select(*keep, array_to_vector(vector).alias("features"))
        scored = self.model.transform(rows)
        return scored.select(*keep, vector_to_array("probability").getItem(1).alias("p"))


class EpochRun(NamedTuple):
    """The trained classifier, the log, what ``evaluate`` returned, and the last epoch."""

    classifier: Classifier
    log: list[tuple[int, int, float, float, float]]
    evaluations: list
    final_epoch: int


def train_epochs(
    draw: Callable[[int], DataFrame],
    sizes: Sequence[int],
    epochs: int,
    steps: int,
    patience: int = 5,
    seed: int = 42,
    evaluate: Callable[[Classifier, int], object] | None = None,
    vector: str = "pooled",
) -> EpochRun:
    """Train output layers of the given ``sizes`` (input width, hidden layers, 2) epoch by epoch.

    ``draw(epoch)`` gives that epoch's rows (y, vector), drawn afresh and far fewer than the table. Every
    epoch starts from the weights of the one before and takes at most ``steps`` optimiser steps; gradients
    are summed on the executors. Training ends where ``patience`` runs out: an epoch improves on the best
    loss so far or counts against it. Evaluation takes place at the fixed epoch, at the last one, and at
    that end, always with the weights trained so far.
    """
    best, waiting, log, evaluations, weights, classifier, epoch = START_LOSS, 0, [], [], None, None, 0
    begin = time.perf_counter()
    for epoch in range(epochs):
        rows = draw(epoch).select(
            array_to_vector(vector).alias("features"), F.col(LABEL).cast("double").alias("label")
        )
        learner = MultilayerPerceptronClassifier(layers=list(sizes), maxIter=steps, seed=seed)
        if weights is not None:
            learner.setInitialWeights(weights)
        model = learner.fit(rows)
        weights, classifier, summary = model.weights, Classifier(model), model.summary()
        losses, accuracy = [float(v) for v in summary.objectiveHistory], float(summary.accuracy)
        elapsed = time.perf_counter() - begin
        log += [(epoch, step, loss, accuracy, elapsed) for step, loss in enumerate(losses)]
        improved = any(loss < best for loss in losses)
        best = min([best, *[loss for loss in losses if loss == loss]])
        waiting = 0 if improved else waiting + 1
        stop = 0 < patience < waiting
        if evaluate and (epoch in (FIXED_EVAL_EPOCH, epochs - 1) or stop):
            evaluations.append(evaluate(classifier, epoch))
        if stop:
            break
    return EpochRun(classifier, log, evaluations, epoch)
