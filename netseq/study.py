"""A whole study: load and preprocess a flow table, window it, train, evaluate, time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netseq.operators import batching
from netseq.operators.assemble import RAW_LABEL, preprocess
from netseq.operators.categorical import one_hot
from netseq.operators.encode import VECTOR, InputEncoding
from netseq.operators.masks import LABEL, add_label, training_candidates
from netseq.operators.metrics import evaluate
from netseq.operators.numeric import NUMERIC_LIMIT
from netseq.operators.order import ROW, Ranked
from netseq.operators.pool import Head
from netseq.operators.preprocessing import Preprocessing
from netseq.operators.score import Scorer, SequenceModel, Weights, pool_windows, score_flows, score_windows, time_scoring
from netseq.operators.split import TRAIN, first_eval_row, split, training_rows
from netseq.operators.train import LOG, Classifier, train_epochs
from netseq.operators.windows import ordered_windows, windows_at
from netseq.session import shared_folder, stage, tune
from netseq.sources.artifacts import Artifact, MemoryCache, artifact_key, load_or_build
from netseq.sources.readers import read_flows
from netseq.spec import CategoricalFormat, EvalSampling, FlowSpec, ModelInput, StudyParams, quoted


class Outcome(NamedTuple):
    """Run log (epoch, step, loss, accuracy, elapsed), result rows, last epoch."""

    train_results: DataFrame
    eval_results: DataFrame
    final_epoch: int


class FlowStudy:
    """Four exchangeable components and the parameters that tie them together."""

    memory = MemoryCache()
    retain_in_memory = False

    def __init__(
        self,
        spark: SparkSession,
        preprocessing: Preprocessing,
        encoding: InputEncoding,
        model: SequenceModel,
        head: Head,
        params: StudyParams | None = None,
    ):
        tune(spark)
        self.spark = spark
        self.preprocessing = preprocessing
        self.encoding = encoding
        self.model = model
        self.head = head
        self.params = params or StudyParams()
        self.spec: FlowSpec | None = None
        self.table: DataFrame | None = None
        self.model_input: ModelInput | None = None
        self.n_rows = 0
        self.first_eval = 0

    def load_dataset(
        self,
        name: str,
        dataset: DataFrame | pd.DataFrame | str,
        spec: FlowSpec,
        cache_path: str | None = None,
        n_rows: int = 0,
        sampling: EvalSampling = EvalSampling.LAST_ROWS,
        evaluation_percent: float = 0.2,
        numerical_filter: float = NUMERIC_LIMIT,
        types: T.StructType | None = None,
    ) -> DataFrame:
        """Preprocess, or reuse the result kept under the same key; returns the feature columns.

        The kept table holds integer codes; one-hot columns are made when it is read, which is cheaper
        than storing one column per level.
        """
        params, encoding = self.params, self.encoding
        settings = {
            "source": dataset if isinstance(dataset, str) else None,
            "types": types.json() if types else None,
            "roles": spec.to_json(),
            "split": [sampling.value, evaluation_percent, params.window_size, params.seed],
            "limit": numerical_filter,
            "form": encoding.required_format.value,
        }
        steps = {"kind": self.preprocessing.name, "settings": self.preprocessing.parameters}
        key = artifact_key(name, n_rows, steps, settings)

        def build() -> Artifact:
            indexed = read_flows(self.spark, dataset, spec, types, n_rows)
            rows = split(
                indexed, sampling, evaluation_percent, params.window_size, params.seed, spec.test_column
            )
            last = sampling is EvalSampling.LAST_ROWS
            done = preprocess(
                rows,
                spec,
                self.preprocessing,
                numerical_filter=numerical_filter,
                training=training_rows(indexed, evaluation_percent) if last else None,
            )
            return Artifact(done.df, done.model_input)

        folder = cache_path or f"{shared_folder(self.spark)}/cache"

        def kept() -> Artifact:
            return load_or_build(self.spark, folder, key, build)

        artifact = FlowStudy.memory.get(key, kept) if FlowStudy.retain_in_memory else kept()
        self.spec, self.model_input = spec, artifact.model_input
        table = artifact.df
        if encoding.required_format is CategoricalFormat.ONE_HOT:
            table = one_hot(table, dict(zip(self.model_input.categorical_features, self.model_input.levels)))
            self.model_input = replace(self.model_input, categorical_format=CategoricalFormat.ONE_HOT)
        self.table = add_label(table, RAW_LABEL, spec.benign_label)
        self.n_rows = artifact.df.count()
        last = sampling is EvalSampling.LAST_ROWS
        self.first_eval = first_eval_row(self.n_rows, evaluation_percent) if last else 0
        return table.select(ROW, *[quoted(c) for c in self.model_input.columns])

    def encoded(self) -> DataFrame:
        """Flows with their vector."""
        if self.table is None:
            raise RuntimeError("load a dataset first")
        return self.encoding.apply(self.table, self.model_input).select(ROW, TRAIN, LABEL, VECTOR)

    def build_model(self, weights: Weights | None = None) -> Scorer:
        """Scorer for this table's windows; without weights, use ``weight_shapes`` to make them."""
        if self.table is None:
            raise RuntimeError("load a dataset first")
        return Scorer(self.model, self.head, tuple(self.params.mlp_layer_sizes), weights or {})

    def weight_shapes(self) -> dict[str, tuple[int, ...]]:
        return self.build_model().weight_shapes(self.params.window_size, self.width)

    @property
    def width(self) -> int:
        return self.encoding.width(self.model_input)

    def evaluation_windows(self) -> DataFrame:
        """(row_idx, y, win): a window for every evaluation row that has enough rows before it."""
        windows = ordered_windows(
            self.encoded(),
            self.params.window_size,
            self.n_rows,
            [VECTOR],
            keep=[LABEL],
            ends=~F.col(TRAIN),
            first_end=self.first_eval,
        )
        return windows.withColumn("win", F.col("win")[VECTOR])

    def batch_rows(self, batch_size: int, steps: int) -> DataFrame:
        """(step, batch_pos, y, row_idx) in the study's draw mode."""
        window = self.params.window_size
        ends = training_candidates(self.table.select(ROW, TRAIN, LABEL), self.n_rows, window)
        ranked = Ranked(ends, self.n_rows, LABEL)
        return batching.batches(
            ranked, batch_size, steps, self.params.seed, self.params.sequential_draw
        )

    def training_windows(self, batch_size: int, steps: int) -> DataFrame:
        """(step, batch_pos, y, row_idx, win) for the batches of a training run."""
        window, flows = self.params.window_size, self.encoded()
        chosen = self.batch_rows(batch_size, steps)
        if self.params.ordered_within_window:
            out = batching.batch_windows(chosen, flows, window, [VECTOR], batch_size * steps)
        else:
            places = batching.random_context(
                chosen, flows, self.n_rows, batch_size, steps, window, self.params.seed, [VECTOR]
            )
            out = places.groupBy("step", "batch_pos", LABEL).agg(
                F.max_by(ROW, "pos").alias(ROW),
                F.sort_array(F.collect_list(F.struct("pos", VECTOR))).alias("win"),
            )
        return out.withColumn("win", F.col("win")[VECTOR])

    def score(self, windows: DataFrame, scorer: Scorer, keep: Sequence[str]) -> DataFrame:
        return score_windows(windows, scorer.probabilities, self.params.window_size, self.width, keep)

    def evaluate(self, scorer: Scorer, epoch: int = 0) -> DataFrame:
        """One result row for a scorer on the evaluation windows."""
        scored = score_flows(
            self.encoded(),
            scorer.probabilities,
            self.params.window_size,
            self.n_rows,
            self.width,
            [LABEL],
            ends=~F.col(TRAIN),
            first_end=self.first_eval,
        )
        return evaluate(scored).select(F.lit(epoch).alias("epoch"), "*")

    def fit(
        self,
        batch_size: int = 128,
        steps_per_epoch: int = 128,
        epochs: int = 100,
        early_stopping_patience: int = 5,
        hidden: Sequence[int] | None = None,
        weights: Weights | None = None,
        iterations: int = 8,
    ) -> tuple[Classifier, Outcome]:
        """Train the output layers on fresh balanced batches in every epoch, evaluating on schedule.

        The study's sequence model runs in front of the head with fixed ``weights``; a model that has
        weights is refused without them. ``hidden`` defaults to the study's layer sizes. An epoch's
        ``steps_per_epoch`` batches are one training set, on which up to ``iterations`` optimiser steps are
        taken, the steps of the run log.
        """
        stored = stage(
            self.pooled(self.training_windows(batch_size, steps_per_epoch * epochs), weights, ["step", LABEL]),
            "batches",
        )

        def draw(epoch: int) -> DataFrame:
            return stored.filter(F.col("step").between(epoch * steps_per_epoch, (epoch + 1) * steps_per_epoch - 1))

        evaluated = stage(self.pooled(self.evaluation_windows(), weights, [LABEL]), "evaluation")

        def judge(classifier: Classifier, epoch: int) -> Row:
            scored = classifier.score(evaluated, [LABEL], "pooled")
            return evaluate(scored).select(F.lit(epoch).alias("epoch"), "*").first()

        width = self.head.output_width(*self.head.model_shape(self.params.window_size, self.width))
        hidden = self.params.mlp_layer_sizes if hidden is None else hidden
        run = train_epochs(
            draw, [width, *hidden, 2], epochs, iterations, early_stopping_patience, self.params.seed, judge
        )
        log = self.spark.createDataFrame(run.log, LOG)
        results = self.spark.createDataFrame(run.evaluations)
        return run.classifier, Outcome(log, results, run.final_epoch)

    train = fit

    def pooled(self, windows: DataFrame, weights: Weights | None = None, keep: Sequence[str] = (LABEL,)) -> DataFrame:
        """(keep…, pooled): the head's vector over the study's sequence model."""
        steps, width = self.params.window_size, self.width
        shape = self.head.model_shape(steps, width)
        needed = self.model.weight_shapes(shape[1])
        if needed and not weights:
            raise ValueError(f"{self.model.name} needs weights; use SequenceModel() to train without one")
        if type(self.model).transform is SequenceModel.transform:
            before = self.head.before_column(F.col("win"), steps, width)
            return windows.select(*keep, self.head.column(before, *shape).alias("pooled"))
        return pool_windows(windows, self.build_model(weights).pooled, steps, width, keep)

    def time(
        self, scorer: Scorer, batch_size: int, n_steps: int = 128, n_repeats: int = 4
    ) -> DataFrame:
        """(step, repeat, seconds) of scoring training batches."""
        windows = self.training_windows(batch_size, n_steps)
        return time_scoring(
            windows, scorer.probabilities, self.params.window_size, self.width, n_repeats
        )

    def windows_of(self, ends: DataFrame, n_ends: int, keep: Sequence[str] = ()) -> DataFrame:
        """Windows for ``n_ends`` chosen end rows (``row_idx`` and ``keep``)."""
        out = windows_at(ends, self.encoded(), self.params.window_size, [VECTOR], list(keep), n_ends)
        return out.withColumn("win", F.col("win")[VECTOR])
