"""Fits that can be added to: what each part of the data contributes is kept as a table.

A part is whatever arrives together, such as a day's files. Its training rows are reduced once to extremes,
level counts and cardinality sketches, all of which merge; fitting again after another part has arrived reads
these, never the rows of earlier parts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netseq.operators.categorical import level_counts, ranked_levels
from netseq.operators.preprocessing import Fitted, StandardPreprocessing
from netseq.operators.split import TRAIN
from netseq.spec import quoted

# Registers of a sketch, as a power of two: a standard error of about 1.04 / 2^6, 1.6 percent.
SKETCH_BITS = 12

SCHEMA = (
    "kind string, feature string, place int, type string, lo double, hi double, n bigint, x double, s string, "
    "cnt bigint, sketch binary"
)
_PART = re.compile(r"[A-Za-z0-9.-]+")


class FitState:
    """Contributions of parts, in a folder.

    The same features are expected in every part. A part without training rows contributes no extremes and no
    levels. Numbers should be cleaned before. A part is written under a run of its own and counts once a line in
    the table of commits names that run, so an interrupted job leaves nothing that is read; adding a part under
    a name that is there replaces it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.data, self.commits = f"{path.rstrip('/')}/data", f"{path.rstrip('/')}/commits"

    def add(
        self,
        part: str,
        rows: DataFrame,
        numerics: Sequence[str] = (),
        categoricals: Sequence[str] = (),
        watched: Sequence[str] = (),
    ) -> None:
        """Reduce the training rows of a part; ``watched`` columns get a sketch of their distinct values."""
        if not _PART.fullmatch(part):
            raise ValueError(f"a part's name must be of letters, digits, dots and dashes: {part!r}")
        missing = [c for c in (*numerics, *categoricals, *watched) if c not in rows.columns]
        if missing:
            raise ValueError(f"columns missing from the part: {missing}")
        parts = [_features(rows, numerics, categoricals)]
        if numerics or watched:
            parts.append(_measures(rows, numerics, watched))
        if categoricals:
            parts.append(level_counts(rows, categoricals).withColumn("kind", F.lit("level")))
        whole = self.spark.createDataFrame([], SCHEMA)
        for p in parts:
            whole = whole.unionByName(p, allowMissingColumns=True)
        run = uuid.uuid4().hex
        whole.write.parquet(f"{self.data}/part={part}/run={run}")
        line = self.spark.range(1).select(F.lit(part).alias("part"), F.lit(run).alias("run"), F.current_timestamp().alias("at"))
        line.coalesce(1).write.mode("append").parquet(self.commits)

    def parts(self) -> DataFrame:
        """(part, run): the parts that count, each with its last committed run."""
        lines = self._read(self.commits, "part string, run string, at timestamp")
        return lines.groupBy("part").agg(F.max_by("run", F.struct("at", "run")).alias("run"))

    def table(self) -> DataFrame:
        """All contributions that count, with the part they come from; empty before the first part."""
        rows = self._read(self.data, f"{SCHEMA}, part string, run string")
        return rows.join(self.parts(), ["part", "run"], "left_semi")

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def numbers(self) -> DataFrame:
        """(feature, min, range) over the training rows of all parts."""
        ends = self.table().filter("kind = 'number'").groupBy("feature").agg(F.min("lo").alias("min"), F.max("hi").alias("max"))
        return ends.select("feature", "min", (F.col("max") - F.col("min")).alias("range"))

    def levels(self, k: int) -> DataFrame:
        """(feature, n, x, s, cnt, code): the ``k`` most frequent levels over all parts."""
        counts = self.table().filter("kind = 'level'").groupBy("feature", "n", "x", "s").agg(F.sum("cnt").alias("cnt"))
        return ranked_levels(counts, k)

    def cardinalities(self) -> DataFrame:
        """(feature, distinct): estimates for the watched columns over all parts, from their merged sketches."""
        merged = self.table().filter("kind = 'watched'").groupBy("feature").agg(F.hll_union_agg("sketch").alias("sketch"))
        return merged.select("feature", F.hll_sketch_estimate("sketch").alias("distinct"))

    def fitted(self, preprocessing: StandardPreprocessing) -> Fitted:
        """The same as a fit over the rows of all parts; constants and ``k`` levels a feature reach the driver."""
        features = self.table().filter("kind = 'feature'").select("feature", "place", "type").distinct().orderBy("place").collect()
        if len({r["feature"] for r in features}) != len(features):
            raise ValueError("the parts do not agree on features, their order or their types")
        ends = {r["feature"]: {"min": r["min"], "range": r["range"]} for r in self.numbers().collect()}
        found = sorted(self.levels(preprocessing.n_categorical_levels).collect(), key=lambda r: r["code"])
        slots = {r["feature"]: r["type"] for r in features if r["type"] != "number"}
        return Fitted(
            preprocessing,
            {r["feature"]: ends.get(r["feature"], {"min": None, "range": None}) for r in features if r["type"] == "number"},
            {c: [next(v for v in (r["n"], r["x"], r["s"]) if v is not None) for r in found if r["feature"] == c] for c in slots},
        )


def _features(rows: DataFrame, numerics: Sequence[str], categoricals: Sequence[str]) -> DataFrame:
    """One row per feature, so that a part without rows still tells what it would fit."""
    kinds = ["number"] * len(numerics) + [rows.schema[c].dataType.simpleString() for c in categoricals]
    names = [(c, i, kind) for i, (c, kind) in enumerate(zip([*numerics, *categoricals], kinds))]
    return rows.sparkSession.createDataFrame(names, "feature string, place int, type string").withColumn("kind", F.lit("feature"))


def _measures(rows: DataFrame, numerics: Sequence[str], watched: Sequence[str]) -> DataFrame:
    """Extremes and sketches of all columns in one aggregation, a row per column."""
    wide = rows.filter(TRAIN).agg(
        *[F.min(F.col(quoted(c)).cast("double")).alias(f"lo{i}") for i, c in enumerate(numerics)],
        *[F.max(F.col(quoted(c)).cast("double")).alias(f"hi{i}") for i, c in enumerate(numerics)],
        *[F.hll_sketch_agg(F.col(quoted(c)).cast("string"), SKETCH_BITS).alias(f"sketch{i}") for i, c in enumerate(watched)],
    )
    nothing, no_sketch = F.lit(None).cast("double"), F.lit(None).cast("binary")
    items = [
        F.struct(F.lit("number").alias("kind"), F.lit(c).alias("feature"), F.col(f"lo{i}").alias("lo"),
                 F.col(f"hi{i}").alias("hi"), no_sketch.alias("sketch"))
        for i, c in enumerate(numerics)
    ] + [
        F.struct(F.lit("watched").alias("kind"), F.lit(c).alias("feature"), nothing.alias("lo"), nothing.alias("hi"),
                 F.col(f"sketch{i}").alias("sketch"))
        for i, c in enumerate(watched)
    ]
    return wide.select(F.inline(F.array(*items)))
