"""A ledger of runs: a plan of settings is worked off, and what is finished is not run again.

A run writes its rows under an attempt of its own and counts once a line of the ledger names that attempt. A job that
is stopped leaves at most one attempt that no line names, which is never read; starting the same plan again goes on
with the runs that are missing and ends with the same table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netseq.sources.artifacts import identifier

# Columns the ledger adds to the rows of a run.
ADDED = ("run", "settings", "attempt")


class RunLedger:
    """Runs in a folder; ``schema`` is that of the rows every run gives, in SQL."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.schema = spark, schema
        self.data, self.lines = f"{path.rstrip('/')}/data", f"{path.rstrip('/')}/ledger"

    def finished(self) -> DataFrame:
        """(run, settings, attempt): the first attempt of each run that was finished."""
        lines = self._read(self.lines, "run string, settings string, attempt string, at timestamp")
        first = F.struct("at", "attempt")
        return lines.groupBy("run").agg(F.min_by("settings", first).alias("settings"), F.min_by("attempt", first).alias("attempt"))

    def work_off(self, plan: Sequence[dict], execute: Callable[[dict], DataFrame]) -> DataFrame:
        """Execute the runs of the plan that are missing and return the rows of all its runs.

        Equal settings are one run, in whatever order their keys stand. A run that fails ends the work; the runs
        before it stay finished.
        """
        keys = {identifier(settings): settings for settings in plan}
        done = {r["run"] for r in self.finished().filter(F.col("run").isin(list(keys))).select("run").collect()}
        for key, settings in keys.items():
            if key not in done:
                self._commit(key, settings, execute(settings))
        return self.results(list(keys.values()))

    def results(self, plan: Sequence[dict] | None = None) -> DataFrame:
        """(run, settings, the rows' columns) of finished runs, of those in the plan if one is given."""
        lines = self.finished()
        if plan is not None:
            lines = lines.filter(F.col("run").isin([identifier(s) for s in plan]))
        rows = self._read(self.data, f"{self.schema}, run string, attempt string")
        return rows.join(lines, ["run", "attempt"]).drop("attempt")

    def _commit(self, key: str, settings: dict, rows: DataFrame) -> None:
        attempt = uuid.uuid4().hex
        columns = self.spark.createDataFrame([], self.schema).schema
        if set(rows.columns) != set(columns.names) or set(ADDED) & set(rows.columns):
            raise ValueError(f"a run gave the columns {rows.columns}, not {columns.names}")
        typed = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in columns])
        typed.write.parquet(f"{self.data}/run={key}/attempt={attempt}")
        told = (key, json.dumps(settings, sort_keys=True), attempt)
        line = self.spark.createDataFrame([told], "run string, settings string, attempt string")
        line.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.lines)

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
