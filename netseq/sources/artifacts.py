"""Preprocessed tables kept on disk or in memory, and records of runs."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from netseq.spec import ModelInput


class Artifact(NamedTuple):
    """A preprocessed table and the model's view of it."""

    df: DataFrame
    model_input: ModelInput


def key_text(settings: dict) -> str:
    """JSON with sorted keys, one pair per line."""
    return json.dumps(settings, sort_keys=True, indent=0)


def identifier(settings: dict) -> str:
    """Short key of a settings dictionary: SHA-1 in base64 with + = / replaced by 0."""
    digest = hashlib.sha1(key_text(settings).encode("utf8")).digest()
    return base64.b64encode(digest).decode("ascii").translate(str.maketrans("+=/", "000"))


def artifact_key(name: str, n_rows: int, preprocessing: dict, local: dict) -> str:
    """Key of a preprocessed table; ``local`` should hold everything else that shapes the result."""
    if not name:
        raise ValueError("a dataset needs a name to be cached under")
    return f"{name}_{n_rows}_{identifier(preprocessing)}_{identifier(local)}"


def save_artifact(artifact: Artifact, path: str) -> None:
    """Table as parquet under a new name, then a description that points to it and marks completion.

    What a broken run has left behind is never read and never in the way.
    """
    spark = artifact.df.sparkSession
    table = f"table-{uuid.uuid4().hex}"
    artifact.df.write.mode("errorifexists").parquet(f"{path}/{table}")
    told = json.dumps({"table": table, "model_input": artifact.model_input.to_json()})
    text = spark.createDataFrame([(told,)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/model_input")


def load_artifact(spark: SparkSession, path: str) -> Artifact | None:
    """The saved table, or None if there is no complete one."""
    try:
        text = spark.read.text(f"{path}/model_input").first()
    except AnalysisException:
        return None
    if text is None:
        return None
    told = json.loads(text[0])
    return Artifact(spark.read.parquet(f"{path}/{told['table']}"), ModelInput.from_json(told["model_input"]))


def load_or_build(
    spark: SparkSession, folder: str, key: str, build: Callable[[], Artifact]
) -> Artifact:
    """Saved artifact if present; else build, save and read back."""
    path = f"{folder.rstrip('/')}/{key}"
    found = load_artifact(spark, path)
    if found is None:
        save_artifact(build(), path)
        found = load_artifact(spark, path)
    return found


class MemoryCache:
    """Keeps the latest artifact persisted; a new key releases the previous one."""

    def __init__(self):
        self._key: str | None = None
        self._artifact: Artifact | None = None

    def get(self, key: str, build: Callable[[], Artifact]) -> Artifact:
        if key != self._key:
            self.clear()
            built = build()
            self._artifact = Artifact(built.df.persist(), built.model_input)
            self._key = key
        return self._artifact

    def clear(self) -> None:
        if self._artifact is not None:
            self._artifact.df.unpersist()
        self._key = self._artifact = None


def save_records(spark: SparkSession, records: Iterable[dict], path: str) -> None:
    """Append run records (small dictionaries) as JSON lines."""
    rows = [(json.dumps(r, sort_keys=True),) for r in records]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(path)


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """Run records as a frame."""
    return spark.read.json(path)
