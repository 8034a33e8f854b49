"""Queries on sources, order, splits, projections and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netseq.functions.hashing import text_key
from netseq.operators.masks import add_candidate_sets, add_label, selectable
from netseq.operators.order import ROW, head, index_by_file
from netseq.operators.split import TRAIN, context_report, leak_audit, split_flag, split_last, split_random
from netseq.plans.common import (
    EVENT_ENCODED,
    EVENT_LABELS,
    EVENT_ROWS,
    EVENTS,
    FRACTION,
    LINE_KEYS,
    LINE_ROWS,
    LINEITEM,
    SEED,
    WINDOW,
    events,
    h60,
    labelled_events,
    lineitem,
    preprocessed,
    r6,
    rd,
    rounded,
)
from netseq.session import staging_path
from netseq.sources.artifacts import Artifact, load_artifact, save_artifact
from netseq.sources.feather import write_feather
from netseq.sources.readers import read_flows, read_table

PREVIEW_ROWS = 500
FILE_COLUMNS = ["event_id", "user_id", "event_type", "value"]
FILE_SPEC = EVENTS.with_order()


def _in_file_order(spark: SparkSession, folder: str) -> DataFrame:
    """Events spread over files whose names follow the event order."""
    df = read_table(spark, folder, "events").select(*FILE_COLUMNS)
    return df.repartitionByRange("event_id").sortWithinPartitions("event_id")


def scan_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = staging_path(spark, "events") + ".csv"
    _in_file_order(spark, folder).write.option("header", True).csv(path)
    return read_flows(spark, path, FILE_SPEC).df.select(ROW, "user_id", "event_type", "value")


def scan_feather(spark: SparkSession, folder: str) -> DataFrame:
    path = staging_path(spark, "events") + ".feather"
    write_feather(_in_file_order(spark, folder), path)
    return read_flows(spark, path, FILE_SPEC).df.select(ROW, "user_id", "event_type", "value")


def head_rows(spark: SparkSession, folder: str) -> DataFrame:
    return head(events(spark, folder), PREVIEW_ROWS).df.select(ROW, "event_id", "user_id", "value")


def artifact_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = staging_path(spark, "artifact")
    done = preprocessed(events(spark, folder), EVENTS)
    save_artifact(Artifact(done.df, done.model_input), path)
    loaded = load_artifact(spark, path)
    return rounded(loaded.df, "value").select(ROW, TRAIN, "y_raw", *loaded.model_input.columns)


def artifact_key(spark: SparkSession, folder: str) -> DataFrame:
    sizes = read_table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n_rows"))
    text = F.format_string('{\n"dataset": "user_%s",\n"n_rows": %s\n}', F.col("user_id"), F.col("n_rows"))
    return sizes.select(
        "user_id",
        "n_rows",
        F.concat_ws("_", F.lit("user"), "user_id", "n_rows", text_key(text)).alias("artifact_key"),
    )


def row_index(spark: SparkSession, folder: str) -> DataFrame:
    return lineitem(spark, folder).df.select(
        ROW, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )


def row_index_files(spark: SparkSession, folder: str) -> DataFrame:
    return index_by_file(read_table(spark, folder, "events")).df.select(ROW, "event_id")


def split_last_rows(spark: SparkSession, folder: str) -> DataFrame:
    return split_last(events(spark, folder), FRACTION).select(ROW, TRAIN)


def left_out(spark: SparkSession, folder: str) -> DataFrame:
    return context_report(split_flag(lineitem(spark, folder), LINEITEM.test_column, WINDOW), WINDOW)


def split_random_rows(spark: SparkSession, folder: str) -> DataFrame:
    return split_random(events(spark, folder), FRACTION, WINDOW, SEED).select(ROW, TRAIN)


def split_by_flag(spark: SparkSession, folder: str) -> DataFrame:
    return split_flag(lineitem(spark, folder), LINEITEM.test_column, WINDOW).select(ROW, TRAIN)


def leaks(spark: SparkSession, folder: str) -> DataFrame:
    indexed = events(spark, folder)
    return leak_audit(split_random(indexed, FRACTION, WINDOW, SEED), indexed.n_rows, WINDOW)


def project_spec(spark: SparkSession, folder: str) -> DataFrame:
    df = LINEITEM.with_order().project(read_table(spark, folder, "lineitem"), with_test=False)
    return df.withColumns({c: F.col(c) + F.lit(0.0) for c in LINEITEM.numeric_fields})


def label_mask(spark: SparkSession, folder: str) -> DataFrame:
    df = read_table(spark, folder, "events").select("event_id", "event_type")
    return add_label(df, EVENTS.class_column, EVENTS.benign_label)


def selectable_rows(spark: SparkSession, folder: str) -> DataFrame:
    indexed = events(spark, folder)
    return indexed.df.select(ROW, selectable(indexed.n_rows, WINDOW).alias("selectable"))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    df, n = labelled_events(spark, folder)
    return add_candidate_sets(df, n, WINDOW).select(
        ROW, "train_malicious", "train_benign", "train_any", "evaluation"
    )


QUERIES = {
    "scan_csv": scan_csv,
    "scan_feather": scan_feather,
    "head_rows": head_rows,
    "artifact_roundtrip": artifact_roundtrip,
    "artifact_key": artifact_key,
    "row_index": row_index,
    "row_index_files": row_index_files,
    "split_last": split_last_rows,
    "split_random": split_random_rows,
    "split_flag": split_by_flag,
    "left_out": left_out,
    "leak_audit": leaks,
    "project_spec": project_spec,
    "label_mask": label_mask,
    "selectable": selectable_rows,
    "candidates": candidates,
}

_FILE_ROWS = (
    "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx, user_id, event_type, value FROM events"
)
RANDOM_SPLIT = (
    EVENT_ROWS
    + f", d AS (SELECT row_idx, n, row_number() OVER (ORDER BY {h60(f'{SEED!s}' + ' || chr(58) || row_idx')}"
    + f", row_idx) AS turn FROM o WHERE row_idx >= {WINDOW})"
    + ", r AS (SELECT o.row_idx, d.turn IS NULL OR d.turn > "
    + f"CAST(floor(o.n * CAST({FRACTION} AS DOUBLE)) AS BIGINT) AS is_train FROM o LEFT JOIN d USING (row_idx))"
)

ORACLE = {
    "scan_csv": _FILE_ROWS,
    "scan_feather": _FILE_ROWS,
    "head_rows": f"WITH {EVENT_ROWS} SELECT row_idx, event_id, user_id, value FROM o WHERE row_idx < {PREVIEW_ROWS}",
    "artifact_roundtrip": f"WITH {EVENT_ENCODED} SELECT row_idx, is_train, event_type AS y_raw, "
    f"{rd('scaled')} AS value, CAST(code AS INTEGER) AS user_id FROM e",
    "artifact_key": "WITH u AS (SELECT user_id, count(*) AS n_rows FROM events GROUP BY user_id), "
    "t AS (SELECT *, '{' || chr(10) || '\"dataset\": \"user_' || user_id || '\",' || chr(10) || "
    "'\"n_rows\": ' || n_rows || chr(10) || '}' AS txt FROM u) "
    "SELECT user_id, n_rows, 'user_' || user_id || '_' || n_rows || '_' || "
    "translate(to_base64(unhex(sha1(txt))), '+=/', '000') AS artifact_key FROM t",
    "row_index": f"SELECT row_number() OVER (ORDER BY {LINE_KEYS}) - 1 AS row_idx, l_orderkey, l_linenumber, "
    "l_partkey, l_suppkey, l_extendedprice FROM lineitem",
    "row_index_files": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx, event_id FROM events",
    "split_last": f"WITH {EVENT_ROWS} SELECT row_idx, is_train FROM o",
    "split_random": f"WITH {RANDOM_SPLIT} SELECT row_idx, is_train FROM r",
    "split_flag": f"WITH {LINE_ROWS}, m AS (SELECT l_linestatus AS v FROM lineitem GROUP BY 1 "
    f"ORDER BY count(*), 1 LIMIT 1) SELECT row_idx, NOT (l_linestatus = v AND row_idx > {WINDOW}) AS is_train "
    "FROM o CROSS JOIN m",
    "left_out": f"WITH {LINE_ROWS}, m AS (SELECT l_linestatus AS v FROM lineitem GROUP BY 1 "
    f"ORDER BY count(*), 1 LIMIT 1) SELECT NOT (l_linestatus = v AND row_idx > {WINDOW}) AS is_train, count(*) AS rows, "
    f"count(*) FILTER (WHERE row_idx >= {WINDOW - 1}) AS windows, count(*) FILTER (WHERE row_idx < {WINDOW - 1}) AS left_out "
    "FROM o CROSS JOIN m GROUP BY 1",
    "leak_audit": f"WITH {RANDOM_SPLIT}, w AS (SELECT is_train, min(CAST(is_train AS INTEGER)) OVER t AS pure, "
    f"count(*) OVER t AS size FROM r WINDOW t AS (ORDER BY row_idx ROWS BETWEEN {WINDOW - 1} PRECEDING "
    "AND CURRENT ROW)) SELECT count(*) AS train_windows, count(*) FILTER (WHERE pure = 0) AS leaky_windows "
    f"FROM w WHERE is_train AND size = {WINDOW}",
    "project_spec": "SELECT l_quantity + 0.0 AS l_quantity, l_extendedprice + 0.0 AS l_extendedprice, "
    "l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax, l_suppkey, l_linenumber, l_returnflag FROM lineitem",
    "label_mask": "SELECT event_id, event_type, event_type IS DISTINCT FROM 'view' AS y FROM events",
    "selectable": f"WITH {EVENT_ROWS} SELECT row_idx, row_idx >= {WINDOW} AND row_idx < n - {WINDOW} "
    "AS selectable FROM o",
    "candidates": f"WITH {EVENT_LABELS}, m AS (SELECT *, is_train AND row_idx >= {WINDOW} AND "
    f"row_idx < n - {WINDOW} AS d FROM c) SELECT row_idx, d AND y AS train_malicious, "
    "d AND NOT y AS train_benign, is_train AS train_any, NOT is_train AS evaluation FROM m",
}
