"""Queries on numeric and categorical preprocessing, assembly and input encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netseq.functions import scalars
from netseq.operators import categorical, numeric
from netseq.operators.assemble import shape_report
from netseq.operators.embed_table import NUMERIC_CODE, TableEmbed
from netseq.operators.encode import VECTOR, CategoryEmbed, ConcatEncoding, RecordEmbed
from netseq.operators.fit_state import FitState
from netseq.operators.numeric import sanitise
from netseq.operators.order import ROW
from netseq.operators.split import TRAIN, first_eval_row, split_last
from netseq.plans.common import (
    EVENT_ENCODED,
    EVENT_LABELS,
    EVENT_SCALED,
    EVENTS,
    FRACTION,
    LEVELS,
    LINE_ENCODED,
    LINE_FIT,
    LINE_NUMBERS,
    LINE_ROWS,
    LINEITEM,
    ORDER_ENCODED,
    ORDERS,
    clean,
    codes,
    customer,
    events,
    labelled_events,
    lineitem,
    minmax,
    ordered,
    orders,
    preprocessed,
    r6,
    rd,
    rounded,
)
from netseq.sources.readers import read_table
from netseq.session import stage, staging_path
from netseq.spec import CategoricalFormat, ModelInput

BALANCE_LIMIT = 5000.0
PRIORITIES = 5
FIT_PARTS = 4
EMBED_DIMENSION = 3

# Lines embedded by their keys: numbers, the table and key behind each category, and where weights are numbered from.
KEYED_NUMBERS = ("l_quantity", "l_discount")
KEYED_TABLES = {"l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}
KEYED_SHIFT = {"l_quantity": 2, "l_discount": 5, "l_partkey": 7, "l_suppkey": 11}

# Numbers that cleaning has to handle, laid over the customers by position.
DIRTY = [1.0, None, float("nan"), float("inf"), float("-inf"), 1e9, 1.0000001e9, -1e9, -2e9]
DIRTY_SQL = (
    "[1.0::DOUBLE, NULL, 'NaN'::DOUBLE, 'Infinity'::DOUBLE, '-Infinity'::DOUBLE, 1e9, 1.0000001e9, -1e9, -2e9]"
)


def weight(i: int, j: int) -> float:
    """Reproducible weight of input i and dimension j."""
    return ((i * 31 + j * 17) % 13 - 6) / 10


def weight_sql(i: str, j: str) -> str:
    return f"((({i}) * 31 + ({j}) * 17) % 13 - 6) / 10.0::DOUBLE"


def dirty_customers(spark: SparkSession, folder: str) -> DataFrame:
    indexed = customer(spark, folder)
    dirty = F.array(*[F.lit(v).cast("double") for v in DIRTY])
    x = F.element_at(dirty, (F.col(ROW) % len(DIRTY) + 1).cast("int"))
    return split_last(indexed, FRACTION).select(ROW, TRAIN, "c_custkey", "c_acctbal", x.alias("x"))


def sanitize(spark: SparkSession, folder: str) -> DataFrame:
    df = numeric.sanitise(dirty_customers(spark, folder), ["c_acctbal"], BALANCE_LIMIT)
    return numeric.sanitise(df, ["x"]).select("c_custkey", "c_acctbal", "x")


def dq_nonfinite(spark: SparkSession, folder: str) -> DataFrame:
    df = dirty_customers(spark, folder).withColumn("x_clean", scalars.sanitise(F.col("x")))
    fits = numeric.fit_minmax(df, ["c_acctbal"])
    return numeric.nonfinite_counts(numeric.scale(df, fits), ["x", "x_clean", "c_acctbal"])


def fit_numeric(spark: SparkSession, folder: str) -> DataFrame:
    df = numeric.sanitise(split_last(lineitem(spark, folder), FRACTION), LINE_NUMBERS)
    return rounded(numeric.fit_minmax_table(df, LINE_NUMBERS), "min", "range")


def log_minmax(spark: SparkSession, folder: str) -> DataFrame:
    df = numeric.sanitise(split_last(lineitem(spark, folder), FRACTION), LINE_NUMBERS)
    out = numeric.scale(df, numeric.fit_minmax(df, LINE_NUMBERS))
    return rounded(out, *LINE_NUMBERS).select(ROW, *LINE_NUMBERS)


def log_minmax_clip(spark: SparkSession, folder: str) -> DataFrame:
    """Balances under the fit of customers with a balance of 0 or more, so some fall outside it.

    Results that are not numbers are shown as text.
    """
    df = customer(spark, folder).df.select("c_custkey", "c_acctbal", (F.col("c_acctbal") >= 0).alias(TRAIN))
    fits = numeric.fit_minmax(df, ["c_acctbal"])
    clipped = numeric.scaled("c_acctbal", fits["c_acctbal"], clip=True)
    out = df.select("c_custkey", numeric.scaled("c_acctbal", fits["c_acctbal"]).alias("plain"), clipped.alias("clipped"))
    return out.select(
        "c_custkey",
        F.when(scalars.is_finite(F.col("plain")), r6("plain")).alias("plain"),
        F.when(F.isnan("plain"), "nan").when(F.col("plain") < -1e300, "-inf").otherwise("finite").alias("kind"),
        F.when(~F.isnan("clipped"), r6("clipped")).alias("clipped"),
    )


def fit_topk(spark: SparkSession, folder: str) -> DataFrame:
    df = split_last(events(spark, folder), FRACTION)
    return categorical.top_levels(df, ["user_id"], LEVELS).select(
        "feature", F.col("n").alias("level"), "cnt", F.col("code").cast("bigint").alias("code")
    )


def fit_topk_text(spark: SparkSession, folder: str) -> DataFrame:
    df = split_last(orders(spark, folder), FRACTION)
    return categorical.top_levels(df, ["o_orderpriority", "o_orderstatus"], 3).select(
        "feature", F.col("s").alias("level"), "cnt", F.col("code").cast("bigint").alias("code")
    )


def _encoded_events(spark: SparkSession, folder: str, unseen: int) -> DataFrame:
    df = split_last(events(spark, folder), FRACTION)
    levels = categorical.fit_levels(df, ["user_id"], LEVELS)
    return categorical.encode(df, levels, unseen).select(ROW, "user_id")


def encode_int(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded_events(spark, folder, 1)


def encode_int_unseen0(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded_events(spark, folder, 0)


def encode_onehot(spark: SparkSession, folder: str) -> DataFrame:
    done = preprocessed(orders(spark, folder), ORDERS, CategoricalFormat.ONE_HOT)
    return done.df.select(ROW, *done.model_input.feature_columns()["o_orderpriority"])


def levels_per_feature(spark: SparkSession, folder: str) -> DataFrame:
    done = preprocessed(lineitem(spark, folder), LINEITEM)
    return categorical.levels_per_feature(done.df, LINEITEM.categorical_fields)


def preprocess_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    done = preprocessed(lineitem(spark, folder), LINEITEM)
    return rounded(done.df, *LINE_NUMBERS)


def shapes(spark: SparkSession, folder: str) -> DataFrame:
    source = read_table(spark, folder, "lineitem")
    return shape_report(source, preprocessed(lineitem(spark, folder), LINEITEM).df)


def _exploded(df: DataFrame, name: str) -> DataFrame:
    # the outer form: the inner one would add a filter on the vector's size, computing it twice
    exploded = df.select(ROW, F.posexplode_outer(VECTOR).alias("dim", name))
    return exploded.select(ROW, "dim", r6(name).alias(name))


def concat_vector(spark: SparkSession, folder: str) -> DataFrame:
    done = preprocessed(orders(spark, folder), ORDERS, CategoricalFormat.ONE_HOT)
    return _exploded(ConcatEncoding().apply(done.df, done.model_input), "v")


def record_weights(model_input) -> dict[str, list[list[float]]]:
    """One row per numeric feature, one row per code of a categorical one, numbered throughout."""
    weights, i = {}, 0
    for feature in model_input.numeric_features:
        weights[feature] = [[weight(i, j) for j in range(EMBED_DIMENSION)]]
        i += 1
    for feature, n in zip(model_input.categorical_features, model_input.levels):
        weights[feature] = [[weight(i + c, j) for j in range(EMBED_DIMENSION)] for c in range(n)]
        i += LEVELS
    return weights


def embed_record(spark: SparkSession, folder: str) -> DataFrame:
    done = preprocessed(lineitem(spark, folder), LINEITEM)
    encoding = RecordEmbed(EMBED_DIMENSION, record_weights(done.model_input), bias=[0.1, 0.2, 0.3])
    return _exploded(encoding.apply(done.df, done.model_input), "v")


def _keyed_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, ModelInput]:
    """Lines whose part and supplier numbers are codes themselves: as many levels as there are parts and suppliers."""
    rows = lineitem(spark, folder).df.select(
        ROW,
        *[F.col(c).cast("double").alias(c) for c in KEYED_NUMBERS],
        *[(F.col(c) + 1).alias(c) for c in KEYED_TABLES],
    )
    levels = [read_table(spark, folder, t).count() for t, _ in KEYED_TABLES.values()]
    return rows, ModelInput(KEYED_NUMBERS, tuple(KEYED_TABLES), levels, CategoricalFormat.INTEGERS)


def _weight_table(spark: SparkSession, folder: str) -> DataFrame:
    """(feature, code, w) with a vector for every part, every supplier and every number."""
    dims = F.sequence(F.lit(0), F.lit(EMBED_DIMENSION - 1))

    def vector(shift: int):
        return F.transform(dims, lambda j: (((F.col("code") + shift) * 31 + j * 17) % 13 - 6) / F.lit(10.0)).alias("w")

    table = None
    for c, (name, key) in KEYED_TABLES.items():
        part = read_table(spark, folder, name).select(F.lit(c).alias("feature"), (F.col(key) + 1).alias("code"))
        part = part.select("*", vector(KEYED_SHIFT[c]))
        table = part if table is None else table.unionByName(part)
    for c in KEYED_NUMBERS:
        one = spark.range(1).select(F.lit(c).alias("feature"), F.lit(NUMERIC_CODE).cast("bigint").alias("code"))
        table = table.unionByName(one.select("*", vector(KEYED_SHIFT[c])))
    return stage(table, "weights")


def embed_table(spark: SparkSession, folder: str) -> DataFrame:
    df, model_input = _keyed_lines(spark, folder)
    encoding = TableEmbed(EMBED_DIMENSION, _weight_table(spark, folder), bias=[0.1, 0.2, 0.3])
    return _exploded(encoding.apply(df, model_input), "v")


def embed_table_concat(spark: SparkSession, folder: str) -> DataFrame:
    df, model_input = _keyed_lines(spark, folder)
    return _exploded(TableEmbed(EMBED_DIMENSION, _weight_table(spark, folder), concat=True).apply(df, model_input), "v")


def _embed_orders(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    done = preprocessed(orders(spark, folder), ORDERS)
    table = [[weight(c, j) for j in range(EMBED_DIMENSION)] for c in range(PRIORITIES)]
    encoding = CategoryEmbed(kind, EMBED_DIMENSION, {"o_orderpriority": table}, {"o_orderpriority": [0.1, 0.2, 0.3]})
    return _exploded(encoding.apply(done.df, done.model_input), "v")


def embed_onehot(spark: SparkSession, folder: str) -> DataFrame:
    return _embed_orders(spark, folder, "dense")


def embed_projection(spark: SparkSession, folder: str) -> DataFrame:
    return _embed_orders(spark, folder, "projection")


def embed_lookup(spark: SparkSession, folder: str) -> DataFrame:
    done = preprocessed(events(spark, folder), EVENTS)
    table = [[weight(c, j) for j in range(EMBED_DIMENSION)] for c in range(LEVELS + 1)]
    encoding = CategoryEmbed("lookup", EMBED_DIMENSION, {"user_id": table})
    return _exploded(encoding.apply(done.df, done.model_input), "v")


def fit_parts(spark: SparkSession, folder: str) -> DataFrame:
    """A fit of the events that arrive in parts: each is reduced once, the fit reads what was kept of them."""
    indexed = events(spark, folder)
    state, n = FitState(spark, staging_path(spark, "fit-state")), first_eval_row(indexed.n_rows, FRACTION)
    cuts = [n * i // FIT_PARTS for i in range(FIT_PARTS + 1)]
    for i, (start, stop) in enumerate(zip(cuts, cuts[1:])):
        part = sanitise(indexed.between(start, stop), ["value"]).withColumn(TRAIN, F.lit(True))
        state.add(str(i), part, ["value"], ["user_id"])
    number = state.numbers().select("feature", *[r6(c).alias(c) for c in ("min", "range")])
    level = state.levels(LEVELS).select("feature", F.col("n").alias("level"), "cnt", "code")
    return number.unionByName(level, allowMissingColumns=True)


QUERIES = {
    "sanitize": sanitize,
    "dq_nonfinite": dq_nonfinite,
    "fit_numeric": fit_numeric,
    "log_minmax": log_minmax,
    "log_minmax_clip": log_minmax_clip,
    "fit_topk": fit_topk,
    "fit_topk_text": fit_topk_text,
    "fit_parts": fit_parts,
    "encode_int": encode_int,
    "encode_int_unseen0": encode_int_unseen0,
    "encode_onehot": encode_onehot,
    "levels_per_feature": levels_per_feature,
    "preprocess": preprocess_lineitem,
    "shape_report": shapes,
    "concat_vector": concat_vector,
    "embed_record": embed_record,
    "embed_table": embed_table,
    "embed_table_concat": embed_table_concat,
    "embed_onehot": embed_onehot,
    "embed_projection": embed_projection,
    "embed_lookup": embed_lookup,
}

_DIRTY = (
    ordered("customer", "c_custkey")
    + f", d AS (SELECT *, ({DIRTY_SQL})[row_idx % {len(DIRTY)} + 1] AS x FROM o)"
)
_TEXT_LEVELS = (
    ordered("orders", "o_orderkey")
    + ", "
    + codes("o_orderpriority", "o", "kp", 3)
    + ", "
    + codes("o_orderstatus", "o", "ks", 3)
)
_ORDER_EMBED = (
    f"WITH {ORDER_ENCODED} SELECT row_idx, 0 AS dim, {rd('price')} AS v FROM e UNION ALL "
    f"SELECT row_idx, CAST(j + 1 AS INTEGER) AS dim, {rd(weight_sql('code - 1', 'j') + ' {bias}')} AS v "
    f"FROM e CROSS JOIN range({EMBED_DIMENSION}) t(j)"
)
_KEYED = (
    f"WITH {LINE_ROWS}, d AS (SELECT row_idx, CAST(j AS INTEGER) AS j, l_quantity, l_discount, l_partkey + 1 AS l_partkey, "
    f"l_suppkey + 1 AS l_suppkey FROM o JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey "
    f"CROSS JOIN range({EMBED_DIMENSION}) t(j))"
)
_FINITE = "c_acctbal - mn + 1"

ORACLE = {
    "sanitize": f"WITH {_DIRTY} SELECT c_custkey, {clean('c_acctbal', str(BALANCE_LIMIT))} AS c_acctbal, "
    f"{clean('x')} AS x FROM d",
    "dq_nonfinite": f"WITH {_DIRTY}, f AS (SELECT min(c_acctbal) AS mn, max(c_acctbal) - min(c_acctbal) AS rg FROM d "
    f"WHERE is_train), s AS (SELECT x, {clean('x')} AS x_clean, {minmax('c_acctbal', 'mn', 'rg')} AS b "
    "FROM d CROSS JOIN f) SELECT 'x' AS feature, count(*) FILTER (WHERE x IS NULL OR NOT isfinite(x)) AS nonfinite "
    "FROM s UNION ALL SELECT 'x_clean', count(*) FILTER (WHERE NOT isfinite(x_clean)) FROM s "
    "UNION ALL SELECT 'c_acctbal', count(*) FILTER (WHERE NOT isfinite(b)) FROM s",
    "fit_numeric": f"WITH {LINE_FIT} "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS feature, {rd('lo_' + x)} AS min, {rd('rg_' + x)} AS range FROM f" for x in LINE_NUMBERS
    ),
    "log_minmax": f"WITH {LINE_ENCODED} SELECT row_idx, "
    + ", ".join(f"{rd(x)} AS {x}" for x in LINE_NUMBERS)
    + " FROM e",
    "log_minmax_clip": "WITH f AS (SELECT min(c_acctbal) AS mn, max(c_acctbal) - min(c_acctbal) AS rg FROM customer "
    f"WHERE c_acctbal >= 0), s AS (SELECT c_custkey, {minmax('c_acctbal', 'mn', 'rg')} AS b FROM customer CROSS JOIN f) "
    f"SELECT c_custkey, CASE WHEN isfinite(b) THEN {rd('b')} END AS plain, CASE WHEN isnan(b) THEN 'nan' "
    f"WHEN b < -1e300 THEN '-inf' ELSE 'finite' END AS kind, CASE WHEN NOT isnan(b) THEN "
    f"{rd('greatest(0.0, least(1.0, b))')} END AS clipped FROM s",
    "fit_topk": f"WITH {EVENT_LABELS}, {codes('user_id', 'c', 'k')} "
    "SELECT 'user_id' AS feature, level, cnt, code FROM k",
    "fit_topk_text": f"WITH {_TEXT_LEVELS} SELECT 'o_orderpriority' AS feature, level, cnt, code FROM kp "
    "UNION ALL SELECT 'o_orderstatus', level, cnt, code FROM ks",
    "fit_parts": f"WITH {EVENT_SCALED}, {codes('user_id', 'c', 'k')} SELECT 'value' AS feature, {rd('mn')} AS min, "
    f"{rd('rg')} AS range, CAST(NULL AS BIGINT) AS level, CAST(NULL AS BIGINT) AS cnt, CAST(NULL AS INTEGER) AS code FROM f "
    "UNION ALL SELECT 'user_id', NULL, NULL, level, cnt, CAST(code AS INTEGER) FROM k",
    "encode_int": f"WITH {EVENT_ENCODED} SELECT row_idx, CAST(code AS INTEGER) AS user_id FROM e",
    "encode_int_unseen0": f"WITH {EVENT_LABELS}, {codes('user_id', 'c', 'k')} "
    "SELECT row_idx, CAST(coalesce(code, 0) AS INTEGER) AS user_id FROM c LEFT JOIN k ON user_id = level",
    "encode_onehot": f"WITH {ORDER_ENCODED} SELECT row_idx, "
    + ", ".join(f"CAST(code = {j} AS INTEGER) AS o_orderpriority_{j}" for j in range(1, PRIORITIES + 1))
    + " FROM e",
    "levels_per_feature": f"WITH {LINE_ENCODED} SELECT 'l_suppkey' AS feature, count(DISTINCT l_suppkey) AS levels "
    "FROM e UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) FROM e",
    "preprocess": f"WITH {LINE_ENCODED} SELECT row_idx, is_train, y_raw, "
    + ", ".join(f"{rd(x)} AS {x}" for x in LINE_NUMBERS)
    + ", CAST(l_suppkey AS INTEGER) AS l_suppkey, CAST(l_linenumber AS INTEGER) AS l_linenumber FROM e",
    "shape_report": "SELECT count(*) AS in_rows, CAST(11 AS BIGINT) AS in_columns, count(*) AS out_rows, "
    "CAST(8 AS BIGINT) AS out_columns FROM lineitem",
    "concat_vector": f"WITH {ORDER_ENCODED} SELECT row_idx, 0 AS dim, {rd('price')} AS v FROM e UNION ALL "
    "SELECT row_idx, CAST(j AS INTEGER) AS dim, CASE WHEN code = j THEN 1.0::DOUBLE ELSE 0.0 END AS v "
    f"FROM e CROSS JOIN range(1, {PRIORITIES + 1}) t(j)",
    "embed_record": f"WITH {LINE_ENCODED} SELECT row_idx, CAST(j AS INTEGER) AS dim, "
    + rd(
        "(j + 1) / 10.0::DOUBLE"
        + "".join(f" + {x} * {weight_sql(str(i), 'j')}" for i, x in enumerate(LINE_NUMBERS))
        + f" + {weight_sql(f'{len(LINE_NUMBERS)} + l_suppkey - 1', 'j')}"
        + f" + {weight_sql(f'{len(LINE_NUMBERS) + LEVELS} + l_linenumber - 1', 'j')}"
    )
    + f" AS v FROM e CROSS JOIN range({EMBED_DIMENSION}) t(j)",
    "embed_table": f"{_KEYED} SELECT row_idx, j AS dim, "
    + rd(
        "(j + 1) / 10.0::DOUBLE"
        + "".join(f" + {x} * {weight_sql(str(NUMERIC_CODE + KEYED_SHIFT[x]), 'j')}" for x in KEYED_NUMBERS)
        + "".join(f" + {weight_sql(f'{x} + {KEYED_SHIFT[x]}', 'j')}" for x in KEYED_TABLES)
    )
    + " AS v FROM d",
    "embed_table_concat": f"{_KEYED} "
    + " UNION ALL ".join(
        [f"SELECT row_idx, {i} AS dim, {rd(x)} AS v FROM d WHERE j = 0" for i, x in enumerate(KEYED_NUMBERS)]
        + [
            f"SELECT row_idx, CAST(j + {len(KEYED_NUMBERS) + i * EMBED_DIMENSION} AS INTEGER), "
            f"{rd(weight_sql(f'{x} + {KEYED_SHIFT[x]}', 'j'))} FROM d"
            for i, x in enumerate(KEYED_TABLES)
        ]
    ),
    "embed_onehot": _ORDER_EMBED.format(bias="+ (j + 1) / 10.0::DOUBLE"),
    "embed_projection": _ORDER_EMBED.format(bias=""),
    "embed_lookup": f"WITH {EVENT_ENCODED} SELECT row_idx, 0 AS dim, {rd('scaled')} AS v FROM e UNION ALL "
    f"SELECT row_idx, CAST(j + 1 AS INTEGER) AS dim, {rd(weight_sql('code', 'j'))} AS v "
    f"FROM e CROSS JOIN range({EMBED_DIMENSION}) t(j)",
}
