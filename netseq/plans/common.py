"""Settings, dataset roles and SQL pieces shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netseq.operators.assemble import Preprocessed, preprocess
from netseq.operators.masks import LABEL, add_label
from netseq.operators.numeric import fit_minmax, sanitise, scaled
from netseq.operators.order import ROW, Indexed, index_rows
from netseq.operators.preprocessing import StandardPreprocessing
from netseq.operators.split import TRAIN, first_eval_row, split_last, training_rows
from netseq.sources.readers import read_table
from netseq.spec import CategoricalFormat, FlowSpec

WINDOW = 8
FRACTION = 0.2
SEED = 42
LEVELS = 32

EVENTS = FlowSpec(("value", "user_id"), ("user_id",), "event_type", "view", order_by=("event_id",))
ORDERS = FlowSpec(
    ("o_totalprice", "o_orderpriority"), ("o_orderpriority",), "o_orderstatus", "F", order_by=("o_orderkey",)
)
LINEITEM = FlowSpec(
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey", "l_linenumber"),
    ("l_suppkey", "l_linenumber"),
    "l_returnflag",
    "N",
    test_column="l_linestatus",
    order_by=(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
    ),
)


def r6(column: Column | str) -> Column:
    """Six digits, without a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def events(spark: SparkSession, folder: str) -> Indexed:
    return index_rows(read_table(spark, folder, "events"), EVENTS.order_by)


def orders(spark: SparkSession, folder: str) -> Indexed:
    return index_rows(read_table(spark, folder, "orders"), ORDERS.order_by)


def lineitem(spark: SparkSession, folder: str) -> Indexed:
    rows = read_table(spark, folder, "lineitem")
    return index_rows(LINEITEM.project(rows), LINEITEM.order_by)


def customer(spark: SparkSession, folder: str) -> Indexed:
    return index_rows(read_table(spark, folder, "customer"), ["c_custkey"])


def labelled_events(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Events with is_train (last rows evaluate), y and the cleaned value; and their number."""
    indexed = events(spark, folder)
    df = add_label(split_last(indexed, FRACTION), EVENTS.class_column, EVENTS.benign_label)
    return sanitise(df, ["value"]), indexed.n_rows


def scaled_events(spark: SparkSession, folder: str) -> tuple[DataFrame, int, int]:
    """(row_idx, is_train, y, scaled), number of rows, first evaluation row."""
    df, n = labelled_events(spark, folder)
    fit = fit_minmax(df, ["value"])["value"]
    return df.select(ROW, TRAIN, LABEL, scaled("value", fit).alias("scaled")), n, first_eval_row(n, FRACTION)


def preprocessed(
    indexed: Indexed, spec: FlowSpec, kind: CategoricalFormat = CategoricalFormat.INTEGERS
) -> Preprocessed:
    return preprocess(
        split_last(indexed, FRACTION),
        spec,
        StandardPreprocessing(LEVELS),
        kind,
        training=training_rows(indexed, FRACTION),
    )


# SQL pieces. Each is one or more common table expressions; later ones read earlier ones.


def h60(text: str) -> str:
    """60-bit hash of a SQL text expression."""
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def rd(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def minmax(value: str, low: str, spread: str) -> str:
    """Log min-max scaling in SQL, with IEEE results below the minimum."""
    shifted = f"({value} - {low} + 1)"
    return (
        f"CASE WHEN {spread} = 0 THEN 0.0 WHEN {shifted} > 0 THEN ln({shifted}) / ln({spread} + 1) "
        f"WHEN {shifted} = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST('NaN' AS DOUBLE) END"
    )


def ordered(table: str, keys: str, fraction: float = FRACTION) -> str:
    """Rows of a table with row_idx, n and is_train."""
    return (
        f"o0 AS (SELECT *, row_number() OVER (ORDER BY {keys}) - 1 AS row_idx, count(*) OVER () AS n FROM {table}), "
        f"o AS (SELECT *, row_idx < n - CAST(floor(n * CAST({fraction} AS DOUBLE)) AS BIGINT) AS is_train FROM o0)"
    )


def clean(column: str, limit: str = "1e9") -> str:
    return f"CASE WHEN abs({column}) <= {limit} THEN CAST({column} AS DOUBLE) ELSE 0.0 END"


def codes(feature: str, rows: str, name: str, levels: int = LEVELS) -> str:
    """Levels of a feature in code order, from the training rows of a CTE."""
    return (
        f"{name} AS (SELECT level, cnt, row_number() OVER (ORDER BY cnt DESC, level) AS code FROM ("
        f"SELECT {feature} AS level, count(*) AS cnt FROM {rows} WHERE is_train AND {feature} IS NOT NULL "
        f"GROUP BY 1) QUALIFY row_number() OVER (ORDER BY cnt DESC, level) <= {levels})"
    )


EVENT_ROWS = ordered("events", "event_id")
EVENT_LABELS = (
    EVENT_ROWS
    + ", c AS (SELECT *, "
    + clean("value")
    + " AS v, event_type IS DISTINCT FROM 'view' AS y FROM o)"
)
EVENT_SCALED = (
    EVENT_LABELS
    + ", f AS (SELECT min(v) AS mn, max(v) - min(v) AS rg FROM c WHERE is_train)"
    + ", s AS (SELECT c.*, "
    + minmax("v", "mn", "rg")
    + " AS scaled FROM c CROSS JOIN f)"
)
EVENT_ENCODED = (
    EVENT_SCALED
    + ", "
    + codes("user_id", "s", "k")
    + ", e AS (SELECT s.*, coalesce(k.code, 1) AS code FROM s LEFT JOIN k ON s.user_id = k.level)"
)
LINE_KEYS = ", ".join(LINEITEM.order_by)
LINE_NUMBERS = LINEITEM.numeric_fields
LINE_ROWS = ordered("lineitem", LINE_KEYS)
LINE_CLEAN = (
    LINE_ROWS
    + ", c AS (SELECT row_idx, n, is_train, l_returnflag, l_linestatus, l_suppkey, l_linenumber, "
    + ", ".join(f"{clean(x)} AS {x}" for x in LINE_NUMBERS)
    + " FROM o)"
)
LINE_FIT = (
    LINE_CLEAN
    + ", f AS (SELECT "
    + ", ".join(f"min({x}) AS lo_{x}, max({x}) - min({x}) AS rg_{x}" for x in LINE_NUMBERS)
    + " FROM c WHERE is_train)"
)
LINE_ENCODED = (
    LINE_FIT
    + ", "
    + codes("l_suppkey", "c", "ks")
    + ", "
    + codes("l_linenumber", "c", "kl")
    + ", e AS (SELECT row_idx, is_train, l_returnflag AS y_raw, "
    + ", ".join(f"{minmax('c.' + x, 'lo_' + x, 'rg_' + x)} AS {x}" for x in LINE_NUMBERS)
    + ", coalesce(ks.code, 1) AS l_suppkey, coalesce(kl.code, 1) AS l_linenumber "
    "FROM c CROSS JOIN f LEFT JOIN ks ON c.l_suppkey = ks.level LEFT JOIN kl ON c.l_linenumber = kl.level)"
)
ORDER_ENCODED = (
    ordered("orders", "o_orderkey")
    + f", c AS (SELECT *, {clean('o_totalprice')} AS v FROM o)"
    + ", f AS (SELECT min(v) AS mn, max(v) - min(v) AS rg FROM c WHERE is_train), "
    + codes("o_orderpriority", "c", "k")
    + ", e AS (SELECT row_idx, is_train, "
    + minmax("v", "mn", "rg")
    + " AS price, coalesce(k.code, 1) AS code FROM c CROSS JOIN f LEFT JOIN k ON c.o_orderpriority = k.level)"
)

CONFUSION = (
    "count(*) FILTER (WHERE y) AS P, count(*) FILTER (WHERE NOT y) AS N, "
    "count(*) FILTER (WHERE pred) AS pred_P, count(*) FILTER (WHERE NOT pred) AS pred_N, "
    "count(*) FILTER (WHERE pred AND y) AS TP, count(*) FILTER (WHERE pred AND NOT y) AS FP, "
    "count(*) FILTER (WHERE NOT pred AND NOT y) AS TN, count(*) FILTER (WHERE NOT pred AND y) AS FN"
)
BAL_ACC = (
    "round((CASE WHEN TP + FN > 0 THEN CAST(TP AS DOUBLE) / (TP + FN) ELSE 0 END"
    " + CASE WHEN TN + FP > 0 THEN CAST(TN AS DOUBLE) / (TN + FP) ELSE 0 END) / 2, 6) + 0.0"
)
F1 = "round(CASE WHEN TP > 0 THEN CAST(2 * TP AS DOUBLE) / (2 * TP + FP + FN) ELSE 0 END, 6) + 0.0"


def trailing_avg(column: str, order: str = "row_idx", window: int = WINDOW) -> str:
    return f"avg({column}) OVER (ORDER BY {order} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"


def window_join(rows: str, columns: str, ends: str, window: int = WINDOW) -> str:
    """Long form of full windows in SQL: one row per end and position."""
    return (
        f"SELECT e.row_idx AS end_idx, CAST(t.pos AS INTEGER) AS pos, {columns} FROM {rows} e "
        f"CROSS JOIN range({window}) t(pos) JOIN {rows} x ON x.row_idx = e.row_idx - {window - 1} + t.pos "
        f"WHERE e.row_idx >= {window - 1} AND ({ends})"
    )
