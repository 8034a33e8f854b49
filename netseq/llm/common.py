"""Column helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# A join side is hinted for broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 64 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_text(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def checked_side(df: DataFrame, n_rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint for a side whose counted size is small; beyond that the optimiser picks the join."""
    return df.hint("broadcast") if n_rows * row_bytes <= BROADCAST_BYTES else df
