"""How filters of a corpus overlap, for every order of applying them.

One table per filter holds the ids of the rows that fail it. What a filter removes after others is its own table
left-anti joined with theirs; label losses are left-semi joins. Which rows earlier filters have removed depends
on their set, not on their order, so each set is joined once and all orders read it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netseq.llm.common import whole_text
from netseq.session import stage, staging_path

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_NOT_CAPITALS = bytes(b for b in range(256) if b not in _CAPITALS)
_CONTINUED = bytes(range(0x80, 0xC0))  # of UTF-8, within a code point
_NOT_SIGNS = bytes(b for b in range(256) if b not in b"#$%&*|")


def failed_by_text(raw: bytes) -> str:
    """Names of the filters A to D that a text fails."""
    words = raw.split()  # of bytes: at ASCII white space
    return "".join(
        name
        for name, fails in (
            ("A", len(words) < LEAST_WORDS),
            ("B", 100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)),
            ("C", 100 * len(raw.translate(None, _NOT_CAPITALS)) > MOST_CAPITALS_PERCENT * len(raw.translate(None, _CONTINUED))),
            ("D", bool(raw.translate(None, _NOT_SIGNS))),
        )
        if fails
    )


def measured(docs: DataFrame, part: str, key: str, text: str) -> DataFrame:
    """Staged table (row, part, key, digest, failed): rows numbered, texts read once."""
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(key).alias("key"), whole_text(text).cast("binary").alias("text"),
    )
    schema = f"row long, part string, key {slim.schema['key'].dataType.simpleString()}, digest binary, failed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, failed = [], []
            for t in batch.column("text"):
                raw = t.as_py()
                digests.append(hashlib.sha256(raw).digest())
                failed.append(failed_by_text(raw))
            columns = [*(batch.column(c) for c in ("row", "part", "key")), pa.array(digests, pa.binary()), pa.array(failed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "part", "key", "digest", "failed"])

    return stage(slim.mapInArrow(run, schema), "filter-facts")


def failing(facts: DataFrame) -> DataFrame:
    """The tables (row, part, key) of failing rows, one folder per filter, told apart by ``filter``.

    Copies are what is left of all rows without the first of each text, so no text's copies meet in one task.
    """
    at = staging_path(facts.sparkSession, "filter-ids")
    named = facts.filter("key IS NOT NULL")
    firsts = named.groupBy("digest").agg(F.min("key").alias("key"))
    copies = named.join(firsts, ["digest", "key"], "left_anti").select("row", "part", "key", F.lit("E").alias("filter"))
    others = facts.select("row", "part", "key", F.explode(F.split("failed", "")).alias("filter")).filter("filter <> ''")
    others.unionByName(copies).write.partitionBy("filter").parquet(at)
    schema = facts.select("row", "part", "key").schema.add("filter", "string")
    return facts.sparkSession.read.schema(schema).parquet(at)


def removals(facts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Table (part, filter, before, removed, good_lost, toxic_lost): what each filter removes after each set of
    others, ``before`` naming the set in alphabetical order.

    Sets grow by one filter a round: the rows that a filter still finds after a set, left-anti joined with the ids
    failing one more, are those it finds after both. All filters and sets of a size share a round's join.
    """
    ids = failing(facts)
    rows = ids.withColumn("before", F.lit(""))
    for name, column in (("good", "quality"), ("toxic", "toxic")):
        told = labels.filter(F.col(column) == 1).select(F.col(key).alias("key"))
        lost, other = (rows.join(told, "key", how).withColumn(name, F.lit(how == "left_semi")) for how in ("left_semi", "left_anti"))
        rows = lost.unionByName(other)
    rounds = [stage(rows.drop("key"), "filter-found")]
    fails = ids.select("row", F.col("filter").alias("next"))
    for _ in FILTERS[1:]:
        wider = F.filter(F.lit(list(FILTERS)), lambda f: (f > F.right("before", F.lit(1))) & (f != F.col("filter")))
        left = rounds[-1].withColumn("next", F.explode(wider)).join(fails, ["row", "next"], "left_anti")
        rounds.append(stage(left.withColumn("before", F.concat("before", "next")).drop("next"), "filter-found"))
    counted = reduce(DataFrame.unionByName, rounds).groupBy("part", "filter", "before")
    return stage(counted.agg(F.count("*").alias("removed"), F.count_if("good").alias("good_lost"), F.count_if("toxic").alias("toxic_lost")), "filter-removals")


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``redundant`` rows fail the step's filter but went before; ``unique_fails`` fail no other; ``shapley`` sums the
    filter's removals over all orders. A null part is the empty string, a null text is empty. A row with a null key
    never fails E, nor does another for its sake, and it has no labels; rows with the same key and text are not
    copies of each other; a key counts as good (toxic) if any of its labels says so. Other columns play no part. An
    empty table has no parts and gives no rows.
    """
    facts = measured(docs, part, key, text)
    found = removals(facts, labels, key)
    size = F.length("before")
    # Orders in which the filters before one are a given set, by the size of the set.
    shares = [factorial(n) * factorial(len(FILTERS) - 1 - n) for n in range(len(FILTERS))]
    by_filter = found.groupBy("part", "filter").agg(
        F.sum(F.when(size == 0, F.col("removed"))).alias("n_failing"),
        F.sum(F.when(size == len(FILTERS) - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.element_at(F.lit(shares), size + 1)).alias("shapley"),
    )
    orders = F.lit(["".join(p) for p in permutations(FILTERS)])
    steps = facts.groupBy("part").agg(F.count("*").alias("n_rows")).select("*", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    earlier = F.array_join(F.array_sort(F.split(F.expr("left(filter_order, step - 1)"), "")), "")
    steps = steps.withColumn("filter", F.expr("substr(filter_order, step, 1)")).withColumn("before", earlier)
    joined = steps.join(found, ["part", "filter", "before"], "left").join(by_filter, ["part", "filter"], "left").na.fill(0)
    upto = Window.partitionBy("part", "filter_order").orderBy("step")
    return joined.select(
        "part", "filter_order", "step",
        (F.col("n_rows") - F.sum("removed").over(upto)).alias("kept"),
        "removed",
        (F.col("n_failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost",
        F.col("shapley").cast("bigint").alias("shapley"),
    )
