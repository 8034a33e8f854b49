"""Mixing sources to target weights by weighted sampling without replacement.

Each source gets a budget of words from its weight. Budgets above the size of a source are met by whole
epochs first; the rest is filled from one more epoch in the order of Efraimidis and Spirakis: documents
sorted by exponential keys divided by their quality weight, sizes summed up to the budget. The order is
resolved by cells of the key, so no source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netseq.functions.hashing import HASH_RANGE, hash60
from netseq.llm.common import checked_side, whole_text, word_count
from netseq.session import stage

# The sampling key is cut into cells, and the cell in which a budget ends into cells again: 2 ** (bits *
# levels) cells per source, of which each round counts 2 ** bits.
CELL_BITS = 10
CELL_LEVELS = 2

SEED = 7


def quality_weight(text: Column, size: Column) -> Column:
    """Weight of a document, 0.1 to 1: the share of its characters that are neither digits nor signs."""
    signs = F.regexp_count(text, F.lit(r"[\x21-\x40\x5B-\x60\x7B-\x7E]"))
    share = 1 - signs / F.greatest(F.length(text), F.lit(1))
    return F.when(size > 0, F.greatest(share, F.lit(0.1))).otherwise(F.lit(0.1))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Slim table (key, source, size, weight), staged: texts are read once."""
    whole = whole_text(text)
    counted = docs.select(
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        word_count(whole).alias("size"),
        whole.alias("whole"),
    )
    return stage(counted.select("key", "source", "size", quality_weight(F.col("whole"), F.col("size")).alias("weight")), "mix")


def cyclic_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """(source, source_size, weight) with weights 1 to ``cycle`` dealt by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sizes.withColumn("weight", ((rank - 1) % cycle + 1).cast("bigint"))


def targets(weighted: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Adds ``target``: the total of all sizes shared by weight, at most ``max_epochs`` sizes each.

    The excess of capped sources goes to the others by weight until none is above its cap. Sources are
    capped in the order of cap over weight, so the level is found from running sums over the sources.
    ``weighted`` has one row per source, the mixture's components; that is what one task sorts here.
    """
    cap = F.col("source_size") * max_epochs
    order = [cap / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    summed = weighted.select(
        "*",
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("capped_weight"),
        F.sum("source_size").over(every).alias("total"),
        F.sum("weight").over(every).alias("total_weight"),
    )
    # the words per weight if all sources before this one are capped, and this and the later are not
    level = (F.col("total") - F.col("capped")) / (F.col("total_weight") - F.col("capped_weight"))
    leveled = summed.withColumn("level", F.when(level * F.col("weight") <= cap, level))
    target = F.coalesce(F.least(F.max("level").over(every) * F.col("weight"), cap.cast("double")), cap.cast("double"))
    return leveled.withColumn("target", target).drop("capped", "capped_weight", "total", "total_weight", "level")


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: DataFrame | None = None,
    max_epochs: int = 3,
    whole: bool = False,
    seed: int = SEED,
) -> DataFrame:
    """Per row of ``docs``: key, size, source, source_size, target, taken, copies.

    ``taken`` counts the words the mix takes of a document, repeats included. The last document of the
    fractional epoch is cut where the budget ends; with ``whole`` it is taken or left, whichever comes
    nearer, as are all rows equal to it in key and size. ``copies`` is how often a document is taken. ``weights`` has (source, weight) and gives
    sources it does not list weight 0; by default weights 1, 2, 3 are dealt in turn.

    Null sources form one source, null or empty texts have size 0 and are never taken. Keys, sizes and the
    seed alone order the rows, so reruns agree and rows equal in all of them may stand for each other.
    """
    rows = sized(docs, key, text, source)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        weighted = cyclic_weights(sizes)
    else:
        given = weights.select(F.col("source").alias("s"), F.col("weight").cast("bigint").alias("weight"))
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").na.fill(0, ["weight"])
    plan = targets(weighted.filter("source_size > 0 AND weight > 0"), max_epochs)
    epochs = F.floor(F.col("target") / F.col("source_size"))
    plan = plan.select(
        F.col("source").alias("plan_source"),
        "source_size",
        "target",
        epochs.alias("epochs"),
        (F.floor("target") - epochs * F.col("source_size")).cast("bigint").alias("budget"),
    )
    plan = stage(plan, "mix-plan")
    n_sources, name_length = plan.agg(F.count(F.lit(1)), F.max(F.length("plan_source"))).first()
    width = 64 + 4 * (name_length or 0)

    # u ** (1 / weight) falls as the exponential key -ln(u) / weight grows; its cells are dealt evenly enough
    unit = (hash60(F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("")), F.col("size")) + F.lit(0.5)) / float(HASH_RANGE)
    n_cells = 1 << CELL_BITS * CELL_LEVELS
    keyed = (
        rows.join(checked_side(plan, n_sources, width), F.col("source").eqNullSafe(F.col("plan_source")), "left")
        .drop("plan_source")
        .withColumn("es_key", F.pow(unit, 1 / F.col("weight")))
        .withColumn("cell", F.least(F.floor((1 - F.col("es_key")) * n_cells), F.lit(n_cells - 1)))
    )
    drawn = keyed.filter("budget > 0 AND size > 0")

    def with_edge(rows: DataFrame, edges: DataFrame, how: str) -> DataFrame:
        joined = rows.join(checked_side(edges, n_sources, width), F.col("source").eqNullSafe(F.col("edge_source")), how)
        return joined.drop("edge_source")

    # the cell in which the budget of a source ends, and what the cells before it hold
    edges = None
    for level in range(1, CELL_LEVELS + 1):
        shift = CELL_BITS * (CELL_LEVELS - level)
        part = F.shiftright("cell", shift)
        if edges is None:
            among = drawn.withColumn("before", F.lit(0).cast("bigint"))
        else:
            among = with_edge(drawn, edges, "inner").filter(F.shiftright("cell", shift + CELL_BITS) == F.col("edge"))
            among = among.withColumnRenamed("held", "before").drop("edge")
        cells = among.groupBy("source", part.alias("part")).agg(
            F.sum("size").alias("n"), F.first("budget").alias("budget"), F.first("before").alias("before")
        )
        running = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        upto = F.col("before") + F.sum("n").over(running)
        ends = cells.withColumn("upto", upto).filter("upto >= budget AND upto - n < budget")
        edges = stage(ends.selectExpr("source AS edge_source", "part AS edge", "upto - n AS held"), "mix-edges")
    placed = with_edge(keyed, edges, "left")
    placed = placed.withColumn("on_edge", F.coalesce((F.col("cell") == F.col("edge")) & (F.col("size") > 0), F.lit(False)))
    inside = Window.partitionBy("source", "cell").orderBy(F.desc("es_key"), "key", "size")
    off_edge = placed.filter("NOT on_edge").withColumn("upto", F.lit(None).cast("bigint"))
    if whole:  # rows equal in key and size end at the same place
        on_edge = placed.filter("on_edge").withColumn("upto", F.col("held") + F.sum("size").over(inside))
        equals = F.count(F.lit(1)).over(Window.partitionBy("source", "cell", "es_key", "key", "size"))
        on_edge = on_edge.withColumn("start", F.col("upto") - F.col("size") * equals)
        last = F.when(2 * F.col("budget") >= F.col("upto") + F.col("start"), F.col("size")).otherwise(F.lit(0))
        on_edge = on_edge.withColumn("last", last).drop("start")
    else:
        upto = F.col("held") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        last = F.greatest(F.least(F.col("budget") - F.col("upto") + F.col("size"), F.col("size")), F.lit(0))
        on_edge = placed.filter("on_edge").withColumn("upto", upto).withColumn("last", last)
    off_edge = off_edge.withColumn("last", F.lit(0).cast("bigint"))
    fraction = (
        F.when(F.col("upto").isNotNull(), F.col("last"))
        .when(F.coalesce(F.col("cell") < F.col("edge"), F.lit(False)), F.col("size"))
        .otherwise(F.lit(0))
    )
    taken = F.coalesce(F.col("epochs") * F.col("size"), F.lit(0)) + fraction
    return on_edge.unionByName(off_edge).select(
        F.col("key").alias(key),
        "source",
        "size",
        F.coalesce("source_size", F.lit(0)).cast("bigint").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"),
        taken.cast("bigint").alias("taken"),
        F.when(F.col("size") > 0, F.ceil(taken / F.col("size"))).otherwise(F.lit(0)).cast("int").alias("copies"),
    )


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", max_epochs: int = 3) -> DataFrame:
    """The rows of the mix itself: each row of ``docs`` as often as whole documents of it are taken."""
    mixed = mix(docs, key, text, source, max_epochs=max_epochs, whole=True).filter("copies > 0")
    taken = mixed.groupBy(F.col(key).alias("__key"), F.col(source).alias("__source"), F.col("size").alias("__size")).agg(
        F.max("copies").alias("__copies")
    )
    taken = stage(taken, "mix-copies")
    n, name_length = taken.agg(F.count(F.lit(1)), F.max(F.length("__source"))).first()
    side = checked_side(taken, n, 32 + 4 * (name_length or 0))
    same = (
        F.col(key).eqNullSafe(F.col("__key"))
        & F.col(source).cast("string").eqNullSafe(F.col("__source"))
        & (word_count(whole_text(text)) == F.col("__size"))
    )
    copies = docs.join(side, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return copies.select(*docs.columns)
