"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netseq.session import stage

MOST_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node named in ``links`` (a, b); nodes of one component share a root.

    In each round a node joins the neighbour, or itself, with the smallest random priority, and links are
    redrawn between those; the number of nodes falls by a constant share on average. Neighbours are reduced
    to one before any shuffle, so a node with many links costs no more than its rows.
    """
    edges = stage(links.filter("a <> b").select("a", "b").distinct(), "links")
    roots = None
    for turn in range(MOST_ROUNDS):
        if edges.isEmpty():
            break

        def ranked(c: str):
            return F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))

        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min(ranked("b")).alias("m"))
        chosen = stage(least.select(F.col("a").alias("node"), F.least(F.col("m"), ranked("a"))["v"].alias("root")), "chosen")
        if roots is None:
            roots = chosen
        else:
            step = chosen.select(F.col("node").alias("of"), F.col("root").alias("next"))
            roots = roots.join(step, F.col("root") == F.col("of"), "left")
            roots = stage(roots.select("node", F.coalesce("next", "root").alias("root")), "roots")
        for end in ("a", "b"):
            step = chosen.select(F.col("node").alias("of"), F.col("root").alias("next"))
            edges = edges.join(step, F.col(end) == F.col("of")).withColumn(end, F.col("next")).select("a", "b")
        edges = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    return links.sparkSession.createDataFrame([], "node long, root long") if roots is None else roots
