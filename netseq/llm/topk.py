"""Exact top-k search by inner product: a ball tree with branch and bound in every shard.

Vectors are dealt to shards; queries go to all shards in blocks. Each (shard, block) builds the shard's ball
tree and descends it with the whole block: children are visited in the order of their upper bounds, and a
query leaves a node whose bound cannot beat its k-th best. That k-th best is shared: a first pass over one
shard per query gives a bound that all shards start from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netseq.session import stage

# Vectors that one task holds as candidates, and queries it holds as a block.
SHARD_ROWS = 1 << 16
BLOCK_ROWS = 1 << 16

# Small tables are still dealt to this many shards, to occupy a cluster.
LEAST_SHARDS = 64

LEAF_ROWS = 128

NO_ID = np.iinfo(np.int64).max
NO_SCORE = np.iinfo(np.int64).min


@dataclass
class Node:
    rows: np.ndarray | None  # of a leaf
    centre: np.ndarray
    radius: float
    smallest_id: int
    children: tuple["Node", ...] = ()


def build_tree(vectors: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Node:
    """Ball tree over the rows: halves along the line between two far points, down to small leaves."""

    def grow(rows: np.ndarray) -> Node:
        own = vectors[rows]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        found = Node(None, centre, float(away.max()), int(ids[rows].min()))
        if len(rows) <= leaf_rows:
            found.rows = rows[np.argsort(ids[rows], kind="stable")]
            return found
        first = own[away.argmax()]
        second = own[((own - first) ** 2).sum(axis=1).argmax()]
        middle = len(rows) // 2
        order = np.argpartition(own @ (second - first), middle)
        found.children = (grow(rows[order[:middle]]), grow(rows[order[middle:]]))
        return found

    return grow(np.arange(len(vectors)))


class Search:
    """Top k of a block of queries over one tree; ``worst`` is each query's current k-th (score, id)."""

    def __init__(self, vectors, ids, queries, query_ids, k, worst_score, worst_id):
        self.vectors, self.ids, self.queries, self.query_ids, self.k = vectors, ids, queries, query_ids, k
        self.lengths = np.sqrt((queries**2).sum(axis=1))
        self.worst_score, self.worst_id = worst_score.copy(), worst_id.copy()
        self.given_score, self.given_id = worst_score, worst_id
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))  # query, score, id
        self.visited = 0

    def bound(self, node: Node, active: np.ndarray) -> np.ndarray:
        """No inner product within the ball is above it; widened by the rounding of the sums."""
        exact = self.queries[active] @ node.centre + self.lengths[active] * node.radius
        return exact + 1e-9 * (np.abs(exact) + 1) + 1e-9 * self.lengths[active] * (np.abs(node.centre).max(initial=0.0) + node.radius)

    def descend(self, node: Node, active: np.ndarray) -> None:
        top = self.bound(node, active)
        worst = self.worst_score[active].astype(np.float64)
        # an equal score only enters by a smaller id
        can = (top >= worst + 1) | ((top >= worst) & (node.smallest_id <= self.worst_id[active]))
        active = active[can]
        if not len(active):
            return
        if node.rows is not None:
            self.leaf(node.rows, active)
            return
        left, right = node.children
        to_left = self.bound(left, active) >= self.bound(right, active)
        for one, other, group in ((left, right, active[to_left]), (right, left, active[~to_left])):
            if len(group):
                self.descend(one, group)
                self.descend(other, group)

    def leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        self.visited += len(rows) * len(active)
        scores = np.rint(self.queries[active] @ self.vectors[rows].T).astype(np.int64)
        ids = self.ids[rows]
        worst = self.worst_score[active][:, None]
        better = (scores > worst) | ((scores == worst) & (ids[None, :] <= self.worst_id[active][:, None]))
        better &= ids[None, :] != self.query_ids[active][:, None]
        at, which = np.nonzero(better)
        if len(at):
            self.merge(active[at], scores[at, which], ids[which])

    def merge(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.zeros(len(self.queries), bool)
        touched[query] = True
        again = touched[self.best[0]]
        parts = [np.concatenate([old[again], new]) for old, new in zip(self.best, (query, score, ids))]
        order = np.lexsort((parts[2], -parts[1], parts[0]))
        query, score, ids = (p[order] for p in parts)
        start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
        keep = place < self.k
        full = place == self.k - 1
        who, their_score, their_id = query[full], score[full], ids[full]
        closer = (their_score > self.given_score[who]) | ((their_score == self.given_score[who]) & (their_id < self.given_id[who]))
        who = who[closer]
        self.worst_score[who], self.worst_id[who] = their_score[closer], their_id[closer]
        self.best = tuple(np.concatenate([old[~again], new[keep]]) for old, new in zip(self.best, (query, score, ids)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column times 64, rounded down; shorter rows are filled with zeros."""
    column = column.combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    values = np.floor(64 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    counts = np.diff(column.offsets.to_numpy()) if len(column) else np.empty(0, np.int64)
    found = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), counts)
    place = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    found[row, place] = values
    return found


def _width(column: pa.ChunkedArray) -> int:
    lengths = pa.compute.list_value_length(column)
    return pa.compute.max(lengths).as_py() or 0


OUT = "query_row long, query_id long, vec_id long, score long"


def _search(k: int):
    import pyarrow.compute  # noqa: F401

    empty = pa.schema([(c, pa.int64()) for c in ("query_row", "query_id", "vec_id", "score")]).empty_table()

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return empty
        width = max(_width(candidates["vec"]), _width(queries["query_vec"]), 1)
        x, q = _matrix(candidates["vec"], width), _matrix(queries["query_vec"], width)
        if np.abs(x).max() * np.abs(q).max() * width >= 2.0**53:
            raise OverflowError("inner products beyond 2**53 are not exact in doubles")
        ids, query_ids = candidates["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        search = Search(x, ids, q, query_ids, k, queries["worst_score"].to_numpy(), queries["worst_id"].to_numpy())
        search.descend(build_tree(x, ids), np.arange(len(q)))
        at, score, found = search.best
        return pa.table(
            {"query_row": queries["query_row"].to_numpy()[at], "query_id": query_ids[at], "vec_id": found, "score": score}
        )

    return run


def usable(vec: Column) -> Column:
    """Vectors that are neither null nor hold a null or non-finite component."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vec.isNotNull() & finite, F.lit(False))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding",
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, least_shards: int = LEAST_SHARDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best partners of every row where ``is_query`` holds.

    The score is the inner product of floor(64 * x); ties go to the smaller key. Rows with the query's own
    key are no partners. Null keys and unusable vectors take no part; of unequal lengths the shorter vector
    counts as filled with zeros. Repeated rows are partners, and queries, each for itself. Fewer than k
    partners give fewer ranks, an empty table no rows.
    """
    rows = vectors.filter(F.col(key).isNotNull() & usable(F.col(vec))).select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(vec).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    )
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1))).first()
    shards, blocks = max(least_shards, -(-n // shard_rows)), max(1, -(-n_queries // block_rows))
    dealt = rows.select("vec_id", "vec", F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    queries = rows.filter("is_query").select(
        F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vec").alias("query_vec"),
        F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).alias("block"),
    )
    unknown = [F.lit(NO_SCORE).alias("worst_score"), F.lit(NO_ID).alias("worst_id")]
    blocked = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def against(asked: DataFrame) -> DataFrame:
        return blocked.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_search(k), OUT)

    order = [F.desc("score"), F.asc("vec_id")]
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(*order))
    home = queries.withColumn("shard", F.pmod(F.xxhash64("query_row", F.lit(2)), F.lit(shards)))
    bounds = against(home.select("*", *unknown)).withColumn("rank", rank).filter(F.col("rank") == k)
    bounds = bounds.select("query_row", F.col("score").alias("worst_score"), F.col("vec_id").alias("worst_id"))
    bounded = queries.join(bounds, "query_row", "left").na.fill({"worst_score": NO_SCORE, "worst_id": NO_ID})
    everywhere = bounded.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")))
    found = against(everywhere).withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
