"""Jaccard join over word n-grams by grouped prefixes.

Documents with equal sets are one node. A node's tokens are the hashes of its n-grams; the smallest hashes
are its prefix. Two nodes that are similar enough must share a counted number of prefix tokens, so pairs come
from the groups of nodes under one token, and their counts decide which are verified.

Tokens under which more than ``RARE`` nodes stand are not paired. A node loses nothing by that unless many
of its prefix tokens are such; those nodes are joined again among themselves on all their tokens, rarest
first. There, large groups are nearly always copies of each other: each member is verified against one
pivot, linked members become one component, and only pairs between components that pass the bound on
positions are verified too. So no group is ever paired out, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from netseq.llm.common import checked_side
from netseq.llm.components import components
from netseq.session import stage

# Nodes under a token that are still paired with each other.
RARE = 32

# Tokens are the upper 48 bits of a hash: shorter rows, and still rarely equal by chance.
TOKEN_SHIFT = 16

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass(frozen=True)
class Measure:
    """Link where 100 * intersection >= ``percent`` * union of the sets of ``words``-word shingles."""

    words: int = 5
    percent: int = 80

    def least_overlap(self, n: int) -> int:
        """With any partner, of a set of size ``n``."""
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.least_overlap(n) + 1 if n else 0

    def slack(self, n: int) -> int:
        """Further tokens beyond the prefix, so that some frequent ones may be left unpaired."""
        return self.prefix(n) // 4

    # The same as column expressions.

    def least_overlap_column(self, n: Column) -> Column:
        return F.ceil(n * self.percent / 100.0 - 1e-9).cast("bigint")

    def prefix_column(self, n: Column) -> Column:
        return n - self.least_overlap_column(n) + 1

    def slack_column(self, n: Column) -> Column:
        return F.floor(self.prefix_column(n) / 4)

    def held_column(self, n: Column) -> Column:
        """Tokens of a set that are indexed."""
        return F.least(n, self.prefix_column(n) + self.slack_column(n))

    def overlap_column(self, a: Column, b: Column) -> Column:
        """Least intersection of two linked sets of these sizes."""
        return F.ceil((a + b) * self.percent / (100.0 + self.percent) - 1e-9).cast("bigint")

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in lower case (A-Z only).

    Fewer words than a shingle form one shingle; no words form none.
    """
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    of_words = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    width = min(words, len(found))
    n = len(found) - width + 1
    with np.errstate(over="ignore"):
        mixed = np.full(n, np.uint64(width))
        for i in range(width):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_MULTIPLIERS[0]) + of_words[i : i + n]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(_MULTIPLIERS[1])
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(_MULTIPLIERS[2])
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def set_digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=16).digest()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _tokens(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(TOKEN_SHIFT)).astype(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def signatures(slim: DataFrame, measure: Measure) -> DataFrame:
    """(key, n, digest, tokens) of every row of (key, text): size, digest and smallest hashes of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, held = [], [], []
            for x in batch.column("text"):
                found = shingles(x.as_py(), measure.words)
                n = len(found)
                sizes.append(n)
                digests.append(set_digest(found))
                held.append(_tokens(found[: measure.prefix(n) + measure.slack(n)]))
            arrays = [batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(held)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "n", "digest", "tokens"])

    schema = T.StructType(
        [slim.schema["key"], T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()),
         T.StructField("tokens", T.ArrayType(T.LongType()))]
    )
    return slim.mapInArrow(run, schema)


class Join:
    """One run over a table (key, text)."""

    def __init__(self, slim: DataFrame, measure: Measure):
        self.slim, self.measure = slim, measure
        rows = stage(signatures(slim, measure), "ngram-signatures")
        self.rows = rows.select("key", "n", "digest")
        classes = rows.filter("n > 0").groupBy("digest").agg(
            F.min("key").alias("key"), F.first("n").alias("n"), F.first("tokens").alias("tokens")
        )
        nodes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "ngram-nodes")
        self.nodes = nodes.select("node", "digest", "key", "n")
        postings = nodes.select("node", "n", F.explode("tokens").alias("token"))
        counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        self.shared = stage(postings.join(counts, "token"), "ngram-shared")

    def texts_of(self, wanted: DataFrame) -> DataFrame:
        """Staged (node, text) of the nodes in ``wanted`` (node): one text of each, found by key and digest."""
        keys = self.nodes.join(wanted, "node", "left_semi").select("node", "key", "digest")
        keys = stage(keys, "ngram-wanted")
        side = checked_side(keys, keys.count(), 96).withColumnsRenamed({"key": "of", "digest": "wanted"})
        met = self.slim.join(side, F.col("key").eqNullSafe(F.col("of"))).select("node", "wanted", "text")
        words = self.measure.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                same = [
                    set_digest(shingles(x.as_py(), words)) == d.as_py()
                    for x, d in zip(batch.column("text"), batch.column("wanted"))
                ]
                yield batch.select(["node", "text"]).filter(pa.array(same, pa.bool_()))

        right = met.mapInArrow(run, "node long, text string")
        return stage(right.groupBy("node").agg(F.first("text").alias("text")), "ngram-texts")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Staged links (a, b) among candidate pairs (a, b)."""
        pairs = stage(pairs.select("a", "b"), "ngram-pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        texts = self.texts_of(ends)
        one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
        words, percent = self.measure.words, self.measure.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, of_last = None, None  # rows of one node stand together after the join
            for batch in batches:
                a, b = batch.column("a"), batch.column("b").to_pylist()
                keep = []
                for i, (x, y) in enumerate(zip(batch.column("text_a"), batch.column("text_b"))):
                    if b[i] != last:
                        last, of_last = b[i], shingles(y.as_py(), words)
                    keep.append(linked(shingles(x.as_py(), words), of_last, percent))
                yield pa.RecordBatch.from_arrays([a, batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return stage(both.mapInArrow(run, "a long, b long"), "ngram-links")

    def rare_pairs(self, frequent: DataFrame) -> DataFrame:
        """Pairs under tokens of at most RARE nodes whose shared tokens can make up the least overlap.

        Of the node whose largest indexed hash is the smaller one, every common token among the indexed ones
        is indexed by both. So the intersection is at most the indexed tokens in common plus the tokens that
        one side has not indexed; of those in common, at most all frequent tokens of a node went uncounted.
        """
        m = self.measure
        groups = self.shared.filter(F.col("df") <= RARE).groupBy("token").agg(
            F.sort_array(F.collect_list(F.struct("node", "n"))).alias("group")
        )
        a, b = F.col("x.node"), F.col("y.node")
        pairs = (
            groups.select("group", F.posexplode("group").alias("i", "x"))
            .select("x", F.explode(F.slice("group", F.col("i") + 2, F.lit(RARE))).alias("y"))
            .filter(m.sizes_fit(F.col("x.n"), F.col("y.n")) & (a != b))
            .groupBy(a.alias("a"), b.alias("b"))
            .agg(F.count(F.lit(1)).alias("common"), F.first("x.n").alias("n_a"), F.first("y.n").alias("n_b"))
        )
        n_frequent = frequent.count()
        for end in ("a", "b"):
            side = frequent.select(F.col("node").alias(end), F.col("frequent").alias(f"f_{end}"))
            pairs = pairs.join(checked_side(side, n_frequent, 16), end, "left")
        a, b = F.col("n_a"), F.col("n_b")
        outside = F.greatest(a - m.held_column(a), b - m.held_column(b))
        uncounted = F.least(F.coalesce("f_a", F.lit(0)), F.coalesce("f_b", F.lit(0)))
        return pairs.filter(F.col("common") + uncounted + outside >= m.overlap_column(a, b))

    def heavy_prefixes(self, frequent: DataFrame) -> DataFrame:
        """Staged (token, node, n, rank) of the prefixes, rarest token first, of all nodes that may have lost
        pairs to frequent tokens; tokens that no other such node has are counted but not listed."""
        m = self.measure
        least = m.least_overlap_column(F.col("n"))
        heavy = frequent.join(self.nodes.select("node", "n"), "node").filter(F.col("frequent") > m.slack_column(least))
        texts = self.texts_of(heavy.select("node"))
        words = m.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = [_tokens(shingles(x.as_py(), words)) for x in batch.column("text")]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("node"), sizes, _lists(sets)], names=["node", "n", "tokens"])

        sets = stage(texts.mapInArrow(run, "node long, n long, tokens array<long>"), "ngram-heavy")
        postings = sets.select("node", "n", F.explode("tokens").alias("token"))
        counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        own = Window.partitionBy("node")
        rank = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "token")) - 1
        ranked = postings.join(counts, "token").withColumn("rank", rank)
        return stage(ranked.filter(F.col("rank") < m.prefix_column(F.col("n"))).select("token", "node", "n", "rank"), "ngram-prefixes")

    def star_pairs(self, prefixes: DataFrame) -> DataFrame:
        """Every node with the pivot of each of its tokens: the node that has the token earliest."""
        pivot = F.min(F.struct((F.col("rank") / F.col("n")).alias("at"), "node", "n")).alias("pivot")
        pivots = stage(prefixes.groupBy("token").agg(pivot, F.count(F.lit(1)).alias("df")).filter("df > 1"), "ngram-pivots")
        met = prefixes.join(pivots.select("token", "pivot"), "token").filter(F.col("node") != F.col("pivot.node"))
        met = met.filter(self.measure.sizes_fit(F.col("n"), F.col("pivot.n")))
        return met.select(F.col("node").alias("a"), F.col("pivot.node").alias("b")).distinct()

    def cross_pairs(self, prefixes: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs under one token, in different components, whose first common token may be this one."""
        m = self.measure
        held = prefixes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        held = stage(held, "ngram-placed")
        mixed = held.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        mixed = stage(held.join(stage(mixed.select("token"), "ngram-mixed"), "token"), "ngram-cross")
        x = mixed.select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "rank", "root")])
        y = mixed.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "rank", "root")])
        a, b = F.col("n_a"), F.col("n_b")
        left = F.least(a - F.col("rank_a"), b - F.col("rank_b"))
        fits = m.sizes_fit(a, b) & (left >= m.overlap_column(a, b))
        met = x.join(y, "token").filter((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & fits)
        return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()

    def roots(self) -> DataFrame:
        """(node, root) of all nodes that have a link."""
        frequent = self.shared.filter(F.col("df") > RARE).groupBy("node").agg(F.count(F.lit(1)).alias("frequent"))
        frequent = stage(frequent, "ngram-frequent")
        links = self.verified(self.rare_pairs(frequent))
        prefixes = self.heavy_prefixes(frequent)
        links = links.unionByName(self.verified(self.star_pairs(prefixes)))
        first = components(links)
        across = self.verified(self.cross_pairs(prefixes, first))
        if across.isEmpty():
            return first
        return components(links.unionByName(across))

    def result(self) -> DataFrame:
        """(key, n, digest, component, root) of every row; the root is null without shingles."""
        roots = self.roots()
        placed = self.nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = stage(placed.select("digest", "key", "root"), "ngram-roots")
        smallest = stage(placed.groupBy("root").agg(F.min("key").alias("component")), "ngram-smallest")
        named = placed.join(smallest, "root").select("digest", "component", "root")
        named = stage(named, "ngram-named")
        rows = self.rows.join(named, "digest", "left")
        component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key"))
        return rows.select("key", "n", "digest", component.alias("component"), "root")


def jaccard_components(docs: DataFrame, measure: Measure, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id (the smallest key reachable by links), digest.

    Null and empty texts have no shingles and are linked with nothing: their component is their own key.
    Rows with equal sets, repeated rows among them, share a component. Null keys take part and name a
    component only if it has no other key. An empty table gives no rows.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = Join(slim, measure).result()
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "digest")


def keep_one(docs: DataFrame, measure: Measure, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest key, null last.

    Rows without shingles stay. Rows are told apart by key; where keys repeat or are null, by key and set, so
    of repeated rows one stays. Only the keys of dropped rows meet the texts, so these are not shuffled while
    such keys are few.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = stage(Join(slim, measure).result(), "keep-rows")
    repeated = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR key IS NULL")
    repeated = stage(repeated.select(F.col("key").alias("__of")), "keep-repeated")
    dropped = found.filter(F.col("n") > 0).filter(~F.col("key").eqNullSafe(F.col("component")))
    dropped = stage(dropped.filter("key IS NOT NULL").select(F.col("key").alias("__of")).distinct(), "keep-dropped")
    n_repeated = repeated.count()
    away = dropped.unionByName(repeated) if n_repeated else dropped
    side = checked_side(away, dropped.count() + n_repeated, 16)
    kept = docs.filter(F.col(key).isNotNull()).join(side, F.col(key) == F.col("__of"), "left_anti")
    if not n_repeated:
        return kept

    again = docs.join(checked_side(repeated, n_repeated, 16), F.col(key).eqNullSafe(F.col("__of")), "left_semi")
    names, words = docs.columns, measure.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), words) for x in batch.column(text).cast(pa.string())]
            digests = pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, digests], names=[*names, "__digest"])

    told = again.mapInArrow(run, T.StructType([*docs.schema, T.StructField("__digest", T.BinaryType())]))
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "digest")).alias("first")
    keepers = found.filter("n > 0").groupBy("root").agg(first).select(
        F.col("first.key").alias("__key"), F.col("first.digest").alias("__kept")
    )
    stay = told.join(keepers, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__digest") == F.col("__kept")), "left_semi")
    stay = stay.dropDuplicates([key, "__digest"]).unionByName(told.filter("__digest IS NULL"))
    return kept.unionByName(stay.drop("__digest"))
