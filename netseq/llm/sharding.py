"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash. It starts with one bucket; only buckets above the byte
limit are split on another bit, so small buckets keep short prefixes. A round counts several bits of the
oversized buckets at once and settles the splits that these bits allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netseq.functions.hashing import HASH_BITS, hash60
from netseq.llm.common import checked_side, whole_text
from netseq.session import stage

# Bits that one round looks ahead.
ROUND_BITS = 6

# Bits taken from the key alone; later ones also depend on the row, so that a repeated key splits as well.
KEY_BITS = 24

SHARD_BYTES = 16 << 20


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Slim staged table (key, n_bytes, hash). The row's place is frozen before it enters the hash."""
    slim = docs.select(
        F.col(key).alias("key"),
        F.octet_length(whole_text(text)).cast("bigint").alias("n_bytes"),
        F.monotonically_increasing_id().alias("place"),
    )
    slim = stage(slim, "shard-rows")
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    rest = HASH_BITS - KEY_BITS
    high = F.shiftrightunsigned(hash60(name), rest)
    low = F.shiftrightunsigned(hash60(name, F.col("place")), KEY_BITS)
    return slim.select("key", "n_bytes", F.shiftleft(high, rest).bitwiseOR(low).alias("hash"))


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("hash", HASH_BITS - bits)


def _settle(cells: DataFrame, depth: int, bits: int, limit: int) -> DataFrame:
    """Entry (depth of its bucket) of every cell of ``depth + bits`` leading bits below oversized buckets.

    A cell's bucket is its shortest prefix, longer than ``depth``, whose bytes are within the limit; null
    where even the cell itself is above it. Each cell is counted towards its ``bits`` prefixes.
    """
    deep = depth + bits
    up = cells.select(
        "cell", "bytes", F.explode(F.sequence(F.lit(depth + 1), F.lit(deep))).alias("d")
    ).withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {deep} - d)"))
    sums = up.groupBy("d", "prefix").agg(F.sum("bytes").alias("bytes"))
    small = sums.filter(F.col("bytes") <= limit).select("d", "prefix")
    entry = up.select("cell", "d", "prefix").join(small, ["d", "prefix"]).groupBy("cell").agg(F.min("d").alias("bucket_depth"))
    return cells.select("cell").join(entry, "cell", "left")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Per row of ``docs``: key, n_bytes, shard (the bits of its bucket), shard_depth, shard_bytes, oversized.

    Bytes are those of the text in UTF-8, zero for null. Buckets partition the rows: every row has one
    bucket, and the bits of one are never the start of another's. A single text above the limit stays alone
    in a bucket of full depth marked ``oversized``; repeated keys, null keys among them, split by row. An
    empty table gives no rows. The shard of a whole table within the limit is the empty string.
    """
    rows = _hashed(docs, key, text)
    total, n_open = rows.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
    if (total or 0) <= limit:
        placed = rows.withColumn("depth", F.lit(0))
        return _described(placed, limit)
    open_rows, done, depth = rows, [], 0
    while depth < HASH_BITS:
        bits = min(ROUND_BITS, HASH_BITS - depth)
        cells = open_rows.groupBy(_prefix(depth + bits).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        directory = stage(_settle(stage(cells, "shard-cells"), depth, bits, limit), "shard-directory")
        n_cells, n_above = directory.agg(F.count(F.lit(1)), F.count(F.when(F.col("bucket_depth").isNull(), 1))).first()
        found = open_rows.withColumn("cell", _prefix(depth + bits)).join(checked_side(directory, n_cells, 32), "cell")
        settled = F.col("bucket_depth").isNotNull()
        done.append(found.filter(settled).select("key", "n_bytes", "hash", F.col("bucket_depth").alias("depth")))
        depth += bits
        open_rows = found.filter(~settled).select("key", "n_bytes", "hash")
        if not n_above:
            break
    else:
        done.append(open_rows.withColumn("depth", F.lit(HASH_BITS)))
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    return _described(placed, limit)


def _described(placed: DataFrame, limit: int) -> DataFrame:
    bits = F.lpad(F.bin("hash"), HASH_BITS, "0")
    named = stage(placed.select("key", "n_bytes", F.expr("depth").alias("shard_depth"), bits.alias("bits")), "shards")
    named = named.select("key", "n_bytes", F.expr("substring(bits, 1, shard_depth)").alias("shard"), "shard_depth")
    sums = named.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    sums = stage(sums, "shard-sums")
    n_shards = sums.count()
    return named.join(checked_side(sums, n_shards, 96), "shard").select(
        "key", "n_bytes", "shard", "shard_depth", "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversized")
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Writes the rows of ``docs`` as parquet, one folder per shard, and returns the assignment.

    Keys must be unique here, as the rows are joined to their shards by key.
    """
    placed = stage(assign(docs, key, text, limit), "shard-assignment")
    named = placed.select(F.col("key").alias("__key"), F.col("shard").alias("__shard"))
    (
        docs.join(named, docs[key].eqNullSafe(named["__key"]))
        .drop("__key")
        .withColumn("__shard", F.concat(F.lit("s"), "__shard"))
        .repartition("__shard")
        .write.partitionBy("__shard")
        .parquet(path)
    )
    return placed
