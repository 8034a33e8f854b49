"""Packing documents into training sequences: concatenate and cut.

The tokens of all documents form one line. A first pass writes each document's ids with its offset within
its partition; prefix sums over the partitions' totals turn these into offsets on the line, which fixed
windows then cut. Every piece between two cuts is one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from netseq.llm.common import checked_side
from netseq.llm.tokens import packed, pieces_of, texts
from netseq.session import staging_path

# Ids that a task holds before it hands them on.
HELD_BYTES = 4 << 20

SEQUENCE = 1024
END = 0


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Staged table (key, ids, n, part, upto): unsigned 32-bit little-endian ids with the end id, their
    number, the partition that wrote them, and the ids of the partition up to and with this document."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType(
        [
            slim.schema["key"],
            T.StructField("ids", T.BinaryType()),
            T.StructField("n", T.LongType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("upto", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, upto, end = pieces_of(path), TaskContext.get().partitionId(), 0, packed([END])
        for batch in batches:
            ids, ns, uptos, first, held = [], [], [], 0, 0
            for i, whole in enumerate(texts(batch, "text")):
                found = known.packed(whole) + end
                upto += len(found) // 4
                ids.append(found)
                ns.append(len(found) // 4)
                uptos.append(upto)
                held += len(found)
                if held >= HELD_BYTES or i + 1 == batch.num_rows:
                    columns = [
                        batch.column("key").slice(first, len(ns)), pa.array(ids, pa.binary()), pa.array(ns, pa.int64()),
                        pa.array([part] * len(ns), pa.int32()), pa.array(uptos, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "n", "part", "upto"])
                    ids, ns, uptos, first, held = [], [], [], i + 1, 0

    spark = docs.sparkSession
    place = staging_path(spark, "packed-ids")
    slim.mapInArrow(run, schema).write.option("compression", "zstd").parquet(place)
    return spark.read.schema(schema).parquet(place)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = SEQUENCE) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, cut_before, cut_after.

    All sequences are full but the last. A null or empty text is the end id alone; repeated rows and null
    keys are documents like any other; an empty table gives no rows. The order of documents is that of the
    scan. ``cut_before`` and ``cut_after`` mark pieces at which a window cut the document.
    """
    rows = encoded(docs, path, key, text)
    totals = rows.groupBy("part").agg(F.max("upto").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("part").alias("of_part"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    offsets = checked_side(offsets, totals.count(), 16)
    placed = rows.join(offsets, F.col("part") == F.col("of_part")).withColumn("at", F.col("base") + F.col("upto") - F.col("n"))

    def piece(s):
        first = F.greatest(s * length, F.col("at"))
        end = F.least((s + 1) * length, F.col("at") + F.col("n"))
        begin, size = first - F.col("at"), end - first
        own = F.substr(F.col("ids"), (begin * 4 + 1).cast("int"), (size * 4).cast("int"))
        return F.struct(
            begin.alias("start"),
            size.alias("length"),
            F.crc32(own).alias("ids_crc32"),
            F.col("n").alias("doc_tokens"),
            s.alias("sequence_id"),
            (first - s * length).alias("offset"),
            (begin > 0).alias("cut_before"),
            (begin + size < F.col("n")).alias("cut_after"),
        )

    windows = F.sequence(F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n") - 1) / length))
    return placed.select(F.col("key").alias(key), F.inline(F.transform(windows, piece)))
