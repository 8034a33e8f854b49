"""Conversations as a trie of their prefixes, with totals of every subtree.

Nodes are distinct sequences of first turns. Totals travel from the leaves to the root by time-forward
processing: a task sorts its nodes by falling depth and passes each node's totals to its parent through a
priority queue, which hands them over when the parent's turn comes. Subtrees small enough for one task are
shards; the few nodes above them receive the totals of shard roots in a last pass.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netseq.llm.common import checked_side
from netseq.session import stage

BLOCK = 100  # conversations that share their first conversation's opening turns
OPENINGS = 6

SHARD_ROWS = 200_000  # turns below a node that one shard may hold
TOP_NODES = 50_000  # nodes above the shards
QUEUED = 200_000  # messages that a queue holds in memory
MOST_RUNS = 64  # of a queue, then they become one
CHUNK_BYTES = 1 << 16
DIGEST = 16

ROOT = hashlib.sha256(b"").digest()[:DIGEST]


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): (conv_id, size) and (conv_id, depth, role, text).

    The first h turns of a conversation are replaced by those of the first conversation of its block of 100,
    h = crc32(conv_id) mod 6. Turns are ordered by turn (null first), then role and text.
    """
    filled = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # Rows of one conversation are sorted by the window, out of memory where they are many.
    own = filled.select("conv_id", F.row_number().over(by).alias("n"), "role", "text")
    own = stage(own, "turns")
    sizes = own.groupBy("conv_id").agg(F.max("n").alias("n_own"))
    sizes = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK)
    sizes = sizes.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % OPENINGS).cast("int"))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = sizes.join(of_base, "base", "left")
    convs = convs.withColumn("kept", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = convs.withColumn("size", F.col("kept") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    convs = stage(convs.select("conv_id", "base", "h", "kept", F.col("size").cast("int").alias("size")), "conversations")
    openings = own.filter(F.col("n") < OPENINGS).withColumnRenamed("conv_id", "base")
    first = convs.filter("kept > 0").join(openings, "base").filter("n <= kept").select("conv_id", F.col("n").alias("depth"), "role", "text", "size")
    rest = own.join(convs, "conv_id").filter("n > h").select("conv_id", (F.col("n") - F.col("h") + F.col("kept")).alias("depth"), "role", "text", "size")
    return convs.select("conv_id", "size"), first.unionByName(rest)


def paths(turns: DataFrame) -> DataFrame:
    """Staged table (conv_id, depth, node, parent, points, size): the digests of all prefixes.

    A node's digest is that of its turns written one after the other with their lengths, so one running hash
    per conversation gives all of them.
    """
    schema = "conv_id long, depth int, node binary, parent binary, points long, size int"
    names = ["conv_id", "depth", "node", "parent", "points", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, running, before = None, None, ROOT
        for batch in batches:
            nodes, parents, points = [], [], []
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role"), batch.column("text")):
                if conv != at:
                    at, running, before = conv, hashlib.sha256(), ROOT
                said = text.as_py()
                for raw in (role.as_py().encode(), said.encode()):
                    running.update(struct.pack("<q", len(raw)) + raw)
                parents.append(before)
                before = running.digest()[:DIGEST]
                nodes.append(before)
                points.append(len(said))
            columns = [batch.column("conv_id"), batch.column("depth"), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(points, pa.int64()), batch.column("size")], names=names)

    in_order = turns.withColumn("depth", F.col("depth").cast("int")).repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return stage(in_order.mapInArrow(run, schema), "paths")


class SpillingQueue:
    """Smallest-first queue of (key, children, leaves, saved).

    Beyond a number of messages it writes them as a sorted run to a scratch file of the task. The file has no
    name: it goes with the task, like Spark's own spills, and no other task reads it.
    """

    LAYOUT = f"<{DIGEST + 8}sqqq"
    BYTES = struct.calcsize(LAYOUT)

    def __init__(self, held: int | None = None):
        self.held, self.heap, self.runs = held or QUEUED, [], []

    def push(self, key: bytes, children: int, leaves: int, saved: int) -> None:
        heapq.heappush(self.heap, (key, children, leaves, saved))
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        entries, self.heap = sorted(self.heap), []
        self._next(self._run(entries))
        if len(self.runs) > MOST_RUNS:  # merge the runs into one
            rest, self.runs = self.runs, []
            self._next(self._run(heapq.merge(*[self._whole(*r) for r in rest])))

    def _run(self, entries: Iterable[tuple]) -> Iterator[bytes]:
        file = tempfile.TemporaryFile()
        for entry in entries:
            file.write(struct.pack(self.LAYOUT, *entry))
        file.seek(0)
        return iter(lambda: file.read(self.BYTES), b"")

    def _whole(self, head: tuple, number: int, run: Iterator[bytes]) -> Iterator[tuple]:
        yield head
        yield from (struct.unpack(self.LAYOUT, raw) for raw in run)

    def _next(self, run: Iterator[bytes]) -> None:
        raw = next(run, None)
        if raw:
            heapq.heappush(self.runs, (struct.unpack(self.LAYOUT, raw), id(run), run))

    def pop(self, key: bytes) -> tuple[int, int, int]:
        """Sums of all messages with this key; smaller keys must have been popped before."""
        children = leaves = saved = 0
        while True:
            if self.heap and (not self.runs or self.heap[0] <= self.runs[0][0]):
                if self.heap[0][0] != key:
                    break
                _, c, n, s = heapq.heappop(self.heap)
            elif self.runs and self.runs[0][0][0] == key:
                (_, c, n, s), _, run = heapq.heappop(self.runs)
                self._next(run)
            else:
                break
            children, leaves, saved = children + c, leaves + n, saved + s
        return children, leaves, saved


def turn_of(depth: int, node: bytes) -> bytes:
    """When a node is processed: deeper ones first."""
    return struct.pack(">Q", (1 << 63) - depth) + node


_SUMS = "node binary, parent binary, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, up boolean"


def time_forward(nodes: DataFrame) -> DataFrame:
    """Totals of subtrees. ``nodes`` (node, parent, depth, conv_id, n_convs, points, is_root, in_children, in_leaves,
    in_saved) arrive by falling depth within each partition; what a shard root sums up is marked ``up``."""
    names = [c.split()[0] for c in _SUMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue()
        for batch in batches:
            out = {c: [] for c in ("n_children", "n_leaves", "saved_tokens")}
            columns = [batch.column(c).to_pylist() for c in ("node", "parent", "depth", "n_convs", "points", "is_root", "in_children", "in_leaves", "in_saved")]
            for node, parent, depth, n_convs, points, is_root, children, leaves, saved in zip(*columns):
                c, n, s = queue.pop(turn_of(depth, node))
                children, leaves, saved = children + c, leaves + n, saved + s + (n_convs - 1) * points
                leaves = leaves if children else 1
                if not is_root:
                    queue.push(turn_of(depth - 1, parent), 1, leaves, saved)
                for name, value in zip(out, (children, leaves, saved)):
                    out[name].append(value)
            kept = [batch.column(c) for c in ("node", "parent", "depth", "conv_id", "n_convs")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, pa.int64()) for v in out.values()), batch.column("is_root")], names=names)

    return nodes.mapInArrow(run, _SUMS)


def member_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): the hash of the ascending ids, comma-joined.

    Ids are sorted over all tasks and joined to stretches of bounded length; a node's stretches then pass through
    one running hash, never held together.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size, out = None, None, [], 0, []
        for batch in batches:
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if n != node or size >= CHUNK_BYTES:
                    if held:
                        out.append((node, first, ",".join(held)))
                    node, first, held, size = n, c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
                if len(out) >= 1_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["node", "first", "ids"])
                    out = []
        if held:
            out.append((node, first, ",".join(held)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            out = []
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids")):
                if n != node:
                    if running:
                        out.append((node, running.hexdigest()))
                    node, running = n, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.as_py().encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["node", "ends_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([running.hexdigest()])], names=["node", "ends_sha256"])

    in_order = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    stretches = in_order.mapInArrow(join, "node binary, first long, ids string")
    return stretches.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    conv_id is a node's smallest member, members are the conversations that start with it, and a root stands for no
    turn. n_leaves counts the childless nodes of its subtree; saved_tokens sums, over the subtree, the code points of
    a node's last text times its members but one; ends_sha256 hashes the ascending ids of members that end there.

    Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out; equal turns of
    a conversation are ordered by role and text, repeated rows are turns of their own. A conversation that loses all
    its turns is a member of the root. An empty table has no conversations and gives no rows. Columns other than
    conv_id, turn, role and text play no part.
    """
    convs, rows = rebuilt(turns)
    found = paths(rows)
    nodes = found.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.min("points").alias("points"), F.count("*").alias("n_convs"), F.sum(F.col("size") - F.col("depth") + 1).alias("below"),
    )
    nodes = stage(nodes, "nodes")
    n_rows, limit = found.count(), SHARD_ROWS
    while (n_top := nodes.filter(F.col("below") > limit).count()) > TOP_NODES:
        limit *= 2  # long chains; larger shards change no result
    # A conversation meets its shard's root where it leaves the nodes above the shards.
    top = checked_side(nodes.filter(F.col("below") > limit).select("node"), n_top, 64)
    outside = found.select("conv_id", "depth", "node").join(top, "node", "left_anti")
    roots = outside.groupBy("conv_id").agg(F.min(F.struct("depth", "node")).alias("m")).select("conv_id", F.col("m.node").alias("shard"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("in_children", "in_leaves", "in_saved")]
    below = nodes.filter(F.col("below") <= limit).join(roots, "conv_id")
    n_shards = max(1, min(-(-n_rows // limit) * 2, 1 << 16))
    below = below.select("node", "parent", "depth", "conv_id", "n_convs", "points", (F.col("node") == F.col("shard")).alias("is_root"), *zero, "shard")
    below = below.repartition(n_shards, "shard").sortWithinPartitions(F.desc("depth"), "node").drop("shard")
    lower = stage(time_forward(below), "trie-shards")
    sent = lower.filter("up").groupBy("parent").agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("points"))
    upper = nodes.filter(F.col("below") > limit).select(*root.columns).unionByName(root)
    upper = upper.join(sent.withColumnRenamed("parent", "node"), "node", "left")
    upper = upper.select(*root.columns, (F.col("depth") == 0).alias("is_root"), *[F.coalesce(a, F.lit(0)).cast("bigint").alias(b) for a, b in (("c", "in_children"), ("l", "in_leaves"), ("s", "in_saved"))])
    # At most TOP_NODES nodes and the root.
    upper = stage(time_forward(upper.coalesce(1).sortWithinPartitions(F.desc("depth"), "node")), "trie-top")
    whole = lower.unionByName(upper)
    names = whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")).filter(F.col("parent") != F.lit(ROOT))
    top_id = root.select(F.col("node").alias("parent"), F.col("conv_id").alias("root_conv_id"))
    ends = found.filter("depth = size").select("node", "conv_id")
    ends = ends.unionByName(convs.filter("size = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    joined = whole.join(F.broadcast(top_id), "parent", "left").join(names, "parent", "left").join(member_digests(ends), "node", "left")
    return joined.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"),
        F.coalesce("parent_conv_id", "root_conv_id").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
