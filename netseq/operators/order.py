"""Dense row order 0..N-1 without a single-partition sort, and scans along that order."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netseq.session import small_side, stage
from netseq.spec import quoted

# Rows that one sort task is given at most, on average.
SORT_ROWS = 500_000

# Indexed tables that a driver remembers, the latest ones.
KEPT_TABLES = 16
_indexed: dict[tuple, Indexed] = {}

# Rows that are looked at before all are: in a table without order they hold a descent already.
FIRST_ROWS = 4_096

ROW = "row_idx"

# Chunk totals are gathered in one place, so their number is bounded whatever the row count.
MAX_CHUNKS = 131_072

# Least rows of a block in a chunk; blocks grow with the root of the chunk.
BLOCK_ROWS = 64


class Indexed(NamedTuple):
    """A frame with a dense ``row_idx`` and its known length.

    When positions come straight from the files, ``source`` is the scan and ``files`` the file index, a staged
    table (file, name, base, rows) with the rows before each file, so that a range of rows can skip the files
    outside it. Only the number of its rows is known to the driver. ``narrow`` is the same for other sources: a frame
    with at least the rows of a range.
    """

    df: DataFrame
    n_rows: int
    source: DataFrame | None = None
    files: DataFrame | None = None
    n_files: int = 0
    narrow: Callable[[int, int], DataFrame] | None = None

    def between(self, start: int = 0, stop: int | None = None) -> DataFrame:
        """Rows with start <= row_idx < stop.

        The file index gives the names of the first and the last file that hold such rows, and the scan is
        narrowed to the names between them, however many they are.
        """
        start, stop = max(start, 0), self.n_rows if stop is None else min(stop, self.n_rows)
        df = self.narrow(start, stop) if self.narrow else self.df
        if self.n_files > 1 and (start > 0 or stop < self.n_rows):
            hit = self.files.filter((F.col("base") < stop) & (F.col("base") + F.col("rows") > start))
            n_hit, first, last = hit.agg(F.count("*"), F.min("name"), F.max("name")).first()
            if not n_hit:
                return self.df.limit(0)
            inside = natural_name("_metadata.file_path").between(F.lit(first), F.lit(last))
            df = _from_files(self.source.filter(inside), hit, n_hit, self.n_rows).df
        if start > 0:
            df = df.filter(F.col(ROW) >= start)
        return df.filter(F.col(ROW) < stop) if stop < self.n_rows else df


class Ranked:
    """Dense rank of each row among the rows of its class, in position order.

    Ranks are found by a directory of two levels: counts per (class, chunk), and, inside the chunks that are
    asked for, counts per block. So a class that holds most rows is still spread over all chunks, and looking
    ranks up moves the rows of the blocks that hold them and no others.
    """

    def __init__(self, df: DataFrame, n_rows: int, by: str, position: str = ROW):
        self.by, self.position = by, position
        self.size = _chunk_size(n_rows)
        self.block = max(BLOCK_ROWS, math.isqrt(self.size))
        self.rows = df.withColumn("__chunk", chunk_of(self.size, position))
        counts = self.rows.groupBy(by, "__chunk").agg(F.count("*").alias("n"))
        before = Window.partitionBy(by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        # at most MAX_CHUNKS rows for each class
        self.directory = stage(counts.withColumn("before", _sum_over("n", before)), "rank-directory")
        totals = self.directory.groupBy(by).agg(F.sum("n").alias("n"), F.count("*").alias("chunks")).collect()
        self.sizes = {r[by]: r["n"] for r in totals}
        self.n_entries = sum(r["chunks"] for r in totals)

    def all(self) -> DataFrame:
        """Every row with its ``rank``."""
        inside = Window.partitionBy(self.by, "__chunk").orderBy(self.position)
        # the directory is joined after the shuffle, which then moves less
        return (
            self.rows.withColumn("__at", F.row_number().over(inside))
            .join(small_side(self.directory.drop("n"), self.n_entries), [self.by, "__chunk"])
            .withColumn("rank", F.col("before") + F.col("__at") - 1)
            .drop("__chunk", "before", "__at")
        )

    def at(self, wanted: DataFrame, n_wanted: int) -> DataFrame:
        """Rows whose (class, rank) is in ``wanted``, joined with its other columns."""
        asked = stage(wanted, "ranks-asked")
        ranks = asked.select(self.by, "rank").distinct()
        in_chunk = self._located(self.directory, ranks, [self.by], self.size, "rank", "__of_chunk")
        chunks = small_side(in_chunk.select(self.by, "__chunk").distinct(), min(n_wanted, self.n_entries))
        blocked = self.rows.withColumn("__block", chunk_of(self.block, self.position))
        keys = [self.by, "__chunk"]
        counts = blocked.join(chunks, keys, "left_semi").groupBy(*keys, "__block").agg(F.count("*").alias("n"))
        before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = counts.withColumn("before", _sum_over("n", before))
        hits = stage(self._located(blocks, in_chunk, keys, self.block, "__of_chunk", "__of_block"), "ranks-placed")
        # A block may lie in two chunks; their rows are counted apart.
        own = [*keys, "__block"]
        rows = blocked.join(small_side(hits.select(*own).distinct(), n_wanted), own, "left_semi")
        placed = rows.withColumn("__of_block", F.row_number().over(Window.partitionBy(*own).orderBy(self.position)).cast("bigint") - 1)
        found = placed.join(small_side(hits, n_wanted), [*own, "__of_block"]).drop(*own[1:], "__of_block", "__of_chunk")
        return found.join(small_side(asked, n_wanted), [self.by, "rank"])

    @staticmethod
    def _located(entries: DataFrame, asked: DataFrame, keys: list[str], width: int, rank: str, inner: str) -> DataFrame:
        """``asked`` with the entry (a stretch of ``n`` ranks from ``before``) that holds each rank, and the rank
        within it, as an equi-join on numbered stretches of ranks, each of which touches few entries."""
        first, last = (F.expr(f"({end}) div {int(width)}") for end in ("before", "before + n - 1"))
        spread = entries.withColumn("__stretch", F.explode(F.sequence(first, last)))
        wanted = asked.withColumn("__stretch", chunk_of(width, rank))
        found = wanted.join(spread, [*keys, "__stretch"]).filter((F.col(rank) >= F.col("before")) & (F.col(rank) < F.col("before") + F.col("n")))
        return found.withColumn(inner, F.col(rank) - F.col("before")).drop("__stretch", "before", "n")


def _sum_over(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0).cast("bigint"))


def index_rows(df: DataFrame, order_by: Sequence[str] = ()) -> Indexed:
    """Add ``row_idx`` by the given total order, or by file order when none is given.

    Where the files already lie in key order (found by reading the key columns once) positions in
    the files are used and nothing is sorted or shuffled; else a range partitioned sort is staged. For a
    table in files this happens once per session, as long as the files stay what they were.
    """
    if not order_by:
        return index_by_file(df)
    if not _has_file_positions(df):
        return index_by_keys(df, order_by)
    state = df.agg(F.count("*"), F.max("_metadata.file_modification_time"), F.count_distinct("_metadata.file_path")).first()
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), tuple(df.columns), tuple(order_by), *state)
    if key not in _indexed:
        found = _in_key_order(df, order_by, state[0]) or index_by_keys(df, order_by, state[0])
        while len(_indexed) >= KEPT_TABLES:
            _indexed.pop(next(iter(_indexed)))
        _indexed[key] = found
    return _indexed[key]


def index_by_file(df: DataFrame) -> Indexed:
    """Index a whole parquet scan by file name, then by row position in the file; no shuffle of rows."""
    if not _has_file_positions(df):
        raise ValueError("only a parquet scan has an order of its own; give order keys")
    path = F.col("_metadata.file_path")
    scan = df.select(path.alias("path"), F.col("_metadata.row_index").alias("pos"))
    counts = scan.groupBy("path").agg(F.count("*").alias("rows"), F.max("pos").alias("top"))
    files = stage(counts.select(F.xxhash64("path").alias("file"), natural_name("path").alias("name"), "path", "rows", "top"), "file-counts")
    n_files, n_hashes, whole, total = files.agg(
        F.count("*"), F.count_distinct("file"), F.coalesce(F.every(F.col("top") + 1 == F.col("rows")), F.lit(True)), F.sum("rows")
    ).first()
    if not whole:
        raise ValueError("file order needs the whole scan: index before filtering")
    if n_hashes != n_files:
        raise ValueError("two file names share a hash; give order keys instead")
    return _from_files(df, rows_before(files, ["name", "path"], n_files), n_files, total or 0)


def rows_before(entries: DataFrame, order_by: Sequence[str], n_entries: int, rows: str = "rows") -> DataFrame:
    """``entries`` with ``base``, the sum of ``rows`` over those before, staged.

    Entries (of files, or of stretches of files) are sorted over all tasks and summed in two levels, so their
    number is not bounded by the driver.
    """
    if n_entries <= 1:
        return entries.withColumn("base", F.lit(0).cast("bigint"))
    placed = index_by_keys(entries, order_by, n_entries)
    summed = running(placed.df, n_entries, {"base": ("sum", F.col(rows))}, inclusive=False)
    return stage(summed.drop(ROW).withColumn("base", F.col("base").cast("bigint")), "rows-before")


def index_by_keys(df: DataFrame, order_by: Sequence[str], n_rows: int | None = None) -> Indexed:
    """Index by a total order: range partitions, each sorted, staged once; offsets from their sizes.

    Partitions follow the number of rows, where the session's number would make them too large.
    """
    keys = [F.col(quoted(k)) for k in order_by]
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(usual, -(-(df.count() if n_rows is None else n_rows) // SORT_ROWS))
    placed = (
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__place", F.monotonically_increasing_id())
    )
    return _by_partition(stage(placed, "ordered"))


def _by_partition(df: DataFrame) -> Indexed:
    """Index rows by the partition and the place in it that ``__place`` names; one row a sort task reaches the driver."""
    part = F.shiftright("__place", 33)
    sizes = sorted(df.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("__place").alias("low")).collect())
    bases, total = [], 0
    for r in sizes:
        bases.append((r["part"], total - r["low"]))
        total += r["n"]
    if not bases:
        return Indexed(df.drop("__place").withColumn(ROW, F.lit(0).cast("bigint")), 0)
    offsets = df.sparkSession.createDataFrame(bases, "__part bigint, __base bigint")
    joined = df.withColumn("__part", part).join(small_side(offsets, len(bases)), "__part")
    return Indexed(joined.withColumn(ROW, F.col("__place") + F.col("__base")).drop("__place", "__base", "__part"), total)


def index_by_place(df: DataFrame, segment: Sequence[Column], place: str) -> Indexed:
    """Index rows that carry an ordered segment (file and block) and a consecutive place inside it.

    Segments stay a table: they are counted, sorted and summed by tasks.
    """
    names = [f"__s{i}" for i in range(len(segment))]
    tagged = df.select("*", *[c.alias(n) for c, n in zip(segment, names)])
    counts = stage(tagged.groupBy(*names).agg(F.count("*").alias("__n"), F.min(place).alias("__low")), "segments")
    n_segments, total = counts.agg(F.count("*"), F.sum("__n")).first()
    keys = [n if counts.schema[n].dataType != T.StringType() else f"{n}_name" for n in names]
    named = counts.withColumns({f"{n}_name": natural_name(n) for n in names if f"{n}_name" in keys})
    summed = rows_before(named, [*keys, *[n for n in names if n not in keys]], n_segments, "__n")
    offsets = summed.select(*names, (F.col("base") - F.col("__low")).alias("__base"))
    joined = tagged.join(small_side(offsets, n_segments), names)
    return Indexed(joined.withColumn(ROW, F.col(place) + F.col("__base")).drop(place, "__base", *names), total or 0)


def head(indexed: Indexed, n_rows: int) -> Indexed:
    """First ``n_rows`` rows in order, if 0 < n_rows < N; else all rows."""
    if not 0 < n_rows < indexed.n_rows:
        return indexed
    return Indexed(indexed.between(0, n_rows), n_rows)


def chunk_of(rows_per_chunk: int, position: str = ROW) -> Column:
    """Number of the chunk a position falls in."""
    return F.expr(f"{quoted(position)} div {int(rows_per_chunk)}")


def running(
    df: DataFrame,
    n_rows: int,
    columns: dict[str, tuple[str, Column]],
    position: str = ROW,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum, min or max along a dense position, in two levels.

    Chunk totals (at most MAX_CHUNKS rows) are accumulated first; each chunk then continues from
    the total before it.
    """
    size = _chunk_size(n_rows)
    tagged = df.select(
        "*",
        chunk_of(size, position).alias("__chunk"),
        *[c.alias(f"__in_{name}") for name, (_, c) in columns.items()],
    )
    folds = {"sum": F.sum, "min": F.min, "max": F.max}
    totals = tagged.groupBy("__chunk").agg(
        *[folds[how](f"__in_{name}").alias(f"__t_{name}") for name, (how, _) in columns.items()]
    )
    earlier = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "__chunk",
        *[
            folds[how](f"__t_{name}").over(earlier).alias(f"__c_{name}")
            for name, (how, _) in columns.items()
        ],
    )
    inside = (
        Window.partitionBy("__chunk")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    joined = tagged.join(small_side(carried, min(n_rows, MAX_CHUNKS)), "__chunk")
    out = []
    for name, (how, _) in columns.items():
        here, carry = folds[how](f"__in_{name}").over(inside), F.col(f"__c_{name}")
        if how == "sum":
            value = F.coalesce(carry, F.lit(0)) + F.coalesce(here, F.lit(0))
        elif how == "min":
            value = F.least(carry, here)
        else:
            value = F.greatest(carry, here)
        out.append(value.alias(name))
    return joined.select(*[quoted(c) for c in df.columns], *out)


def _chunk_size(n_rows: int) -> int:
    """Rows per chunk such that there are at most MAX_CHUNKS of them."""
    return max(1, math.ceil(n_rows / MAX_CHUNKS), min(1024, n_rows))


def natural_key(value):
    """Sort key that puts part-10 after part-9."""
    if not isinstance(value, str):
        return value
    return [int(p) if i % 2 else p for i, p in enumerate(re.split(r"(\d+)", value))]


def natural_name(path: Column | str) -> Column:
    """The same order as text: each number is written behind the count of its digits."""

    def written(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=.)", "")
        number = F.concat(F.lit("\u0001"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
        return F.when(part.rlike("^[0-9]"), number).otherwise(part)

    parts = F.regexp_extract_all(F.col(path) if isinstance(path, str) else path, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, written), "")


def _has_file_positions(df: DataFrame) -> bool:
    try:
        return bool(df.select("_metadata.row_index").columns)
    except AnalysisException:
        return False


def _from_files(df: DataFrame, files: DataFrame, n_files: int, n_rows: int) -> Indexed:
    """``row_idx`` = row position in the file + number of rows in the files before it."""
    pos = F.col("_metadata.row_index")
    if n_files <= 1:
        base = files.select("base").first()
        return Indexed(df.select("*", (pos + F.lit(base[0] if base else 0)).alias(ROW)), n_rows, df, files, n_files)
    bases = files.select(F.col("file").alias("__file"), F.col("base").alias("__base"))
    tagged = df.select("*", pos.alias("__pos"), F.xxhash64("_metadata.file_path").alias("__file"))
    joined = tagged.join(small_side(bases, n_files), "__file")
    placed = joined.withColumn(ROW, F.col("__pos") + F.col("__base")).drop("__file", "__pos", "__base")
    return Indexed(placed, n_rows, df, files, n_files)


def _in_key_order(df: DataFrame, order_by: Sequence[str], n_rows: int) -> Indexed | None:
    """The index by file positions if all files together are strictly increasing in the keys, else None.

    Each task reduces the rows it reads to one line per stretch of a file. The lines are sorted by their first
    keys; each must end before the next begins, and all stretches of a file must tell the same rows before it.
    """
    keys = [F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(order_by)]
    scan = df.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("pos"), *keys)
    kinds = [f for f in scan.schema.fields if f.name.startswith("k")]
    if _descends_early(scan, kinds):
        return None
    fields = [("file", T.LongType()), ("pos", T.LongType()), ("rows", T.LongType()), ("rising", T.BooleanType())]
    fields += [(f"{end}_{f.name}", f.dataType) for end in ("first", "last") for f in kinds]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    lines = stage(scan.mapInArrow(_file_runs, schema), "stretches")
    firsts, lasts = ([f"{end}_{f.name}" for f in kinds] for end in ("first", "last"))
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*firsts, *lasts)])
    n_lines, rising = lines.agg(F.count("*"), F.every(F.col("rising") & known)).first()
    if not n_lines or not rising:
        return None
    if n_lines > 1:
        placed = index_by_keys(lines, firsts, n_lines).df
        placed = stage(running(placed, n_lines, {"base": ("sum", F.col("rows"))}, inclusive=False), "stretches-placed")

        def at(names: list[str]) -> Column:
            return F.struct(*[F.col(c).alias(f.name) for c, f in zip(names, kinds)])

        ends = placed.select((F.col(ROW) + 1).alias(ROW), at(lasts).alias("last"))
        meet = placed.select(ROW, at(firsts).alias("first")).join(ends, ROW)
        if not meet.filter(~(F.col("last") < F.col("first"))).isEmpty():
            return None
    else:
        placed = lines.withColumn("base", F.lit(0).cast("bigint"))
    start = F.col("base") - F.col("pos")
    told = placed.groupBy("file").agg(F.min(start).alias("base"), F.max(start).alias("other"), F.sum("rows").alias("rows"))
    names = df.select(F.col("_metadata.file_path").alias("path")).distinct().select(F.xxhash64("path").alias("file"), natural_name("path").alias("name"))
    files = stage(told.join(names, "file").select("file", "name", F.col("base").cast("bigint").alias("base"), "rows", "other"), "file-index")
    n_files, same = files.agg(F.count("*"), F.every(F.col("base") == F.col("other"))).first()
    return _from_files(df, files.drop("other"), n_files, n_rows) if same else None


def _descends_early(scan: DataFrame, kinds: list[T.StructField]) -> bool:
    """Whether the keys fall among the first rows already; an ordered table costs this look in vain."""
    plain = [F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name for f in kinds]
    first = scan.select("file", "pos", *plain).take(FIRST_ROWS)

    def rises(a: tuple, b: tuple) -> bool:
        x, y = next(((x, y) for x, y in zip(a, b) if x is None or y is None or x != y), (None, None))
        return x is not None and y is not None and x < y

    return any(a[0] == b[0] and a[1] + 1 == b[1] and not rises(a[2:], b[2:]) for a, b in zip(first, first[1:]))


def _file_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One line per stretch of consecutive rows of a file: its start, length, and whether keys rise."""
    names, run = None, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        file, pos = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keys = batch.columns[2:]
        if names is None:
            names = ["file", "pos", "rows", "rising"]
            names += [f"{end}_k{i}" for end in ("first", "last") for i in range(len(keys))]
        rising = _rises([k.slice(0, len(k) - 1) for k in keys], [k.slice(1) for k in keys])
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pos)]):
            first, last = [k.slice(lo, 1) for k in keys], [k.slice(hi - 1, 1) for k in keys]
            ok = bool(rising[lo : hi - 1].all())
            if run and run[0] == file[lo] and run[1] + run[2] == pos[lo]:
                run[3] = ok and bool(_rises(run[5], first)[0])
                run[2], run[5] = run[2] + hi - lo, last
            else:
                if run:
                    yield _line(run, names)
                run = [file[lo], pos[lo], hi - lo, ok, first, last]
            if not run[3]:
                # one descent settles the question for the whole table
                yield _line(run, names)
                return
    if run:
        yield _line(run, names)


def _rises(before: list[pa.Array], after: list[pa.Array]) -> np.ndarray:
    """Row by row, whether the key tuple increases; a missing key counts as not increasing."""
    less = np.zeros(len(before[0]), dtype=bool)
    same = np.ones(len(before[0]), dtype=bool)
    for a, b in zip(before, after):
        less |= same & pc.fill_null(pc.less(a, b), False).to_numpy(zero_copy_only=False)
        same &= pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
    return less


def _line(run: list, names: list[str]) -> pa.RecordBatch:
    file, pos, rows, rising, first, last = run
    columns = [pa.array([file], pa.int64()), pa.array([pos], pa.int64()), pa.array([rows], pa.int64())]
    columns += [pa.array([bool(rising)]), *first, *last]
    return pa.RecordBatch.from_arrays(columns, names=names)
