"""Feather (Arrow IPC) files in Spark: scans by a table of record batches, writes by a data source.

The table of batches (path, batch, rows, base) is the file index: tasks read the footers, and the rows before
each batch are summed over all tasks. A scan hands its lines to tasks, each of which reads the batches it is
given, so a range of rows touches the batches that hold it and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema

from netseq.operators.order import ROW, Indexed, natural_key, natural_name, rows_before
from netseq.session import stage

# Position columns a scan adds on request: path of the file, record batch number, row in the batch.
FILE, BATCH, PLACE = "__file", "__batch", "__place"

# Rows that a task reads, where there are more batches than eight for each core.
TASK_ROWS = 1_000_000

# Any case of the suffix, for a folder's files.
SUFFIX = "*.[fF][eE][aA][tT][hH][eE][rR]"


def batches(spark: SparkSession, path: str) -> DataFrame:
    """Staged table (path, batch, rows) of the record batches of a file or of a folder of files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", SUFFIX).load(path).select("path")

    def footers(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name in part.column(0).to_pylist():
                system, at = _place(name)
                with system.open_input_file(at) as f:
                    file = ipc.open_file(f)
                    rows = [file.get_batch(i).num_rows for i in range(file.num_record_batches)]
                columns = [pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "batch", "rows"])

    return stage(found.mapInArrow(footers, "path string, batch long, rows long"), "feather-batches")


def read_feather(
    spark: SparkSession, path: str, columns: list[str] | None = None, positions: bool = False
) -> DataFrame:
    """Scan a feather file or a folder of them; only ``columns`` leave the file reader."""
    return _read(_listed(spark, path), _schema(spark, path, columns), positions)


def index_feather(spark: SparkSession, path: str, columns: list[str] | None = None) -> Indexed:
    """The rows of feather files in the order of file names (part-10 after part-9), batches and rows."""
    listed = _listed(spark, path).withColumn("name", natural_name("path"))
    n, total = listed.agg(F.count("*"), F.sum("rows")).first()
    index, schema = rows_before(listed, ["name", "path", "batch"], n), _schema(spark, path, columns)

    def narrow(start: int, stop: int) -> DataFrame:
        hit = index.filter((F.col("base") < stop) & (F.col("base") + F.col("rows") > start))
        return _read(hit, schema, row=True)

    return Indexed(narrow(0, total or 0), total or 0, narrow=narrow)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    try:
        found = batches(spark, path)
    except AnalysisException as missing:
        raise FileNotFoundError(f"no feather file at {path}") from missing
    return found


def _schema(spark: SparkSession, path: str, columns: list[str] | None) -> T.StructType:
    """Fields of the first file, in its order or that of ``columns``."""
    scan = _Folder.of({"path": path})
    first = scan.first()
    if first is None:
        raise FileNotFoundError(f"no feather file at {path}")
    with scan.system.open_input_file(first) as f:
        arrow = ipc.open_file(f).schema
    by_name = {f.name: f for f in from_arrow_schema(pa.schema([_plain(x) for x in arrow])).fields}
    return T.StructType([by_name[c] for c in (columns if columns is not None else by_name)])


def _read(index: DataFrame, schema: T.StructType, positions: bool = False, row: bool = False) -> DataFrame:
    """The rows of the batches that ``index`` lists, one batch after the other in each task."""
    names = [f.name for f in schema.fields]
    extra = [T.StructField(FILE, T.StringType()), T.StructField(BATCH, T.LongType()), T.StructField(PLACE, T.LongType())] if positions else []
    extra += [T.StructField(ROW, T.LongType())] if row else []

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, number, base in zip(*(part.column(c).to_pylist() for c in ("path", "batch", "base"))):
                system, at = _place(path)
                with system.open_input_file(at) as f:
                    everything = ipc.open_file(f).schema
                    wanted = ipc.IpcReadOptions(included_fields=[everything.get_field_index(n) for n in names])
                    batch = ipc.open_file(f, options=wanted).get_batch(number)
                columns = [_decoded(batch.column(batch.schema.get_field_index(n))) for n in names]
                places = pa.array(range(batch.num_rows), pa.int64())
                if positions:
                    columns += [pa.array([path] * batch.num_rows, pa.string()), pa.array([number] * batch.num_rows, pa.int64()), places]
                if row:
                    columns.append(pa.array(range(base, base + batch.num_rows), pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *(f.name for f in extra)])

    listed = index if "base" in index.columns else index.withColumn("base", F.lit(0).cast("bigint"))
    n, total = index.agg(F.count("*"), F.sum("rows")).first()
    tasks = min(n, max(8 * index.sparkSession.sparkContext.defaultParallelism, (total or 0) // TASK_ROWS))
    spread = listed.select("path", "batch", "base").repartition(max(tasks, 1))
    return spread.mapInArrow(run, T.StructType([*schema.fields, *extra]))


def write_feather(df: DataFrame, path: str) -> None:
    """Write one feather file per task into a folder that must be new or empty."""
    df.sparkSession.dataSource.register(FeatherSink)
    df.write.format(FeatherSink.name()).mode("append").save(path)


class FeatherSink(DataSource):
    """Option: path."""

    @classmethod
    def name(cls) -> str:
        return "netseq_feather"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FeatherWriter(self.options, schema, overwrite)


@dataclass
class WrittenFile(WriterCommitMessage):
    path: str


class FeatherWriter(DataSourceArrowWriter):
    """Tasks write hidden files; the commit gives them their final names in task order."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        if overwrite:
            raise ValueError("feather output does not overwrite; choose a new folder")
        self.options = options
        scan = _Folder.of(options)
        scan.system.create_dir(scan.root, recursive=True)
        if scan.first() is not None:
            raise FileExistsError(f"{options['path']} already holds feather files")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFile:
        from pyspark import TaskContext

        scan = _Folder.of(self.options)
        number = TaskContext.get().partitionId()
        path = f"{scan.root}/.{number:010d}-{uuid.uuid4().hex}"
        writer = None
        with scan.system.open_output_stream(path) as out:
            for batch in iterator:
                writer = writer or ipc.new_file(out, batch.schema)
                writer.write_batch(batch)
            if writer:
                writer.close()
        return WrittenFile(path if writer else "")

    def commit(self, messages: list[WrittenFile | None]) -> None:
        scan = _Folder.of(self.options)
        for m in messages:
            if m is not None and m.path:
                number = m.path.rsplit("/.", 1)[1].split("-")[0]
                scan.system.move(m.path, f"{scan.root}/part-{number}.feather")

    def abort(self, messages: list[WrittenFile | None]) -> None:
        scan = _Folder.of(self.options)
        for m in messages:
            if m is not None and m.path:
                scan.system.delete_file(m.path)


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://"))
    return pafs.LocalFileSystem(), path


@dataclass
class _Folder:
    system: pafs.FileSystem
    root: str

    @classmethod
    def of(cls, options: dict) -> _Folder:
        system, root = _place(options["path"])
        return cls(system, root.rstrip("/"))

    def first(self) -> str | None:
        """The first feather file, itself or in the folder; None without one."""
        info = self.system.get_file_info(self.root)
        if info.type == pafs.FileType.File:
            return self.root
        if info.type != pafs.FileType.Directory:
            return None
        found = self.system.get_file_info(pafs.FileSelector(self.root))
        return min((f.path for f in found if f.base_name.lower().endswith(".feather")), key=natural_key, default=None)


def _plain(field: pa.Field) -> pa.Field:
    kind = field.type.value_type if pa.types.is_dictionary(field.type) else field.type
    return pa.field(field.name, kind, field.nullable)


def _decoded(column: pa.Array) -> pa.Array:
    return column.dictionary_decode() if pa.types.is_dictionary(column.type) else column
