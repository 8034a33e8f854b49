"""Legacy archives: writing ARC files, converting them to WARC, reading WARC back.

Archives are gzip files with one member per record. Spark's own writers and readers carry them, so any store
that Spark reaches will do: an archive is one row while it is written and one row of a binary file while it
is read, and a size limit keeps that row small. Records are parsed one at a time from their declared lengths.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netseq.llm import common
from netseq.llm.common import checked_side
from netseq.session import stage, staging_path

# An archive ends with the record that brings its compressed size to this.
ARCHIVE_BYTES = 32 << 20

FETCHED = "20240101000000"

# The field names that an ARC file declares in its version block, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

# Fixed value: the profile of a revisit whose payload equals that of an earlier response.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, ordinal: int) -> str:
    """The same identifier whenever the same record of the same archive is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{ordinal}')}>"


def http_message(page_id: int | None, payload_bytes: int) -> bytes:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    return "\r\n".join([*lines, f"Content-Length: {payload_bytes}", "", ""]).encode()


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Lower-case header fields and body of an HTTP message; without an empty line all of it is body."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return {}, block
    pairs = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}, body


def url_field(url: str | None) -> str:
    """A URL without blanks, controls or non-ASCII characters, as header lines are split at blanks."""
    return quote(url or "about:blank", safe="".join(map(chr, range(0x21, 0x7F))))


# ARC


def arc_head(name: str, version: int) -> bytes:
    block = f"{version} 0 netseq\n{ARC_FIELDS[version]}\n".encode()
    given = {"URL": f"filedesc://{name}", "Content-type": "text/plain", "Archive-length": str(len(block))}
    return arc_line(version, given) + block + b"\n"


def arc_line(version: int, given: dict[str, str]) -> bytes:
    usual = {"IP-address": "0.0.0.0", "Archive-date": FETCHED, "Result-code": "200"}
    return (" ".join(given.get(f, usual.get(f, "-")) for f in ARC_FIELDS[version].split()) + "\n").encode()


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    block = http_message(page_id, len(payload)) + payload
    given = {"URL": url_field(url), "Content-type": "text/html", "Archive-length": str(len(block))}
    return arc_line(version, given) + block + b"\n"


def read_arc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record, the version block first.

    Which fields a header line has is what the version block declares; a URL may hold blanks in version 1
    files of careless writers, so fields are counted from the right.
    """
    fields = None
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("latin-1").rstrip("\n").split(" ")
        block = stream.read(int(parts[-1]))
        if len(block) < int(parts[-1]):
            raise ValueError(f"archive ends within {parts[0]}")
        if fields is None:
            declared = block.decode("latin-1").split("\n")
            version = int(declared[0].split(" ")[0])
            fields = declared[1].split() if len(declared) > 1 and declared[1].strip() else ARC_FIELDS[version].split()
            # the head of a version 1 file may be written with fewer fields than its records
            yield {"URL": parts[0], "version": str(version), "Archive-date": FETCHED}, block
            continue
        tail = parts[len(parts) - len(fields) + 1 :]
        yield dict(zip(fields, [" ".join(parts[: len(parts) - len(fields) + 1]), *tail])), block


# WARC


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def warc_date(arc_date: str) -> str:
    """2024-01-01T00:00:00Z from 20240101000000; shorter dates are filled with their first moment."""
    d = re.sub(r"\D", "", arc_date)[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-case header fields, block) of every record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8").partition(":")
            fields[k.strip().lower()] = v.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("archive ends within a record")
        yield fields, block


def converted(archive: bytes, earlier: dict[int, tuple[int | None, str, int]]) -> Iterator[bytes]:
    """WARC records of one ARC file. ``earlier`` names, by ordinal, records that repeat another's payload:
    the other's page, archive and ordinal."""
    name = ""
    for ordinal, (fields, block) in enumerate(read_arc(gzip.GzipFile(fileobj=io.BytesIO(archive)))):
        dated = [("WARC-Date", warc_date(fields["Archive-date"]))]
        if ordinal == 0:
            name = fields["URL"].removeprefix("filedesc://")
            told = f"software: netseq\r\nformat: WARC File Format 1.0\r\nconverted-from: ARC version {fields['version']}\r\n"
            head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, 0)), ("WARC-Filename", f"{name}.warc.gz")]
            yield warc_record([*head, *dated, ("Content-Type", "application/warc-fields")], told.encode())
            continue
        http, body = http_parts(block)
        again = earlier.get(ordinal)
        own = [
            ("WARC-Type", "revisit" if again else "response"),
            ("WARC-Record-ID", record_id(name, ordinal)),
            ("WARC-Target-URI", fields["URL"]),
            *dated,
            ("WARC-IP-Address", fields.get("IP-address", "0.0.0.0")),
            ("WARC-Payload-Digest", f"sha1:{payload_digest(body)}"),
            ("Content-Type", "application/http; msgtype=response" if http else fields["Content-type"]),
        ]
        if again:
            page, other, at = again
            own += [("WARC-Refers-To", record_id(other, at)), ("WARC-Profile", SAME_PAYLOAD)]
            own += [("X-Refers-To-Page", str(page))] if page is not None else []
            block = block[: len(block) - len(body)]
        else:
            own.append(("WARC-Block-Digest", f"sha1:{payload_digest(block)}"))
        yield warc_record(own, block)


# Spark


# Written between the rows of a text file; an empty gzip member adds nothing to the archive.
_EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")


def _write(archives: DataFrame, path: str) -> None:
    """Each row's bytes as one file. The text writer copies bytes as they are."""
    (
        archives.select(F.col("archive").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("lineSep", _EMPTY_MEMBER)
        .option("encoding", "ISO-8859-1")
        .text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _batch(**columns: tuple[list, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def write_arc(pages: DataFrame, path: str, limit: int = ARCHIVE_BYTES) -> None:
    """(page_id, url, html) as ARC files below ``path``, versions 1 and 2 in turn; null html is empty."""
    slim = pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page_id, url, payload in zip(*batch.columns):
                version = 1 + (part + n) % 2
                if not held:
                    held.append(gzip.compress(arc_head(f"part-{part}-{n}.arc", version), mtime=0))
                held.append(gzip.compress(arc_record(version, page_id.as_py(), url.as_py(), payload.as_py()), 6, mtime=0))
                size += len(held[-1])
                if size >= limit:
                    yield _batch(archive=([b"".join(held)], pa.binary()))
                    n, held, size = n + 1, [], 0
        if held:
            yield _batch(archive=([b"".join(held)], pa.binary()))

    _write(slim.mapInArrow(run, "archive binary"), path)


def index_arc(spark: SparkSession, path: str) -> DataFrame:
    """(path, archive, ordinal, page_id, digest, payload_bytes) of every record of the ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(*batch.columns):
                rows, name = [], ""
                for ordinal, (fields, block) in enumerate(read_arc(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    if ordinal == 0:
                        name = fields["URL"].removeprefix("filedesc://")
                        continue
                    http, body = http_parts(block)
                    page = int(http["x-page-id"]) if "x-page-id" in http else None
                    rows.append((ordinal, page, payload_digest(body), len(body)))
                ordinals, pages, digests, sizes = zip(*rows) if rows else ([], [], [], [])
                yield _batch(
                    path=([place.as_py()] * len(rows), pa.string()), archive=([name] * len(rows), pa.string()),
                    ordinal=(ordinals, pa.int32()), page_id=(pages, pa.int64()), digest=(digests, pa.string()),
                    payload_bytes=(sizes, pa.int64()),
                )

    schema = "path string, archive string, ordinal int, page_id long, digest string, payload_bytes long"
    return _files(spark, path).mapInArrow(run, schema)


def _repeat_bytes(by_file: DataFrame) -> int:
    """Bytes of the lists of repeats: their names and paths, and 48 for the numbers of each."""
    names = F.aggregate("earlier", F.lit(0).cast("bigint"), lambda n, e: n + F.octet_length(e["other"]) + 48)
    return by_file.agg(F.sum(F.octet_length("path") + 48 + names)).first()[0] or 0


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """Every ARC file below ``arc_path`` as one WARC file below ``warc_path``.

    Of records with equal payloads of at least ``least`` bytes, the one with the smallest page (null last,
    then by archive and ordinal) is the response, the others revisit it. Archives stay where they are read while
    the list of repeats, whose bytes are counted, is small enough to be sent to them; beyond that they are dealt
    by path over as many tasks as there are archives.
    """
    index = stage(index_arc(spark, arc_path).filter(F.col("payload_bytes") >= least), "arc-index")
    rank = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "archive", "ordinal")
    first = index.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = stage(first.select(F.col("digest").alias("of"), "first"), "arc-first")
    repeats = index.join(checked_side(first, first.count(), 160), F.col("digest") == F.col("of"))
    repeats = repeats.filter((F.col("archive") != F.col("first.archive")) | (F.col("ordinal") != F.col("first.ordinal")))
    repeats = repeats.select(
        "path", "ordinal", F.col("first.page_id").alias("page"), F.col("first.archive").alias("other"), F.col("first.ordinal").alias("at")
    )
    by_file = repeats.groupBy("path").agg(F.collect_list(F.struct("ordinal", "page", "other", "at")).alias("earlier"))
    by_file = stage(by_file, "arc-repeats")
    archives = _files(spark, arc_path)
    n_bytes = _repeat_bytes(by_file)
    if n_bytes > common.BROADCAST_BYTES:
        archives = archives.repartition(archives.select("path").count(), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, earlier in zip(*batch.columns):
                known = {e["ordinal"]: (e["page"], e["other"], e["at"]) for e in earlier.as_py() or ()}
                members = [gzip.compress(r, 6, mtime=0) for r in converted(content.as_py(), known)]
                yield _batch(archive=([b"".join(members)], pa.binary()))

    joined = archives.join(checked_side(by_file, n_bytes, 1), "path", "left").select("content", "earlier")
    _write(joined.mapInArrow(run, "archive binary"), warc_path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id) of all responses and
    revisits of the WARC files below ``path``. A response whose payload differs from its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (content,) in zip(*batch.columns):
                rows = []
                for fields, block in read_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    http, body = http_parts(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    size = len(body)
                    if fields["warc-type"] == "revisit":
                        size = int(http["content-length"])
                    elif payload_digest(body) != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    page, other = http.get("x-page-id"), fields.get("x-refers-to-page")
                    rows.append(
                        (int(page) if page else None, fields.get("warc-target-uri"), size, digest, fields["warc-type"],
                         int(other) if other else None, fields["warc-record-id"])
                    )
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, limit: int = ARCHIVE_BYTES, least: int = 0) -> DataFrame:
    """Pages to ARC files, those to WARC files, and these read back; see ``read_archives``.

    Null and empty html are equal payloads of no bytes. Rows with repeated or null page ids are records like
    any other; null URLs become about:blank. An empty table gives no archives and no rows.
    """
    spark = pages.sparkSession
    arc, warc = staging_path(spark, "arc"), staging_path(spark, "warc")
    write_arc(pages, arc, limit)
    convert(spark, arc, warc, least)
    return read_archives(spark, warc)
