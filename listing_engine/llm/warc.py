"""WARC archives: written with Spark's text writer, read by a Python data source.

Payloads are UTF-8 text, so a record is one string and the two line ends behind
it are the writer's line separator: archives go to any file system that Spark
writes to, under its commit protocol. The reader plans file partitions, takes
predicates on record type and headers, parses headers first and steps over the
payloads that nobody asked for.
"""

from __future__ import annotations

import io
import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from listing_engine.llm.shared import kept, shared_folder, small_side, table

END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
#: Records of a file and bytes of a read partition (one file at least).
RECORDS_PER_FILE = 20_000
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
#: Repeated payloads (about 100 bytes each) that may be broadcast; more are joined by shuffle.
BROADCAST_PAYLOADS = 500_000

SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, content_length long, payload_length long, payload binary"
#: Column of SCHEMA and the header that it holds.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a payload: five hex digits (20 bits) make four signs."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_of(record: Column) -> Column:
    return F.regexp_extract(record, r"^<urn:page:(-?\d*)>$", 1).try_cast("long")


def records(pages: DataFrame, least: int = 0, date: str = DATE) -> DataFrame:
    """One string `record` for each row of `pages` (page_id, url, html).

    Of records with equal payloads of at least `least` bytes, that with the
    largest page_id is a response and the others revisit it. Null html is the
    empty payload; a null url gives no target header, line ends in it become
    %0D and %0A; null page_ids count as smallest, and only among themselves all
    are responses; rows that repeat a page_id are each a record of the same kind.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumns({"digest": payload_digest(F.col("html")), "bytes": F.octet_length("html").cast("long")})
    # payloads that repeat, one row each (partly reduced before its shuffle); if their counted
    # number is small, they are broadcast and no page is shuffled
    repeated = own.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    repeated = kept(repeated.filter("kept is not null and n > 1").select("digest", "kept"))
    joined = own.join(small_side(repeated, BROADCAST_PAYLOADS), "digest", "left")
    revisit = F.col("kept").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("kept")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    revisits = F.when(revisit, record_id(F.col("kept")))
    return joined.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            header("WARC-Record-ID", record_id(F.col("page_id"))),
            header("WARC-Date", F.lit(date)),
            header("WARC-Target-URI", uri),
            header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            header("WARC-Refers-To", revisits),
            header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            header("Content-Type", F.lit("application/http;msgtype=response")),
            header("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("record")
    )


def write_warc(pages: DataFrame, path: str, least: int = 0, date: str = DATE) -> None:
    """Write archives (*.txt of concatenated, uncompressed WARC records) to a new folder."""
    records(pages, least, date).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


_TESTS = {EqualTo: operator.eq, In: lambda a, b: a in b, StringStartsWith: str.startswith, IsNotNull: lambda a, b: a is not None}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.wanted: list[tuple[str, type, object]] = [(c, EqualTo, options[c.replace("_", "")]) for c in HEADERS if c.replace("_", "") in options]

    def partitions(self) -> list[Files]:
        """Files, largest first, put together up to the partition size."""
        system, path = _opened(self.path)
        found = system.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((f for f in found if f.is_file and f.size and not f.base_name.startswith(("_", "."))), key=lambda f: (-f.size, f.path))
        out, room = [], 0
        for f in files:
            if not out or f.size > room:
                out.append(Files())
                room = self.partition_bytes
            out[-1].paths.append(f.path)
            room -= f.size
        return out or [Files()]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        schema = pa.schema([(n, pa.int64() if n.endswith("length") else pa.binary() if n == "payload" else pa.string()) for n in (c.split()[0] for c in SCHEMA.split(", "))])
        rows, size = [], 0
        for path in partition.paths:
            with io.BufferedReader(system.open_input_file(path), 1 << 20) as stream:
                for row in self.rows(stream):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def rows(self, stream: io.BufferedReader) -> Iterator[dict]:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {stream.tell() - len(line)}: {line[:40]!r}")
            headers = _headers(stream)
            length = int(headers["content-length"])
            row = {column: headers.get(name) for column, name in HEADERS.items()}
            if not all(row[c] is not None and _TESTS[kind](row[c], value) for c, kind, value in self.wanted):
                stream.seek(length, io.SEEK_CUR)
                continue
            end = stream.tell() + length
            row |= {"content_length": length, "payload_length": length, "payload": None}
            if "application/http" in headers.get("content-type", "") and length:
                stream.readline()  # the HTTP status
                row["payload_length"] = int(_headers(stream).get("content-length", end - stream.tell()))
            if self.with_payload and row["record_type"] != "revisit":
                row["payload"] = stream.read(end - stream.tell())
            stream.seek(end)
            yield row


class PushingWarcReader(WarcReader):
    """Takes the predicates of the query that reads it.

    Spark keeps what was pushed with the source's DataFrame, so each DataFrame
    of this kind may be read under one set of filters only.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep predicates on headers; hand back all others."""
        for f in filters:
            name = getattr(f, "attribute", ("",))
            if type(f) in _TESTS and len(name) == 1 and name[0] in HEADERS:
                self.wanted.append((name[0], type(f), getattr(f, "value", None)))
            else:
                yield f


def _headers(stream: io.BufferedReader) -> dict[str, str]:
    found = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.partition(b":")
        found[name.decode("utf-8").strip().lower()] = value.decode("utf-8").strip()
    return found


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder).

    Options: payload (true), partitionBytes, a header column without its
    underscores (recordType, targetUri, ...) with the value wanted, and pushdown
    (false), which takes the query's own filters (see PushingWarcReader).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushingWarcReader if options.get("pushdown", "false").lower() == "true" else WarcReader)(options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, where: Column | None = None) -> DataFrame:
    """Records of the archives in a folder; those that `where` holds for, if given.

    Tests of header columns in `where` are applied while reading, before any
    payload is touched. Registers the source and turns on filter pushdown for
    Python sources in this session.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    # a new relation each time: what is pushed stays with it
    source = spark.read.format("warc").option("payload", str(payload).lower()).option("pushdown", str(where is not None).lower())
    return source.load(path) if where is None else source.load(path).filter(where)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    full = read_warc(spark, path, where=F.col("record_type") == "response")
    again = read_warc(spark, path, payload=False, where=F.col("record_type") == "revisit")
    columns = lambda size, digest: [page_of(F.col("record_id")).alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page_of(F.col("refers_to")).alias("refers_to")]
    return full.select(*columns(F.octet_length("payload").cast("long"), payload_digest(F.col("payload")))).union(
        again.select(*columns(F.col("payload_length"), F.regexp_replace("payload_digest", "^sha1:", "")))
    )


QUERIES = {"op8_warc": op8_warc}
ORACLE: dict[str, str] = {}
