"""Archives of stored responses as a data source: `spark.read.format("sitelens_archive")` and `df.write.format("sitelens_archive")`.

Files are WARC 1.1: a `response` record for each response, a `metadata` record for each request that got none. The writer cuts files at
`fileBytes` and puts an index beside each (URL, status, type, place), so readers open records only where they must:

- filters on url, status and fetched_at are taken over by the source (`spark.sql.python.filterPushdown.enabled`): files whose range of URLs or whose statuses
  cannot match are left out when the scan is planned, others by their index, and only matching records are read;
- columns are pruned by the schema that the reader is given: without body and headers no record is opened at all;
- files are split every `splitBytes`; a split reads the records that begin in it.

Archives of others are read without commits and index: `.warc` files are split too (a split looks for the first record that begins
in it), `.warc.gz` files are one split each. Reading is by path, so the folder must be mounted on all executors.

A null body is written as an empty one; of a request without response only URL, time and error are kept. Content-Type and Location have columns of their own and are not among the headers; of headers
of one name the last stays. Chunked or compressed payloads of other archives are given as they are stored.
"""

from __future__ import annotations

import gzip
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StructType

from sitelens import schemas
from sitelens.sinks.committed import Folder, Job, Written, local
from sitelens.storage import ship

NAME = "sitelens_archive"
SCHEMA = f"{schemas.ROUTE}, error string, fetched_at timestamp"
COLUMNS = ["url", "body", "status", "content_type", "location", "headers", "error", "fetched_at"]
ARROW = pa.schema(
    [("url", pa.string()), ("body", pa.binary()), ("status", pa.int32()), ("content_type", pa.string()), ("location", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("error", pa.string()), ("fetched_at", pa.timestamp("us", "UTC"))]
)
#: Columns that only the records themselves have.
IN_RECORD = {"body", "headers"}
INDEX = pa.schema([f for f in ARROW if f.name not in IN_RECORD] + [("at", pa.int64()), ("length", pa.int64())])
#: Rows and bytes of one batch that a task hands to Spark.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Statuses that a commit lists for a file, at most; beyond it says nothing.
STATUSES = 32
_START = b"WARC/1."
_BEGIN = re.compile(rb"\r\n\r\n" + re.escape(_START) + rb"\d\r\n")


def _clean(text: str) -> str:
    return text.replace("\r", " ").replace("\n", " ")


def record(row: dict) -> bytes:
    """One response, or what is known of a request without one."""
    at = row["fetched_at"] or datetime.fromtimestamp(0, UTC)
    head = [f"WARC-Target-URI: {_clean(row['url'])}", f"WARC-Date: {at.astimezone(UTC).isoformat(timespec='microseconds').replace('+00:00', 'Z')}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    if row["fetched_at"] is None:
        head.append("WARC-Date-Unknown: true")
    if row["status"] is None:
        kind, form, block = "metadata", "application/warc-fields", f"error: {_clean(row['error'] or 'transport')}\r\n".encode()
    else:
        own = [(k, v) for k, v in row["headers"] or [] if k.lower() not in ("content-type", "location")]
        own += [(k, v) for k, v in (("Content-Type", row["content_type"]), ("Location", row["location"])) if v is not None]
        lines = "".join(f"{_clean(k)}: {_clean(v or '')}\r\n" for k, v in own)
        kind, form = "response", "application/http; msgtype=response"
        block = f"HTTP/1.1 {row['status']} \r\n{lines}\r\n".encode() + (row["body"] or b"")
        if row["error"] is not None:
            head.append(f"WARC-Error: {_clean(row['error'])}")
    lines = "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", *head, f"Content-Type: {form}", f"Content-Length: {len(block)}"])
    return lines.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    """Names lower-cased; the first line is not one of them."""
    found = {}
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def parsed(head: dict[str, str], block: bytes) -> dict | None:
    """A row of a record, given its fields and block; none for records that are neither."""
    kind = head.get("warc-type")
    row = dict.fromkeys(COLUMNS) | {"url": head.get("warc-target-uri", "").strip("<>"), "error": head.get("warc-error")}
    if "warc-date" in head and "warc-date-unknown" not in head:
        row["fetched_at"] = datetime.fromisoformat(head["warc-date"].replace("Z", "+00:00"))
    if kind == "metadata" and block.startswith(b"error:"):
        return row | {"error": block[6:].decode("utf-8", "replace").strip(), "headers": []}
    if kind != "response" or not block.startswith(b"HTTP/"):
        return None
    lines, _, body = block.partition(b"\r\n\r\n")
    first = lines.split(b"\r\n", 1)[0].split(None, 2)
    status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
    headers: dict[str, str] = {}
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers.pop(name, None)
            headers[name] = value.strip()
    own = {k.lower(): v for k, v in headers.items()}
    kept = [(k, v) for k, v in headers.items() if k.lower() not in ("content-type", "location")]
    return row | {"status": status, "content_type": own.get("content-type"), "location": own.get("location"), "headers": kept, "body": body}


def _first_record(f, start: int) -> int | None:
    """Where the first record that begins at or after `start` does: after an empty line, with a version alone on its line and a type among its fields."""
    tail, at = b"", max(0, start - 4)  # the empty line may end just where the split begins
    f.seek(at)
    while more := f.read(1 << 20):
        tail += more
        for found in _BEGIN.finditer(tail):
            here = at + found.start() + 4
            f.seek(here)
            head = f.read(1 << 14).partition(b"\r\n\r\n")[0]
            if {"warc-type", "content-length"} <= _fields(head).keys():
                return here
        f.seek(at + len(tail))
        keep = len(_START) + 8
        at, tail = at + max(0, len(tail) - keep), tail[-keep:]
    return None


def records(f, start: int = 0, end: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record that begins in [start, end), without an index."""
    if start:
        begin = _first_record(f, start)
        if begin is None:
            return
        start = begin
    f.seek(start)
    at = start
    while end is None or at < end:
        lines = []
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            lines.append(line)
        if not lines:
            if not line:
                return
            at += len(line)
            continue
        head = _fields(b"".join(lines).replace(b"\r\n", b"\n").replace(b"\n", b"\r\n"))
        size = int(head.get("content-length", 0))
        block = f.read(size)
        yield head, block
        at += sum(map(len, lines)) + len(line) + size


_COMPARED = {D.EqualTo: "equal", D.EqualNullSafe: "equal", D.GreaterThan: "greater", D.GreaterThanOrEqual: "greater_equal", D.LessThan: "less", D.LessThanOrEqual: "less_equal"}
PUSHED = ("url", "status", "fetched_at")


def supported(f: D.Filter) -> bool:
    if isinstance(f, D.Not):
        return False
    of = getattr(f, "attribute", ())
    if len(of) != 1 or of[0] not in PUSHED:
        return False
    if isinstance(f, D.StringStartsWith):
        return of[0] == "url"
    if isinstance(f, D.In):
        return all(v is not None for v in f.value)
    return isinstance(f, D.IsNotNull) or type(f) in _COMPARED and f.value is not None


def mask(f: D.Filter, table: pa.Table) -> pa.ChunkedArray:
    """Which rows of an index or batch a filter keeps."""
    column = table[f.attribute[0]]
    if isinstance(f, D.IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, D.StringStartsWith):
        return pc.starts_with(column, f.value)
    if isinstance(f, D.In):
        return pc.is_in(column, value_set=pa.array(list(f.value)).cast(column.type))
    value = f.value
    if pa.types.is_timestamp(column.type) and isinstance(value, datetime) and value.tzinfo is None:
        value = value.astimezone(UTC)
    return getattr(pc, _COMPARED[type(f)])(column, pa.scalar(value, column.type))


def may_match(f: D.Filter, file: dict) -> bool:
    """Whether a file of which a commit tells the URLs' range and the statuses can have a row that the filter keeps."""
    of = f.attribute[0]
    if of == "url" and file.get("first") is not None:
        low, high = file["first"], file["last"]
        if isinstance(f, D.StringStartsWith):
            return low[: len(f.value)] <= f.value <= high[: len(f.value)] or low <= f.value <= high
        if isinstance(f, D.In):
            return any(low <= v <= high for v in f.value)
        if isinstance(f, D.EqualTo | D.EqualNullSafe):
            return low <= f.value <= high
    if of == "status" and file.get("statuses") is not None:
        if isinstance(f, D.In):
            return any(v in file["statuses"] for v in f.value)
        if isinstance(f, D.EqualTo | D.EqualNullSafe):
            return f.value in file["statuses"]
    return True


@dataclass
class Split(D.InputPartition):
    """A stretch of one file."""

    file: str
    start: int
    end: int | None
    indexed: bool

    def __init__(self, file: str, start: int, end: int | None, indexed: bool) -> None:
        self.file, self.start, self.end, self.indexed = file, start, end, indexed


def batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append({k: row[k] for k in schema.names})
        size += len(row["body"] or b"") if "body" in schema.names else 0
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class ArchiveReader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.folder, self.columns = options["path"], schema.names
        unknown = set(self.columns) - set(COLUMNS)
        if unknown:
            raise ValueError(f"an archive has no column {', '.join(sorted(unknown))}")
        self.split = int(options.get("splitBytes", 64 << 20))
        self.filters: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        for f in filters:
            if supported(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Split]:
        folder = local(self.folder)
        listed = Folder(folder).files()
        out = []
        for file in listed:
            if all(may_match(f, file) for f in self.filters):
                out += self._cut(f"{folder}/{file['name']}", file["bytes"], True)
        if not os.path.isdir(f"{folder}/_commits"):
            for name in sorted(os.listdir(folder)):
                path = f"{folder}/{name}"
                if name.endswith(".warc"):
                    out += self._cut(path, os.path.getsize(path), False)
                elif name.endswith(".warc.gz"):
                    out.append(Split(path, 0, None, False))
        return out or [Split("", 0, 0, True)]

    def _cut(self, path: str, size: int, indexed: bool) -> list[Split]:
        return [Split(path, at, min(at + self.split, size), indexed) for at in range(0, size, self.split)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        schema = pa.schema([ARROW.field(c) for c in self.columns])
        if partition.indexed:
            yield from self._by_index(partition, schema)
            return
        with (gzip.open if partition.file.endswith(".gz") else open)(partition.file, "rb") as f:
            rows = (row for head, block in records(f, partition.start, partition.end) if (row := parsed(head, block)) is not None)
            # all columns are there, as filters may be on others than those asked for
            for batch in batches(rows, ARROW):
                table = pa.Table.from_batches([batch])
                for one in self.filters:
                    table = table.filter(mask(one, table))
                yield from table.select(self.columns).to_batches()

    def _by_index(self, split: Split, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        index = pq.read_table(f"{split.file}.index", schema=INDEX)
        index = index.filter(pc.and_(pc.greater_equal(index["at"], split.start), pc.less(index["at"], split.end)))
        for f in self.filters:
            index = index.filter(mask(f, index))
        if not IN_RECORD & set(self.columns):
            yield from index.select(self.columns).to_batches()
            return

        def rows() -> Iterator[dict]:
            with open(split.file, "rb") as f:
                for at, length in zip(index["at"].to_pylist(), index["length"].to_pylist(), strict=True):
                    f.seek(at)
                    raw = f.read(length)
                    lines, _, rest = raw.partition(b"\r\n\r\n")
                    yield parsed(_fields(lines), rest[:-4])

        yield from batches(rows(), schema)


class ArchiveWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.job = Job(options["path"], overwrite)
        self.most = int(options.get("fileBytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, rows = Written(), self._rows(iterator)
        row = next(rows, None)
        while row is not None:
            with self.job.file(".warc") as (name, f):
                index, at = [], 0
                while row is not None and at < self.most:
                    raw = record(row)
                    f.write(raw)
                    known = {c: row[c] for c in INDEX.names if c in COLUMNS} | {"at": at, "length": len(raw)}
                    index.append(known | {"content_type": None, "location": None, "error": row["error"] or "transport"} if row["status"] is None else known)
                    at += len(raw)
                    row = next(rows, None)
            pq.write_table(pa.Table.from_pylist(index, INDEX), f"{self.job.staging}/{name}.index")
            urls, statuses = [r["url"] for r in index], sorted({r["status"] for r in index}, key=lambda s: (s is not None, s))
            done.files.append({"name": name, "beside": [f"{name}.index"], "rows": len(index), "bytes": at, "first": min(urls), "last": max(urls), "statuses": statuses if len(statuses) <= STATUSES else None})
        return done

    @staticmethod
    def _rows(iterator: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in iterator:
            for row in batch.to_pylist():
                row = dict.fromkeys(COLUMNS) | row
                headers = row["headers"]
                yield row | {"headers": list(headers.items()) if isinstance(headers, dict) else headers}

    def commit(self, messages: list[Written | None]) -> None:
        self.job.commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.job.abort()


class ArchiveSource(D.DataSource):
    """Options: path, splitBytes (reading), fileBytes (writing)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        missing = {"url", "status"} - set(schema.names)
        if missing:
            raise ValueError(f"an archive needs the columns {', '.join(sorted(missing))}")
        return ArchiveWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let Spark hand its filters over."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_archive(responses: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Responses (schemas.ROUTE, and error, fetched_at where there) as an archive; rows with a null URL are left out."""
    register(responses.sparkSession)
    rows = responses.where("url IS NOT NULL").select(*[c for c in COLUMNS if c in responses.columns])
    rows.write.format(NAME).options(**options).mode(mode).save(path)


def read_archive(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """An archive's responses, of which only `columns` are read."""
    register(spark)
    reader = spark.read.format(NAME).options(**options)
    if columns is not None:
        kinds = {c.split()[0]: c for c in SCHEMA.split(", ")}
        reader = reader.schema(", ".join(kinds[c] for c in columns))
    return reader.load(path)
