"""Findings of a corpus as a data source: `df.write.format("sitelens_findings")` and `spark.read.format("sitelens_findings")`.

A run's report is one document; findings of many sites are files that the executors write, one for each task and field, with one commit (sinks.committed).
`kind` is `jsonl` (the default: one object a line, keys in the order of the schema) or `csv` (RFC 4180 after a byte order mark, flat columns). JSON Lines can be read again: a filter on
`field` opens only the files of these fields, and a filter on `value` is applied where the lines are read.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitelens import schemas
from sitelens.functions import text as T
from sitelens.sinks.committed import Folder, Job, Written, local
from sitelens.storage import ship

NAME = "sitelens_findings"
KINDS = ("jsonl", "csv")
BATCH_ROWS = 2000
_PROVENANCE = pa.struct([("source_url", pa.string()), ("collected_at", pa.timestamp("us", "UTC")), ("extraction_layer", pa.string()), ("raw_value", pa.string())])
ARROW = pa.schema(
    [("field", pa.string()), ("value", pa.string()), ("extraction_confidence", pa.float64()), ("page_support", pa.int32()), ("occurrence_count", pa.int32()), ("first_seen_url", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("provenance", pa.list_(_PROVENANCE))]
)


def _plain(value: object) -> object:
    """As JSON has it: times in UTC with Z, maps as objects."""
    if isinstance(value, datetime):
        return value.astimezone(UTC).isoformat().replace("+00:00", "Z")
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return {k: _plain(v) for k, v in value} if value and isinstance(value[0], tuple) else [_plain(v) for v in value]
    return value


class FindingsWriter(D.DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.kind = options.get("kind", "jsonl")
        if self.kind not in KINDS:
            raise ValueError(f"findings are written as {' or '.join(KINDS)}, not {self.kind}")
        self.columns, self.maps = schema.names, {f.name for f in schema if f.dataType.typeName() == "map"}
        if self.kind == "csv" and any(f.dataType.typeName() in ("map", "array", "struct") for f in schema):
            raise ValueError("csv takes flat columns: flatten the findings first")
        self.job = Job(options["path"], overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = Written()
        with ExitStack() as stack:
            files: dict[str | None, tuple] = {}
            for batch in iterator:
                for row in batch.to_pylist():
                    field = row.get("field")
                    if field not in files:
                        name, raw = stack.enter_context(self.job.file(f".{self.kind}"))
                        files[field] = ({"name": name, "field": field, "rows": 0, "bytes": 0}, raw)
                        self._begin(raw)
                    entry, raw = files[field]
                    raw.write(self._line(row))
                    entry["rows"] += 1
            for entry, raw in files.values():
                entry["bytes"] = raw.tell()
                done.files.append(entry)
        return done

    def _begin(self, raw: io.BufferedWriter) -> None:
        if self.kind == "csv":
            raw.write(b"\xef\xbb\xbf" + self._csv(self.columns))

    def _line(self, row: dict) -> bytes:
        if self.kind == "csv":
            return self._csv(["" if row[c] is None else _plain(row[c]) for c in self.columns])
        plain = {c: dict(row[c]) if c in self.maps and row[c] is not None else _plain(row[c]) for c in self.columns}
        return json.dumps(plain, ensure_ascii=False).encode() + b"\n"

    @staticmethod
    def _csv(values: list) -> bytes:
        out = io.StringIO()
        csv.writer(out, lineterminator="\r\n").writerow(values)
        return out.getvalue().encode()

    def commit(self, messages: list[Written | None]) -> None:
        self.job.commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.job.abort()


class Lines(D.InputPartition):
    """A file of JSON Lines, from one place to another: the lines that begin there."""

    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


class FindingsReader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.folder, self.columns = options["path"], schema.names
        self.split = int(options.get("splitBytes", 64 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        for f in filters:
            of = getattr(f, "attribute", None)
            if of in (("field",), ("value",)) and isinstance(f, D.EqualTo | D.In) and f.value is not None:
                values = set(f.value) if isinstance(f, D.In) else {f.value}
                self.wanted[of[0]] = self.wanted.get(of[0], values) & values
            else:
                yield f

    def partitions(self) -> list[Lines]:
        files = [f for f in Folder(self.folder).files() if f["name"].endswith(".jsonl") and ("field" not in self.wanted or f["field"] in self.wanted["field"])]
        return [Lines(f"{local(self.folder)}/{f['name']}", at, min(at + self.split, f["bytes"])) for f in files for at in range(0, f["bytes"], self.split)] or [Lines("", 0, 0)]

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        schema = pa.schema([ARROW.field(c) for c in self.columns])
        held: list[dict] = []
        with open(partition.file, "rb") as f:
            at = partition.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.end and (line := f.readline()):
                at += len(line)
                row = json.loads(line)
                if all(row.get(c) in values for c, values in self.wanted.items()):
                    held.append({c: self._read(c, row.get(c)) for c in self.columns})
                if len(held) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    @staticmethod
    def _read(column: str, value: object) -> object:
        if column == "metadata" and value is not None:
            return list(value.items())
        if column == "provenance" and value is not None:
            return [p | {"collected_at": p["collected_at"] and datetime.fromisoformat(p["collected_at"].replace("Z", "+00:00"))} for p in value]
        return value


class FindingsSource(D.DataSource):
    """Options: path, kind (writing), splitBytes (reading)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return schemas.FINDING

    def reader(self, schema: StructType) -> FindingsReader:
        return FindingsReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> FindingsWriter:
        return FindingsWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FindingsSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_findings(found: DataFrame, path: str, kind: str = "jsonl", mode: str = "append") -> None:
    """Findings as files of the executors. csv gets a row for each finding without its provenance, formulas guarded."""
    register(found.sparkSession)
    if kind == "csv":
        found = found.select(*[_flat(found, c) for c in found.columns if c != "provenance"])
    found.write.format(NAME).option("kind", kind).mode(mode).save(path)


def _flat(found: DataFrame, name: str) -> Column:
    kind = found.schema[name].dataType.typeName()
    if kind == "map":
        return T.formula_guard(F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")).alias(name)
    return T.formula_guard(F.col(name)).alias(name) if kind == "string" else F.col(name)


def read_findings(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """Written findings (JSON Lines), of which only `columns` are made."""
    register(spark)
    reader = spark.read.format(NAME).options(**options)
    if columns is not None:
        known = spark.createDataFrame([], schemas.FINDING).schema
        reader = reader.schema(StructType([known[c] for c in columns]))
    return reader.load(path)
