"""Landed responses as a data source of Spark, a file for each request.

Requests form a grid: a station, and a chunk of days of it (``backfill_plan``). The response to one
lands in ``<station>/<first day>_<last day>.json``, so what a file answers is known from its name.
Stations and days are chosen in the source: of other stations not even the
folder is listed, and files of other days are not opened. They are options of the source, not
conditions it takes from the plan: Spark 4.1 keeps those with the source, for whatever else is done
with the same DataFrame. Unlike Spark's own reader this one also gives files of zero bytes, which are
answers that say nothing.

Paths are opened by ``pyarrow.fs``, with the schemes it knows (local files, object stores, HDFS).
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from almanac.operators.statistics import Day
from almanac.functions import parse_day
from almanac.sources.landing import decode_records, records_in

SCHEMA = "STATION string, chunk_start date, chunk_end date, file string, size long, body string"
REQUEST = ["STATION", "chunk_start", "chunk_end"]
_NAME = re.compile(r"([0-9]{4}-[0-9]{2}-[0-9]{2})_([0-9]{4}-[0-9]{2}-[0-9]{2})\.json")
#: Bytes of files in a partition, about; a file of any size counts as so many at least.
PARTITION_BYTES, FILE_BYTES = 32 << 20, 64 << 10
_BATCH_BYTES = 4 << 20


def response_name(station: str, start: dt.date, end: dt.date) -> str:
    """Where the response to a request lands, below the landing folder."""
    return f"{quote(station, safe='')}/{start.isoformat()}_{end.isoformat()}.json"


@dataclass
class _File:
    station: str
    start: dt.date
    end: dt.date
    path: str
    size: int


@dataclass
class _Files(InputPartition):
    files: tuple[_File, ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.columns = options["path"], schema.fieldNames()
        named = options.get("stations")
        self.stations = None if named is None else sorted(set(json.loads(named)))
        day = lambda k: dt.date.fromisoformat(options[k]) if k in options else None
        self.start, self.end = day("start"), day("end")

    def _wanted(self, start: dt.date, end: dt.date) -> bool:
        return (self.start is None or end >= self.start) and (self.end is None or start <= self.end)

    def partitions(self) -> list[_Files]:
        system, base = pafs.FileSystem.from_uri(self.path)
        if self.stations is None:
            found = system.get_file_info(pafs.FileSelector(base))
            folders = sorted(i.path for i in found if i.type == pafs.FileType.Directory)
        else:
            folders = [f"{base}/{quote(s, safe='')}" for s in self.stations]
        out, own, size = [], [], 0
        for folder in folders:
            station = unquote(folder.rsplit("/", 1)[1])
            listed = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
            for i in sorted(listed, key=lambda i: i.path):
                named = _NAME.fullmatch(i.base_name)
                if not named:
                    continue
                start, end = map(dt.date.fromisoformat, named.groups())
                if not self._wanted(start, end):
                    continue
                if own and size + max(i.size, FILE_BYTES) > PARTITION_BYTES:
                    out.append(_Files(tuple(own)))
                    own, size = [], 0
                own.append(_File(station, start, end, i.path, i.size))
                size += max(i.size, FILE_BYTES)
        return [*out, _Files(tuple(own))] if own or not out else out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(self.path)
        kinds = {"chunk_start": pa.date32(), "chunk_end": pa.date32(), "size": pa.int64()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        rows, size = [], 0
        for f in partition.files:
            row = {"STATION": f.station, "chunk_start": f.start, "chunk_end": f.end, "file": f.path, "size": f.size}
            if "body" in self.columns:
                with system.open_input_stream(f.path, compression=None) as stream:
                    row["body"] = stream.read().decode("utf-8", "replace")
            rows.append(row)
            size += 200 + f.size
            if size >= _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


@dataclass
class _Landed(WriterCommitMessage):
    files: int


class _Writer(DataSourceArrowWriter):
    """Files appear whole under their name; one that is there is replaced, as by a later answer."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Landed:
        system, base = pafs.FileSystem.from_uri(self.path)
        n, folders = 0, set()
        for batch in iterator:
            columns = [batch.column(c) for c in (*REQUEST, "body")]
            for values in zip(*columns, strict=True):
                station, start, end, body = (v.as_py() for v in values)
                target = f"{base}/{response_name(station, start, end)}"
                folder = target.rsplit("/", 1)[0]
                if folder not in folders:
                    system.create_dir(folder, recursive=True)
                    folders.add(folder)
                draft = f"{folder}/_{uuid.uuid4().hex}"
                with system.open_output_stream(draft, compression=None) as out:
                    out.write((body or "").encode())
                system.move(draft, target)
                n += 1
        return _Landed(n)

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        """What has landed stays: it is an answer whatever became of the others."""


class ResponsesDataSource(DataSource):
    """``format("landed_responses")`` with the option ``path``, the landing folder, and to choose
    from it ``stations`` (JSON), ``start`` and ``end``."""

    @classmethod
    def name(cls) -> str:
        return "landed_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def _as_uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def land_responses(responses: DataFrame, path: str) -> None:
    """Write bodies (``STATION``, ``chunk_start``, ``chunk_end``, ``body``) as landed files. A missing
    body is a file of zero bytes."""
    responses.sparkSession.dataSource.register(ResponsesDataSource)
    picked = responses.select(F.col("STATION").cast("string").alias("STATION"), *REQUEST[1:], "body")
    picked.write.format("landed_responses").mode("append").option("path", _as_uri(path)).save()


def read_responses(
    spark: SparkSession,
    path: str,
    body: bool = True,
    stations: Iterable[str] | None = None,
    start: Day | None = None,
    end: Day | None = None,
) -> DataFrame:
    """A row for each landed file, of some stations and of requests that reach into a range of days if
    these are given. Without ``body`` the files are listed, not opened. Files of other names are
    passed over."""
    spark.dataSource.register(ResponsesDataSource)
    schema = SCHEMA if body else SCHEMA.rsplit(",", 1)[0]
    reader = spark.read.format("landed_responses").schema(schema).option("path", _as_uri(path))
    if stations is not None:
        reader = reader.option("stations", json.dumps(list(stations)))
    for name, day in (("start", start), ("end", end)):
        if day is not None:
            reader = reader.option(name, parse_day(day).isoformat())
    return reader.load()


def response_records(responses: DataFrame) -> DataFrame:
    """The daily records of the bodies. Those that ``rejected_responses`` lists add none."""
    return decode_records(responses.select("body"))


def rejected_responses(responses: DataFrame) -> DataFrame:
    """Files that answer nothing: of zero bytes, blank, malformed, or no array of records."""
    return responses.where(records_in(F.col("body")).isNull())


def open_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """The requests of a plan that have not been answered yet, or with what is rejected."""
    answered = responses.where(records_in(F.col("body")).isNotNull()).select(*REQUEST)
    return requests.join(answered, REQUEST, "left_anti").select(*requests.columns)
