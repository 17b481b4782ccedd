"""WARC archives as a Python data source of Spark.

Writing: each task writes archives of bounded size, one gzip member a record. A member tells its
compressed and its full size in a field of its header (subfield ``sl``), so that a reader can pass
over it. The names of the archives that tasks have committed go into a manifest, one for each write;
what failed or repeated attempts leave behind is in none and is never read. Overwriting replaces the
manifests and removes the archives they name.

Reading: a partition is some archives of together bounded size: those that the manifests of a folder
name or, in a folder without any, all its files ``*.warc`` and ``*.warc.gz``, also in folders below;
the path may be one such file, too. Conditions on record type and headers are pushed into the
source: those that are given by name, and with ``once`` also the equality and membership conditions
of a plan. Spark 4.1 keeps the latter with the source, for whatever else is done with the same
DataFrame, which would lose records; so they are only taken from plans that use it once. Of each record only the headers are looked at first; if they don't meet
the conditions, or no payload is asked for, the rest is passed over: not decompressed in archives
written here, not kept in compressed ones of other writers, not read in plain ones.

The payload is what follows the HTTP headers in a block of ``application/http``, and the whole block
of any other record. It is given as it is archived: transfer and content encodings stay.

Paths are opened by ``pyarrow.fs``, with the schemes it knows (local files, object stores, HDFS).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from almanac.llm.common import stored

MANIFEST = "_archives-{}.json"
ROLL_BYTES = 128 << 20
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
_CHUNK = 1 << 20
_HEAD = 4096
LEVEL = 4

#: Header lines of the format.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "warc_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

COLUMNS = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, payload binary"


#: The digits of base 32, as Spark writes them and as the format has them.
_DIGITS, _LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1, as in ``WARC-Payload-Digest``; missing data count as empty."""
    digest = F.sha1(F.coalesce(data.cast("binary"), F.lit(b"")))
    # Five bytes are eight digits.
    parts = (F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4))
    return F.translate(F.concat(*parts), _DIGITS, _LETTERS)


def _clean(value: str) -> str:
    """A header value is one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def _record(row: dict) -> bytes:
    """A record as a gzip member with its sizes in the header."""
    payload = row["payload"] or b""
    revisit = row["warc_type"] == "revisit"
    block = _HTTP.encode()
    if not revisit:
        block += f"Content-Length: {len(payload)}\r\n".encode()
    block += b"\r\n" + (b"" if revisit else payload)
    lines = ["WARC/1.1"]
    for column, header in HEADERS.items():
        value = row[column]
        if value is not None:
            value = f"<{value}>" if column in ("record_id", "refers_to") else value
            value = f"sha1:{value}" if column == "payload_digest" else value
            lines.append(f"{header}: {_clean(value)}")
    if revisit:
        lines.append(f"WARC-Profile: {_PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    full = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(full) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(full), len(full) & 0xFFFFFFFF)
    extra = 2 + 4 + 16
    size = 10 + extra + len(body) + len(tail)
    head = b"\x1f\x8b\x08\x04" + b"\0\0\0\0" + b"\0\xff" + struct.pack(
        "<H2sHQQ", extra - 2, b"sl", 16, size, len(full)
    )
    return head + body + tail


@dataclass
class _Written(WriterCommitMessage):
    archives: list[tuple[str, int, int]]  # name, bytes, records


def _manifests(system: pafs.FileSystem, base: str) -> list[str]:
    """Paths of the manifests of a folder."""
    found = system.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    before, after = MANIFEST.split("{}")
    return sorted(
        i.path for i in found if i.base_name.startswith(before) and i.base_name.endswith(after)
    )


def _archives_of(system: pafs.FileSystem, manifest: str) -> list[tuple[str, int, int]]:
    with system.open_input_stream(manifest, compression=None) as f:
        return [tuple(a) for a in json.loads(f.read())]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, roll: int, overwrite: bool = False):
        self.path, self.roll, self.overwrite = path, roll, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, base = pafs.FileSystem.from_uri(self.path)
        system.create_dir(base, recursive=True)
        done, out, size, records, name = [], None, 0, 0, ""
        for batch in iterator:
            columns = batch.schema.names
            for values in zip(*batch.columns, strict=True):
                data = _record(dict(zip(columns, (v.as_py() for v in values), strict=True)))
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data)
                size += len(data)
                records += 1
                if size >= self.roll:
                    out.close()
                    done.append((name, size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, records))
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        system, base = pafs.FileSystem.from_uri(self.path)
        system.create_dir(base, recursive=True)
        archives = [a for m in messages if m for a in m.archives]
        before = _manifests(system, base) if self.overwrite else []
        name = MANIFEST.format(uuid.uuid4().hex)
        with system.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(json.dumps(archives).encode())
        for manifest in before:
            names = [a[0] for a in _archives_of(system, manifest)]
            system.delete_file(manifest)
            for old in names:
                system.delete_file(f"{base}/{old}")

    def abort(self, messages: list[_Written | None]) -> None:
        system, base = pafs.FileSystem.from_uri(self.path)
        for name, _, _ in (a for m in messages if m for a in m.archives):
            system.delete_file(f"{base}/{name}")


@dataclass
class _Archives(InputPartition):
    paths: tuple[str, ...]


class _Stream:
    """Bytes of an archive, from a buffer that is filled in chunks."""

    def __init__(self, file):
        self.file, self.buffer, self.at = file, b"", 0

    def fill(self, n: int) -> bool:
        while len(self.buffer) - self.at < n:
            more = self.file.read(max(_CHUNK, n - len(self.buffer) + self.at))
            if not more:
                return False
            self.buffer, self.at = self.buffer[self.at :] + more, 0
        return True

    def skip(self, n: int) -> None:
        have = len(self.buffer) - self.at
        if n > have:
            self.file.seek(n - have, 1)
            self.buffer, self.at = b"", 0
        else:
            self.at += n


class _Inflated:
    """What a compressed file holds, as a file. Its gzip members follow one another, whatever they
    hold: a record each, as the format wants, or many."""

    def __init__(self, file):
        self.file, self.unpack, self.rest, self.ended = file, None, b"", False

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n and not self.ended:
            self.rest = self.rest or self.file.read(_CHUNK)
            if not self.rest:
                if self.unpack is not None:
                    raise ValueError("an archive ends within a record")
                self.ended = True
                break
            if self.unpack is None:
                self.unpack = zlib.decompressobj(31)
            out += self.unpack.decompress(self.rest, n - len(out))
            self.rest = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.rest, self.unpack = self.unpack.unused_data, None
        return out

    def seek(self, n: int, _whence: int) -> None:
        while n > 0 and (got := len(self.read(min(n, _CHUNK)))):
            n -= got


def _plain(file) -> Iterator[tuple[bytes, object]]:
    """For each record of uncompressed ones its headers, and a function that gives all of it."""
    stream = _Stream(file)
    while True:
        while stream.fill(1) and stream.buffer[stream.at : stream.at + 1] in b"\r\n":
            stream.skip(1)
        if not stream.fill(1):
            return
        size = _HEAD
        while (end := stream.buffer.find(b"\r\n\r\n", stream.at)) < 0:
            if not stream.fill(size):
                raise ValueError("a record without an end of its headers")
            size = len(stream.buffer) - stream.at + _HEAD
        head = stream.buffer[stream.at : end + 4]
        lines, start = _headers(head)
        whole_size = start + int(lines.get("content-length", 0))

        def whole(size: int = whole_size) -> bytes:
            if not stream.fill(size):
                raise ValueError("an archive ends within a record")
            return stream.buffer[stream.at : stream.at + size]

        yield head, whole
        stream.skip(whole_size)


def _records(file) -> Iterator[tuple[bytes, object]]:
    """For each record its first bytes, and a function that gives all of it. The caller may leave
    that uncalled; the record is then passed over. Of members written here the size is known."""
    stream = _Stream(file)
    while stream.fill(1):
        stream.fill(_HEAD)
        start = stream.buffer[stream.at : stream.at + _HEAD]
        if not (start[:4] == b"\x1f\x8b\x08\x04" and start[12:14] == b"sl"):
            file.seek(stream.at - len(stream.buffer), 1)
            yield from _plain(_Inflated(file) if start[:2] == b"\x1f\x8b" else file)
            return
        size = struct.unpack("<Q", start[16:24])[0]

        def whole(size: int = size) -> bytes:
            if not stream.fill(size):
                raise ValueError("an archive ends within a record")
            return zlib.decompress(stream.buffer[stream.at : stream.at + size], 31)

        yield zlib.decompressobj(31).decompress(start, _HEAD), whole
        stream.skip(size)


def _headers(head: bytes) -> tuple[dict[str, str], int] | None:
    """Header lines by lower-case name and where the block starts; none if more bytes are needed."""
    end = head.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = head[:end].decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}, end + 4


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, wanted: dict[str, list[str]]):
        self.path, self.columns = path, schema.fieldNames()
        self.wanted = {name: set(values) for name, values in wanted.items()}

    def partitions(self) -> list[_Archives]:
        system, base = pafs.FileSystem.from_uri(self.path)
        if system.get_file_info(base).type == pafs.FileType.File:
            return [_Archives((base,))]
        if manifests := _manifests(system, base):
            archives = [
                (f"{base}/{name}", n) for m in manifests for name, n, _ in _archives_of(system, m)
            ]
        else:
            found = system.get_file_info(pafs.FileSelector(base, recursive=True))
            archives = sorted(
                (i.path, i.size) for i in found if i.base_name.endswith((".warc", ".warc.gz"))
            )
        out, own, size = [], [], 0
        for path, n in archives:
            if own and size + n > PARTITION_BYTES:
                out.append(_Archives(tuple(own)))
                own, size = [], 0
            own.append(path)
            size += n
        return [*out, _Archives(tuple(own))] if own or not out else out

    def read(self, partition: _Archives) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(self.path)
        types = {c: pa.string() for c in HEADERS}
        types |= {"content_length": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, types[c]) for c in self.columns])
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for head, whole in _records(file):
                    row = self._row(head, whole)
                    if row is None:
                        continue
                    rows.append(row)
                    size += 300 + len(row.get("payload") or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _row(self, head: bytes, whole) -> dict | None:
        data = None
        found = _headers(head)
        if found is None:
            data = whole()
            found = _headers(data)
            if found is None:
                raise ValueError("a record without an end of its headers")
        lines, start = found
        row = {}
        for column, header in HEADERS.items():
            value = lines.get(header.lower())
            if value is not None and column in ("record_id", "refers_to"):
                value = value.strip("<>")
            if value is not None and column == "payload_digest":
                value = value.removeprefix("sha1:")
            if column in self.wanted and value not in self.wanted[column]:
                return None
            row[column] = value
        length = int(lines.get("content-length", 0))
        row["content_length"] = length
        if "payload" in self.columns:
            data = whole() if data is None else data
            block = data[start : start + length]
            http = lines.get("content-type", "").lower().startswith("application/http")
            row["payload"] = block.partition(b"\r\n\r\n")[2] if http else block
        return row


class _PushingReader(_Reader):
    """Takes the conditions of the plan."""

    def pushFilters(self, filters):
        for f in filters:
            own = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if own in HEADERS and len(f.attribute) == 1:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[own] = self.wanted.get(own, values) & values
            else:
                yield f


class WarcDataSource(DataSource):
    """``format("warc")`` with the option ``path``, a folder; ``wanted`` (JSON) has the values of
    columns that are asked for, and ``once`` says that conditions of the plan may be taken."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _PushingReader if self.options.get("once") == "true" else _Reader
        return kind(self.options["path"], schema, json.loads(self.options.get("wanted", "{}")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], int(self.options.get("roll_bytes", ROLL_BYTES)), overwrite)


def _as_uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def write_warc(records: DataFrame, path: str, mode: str = "append") -> None:
    """Write records, with the columns of ``COLUMNS`` but ``content_length``, to a folder: ``append``
    adds to those written there before, ``overwrite`` replaces them. A record without a type is a
    response; missing payloads are empty, records may repeat, an empty table adds none."""
    records.sparkSession.dataSource.register(WarcDataSource)
    columns = [F.col(c).cast("string").alias(c) for c in HEADERS if c != "warc_type"]
    records.select(
        F.coalesce("warc_type", F.lit("response")).alias("warc_type"),
        *columns,
        F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"),
    ).write.format("warc").mode(mode).option("path", _as_uri(path)).save()


def read_warc(
    spark: SparkSession, path: str, payload: bool = True,
    wanted: dict[str, Iterable[str]] | None = None, once: bool = False,
) -> DataFrame:
    """The records of a folder. ``wanted`` names values of columns (``warc_type`` and other headers):
    the source gives the records that have one of them. With ``once`` it takes such conditions from
    the plan, too; the result must then not be used more than once, in one plan or in several. That
    turns on the session's push-down to Python sources."""
    own = {name: sorted(values) for name, values in (wanted or {}).items()}
    if not own.keys() <= HEADERS.keys():
        raise ValueError(f"there are values of {', '.join(HEADERS)} only")
    spark.dataSource.register(WarcDataSource)
    if once:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    columns = COLUMNS if payload else COLUMNS.rsplit(",", 1)[0]
    reader = spark.read.format("warc").schema(columns).option("path", _as_uri(path))
    return reader.option("wanted", json.dumps(own)).option("once", str(once).lower()).load()


def page_records(
    pages: DataFrame, date: str, least: int = 0, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html",
) -> DataFrame:
    """Records of pages: of those with equal payloads of at least ``least`` bytes the one with the
    smallest id is a response, the others are revisits that refer to it; smaller ones are all
    responses. A missing payload is empty, a page without an id is a response of its own. Repeated
    rows are repeated records, an empty table gives none.

    Which pages are copies is decided on a stored table of ids, sizes and digests, made in one scan.
    The pages then meet the revisits by id and digest, which moves whole payloads unless the
    revisits are few enough for Spark to send them around."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    own = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("target_uri"),
        payload.alias("payload"),
        base32_sha1(payload).alias("payload_digest"),
    )
    marks = stored(own.select("id", "payload_digest", F.octet_length("payload").alias("size")), "pages")
    large = marks.where((F.col("size") >= least) & F.col("id").isNotNull())
    copies = (
        large.select("payload_digest", "id").groupBy("payload_digest")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
        .where("first < last").select("payload_digest", "first")
    )
    revisits = (
        large.select("id", "payload_digest").distinct().join(copies, "payload_digest")
        .where("id > first").select("id", "payload_digest", "first")
    )
    name = lambda c: F.concat(
        F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(":"),
        F.col("payload_digest"),
    )
    return own.join(revisits, ["id", "payload_digest"], "left").select(
        name("id").alias("record_id"),
        F.when(F.col("first").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
        .alias("warc_type"),
        "target_uri",
        F.lit(date).alias("warc_date"),
        F.when(F.col("first").isNotNull(), name("first")).alias("refers_to"),
        "payload_digest",
        F.when(F.col("first").isNull(), F.col("payload")).alias("payload"),
    )
