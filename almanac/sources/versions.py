"""Tables that are replaced partition by partition, and read as one version.

A table is a folder with data and manifests. Publishing writes the partitions that a batch touches
into a folder of its own, and then a manifest that names for every partition the folder that holds
it; the others stay where they were. A reader takes the newest manifest, so it sees all of a batch
or nothing of it, and a write that fails leaves files that nothing names. Two writers at once cannot
both take the next number: the later one gets an error and has to merge again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_VERSION = "almanac_version"


class ConflictError(RuntimeError):
    """Another writer has published in the meantime."""


@dataclass
class Manifest:
    """``folders``: of each partition (as in its path) the version that holds it."""

    number: int = 0
    schema: str = ""
    folders: dict[str, str] = field(default_factory=dict)


class VersionedTable:
    """``keys``: the partition columns, such as the year; whole numbers or text."""

    def __init__(self, spark: SparkSession, path: str, keys: Iterable[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def _at(self, *parts: str):
        """File system and path, through Spark's own settings."""
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def _names(self, *parts: str) -> list[str]:
        fs, place = self._at(*parts)
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

    def numbers(self) -> list[int]:
        """Versions that can be read, oldest first."""
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json"))

    def manifest(self, number: int | None = None) -> Manifest:
        numbers = self.numbers()
        if number is None:
            if not numbers:
                return Manifest()
            number = numbers[-1]
        if number not in numbers:
            raise ValueError(f"there is no version {number} of {self.path}")
        fs, place = self._at("manifests", f"{number:010d}.json")
        stream = fs.open(place)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def read(self, number: int | None = None) -> DataFrame:
        """One version, the newest if none is named. Filters on the keys choose folders."""
        found = self.manifest(number)
        if not found.schema:
            raise ValueError(f"nothing was published to {self.path}")
        schema = T.StructType.fromJson(json.loads(found.schema))
        if not found.folders:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*schema.fields, T.StructField(_VERSION, T.StringType())])
        paths = [f"{self.path}/data/{_VERSION}={v}/{p}" for p, v in sorted(found.folders.items())]
        reader = self.spark.read.schema(whole).option("basePath", f"{self.path}/data")
        return reader.parquet(*paths).drop(_VERSION)

    def publish(
        self, rows: DataFrame, touched: Iterable[tuple] | None = None,
        base: Manifest | None = None, order: Iterable[str] = (), cut: bool = False,
    ) -> Manifest:
        """Replace the partitions ``touched`` (values of the keys) by the rows, which have to lie in
        them; a touched partition without rows goes. Without ``touched`` the rows are the whole new
        table. ``base`` is the manifest that the rows were made from, if it was read before: if
        another one is newest by now, nothing is published. Rows are ordered within files by
        ``order``, and the files cut by it. ``cut`` tells that the rows' partitions are cut by it
        already: they are not shuffled then, and each partition has a file in every folder it fills.
        """
        base = self.manifest() if base is None else base
        version, order = uuid.uuid4().hex, list(order)
        if order:
            rows = rows if cut else rows.repartitionByRange(*self.keys, *order)
            rows = rows.sortWithinPartitions(*self.keys, *order)
        columns = [c for c in rows.columns if c not in self.keys]
        rows = rows.select(*columns, *self.keys)  # as they are read back
        rows.write.partitionBy(*self.keys).parquet(f"{self.path}/data/{_VERSION}={version}")
        written = set(self._partitions("data", f"{_VERSION}={version}"))
        kept = {}
        if touched is not None:
            gone = {self._folder(values) for values in touched}
            if written - gone:
                raise ValueError(f"rows outside the partitions touched: {sorted(written - gone)[:3]}")
            kept = {p: v for p, v in base.folders.items() if p not in gone}
        new = Manifest(base.number + 1, rows.schema.json(), {**kept, **dict.fromkeys(written, version)})
        self._commit(new)
        return new

    def _folder(self, values: tuple) -> str:
        return "/".join(f"{k}={quote(str(v), safe=' -_.')}" for k, v in zip(self.keys, values, strict=True))

    def _partitions(self, *parts: str) -> list[str]:
        if len(parts) == 2 + len(self.keys):
            return ["/".join(parts[2:])]
        names = [n for n in self._names(*parts) if n[:1] not in "_."]
        return [p for n in names for p in self._partitions(*parts, n)]

    def _commit(self, manifest: Manifest) -> None:
        """The manifest appears whole, under a number that no other has."""
        fs, target = self._at("manifests", f"{manifest.number:010d}.json")
        _, draft = self._at("manifests", f"_{uuid.uuid4().hex}")
        if self.numbers()[-1:] not in ([], [manifest.number - 1]):
            raise ConflictError(f"version {manifest.number} of {self.path} is there already")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(vars(manifest)).encode()))
        stream.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(
            getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0
        )
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), fs.getConf())
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(target), options)  # never replaces
        except Exception as e:
            fs.delete(draft, False)
            raise ConflictError(f"version {manifest.number} of {self.path} is there already") from e

    def forget(self, keep: int = 1) -> list[str]:
        """Remove all but the newest ``keep`` versions, and data that none of those names, such as
        what failed writes left. Nobody may be writing or reading older ones."""
        numbers = self.numbers()
        fs, _ = self._at()
        for n in numbers[:-keep]:
            fs.delete(self._at("manifests", f"{n:010d}.json")[1], False)
        used = {f"{_VERSION}={v}/{p}" for n in numbers[-keep:] for p, v in self.manifest(n).folders.items()}
        gone = []
        for version in self._names("data"):
            for p in self._partitions("data", version):
                if f"{version}/{p}" not in used:
                    fs.delete(self._at("data", version, p)[1], True)
                    gone.append(f"{version}/{p}")
            if not self._partitions("data", version):
                fs.delete(self._at("data", version)[1], True)
        return gone
