"""The raw corpus as a data source: ``spark.read.format("corpus").load(folder)`` and, as a stream, ``spark.readStream.format("corpus")``.

Rows are those of ``files.scan_corpus``: (name, kind, content, sidecar, sha256) of the documents right in a folder. The driver lists the folder; files are read by
tasks, packed to parts by bytes; the option ``names`` (a pattern as of a shell) narrows the list. Filters are not pushed into the source: with Spark 4.1 those of one query
stay with the DataFrame that was read and would narrow its other queries too. The stream's offset is the hash of each document and its sidecar, so a document comes again when its
content changed and not when it was only touched; a document that is gone gives nothing, as the change plan finds it in the manifest. To hash them, the driver reads each new or touched
file once, one at a time, and the offset has an entry for each document: a first load of a large corpus is better done in batch.

Folders are those that pyarrow's file systems open (local, hdfs, s3, gs); the Spark-readable ``files.scan_corpus`` takes any.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "name string, kind string, content binary, sidecar binary, sha256 string"
SUFFIXES = ("md", "pdf", "docx")
SIDECAR = ".meta.yaml"
#: Bytes of one part; a larger file is one.
PART_BYTES = 32 << 20


@dataclass(frozen=True)
class Found:
    """A listed document: its sizes and times tell whether it may have changed."""

    name: str
    sidecar: str | None
    bytes: int
    stamp: str


@dataclass
class Part(InputPartition):
    files: list[Found]


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


def listed(folder: str, names: str = "*") -> list[Found]:
    system, base = _opened(folder)
    infos = {i.base_name: i for i in system.get_file_info(pafs.FileSelector(base)) if i.type == pafs.FileType.File}
    out = []
    for name, i in sorted(infos.items()):
        stem, _, suffix = name.rpartition(".")
        if suffix.lower() in SUFFIXES and fnmatchcase(name, names):
            side = infos.get(stem + SIDECAR)
            both = [i] + ([side] if side else [])
            out.append(Found(name, side.base_name if side else None, sum(x.size for x in both), ",".join(f"{x.size}/{x.mtime_ns}" for x in both)))
    return out


def packed(files: list[Found], size: int) -> list[Part]:
    """Parts of about ``size`` bytes, in order of names."""
    out: list[Part] = []
    left = 0
    for f in files:
        if not out or f.bytes > left:
            out.append(Part([]))
            left = size
        out[-1].files.append(f)
        left -= f.bytes
    return out


def row_of(system: pafs.FileSystem, base: str, f: Found) -> tuple:
    def read(name: str) -> bytes:
        with system.open_input_stream(f"{base}/{name}") as source:
            return source.read()

    content, sidecar = read(f.name), read(f.sidecar) if f.sidecar else None
    return f.name, f.name.rpartition(".")[2].lower(), content, sidecar, hashlib.sha256(content + (sidecar or b"")).hexdigest()


def rows_of(folder: str, part: Part) -> Iterator[tuple]:
    system, base = _opened(folder)
    for f in part.files:
        yield row_of(system, base, f)


class CorpusReader(DataSourceReader):
    def __init__(self, folder: str, size: int, names: str):
        self.folder, self.size, self.names = folder, size, names

    def partitions(self) -> list[Part]:
        return packed(listed(self.folder, self.names), self.size) or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return rows_of(self.folder, partition)


class CorpusStreamReader(DataSourceStreamReader):
    """Offsets: for each document its hash, and the sizes and times under which it was hashed."""

    def __init__(self, folder: str, size: int, names: str):
        self.folder, self.size, self.names, self.known = folder, size, names, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, base = _opened(self.folder)
        now = {}
        for f in listed(self.folder, self.names):
            before = self.known.get(f.name)
            now[f.name] = before if before and before["stamp"] == f.stamp else {"stamp": f.stamp, "sha256": row_of(system, base, f)[4]}
        self.known = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Part]:
        changed = {n for n, x in end.items() if start.get(n, {}).get("sha256") != x["sha256"]}
        self.known = self.known or end  # after a restart nothing that the checkpoint knows is hashed again
        return packed([f for f in listed(self.folder, self.names) if f.name in changed], self.size)

    def read(self, partition: Part) -> Iterator[tuple]:
        return rows_of(self.folder, partition)


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, int, str]:
        if "path" not in self.options:
            raise ValueError("corpus needs a folder")
        return self.options["path"], int(self.options.get("partBytes", PART_BYTES)), self.options.get("names", "*")

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(*self._given())

    def streamReader(self, schema) -> CorpusStreamReader:
        return CorpusStreamReader(*self._given())


def register(spark: SparkSession) -> None:
    """Makes the format ``corpus`` known to the session."""
    spark.dataSource.register(CorpusSource)
