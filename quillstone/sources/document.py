"""Folders of documents as a Spark data source: ``spark.read.format("document").load(folder)``.

Reading gives a row for each page, slide, sheet, paragraph or mail part. Planning lists the files and packs them into
partitions of about ``split`` bytes by their sizes, so neither one large folder nor many small files make uneven
tasks; the option ``open`` states what opening a file costs, in bytes, and is less where all are small and near. Filters on path and size, and on a kind that a file's name tells, are applied to the list: what
they leave out is never opened. With a schema of path and size only (``.schema("path string, size long")``), no file is opened.

Writing makes a file of each row (name, kind, content): ``df.write.format("document").mode("append").save(folder)``; the
lines of content are the file's lines. A file is written under a name of its own and then moved, so that a repeated task leaves whole files.

Folders are found through pyarrow's file systems (local paths, file:, hdfs:, s3: and others it knows); for other stores
there is ``files.scan``, which reads through Spark. Register with ``register(spark)``.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from quillstone.session import ship
from quillstone.sources.detect import EXTENSIONS, IMAGE_MAGIC, LARGEST

SCHEMA = "path string, size long, kind string, number int, part string, content string, error string"
WRITTEN = "name string, kind string, content string"
SPLIT = 64 << 20
#: What opening a file costs, in bytes read; and what naming one costs that isn't opened.
OPEN, NAMED = 1 << 20, 1 << 10
_BY_NAME = EXTENSIONS | {".html": "html", ".htm": "html", ".xhtml": "html", ".epub": "epub"}
_MARKS = [(b"%PDF", "pdf"), *((bytes.fromhex(x), "image") for x in IMAGE_MAGIC)]


def kind_by_name(path: str) -> str | None:
    """The kind that a file's name tells, None where only its bytes do."""
    name = path.rpartition("/")[2].lower()
    return _BY_NAME.get("." + name.rpartition(".")[2]) if "." in name else None


def kind_of(path: str, data: bytes) -> str:
    if known := kind_by_name(path):
        return known
    for mark, kind in _MARKS:
        if data.startswith(mark):
            return kind
    if data.startswith(b"PK\x03\x04"):
        return next((kind for mark, kind in ((b"word/", "docx"), (b"ppt/", "pptx"), (b"xl/", "xlsx")) if mark in data), "zip")
    return "eml" if b"From:" in data[:1000] or b"To:" in data[:1000] else "txt"


def _store(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Files(InputPartition):
    """Files of one task: (path, size)."""

    files: list[tuple[str, int]]


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path = options["path"]
        self.glob = options.get("glob", "*")
        self.split = int(options.get("split", SPLIT))
        self.open = int(options.get("open", OPEN))
        self.largest = int(options.get("largest", LARGEST))
        self.columns = schema.names
        self.filters: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  the interface's name
        """Takes what the list of files can decide; a filter on kind is repeated by Spark for files whose name doesn't tell."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and name in ("path", "size", "kind"):
                self.filters.append((name, type(f), f.value))
                if name != "kind":
                    continue
            yield f

    def _wanted(self, path: str, size: int) -> bool:
        values = {"path": path, "size": size, "kind": "oversize" if size > self.largest else kind_by_name(path)}
        return all(values[name] is None or _TESTS[kind](values[name], value) for name, kind, value in self.filters)

    def listed(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        store, root = _store(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        below = lambda p: p[len(root) :].strip("/").split("/")
        found = [(f.path, f.size) for f in infos if f.type == fs.FileType.File and not any(x.startswith(("_", ".")) for x in below(f.path)) and fnmatch.fnmatch(f.base_name, self.glob)]
        return sorted(f for f in found if self._wanted(*f))

    @property
    def opened(self) -> bool:
        return any(c not in ("path", "size") for c in self.columns)

    def partitions(self) -> list[Files]:
        out, now, filled = [], [], 0
        for path, size in self.listed():
            cost = min(size, self.largest) + self.open if self.opened else NAMED
            if now and filled + cost > self.split:
                out.append(Files(now))
                now, filled = [], 0
            now.append((path, size))
            filled += cost
        return [*out, Files(now)] if now else out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from quillstone.sources import files

        store, _ = _store(self.path)
        for path, size in partition.files:
            if not self.opened:
                rows = [(None, None, None, None, None)]
            elif size > self.largest:
                rows = [("oversize", None, None, None, None)]
            else:
                try:
                    with store.open_input_stream(path) as stream:
                        data = stream.read()
                except OSError as bad:  # gone or closed since it was listed
                    rows = [(None, None, None, None, f"{type(bad).__name__}: {bad}")]
                else:
                    rows = files.parsed(kind_of(path, data), data)
            for kind, number, part, content, error in rows:
                own = {"path": path, "size": size, "kind": kind, "number": number, "part": part, "content": content, "error": error}
                yield tuple(own[c] for c in self.columns)


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("files are added to a folder; use mode append")
        self.path = options["path"]
        self.at = [schema.names.index(c) for c in ("name", "kind", "content")]

    def write(self, rows) -> WriterCommitMessage:
        from quillstone.sources.encode import ENCODERS

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        for row in rows:
            name, kind, content = (row[i] for i in self.at)
            if "/" in name:
                raise ValueError(f"a file's name has no slash: {name!r}")
            data = ENCODERS[kind](name, content.split("\n") if content else [])
            ready = f"{root}/.{name}-{uuid.uuid4().hex}"
            with store.open_output_stream(ready) as out:
                out.write(data)
            store.move(ready, f"{root}/{name}.{kind}")
        return WriterCommitMessage()


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DocumentReader:
        known = [c.split()[0] for c in SCHEMA.split(", ")]
        if unknown := [c for c in schema.names if c not in known]:
            raise ValueError(f"no columns {unknown}; known: {known}")
        return DocumentReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters handed down to it."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentSource)
