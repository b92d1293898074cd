"""Uploads as a Spark data source: files of a folder, and each member of its archives, in the order of their names.

    spark.dataSource.register(Uploads)
    spark.read.format("uploads").option("path", folder).load()

Planning lists the folder and the directories of its archives, nothing else.  A partition is a run
of files or of members of one archive up to some megabytes: a large archive is read by many tasks,
each of which seeks to its own members, and a lost task reads its members again.  Folders are
reached by pyarrow's file systems (local, or by the scheme of the path).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..conf import DEFAULT, EXTENSIONS
from .files import LOADERS, Loader, _ext, shown_member

SCHEMA = "doc_id string, position long, filename string, markdown string, title string, source_url string, content_type string, error string"
#: Bytes (of members: unpacked) that a task reads.
PART_BYTES = 32 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace(":", "://", 1))
    return pafs.LocalFileSystem(), path


class _Archive(io.RawIOBase):
    """A file of a file system as zipfile wants it: a seek before the start is an OSError."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        body = self.file.read(len(into))
        into[: len(body)] = body
        return len(body)

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            return self.file.seek(at, whence)
        except ValueError as error:
            raise OSError(str(error)) from error

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()


@dataclass
class Part(InputPartition):
    """Files, or members of one archive: (position, path, member or None, error or None)."""

    items: list[tuple[int, str, str | None, str | None]]


def listed(path: str, limit: int, loaders: dict[str, Loader]) -> Iterator[tuple[str, str | None, int, str | None]]:
    """(path, member, bytes, error) of all uploads under `path`, by name; what cannot be read has its error here."""
    fs, root = _open(path)
    info = fs.get_file_info(root)
    files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    for f in sorted((f for f in files if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
        name, ext = f.base_name, _ext(f.base_name)
        if f.size > limit:
            yield f.path, None, 0, f"{name}: larger than {limit / 1e6:g} MB"
        elif ext not in EXTENSIONS:
            yield f.path, None, 0, f"{name}: unsupported file type; supported are {', '.join(EXTENSIONS)}"
        elif ext != ".zip":
            yield f.path, None, f.size, None
        else:
            try:
                with _Archive(fs, f.path) as data, zipfile.ZipFile(data) as z:
                    members = sorted((m for m in z.infolist() if shown_member(m) and _ext(m.filename) in loaders), key=lambda m: m.filename)
            except (zipfile.BadZipFile, OSError, ValueError) as error:  # a torn archive may point anywhere
                yield f.path, None, 0, f"{name}: {error}"
                continue
            if not members:
                yield f.path, None, 0, f"{name}: no document in the archive"
            for m in members:
                yield f.path, m.filename, m.file_size, f"{m.filename}: larger than {limit / 1e6:g} MB" if m.file_size > limit else None


class UploadReader(DataSourceReader):
    def __init__(self, path: str, limit: int, strict: bool):
        self.path, self.limit, self.strict = path, limit, strict

    def partitions(self) -> Sequence[InputPartition]:
        parts: list[Part] = []
        size, bad = PART_BYTES, []
        for position, (path, member, n, error) in enumerate(listed(self.path, self.limit, LOADERS)):
            if error:
                bad.append(error)
            same = parts and (member is not None) == (parts[-1].items[-1][2] is not None) and (member is None or parts[-1].items[-1][1] == path)
            if not same or size + n > PART_BYTES:
                parts.append(Part([]))
                size = 0
            parts[-1].items.append((position, path, member, error))
            size += n
        if bad and self.strict:
            raise ValueError(f"{len(bad)} uploads are refused: " + "; ".join(bad[:20]))
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        rows: list[tuple] = []
        archive = held = None
        try:
            for position, path, member, error in partition.items:
                name = (member or path).rsplit("/", 1)[-1]
                if error is None:
                    try:
                        if member is None:
                            with fs.open_input_file(path) as f:
                                body = f.read()
                        else:
                            if archive is None:
                                held = _Archive(fs, path)
                                archive = zipfile.ZipFile(held)
                            body = archive.read(member)
                        row = (*LOADERS[_ext(name)](body, name), None)
                    except Exception as failed:
                        error = str(failed)
                rows.append((path if member is None else f"{path}!{member}", position, name, *(row if error is None else (None, None, None, None, error))))
                if len(rows) == 256:
                    yield _batch(rows)
                    rows = []
        finally:
            if held is not None:
                held.close()
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class Uploads(DataSource):
    """Options: `path`; `max_bytes` of a file or member; `strict`, whether one bad upload refuses them all before any is read."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return UploadReader(self.options["path"], int(self.options.get("max_bytes", DEFAULT.max_upload_bytes)), self.options.get("strict", "false").lower() == "true")


def read_uploads(spark: SparkSession, path: str, strict: bool = False, max_bytes: int = DEFAULT.max_upload_bytes) -> DataFrame:
    """Documents of all uploads under `path`, an error row for each that cannot be read; `position` is their order."""
    spark.dataSource.register(Uploads)
    return spark.read.format("uploads").option("path", path).option("strict", str(strict).lower()).option("max_bytes", max_bytes).load()
