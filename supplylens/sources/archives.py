"""Zip archives as a Python data source: batch and stream.

An archive's central directory says where each member lies. The driver reads only the directories and cuts them into stretches of about ``stretch_bytes``
compressed bytes; a task opens the archive, jumps to its stretch and reads no other member's data. Archives of any size are so read by many tasks.

As a stream, the offset holds the etag of each archive (size and time of change); a batch reads the archives whose etag isn't the one of the offset before, so
a restart reads nothing twice. An offset has an entry for each archive, of which there is one for each ecosystem.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from supplylens.sources.files import open_fs

#: Members beyond this size come without content, so that they are rejected and not lost: no record is that long.
LARGEST_MEMBER = 16 << 20
#: Up to this size an archive is read at once.
SMALL_ARCHIVE = 1 << 16
#: Content that a task hands over at once.
BATCH_BYTES = 8 << 20

SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.string())])


@dataclass
class Stretch(InputPartition):
    """Members ``first`` to ``end`` of an archive's central directory, in the order of their places in the file."""

    archive: str
    first: int
    end: int


def archives_below(paths: list[str]) -> dict[str, str]:
    """Etag of each archive: the paths themselves, and the ``.zip`` files right below paths that are folders."""
    found = {}
    for path in paths:
        system, inner = open_fs(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            files = [(f"{path.rstrip('/')}/{i.base_name}", i) for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and i.base_name.endswith(".zip")]
        elif info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        else:
            files = [(path, info)]
        for name, i in files:
            found[name] = f"{i.size}-{i.mtime_ns}"
    return found


def _members(archive: zipfile.ZipFile, suffix: str) -> list[zipfile.ZipInfo]:
    return sorted((i for i in archive.infolist() if i.filename.endswith(suffix)), key=lambda i: i.header_offset)


def _open(archive: str):
    """The archive as a file. Small ones are read whole: an arrow file doesn't let ``zipfile`` look for its records before the start."""
    system, inner = open_fs(archive)
    f = system.open_input_file(inner)
    if f.size() > SMALL_ARCHIVE:
        return f
    with f:
        return io.BytesIO(f.read())


def stretches(archive: str, suffix: str, stretch_bytes: int) -> list[Stretch]:
    """An archive's members dealt into stretches of at least one member, none of which needs another's data."""
    with _open(archive) as f, zipfile.ZipFile(f) as z:
        out, first, held = [], 0, 0
        members = _members(z, suffix)
        for i, info in enumerate(members):
            if held and held + info.compress_size > stretch_bytes:
                out.append(Stretch(archive, first, i))
                first, held = i, 0
            held += info.compress_size + 1
        if members:
            out.append(Stretch(archive, first, len(members)))
        return out


def read_stretch(part: Stretch, suffix: str) -> Iterator[pa.RecordBatch]:
    """(archive, member, content) of a stretch in batches of bounded size. Bytes that aren't UTF-8 become the replacement character."""
    with _open(part.archive) as f, zipfile.ZipFile(f) as z:
        rows: list[tuple[str, str, str | None]] = []
        held = 0
        for info in _members(z, suffix)[part.first : part.end]:
            content = z.read(info).decode("utf-8", "replace") if info.file_size <= LARGEST_MEMBER else None
            rows.append((part.archive, info.filename, content))
            held += len(content or "")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=SCHEMA)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=SCHEMA)


class _Options:
    def __init__(self, options):
        # Spark's option names know no case; ``load`` names one path, a JSON list several.
        self.paths = json.loads(options["paths"]) if options.get("paths") else [options["path"]]
        self.suffix = options.get("suffix", ".json")
        self.stretch_bytes = int(options.get("stretch_bytes", 32 << 20))

    def cut(self, archives) -> list[Stretch]:
        return [s for a in archives for s in stretches(a, self.suffix, self.stretch_bytes)]


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.own = _Options(options)

    def partitions(self) -> list[Stretch]:
        return self.own.cut(sorted(archives_below(self.own.paths)))

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        # Without archives Spark calls this once with no partition.
        return read_stretch(partition, self.own.suffix) if partition is not None else iter(())


class ArchiveStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.own = _Options(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return archives_below(self.own.paths)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        now = archives_below(self.own.paths)
        # What has changed again since the offset was taken belongs to the next batch as well, and is read as it is now.
        return self.own.cut(sorted(a for a, etag in end.items() if start.get(a) != etag and a in now))

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return read_stretch(partition, self.own.suffix)


class ArchiveSource(DataSource):
    """``format("zip_members")``: options ``path`` or ``paths`` (a JSON list), ``suffix`` of members, ``stretch_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, content string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema) -> ArchiveStreamReader:
        return ArchiveStreamReader(self.options)
