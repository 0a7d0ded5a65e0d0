"""Files that tasks open themselves, where Spark has no reader or writer for their format.

Paths may have any scheme that ``pyarrow.fs`` knows (local, ``hdfs:``, ``s3:``, ``gs:`` and so on); without one they are local, or on a mount that all tasks share.
"""

from __future__ import annotations

from urllib.parse import quote

from pyarrow import fs

#: Names of files may have 255 bytes nearly everywhere; what is longer is cut and told apart by a digest.
LONGEST_NAME = 200


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def file_name(key: str | None) -> str:
    """A file name for any key, another for each: percent-encoded; very long keys end in a digest of theirs, null is ``%null``."""
    if key is None:
        return "%null"
    name = quote(key, safe="")
    if len(name) <= LONGEST_NAME:
        return name
    import hashlib

    return f"{name[:LONGEST_NAME - 66]}%-{hashlib.sha256(key.encode()).hexdigest()}"
