"""One file for each key, written in two phases, and the files of such a folder read by as many tasks as are wanted.

Tasks write below ``_staging/<job>/<attempt>`` and beside it a list of the names; only an attempt's id comes back to the driver, from the attempts whose
results Spark took. When all tasks are done, a second job moves these attempts' files into the folder, so readers never see a failed or a second attempt's
files. A job that fails removes its staging folder, and the next job to the same folder what a lost driver has left there.

The driver holds a row for each task and never a name: names are compared, moved, listed and read by tasks. Every key costs a file of its own, at least a
block of disk, so this is for tables of packages, not of findings.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.sources.files import file_name, open_fs

STAGING = "_staging"
#: Rows that a task hands over at once, and bytes of documents.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of texts as Arrow batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row))
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*held)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*held)], schema=schema)


def _texts(*names: str) -> pa.Schema:
    return pa.schema([(n, pa.string()) for n in names])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _writer(path: str, suffix: str, job: str) -> Callable:
    def write(batches):
        system, root = open_fs(path)
        attempt = uuid.uuid4().hex
        at = f"{root}/{STAGING}/{job}/{attempt}"
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}.names") as names:
            for key, document in _rows(batches):
                data = document if isinstance(document, (bytes, bytearray)) else (document or "").encode()
                name = file_name(key) + suffix
                with system.open_output_stream(f"{at}/{name}") as f:
                    f.write(bytes(data))
                names.write(f"{name}\n".encode())
        yield pa.record_batch([pa.array([attempt])], schema=_texts("attempt"))

    return write


def _written(path: str, job: str, attempts: list[str]) -> Callable:
    """(attempt, name) of what the attempts with the given numbers have written."""

    def names(batches):
        system, root = open_fs(path)

        def each():
            for (i,) in _rows(batches):
                with system.open_input_stream(f"{root}/{STAGING}/{job}/{attempts[i]}.names") as f:
                    for line in io.TextIOWrapper(f, "ascii"):
                        yield attempts[i], line.rstrip("\n")

        yield from _batches(each(), _texts("attempt", "name"))

    return names


def _mover(path: str, job: str) -> Callable:
    """Moves files into the folder. One that an earlier try of the task has moved is there already."""

    def move(batches):
        system, root = open_fs(path)
        n = 0
        for attempt, name in _rows(batches):
            staged, target = f"{root}/{STAGING}/{job}/{attempt}/{name}", f"{root}/{name}"
            try:
                system.move(staged, target)
            except OSError:
                if system.get_file_info(staged).type != fs.FileType.NotFound or system.get_file_info(target).type != fs.FileType.File:
                    raise
            n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return move


def _remover(path: str) -> Callable:
    def remove(batches):
        system, root = open_fs(path)
        n = 0
        for (name,) in _rows(batches):
            if system.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                system.delete_file(f"{root}/{name}")
            n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return remove


def _lister(path: str, suffix: str) -> Callable:
    """Names of the files right below the folder that end in ``suffix``: local ones one after the other, others as ``pyarrow.fs`` gives them."""

    def names(batches):
        system, root = open_fs(path)
        for b in batches:
            if b.num_rows and isinstance(system, fs.LocalFileSystem):
                with os.scandir(root) as entries:
                    yield from _batches(((e.name,) for e in entries if e.name.endswith(suffix) and e.is_file()), _texts("name"))
            elif b.num_rows:
                yield from _batches(((i.base_name,) for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(suffix) and i.type == fs.FileType.File), _texts("name"))

    return names


def _reader(path: str) -> Callable:
    def read(batches):
        system, root = open_fs(path)

        def each():
            for (name,) in _rows(batches):
                with system.open_input_stream(f"{root}/{name}") as f:
                    yield name, f.read().decode("utf-8", "replace")

        yield from _batches(each(), _texts("name", "document"))

    return read


def _names(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """A folder is listed by one task, as it can't be divided; names leave it in batches."""
    return spark.range(0, 1, 1, 1).mapInArrow(_lister(path, suffix), "name string")


def _drop(system: fs.FileSystem, folder: str) -> None:
    if system.get_file_info(folder).type == fs.FileType.Directory:
        system.delete_dir(folder)


def write_documents(df: DataFrame, path: str, key: str, document: str, suffix: str = ".json", mode: str = "overwrite") -> None:
    """A file ``path/<key><suffix>`` for each row. Keys must be unique, or nothing is written.

    Names are percent-encoded keys. Overwriting removes the files of keys that are gone; appending replaces those of the same key and leaves the others. A null
    document is an empty file, a null key the file ``%null``; an empty table overwrites with nothing.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, not {mode}")
    spark, path, job = df.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    system, root = open_fs(path)
    replaces = mode == "overwrite" and system.get_file_info(root).type == fs.FileType.Directory
    try:
        rows = df.select(df[key].cast("string").alias("key"), df[document].alias("document"))
        attempts = [r["attempt"] for r in rows.mapInArrow(_writer(path, suffix, job), "attempt string").collect()]
        names = spark.range(0, len(attempts), 1, max(1, len(attempts))).mapInArrow(_written(path, job, attempts), "attempt string, name string")
        if not names.groupBy("name").count().filter("count > 1").isEmpty():
            raise ValueError("keys must be unique")
        system.create_dir(root, recursive=True)
        names.mapInArrow(_mover(path, job), "n long").agg(F.sum("n")).collect()
        if replaces:
            both = _names(spark, path, suffix).select("name", F.lit(False).alias("new")).unionByName(names.select("name", F.lit(True).alias("new")))
            gone = both.groupBy("name").agg(F.max("new").alias("new")).filter("not new").select("name")
            gone.mapInArrow(_remover(path), "n long").agg(F.sum("n")).collect()
    except BaseException:
        _drop(system, f"{root}/{STAGING}/{job}")
        raise
    _drop(system, f"{root}/{STAGING}")


def read_documents(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(name, document) of each file right below ``path`` whose name ends in ``suffix``, as text.

    Spark's readers list a folder on the driver and count each small file as some megabytes, so that a few files make a task; here names are dealt over as many
    tasks as a shuffle has partitions, whatever their number.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _names(spark, path, suffix).repartition(tasks, "name").mapInArrow(_reader(path), "name string, document string")
