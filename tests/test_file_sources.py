"""Archives in stretches, as batch and as stream, and one file for each key."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from supplylens.plans import QUERIES
from supplylens.sources import archives, documents, readers
from supplylens.sources.documents import read_documents, write_documents
from supplylens.sources.files import file_name


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members:
            z.writestr(name, content)


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


@pytest.mark.parametrize("stretch_bytes", [1, 300, 1 << 30])
def test_stretches_hold_each_member_once(tmp_path, stretch_bytes):
    members = [(f"{i}.json", os.urandom(i * 7 % 200).hex()) for i in range(60)] + [("note.txt", "x")]
    archive(tmp_path / "a.zip", members)
    parts = archives.stretches(str(tmp_path / "a.zip"), ".json", stretch_bytes)
    got = [row for p in parts for b in archives.read_stretch(p, ".json") for row in zip(*[c.to_pylist() for c in b.columns[1:]])]
    assert sorted(got) == sorted(members[:-1])
    assert len(parts) == (60 if stretch_bytes == 1 else 1 if stretch_bytes > 10**6 else len(parts)) and len(parts) >= 1


def test_archives_of_a_folder_and_by_name(spark, tmp_path):
    archive(tmp_path / "x.zip", [("A.json", "{}"), ("sub/B.json", '{"é":1}')])
    archive(tmp_path / "empty.zip", [])
    archive(tmp_path / "y.zip", [("C.json", b"\xff{}")])
    keys = lambda p: sorted((r["key"], r["content"]) for r in readers.read_osv_zip(spark, p, stretch_bytes=1).collect())
    both = [("osv/x/A.json", "{}"), ("osv/x/sub/B.json", '{"é":1}'), ("osv/y/C.json", "�{}")]
    assert keys(str(tmp_path)) == both and keys([f"file:{tmp_path}/x.zip", str(tmp_path / "y.zip")]) == both
    assert keys(str(tmp_path / "empty.zip")) == []
    assert readers.read_osv_zip(spark, str(tmp_path), stretch_bytes=1).rdd.getNumPartitions() == 3


def test_members_too_large_come_without_content(spark, tmp_path, monkeypatch):
    archive(tmp_path / "z.zip", [("big.json", "1" * (archives.LARGEST_MEMBER + 1)), ("fits.json", "2" * archives.LARGEST_MEMBER)])
    rows = {r["key"]: r["n"] for r in readers.read_osv_zip(spark, str(tmp_path)).select("key", F.length("content").alias("n")).collect()}
    assert rows == {"osv/z/big.json": None, "osv/z/fits.json": archives.LARGEST_MEMBER}


def test_a_damaged_archive_stops_the_read(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="zip"):
        readers.read_osv_zip(spark, str(tmp_path)).collect()


def test_a_stream_reads_new_and_changed_archives_only(spark, tmp_path):
    def run():
        out = readers.read_osv_zip(spark, str(tmp_path / "in"), streaming=True).select("key", "content")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r["key"], r["content"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (tmp_path / "in").mkdir()
    archive(tmp_path / "in/a.zip", [("1.json", "{}")])
    archive(tmp_path / "in/b.zip", [("2.json", "{}")])
    first = [("osv/a/1.json", "{}"), ("osv/b/2.json", "{}")]
    assert run() == first
    assert run() == first
    archive(tmp_path / "in/b.zip", [("2.json", '{"new":1}')])
    archive(tmp_path / "in/c.zip", [("3.json", "{}")])
    assert run() == sorted(first + [("osv/b/2.json", '{"new":1}'), ("osv/c/3.json", "{}")])


def test_a_file_for_each_key(spark, tmp_path):
    long = "k" * 400
    odd = ["plain", "a/b c", "..", ".", "%null", "é", "", long, long + "x", None]
    df = spark.createDataFrame([(k, f"doc of {k}") for k in odd], "key string, doc string")
    write_documents(df.repartition(3), f"{tmp_path}/d", "key", "doc")
    assert files(f"{tmp_path}/d") == sorted(file_name(k) + ".json" for k in odd) and len({file_name(k) for k in odd}) == len(odd)
    assert (tmp_path / "d" / (file_name("a/b c") + ".json")).read_text() == "doc of a/b c"
    more = spark.createDataFrame([("plain", "later"), ("more", None)], "key string, doc string")
    write_documents(more, f"{tmp_path}/d", "key", "doc", mode="append")
    assert len(files(f"{tmp_path}/d")) == len(odd) + 1 and (tmp_path / "d/plain.json").read_text() == "later" and (tmp_path / "d/more.json").read_text() == ""
    write_documents(more.limit(1), f"{tmp_path}/d", "key", "doc")
    assert files(f"{tmp_path}/d") == ["plain.json"]
    write_documents(more.limit(0), f"{tmp_path}/d", "key", "doc")
    assert files(f"{tmp_path}/d") == []


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    old = spark.createDataFrame([("old", "1")], "key string, doc string")
    write_documents(old, f"{tmp_path}/d", "key", "doc")
    fails = spark.range(40).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") == 33, F.raise_error(F.lit("stop"))).otherwise("x").alias("doc"))
    with pytest.raises(Exception, match="stop"):
        write_documents(fails.repartition(4), f"{tmp_path}/d", "key", "doc")
    assert files(f"{tmp_path}/d") == ["old.json"]
    with pytest.raises(Exception, match="unique"):
        write_documents(old.union(old), f"{tmp_path}/d", "key", "doc")
    assert files(f"{tmp_path}/d") == ["old.json"]


def test_many_files_are_read_by_a_bounded_number_of_tasks(spark, sf_dir, tmp_path):
    """The number of tasks, and so what the driver holds, doesn't follow the number of files."""
    rows = [(f"k{i}", f"{{}} é {i}") for i in range(300)]
    write_documents(spark.createDataFrame(rows, "key string, doc string").repartition(5), f"{tmp_path}/d", "key", "doc")
    (tmp_path / "d/other.md").write_text("x")
    (tmp_path / "d/sub.json").mkdir()
    (tmp_path / "d/odd.json").write_bytes(b"\xff")
    got = read_documents(spark, f"{tmp_path}/d")
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, got.collect())) == sorted([(k + ".json", d) for k, d in rows] + [("odd.json", "\ufffd")])
    packages = QUERIES["write_package_advisories"](spark, sf_dir)
    assert packages.count() > 150 and packages.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_names_stay_with_the_tasks(spark, tmp_path, monkeypatch):
    """Of a write the driver collects a row for each task; overwriting leaves files of other kinds and folders."""
    collected, plain = [], type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: collected.append(plain(self)) or collected[-1])
    (tmp_path / "d/sub").mkdir(parents=True)
    (tmp_path / "d/note.md").write_text("x")
    (tmp_path / "d/sub/s.json").write_text("x")
    for n in (200, 120):
        df = spark.range(n).select(F.col("id").cast("string").alias("key"), F.lit("x").alias("doc")).repartition(3)
        write_documents(df, f"{tmp_path}/d", "key", "doc")
        assert files(f"{tmp_path}/d") == sorted([f"{i}.json" for i in range(n)] + ["note.md", "sub/s.json"])
    assert sum(map(len, collected)) <= 12


def test_a_move_that_is_tried_again_finds_its_file_in_place(tmp_path):
    (tmp_path / documents.STAGING / "j/a").mkdir(parents=True)
    (tmp_path / documents.STAGING / "j/a/2.json").write_text("two")
    (tmp_path / "1.json").write_text("one")
    batch = lambda *names: iter(documents._batches([("a", n) for n in names], documents._texts("attempt", "name")))
    assert [b.to_pydict() for b in documents._mover(str(tmp_path), "j")(batch("1.json", "2.json"))] == [{"n": [2]}]
    assert (tmp_path / "1.json").read_text() == "one" and (tmp_path / "2.json").read_text() == "two"
    with pytest.raises(OSError):
        list(documents._mover(str(tmp_path), "j")(batch("3.json")))
