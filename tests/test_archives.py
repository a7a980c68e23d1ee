"""Archives read by parts: against Python's own reader, over several tasks, with everything that can be wrong in one."""

from __future__ import annotations

import random
import zipfile

from pyspark.sql import functions as F

from evidora.sources import archives


def large(path, rng, n=300):
    """An archive with members of all methods, folders, litter, empty and large members."""
    want = {}
    with zipfile.ZipFile(path, "w") as z:
        for i in range(n):
            content = rng.randbytes(rng.choice((0, 1, 700, 40_000))) + b"word " * rng.choice((0, 3, 9000))
            name = f"folder {i % 7}/m\u00e9mber {i}.txt"
            z.writestr(name, content, compress_type=(zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2)[i % 3])
            want[name] = content
        z.mkdir("empty folder")
        z.writestr("__MACOSX/._x", b"litter")
    return want


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    want = large(tmp_path / "Large.ZIP", random.Random(1))
    listed = archives.members(archives.archives_in(spark, str(tmp_path)), part_bytes=100_000)
    assert listed.select("part").distinct().count() > 8
    found = archives.read_members(listed, tasks=6).withColumn("task", F.spark_partition_id()).collect()
    assert {r.path.split("!", 1)[1]: bytes(r.content) for r in found} == want and all(r.error is None and r.size == len(r.content) for r in found)
    assert len(found) == len(want) and len({r.task for r in found}) > 3


def test_what_cannot_be_read_is_a_row_with_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "none.zip").write_bytes(b"no archive")
    (tmp_path / "short.zip").write_bytes(b"PK")
    with zipfile.ZipFile(tmp_path / "no_members.zip", "w"):
        pass
    with zipfile.ZipFile(tmp_path / "mixed.zip", "w") as z:
        z.writestr("good", b"good bytes")
        z.writestr("hurt", b"bytes that change", compress_type=zipfile.ZIP_STORED)
        z.writestr("torn", b"packed " * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("lzma", b"other method", compress_type=zipfile.ZIP_LZMA)
        torn = z.getinfo("torn").header_offset + 34
    raw = (tmp_path / "mixed.zip").read_bytes()
    raw = raw.replace(b"bytes that change", b"bytes that chance", 1)
    (tmp_path / "mixed.zip").write_bytes(raw[:torn] + b"\xff\xff\xff" + raw[torn + 3:])
    found = archives.read_members(archives.members(archives.archives_in(spark, str(tmp_path)))).collect()
    got = {r.path.rsplit("/", 1)[-1]: (r.content and bytes(r.content), r.error is not None) for r in found}
    assert got == {"none.zip": (None, True), "short.zip": (None, True), "mixed.zip!good": (b"good bytes", False), "mixed.zip!hurt": (None, True), "mixed.zip!torn": (None, True), "mixed.zip!lzma": (None, True)}


def test_written_archives_are_read_back(spark, tmp_path):
    rows = [(f"d/{i}", None if i == 3 else "" if i == 4 else f"text {i} \u00e9") for i in range(40)]
    made = archives.write_archives(spark.createDataFrame(rows, "member string, content string").repartition(3), f"file://{tmp_path}/out").collect()
    assert sum(r.members for r in made) == 40
    for r in made:
        assert zipfile.ZipFile(r.path.removeprefix("file://")).testzip() is None
    found = archives.read_members(archives.members(spark.createDataFrame(made))).collect()
    assert {r.path.split("!")[1]: bytes(r.content).decode() for r in found} == {m: c or "" for m, c in rows}
    empty = spark.createDataFrame([], "member string, content string")
    assert archives.write_archives(empty, f"{tmp_path}/none").count() == 0
