"""ZIP archives read by many tasks at once, and archives written by tasks.

Only the directory at the end of an archive is read to list it.  Its members are dealt in parts of ``PART_BYTES``
compressed bytes, so a large archive is spread over tasks, and each task reads the stretches of the file that hold its
members and nothing else.  Neither archives nor lists of members pass through the driver.

What cannot be read is a row with an ``error`` and without content: a file that is no archive, a member that is
encrypted, damaged, over ``MOST_BYTES`` or compressed in a way not known.
"""

from __future__ import annotations

import bz2
import io
import re
import struct
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.sources.files import JUNK

PART_BYTES = 64 << 20
MOST_BYTES = 1 << 30  # of a member's content, which is one cell
ROWS = 4096           # of a list of members that a task holds at once

_LISTED = "path string, member string, place long, part long, at long, packed long, size long, crc long, method int, flags int, error string"


def _on(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path names and the path on it; Spark names local files ``file:/`` with one slash."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":/" in path else f"file://{path}")


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the ZIP files below a folder; their contents are not read, and Spark passes files of no bytes over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[zZ][iI][pP]").load(folder)
    return files.where(~F.col("path").rlike(JUNK)).select("path", "length")


def members(archives: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The members of archives (path) from their directories, in order of their place in the file, with the part that reads each."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, before = [], 0
                try:
                    system, name = _on(path)
                    with system.open_input_file(name) as f, zipfile.ZipFile(_Source(f)) as z:
                        for place, i in enumerate(sorted(z.infolist(), key=lambda i: i.header_offset)):
                            if not i.is_dir() and not re.search(JUNK, i.filename):
                                rows.append((path, i.filename, place, before // part_bytes, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type, i.flag_bits, None))
                                before += i.compress_size
                except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
                    rows = [(path, *[None] * 9, str(e))]
                for a in range(0, len(rows), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a:a + ROWS], strict=True), _types, strict=True)], _names)

    _names = [x.split()[0] for x in _LISTED.split(", ")]
    _types = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in _LISTED.split(", ")]
    return archives.select("path").mapInArrow(run, _LISTED)


def _content(f, at: int, packed: int, size: int, crc: int, method: int, flags: int) -> bytes:
    """A member's bytes; its own header tells where they start."""
    if flags & 1:
        raise ValueError("encrypted")
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes, more than {MOST_BYTES}")
    f.seek(at)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member where the directory names one")
    name, extra = struct.unpack("<HH", head[26:])
    f.seek(at + 30 + name + extra)
    raw = f.read(packed)
    if method == zipfile.ZIP_STORED:
        out = raw
    elif method == zipfile.ZIP_DEFLATED:
        out = zlib.decompressobj(-15).decompress(raw, size + 1)
    elif method == zipfile.ZIP_BZIP2:
        out = bz2.BZ2Decompressor().decompress(raw, size + 1)
    else:
        raise ValueError(f"compression method {method} is not known")
    if len(out) != size or zlib.crc32(out) != crc:
        raise ValueError("damaged")
    return out


def read_members(listed: DataFrame, tasks: int | None = None) -> DataFrame:
    """path (``archive!member``), size, content and error of what :func:`members` lists, read part by part.

    Parts are dealt over ``tasks`` tasks (as many as shuffles have if none is named); a task reads its parts in order of
    the file and holds about ``PART_BYTES`` of content, or one member, at once.
    """
    tasks = tasks or int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        rows, held, opened, f = [], 0, None, None

        def made():
            nonlocal rows, held
            columns = list(zip(*rows, strict=True))
            rows, held = [], 0
            types = (pa.string(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["path", "size", "content", "error"])

        try:
            for b in batches:
                for r in b.to_pylist():
                    content, error = None, r["error"]
                    if error is None:
                        try:
                            if opened != r["path"]:
                                if f is not None:
                                    f.close()
                                opened, f = None, None
                                system, name = _on(r["path"])
                                f, opened = system.open_input_file(name), r["path"]
                            content = _content(f, *(r[c] for c in ("at", "packed", "size", "crc", "method", "flags")))
                        except (ValueError, OSError, EOFError, zlib.error) as e:
                            error = str(e)
                    rows.append((r["path"] if r["member"] is None else f"{r['path']}!{r['member']}", r["size"], content, error))
                    held += len(content or b"")
                    if held >= PART_BYTES or len(rows) >= ROWS:
                        yield made()
            if rows:
                yield made()
        finally:
            if f is not None:
                f.close()

    dealt = listed.repartition(tasks, "path", "part").sortWithinPartitions("path", "at")
    return dealt.mapInArrow(run, "path string, size long, content binary, error string")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Rows (member, content) as ZIP files, one for each partition; returns their path and number of members.

    A file gets its name, that of its partition, once it is whole, so a task that is run again replaces what it had
    written.  A member without content is empty.
    """

    def run(batches):
        partition, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, name = _on(folder)
        n, held = 0, None
        for b in batches:
            if b.num_rows and held is None:
                system.create_dir(name, recursive=True)
                out = system.open_output_stream(f"{name}/.{partition}-{attempt}")
                buffered = io.BufferedWriter(_Sink(out), 1 << 20)
                held = zipfile.ZipFile(buffered, "w")
            for member, content in zip(b.column("member").to_pylist(), b.column("content").to_pylist(), strict=True):
                held.writestr(zipfile.ZipInfo(member), content or b"", zipfile.ZIP_DEFLATED, 1)
                n += 1
        if held is not None:
            held.close()
            buffered.close()
            system.move(f"{name}/.{partition}-{attempt}", f"{name}/part-{partition:06d}.zip")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/part-{partition:06d}.zip"], "members": pa.array([n], pa.int64())})

    return rows.select("member", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, members long")


class _Source:
    """An input file of pyarrow as Python's archive reader expects one: a place before the start is an OSError."""

    def __init__(self, f):
        self.read, self.tell, self.seekable, self.f = f.read, f.tell, f.seekable, f

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.f.seek(offset, whence)
        except ValueError as e:
            raise OSError(str(e)) from e


class _Sink(io.RawIOBase):
    """An output stream of pyarrow as one that Python's archive writer takes: it can only go forward."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.out.close()
        super().close()
