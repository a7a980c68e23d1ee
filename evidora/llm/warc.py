"""Legacy web archives (ARC versions 1 and 2) to WARC, and WARC files written and read by Spark.

An ARC file opens with a ``filedesc`` record whose first line names the version
and whose second names the columns of every later header line; the last column
is the declared length of the bytes that follow.  :func:`parse_arc` reads by
those declarations.  Each record becomes a WARC response, or a revisit of the
record that holds the same payload, with synthesised identifier, date and
digests.  A WARC record ends with two line breaks, so Spark's text writer with
that separator writes valid archives straight to the shared folder, compressed
with gzip; the reader goes by each record's Content-Length.

Cases: null html is an empty payload; a null URL is written as ``-`` and white
space or control characters in a URL are percent-encoded; payloads under 100
bytes are never revisits; rows that repeat a page_id and payload are alike, so
those with the smallest page_id are all responses; a null page_id is kept and
revisits only what a row with an id holds; a payload of any length is one record;
extra columns are ignored, whatever their names; an empty table gives archives
without records and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import shared_dir, staged

REVISIT_BYTES = 100
RECORDS_PER_FILE = 2000
FILE_BYTES = 1 << 29                # of a file's records before compression
SIZE_CLASSES = (1 << 18, 1 << 24)   # pages up to each size share files; larger ones have a file each
HOT_COPIES = 4096                   # copies of a payload above which it may be joined by broadcast
ARCHIVE_DATE = "20240101000000"
# Fixed values of the ARC formats: columns of a header line, by version.
ARC_COLUMNS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BREAK = "\r\n"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string"


def write_arc(records: list[tuple[str | None, bytes]], version: int, date: str = ARCHIVE_DATE) -> bytes:
    """An ARC file of (url, content) records."""
    columns = ARC_COLUMNS[version]
    about = f"{version} 0 evidora\n{' '.join(columns)}\n\n".encode()
    out = [_arc_line(columns, "filedesc://pages.arc", "text/plain", date, len(about)), about, b"\n"]
    for url, content in records:
        safe = re.sub(r"[\x00-\x20\x7f\x85\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "-") or "-"
        out += [_arc_line(columns, safe, "text/html", date, len(content)), content, b"\n"]
    return b"".join(out)


def _arc_line(columns, url, kind, date, length) -> bytes:
    known = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": "200", "Archive-length": str(length)}
    return (" ".join(known.get(c, "-") for c in columns) + "\n").encode()


def parse_arc(data: bytes):
    """(header, content) of each record of an ARC file; columns and version are read from its first record."""
    columns, at = ARC_COLUMNS[1], 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        line = data[at:end].decode("utf-8", "replace")
        if not line.strip():
            at = end + 1
            continue
        fields = line.split(" ")
        try:
            length = int(fields[-1])
        except ValueError:
            raise ValueError(f"an ARC header line declares no length: {line[:80]}") from None
        content = data[end + 1:end + 1 + length]
        if length < 0 or len(content) < length:
            raise ValueError(f"an ARC record is shorter than its declared {length} bytes")
        at = end + 1 + length
        if fields[0].startswith("filedesc:"):
            about = content.decode("utf-8", "replace").split("\n")
            version = int(about[0].split(" ")[0])
            columns = tuple(about[1].split(" ")) if len(about) > 1 and about[1].startswith("URL ") else ARC_COLUMNS[version]
            continue
        if len(fields) != len(columns):
            raise ValueError(f"an ARC header line has {len(fields)} fields for {len(columns)} columns")
        yield dict(zip(columns, fields, strict=True)), content


def warc_record(header: dict, content: bytes, page_id: int | None, leader: int | None) -> str:
    """The WARC record, without its final line breaks, of an ARC record; ``leader`` is the page that already holds the payload."""
    head, _, payload = content.partition(b"\r\n\r\n")
    digest = hashlib.sha256(payload).hexdigest()
    d = header["Archive-date"]
    fields = [("WARC-Type", "response" if leader is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, digest)),
              ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"), ("WARC-Target-URI", header["URL"]),
              ("WARC-IP-Address", header["IP-address"]), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", str(len(payload)))]
    if page_id is not None:
        fields.append(("Page-Id", str(page_id)))
    if leader is None:
        block = head + b"\r\n\r\n" + payload
    else:
        block = head + b"\r\n\r\n"
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(leader, digest)), ("Refers-To-Page-Id", str(leader))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return BREAK.join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields), "", block.decode()])


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id} {digest}'.encode()).hexdigest()[:32], version=5)}>"


def parse_warc(stream):
    """(fields, block) of each record of a WARC file, read one after the other by declared lengths."""
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("a WARC record does not begin where the last one ends")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError("a WARC record's header has no end")
            key, _, value = line.decode("utf-8").removesuffix("\r\n").partition(": ")
            fields[key] = value
        length = int(fields["Content-Length"])
        block = stream.read(length)
        if len(block) < length or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is not as long as it declares")
        yield fields, block


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the pages as WARC files; equal payloads are stored once and revisited.

    Pages of one class of size share files, so that no file holds more than about FILE_BYTES before compression, or one
    record.  Payloads that very many pages share find their leader by broadcast, so that they do not meet in one task.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    of_digest = staged(rows.groupBy("digest").agg(F.min("page_id").alias("leader"), F.count("*").alias("copies"), F.max("size").alias("size")), "digests")
    seen = of_digest.agg(F.sum("copies").alias("n"), F.max("size").alias("largest")).first()
    leaders = of_digest.where((F.col("copies") > 1) & (F.col("size") >= REVISIT_BYTES)).select("digest", "leader", "copies")
    hot = leaders.where(F.col("copies") > max(HOT_COPIES, (seen.n or 0) // 1000)).select("digest", "leader")  # fewer than a thousand
    if hot.isEmpty():
        joined = rows.join(leaders.select("digest", "leader"), "digest", "left")
    else:
        rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(leaders.select("digest", "leader"), "digest", "left")
        joined = rows.join(F.broadcast(hot), "digest").unionByName(rest)
    marked = joined.select("page_id", "url", "html", F.when(~F.col("leader").eqNullSafe(F.col("page_id")), F.col("leader")).alias("leader"), "size")

    def convert(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "leader")]
            made: list[str | None] = [None] * b.num_rows
            for version in ARC_COLUMNS:  # a legacy file of each version
                chosen = range(version - 1, b.num_rows, 2)
                data = write_arc([(cols[1][i], HTTP_HEAD + cols[2][i].encode()) for i in chosen], version)
                for i, (header, content) in zip(chosen, parse_arc(data), strict=True):
                    made[i] = warc_record(header, content, cols[0][i], cols[3][i])
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])

    least = -1
    for most in (*SIZE_CLASSES, None):
        part = marked.where(F.col("size") > least) if most is None else marked.where((F.col("size") > least) & (F.col("size") <= most))
        if least < (seen.largest or 0):
            records = 1 if most is None else max(1, FILE_BYTES // most)
            (part.drop("size").mapInArrow(convert, "value string").write.mode("append").option("lineSep", BREAK * 2).option("compression", "gzip")
             .option("maxRecordsPerFile", min(records, RECORDS_PER_FILE)).text(path))
        least = most if most is not None else least


def read_archives(spark, path: str) -> DataFrame:
    """A row for each record of the WARC files in a folder; digests and lengths of responses are taken from their bytes."""

    def parse(batches):
        for b in batches:
            for i in range(b.num_rows):
                out: list[list] = [[] for _ in range(7)]
                for fields, block in parse_warc(gzip.GzipFile(fileobj=io.BytesIO(b.column("content")[i].as_py()))):
                    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != n:
                            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its digest says")
                    page, refers = fields.get("Page-Id"), fields.get("Refers-To-Page-Id")
                    for c, v in zip(out, (page and int(page), n, digest, fields["WARC-Type"], refers and int(refers), fields["WARC-Target-URI"], fields["WARC-Date"]), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)],
                                                 ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "warc_date"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RESULT)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder, and what reading these archives back says of each."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
