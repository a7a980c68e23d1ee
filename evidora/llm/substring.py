"""Exact substring dedup by merging Burrows-Wheeler transforms.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller doc_id.  Every such string ("window") has a key, the least hash of its
20-byte grams, so equal windows have equal keys; neighbouring windows mostly
share theirs and form one segment.  The steps:

1. Each task sends the keys of its documents, packed, to the bucket of each
   key; a bucket returns a bit map of the keys that came more than once.  The
   map has at most ``MAP_BITS`` bits.  It only spares sending segments that
   cannot match; when it fills up more segments are sent and nothing is lost.
   A bucket also counts each key's segments: the entries sent to it, and what
   a task adds for a key that came more often than it was sent.
2. Segments meet by 40 bits of their key.  Equal ones are collapsed.  Each distinct segment is a
   shard with a transform of its own; all shards of a block are merged by
   refining their interleave: a pass puts the order of all rotations right for
   one more pair of leading bytes, by a stable distribution on the pair of bytes
   that the transform names, and never compares suffixes.  Where a boundary first
   appears gives the common prefix of two neighbours; stretches with 50 bytes or
   more in common are the repeated intervals, and the smallest doc_id of each says
   which windows go.  A key with more rows than a block takes carries its distinct
   segments on to the next block.
3. Keys with more than ``HOT_ROWS`` segments are not judged by one task.  Their equal segments are collapsed on the map
   side; of the distinct ones, windows whose hash comes in several meet by hash and bytes, again on the map side first,
   and what goes joins the segments by a splittable join.
4. The removed spans join the documents.

Cases: a null or empty text has no bytes; texts under 50 bytes lose none; a row
without doc_id keeps all its bytes and counts for no other; rows that repeat a
doc_id are judged each by its own text and never remove each other's bytes;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidora.llm.common import staged

WINDOW = 50
GRAM = 20             # 16 to 32; windows share a key for about WINDOW - GRAM positions
PIECE = 1 << 20       # bytes whose keys are computed at once
BATCH_BYTES = 1 << 22 # bytes of text of a batch that are held as Python objects at once
MAP_BITS = 1 << 28    # of the map that is broadcast, at most (32 MB)
BUCKET_KEYS = 1 << 20
BLOCK_ROWS = 30000    # rows that a task judges at once
HOT_ROWS = 8192       # of one key; above, its rows are spread
MERGE_BYTES = 1 << 17
END = 0xFF            # a byte that UTF-8 never has ends a segment

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A hash of each gram of ``size`` bytes, built by doubling."""
    h, k = (data.astype(np.uint64) + np.uint64(1)) * _M[0], 1
    while k * 2 <= size:
        left, right = h[:-k], h[k:]
        h = left * _M[1] + (right ^ (right >> np.uint64(29))) * _M[2]
        h ^= h >> np.uint64(32)
        k *= 2
    if j := size - k:
        h = h[:-j] * _M[3] + h[j:] * _M[4]
    h ^= h >> np.uint64(31)
    h *= _M[1]
    h ^= h >> np.uint64(29)
    return h


def keyed_segments(texts: list[bytes]):
    """(key, index of the text, first window, number of windows) of each run of windows with one key, piece by piece."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def keys():
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        if len(data) < WINDOW:
            return None
        lengths = np.array([len(x[2]) for x in held])
        m = gram_hashes(data)
        wide, span = WINDOW - GRAM + 1, 1
        while span * 2 <= wide:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if wide > span:
            m = np.minimum(m[:len(m) - (wide - span)], m[wide - span:])
        of = np.repeat(np.arange(len(held), dtype=np.int32), lengths)
        ok = np.flatnonzero(of[:len(m)] == of[WINDOW - 1:WINDOW - 1 + len(m)])
        if not len(ok):
            return None
        m, p = m[ok], of[ok]
        first = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (p[1:] != p[:-1])])
        count = np.diff(np.r_[first, len(m)])
        p = p[first]
        start = ok[first] - (np.cumsum(lengths) - lengths)[p]
        return m[first], np.array([x[0] for x in held])[p], start + np.array([x[1] for x in held])[p], count

    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - WINDOW + 1, 0), PIECE):
            held.append((i, at, text[at:at + PIECE + WINDOW - 1]))
            size += len(held[-1][2])
            if size >= PIECE:
                if (found := keys()) is not None:
                    yield found
                held, size = [], 0
    if held and (found := keys()) is not None:
        yield found


def _parts(b):
    """A batch in parts of about BATCH_BYTES of text, each with its first row and its texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // BATCH_BYTES)) + 1
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
        if z > a:
            yield a, [(t or "").encode() for t in b.column("text").slice(a, z - a).to_pylist()]


def segment_keys(b):
    for a, texts in _parts(b):
        for key, row, _, _ in keyed_segments(texts):
            yield key, row + a


def coded(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key and its low 32 bits."""
    return ((key >> np.uint64(32)) & np.uint64((1 << buckets) - 1)) << np.uint64(32) | key & np.uint64(0xFFFFFFFF)


def marked(bits: np.ndarray, code: np.ndarray, each: int) -> np.ndarray:
    place = ((code >> np.uint64(32)) << np.uint64(each) | (code & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - each)).astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)


def repeated_keys(rows: DataFrame, keys_of, expected: float) -> tuple[np.ndarray, int, int, np.ndarray]:
    """A bit map of keys that may occur in more than one row, the binary logarithms of its buckets and of the bits of each, and hot keys.

    ``keys_of`` gives pairs of arrays, the keys and their rows, of a batch.  Hot keys are coded, in order; there are at most
    1 / HOT_ROWS as many as keys.
    """
    buckets = min(20, max(4, int(np.ceil(np.log2(max(expected / BUCKET_KEYS, 1))))))
    bits = int(np.ceil(np.log2(min(max(expected / 0.7, 1 << 20), MAP_BITS))))
    each = max(bits - buckets, 8)

    def by_bucket(code, values):
        order = np.argsort(code >> np.uint64(32), kind="stable")
        bucket, values = (code[order] >> np.uint64(32)).astype(np.int32), values[order]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        return pa.array(bucket[edges]), pa.array([values[a:b].tobytes() for a, b in zip(edges, np.r_[edges[1:], len(values)], strict=True)], pa.binary())

    def send(batches):
        keys, rows, n = [], [], 0
        for b in batches:
            for key, row in keys_of(b):
                keys.append(key)
                rows.append(row + n)
            n += b.num_rows
        if not keys:
            return
        key, row = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.maximum.reduceat(row, first) != np.minimum.reduceat(row, first)
        times, copies = np.diff(np.r_[first, len(key)]), 1 + many  # twice: it has come in more than one row already
        sent = coded(np.repeat(key[first], copies), buckets)
        bucket, packed = by_bucket(sent, sent.astype(np.uint32))
        yield pa.RecordBatch.from_arrays([bucket, packed, pa.nulls(len(bucket), pa.binary())], ["bucket", "keys", "counts"])
        more = times > copies
        if more.any():
            sent = coded(key[first][more], buckets)
            bucket, packed = by_bucket(sent, np.c_[sent.astype(np.uint32), (times - copies)[more].astype(np.uint32)])
            yield pa.RecordBatch.from_arrays([bucket, pa.nulls(len(bucket), pa.binary()), packed], ["bucket", "keys", "counts"])

    def meet(table):
        low = np.sort(np.frombuffer(b"".join(x for x in table.column("keys").to_pylist() if x), np.uint32))
        again = low[1:][low[1:] == low[:-1]]
        bitmap = np.zeros(1 << each, bool)
        bitmap[again >> np.uint32(32 - each)] = True
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        name, times = low[first], np.diff(np.r_[first, len(low)]).astype(np.int64)
        more = np.frombuffer(b"".join(x for x in table.column("counts").to_pylist() if x), np.uint32).reshape(-1, 2)
        np.add.at(times, np.searchsorted(name, more[:, 0]), more[:, 1])
        hot = name[times > HOT_ROWS]
        return pa.table({"bucket": table.column("bucket")[:1], "bits": pa.array([np.packbits(bitmap).tobytes()], pa.binary()), "hot": pa.array([hot.astype(np.uint32).tobytes()], pa.binary())})

    sent = rows.mapInArrow(send, "bucket int, keys binary, counts binary")
    out, hot = np.zeros((1 << buckets, 1 << each >> 3), np.uint8), [np.zeros(0, np.uint64)]
    for r in sent.groupBy("bucket").applyInArrow(meet, "bucket int, bits binary, hot binary").toLocalIterator():
        out[r.bucket] = np.frombuffer(r.bits, np.uint8)
        hot.append(np.frombuffer(r.hot, np.uint32).astype(np.uint64) | np.uint64(r.bucket) << np.uint64(32))
    return out.reshape(-1), buckets, each, np.sort(np.concatenate(hot))


def distinct_windows(segments: list[bytes]):
    """Piece by piece: the segment, offset and hash of distinct windows of each segment, their bytes joined, and for every window of the piece its segment, offset and the offset of one equal to it.

    Windows that are found equal are equal; a few equal ones may be given twice.
    """
    at = 0
    while at < len(segments):
        to, size = at, 0
        while to < len(segments) and size < PIECE:
            size += len(segments[to])
            to += 1
        part = segments[at:to]
        lengths = np.array([len(s) for s in part])
        data = np.frombuffer(b"".join(part), np.uint8)
        base = np.cumsum(lengths) - lengths
        windows = lengths - WINDOW + 1
        own = np.repeat(np.arange(len(part)), windows)
        offset = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
        h = gram_hashes(data, WINDOW)[base[own] + offset]
        view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
        order = np.lexsort((h, own))
        o, w, x = own[order], h[order], (base[own] + offset)[order]
        same = np.flatnonzero((o[1:] == o[:-1]) & (w[1:] == w[:-1]))
        new = np.ones(len(order), bool)
        for a in range(0, len(same), 1 << 16):
            i = same[a:a + (1 << 16)]
            new[i + 1] = (view[x[i]] != view[x[i + 1]]).any(axis=1)
        lead = np.flatnonzero(new)
        like = np.empty(len(order), np.int64)
        like[order] = np.repeat(offset[order[lead]], np.diff(np.r_[lead, len(order)]))
        first = order[lead]
        yield own[first] + at, offset[first], h[first], (view, base[own[first]] + offset[first]), own + at, offset, like
        at = to


def window_keys(b):
    for own, _, h, _, _, _, _ in distinct_windows(b.column("segment").to_pylist()):
        yield h, own


def hot_spans(segments: DataFrame) -> DataFrame:
    """Spans (doc, tag, span) that go, of the segments of hot keys; no step has all rows of a key in one task.

    Of equal segments all but those of the smallest doc go whole.  That doc loses the windows which distinct segments of a
    smaller doc have too.
    """
    spark = segments.sparkSession
    rows = staged(segments, "hot-segments")
    distinct = staged(rows.groupBy("key", "segment").agg(F.min("doc").alias("least")).withColumn("id", F.monotonically_increasing_id()), "hot-distinct")
    expected = distinct.agg(F.sum(F.octet_length("segment") - (WINDOW - 1)).alias("n")).first().n or 0
    bitmap, buckets, each, _ = repeated_keys(distinct.select("segment"), window_keys, expected)
    shared = spark.sparkContext.broadcast(bitmap)

    def windows(batches):
        bits = shared.value
        for b in batches:
            name, least = (b.column(c).to_numpy() for c in ("id", "least"))
            for own, offset, h, (view, place), _, _, _ in distinct_windows(b.column("segment").to_pylist()):
                seen = np.flatnonzero(marked(bits, coded(h, buckets), each))
                for s in range(0, len(seen), 1 << 16):
                    i = seen[s:s + (1 << 16)]
                    ends = pa.py_buffer(np.arange(0, WINDOW * len(i) + 1, WINDOW, dtype=np.int32))
                    made = pa.Array.from_buffers(pa.binary(), len(i), [None, ends, pa.py_buffer(view[place[i]].tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(name[own[i]]), pa.array(offset[i]), pa.array(least[own[i]]), pa.array(h[i].view(np.int64)), made], ["id", "offset", "least", "hash", "window"])

    def parts(batches):
        for b in batches:
            made: list[list[int]] = [[] for _ in range(b.num_rows)]
            lost = b.column("lost").to_pylist()
            for _, _, _, _, own, offset, like in distinct_windows(b.column("segment").to_pylist()):
                names = np.array([i << 32 | x for i in range(own[0], own[-1] + 1) for x in lost[i]], np.int64)
                goes = np.isin(own << 32 | like, names)
                new = np.r_[True, own[1:] != own[:-1]]
                begins = np.flatnonzero(goes & (new | ~np.r_[False, goes[:-1]]))
                ends = np.flatnonzero(goes & np.r_[new[1:] | ~goes[1:], True])
                for i, a, z in zip(own[begins].tolist(), offset[begins].tolist(), offset[ends].tolist(), strict=True):
                    made[i].append(a << 32 | z + WINDOW)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(made, pa.list_(pa.int64()))], ["id", "parts"])

    each_window = distinct.mapInArrow(windows, "id long, offset long, least long, hash long, window binary")
    several = each_window.groupBy("hash", "window").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last")
    lost = each_window.join(several, ["hash", "window"]).where("first < least").groupBy("id").agg(F.collect_list("offset").alias("lost"))
    partly = distinct.select("id", "segment").join(lost, "id").mapInArrow(parts, "id long, parts array<long>")
    known = distinct.join(partly, "id", "left").select("key", "segment", "least", "parts")
    whole = F.array(F.shiftleft("at", 32) + F.col("at") + F.octet_length("segment"))
    some = F.transform("parts", lambda x: x + F.shiftleft("at", 32) + F.col("at"))
    return rows.join(known, ["key", "segment"]).select("doc", "tag", F.explode(F.when(F.col("doc") > F.col("least"), whole).otherwise(some)).alias("span"))


def merge_transforms(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rotations of all segments in merged order, as places in the joined segments, and the interval of each.

    Rotations in one interval have WINDOW bytes in common.  Starting from the segments one after the other, a pass takes
    the two bytes before each rotation from the transform and distributes stably by them: then the rotations that these
    bytes begin are in order by two bytes more.
    """
    text = np.frombuffer(b"".join(s + bytes([END]) for s in segments), np.uint8)
    lengths = np.array([len(s) + 1 for s in segments])
    n = len(text)
    first = np.cumsum(lengths) - lengths
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[first] = first + lengths - 1
    before2 = before[before]
    pair = text[before2].astype(np.uint16) << 8 | text[before]
    at, interval = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    for _ in range(WINDOW // 2):
        named = pair[at]
        order = np.argsort(named, kind="stable")
        named, interval = named[order], interval[order]
        border = (named[1:] != named[:-1]) | (interval[1:] != interval[:-1])
        interval = np.empty(n, np.int32)
        interval[0] = 0
        np.cumsum(border, out=interval[1:])
        at = before2[at[order]]
    return at, interval


def smallest_holder(segments: list[bytes], doc: np.ndarray) -> np.ndarray:
    """For each window of each segment, all in one array, the smallest ``doc`` of the segments that hold it."""
    windows = np.array([len(s) - WINDOW + 1 for s in segments])
    at, interval = merge_transforms(segments)
    lengths = windows + WINDOW
    of = np.repeat(np.arange(len(segments), dtype=np.int32), lengths)
    offset = np.arange(len(of), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    of, offset = of[at], offset[at]
    window = offset < windows[of]
    of, offset, interval = of[window], offset[window], interval[window]
    start = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
    least = np.repeat(np.minimum.reduceat(doc[of], start), np.diff(np.r_[start, len(of)]))
    out = np.empty(len(of), np.int64)
    out[(np.cumsum(windows) - windows)[of] + offset] = least
    return out


def holders(key: np.ndarray, segments: list[bytes], doc: np.ndarray) -> np.ndarray:
    """As smallest_holder, for segments in order of their key, block by block; a key is never cut.

    The transform of a key's only segment has none to be merged with: its windows are its own.
    """
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[first, len(key)])
    windows = np.fromiter(map(len, segments), np.int64, len(segments)) - WINDOW + 1
    base = np.cumsum(windows) - windows
    out = np.repeat(doc, windows)
    several = np.flatnonzero(count > 1).tolist()
    part: list[int] = []
    size = 0
    for n, i in enumerate(several):
        part.extend(range(first[i], first[i] + count[i]))
        size += int(windows[first[i]:first[i] + count[i]].sum()) + int(count[i]) * WINDOW
        if size >= MERGE_BYTES or n == len(several) - 1:
            at = np.array(part)
            n_windows = windows[at]
            place = np.repeat(base[at] - (np.cumsum(n_windows) - n_windows), n_windows) + np.arange(n_windows.sum())
            out[place] = smallest_holder([segments[j] for j in part], doc[at])
            part, size = [], 0
    return out


def removed_windows(table: pa.Table, carried):
    """Spans (doc, tag, start, stop) that go, of segments in order of key and doc, and the distinct segments of the last key."""
    key, doc, tag, at = (table.column(c).to_numpy() for c in ("key", "doc", "tag", "at"))
    coded = table.column("segment").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    code, segments = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    first = np.flatnonzero(np.r_[True, code[1:] > np.maximum.accumulate(code)[:-1]])  # of each segment, with its smallest doc
    keys, docs = key[first], doc[first]
    ahead = 0
    if carried is not None and carried[0] == key[0]:
        ahead = len(carried[1])
        segments, docs, keys = carried[1] + segments, np.r_[carried[2], docs], np.r_[np.full(ahead, key[0]), keys]
    least = holders(keys, segments, docs)
    windows = np.array([len(s) - WINDOW + 1 for s in segments])
    base = np.cumsum(windows) - windows
    low, high = np.minimum.reduceat(least, base), np.maximum.reduceat(least, base)
    code = code + ahead
    whole, some = high[code] < doc, low[code] < doc
    spans = [(doc[whole], tag[whole], at[whole], at[whole] + windows[code[whole]] + WINDOW - 1)]
    part = np.flatnonzero(some & ~whole)
    if len(part):
        n = windows[code[part]]
        own = np.repeat(np.arange(len(part)), n)
        inside = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        goes = least[base[code[part]][own] + inside] < doc[part][own]
        begins = np.flatnonzero(goes & ~(np.r_[False, goes[:-1]] & np.r_[False, own[1:] == own[:-1]]))
        ends = np.flatnonzero(goes & ~(np.r_[goes[1:], False] & np.r_[own[1:] == own[:-1], False]))
        row = part[own[begins]]
        spans.append((doc[row], tag[row], at[row] + inside[begins], at[row] + inside[ends] + WINDOW))
    last = keys == key[-1]
    kept = (key[-1], [s for s, x in zip(segments, last.tolist(), strict=True) if x], docs[last])
    return [np.concatenate(x) for x in zip(*spans, strict=True)], kept


def survey(docs: DataFrame) -> tuple[int, Column]:
    """Bytes of all texts, and what tells rows apart that share a doc_id: a hash of the text if any do, else nothing."""
    of_doc = docs.groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    seen = of_doc.agg(F.sum("bytes").alias("bytes"), F.max("rows").alias("rows")).first()
    return seen.bytes or 0, F.hash("text") if (seen.rows or 0) > 1 else F.lit(0)


def removed_spans(docs: DataFrame, total: int, tag: Column) -> DataFrame:
    """doc, tag and ``spans`` of every row that loses bytes; a span is start * 2^32 + stop."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), tag.alias("tag"), "text")
    bitmap, buckets, each, hot = repeated_keys(docs, segment_keys, total * 0.07)
    shared = spark.sparkContext.broadcast((bitmap, hot))

    def send(of_hot_keys):
        def run(batches):
            bits, hot = shared.value
            for first, texts, b in ((*part, b) for b in batches for part in _parts(b)):
                doc, tag = (b.column(c).slice(first, len(texts)).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
                for key, row, at, count in keyed_segments(texts):
                    code = coded(key, buckets)
                    seen = marked(bits, code, each)
                    if len(hot):
                        seen &= (hot[np.minimum(np.searchsorted(hot, code), len(hot) - 1)] == code) == of_hot_keys
                    seen = np.flatnonzero(seen)
                    if not len(seen):
                        continue
                    row, at, count = row[seen], at[seen], count[seen]
                    segments = [texts[i][a:z] for i, a, z in zip(row.tolist(), at.tolist(), (at + count + WINDOW - 1).tolist(), strict=True)]
                    key = key[seen].view(np.int64) if of_hot_keys else (key[seen] >> np.uint64(24)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc[row]), pa.array(tag[row]), pa.array(at), pa.array(segments, pa.binary())],
                                                     ["key", "doc", "tag", "at", "segment"])
        return run

    def judge(batches):
        held, rows, carried = [], 0, None

        def spans():
            nonlocal held, rows, carried
            (doc, tag, start, stop), carried = removed_windows(pa.Table.from_batches(held), carried)
            held, rows = [], 0
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(start << 32 | stop)], ["doc", "tag", "span"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= BLOCK_ROWS:
                yield spans()
        if held:
            yield spans()

    sent = docs.mapInArrow(send(False), "key long, doc long, tag int, at long, segment binary")
    found = sent.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(judge, "doc long, tag int, span long")
    if len(hot):
        found = found.unionByName(hot_spans(docs.mapInArrow(send(True), "key long, doc long, tag int, at long, segment binary")))
    return found.groupBy("doc", "tag").agg(F.collect_list("span").alias("spans"))


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted((s >> 32, s & 0xFFFFFFFF) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _with_spans(docs: DataFrame) -> DataFrame:
    """The rows with their spans as ``__spans``; texts are compressed for the way, to bytes."""
    known = docs.where("doc_id is not null")
    total, tag = survey(known)
    spans = removed_spans(docs, total, tag).select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans"))

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.set_column(at, "text", pa.array([None if t is None else press.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary()))

    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in docs.schema]).add("__own", "integer")
    packed = docs.withColumn("__own", tag).mapInArrow(pack, schema)
    return packed.join(spans, (F.col("doc_id") == F.col("__doc")) & (F.col("__own") == F.col("__tag")), "left").drop("__doc", "__tag", "__own")


def _unpacked(b) -> list[bytes | None]:
    press = zstandard.ZstdDecompressor()
    return [None if t is None else press.decompress(t) for t in b.column("text").to_pylist()]


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    docs = docs.select("doc_id", "text")

    def run(batches):
        for b in batches:
            rows = []
            for text, spans in zip(_unpacked(b), b.column("__spans").to_pylist(), strict=True):
                text = text or b""
                gone = merge_spans(spans)
                rows.append((len(text), sum(z - a for a, z in gone), len(gone), hashlib.sha256(kept_bytes(text, gone)).hexdigest()))
            made = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in made[:3]), pa.array(made[3], pa.string())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    return _with_spans(docs).select("doc_id", "text", "__spans").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows without their removed spans: ``text``, and ``n_chars`` where it is a column, are those of what is left.

    A character that a span cuts goes whole.
    """

    def run(batches):
        for b in batches:
            texts = [None if t is None else kept_bytes(t, merge_spans(spans)).decode(errors="ignore") for t, spans in zip(_unpacked(b), b.column("__spans").to_pylist(), strict=True)]
            at = b.schema.get_field_index("text")
            yield b.drop_columns(["__spans"]).set_column(at, "text", pa.array(texts, pa.string()))

    out = _with_spans(docs).select(*docs.columns, "__spans").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
