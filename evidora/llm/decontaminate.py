"""Benchmark decontamination: q-gram counts in diagonal bands, then banded alignment.

Texts are compared in lower case with white space runs as one space.  A region
of a document leaks an item of m characters if their edit distance is at most
``e``, a tenth of m.  By the q-gram lemma such a region keeps at least
``m - q + 1 - q * e`` of the item's q-grams, on diagonals (place in the document
less place in the item) at most e apart.  Shared q-grams are counted in bands of
2(e + 1) diagonals, each overlapping the next by half, so that one band holds
them all; bands that reach the bound are verified by an alignment that is free
at both ends of the region and confined to the band's diagonals.

The items are indexed in blocks of about ``INDEX_CHARS`` characters.  One block is
broadcast at a time and released before the next, and every further block is
another pass over the documents.

Cases: a null or empty document leaks nothing; a text of any length is searched
whole; of an item's regions that need equally many edits the first to end counts; items that are null or empty
are not searched; items under ``Q`` characters, which have no q-gram, are found where they stand
as they are, with no letter or digit on either side, by one automaton over all of them; for short
items e is lowered to where the bound is one q-gram or more; items and rows that
repeat each give their rows; null ids are carried along; extra columns are
ignored; without documents or items the result is empty.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidora.llm.common import staged

Q = 8
EDITS_PER_CHAR = 0.1
INDEX_CHARS = 1 << 22
CHUNK_CHARS = 1 << 20
CHUNK_TEXTS = 1 << 16
PREFILTER_BITS = 22
PAIRS = 1 << 22       # pairs of a document's and an item's place that are counted at once
GAP = "￿"         # stands between texts; it is a noncharacter

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def normalise(text: str | None) -> str:
    return " ".join((text or "").replace(GAP, " ").lower().split())


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of each run of eight characters, by doubling."""
    h, k = (codes.astype(np.uint64) + np.uint64(1)) * _M[0], 1
    while k < Q:
        h = h[:-k] * _M[1] + (h[k:] ^ (h[k:] >> np.uint64(29))) * _M[2]
        k *= 2
    h ^= h >> np.uint64(32)
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Index:
    """Places of the q-grams of some items."""

    def __init__(self, items: list[tuple]):
        self.short = self._automaton([(i, t) for i, t in items if len(t) < Q])
        items = [(i, t) for i, t in items if len(t) >= Q]
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.m = np.array([len(t) for t in self.texts])
        self.e = np.minimum(np.floor(self.m * EDITS_PER_CHAR).astype(int), (self.m - Q) // Q)
        self.least = self.m - Q + 1 - Q * self.e
        hashes = [gram_hashes(_codes(t)) for t in self.texts] or [np.zeros(0, np.uint64)]
        gram = np.concatenate(hashes)
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(gram, kind="stable")
        gram, self.item, self.place = gram[order], item[order], place[order]
        self.first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
        self.count = np.diff(np.r_[self.first, len(gram)])
        self.gram = gram[self.first]
        self.some = np.zeros(1 << PREFILTER_BITS, bool)
        self.some[self.gram >> np.uint64(64 - PREFILTER_BITS)] = True

    def bands(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, first diagonal) of bands with enough shared q-grams."""
        lengths = np.array([len(t) + 1 for t in texts])
        codes = _codes(GAP.join(texts))
        if len(codes) < Q or not len(self.gram):
            return []
        start = np.cumsum(lengths) - lengths
        h = gram_hashes(codes)
        hit = np.flatnonzero(self.some[h >> np.uint64(64 - PREFILTER_BITS)])
        gram = np.minimum(np.searchsorted(self.gram, h[hit]), len(self.gram) - 1)
        right = self.gram[gram] == h[hit]
        hit, gram = hit[right], gram[right]
        n = self.count[gram]
        # The last place of a key holds bands; a long text's own length bounds them, hence the mixed radix.
        radix = int(CHUNK_CHARS + lengths.max() + 2)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # A gram that many items share has many places for each hit, so pairs of hit and place are made and counted part by part.
        for part in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
            m = n[part]
            at = np.repeat(self.first[gram[part]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            of = np.repeat(hit[part], m)
            text, item = np.searchsorted(start, of, side="right") - 1, self.item[at]
            band = (of - start[text] - self.place[at]) // (self.e[item] + 1) + CHUNK_CHARS
            key = (text * len(self.m) + item) * radix + band
            key, count = np.unique(np.r_[key, key - 1], return_counts=True)
            keys, back = np.unique(np.r_[keys, key], return_inverse=True)
            counts = np.bincount(back, np.r_[counts, count], len(keys)).astype(np.int64)
        item = keys // radix % len(self.m)
        enough = counts >= self.least[item]
        key, item = keys[enough], item[enough]
        return list(zip((key // radix // len(self.m)).tolist(), item.tolist(), ((key % radix - CHUNK_CHARS) * (self.e[item] + 1)).tolist(), strict=True))

    @staticmethod
    def _automaton(items: list[tuple]):
        """All items without a q-gram, each text with the ids that have it."""
        if not items:
            return None
        a = ahocorasick.Automaton()
        for i, t in items:
            a.add_word(t, (len(t), [*(a.get(t)[1] if t in a else []), i]))
        a.make_automaton()
        return a

    def found(self, texts: list[str]) -> list[tuple]:
        """(text, id, edits, stop) of all items that leak, those without a q-gram as they stand."""
        out = [(t, self.ids[i], e, s) for t, i, e, s in self.leaks(texts)]
        for n, text in enumerate(texts) if self.short else ():
            first: dict[str, tuple] = {}
            for end, (length, ids) in self.short.iter(text):
                start = end - length + 1
                if not text[max(start - 1, 0):start].isalnum() and not text[end + 1:end + 2].isalnum():
                    first.setdefault(text[start:end + 1], (ids, end + 1))
            out += [(n, i, 0, stop) for ids, stop in first.values() for i in ids]
        return out

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, stop) of the best region of each item in each text that leaks it."""
        best: dict = {}
        for text, item, diagonal in self.bands(texts):
            if best.get((text, item), (1,))[0] == 0:
                continue
            edits, stop = align(self.texts[item], texts[text], diagonal, int(self.e[item]))
            if edits <= self.e[item]:
                best[text, item] = min(best.get((text, item), (edits, stop)), (edits, stop))
        return [(*k, *v) for k, v in sorted(best.items())]


def align(item: str, text: str, diagonal: int, e: int) -> tuple[int, int]:
    """Edits, and end in the text, of the best match of ``item`` that starts on 2(e + 1) diagonals from ``diagonal``, or e beside them."""
    low, high = diagonal - e, diagonal + 2 * (e + 1) + e
    exact = text.find(item, max(low, 0), max(high + len(item), 0))
    if exact >= 0:
        return 0, exact + len(item)
    a = _codes(item)
    width = high - low
    region = np.full(len(a) + width, 0xFFFFFFFF, np.uint32)
    take = _codes(text[max(low, 0):max(low + len(region), 0)])
    region[max(-low, 0):max(-low, 0) + len(take)] = take
    outside = region == 0xFFFFFFFF
    far = len(a) + width
    steps = np.arange(width)
    row = np.zeros(width, np.int64)
    for i in range(len(a)):
        cost = np.where(outside[i:i + width], far, region[i:i + width] != a[i])
        new = row + cost
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[-1] = min(new[-1], far)
        row = np.minimum.accumulate(new - steps) + steps
        if i % 8 == 7 and row.min() > e:  # it never falls again
            return e + 1, 0
    d = int(row.argmin())
    return int(row[d]), min(len(text), max(0, low + d + len(a)))


def _blocks(benchmark: DataFrame):
    held, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        text = normalise(r.text)
        if not text:
            continue
        held.append((r.item_id, text))
        size += len(text)
        if size >= INDEX_CHARS:
            yield Index(held)
            held, size = [], 0
    if held:
        yield Index(held)


def _chunks(texts: list[str]):
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK_CHARS or i - a >= CHUNK_TEXTS:
            yield a, texts[a:i + 1]
            a, size = i + 1, 0
    if a < len(texts):
        yield a, texts[a:]


def _passes(docs: DataFrame, benchmark: DataFrame, one_pass):
    """``one_pass`` (docs, broadcast index) for each block of items.

    With one block its result is lazy.  With more, each pass is written before the next block is indexed, and its index is
    released, so that driver and executors hold one block at a time, however large the benchmark.
    """
    context = docs.sparkSession.sparkContext
    blocks = _blocks(benchmark)
    index, following = next(blocks, None), next(blocks, None)
    while index is not None:
        shared = context.broadcast(index)
        out = one_pass(shared)
        if following is None:
            yield out
            return
        yield staged(out, "leaks")
        shared.destroy()
        index, following = following, next(blocks, None)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits and stop (end of the region in the normalised text), a row for each item that a document leaks."""
    spark = docs.sparkSession
    schema = docs.select("doc_id").schema
    for f in benchmark.select("item_id").schema:
        schema = schema.add(f)
    schema = schema.add("edits", "integer").add("stop", "long")
    kind = _arrow_type(schema["item_id"])

    def one_pass(shared):
        def run(batches):
            index = shared.value
            for b in batches:
                texts = [normalise(t) for t in b.column("text").to_pylist()]
                found = [(a + t, i, e, s) for a, part in _chunks(texts) for t, i, e, s in index.found(part)]
                if found:
                    row, item, edits, stop = map(list, zip(*found, strict=True))
                    ids = pa.array(item, kind)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), ids, pa.array(edits, pa.int32()), pa.array(stop, pa.int64())], ["doc_id", "item_id", "edits", "stop"])

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    out = None
    for part in _passes(docs, benchmark, one_pass):
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _arrow_type(field):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that leak no item, with their own columns; every block of items sees only what the blocks before it left."""
    left = [docs]

    def one_pass(shared):
        def run(batches):
            for b in batches:
                texts = [normalise(t) for t in b.column("text").to_pylist()]
                found = {a + t for a, part in _chunks(texts) for t, *_ in shared.value.found(part)}
                yield b.filter(pa.array([i not in found for i in range(b.num_rows)])) if found else b

        return left[0].mapInArrow(run, docs.schema)

    for part in _passes(docs, benchmark, one_pass):
        left[0] = part
    return left[0]
