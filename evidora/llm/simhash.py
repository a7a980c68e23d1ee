"""SimHash near-duplicates, linked exactly with vantage-point trees.

A fingerprint bit is the majority over the XXH64 hashes of a text's word
shingles.  Distinct fingerprints are partitioned by a vantage-point tree: a
node keeps a point and a radius, points within the radius go inside, the rest
outside.  By the triangle inequality two fingerprints at most ``bits`` apart can
only be on different sides when both lie within ``bits`` of the border, so an
inside point near the border also visits the outer shard.  A shard goes on
splitting by vantage points in memory; what is left at the bottom is compared
where one of ``bits + 1`` blocks of bits agrees, as it does for every pair that
differs in ``bits`` of them.  Each shard returns a spanning forest of its links, so
a group of n near copies gives fewer than n rows from a shard, never all pairs.
Links are joined into components by large-star and small-star steps.

The tree is fitted on a bounded sample and only routes; every fingerprint is
indexed, and the pairs are exact whatever the tree.  It has ``DEPTH`` levels, and
one more for every doubling past ``LEAF`` fingerprints a shard.

Cases: an empty or null text has fingerprint zero, linked like any other; a text of
any length is one fingerprint of all its shingles; rows that repeat are one
fingerprint; a null doc_id is in its group but never names it, and the component of
a group without any doc_id is null; ties do not arise, as the smallest doc_id names
a group; extra columns are ignored by :func:`near_duplicates`, whatever their names,
and kept by :func:`keep_one`; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import row_hash, staged

WORDS = 4
BITS = 4
SEED = 42
SAMPLE = 20000        # fingerprints that a tree is fitted on, at most
DEPTH = 3             # levels of the smallest tree
LEAF = 1 << 20        # fingerprints that should be at home in a shard, at most
GROUP = 1 << 23       # rows of a shard that one task takes; a shard with more is dealt in pairs of blocks
BOTTOM = 1 << 15      # points below which a shard's own tree ends
BLOCK = 1 << 20       # comparisons made at once
HOT_ROWS = 4096       # rows of one fingerprint above which they may be joined apart


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Majority of the hashes of all word shingles, repeats included; words are split at ASCII white space."""
    found = text.lower().split()  # of bytes: lowers A-Z only and splits at \\x20 and \\x09-\\x0D
    if not found:
        return 0
    joined = memoryview(b" ".join(found))
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = max(len(found) - words, 0)
    last = ends[min(words, len(found)) - 1:]
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:k + 1].tolist(), last.tolist(), strict=True)), np.uint64, k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at:at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and ``fp``, the fingerprint as a signed long, of every row."""

    def run(batches):
        for b in batches:
            made = np.array([fingerprint((t or "").encode(), words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("fp", "long"))


def _distance(a, b):
    return np.bitwise_count(a ^ b).astype(np.int64)


class Node:
    __slots__ = ("point", "radius", "inner", "outer", "leaf")

    def __init__(self, leaf=None, point=None, radius=0, inner=None, outer=None):
        self.leaf, self.point, self.radius, self.inner, self.outer = leaf, point, radius, inner, outer


def _split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """Of some candidates the vantage point, with its median radius, whose border has the fewest points beside it; none if all are at one distance."""
    best = None
    for point in points[np.linspace(0, len(points) - 1, min(len(points), 8)).astype(int)]:
        d = _distance(points, point)
        radius = int(np.median(d))
        if radius == d.max():
            radius -= 1
        if radius < 0 or not (d <= radius).any():
            continue
        inside = (d <= radius).mean()
        cost = ((d > radius - BITS) & (d <= radius + BITS)).mean() + 2 * abs(inside - 0.5)
        if best is None or cost < best[0]:
            best = cost, point, radius
    return best and best[1:]


def build_tree(sample: np.ndarray, depth: int) -> tuple[Node, int]:
    """A tree of ``depth`` levels at most, and its number of leaves."""
    leaves = 0

    def grow(points, level):
        nonlocal leaves
        split = _split(points) if level and len(points) > 1 else None
        if split:
            point, radius = split
            d = _distance(points, point)
            return Node(None, point, radius, grow(points[d <= radius], level - 1), grow(points[d > radius], level - 1))
        leaves += 1
        return Node(leaves - 1)

    return grow(sample, depth), leaves


def route(tree: Node, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, index, home) of every shard that each fingerprint visits; it is at home in one of them."""
    out: list[tuple] = []

    def go(node, at, home):
        if not len(at):
            return
        if node.leaf is not None:
            out.append((np.full(len(at), node.leaf), at, home))
            return
        d = _distance(fps[at], node.point)
        inside = d <= node.radius
        # At home a point near the border visits the other side only outwards, so that each pair across it meets once.
        go(node.inner, at[inside | ~home & (d <= node.radius + bits)], home[inside | ~home & (d <= node.radius + bits)])
        outer = ~inside | (d > node.radius - bits)
        go(node.outer, at[outer], (home & ~inside)[outer])

    go(tree, np.arange(len(fps)), np.ones(len(fps), bool))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Forest:
    """Union-find over positions in an array; the smallest position is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while True:
            s = self.up[r]
            if (s == r).all():
                self.up[at] = r
                return r
            r = s

    def hook(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hang the larger root of each pair below the smallest it meets; some pairs may still be apart afterwards."""
        np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def link_near(fps: np.ndarray, home: np.ndarray, bits: int) -> np.ndarray:
    """Root of each of a shard's fingerprints, after linking all pairs of which one at least is at home."""
    forest = Forest(len(fps))

    def link(i, j):
        near = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        i, j = i[near], j[near]
        while len(i):
            a, b = forest.roots(i), forest.roots(j)
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            forest.hook(a[apart], b[apart])

    def compare(a, points):
        """Pairs of ``a`` and ``points`` that agree in a block of bits; a block value whose holders are all linked needs no more."""
        edges = np.linspace(0, 64, bits + 2).astype(int).tolist()
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            mask = np.uint64((1 << high - low) - 1)
            of_a, of_points = (fps[x] >> np.uint64(low) & mask for x in (a, points))
            order = np.argsort(of_a, kind="stable")
            own, of_a = a[order], of_a[order]
            order = np.argsort(of_points, kind="stable")
            other, of_points = points[order], of_points[order]
            first, last = np.searchsorted(of_points, of_a), np.searchsorted(of_points, of_a, side="right")
            n = last - first
            at, width = 0, 1
            while at < len(own):
                if n[at] > 512:  # few rows first: in a dense group they link nearly all of it
                    same = other[first[at]:last[at]]
                    stop = int(np.searchsorted(of_a, of_a[at], side="right"))
                    if len(np.unique(forest.roots(np.concatenate([own[at:stop], same])))) == 1:
                        at, width = stop, 1
                        continue
                    to = min(at + width, stop)
                    width = 1 if to == stop else min(2 * width, max(1, BLOCK // len(same)))
                else:
                    big = np.flatnonzero(n[at:at + BLOCK] > 512)
                    end = at + (int(big[0]) if len(big) else min(BLOCK, len(own) - at))
                    to = at + max(1, int(np.searchsorted(np.cumsum(n[at:end]), BLOCK)))
                    to = min(to, end)
                count = n[at:to]
                i = np.repeat(np.arange(at, to), count)
                link(own[i], other[np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + first[i]])
                at = to

    stack = [(np.flatnonzero(home), None), (np.flatnonzero(~home), np.flatnonzero(home))]
    while stack:
        a, b = stack.pop()
        same = b is None
        points = a if same else b
        if not len(a) or not len(points):
            continue
        split = _split(fps[points[np.linspace(0, len(points) - 1, min(len(points), 512)).astype(int)]]) if len(points) > BOTTOM else None
        d = _distance(fps[points], split[0]) if split else None
        if d is None or (d <= split[1]).all() or not (d <= split[1]).any():
            compare(a, points)
            continue
        point, radius = split
        inside = d <= radius
        inner, outer = points[inside], points[~inside]
        if same:
            stack += [(inner, None), (outer, None), (inner[d[inside] > radius - bits], outer[d[~inside] <= radius + bits])]
        else:
            e = _distance(fps[a], point)
            stack += [(a[e <= radius + bits], inner), (a[e > radius - bits], outer)]
    return forest.roots(np.arange(len(fps)))


def depth_for(n: int) -> int:
    return max(DEPTH, int(np.ceil(np.log2(max(n, 1) / LEAF))))


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v) of a set of links with the same components as all pairs of ``fp`` at most ``bits`` apart; v < u."""
    spark = distinct.sparkSession
    n = distinct.count()
    sample = [r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    tree, leaves = build_tree(np.array(sample, np.int64).view(np.uint64), depth_for(n))
    shared = spark.sparkContext.broadcast(tree)  # no more nodes than twice the sample

    def visit(batches):
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False)
            leaf, at, home = route(shared.value, fps.view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(fps[at]), pa.array(home)], ["leaf", "fp", "home"])

    visits = staged(distinct.mapInArrow(visit, "leaf int, fp long, home boolean"), "visits")

    def pair(table):
        fps = table.column("fp").to_numpy()
        order = np.argsort(fps)
        fps, home = fps[order], table.column("home").to_numpy()[order]
        up = link_near(np.ascontiguousarray(fps).view(np.uint64), home, bits)
        at = np.flatnonzero(up != np.arange(len(fps)))
        return pa.table({"u": fps[at], "v": fps[up[at]]})

    # A shard that is too large for a task is dealt in blocks, and every pair of blocks is a group of its own, so that no
    # group holds it whole: a row of block b goes to the pairs of b with each block, itself included.
    sizes = visits.groupBy("leaf").count().withColumn("blocks", F.ceil(F.col("count") * 2 / GROUP).cast("int")).collect()  # a row for each leaf of the tree
    blocks = {r.leaf: r.blocks for r in sizes if r["count"] > GROUP}
    dealt = visits.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if blocks:
        n_blocks = F.coalesce(F.create_map(*(F.lit(x) for kv in blocks.items() for x in kv))[F.col("leaf")], F.lit(1))
        own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        dealt = (visits.withColumn("n", n_blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
                 .select("leaf", "fp", "home", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    return dealt.groupBy("leaf", "i", "j").applyInArrow(pair, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v): root is the smallest node of its component.

    Large-star and small-star steps in turn, each a grouping and a join, until the links no longer change.
    """
    def both(e):
        return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large_star(e):
        e = both(e)
        least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return e.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()

    def small_star(e):
        e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        return (e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())

    def state(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h")).first()
        return r.n, r.h

    now = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = state(now)
    while seen[0]:
        now = staged(small_star(large_star(now)), "links")
        was, seen = seen, state(now)
        if was == seen:
            break
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root").distinct())


def _grouped(docs: DataFrame, words: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The staged (doc_id, fp) of every row, and for each fp its group (a fingerprint), its number of rows and the group's smallest doc_id."""
    rows = staged(fingerprints(docs, words), "fingerprints")
    of_fp = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "distinct")
    root = components(links(of_fp.select("fp"), bits)).withColumnRenamed("node", "fp")
    named = of_fp.join(root, "fp", "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("group"))
    groups = named.groupBy("group").agg(F.min("least").alias("component_id"))
    return rows, staged(named.join(groups, "group").select("fp", "rows", "group", "component_id"), "groups")


def _with_groups(rows: DataFrame, of_fp: DataFrame) -> DataFrame:
    """The rows with their fingerprint's group; the few fingerprints with very many rows are joined by broadcast."""
    total = of_fp.agg(F.sum("rows").alias("n")).first().n or 0
    hot = of_fp.where(F.col("rows") > max(HOT_ROWS, total // 1000))  # fewer than a thousand, as each holds a thousandth of all rows
    if hot.isEmpty():
        return rows.join(of_fp, "fp")
    few = F.broadcast(hot)
    return rows.join(few, "fp").unionByName(rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(of_fp, "fp"))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every row."""
    rows, of_fp = _grouped(docs.select("doc_id", "text"), words, bits)
    return _with_groups(rows, of_fp).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """One row of each group, that with the smallest doc_id.

    Of a group's rows with that doc_id the one with the smallest hash of its columns stays, so the choice does not depend
    on partitions; a doc_id with different texts is in as many groups and may stay in each.  Rows without a doc_id all stay.
    """
    named = docs.where("doc_id is not null")
    mark = row_hash(docs)
    marked = named.select("doc_id", "text", mark.alias("mark"))

    def run(batches):
        for b in batches:
            made = np.array([fingerprint((t or "").encode(), words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(made.view(np.int64))], ["doc_id", "mark", "fp"])

    schema = docs.select("doc_id").schema.add("mark", "long").add("fp", "long")
    rows = staged(marked.mapInArrow(run, schema), "fingerprints")
    of_fp = staged(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "mark")).alias("first")), "distinct")
    root = components(links(of_fp.select("fp"), bits)).withColumnRenamed("node", "fp")
    first = of_fp.join(root, "fp", "left").groupBy(F.coalesce("root", "fp").alias("group")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__doc"), F.col("first.mark").alias("__mark"))
    same = (F.col("doc_id") == F.col("__doc")) & (mark == F.col("__mark"))
    # Rows that are alike in all columns: by the join's own keys, so that they are not shuffled again.
    one = named.join(first, same).select(*docs.columns, "__doc", "__mark").dropDuplicates(["__doc", "__mark"]).select(docs.columns)
    return one.unionByName(docs.where("doc_id is null"))
