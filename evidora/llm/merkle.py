"""A Merkle manifest of a dataset, and a proof for each of its rows.

Rows become leaves, the leaves of a group (a language) stand in order of their
doc_id, and every ``FANOUT`` consecutive nodes become the digest of their digests
until one is left; the groups' tops are joined the same way to the root.  The tree
is a table of nodes by their coordinates: group, level and place.

A proof is looked up by coordinates.  From its place and the size of its group
follows which siblings a leaf needs; it explodes their coordinates, joins the table
of nodes, orders what it finds, and folds it with its own digest.  Above level
``TIER`` all leaves of a block have the same siblings, so these are looked up once
by the block's top, and so on up the tree: a leaf explodes at most ``TIER``
coordinates whatever the size of the table, and no node is asked for by more than
``FANOUT ** TIER`` rows, where the top of the tree would be by all.

Places come from a range partitioning by group, doc_id and digest, with a row number
to split ties; a group of any size is spread over all partitions, and only counts
for each partition and group are summed in order.

Cases: a null is written ``-`` in a leaf, so it differs from an empty text; a null
doc_id comes first in its group and is never tampered with; a null language is a
group of its own, before all others; rows that repeat are leaves each, with proofs of
their own; the order of rows of the same doc_id is that of their digests; texts of any length
count whole; a group of one leaf has that leaf as its top; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.llm.common import crc_mod, staged

FANOUT = 2
TIER = 6                  # levels that are built, and looked up, in one step
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """A value as text that cannot be taken for two values: ``-`` for null, else its byte count, a colon and itself."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value), F.lit(":"), value))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, key (of the group), leaf, and tampered: the leaf of a row that was changed, null for the others."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    whole, changed = (digest(F.concat(*(encoded(n if c == "n_chars" else F.col(c)) for c in LEAF))) for n in (F.col("n_chars"), more))
    return docs.select("doc_id", "lang", encoded(F.col("lang")).alias("key"), whole.alias("leaf"), F.when(crc_mod("doc_id", 7) == 0, changed).alias("tampered"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, a row's place in the order of its ``key``, and ``n``, how many rows that key has."""
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "key", *order, "row").sortWithinPartitions("key", *order, "row").drop("row")
    ranged = staged(ranged.withColumn("spot", F.monotonically_increasing_id()), "ranged").withColumn("part", F.shiftright("spot", 33))
    # A row for each partition and key: at most the partitions and the keys together.
    runs = ranged.groupBy("key", "part").agg(F.min("spot").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("key")
    runs = runs.select("key", "part", (F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"), "first", F.sum("rows").over(whole).alias("n"))
    return ranged.join(runs, ["key", "part"]).withColumn("at", F.col("spot") - F.col("first") + F.coalesce("before", F.lit(0))).drop("spot", "part", "first", "before")


def _levels(n: Column, fanout: int) -> Column:
    """How many levels stand above the leaves of a group of ``n``."""
    powers = [fanout ** i for i in range(64) if fanout ** i < 1 << 62]
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < n))


def _up(at: Column, fanout: int, levels: int) -> Column:
    """The place of a node's ancestor so many levels higher."""
    return F.floor(at / F.lit(fanout ** levels))


def tree(rows: DataFrame, fanout: int = FANOUT, tier: int = TIER) -> list[DataFrame]:
    """Nodes above ``rows`` (key, at, n, hash), as tables of ``tier`` levels: key, n, level, at and hash.

    The highest level of a table is the lowest of the next one too, if that group has a next one.
    """
    tables = []
    most = rows.agg(F.max("n")).first()[0] or 0
    base, width = 0, fanout ** tier
    while True:
        block = rows.groupBy("key", "n", _up(F.col("at"), fanout, tier).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "hash"))).alias("own"))
        # At most ``width`` nodes of a block, hashed level by level while the group has a level more.
        joined = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / fanout).cast("int")), lambda i: digest(F.array_join(F.slice(xs, i * fanout + 1, fanout), "")))
        levels = F.aggregate(F.sequence(F.lit(1), F.lit(tier)), F.array(F.transform("own", lambda x: F.lower(F.hex(x["hash"])))),
                             lambda made, i: F.when(i + base <= F.col("depth"), F.concat(made, F.array(joined(F.element_at(made, -1))))).otherwise(made))
        up = block.withColumn("depth", _levels(F.col("n"), fanout)).select("key", "n", "block", F.posexplode(levels).alias("up", "hashes")).select("key", "n", "block", "up", F.posexplode("hashes").alias("i", "hash"))
        size = F.element_at(F.array(*(F.lit(fanout ** (tier - i)).cast("long") for i in range(tier + 1))), F.col("up") + 1)
        tables.append(staged(up.select("key", "n", (F.col("up") + base).alias("level"), (F.col("block") * size + F.col("i")).alias("at"), F.unhex("hash").alias("hash")), "nodes"))
        base += tier
        if fanout ** base >= most:
            return tables
        rows = tables[-1].where((F.col("level") == base) & (_levels(F.col("n"), fanout) > base)).select("key", "at", "n", "hash")


def tops(tables: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """key, n, depth and hash: the last node of every group."""
    return reduce(DataFrame.unionByName, tables).withColumn("depth", _levels(F.col("n"), fanout)).where("level = depth").select("key", "n", "depth", "hash")


def _looked_up(members: DataFrame, nodes: DataFrame, base: int, fanout: int, tier: int) -> DataFrame:
    """``members`` (key, at, n, payload) with ``block`` and ``steps``: their siblings' digests before and after them, by level."""
    depth = _levels(F.col("n"), fanout)

    widths = F.array(*(F.lit(fanout ** j).cast("long") for j in range(tier)))  # leaves of this tier below a node, by level

    def siblings(i):
        width, level = F.element_at(widths, i + 1), i + base
        here = F.floor(F.col("at") / width)
        last = F.floor((F.col("count") - 1) / width)  # place of the last node of this level
        run = F.floor(here / fanout) * fanout
        return F.when(level < depth, F.transform(F.filter(F.sequence(run, F.least(run + fanout - 1, last)), lambda p: p != here), lambda p: F.struct(level.alias("level"), p.alias("place")))).otherwise(
            F.array().cast("array<struct<level:int,place:bigint>>"))

    # Places count from this tier's lowest level, of which a group has so many nodes.
    members = members.withColumn("count", F.floor((F.col("n") - 1) / F.lit(fanout ** base)) + 1)
    wanted = F.concat(F.array(F.struct(F.lit(base).alias("level"), F.col("at").alias("place"))), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(tier - 1)), siblings)))
    # The first coordinate is the member's own: it carries what belongs to the member.
    asked = members.select("key", "at", "n", "payload", F.posexplode(wanted).alias("i", "c")).select("key", "at", "n", F.when(F.col("i") == 0, F.col("payload")).alias("payload"), "i", "c.level", "c.place")
    found = asked.join(nodes.select("key", "level", F.col("at").alias("place"), "hash"), ["key", "level", "place"])
    block = _up(F.col("at"), fanout, tier).alias("block")
    got = (found.select("key", block, "at", "n", "payload", "i", "level", "place", F.when(F.col("i") > 0, F.col("hash")).alias("hash"), F.when(F.col("i") == 0, F.col("hash")).alias("own")).repartition("key", "block")
           .groupBy("key", "block", "at", "n").agg(F.max("payload").alias("payload"), F.max("own").alias("own"), F.sort_array(F.collect_list(F.when(F.col("i") > 0, F.struct("level", "place", "hash")))).alias("held")))
    level = F.filter(F.sequence(F.lit(0), F.lit(tier - 1)), lambda i: i + base < depth)

    def beside(i, before):
        here = F.floor(F.col("at") / F.element_at(widths, i + 1))
        side = (lambda x: x.place < here) if before else (lambda x: x.place > here)
        return F.array_join(F.transform(F.filter("held", lambda x: (x.level == i + base) & side(x)), lambda x: F.lower(F.hex(x["hash"]))), "")

    return got.withColumn("steps", F.transform(level, lambda i: F.struct(beside(i, True).alias("before"), beside(i, False).alias("after"))))


def paths(members: DataFrame, tables: list[DataFrame], above: DataFrame, fanout: int = FANOUT, tier: int = TIER) -> DataFrame:
    """key, payload, own, steps (from the member to the last root) and what ``above`` carries besides.

    ``members`` has key, at, n and payload (a struct without other structs); ``above`` has key, n, steps and ``carried`` for every group.
    """
    depth = _levels(F.col("n"), fanout)
    ends = F.greatest(F.floor((depth - 1) / tier).cast("int"), F.lit(0))  # the tier in which a group's top stands
    upper = None
    for t in reversed(range(len(tables))):
        base = t * tier
        here = members if t == 0 else tables[t].where((F.col("level") == base) & (depth > base)).select("key", "at", "n", F.lit(None).cast("struct<none:int>").alias("payload"))
        got = _looked_up(here, tables[t], base, fanout, tier)
        last = above.where(ends == t).select("key", F.lit(0).cast("long").alias("block"), F.col("steps").alias("more"), "carried")
        higher = last if upper is None else last.unionByName(upper)
        joined = got.join(higher, ["key", "block"]).withColumn("steps", F.concat("steps", "more")).drop("more", "block")
        upper = joined.select("key", F.col("at").alias("block"), F.col("steps").alias("more"), "carried")
    return joined


def proofs(docs: DataFrame, fanout: int = FANOUT, tier: int = TIER) -> DataFrame:
    """A row for each of ``docs``: its leaf, subroot, root, the proof's digest, and what the leaf (a changed one for every seventh) folds to."""
    rows = staged(placed(leaves(docs), "doc_id", "leaf"), "leaves")
    nodes = tree(rows.select("key", "at", "n", F.unhex("leaf").alias("hash")), fanout, tier)
    groups = tops(nodes, fanout).join(rows.groupBy("key").agg(F.first("lang").alias("lang")), "key")
    ranked = staged(placed(groups.select(F.lit("").alias("key"), F.col("key").alias("group"), F.col("n").alias("size"), "lang", "hash"), "lang"), "groups")
    upper = tree(ranked.select("key", "at", "n", "hash"), fanout, tier)
    root = tops(upper, fanout).select("key", "n", F.array().cast("array<struct<before:string,after:string>>").alias("steps"), F.struct("hash").alias("carried"))
    subroots = paths(ranked.select("key", "at", "n", F.struct("group", "size").alias("payload")), upper, root, fanout, tier)
    above = staged(subroots.select(F.col("payload.group").alias("key"), F.col("payload.size").alias("n"), "steps", F.struct(F.col("own").alias("subroot"), F.col("carried.hash").alias("root")).alias("carried")), "subroots")
    got = paths(rows.select("key", "at", "n", F.struct("doc_id", "tampered").alias("payload")), nodes, above, fanout, tier)
    hexed = lambda c: F.lower(F.hex(c))
    got = got.select("payload.doc_id", hexed("own").alias("leaf"), hexed("carried.subroot").alias("subroot"), hexed("carried.root").alias("root"), "steps", "payload.tampered")
    proof = digest(F.array_join(F.transform("steps", lambda s: F.concat(s.before, s.after)), ""))
    fold = F.aggregate("steps", F.coalesce("tampered", "leaf"), lambda node, s: digest(F.concat(s.before, node, s.after)))
    return got.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root"), "steps").withColumn("verified", F.col("folded_root") == F.col("root")).drop("steps")
