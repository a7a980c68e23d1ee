"""How filters of documents interact: what each removes at each place of every order.

A document is a mask of the filters it fails.  Masks are counted for each part: a
histogram of all documents, one of those labelled good and one of those labelled
toxic.  These histograms, stacked as rows, are an incidence matrix, and it is
multiplied by integer matrices with a row for each mask and a column for each
order and step: for five filters 32 by 600.  One matrix says which masks are still
kept after a step, one which are removed by it, one which fail its filter but were
removed before, one which fail nothing else, and one in how many of all orders its
filter is the one that removes them.

Documents are reduced to (text digest, doc_id, part, mask) before anything is
joined, so no text is shuffled and a text, source or document that a third of all
rows repeat is counted on the map side.  Which copy of a text is the first is a
minimum for each digest, found again by an equality join on (digest, doc_id).

Cases: a null text is as an empty one, which has no words and fails only the filter
on few words and, if it is not the first, the one on copies; a null source is the
part of the empty string; a row without a doc_id is no copy of another, makes no
other row a copy and has no labels; rows that repeat a doc_id and a text all count
and are not copies of each other; a doc_id labelled twice is good or toxic if any
of its labels says so; texts of any length are judged whole; extra columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import staged

LETTERS = "ABCDE"         # the filters of :func:`failures`, by bit
LEAST_WORDS = 200         # A: fewer fail
LEAST_DISTINCT = 50       # B: a smaller percentage of distinct words fails
MOST_CAPITALS = 2         # C: a larger percentage of A-Z fails
SYMBOLS = "[#$%&*|]"      # D: any of these fails
WORD = r"[^\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AT_ONCE = 256             # parts multiplied at once


def text_mask(text: Column, words: Column) -> Column:
    """The bits of the filters that look at a text alone, A to D."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text), text.rlike(SYMBOLS))
    mask = F.lit(0)
    for bit, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask.cast("int")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: sums over rows of the documents that share a part and a mask are what :func:`histograms` needs."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text"), F.col("words")).alias("mask"))
    rows = staged(rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "masks")
    known = rows.where("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = (labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id")
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic")))
    copy = 1 << LETTERS.index("E")
    judged = known.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left").select(
        "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + copy).alias("mask"), "n",
        F.when(F.col("is_good"), F.col("n")).otherwise(0).alias("good"), F.when(F.col("is_toxic"), F.col("n")).otherwise(0).alias("toxic"))
    nameless = rows.where("doc_id IS NULL").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return judged.unionByName(nameless)


def histograms(rows: DataFrame, filters: int) -> DataFrame:
    """part and the three rows of the incidence matrix that are its own: arrays with a count for each mask."""
    counts = ("n", "good", "toxic")
    by_mask = rows.groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in counts))
    held = by_mask.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*counts)))).alias("held"))  # at most a struct for each mask
    masks = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    row = lambda c: F.transform(masks, lambda m: F.coalesce(F.try_element_at("held", m)[c], F.lit(0).cast("long")))
    return held.select("part", *(row(c).alias(c) for c in counts))


def outcomes(letters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The columns (order, step) and, by name, a matrix of integers with a row for each mask and a column for each of them."""
    orders = ["".join(p) for p in permutations(letters)]
    columns = [(order, step) for order in orders for step in range(1, len(letters) + 1)]
    masks = np.arange(1 << len(letters))[:, None]
    bit = {x: 1 << i for i, x in enumerate(letters)}
    before = np.array([sum(bit[x] for x in order[:step - 1]) for order, step in columns])
    own = np.array([bit[order[step - 1]] for order, step in columns])
    fails, gone = (masks & own) > 0, (masks & before) > 0
    made = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": fails & (masks == own)}
    made = {k: v.astype(np.int64) for k, v in made.items()}
    same = (own[:, None] == own[None, :]).astype(np.int64)  # steps of the same filter, in any order
    return columns, made | {"shapley": made["removed"] @ same}


def interactions(hist: DataFrame, letters: str) -> DataFrame:
    """A row for each part, filter_order and step: the product of the incidence matrix and the outcome matrices."""
    columns, made = outcomes(letters)
    orders, steps = pa.array([o for o, _ in columns]), pa.array([s for _, s in columns], pa.int32())

    def matrix(column):
        return column.flatten().to_numpy().reshape(len(column), -1)

    def multiply(batches):
        for b in batches:
            for a in range(0, b.num_rows, AT_ONCE):
                x = b.slice(a, AT_ONCE)
                n, good, toxic = (matrix(x.column(c)) for c in ("n", "good", "toxic"))
                out = {k: n @ m for k, m in made.items()} | {"good_lost": good @ made["removed"], "toxic_lost": toxic @ made["removed"]}
                part = x.column("part").take(pa.array(np.repeat(np.arange(x.num_rows), len(columns))))
                order, step = (c.take(pa.array(np.tile(np.arange(len(columns)), x.num_rows))) for c in (orders, steps))
                yield pa.RecordBatch.from_arrays([part, order, step, *(pa.array(out[c].ravel()) for c in COUNTS)], ["part", "filter_order", "step", *COUNTS])

    return hist.mapInArrow(multiply, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction of the five filters of :func:`failures`, by source."""
    return interactions(histograms(failures(docs, labels), len(LETTERS)), LETTERS)
