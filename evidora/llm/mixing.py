"""Mixing sources to target weights by temperature.

Each source's share of all tokens (runs of characters that are not white space)
is raised to an exponent and the results are scaled to weights.  The exponent is
found by bisection between 0 (equal weights) and 1 (natural shares): the largest
one whose weights have the target entropy, or a larger one where a source would
otherwise be repeated more than the limit.  Unless a target is given it is half-way
between the entropy of the natural shares and the greatest, so that sources of
different sizes are always brought nearer to each other.  A source's weight times the token
budget is its quota, taken in passes over the source.  In every pass the source's
blocks of documents come in a random order, and the documents of a block in
another; the last pass stops where the quota is met, to within a document.
``progress`` is how much of its source's quota stands before a document, so all
sources sorted by it together are the mixture.

Everything is DataFrame functions.  A source is cut in blocks of about
``BLOCK_TOKENS`` tokens by a hash, so a source of any size is ordered by windows
over blocks and over the documents of one block, never over all its documents.

Cases: a null or empty text has no tokens and is in no pass, as is a source
without tokens; a null source is a source of its own; rows that repeat a doc_id
and text are taken together or not at all; a null doc_id is allowed; a text of any
length counts all its tokens, and one longer than its source's quota is not taken;
ties in a random order go to the smaller doc_id; sources of equal size have equal
weights; extra columns are kept by :func:`mix`, but for those that it makes, which
replace columns of their name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidora.llm.common import staged

TARGET_ENTROPY = None     # of the entropy of equal weights; None: half-way between that of the natural shares and 1
MAX_REPETITION = 4.0      # passes over a source
BUDGET_RATE = 1.0         # tokens of the mixture, over those of the corpus
BLOCK_TOKENS = 1 << 20
SEED = 7
SECTIONS, ROUNDS = 16, 7  # the bisection cuts its interval in so many parts at once


def units(docs: DataFrame) -> DataFrame:
    """doc_id, source, tag (a hash of the text) and tokens: a row for all rows that share the first three."""
    return (docs.select("doc_id", "source", F.hash("text").alias("tag"), F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("n"))
            .groupBy("doc_id", "source", "tag").agg(F.sum("n").alias("tokens")).where("tokens > 0"))


def exponent(totals: DataFrame, target_entropy: float | None = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION, budget: float | None = None) -> float:
    """The exponent for the sources in ``totals`` (source, tokens)."""
    whole = totals.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).first()
    if not whole.n or whole.n == 1:
        return 1.0
    rate = (budget or whole.tokens) / whole.tokens
    share = F.col("tokens") / F.lit(float(whole.tokens))

    def measured(points):
        """(share of the greatest entropy, most passes over a source) at each exponent."""
        w = F.pow(share, F.col("t"))
        rows = (totals.withColumn("t", F.explode(F.array(*map(F.lit, points)))).groupBy("t")
                .agg(F.sum(w).alias("z"), F.sum(w * F.log(share)).alias("l"), F.max(w / share).alias("most"))
                .select("t", ((F.log("z") - F.col("t") * F.col("l") / F.col("z")) / F.log(F.lit(float(whole.n)))).alias("h"), (rate * F.col("most") / F.col("z")).alias("most")).collect())
        return {r.t: (r.h, r.most) for r in rows}

    def bisect(holds, low, high):
        """The largest exponent of [low, high] with ``holds``, true below and false above some place."""
        for _ in range(ROUNDS):
            points = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
            true = holds(measured(points), points)
            i = max((i for i, x in enumerate(true) if x), default=0)
            low, high = points[i], points[min(i + 1, SECTIONS)]
            if low == high:
                break
        return low

    if target_entropy is None:
        target_entropy = (measured([1.0])[1.0][0] + 1) / 2
    even = bisect(lambda m, points: [m[t][0] >= target_entropy - 1e-12 for t in points], 0.0, 1.0)
    if measured([even])[even][1] <= max(max_repetition, rate) + 1e-9:
        return even
    return bisect(lambda m, points: [m[t][1] > max(max_repetition, rate) for t in points], even, 1.0) + 1 / SECTIONS**ROUNDS


def passes(docs: DataFrame, target_entropy: float | None = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION, budget: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, source, tag, tokens, weight, epoch and progress: a row for each time that a document is in the mixture."""
    rows = staged(units(docs), "units").withColumn("of", F.concat(F.lit("="), "source")).withColumn("of", F.coalesce("of", F.lit("-")))
    totals = staged(rows.groupBy("of").agg(F.sum("tokens").alias("tokens")), "totals")
    t = exponent(totals, target_entropy, max_repetition, budget)
    whole = totals.agg(F.sum("tokens").alias("n"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(t))).alias("z")).first()
    weight = F.pow(F.col("tokens").cast("double"), F.lit(t)) / F.lit(whole.z or 1.0)
    quota = (totals.withColumn("weight", weight).withColumn("quota", F.round(F.col("weight") * F.lit(float(budget or (whole.n or 0) * BUDGET_RATE))).cast("long"))
             .select("of", "weight", "quota", F.col("tokens").alias("all"), F.ceil(F.col("tokens") / block_tokens).alias("blocks")))
    taken = (rows.join(quota, "of")
             .withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "tag"), F.col("blocks")))
             .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr("cast((quota - 1) div `all` as int)")))).where("quota > 0"))
    of_block = taken.groupBy("of", "epoch", "block").agg(F.sum("tokens").alias("in_block"))
    shuffled = F.xxhash64(F.lit(SEED), "epoch", "of", "block")
    ahead = Window.partitionBy("of", "epoch").orderBy(shuffled, "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_block.select("of", "epoch", "block", F.coalesce(F.sum("in_block").over(ahead), F.lit(0)).alias("block_start"))
    within = Window.partitionBy("of", "epoch", "block").orderBy(F.xxhash64(F.lit(SEED), "epoch", "doc_id", "tag"), "doc_id", "tag").rowsBetween(Window.unboundedPreceding, -1)
    placed = (taken.withColumn("before", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(starts, ["of", "epoch", "block"])
              .withColumn("start", F.col("epoch") * F.col("all") + F.col("block_start") + F.col("before")))
    return (placed.where(F.col("start") + F.col("tokens") <= F.col("quota"))
            .select("doc_id", "source", "tag", "tokens", "weight", "epoch", (F.col("start") / F.col("quota")).alias("progress")))


def mixture(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, source, tokens, weight, epoch and progress of the mixture's documents."""
    return passes(docs, **limits).drop("tag")


def mix(docs: DataFrame, **limits) -> DataFrame:
    """The rows of the mixture with their own columns, and weight, epoch and progress."""
    chosen = passes(docs, **limits).select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("tag").alias("__tag"), F.col("weight").alias("mix_weight"), F.col("epoch").alias("mix_epoch"), F.col("progress").alias("mix_progress"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("source").eqNullSafe(F.col("__source")) & (F.hash("text") == F.col("__tag"))
    return docs.drop("mix_weight", "mix_epoch", "mix_progress").join(chosen, same).drop("__doc", "__source", "__tag")
