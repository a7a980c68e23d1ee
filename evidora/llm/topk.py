"""Exact top-k search by distributed histogram selection.

Vectors are packed in blocks; every block of candidates meets every block of
queries, and all scores are exact integers.  Each round counts scores in bins of
an interval that holds a query's k-th highest score: a pair of blocks sends the
counts down to its own k-th score only, since the global one cannot be lower,
Spark sums them, and the bin that holds the k-th score is the next round's
interval.  When bins are one wide that score is known, the scores below it are
filtered out, and ties go to the smaller id.

Cases: vectors that are null, or hold a null or non-finite component, take no
part; a shorter vector is as if filled with zeros; a null id is never a query
and loses every tie; rows that repeat are candidates each, those with the
query's own id are never its partners; a query with fewer than k candidates
gets all; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.llm.common import staged

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16384
AT_ONCE = 1 << 22     # scores held at once
BINS = 512
NO_ID = np.iinfo(np.int64).max  # stands for a null id


def quantised(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``v``: floor(256 x) of each component x; rows that take no part are gone."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & whole).withColumn("v", F.transform(x, lambda c: F.floor(c * 256)))


def _packed(rows: DataFrame, block: int, dim: int, groups: int) -> DataFrame:
    """Blocks of at most ``block`` rows (ids and a matrix), each with a number below ``groups``."""

    def run(batches):
        ids, parts, n, g = [], [], 0, None
        for b in batches:
            i = b.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            v = b.column("v")
            lengths = np.diff(v.offsets.to_numpy())
            m = np.zeros((len(i), dim), np.int64)
            m[np.repeat(np.arange(len(i)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = v.flatten().to_numpy(zero_copy_only=False)
            for a in range(0, len(i), block):
                ids.append(i[a:a + block])
                parts.append(m[a:a + block])
                n += len(ids[-1])
                if n >= block:
                    g = int(ids[0][0] % groups) if g is None else (g + 1) % groups
                    yield _block(ids, parts, g)
                    ids, parts, n = [], [], 0
        if n:
            yield _block(ids, parts, int(ids[0][0] % groups) if g is None else (g + 1) % groups)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(run, "g int, ids binary, m binary")


def _block(ids, parts, g):
    m = np.concatenate(parts)
    return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["g", "ids", "m"])


def _scores(q, c, q_ids, c_ids, exact_as_float):
    """Score blocks (rows of queries) with the query's own rows at the least integer."""
    step = max(1, AT_ONCE // max(len(c), 1))
    cf = c.T.astype(np.float64) if exact_as_float else c.T
    for a in range(0, len(q), step):
        s = (q[a:a + step].astype(np.float64) @ cf).astype(np.int64) if exact_as_float else q[a:a + step] @ cf
        s[q_ids[a:a + step, None] == c_ids[None, :]] = np.iinfo(np.int64).min
        yield a, s


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row that ``is_query`` selects."""
    spark = vectors.sparkSession
    v = staged(quantised(vectors, vector).select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = v.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(norm).alias("norm"), F.count_if("asks").alias("asks")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not size.asks:
        return spark.createDataFrame([], result)
    dim, bound = size.dim, int(size.norm) + 1
    exact_as_float = bound < 1 << 52
    groups = max(1, -(-size.n // CANDIDATE_BLOCK))
    cands = staged(_packed(v, CANDIDATE_BLOCK, dim, groups), "candidates")
    queries = staged(_packed(v.where("asks"), QUERY_BLOCK, dim, 1).select(F.monotonically_increasing_id().alias("block"), F.col("ids").alias("q_ids"), F.col("m").alias("q")), "queries")
    width = max(1, -(-(2 * bound + 1) // BINS))

    def start(batches):
        for b in batches:
            n = [len(x.as_py()) // 8 for x in b.column("q_ids")]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array([np.full(x, -bound, np.int64).tobytes() for x in n], pa.binary()), pa.array([np.zeros(x, np.int64).tobytes() for x in n], pa.binary())],
                                             ["block", "low", "above"])

    state = staged(queries.select("block", "q_ids").mapInArrow(start, "block long, low binary, above binary"), "intervals")

    def pairs(state):
        asked = queries.join(state, "block").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return cands.join(asked, "g")

    def arrays(row):
        q_ids, c_ids = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "ids"))
        return q_ids, c_ids, np.frombuffer(row["q"], np.int64).reshape(-1, dim), np.frombuffer(row["m"], np.int64).reshape(-1, dim), np.frombuffer(row["low"], np.int64), np.frombuffer(row["above"], np.int64)

    def best(s):
        """The k-th highest score of each row, or the least if there are fewer."""
        return s.min(1) if s.shape[1] <= k else np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]

    def round_of(state, width, span):
        def count(batches):
            for b in batches:
                for row in b.to_pylist():
                    q_ids, c_ids, q, c, low, above = arrays(row)
                    for a, s in _scores(q, c, q_ids, c_ids, exact_as_float):
                        floor = np.maximum(best(s), low[a:a + len(s)])
                        i, j = np.nonzero(s >= floor[:, None])
                        at = s[i, j] - low[a + i]
                        inside = at < span  # those beyond are in ``above``
                        at //= width
                        key, n = np.unique((a + i[inside]) * BINS + at[inside], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), row["block"])), pa.array((key // BINS).astype(np.int32)), pa.array((key % BINS).astype(np.int32)), pa.array(n)], ["block", "i", "bin", "n"])

        counted = pairs(state).mapInArrow(count, "block long, i int, bin int, n long").groupBy("block", "i", "bin").agg(F.sum("n").alias("n"))

        def narrow(was, table):
            low, above = (np.frombuffer(was.column(c)[0].as_py(), np.int64).copy() for c in ("low", "above"))
            seen = np.zeros((len(low), BINS), np.int64)
            seen[table.column("i").to_numpy(), table.column("bin").to_numpy()] = table.column("n").to_numpy()
            down = above[:, None] + np.cumsum(seen[:, ::-1], axis=1)[:, ::-1]  # scores in a bin or above it
            held = down >= k
            at = np.where(held.any(1), BINS - 1 - np.argmax(held[:, ::-1], axis=1), 0)
            rows = np.arange(len(low))
            above = down[rows, at] - seen[rows, at]
            return pa.table({"block": was.column("block")[:1], "low": pa.array([(low + at * width).tobytes()], pa.binary()), "above": pa.array([above.tobytes()], pa.binary())})

        return staged(state.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(narrow, "block long, low binary, above binary"), "intervals")

    span = width * BINS
    while True:
        state = round_of(state, width, span)
        if width == 1:
            break
        span, width = width, -(-width // BINS)

    def select(batches):
        for b in batches:
            for row in b.to_pylist():
                q_ids, c_ids, q, c, low, _ = arrays(row)
                out = []
                for a, s in _scores(q, c, q_ids, c_ids, exact_as_float):
                    i, j = np.nonzero(s >= np.maximum(best(s), low[a:a + len(s)])[:, None])
                    own = s[i, j] == np.iinfo(np.int64).min
                    i, j = i[~own], j[~own]
                    order = np.lexsort((c_ids[j], -s[i, j], i))
                    i, j = i[order], j[order]
                    first = np.searchsorted(i, i)
                    top = np.arange(len(i)) - first < k
                    out.append((a + i[top], j[top], s[i[top], j[top]]))
                i, j, s = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), row["block"])), pa.array(i), pa.array(q_ids[i]), pa.array(c_ids[j], mask=c_ids[j] == NO_ID), pa.array(s)], ["block", "i", "query_id", "vec_id", "score"])

    found = pairs(state).mapInArrow(select, "block long, i long, query_id long, vec_id long, score long")
    # At most k rows of each pair of blocks reach a query's window.
    order = Window.partitionBy("block", "i").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
