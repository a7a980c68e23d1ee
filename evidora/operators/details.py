"""Smaller operators: guards, exact updates, cascades, job selection, details of a document and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_CAP = 1200


def one_of(rows: DataFrame, column: str, value: str | None, allowed) -> DataFrame:
    """Rows whose column is ``value``; all for no value, and none for a value that is not allowed."""
    if value is None:
        return rows
    return rows.where(F.col(column) == value) if value in allowed else rows.limit(0)


def retry_state(docs: DataFrame) -> DataFrame:
    """Why a failed document cannot be retried or deleted; null where it can."""
    failed = F.coalesce(F.col("status") == "error", F.lit(False))
    return docs.select("document_id", F.when(~failed, "not failed").when(F.col("storage_path").isNull(), "no original").when(F.coalesce(F.trim("title"), F.lit("")) == "", "no name").alias("retry"), F.when(~failed, "not failed").alias("delete"))


def supersede_errors(asked: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """For each (document_id, old_id) what forbids the supersede: the same document, an unknown one, or one that another supersedes."""
    known = docs.select(F.col("document_id").alias("old_id"), F.lit(True).alias("known"))
    taken = links.groupBy("old_id").agg(F.min("document_id").alias("low"), F.max("document_id").alias("high"))
    other = F.coalesce((F.col("low") != F.col("document_id")) | (F.col("high") != F.col("document_id")), F.lit(False))
    error = F.when(F.col("old_id") == F.col("document_id"), "itself").when(F.col("known").isNull(), "unknown").when(other, "already superseded")
    return asked.join(known, "old_id", "left").join(taken, "old_id", "left").select("document_id", "old_id", error.alias("error"))


def updated_from(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with a column and the version changed where ``changes`` (key, value) has the key."""
    return rows.join(changes, key, "left").withColumns({column: F.coalesce("value", column), "current_version": F.col("current_version") + F.when(F.col("value").isNotNull(), 1).otherwise(0)}).drop("value")


def cascade(parents: DataFrame, gone: DataFrame, key: str, *children: DataFrame) -> list[DataFrame]:
    """What is left of parents and their children when the rows of ``gone`` (key) are deleted."""
    return [t.join(gone, key, "left_anti") for t in (parents, *children)]


def finish(jobs: DataFrame, results: DataFrame, now: str, backoff: Column) -> DataFrame:
    """Workers' results (job_id, seen_attempts, seen_lease, outcome) written only where the job is still as they saw it.

    A job that is no longer processing, or has other attempts or another lease, is another worker's by now.  ``done`` and
    ``error`` finish it; ``retry`` queues it again after a wait.
    """
    held = (F.col("status") == "processing") & (F.col("attempts") == F.col("seen_attempts")) & F.col("lease_expires_at").eqNullSafe(F.col("seen_lease"))
    mine = F.coalesce(held, F.lit(False)) & F.col("outcome").isNotNull()
    at = F.to_timestamp_ntz(F.lit(now))
    retry = mine & (F.col("outcome") == "retry")
    return jobs.join(results, "job_id", "left").select("job_id", F.when(retry, "queued").when(mine, F.col("outcome")).otherwise(F.col("status")).alias("status"),
                                                       F.when(retry, at + F.make_interval(secs=backoff)).otherwise(F.col("queued_at")).alias("queued_at"), F.when(~mine, F.col("lease_expires_at")).alias("lease_expires_at"), mine.alias("written"))


def select_jobs(groups: list[DataFrame], limit: int) -> DataFrame:
    """Jobs (job_id, status) of several groups, each once, without finished ones, in order of group and id."""
    out = None
    for i, g in enumerate(groups):
        part = g.where(~F.col("status").isin("done", "canceled")).select("job_id", F.lit(i).alias("place"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("job_id").agg(F.min("place").alias("place")).orderBy("place", "job_id").limit(limit)


def document_detail(docs: DataFrame, chunks: DataFrame, events: DataFrame, cap: int = CHUNK_CAP) -> DataFrame:
    """Each document with its first chunks, whether some were left out, its newest event and its text put together from the chunks.

    Chunks are cut off by their index, which counts from 0, before they are gathered.
    """
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    first = chunks.where(F.col("chunk_index") < cap).groupBy("document_id").agg(parts.alias("parts"))
    newest = events.groupBy("document_id").agg(F.count("*").alias("events"), F.max_by("action", "event_id").alias("last_action"))
    texts = F.filter(F.transform("parts", lambda p: F.trim(p["content"])), lambda t: t != "")
    return (docs.join(first, "document_id", "left").join(newest, "document_id", "left")
            .select("document_id", "title", F.coalesce(F.size("parts"), F.lit(0)).alias("fetched"), (F.coalesce("chunk_count", F.lit(0)) > F.coalesce(F.size("parts"), F.lit(0))).alias("truncated"), F.coalesce("events", F.lit(0)).alias("events"), "last_action",
                    F.when(F.col("md_path").isNotNull(), "artifact").otherwise("reconstructed").alias("source"), F.array_join(texts, "\n\n").alias("markdown")))


def grounding_rows(candidates: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence rows with what grounds them; without a document and a file name there is nothing."""
    joined = candidates.join(docs.select("document_id", "title"), "document_id", "left").join(chunks, "document_id", "left")
    path = F.when(F.col("folder").isNotNull() & F.col("source_file").isNotNull(), F.concat("folder", F.lit("/"), "source_file"))
    return joined.where(F.col("title").isNotNull() | F.col("source_file").isNotNull()).select("candidate_id", F.coalesce("title", "source_file").alias("title"), "source_file", path.alias("path"))


def retrieval_report(results: DataFrame) -> DataFrame:
    """One row for each kind of failure of (question, mode, rank, pinned, degraded): what was missed, and how often.

    A pinned question fails where its document is not among the first five, and has a scoping defect where the scoped search
    misses within ten what the unscoped one found; others are still to be pinned.
    """
    wide = results.groupBy("question").agg(*(F.max(F.when(F.col("mode") == m, F.col("rank"))).alias(m) for m in ("cross", "scoped")), F.max("pinned").alias("pinned"), F.max(F.when(F.col("mode") == "cross", F.col("degraded"))).alias("degraded"))
    hit = lambda c, k: F.coalesce((F.col(c) > 0) & (F.col(c) <= k), F.lit(False))
    kinds = F.array(F.when(F.col("pinned") & ~hit("cross", 5), F.lit("missed")), F.when(F.col("pinned") & F.col("scoped").isNotNull() & hit("cross", 10) & ~hit("scoped", 10), F.lit("scoping")), F.when(~F.col("pinned"), F.lit("unpinned")), F.when(F.col("degraded"), F.lit("degraded")))
    return wide.select("question", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("failure")).groupBy("failure").agg(F.count("*").alias("n"), F.min("question").alias("first"))


def smart_summary(rows: DataFrame) -> DataFrame:
    """One row: how many searches passed, had their document first or among three, and the mean time."""
    hit = lambda k: F.count_if((F.col("rank") > 0) & (F.col("rank") <= k))
    return rows.agg(F.count("*").alias("total"), F.count_if("pass").alias("pass"), hit(1).alias("doc_at_1"), hit(3).alias("doc_at_3"), F.round(F.avg("ms"), 4).alias("avg_ms"))


def total_against_candidate(totals: DataFrame, candidates: DataFrame) -> DataFrame:
    """The difference between a fact's total and the candidate for it, by project."""
    delta = F.abs(F.col("total") - F.col("value"))
    share = F.try_divide(delta, F.col("value"))
    return totals.join(candidates, "project_id").where((F.col("total") != 0) & (F.col("value") != 0)).select("project_id", F.round(delta, 2).alias("delta"), F.round(share, 6).alias("share"), F.when(share > 0.3, "high").otherwise("medium").alias("severity"))


def top_of_each(parts: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """The first rows (id, key) of several lists by key and id, each with its own limit."""
    out = None
    for name, rows, k in parts:
        part = rows.select(F.lit(name).alias("list"), "id", "key").orderBy("key", "id").limit(k)
        out = part if out is None else out.unionByName(part)
    return out


def identifiers_first(rows: DataFrame, by: str) -> DataFrame:
    """``place`` of each row of a query: rows that match an identifier first, otherwise as they were."""
    return rows.withColumn("final", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("exact"), "place")))
