"""The ingest job ledger as a function of its state: leases, retries and claims as of a given time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def claim(jobs: DataFrame, now: str, lease_seconds: int | None = None) -> DataFrame:
    """The ledger after one claim: expired leases are requeued or failed, exhausted jobs fail, the oldest due job is taken."""
    at = F.to_timestamp_ntz(F.lit(now))
    expired = (F.col("status") == "processing") & (F.col("lease_expires_at") < at)
    spent = F.col("attempts") >= F.col("max_attempts")
    swept = jobs.withColumn("status", F.when(expired & spent, "error").when(expired, "queued").when((F.col("status") == "queued") & spent, "error").otherwise(F.col("status")))
    due = swept.where((F.col("status") == "queued") & (F.col("queued_at") <= at)).orderBy("queued_at", "job_id").limit(1).select(F.col("job_id").alias("taken"))
    mine = F.col("taken").isNotNull()
    until = at + F.make_interval(secs=F.lit(max(1200 if lease_seconds is None else lease_seconds, 60)))
    return (swept.join(F.broadcast(due), F.col("job_id") == F.col("taken"), "left")
            .select("job_id", F.when(mine, "processing").otherwise(F.col("status")).alias("status"), (F.col("attempts") + F.when(mine, 1).otherwise(0)).alias("attempts"),
                    F.when(mine, until).otherwise(F.when(F.col("status") == "processing", F.col("lease_expires_at"))).alias("lease_expires_at")))


def swept(jobs: DataFrame, now: str) -> DataFrame:
    """The ledger with expired leases requeued or, like queued jobs without an attempt left, failed."""
    expired = (F.col("status") == "processing") & (F.col("lease_expires_at") < F.to_timestamp_ntz(F.lit(now)))
    spent = F.col("attempts") >= F.col("max_attempts")
    state = F.when(expired & spent, "error").when(expired, "queued").when((F.col("status") == "queued") & spent, "error").otherwise(F.col("status"))
    return jobs.withColumn("status", state).withColumn("lease_expires_at", F.when(F.col("status") == "processing", F.col("lease_expires_at")))


def claim_many(jobs: DataFrame, workers: DataFrame, now: str) -> DataFrame:
    """job_id, worker_id, attempts and lease_expires_at: the oldest due jobs, dealt to the free slots of many workers at once.

    ``workers`` has worker_id, slots and lease_seconds (null: 1200, at least 60).  The first free slot of every worker is
    filled before any second one, in the order of their ids.  As many jobs as there are slots are taken by a heap in each
    partition, so the ledger is never sorted; only the slots, which workers bound, are numbered in one place.  No job is
    dealt twice, and none while it is another's.
    """
    at = F.to_timestamp_ntz(F.lit(now))
    slots = workers.where("slots > 0").select("worker_id", F.explode(F.sequence(F.lit(1), F.col("slots"))).alias("slot"), F.greatest(F.coalesce("lease_seconds", F.lit(1200)), F.lit(60)).alias("lease"))
    free = slots.agg(F.count("*")).first()[0]
    due = swept(jobs, now).where((F.col("status") == "queued") & (F.col("queued_at") <= at)).orderBy("queued_at", "job_id").limit(free)
    numbered = slots.withColumn("place", F.row_number().over(Window.orderBy("slot", "worker_id")))
    taken = due.select("job_id", "attempts", F.row_number().over(Window.orderBy("queued_at", "job_id")).alias("place"))
    return taken.join(numbered, "place").select("job_id", "worker_id", (F.col("attempts") + 1).alias("attempts"), (at + F.make_interval(secs=F.col("lease"))).alias("lease_expires_at"))


def after_claims(jobs: DataFrame, claims: DataFrame, now: str) -> DataFrame:
    """The ledger after the claims of :func:`claim_many`: job_id, status, attempts, lease_expires_at and worker_id."""
    given = claims.select("job_id", "worker_id", F.col("attempts").alias("now_attempts"), F.col("lease_expires_at").alias("until"))
    mine = F.col("worker_id").isNotNull()
    return swept(jobs, now).join(given, "job_id", "left").select("job_id", F.when(mine, "processing").otherwise(F.col("status")).alias("status"), F.coalesce("now_attempts", "attempts").alias("attempts"), F.coalesce("until", "lease_expires_at").alias("lease_expires_at"), "worker_id")


def stranded(jobs: DataFrame, now: str, minutes: int = 30) -> DataFrame:
    """Jobs that have been in work for longer than the limit."""
    return jobs.where((F.col("status") == "processing") & (F.col("queued_at") < F.to_timestamp_ntz(F.lit(now)) - F.make_interval(mins=F.lit(minutes))))


def backoff_seconds(attempts) -> "F.Column":
    return F.least(F.lit(900), F.greatest(F.lit(30), attempts * attempts * 30))
