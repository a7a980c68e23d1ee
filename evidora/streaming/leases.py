"""Leases that run out, from the changes of a ledger: as a table and as a stream with a timer for each lease.

A change has job_id, seq, ts, status, attempts, max_attempts and lease_expires_at.  A lease is a change to ``processing``
with an end; it has run out if the job's next change (by ts, then seq) comes after its end or not at all.  Changes without
job_id or ts are left out; without attempts or max_attempts an attempt is left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

CHANGE = ["job_id", "seq", "ts", "status", "attempts", "max_attempts", "lease_expires_at"]
_KNOWN = "job_id is not null and ts is not null"


def expiries(changes: DataFrame, now: str) -> DataFrame:
    """job_id, seq, expired_at and new status (queued, or error without an attempt left) of each lease that has run out by ``now``."""
    following = F.lead("ts").over(Window.partitionBy("job_id").orderBy("ts", "seq"))
    leases = changes.select(*CHANGE).where(_KNOWN).withColumn("following", following).where((F.col("status") == "processing") & (F.col("lease_expires_at") <= F.lit(now).cast(changes.schema["lease_expires_at"].dataType)))
    return leases.where(F.col("following").isNull() | (F.col("following") > F.col("lease_expires_at"))).select("job_id", "seq", F.col("lease_expires_at").alias("expired_at"), _after().alias("status"))


def _after():
    return F.when(F.col("attempts") >= F.col("max_attempts"), "error").otherwise("queued")


def expiry_stream(changes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """As :func:`expiries`, of a stream: each expiry comes once, when the watermark passes the lease's end.

    Changes may come in any order within ``delay``; by the time that a timer rings all changes up to the lease's end are
    in.  A job's state holds its open leases and the times of the changes after the first of them, and goes with the
    last open lease.
    """
    long = lambda c: F.unix_micros(F.col(c).cast("timestamp"))  # noqa: E731  exact, and free of time zones in Python
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    lease = F.when(F.col("status") == "processing", long("lease_expires_at"))
    rows = timed.where(_KNOWN).select(F.col("job_id").cast("long").alias("job_id"), "ts", F.col("seq").cast("long").alias("seq"), long("ts").alias("at"), F.coalesce(lease, F.lit(-1)).alias("until"), _after().alias("then"))

    def run(key, frames, state):
        seqs, times, untils, thens = (list(x) for x in state.get) if state.exists else ([], [], [], [])
        if not state.hasTimedOut:
            for f in frames:
                seqs += f["seq"].tolist()
                times += f["at"].tolist()
                untils += f["until"].tolist()
                thens += f["then"].tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        held = sorted(zip(times, seqs, untils, thens, strict=True))
        after = [*(x[0] for x in held[1:]), None]
        due = [x[2] >= 0 and x[2] < mark for x in held]
        gone = [(key[0], seq, until, then) for (_, seq, until, then), late, d in zip(held, after, due, strict=True) if d and (late is None or late > until)]
        held = [(at, seq, -1 if d else until, then) for (at, seq, until, then), d in zip(held, due, strict=True)]
        first = next((i for i, x in enumerate(held) if x[2] >= 0), len(held))
        # A lease that comes later may stand between changes that are here, so what the watermark has not passed stays.
        held = [x for i, x in enumerate(held) if i >= first or x[0] >= mark]
        if held:
            state.update(tuple(list(c) for c in (*zip(*((x[1], x[0], x[2], x[3]) for x in held), strict=True),)))
            state.setTimeoutTimestamp(max(min([x[2] for x in held if x[2] >= 0] or [held[-1][0]]), mark) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"job_id": pd.Series([x[0] for x in gone], dtype="int64"), "seq": pd.Series([x[1] for x in gone], dtype="int64"), "expired": pd.Series([x[2] for x in gone], dtype="int64"), "status": pd.Series([x[3] for x in gone], dtype="object")})

    held = "seqs array<long>, times array<long>, untils array<long>, thens array<string>"
    found = rows.groupBy("job_id").applyInPandasWithState(run, "job_id long, seq long, expired long, status string", held, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("job_id", "seq", F.timestamp_micros("expired").alias("expired_at"), "status")
