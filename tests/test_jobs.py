"""Claims of many workers played one by one, and the ledger as a stream."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evidora.operators import jobs
from evidora.streaming import leases, windows

NOW = datetime(2024, 1, 20, 12)
SCHEMA = "job_id long, status string, attempts int, max_attempts int, queued_at timestamp_ntz, lease_expires_at timestamp_ntz"


def ledger(rng, n):
    return [(i, rng.choice(("queued", "queued", "processing", "done", "error")), rng.randrange(5), 3, NOW + timedelta(minutes=rng.randrange(-300, 60)), rng.choice((None, NOW - timedelta(minutes=5), NOW + timedelta(minutes=5)))) for i in range(n)]


def played(rows, workers):
    """Slots ask one after another for the oldest due job."""
    state = {}
    for i, status, attempts, most, queued, lease in rows:
        expired = status == "processing" and lease is not None and lease < NOW
        status = ("error" if attempts >= most else "queued") if expired else "error" if status == "queued" and attempts >= most else status
        state[i] = [status, attempts, lease if status == "processing" else None, None, queued]
    for slot in range(1, 10):
        for worker, slots, seconds in sorted(workers):
            if slot <= slots:
                due = sorted((s[4], i) for i, s in state.items() if s[0] == "queued" and s[4] <= NOW)
                if due:
                    s = state[due[0][1]]
                    s[:4] = ["processing", s[1] + 1, NOW + timedelta(seconds=max(1200 if seconds is None else seconds, 60)), worker]
    return {i: tuple(s[:4]) for i, s in state.items()}


def test_claims_of_many_are_those_of_workers_asking_in_turn(spark):
    rng = random.Random(3)
    for n, workers in ((200, [(w, rng.randrange(4), rng.choice((None, 30, 900))) for w in range(12)]), (10, [(1, 9, None), (2, 9, 30)]), (0, [(1, 2, None)]), (50, [(1, 0, None)])):
        rows = ledger(rng, n)
        table = spark.createDataFrame(rows, SCHEMA)
        claims = jobs.claim_many(table, spark.createDataFrame(workers, "worker_id long, slots int, lease_seconds int"), str(NOW))
        got = {r.job_id: (r.status, r.attempts, r.lease_expires_at, r.worker_id) for r in jobs.after_claims(table, claims, str(NOW)).collect()}
        assert got == played(rows, workers)
        taken = [r.job_id for r in claims.collect()]
        assert len(taken) == len(set(taken))


def test_one_claim_is_that_of_one_slot(spark):
    table = spark.createDataFrame(ledger(random.Random(5), 100), SCHEMA)
    one = jobs.after_claims(table, jobs.claim_many(table, spark.createDataFrame([(1, 1, None)], "worker_id long, slots int, lease_seconds int"), str(NOW)), str(NOW)).drop("worker_id")
    assert sorted(map(str, one.collect())) == sorted(map(str, jobs.claim(table, str(NOW)).collect()))


def test_a_stream_of_changes_ends_in_the_table_s_ledger(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(20), NOW + timedelta(seconds=rng.randrange(3000)), rng.choice(("queued", "processing", "done"))) for _ in range(400)]
    for i in range(4):
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], "job_id long, ts timestamp, status string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema("job_id long, ts timestamp, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream = windows.ledger(source, "2 hours").writeStream.format("memory").queryName("newest_jobs").outputMode("complete").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    whole = windows.ledger(spark.createDataFrame(rows, "job_id long, ts timestamp, status string"))
    want = {i: max((t, s) for j, t, s in rows if j == i) for i in {r[0] for r in rows}}
    for found in (spark.table("newest_jobs"), whole):
        assert {r.job_id: (r.ts, r.status) for r in found.collect()} == want
    assert whole.where(F.col("status").isNull()).count() == 0


CHANGES = "job_id long, seq long, ts timestamp, status string, attempts int, max_attempts int, lease_expires_at timestamp"


def run_out(rows, now):
    """Each job's changes read in order."""
    out = set()
    for job in {r[0] for r in rows} - {None}:
        own = sorted((r for r in rows if r[0] == job and r[2] is not None), key=lambda r: r[2:0:-1])
        for i, (_, seq, _, status, attempts, most, until) in enumerate(own):
            if status == "processing" and until is not None and until <= now and (i + 1 == len(own) or own[i + 1][2] > until):
                out.add((job, seq, until, "error" if attempts is not None and attempts >= most else "queued"))
    return out


def test_timers_of_a_stream_expire_the_leases_of_the_table(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for seq in range(600):
        at = NOW + timedelta(seconds=seq * 20 + rng.randrange(600))
        lease = rng.choice((None, at + timedelta(seconds=rng.randrange(1, 900), microseconds=rng.randrange(3) * 333_333)))
        rows.append((rng.choice((0, 0, 0, *range(1, 25))), seq, at, rng.choice(("processing", "processing", "done", None)), rng.choice((None, 1, 3, 4)), 3, lease))
    rows += [(5, 700, rows[9][2], "processing", 1, 3, rows[9][2]), (None, 701, NOW, "processing", 1, 3, NOW), (6, 702, None, "processing", 1, 3, NOW)]
    last = NOW + timedelta(days=2)
    parts = [rows[-3:] + rows[:100], rows[100:200], rows[200:420], rows[420:-3], [(99, 800, last, "done", 1, 3, None)], [(99, 801, last + timedelta(seconds=1), "done", 1, 3, None)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    stream = leases.expiry_stream(source, "15 minutes").writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination(240)
    want = run_out([r for part in parts for r in part], last)
    assert len(want) > 50
    for found in (spark.table("expired"), leases.expiries(spark.createDataFrame([r for part in parts for r in part], CHANGES), str(last))):
        got = [(r.job_id, r.seq, r.expired_at, r.status) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
