"""Job ledger, evaluation and streaming queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidora.operators import evaluation as v
from evidora.operators import jobs as j
from evidora.operators.governance import retrievable
from evidora.plans.governance import DOCS, RETRIEVABLE
from evidora.plans.registry import query
from evidora.sources.views import JOBS_SQL, as_sql, documents, jobs, table
from evidora.streaming import leases, windows

JOBS = as_sql(JOBS_SQL)
NOW = "2024-01-20 12:00:00"


@query(f"""{JOBS}, s AS (SELECT *, CASE WHEN status = 'processing' AND lease_expires_at < timestamp '{NOW}' THEN CASE WHEN attempts >= max_attempts THEN 'error' ELSE 'queued' END WHEN status = 'queued' AND attempts >= max_attempts THEN 'error' ELSE status END AS st FROM ingest_job),
t AS (SELECT job_id AS taken FROM s WHERE st = 'queued' AND queued_at <= timestamp '{NOW}' ORDER BY queued_at, job_id LIMIT 1)
SELECT job_id, CASE WHEN job_id = (SELECT taken FROM t) THEN 'processing' ELSE st END AS status, attempts + CASE WHEN job_id = (SELECT taken FROM t) THEN 1 ELSE 0 END AS attempts,
CASE WHEN job_id = (SELECT taken FROM t) THEN timestamp '{NOW}' + to_seconds(1200) WHEN st = 'processing' THEN lease_expires_at END AS lease_expires_at FROM s""")
def job_claim_transition(spark, d):
    return j.claim(jobs(spark, d), NOW)


_WORKERS = "SELECT s_suppkey AS worker_id, cast(s_suppkey % 4 AS integer) AS slots, CASE WHEN s_suppkey % 3 = 0 THEN 30 WHEN s_suppkey % 3 = 1 THEN 600 END AS lease_seconds FROM supplier"


@query(f"""{JOBS}, s AS (SELECT *, CASE WHEN status = 'processing' AND lease_expires_at < timestamp '{NOW}' THEN CASE WHEN attempts >= max_attempts THEN 'error' ELSE 'queued' END WHEN status = 'queued' AND attempts >= max_attempts THEN 'error' ELSE status END AS st FROM ingest_job),
w AS (SELECT worker_id, unnest(range(1, slots + 1)) AS slot, greatest(coalesce(lease_seconds, 1200), 60) AS lease FROM ({_WORKERS})), n AS (SELECT *, row_number() OVER (ORDER BY slot, worker_id) AS place FROM w),
t AS (SELECT *, row_number() OVER (ORDER BY queued_at, job_id) AS place FROM s WHERE st = 'queued' AND queued_at <= timestamp '{NOW}'), c AS (SELECT * FROM t JOIN n USING (place))
SELECT s.job_id, CASE WHEN worker_id IS NOT NULL THEN 'processing' ELSE s.st END AS status, s.attempts + CASE WHEN worker_id IS NOT NULL THEN 1 ELSE 0 END AS attempts,
CASE WHEN worker_id IS NOT NULL THEN timestamp '{NOW}' + to_seconds(lease) WHEN s.st = 'processing' THEN s.lease_expires_at END AS lease_expires_at, worker_id FROM s LEFT JOIN c ON c.job_id = s.job_id""")
def job_claims_of_many(spark, d):
    """The ledger after all workers with free slots have claimed at once."""
    workers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("worker_id"), (F.col("s_suppkey") % 4).cast("int").alias("slots"), F.when(F.col("s_suppkey") % 3 == 0, 30).when(F.col("s_suppkey") % 3 == 1, 600).alias("lease_seconds"))
    ledger = jobs(spark, d)
    return j.after_claims(ledger, j.claim_many(ledger, workers, NOW), NOW)


@query("SELECT user_id, arg_max(event_type, ts) AS status, max(ts) AS ts FROM (SELECT user_id, ts, max(event_type) AS event_type FROM events GROUP BY user_id, ts) GROUP BY user_id")
def newest_status(spark, d):
    """The newest state of each key of a log of changes, of changes at the same time the last by name; the same for a stream."""
    return windows.ledger(table(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_type").alias("status"))).withColumnRenamed("job_id", "user_id")


_CHANGES = "user_id AS job_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'processing' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'done' ELSE 'queued' END AS status, cast(event_id % 5 AS int) AS attempts, cast(3 AS int) AS max_attempts"


@query(f"""WITH c AS (SELECT {_CHANGES}, ts + to_seconds(3600 + 600 * (event_id % 400)) AS lease_expires_at FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), l AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, seq) AS following FROM c)
SELECT job_id, seq, lease_expires_at AS expired_at, CASE WHEN attempts >= max_attempts THEN 'error' ELSE 'queued' END AS status FROM l WHERE status = 'processing' AND lease_expires_at <= timestamp '{NOW}' AND (following IS NULL OR following > lease_expires_at)""")
def lease_expiries(spark, d):
    """Each user's events as the changes of a job: leases that ran out before the next change; the same for a stream."""
    changes = table(spark, d, "events").selectExpr(*_CHANGES.split(", "), "ts + make_interval(0, 0, 0, 0, 0, 0, 3600 + 600 * (event_id % 400)) AS lease_expires_at")
    return leases.expiries(changes, NOW)


@query(f"{JOBS} SELECT job_id, queued_at FROM ingest_job WHERE status = 'processing' AND queued_at < timestamp '{NOW}' - INTERVAL 30 MINUTE")
def stranded_docs(spark, d):
    return j.stranded(jobs(spark, d), NOW).select("job_id", "queued_at")


_STATES = ("queued", "processing", "done", "error", "canceled")


@query(f"{JOBS} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in _STATES) + " FROM ingest_job")
def job_status_summary(spark, d):
    return jobs(spark, d).agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == x).alias(x) for x in _STATES))


@query(f"{JOBS} SELECT attempts, least(900, greatest(30, attempts * attempts * 30)) AS wait, count(*) AS n FROM ingest_job WHERE status = 'error' GROUP BY 1, 2")
def job_backoff(spark, d):
    return jobs(spark, d).where("status = 'error'").groupBy("attempts", j.backoff_seconds(F.col("attempts")).alias("wait")).agg(F.count("*").alias("n"))


RESULTS = (f"{DOCS}, res AS (SELECT * FROM (SELECT document_id % 20 AS query_id, document_id, document_id % 7 = document_id % 20 % 7 AS relevant, row_number() OVER (PARTITION BY document_id % 20 ORDER BY (document_id * 53) % 97 DESC, document_id) AS place FROM rag_documents WHERE {RETRIEVABLE}) WHERE place <= 10)")


def _results(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "document_id")
    rows = documents(spark, d).where(retrievable()).select("document_id", (F.col("document_id") % 20).alias("query_id"), ((F.col("document_id") * 53) % 97).alias("s"))
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 10").withColumn("relevant", F.col("document_id") % 7 == F.col("query_id") % 7)


_FIRST = "f AS (SELECT query_id, coalesce(min(place) FILTER (relevant), 0) AS first, count(*) FILTER (relevant AND place <= 5) AS good FROM res GROUP BY query_id)"


@query(f"{RESULTS}, {_FIRST} SELECT count(*) AS queries, " + ", ".join(f"round(count(*) FILTER (first > 0 AND first <= {k}) / count(*), 6) AS recall_{k}" for k in (1, 3, 5, 10)) + ", round(avg(CASE WHEN first > 0 THEN 1.0::double / first ELSE 0 END), 6) AS mrr, round(avg(good / 5), 6) AS precision_5 FROM f")
def recall_mrr(spark, d):
    return v.retrieval_scores(_results(spark, d))


@query(f"{RESULTS}, {_FIRST} SELECT query_id, round(CASE WHEN first BETWEEN 1 AND 5 THEN 1 / log2(first + 1) ELSE 0 END, 6) AS ndcg_5, spearman FROM f JOIN (SELECT query_id, round(1 - 6 * sum((place - other) ** 2) / nullif(count(*) * (count(*) * count(*) - 1), 0), 6) AS spearman "
       "FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id) AS other FROM res) GROUP BY query_id) USING (query_id)")
def rank_quality_metrics(spark, d):
    r = _results(spark, d)
    both = r.withColumn("other", F.row_number().over(Window.partitionBy("query_id").orderBy("document_id")))
    return (v.first_relevant(r).select("query_id", F.round(v.ndcg(F.col("first"), 5), 6).alias("ndcg_5"))
            .join(v.spearman(both, "query_id", "place", "other").drop("n"), "query_id"))


@query(f"{DOCS}, a AS (SELECT conv_id, turn, conv_id * 7 % 1000 AS document_id, role = 'assistant' AND turn % 4 = 1 AS discloses FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, review_status IS NOT DISTINCT FROM 'rejected' OR lifecycle IS NOT DISTINCT FROM 'superseded' AS cites_excluded, "
       "coalesce(review_status <> 'approved', true) AND NOT discloses AS undisclosed FROM a JOIN rag_documents USING (document_id)")
def citation_governance_gate(spark, d):
    """Answers must not cite excluded documents, and must say when a cited one is unreviewed."""
    answers = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", (F.col("conv_id") * 7 % 1000).alias("document_id"), (F.col("turn") % 4 == 1).alias("discloses"))
    excluded = F.col("review_status").eqNullSafe(F.lit("rejected")) | F.col("lifecycle").eqNullSafe(F.lit("superseded"))
    return (answers.join(documents(spark, d).select("document_id", "review_status", "lifecycle"), "document_id")
            .select("conv_id", "turn", excluded.alias("cites_excluded"), (F.coalesce(F.col("review_status") != "approved", F.lit(True)) & ~F.col("discloses")).alias("undisclosed")))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, cast(sum(cast(value as decimal(18,2))) as double) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Counts in six-hour windows; the same function serves streams (an extra, with a watermark there)."""
    return windows.tumbling(table(spark, d, "events"), "6 hours")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s")
def event_sessions(spark, d):
    """Sessions that four hours of silence end."""
    return windows.sessions(table(spark, d, "events"), "4 hours").select("user_id", "start", "n")


@query(f"{RESULTS}, t AS (SELECT query_id, place, (document_id * 7) % 50 AS ms FROM res) SELECT query_id, round(avg(ms), 6) AS mean, min(ms) AS low, max(ms) AS high, list_sort(list(ms))[count(*) // 2 + 1] AS upper_median, bool_or(ms > 45) AS failed FROM t GROUP BY query_id")
def experiment_stats(spark, d):
    """Mean, least, greatest and upper median of each query's ten results, and whether one took too long."""
    t = _results(spark, d).withColumn("ms", (F.col("document_id") * 7) % 50)
    at = (F.floor(F.count("*") / 2) + 1).cast("int")
    return t.groupBy("query_id").agg(F.round(F.avg("ms"), 6).alias("mean"), F.min("ms").alias("low"), F.max("ms").alias("high"), F.element_at(F.array_sort(F.collect_list("ms")), at).alias("upper_median"), F.bool_or(F.col("ms") > 45).alias("failed"))
