"""The engine's tables, derived from the driver's: governed documents, chunks, metric candidates, facts and jobs.

Derived columns are written once, as expressions that Spark and standard SQL read
alike; :func:`as_sql` gives the same view for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_CHARS = 2000

DOCUMENT = {
    "document_id": "doc_id",
    "title": "concat(case doc_id % 12 when 0 then 'Board minutes' when 1 then 'Loan agreement signed' when 2 then 'Capex report' when 3 then 'Cash flow forecast' when 4 then 'Audited annual accounts' "
             "when 5 then 'Due diligence memo' when 6 then 'Legal opinion' when 7 then 'Site photo annex' when 8 then 'Tax return' when 9 then 'Business plan v2' when 10 then 'Newsletter' else 'Working note' end, "
             "' ', lang, ' ', cast(doc_id % 40 as string), case when doc_id % 9 = 0 then ' (copy)' when doc_id % 10 = 0 then ' v3 draft' else '' end)",
    "project_id": "case when doc_id % 13 = 5 then null else concat('P', cast(doc_id % 6 as string)) end",
    "doc_type": "case doc_id % 9 when 0 then 'board' when 1 then 'funding' when 2 then 'capex' when 3 then 'cash_flow' when 4 then 'legal' when 5 then 'general' when 6 then null when 7 then 'other' else 'monthly_reporting' end",
    "period": "case when doc_id % 4 = 0 then null else concat('Q', cast(1 + doc_id % 4 as string), ' ', cast(2020 + doc_id % 5 as string)) end",
    "status": "case when n_chars < 120 then 'error' when doc_id % 17 = 0 then 'retired' else 'indexed' end",
    "review_status": "case when quality is null then 'needs_review' when toxic = 1 then 'rejected' when quality = 1 then 'approved' when doc_id % 31 = 0 then null else 'pending' end",
    "classification_source": "case when doc_id % 25 = 4 then 'agent_rejected' when doc_id % 5 = 0 then 'user' when doc_id % 5 = 1 then 'agent' when doc_id % 5 = 2 then 'rule' when doc_id % 5 = 3 then null else 'admin' end",
    "lifecycle": "case doc_id % 7 when 0 then 'superseded' when 1 then 'executed' when 2 then 'draft' when 3 then null when 4 then 'working_paper' when 5 then 'signed' else 'filed' end",
    "authority_score": "case when doc_id % 11 = 0 then null else cast(coalesce(quality, 0) * 60 + (doc_id * 37) % 41 as int) end",
    "confidence": "cast((doc_id * 29) % 101 as double) / 100",
    "source_channel": "source",
    "chunk_count": "cast(case when n_chars < 20 then 0 else ceil(n_chars / 2000.0) end as int)",
    "created_at": "date '2024-01-01' + cast(doc_id % 365 as int)",
    "current_version": "cast(1 + doc_id % 3 as int)",
    "storage_path": "case when doc_id % 4 = 1 then null else concat('uploads/', cast(doc_id as string)) end",
    "md_path": "case when doc_id % 3 = 0 then null else concat('md/', cast(doc_id as string)) end",
    "reingest_attempts": "cast(doc_id % 6 as int)",
    "text": "text",
}
CHUNK = {
    "chunk_project": "case when chunk_id % 7 = 0 then 'P9' when chunk_id % 3 = 0 then null else concat('P', cast(document_id % 6 as string)) end",
    "chunk_doc_type": "case when chunk_id % 5 = 0 then 'tax' when chunk_id % 4 = 0 then null else 'other' end",
    "chunk_period": "case when chunk_id % 6 = 0 then 'FY2023' else null end",
    "chunk_authority": "case when chunk_id % 8 = 0 then null else cast((chunk_id * 7) % 120 as int) end",
}
CANDIDATE = {
    "candidate_id": "o_orderkey",
    "metric_id": "concat('M', cast(o_custkey % 400 as string))",
    "document_id": "o_orderkey % 500",
    "period_label": "case when o_orderkey % 13 = 0 then null else concat(cast(year(o_orderdate) as string), 'Q', cast(quarter(o_orderdate) as string)) end",
    "period_date": "case when o_orderkey % 3 = 0 then null else cast(o_orderdate as date) end",
    "value": "case when o_orderkey % 97 = 0 then 0.0 else o_totalprice end",
    "authority_score": "cast((o_custkey * 13) % 101 as int)",
    "confidence": "cast(o_orderkey % 101 as double) / 100",
    "status": "case o_orderstatus when 'F' then 'accepted' when 'O' then 'pending_review' else case when o_orderkey % 2 = 0 then 'rejected' else 'needs_info' end end",
    "is_latest": "o_orderkey % 4 <> 0",
    "pack_id": "o_orderkey % 60",
    "note": "case when o_orderkey % 19 = 0 then 'provisional figure' else null end",
    "created_at": "cast(o_orderdate as date)",
}
METRIC = {
    "metric_id": "concat('M', cast(c_custkey as string))",
    "display_name": "concat('Metric ', cast(c_custkey as string))",
    "domain": "c_mktsegment",
    "project_id": "concat('P', cast(c_nationkey % 6 as string))",
    "min_authority": "cast(c_custkey % 60 as int)",
}
JOB = {
    "job_id": "event_id",
    "status": "case event_type when 'view' then 'queued' when 'signup' then 'processing' when 'error' then 'error' when 'click' then 'done' else 'queued' end",
    "attempts": "cast(event_id % 5 as int)",
    "max_attempts": "cast(3 as int)",
    "queued_at": "ts",
    "lease_seconds": "cast(case when event_id % 4 = 0 then null else (event_id % 40) * 60 end as int)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(spec: dict[str, str]):
    return [F.expr(e).alias(n) for n, e in spec.items()]


def _sql(spec: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in spec.items()).replace("as string)", "as varchar)")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their governance columns; unlabelled ones need review."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(*_columns(DOCUMENT))


DOCUMENTS_SQL = f"""rag_documents AS (SELECT {_sql(DOCUMENT)} FROM documents LEFT JOIN
 (SELECT doc_id AS label_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON doc_id = label_id)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-length chunks of every document with metadata that diverges from the parent's on some rows."""
    n = F.greatest(F.ceil(F.length("text") / F.lit(float(CHUNK_CHARS))), F.lit(1))
    parts = (table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("chunk_index"))
             .select("document_id", "chunk_index", (F.col("document_id") * 1000000 + F.col("chunk_index")).alias("chunk_id"),
                     F.col("text").substr(F.col("chunk_index") * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)).alias("content")))
    return parts.select("document_id", "chunk_index", "chunk_id", "content", *_columns(CHUNK))


CHUNKS_SQL = f"""rag_chunks AS (SELECT document_id, chunk_index, chunk_id, content, {_sql(CHUNK)} FROM (
 SELECT doc_id AS document_id, i AS chunk_index, doc_id * 1000000 + i AS chunk_id, substr(text, i * {CHUNK_CHARS} + 1, {CHUNK_CHARS}) AS content
 FROM (SELECT doc_id, text, unnest(range(cast(greatest(ceil(length(text) / {CHUNK_CHARS}.0), 1) AS bigint))) AS i FROM documents)))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*_columns(CANDIDATE))


CANDIDATES_SQL = f"metric_candidate AS (SELECT {_sql(CANDIDATE)} FROM orders)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(*_columns(METRIC))


METRICS_SQL = f"metric_definition AS (SELECT {_sql(METRIC)} FROM customer)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*_columns(JOB)).withColumn("lease_expires_at", F.expr("case when status = 'processing' then queued_at + make_interval(0, 0, 0, 0, 0, 0, coalesce(lease_seconds, 1200)) end"))


JOBS_SQL = f"ingest_job AS (SELECT *, CASE WHEN status = 'processing' THEN queued_at + to_seconds(coalesce(lease_seconds, 1200)) END AS lease_expires_at FROM (SELECT {_sql(JOB)} FROM events))"


def as_sql(*views: str) -> str:
    """A WITH clause that defines views for the oracle."""
    return "WITH " + ",\n".join(views)
