"""Evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora.operators import evidence as e
from evidora.plans.governance import DOCS
from evidora.plans.registry import query
from evidora.sources.views import CANDIDATES_SQL, CHUNKS_SQL, DOCUMENTS_SQL, METRICS_SQL, as_sql, candidates, chunks, documents, metrics, table

CANDS, WITH_METRICS, WITH_DOCS = as_sql(CANDIDATES_SQL), as_sql(CANDIDATES_SQL, METRICS_SQL), as_sql(CANDIDATES_SQL, DOCUMENTS_SQL)
PAIRS = """p AS (SELECT a.metric_id, a.candidate_id AS a_id, b.candidate_id AS b_id, round(abs(a.value - b.value), 2) AS delta_abs, round(abs(a.value - b.value) / greatest(abs(a.value), abs(b.value)), 6) AS delta_pct,
a.authority_score AS authority_a, b.authority_score AS authority_b FROM metric_candidate a JOIN metric_candidate b ON a.metric_id = b.metric_id AND a.candidate_id < b.candidate_id AND (a.period_label IS NOT DISTINCT FROM b.period_label OR a.period_date = b.period_date)
WHERE a.status <> 'rejected' AND b.status <> 'rejected' AND a.value <> 0 AND b.value <> 0),
x AS (SELECT *, CASE WHEN delta_pct > 0.2 THEN 'critical' WHEN delta_pct > 0.1 THEN 'high' WHEN delta_pct > 0.05 THEN 'medium' ELSE 'low' END AS severity FROM p WHERE delta_pct > CASE WHEN authority_a >= 80 THEN 0.01 ELSE 0.05 END)"""


@query(f"{CANDS}, {PAIRS} SELECT * FROM x")
def contradiction_pairs(spark, d):
    return e.contradictions(candidates(spark, d))


@query(f"{WITH_METRICS}, {PAIRS} SELECT metric_id, display_name, domain, a_id, b_id, delta_abs, severity FROM x JOIN metric_definition USING (metric_id) ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, delta_abs DESC, a_id, b_id LIMIT 20")
def open_contradictions(spark, d):
    known = metrics(spark, d)
    found = e.largest_contradictions(candidates(spark, d).join(known.select("metric_id"), "metric_id", "left_semi"), 20)  # at most 20 by label and 20 by date
    return (known.join(F.broadcast(found), "metric_id").orderBy(e.severity_rank(F.col("severity")), F.desc("delta_abs"), "a_id", "b_id").limit(20)
            .select("metric_id", "display_name", "domain", "a_id", "b_id", "delta_abs", "severity"))


@query(f"{WITH_METRICS} SELECT status, domain, project_id, count(*) AS n, round(cast(sum(cast(confidence as decimal(9,4))) as double) / count(*), 4) AS avg_confidence, count(*) FILTER (confidence >= 0.8) AS confident, count(*) FILTER (confidence < 0.5) AS doubtful FROM metric_candidate JOIN metric_definition USING (metric_id) GROUP BY ALL")
def candidate_pipeline(spark, d):
    return (candidates(spark, d).join(metrics(spark, d), "metric_id").groupBy("status", "domain", "project_id")
            .agg(F.count("*").alias("n"), F.round(F.sum(F.col("confidence").cast("decimal(9,4)")).cast("double") / F.count("*"), 4).alias("avg_confidence"), F.count_if(F.col("confidence") >= 0.8).alias("confident"), F.count_if(F.col("confidence") < 0.5).alias("doubtful")))


_STATES = ("accepted", "pending_review", "rejected", "needs_info")


@query(f"{CANDS} SELECT metric_id, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in _STATES) + ", count(*) AS total FROM metric_candidate GROUP BY metric_id")
def candidate_status_pivot(spark, d):
    return candidates(spark, d).groupBy("metric_id").agg(*(F.count_if(F.col("status") == x).alias(x) for x in _STATES), F.count("*").alias("total"))


@query(f"{WITH_METRICS} SELECT candidate_id, metric_id, c.confidence, domain FROM metric_candidate c JOIN metric_definition USING (metric_id) WHERE ((status = 'pending_review' AND is_latest) OR pack_id = 7) AND domain IN ('BUILDING', 'MACHINERY') AND project_id <> 'P3'")
def candidate_list(spark, d):
    """Candidates that wait, or all of one pack, of some domains and projects."""
    dims = metrics(spark, d).where(F.col("domain").isin("BUILDING", "MACHINERY") & (F.col("project_id") != "P3")).select("metric_id", "domain")
    return candidates(spark, d).where("(status = 'pending_review' and is_latest) or pack_id = 7").select("candidate_id", "metric_id", "confidence").join(dims, "metric_id")


@query(f"{CANDS} SELECT metric_id, count(DISTINCT document_id) AS documents, count(*) AS links, count(*) FILTER (status = 'accepted') AS accepted, round(cast(sum(cast(confidence as decimal(9,4))) as double) / count(*), 4) AS avg_confidence, round(cast(sum(authority_score) as double) / count(authority_score), 4) AS avg_authority FROM metric_candidate GROUP BY metric_id")
def evidence_coverage(spark, d):
    return candidates(spark, d).groupBy("metric_id").agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("links"), F.count_if(F.col("status") == "accepted").alias("accepted"),
                                                         F.round(F.sum(F.col("confidence").cast("decimal(9,4)")).cast("double") / F.count("*"), 4).alias("avg_confidence"), F.round(F.sum("authority_score").cast("double") / F.count("authority_score"), 4).alias("avg_authority"))


@query(f"{as_sql(CANDIDATES_SQL, DOCUMENTS_SQL, CHUNKS_SQL)} SELECT candidate_id, c.document_id, chunk_id, title, coalesce(d.authority_score, c.authority_score) AS authority_score, sha256(content) AS digest FROM metric_candidate c JOIN rag_chunks k ON k.document_id = c.document_id AND k.chunk_index = candidate_id % 3 JOIN rag_documents d ON d.document_id = c.document_id WHERE c.status = 'accepted'")
def fact_evidence(spark, d):
    """Each accepted candidate's chunk, which is one of its document's first three, and the document; the chunk's whole text as a digest."""
    c = candidates(spark, d).where("status = 'accepted'").select("candidate_id", "document_id", (F.col("candidate_id") % 3).cast("int").alias("chunk_index"), F.col("authority_score").alias("own"))
    return (c.join(chunks(spark, d).select("document_id", "chunk_index", "chunk_id", F.sha2("content", 256).alias("digest")), ["document_id", "chunk_index"])
            .join(documents(spark, d).select("document_id", "title", "authority_score"), "document_id").select("candidate_id", "document_id", "chunk_id", "title", F.coalesce("authority_score", "own").alias("authority_score"), "digest"))


@query(f"{WITH_DOCS}, o AS (SELECT document_id, 99 AS named FROM rag_documents WHERE document_id % 3 = 0) SELECT metric_id, candidate_id, title, coalesce(named, d.authority_score, c.authority_score) AS authority_score, c.confidence FROM metric_candidate c JOIN rag_documents d USING (document_id) LEFT JOIN o USING (document_id) WHERE c.metric_id = 'M7' ORDER BY 4 DESC NULLS LAST, c.confidence DESC, candidate_id")
def metric_candidates(spark, d):
    """One metric's candidates with their document and the authority that a list names for it, the document's own, or the candidate's."""
    c = candidates(spark, d).where("metric_id = 'M7'").withColumnRenamed("authority_score", "own")
    docs = documents(spark, d)
    named = docs.where("document_id % 3 = 0").select("document_id", F.lit(99).alias("named"))
    return (c.join(docs.select("document_id", "title", "authority_score"), "document_id").join(named, "document_id", "left")
            .select("metric_id", "candidate_id", "title", F.coalesce("named", "authority_score", "own").alias("authority_score"), "confidence").orderBy(F.desc_nulls_last("authority_score"), F.desc("confidence"), "candidate_id"))


@query(f"{WITH_METRICS} SELECT metric_id, domain FROM metric_definition WHERE metric_id NOT IN (SELECT metric_id FROM metric_candidate WHERE status = 'accepted')")
def missing_metrics(spark, d):
    return e.missing_metrics(metrics(spark, d), candidates(spark, d)).select("metric_id", "domain")


# Rules of the metrics, and the quote of each candidate: the first 200 characters of its document.
_RULES = {"negative_terms": "case when {k} % 5 = 0 then ['Stand', 'heaton'] when {k} % 5 = 1 then [] end", "positive_terms": "case when {k} % 4 = 0 then ['Nation', 'thereal'] when {k} % 4 = 1 then ['zzz'] else [] end",
          "forbidden_doc_types": "case when {k} % 3 = 0 then ['legal', 'unknown'] else ['tax'] end", "temporal_shape": "case when {k} % 9 = 0 then 'rolling_13w_forecast' else 'point' end", "period_required": "{k} % 2 = 0", "period_inference_allowed": "{k} % 4 <> 2",
          "auto_accept_enabled": "{k} % 3 <> 1", "auto_accept_min_confidence": "case when {k} % 6 = 0 then 0.8 end", "auto_accept_requires_period": "{k} % 5 = 2"}
_TEXTS = "case when document_id % 6 = 1 then concat(text, ' Week ending') else text end"


@query(f"""{as_sql(CANDIDATES_SQL, DOCUMENTS_SQL)}, m AS (SELECT concat('M', cast(c_custkey AS varchar)) AS metric_id, {', '.join(f"{e.format(k='c_custkey')} AS {n}" for n, e in _RULES.items())} FROM customer WHERE c_custkey < 380),
d AS (SELECT document_id, doc_type, lower({_TEXTS}) AS text, lower(substr(text, 1, 200)) AS quote FROM rag_documents),
g AS (SELECT candidate_id, confidence, c.authority_score, period_date, m.*, doc_type, coalesce(text, '') AS text, coalesce(quote, '') AS quote FROM metric_candidate c LEFT JOIN m USING (metric_id) LEFT JOIN d USING (document_id)),
i AS (SELECT *, len(list_filter(coalesce(negative_terms, []), lambda t: contains(quote, lower(t)))) > 0 AS n, coalesce(temporal_shape = 'rolling_13w_forecast', false) AND NOT regexp_matches(text, '13 week|13-week|13week|weekly forecast|week ending|13 semanas') AS t,
 coalesce(period_required AND NOT period_inference_allowed, false) AND period_date IS NULL AS p, list_contains(coalesce(forbidden_doc_types, []), coalesce(doc_type, 'unknown')) AS f,
 len(coalesce(positive_terms, [])) > 0 AND len(list_filter(positive_terms, lambda t: contains(quote, lower(t)) OR contains(text, lower(t)))) = 0 AS s FROM g)
SELECT candidate_id, concat_ws(',', CASE WHEN n THEN 'NEGATIVE_TERM' END, CASE WHEN t THEN 'TEMPORAL_SHAPE_MISMATCH' END, CASE WHEN p THEN 'MISSING_PERIOD' END, CASE WHEN f THEN 'FORBIDDEN_DOC_TYPE' END, CASE WHEN s THEN 'NO_POSITIVE_TERMS' END) AS issues,
CASE WHEN n OR t OR p THEN 'validation_failed' WHEN coalesce(auto_accept_enabled, false) AND confidence >= coalesce(auto_accept_min_confidence, 0.9) AND authority_score >= 80 AND (NOT coalesce(auto_accept_requires_period, false) OR period_date IS NOT NULL) THEN 'auto_accepted' ELSE 'pending_review' END AS gate FROM i""")
def validation_gate(spark, d):
    rules = [F.expr(e.format(k="c_custkey").replace("[]", "array()").replace("[", "array(").replace("]", ")")).alias(n) for n, e in _RULES.items()]
    m = table(spark, d, "customer").where("c_custkey < 380").select(F.concat(F.lit("M"), F.col("c_custkey").cast("string")).alias("metric_id"), *rules)
    m = m.withColumns({n: F.col(n).cast("array<string>") for n in ("negative_terms", "positive_terms", "forbidden_doc_types")})
    docs = documents(spark, d).withColumn("quote", F.substring("text", 1, 200)).withColumn("text", F.expr(_TEXTS))
    c = candidates(spark, d).join(docs.select("document_id", F.col("quote").alias("evidence_quote")), "document_id", "left")
    return e.validation_gate(c, m, docs)


@query(f"{CANDS} SELECT candidate_id, CASE WHEN confidence < 0.3 THEN 'urgent' WHEN confidence < 0.6 THEN 'high' ELSE 'normal' END AS priority FROM metric_candidate WHERE status = 'pending_review' ORDER BY CASE WHEN confidence < 0.3 THEN 0 WHEN confidence < 0.6 THEN 1 ELSE 2 END, created_at, candidate_id LIMIT 100")
def review_queue(spark, d):
    p = F.when(F.col("confidence") < 0.3, 0).when(F.col("confidence") < 0.6, 1).otherwise(2)
    return (candidates(spark, d).where("status = 'pending_review'").orderBy(p, "created_at", "candidate_id").limit(100)
            .select("candidate_id", F.when(F.col("confidence") < 0.3, "urgent").when(F.col("confidence") < 0.6, "high").otherwise("normal").alias("priority")))


_NEW = "n AS (SELECT * FROM metric_candidate WHERE status = 'accepted' AND is_latest AND candidate_id % 10 <> 3)"


_OVERRIDE = "case when candidate_id % 7 = 0 then round(value * 1.1, 2) end"


@query(f"{CANDS}, {_NEW}, r AS (SELECT *, row_number() OVER (PARTITION BY metric_id, period_label ORDER BY authority_score DESC, confidence DESC, candidate_id) AS r, count(*) OVER (PARTITION BY metric_id, period_label) AS offered FROM n), "
       "p AS (SELECT metric_id, period_label, arg_max(value, candidate_id) AS previous FROM metric_candidate WHERE candidate_id % 10 = 3 GROUP BY ALL) "
       f"SELECT r.metric_id, r.period_label, candidate_id, round(coalesce({_OVERRIDE}, value), 2) AS published_value, round(previous, 2) AS previous_value, offered, {_OVERRIDE} IS NOT NULL AS overridden FROM r LEFT JOIN p ON r.metric_id = p.metric_id AND r.period_label IS NOT DISTINCT FROM p.period_label WHERE r = 1")
def publish_facts(spark, d):
    """Candidates whose id ends in 3 are the ones already published; a reviewer overrides some values."""
    c = candidates(spark, d)
    return e.publish(c, c.where("candidate_id % 10 = 3").select("candidate_id", "metric_id", "period_label", "value"), c.select("candidate_id", F.expr(_OVERRIDE).alias("override")).where("override is not null"))


@query(f"{CANDS}, {_NEW} SELECT candidate_id, metric_id FROM n")
def publish_idempotent(spark, d):
    c = candidates(spark, d)
    return c.where("status = 'accepted' and is_latest").join(c.where("candidate_id % 10 = 3").select("candidate_id"), "candidate_id", "left_anti").select("candidate_id", "metric_id")


_PACK = ("SELECT pack_id, count(*) AS total, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'accepted' AND (coalesce(contains(note, 'provisional'), false) OR confidence < 0.75)) AS provisional, "
         "count(*) FILTER (date '2001-08-01' - created_at > 90) AS stale, count(*) FILTER (period_label IS NULL) AS no_period, cast(round(count(*) FILTER (status = 'accepted') * 100 / count(*)) AS bigint) AS completeness FROM metric_candidate GROUP BY pack_id")


@query(f"{CANDS} {_PACK}")
def pack_reconciliation(spark, d):
    return e.pack_summary(candidates(spark, d), "2001-08-01")


@query(f"{CANDS} SELECT pack_id, completeness FROM ({_PACK})")
def pack_completeness(spark, d):
    return e.pack_summary(candidates(spark, d), "2001-08-01").select("pack_id", "completeness")


@query(f"{DOCS}, h AS (SELECT document_id % 20 AS query_id, document_id, round((document_id * 53) % 97 / 97.0::double, 6) AS similarity, coalesce(doc_type IN ('board','funding'), false) AND document_id % 4 = 0 AS priority FROM rag_documents), "
       "a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id) AS r FROM h) WHERE r <= 24), b AS (SELECT *, count(*) FILTER (priority) OVER (PARTITION BY query_id) AS n FROM a), "
       "c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id) AS place FROM b WHERE priority OR n < 3) SELECT query_id, document_id, place FROM c WHERE place <= 8")
def prefilter_relax(spark, d):
    hits = documents(spark, d).select((F.col("document_id") % 20).alias("query_id"), "document_id", F.round((F.col("document_id") * 53) % 97 / 97.0, 6).alias("similarity"),
                                      (F.coalesce(F.col("doc_type").isin("board", "funding"), F.lit(False)) & (F.col("document_id") % 4 == 0)).alias("priority"))
    return e.prefilter(hits)


@query(f"{WITH_METRICS}, {PAIRS}, k AS (SELECT pack_id, count(*) AS contradictions FROM x JOIN metric_candidate c ON c.candidate_id = a_id GROUP BY pack_id), u AS (SELECT pack_id, count(*) FILTER (status = 'accepted' AND candidate_id % 10 = 3) AS publications, count(DISTINCT metric_id) FILTER (status = 'accepted') AS metrics FROM metric_candidate GROUP BY pack_id) "
       "SELECT pack_id, coalesce(contradictions, 0) AS contradictions, publications, (SELECT count(*) FROM metric_definition) - metrics AS missing FROM u LEFT JOIN k USING (pack_id)")
def pack_open_items(spark, d):
    """What a pack still has open: contradictions of its candidates, what is published, and metrics without an accepted value."""
    c = candidates(spark, d)
    pack = c.select(F.col("candidate_id").alias("a_id"), "pack_id")
    found = e.contradiction_counts(c).join(pack, "a_id").groupBy("pack_id").agg(F.sum("n").alias("contradictions"))
    done = F.col("status") == "accepted"
    known = c.groupBy("pack_id").agg(F.count_if(done & (F.col("candidate_id") % 10 == 3)).alias("publications"), F.countDistinct(F.when(done, F.col("metric_id"))).alias("metrics"))
    total = metrics(spark, d).agg(F.count("*").alias("all"))
    return known.join(found, "pack_id", "left").join(F.broadcast(total)).select("pack_id", F.coalesce("contradictions", F.lit(0)).alias("contradictions"), "publications", (F.col("all") - F.col("metrics")).alias("missing"))
