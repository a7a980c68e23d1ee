"""Governance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora.operators import governance as g
from evidora.plans.registry import ORACLE as QUERIES_SQL
from evidora.plans.registry import query
from evidora.sources.views import CHUNKS_SQL, DOCUMENTS_SQL, as_sql, chunks, documents, table

DOCS, BOTH = as_sql(DOCUMENTS_SQL), as_sql(DOCUMENTS_SQL, CHUNKS_SQL)
RETRIEVABLE = "(review_status <> 'rejected' AND classification_source IS DISTINCT FROM 'agent_rejected' AND status = 'indexed' AND lifecycle IS DISTINCT FROM 'superseded')"
TIER = ("CASE WHEN review_status IS NOT DISTINCT FROM 'rejected' OR authority_score IS NULL THEN 'unverified' WHEN authority_score >= 90 AND review_status = 'approved' AND "
        "classification_source IN ('user','admin','import') THEN 'source_of_record' WHEN authority_score >= 75 AND review_status = 'approved' THEN 'supporting' ELSE 'context' END")
TIER_OF_SCORE = ("CASE WHEN authority_score >= 95 THEN 'audited' WHEN authority_score >= 90 THEN 'executed' WHEN authority_score >= 80 THEN 'controller' WHEN authority_score >= 70 THEN 'board_pack' "
                 "WHEN authority_score >= 60 THEN 'dd_memo' WHEN authority_score >= 40 THEN 'internal' WHEN authority_score >= 10 THEN 'narrative' ELSE 'unverified' END")


@query(f"{DOCS} SELECT document_id, project_id, doc_type, review_status, authority_score FROM rag_documents WHERE {RETRIEVABLE}")
def governed_docs(spark, d):
    return documents(spark, d).where(g.retrievable()).select("document_id", "project_id", "doc_type", "review_status", "authority_score")


@query(f"{BOTH} SELECT chunk_id, document_id, coalesce(project_id, chunk_project) AS project_id, coalesce(doc_type, chunk_doc_type) AS doc_type, coalesce(period, chunk_period) AS period, "
       f"{', '.join(g.GOVERNED)} FROM rag_chunks JOIN rag_documents USING (document_id)")
def parent_first_overlay(spark, d):
    return g.overlay(chunks(spark, d), documents(spark, d))


@query(f"{DOCS} SELECT document_id, {TIER} AS tier FROM rag_documents")
def verification_tier(spark, d):
    return documents(spark, d).select("document_id", g.verification_tier().alias("tier"))


@query(f"{DOCS}, t AS (SELECT document_id, CASE {TIER} WHEN 'source_of_record' THEN 3 WHEN 'supporting' THEN 2 WHEN 'context' THEN 1 ELSE 0 END AS trust FROM rag_documents) "
       "SELECT 'standard' AS mode, document_id FROM t UNION ALL SELECT 'trusted_only', document_id FROM t WHERE trust >= 2 UNION ALL SELECT 'official_only', document_id FROM t WHERE trust >= 3")
def grounding_modes(spark, d):
    docs = documents(spark, d)
    out = None
    for mode in ("standard", "trusted_only", "official_only"):
        part = g.grounded(docs, mode).select(F.lit(mode).alias("mode"), "document_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{DOCS} SELECT document_id, title, review_status, authority_score FROM rag_documents WHERE status IN ('indexed','retired') AND review_status = 'approved' AND authority_score >= 50 AND md_path IS NOT NULL "
       "AND title ILIKE '%report%' ORDER BY created_at DESC, document_id LIMIT 50")
def document_list(spark, d):
    return (documents(spark, d).where(F.col("status").isin("indexed", "retired") & (F.col("review_status") == "approved") & (F.col("authority_score") >= 50) & F.col("md_path").isNotNull() & F.col("title").ilike("%report%"))
            .orderBy(F.desc("created_at"), "document_id").limit(50).select("document_id", "title", "review_status", "authority_score"))


@query(f"{DOCS} SELECT document_id, reingest_attempts FROM rag_documents WHERE status = 'error' AND storage_path IS NOT NULL AND review_status IS DISTINCT FROM 'rejected' AND reingest_attempts < 5 "
       "ORDER BY reingest_attempts, created_at, document_id LIMIT 10")
def recoverable_docs(spark, d):
    return (documents(spark, d).where((F.col("status") == "error") & F.col("storage_path").isNotNull() & ~F.col("review_status").eqNullSafe(F.lit("rejected")) & (F.col("reingest_attempts") < 5))
            .orderBy("reingest_attempts", "created_at", "document_id").limit(10).select("document_id", "reingest_attempts"))


@query(f"{DOCS} SELECT document_id, title FROM rag_documents WHERE regexp_matches(title, '(?i)(annex|photo|memo)') AND NOT regexp_matches(title, '(?i)(draft|copy)')")
def title_rule_select(spark, d):
    return documents(spark, d).where(F.col("title").rlike("(?i)(annex|photo|memo)") & ~F.col("title").rlike("(?i)(draft|copy)")).select("document_id", "title")


_TYPES = " ".join(f"WHEN regexp_matches(title, '{p}') THEN '{v}'" for p, v in g.TITLE_TYPES)


@query(f"{DOCS} SELECT document_id, CASE WHEN doc_type IS NULL OR doc_type IN ('general','unknown','') THEN CASE {_TYPES} ELSE 'unknown' END ELSE doc_type END AS new_type FROM rag_documents")
def title_classify(spark, d):
    return g.title_types(documents(spark, d)).select("document_id", "new_type")


_APPROVE = "((tier IN ('audited','executed','controller') OR (confidence >= 0.5 AND tier <> 'unverified')) AND typed)"
_TRIAGE = f"{DOCS}, t AS (SELECT *, {TIER_OF_SCORE} AS tier, doc_type IS NOT NULL AND doc_type NOT IN ('other','general') AS typed FROM rag_documents) "


@query(_TRIAGE + f"SELECT document_id, tier AS authority_tier, CASE WHEN {_APPROVE} THEN 'approved' ELSE 'needs_review' END AS conservative, CASE WHEN {_APPROVE} OR (typed AND confidence >= "
       "CASE WHEN lifecycle IN ('executed','signed','filed','audited') THEN 0.6 ELSE 0.75 END) THEN 'approved' ELSE 'needs_review' END AS aggressive FROM t")
def triage_decision(spark, d):
    docs = documents(spark, d).withColumn("authority_tier", g.tier_of_score(F.col("authority_score")))
    return g.triage(g.triage(docs).withColumnRenamed("decision", "conservative"), aggressive=True).select("document_id", "authority_tier", "conservative", F.col("decision").alias("aggressive"))


@query(f"{DOCS} SELECT document_id, CASE WHEN NOT risky AND confidence >= 0.7 THEN 'approve' WHEN risky AND confidence >= 0.8 THEN 'downgrade' ELSE 'keep' END AS outcome FROM "
       "(SELECT *, coalesce(doc_type IN ('funding','board','legal'), false) AS risky FROM rag_documents WHERE review_status = 'needs_review')")
def backlog_finalize(spark, d):
    return g.finalise_backlog(documents(spark, d)).select("document_id", "outcome")


DOC_TYPES = ("board", "funding", "capex", "cash_flow", "legal", "general", "other", "monthly_reporting", "tax")
LIFECYCLES = ("superseded", "executed", "draft", "working_paper", "signed", "filed", "audited")
_ACTIONS = {
    "action": "case document_id % 7 when 0 then 'approve' when 1 then 'reject' when 2 then 'endorse' when 3 then 'supersede' when 4 then 'restore' when 5 then 'retire' else 'reclassify' end",
    "old_id": "case when document_id % 7 = 3 then case when document_id % 4 = 0 then document_id when document_id % 4 = 1 then -1 else document_id - 1 end end",
    "new_doc_type": "case document_id % 5 when 0 then 'tax' when 1 then 'nonsense' end", "new_period": "case when document_id % 4 = 0 then 'FY2024' end", "new_lifecycle": "case document_id % 6 when 0 then 'signed' when 1 then 'lost' end",
    "new_tier": "case when document_id % 11 = 0 then 'controller' when document_id % 11 = 1 then 'regal' end", "new_score": "cast(case when document_id % 3 = 0 then document_id % 100 end as int)",
}
_SCORED = " ".join(f"WHEN '{t}' THEN {n}" for t, n in g.SCORE_OF_TIER.items())
_NEW_TIER = TIER_OF_SCORE.replace("authority_score", "new_score")


@query(f"""{DOCS}, a AS (SELECT *, {TIER_OF_SCORE} AS authority_tier, {', '.join(f"{e} AS {n}" for n, e in _ACTIONS.items())} FROM rag_documents), o AS (SELECT document_id AS o_id, current_version AS old_version FROM rag_documents),
e AS (SELECT *, CASE WHEN action IN ('approve','endorse') AND classification_source IS NOT DISTINCT FROM 'agent_rejected' THEN 'rejected by the agent' WHEN action = 'endorse' AND coalesce(authority_score, 0) < 90 THEN 'authority below 90'
 WHEN action = 'endorse' AND (status = 'retired' OR review_status IS NOT DISTINCT FROM 'rejected') THEN 'not live' WHEN action = 'reject' AND review_status IS NOT DISTINCT FROM 'rejected' THEN 'already rejected'
 WHEN action = 'reclassify' AND coalesce(new_doc_type, new_period, new_lifecycle, new_tier, cast(new_score AS varchar)) IS NULL THEN 'nothing to set' WHEN action = 'reclassify' AND new_doc_type NOT IN {DOC_TYPES} THEN 'unknown type'
 WHEN action = 'reclassify' AND new_lifecycle NOT IN {LIFECYCLES} THEN 'unknown lifecycle' WHEN action = 'reclassify' AND new_tier NOT IN {tuple(g.SCORE_OF_TIER)} THEN 'unknown tier' WHEN action = 'retire' AND status = 'retired' THEN 'already retired'
 WHEN action = 'restore' AND status <> 'retired' THEN 'not retired' WHEN action = 'restore' AND lifecycle IS NOT DISTINCT FROM 'superseded' THEN 'superseded' WHEN action = 'supersede' AND old_id IS NULL THEN 'replaces nothing'
 WHEN action = 'supersede' AND old_id = document_id THEN 'replaces itself' WHEN action = 'supersede' AND old_version IS NULL THEN 'replaces nothing known' WHEN action = 'supersede' AND (status <> 'indexed' OR review_status IS NOT DISTINCT FROM 'rejected') THEN 'not live' END AS error
 FROM a LEFT JOIN o ON old_id = o_id), x AS (SELECT *, error IS NULL AS ok, error IS NULL AND action = 'reclassify' AS re FROM e)
SELECT document_id, action, error, CASE WHEN ok AND action IN ('approve','endorse') THEN 'approved' WHEN ok AND action = 'reject' THEN 'rejected' ELSE review_status END AS review_status,
CASE WHEN ok AND action IN ('approve','endorse') AND NOT coalesce(classification_source IN {g.HUMAN_VALIDATED}, false) THEN 'agent_reviewed' WHEN re THEN 'agent_corrected' ELSE classification_source END AS classification_source,
CASE WHEN ok AND action = 'retire' THEN 'retired' WHEN ok AND action = 'restore' THEN 'indexed' ELSE status END AS status, CASE WHEN re THEN coalesce(new_lifecycle, lifecycle) ELSE lifecycle END AS lifecycle,
CASE WHEN re THEN coalesce(new_doc_type, doc_type) ELSE doc_type END AS doc_type, CASE WHEN re THEN coalesce(new_period, period) ELSE period END AS period,
CASE WHEN re AND new_tier IS NOT NULL THEN new_tier WHEN re AND new_score IS NOT NULL THEN {_NEW_TIER} ELSE authority_tier END AS authority_tier,
CASE WHEN re AND new_score IS NOT NULL THEN new_score WHEN re AND new_tier IS NOT NULL THEN CASE new_tier {_SCORED} END ELSE authority_score END AS authority_score, CASE WHEN ok AND action = 'supersede' THEN old_id END AS supersedes_document_id,
CASE WHEN ok AND action = 'supersede' THEN greatest(current_version, old_version) + 1 WHEN ok THEN current_version + 1 ELSE current_version END AS current_version,
CASE WHEN NOT ok THEN 0 WHEN re THEN 1 + CASE WHEN new_doc_type IS NULL THEN 0 ELSE 1 END + CASE WHEN new_period IS NULL THEN 0 ELSE 1 END + CASE WHEN new_lifecycle IS NULL THEN 0 ELSE 1 END
 + CASE WHEN new_tier IS NOT NULL THEN 2 WHEN new_score IS NOT NULL THEN 1 + CASE WHEN {_NEW_TIER} IS DISTINCT FROM authority_tier THEN 1 ELSE 0 END ELSE 0 END WHEN action = 'supersede' THEN 3 ELSE 1 END AS events FROM x""")
def governance_transitions(spark, d):
    docs = documents(spark, d).withColumn("authority_tier", g.tier_of_score(F.col("authority_score")))
    return g.transition(docs, docs.select("document_id", *(F.expr(e).alias(n) for n, e in _ACTIONS.items())), DOC_TYPES, LIFECYCLES)


_SUPERSEDED_SQL = QUERIES_SQL["governance_transitions"]


@query(f"WITH t AS ({_SUPERSEDED_SQL}), {DOCS[5:]} SELECT document_id, superseded_by, status AS old_status, lifecycle AS old_lifecycle FROM rag_documents JOIN (SELECT supersedes_document_id AS document_id, min(document_id) AS superseded_by FROM t WHERE supersedes_document_id IS NOT NULL GROUP BY ALL) USING (document_id)")
def superseded_documents(spark, d):
    """The related changes of accepted supersedes."""
    return g.superseded(governance_transitions(spark, d), documents(spark, d)).select("document_id", "superseded_by", "old_status", "old_lifecycle")


_CHANGE = ("event_id as seq", "event_id % 300 as document_id", "cast(case when event_id % 5 < 2 then 1 + event_id % 4 end as int) as expected_version", "case event_type when 'view' then 'approved' when 'click' then 'rejected' end as review_status",
           "case when user_id % 3 = 0 then 'tax' end as doc_type", "user_id % 7 = 1 as clears_type")


@query(f"""{DOCS}, c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS n FROM (SELECT {', '.join(_CHANGE)} FROM events WHERE event_id < 900)),
r AS (WITH RECURSIVE f AS (SELECT document_id, 0::bigint AS n, current_version AS version, review_status, doc_type, 0 AS applied FROM rag_documents WHERE document_id IN (SELECT document_id FROM c)
 UNION ALL SELECT f.document_id, c.n, CASE WHEN ok THEN version + 1 ELSE version END, CASE WHEN ok THEN coalesce(c.review_status, f.review_status) ELSE f.review_status END,
 CASE WHEN NOT ok THEN f.doc_type WHEN clears_type THEN NULL ELSE coalesce(c.doc_type, f.doc_type) END, applied + CASE WHEN ok THEN 1 ELSE 0 END
 FROM f JOIN c ON c.document_id = f.document_id AND c.n = f.n + 1, LATERAL (SELECT expected_version IS NULL OR expected_version = version AS ok) k) SELECT * FROM f)
SELECT document_id, arg_max(version, n) AS version, arg_max(struct_pack(v := review_status), n).v AS review_status, arg_max(struct_pack(v := doc_type), n).v AS doc_type, arg_max(applied, n) AS applied, cast(max(n) - arg_max(applied, n) AS integer) AS refused FROM r GROUP BY document_id""")
def apply_governance(spark, d):
    """Three changes a document, some of which expect a version that they do not find."""
    return g.apply_changes(documents(spark, d), table(spark, d, "events").where("event_id < 900").selectExpr(*_CHANGE))


_EVENT = ("SELECT event_id, event_id % 700 AS document_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'needs_review' ELSE 'approved' END AS old_value, "
          "CASE user_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'needs_review' ELSE 'rejected' END AS new_value FROM events")


@query(f"{DOCS}, ev AS ({_EVENT}), ends AS (SELECT document_id, arg_min(old_value, event_id) AS old_value, arg_max(new_value, event_id) AS new_value FROM ev GROUP BY document_id) "
       "SELECT document_id, CASE WHEN review_status IS NOT DISTINCT FROM new_value THEN old_value ELSE review_status END AS review_status, review_status IS NOT DISTINCT FROM new_value AS reverted FROM rag_documents JOIN ends USING (document_id)")
def revert_from_events(spark, d):
    e = table(spark, d, "events")
    old = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "needs_review").otherwise("approved")
    new = F.when(F.col("user_id") % 3 == 0, "approved").when(F.col("user_id") % 3 == 1, "needs_review").otherwise("rejected")
    return g.revert(documents(spark, d), e.select("event_id", (F.col("event_id") % 700).alias("document_id"), old.alias("old_value"), new.alias("new_value")))


@query(f"{DOCS} SELECT count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (review_status = 'approved') AS approved, "
       "count(*) FILTER (review_status = 'needs_review') AS needs_review, count(*) FILTER (review_status = 'rejected') AS rejected, count(*) FILTER (lifecycle IS DISTINCT FROM 'superseded' AND authority_score >= 90 AND review_status = 'approved') AS source_of_record, "
       "count(md_path) AS with_markdown, cast(coalesce(sum(chunk_count) FILTER (status = 'indexed'), 0) AS bigint) AS chunks, round(avg(authority_score), 4) AS avg_authority, round(count(md_path) / nullif(count(*), 0), 4) AS pct_markdown FROM rag_documents")
def corpus_health(spark, d):
    return g.corpus_health(documents(spark, d))


@query(f"{DOCS} SELECT coalesce(review_status, 'none') AS review_status, count(*) AS n, count(md_path) AS with_markdown, count(*) FILTER (authority_score >= 90) AS official FROM rag_documents GROUP BY 1")
def portfolio_context(spark, d):
    return (documents(spark, d).groupBy(F.coalesce("review_status", F.lit("none")).alias("review_status"))
            .agg(F.count("*").alias("n"), F.count("md_path").alias("with_markdown"), F.count_if(F.col("authority_score") >= 90).alias("official")))


def _mode_sql(c):
    return (f"(SELECT document_id, {c}, round(n / total, 4) AS {c}_share FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, {c}) AS r, sum(n) OVER (PARTITION BY document_id) AS total FROM "
            f"(SELECT document_id, {c}, count(*) AS n FROM rag_chunks WHERE {c} IS NOT NULL GROUP BY ALL)) WHERE r = 1)")


_CHUNKS = as_sql(CHUNKS_SQL)


@query(f"{_CHUNKS} SELECT * FROM {_mode_sql('chunk_project')} FULL JOIN {_mode_sql('chunk_doc_type')} USING (document_id) FULL JOIN {_mode_sql('chunk_period')} USING (document_id)")
def mode_backfill(spark, d):
    c = chunks(spark, d)
    return g.modes(c, "chunk_project").join(g.modes(c, "chunk_doc_type"), "document_id", "full").join(g.modes(c, "chunk_period"), "document_id", "full")


@query(f"{_CHUNKS} SELECT * FROM (SELECT document_id, max(chunk_authority) FILTER (chunk_authority BETWEEN 0 AND 100) AS authority_score FROM rag_chunks GROUP BY document_id) "
       f"LEFT JOIN {_mode_sql('chunk_project')} USING (document_id) LEFT JOIN {_mode_sql('chunk_doc_type')} USING (document_id)")
def lift_up_chunks(spark, d):
    return g.lift_up(chunks(spark, d))


@query(f"{BOTH} SELECT document_id, cast(sum(length(content)) AS bigint) AS n_chars FROM rag_chunks JOIN rag_documents USING (document_id) WHERE authority_score > 20 GROUP BY document_id HAVING sum(length(content)) < 200")
def near_empty_docs(spark, d):
    return (chunks(spark, d).join(documents(spark, d).where("authority_score > 20").select("document_id"), "document_id")
            .groupBy("document_id").agg(F.sum(F.length("content")).alias("n_chars")).where("n_chars < 200"))


@query(f"{DOCS}, n AS (SELECT row_number() OVER (ORDER BY authority_score DESC NULLS LAST, confidence, document_id) AS r, * FROM rag_documents WHERE {RETRIEVABLE}) "
       "SELECT document_id, r AS position, cast((SELECT count(*) FROM n) AS bigint) AS total, cast((r - 1) // 25 + 1 AS bigint) AS page FROM n WHERE r BETWEEN 26 AND 50")
def document_page(spark, d):
    """The second page of 25, with the exact count: one sort and limit, and one count."""
    docs = documents(spark, d).where(g.retrievable())
    order = [F.desc_nulls_last("authority_score"), F.col("confidence"), F.col("document_id")]
    page = docs.orderBy(*order).limit(50).select("document_id", F.row_number().over(_window(order)).alias("position")).where("position > 25")
    return page.join(F.broadcast(docs.agg(F.count("*").alias("total"))), how="inner").select("document_id", F.col("position").cast("long"), "total", F.expr("cast((position - 1) div 25 + 1 as bigint)").alias("page"))


def _window(order):
    from pyspark.sql import Window

    return Window.orderBy(*order)  # over at most 50 rows


@query(f"{DOCS}, q AS (SELECT count(*) FILTER (event_type = 'view') AS queued, count(*) FILTER (event_type = 'signup') AS processing, count(*) FILTER (event_type = 'error') AS failed FROM events) SELECT total, queued, processing, failed FROM (SELECT count(*) AS total FROM rag_documents), q")
def corpus_queue(spark, d):
    """The counts of the queue that stand beside the corpus's own."""
    kind = F.col("event_type")
    queue = table(spark, d, "events").agg(F.count_if(kind == "view").alias("queued"), F.count_if(kind == "signup").alias("processing"), F.count_if(kind == "error").alias("failed"))
    return documents(spark, d).agg(F.count("*").alias("total")).join(F.broadcast(queue))


_ORDER = "(SELECT document_id, arg_min(chunk_period, chunk_index) AS period, cast(count(DISTINCT chunk_period) AS bigint) AS n FROM rag_chunks WHERE chunk_period IS NOT NULL GROUP BY document_id)"


@query(f"{_CHUNKS} SELECT document_id, period, n FROM {_ORDER}")
def first_seen_period(spark, d):
    """Of values that are equally frequent in a document the first seen counts; with one value that is all there is."""
    return chunks(spark, d).where("chunk_period is not null").groupBy("document_id").agg(F.min_by("chunk_period", "chunk_index").alias("period"), F.countDistinct("chunk_period").alias("n"))
