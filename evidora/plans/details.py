"""Queries over labels, guards, details and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidora.functions import labels as n
from evidora.functions.columns import fold, tokens
from evidora.functions.injection import fenced
from evidora.operators import details as x
from evidora.operators import evidence, jobs
from evidora.operators.alias_graph import named
from evidora.operators import vector_index as vi
from evidora.operators.governance import HUMAN_VALIDATED, retrievable, trust, verification_tier
from evidora.operators.search import over_fetched
from evidora.plans.evidence import PAIRS, WITH_METRICS
from evidora.plans.governance import DOCS, RETRIEVABLE, TIER
from evidora.plans.operations import JOBS, NOW
from evidora.plans.registry import query
from evidora.plans.search import _ENTITIES_SQL, _FOLD, _MANY, _NAMES, _TOKENS, _TRUST, COS, entities, questions, vector_index
from evidora.sources.views import CHUNKS_SQL, DOCUMENTS_SQL, as_sql, candidates, chunks, documents, metrics, table
from evidora.sources.views import jobs as ledger

BOTH = as_sql(DOCUMENTS_SQL, CHUNKS_SQL)
_RAW = "case doc_id % 6 when 0 then ' 12.5 ' when 1 then concat('abc', cast(doc_id as string)) when 2 then '  ' when 3 then 'NaN' when 4 then null else cast(n_chars as string) end"
_ODD = "concat(chr(7), ' ', substring(text, 1, 300), chr(9))"


def _sql(e: str) -> str:
    return e.replace("as string)", "as varchar)").replace("substring(", "substr(")


@query(f"SELECT doc_id, CASE WHEN isfinite(try_cast(trim(raw) AS double)) THEN try_cast(trim(raw) AS double) END AS number, nullif(trim(raw), '') AS label FROM (SELECT doc_id, {_sql(_RAW)} AS raw FROM documents)")
def metadata_coercion(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_RAW).alias("raw")).select("doc_id", n.number_value(F.col("raw")).alias("number"), n.string_value(F.col("raw")).alias("label"))


_INERT = "nullif(substr(trim(regexp_replace(regexp_replace({}, '[\\x00-\\x1f\\x7f]+', ' ', 'g'), '\\s+', ' ', 'g')), 1, 160), '')"


@query(f"SELECT doc_id, {_INERT.format(_sql(_ODD))} AS label FROM documents")
def inert_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", n.inert(F.expr(_ODD)).alias("label"))


_STATE = "CASE WHEN review_status IN ('pending','approved','rejected','needs_review') THEN review_status ELSE 'needs_review' END"


@query(f"{DOCS} SELECT document_id, concat_ws(' | ', {_INERT.format('project_id')}, {_INERT.format('doc_type')}, {_INERT.format('title')}) || CASE WHEN {_STATE} IN ('pending','needs_review') THEN '{n.UNREVIEWED}' ELSE '' END AS label, "
       f"'[Source ' || (document_id % 9 + 1) || '] ' || coalesce(project_id, '?') || ' | ' || coalesce(doc_type, '?') || coalesce(' | ' || period, '') || ' | ' || title || coalesce(' | authority ' || authority_score, '') || ' | review ' || {_STATE} || ' (' || cast(round(confidence * 100) AS integer) || '%)' AS header FROM rag_documents")
def source_labels(spark, d):
    c = F.col
    return documents(spark, d).select("document_id", n.source_label(c("project_id"), c("doc_type"), c("title"), c("review_status")).alias("label"),
                                      n.source_header(c("document_id") % 9 + 1, c("project_id"), c("doc_type"), c("period"), c("title"), c("authority_score"), c("review_status"), c("confidence")).alias("header"))


_FENCE = "substr(sha256(text), 1, 24)"


@query(f"SELECT doc_id, length(w) AS length, sha256(w) AS digest, contains(text, {_FENCE}) AS broken FROM (SELECT doc_id, text, '[quoted text ' || {_FENCE} || ' begins]' || chr(10) || text || chr(10) || '[quoted text ' || {_FENCE} || ' ends]' AS w FROM documents)")
def wrap_untrusted(spark, d):
    """Whole texts as they are quoted to a model, and whether one could end its quotation."""
    t = table(spark, d, "documents").select("doc_id", "text", fenced(F.col("text")).alias("w"))
    return t.select("doc_id", F.length("w").alias("length"), F.sha2("w", 256).alias("digest"), F.contains("text", F.substring(F.sha2("text", 256), 1, 24)).alias("broken"))


_CODES = "concat('see MPS20', cast(doc_id as string), 'X77 and AB1 or QRS99', cast(100000 + doc_id as string), ' then lower1234567 MPS20', cast(doc_id as string), 'X77 ZZ', cast(doc_id * 7919 as string), 'ABCDEF')"


@query(f"SELECT doc_id, array_to_string(list_distinct_first, ' ') AS codes FROM (SELECT doc_id, list_transform(list_sort(list_transform(list_distinct(c), lambda w: struct_pack(i := list_position(c, w), w := w)))[1:3], lambda s: s.w) AS list_distinct_first FROM (SELECT doc_id, regexp_extract_all({_sql(_CODES)}, '\\b[A-Z]{{2,}}[A-Z0-9]*[0-9][A-Z0-9]{{5,}}\\b') AS c FROM documents))")
def exact_identifiers(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(n.identifiers(F.expr(_CODES)), " ").alias("codes"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4)), lambda w: w NOT IN {n.STOP})), ' ') AS words FROM conversations WHERE role = 'user'")
def significant_tokens(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(n.significant(F.col("text")))), " ").alias("words"))


@query(f"{DOCS} SELECT document_id, array_to_string(list_sort({_TOKENS.format('title')}), ' ') AS lexemes, len({_TOKENS.format('title')}) + len({_TOKENS.format('source_channel')}) AS both FROM rag_documents")
def lexeme_lists(spark, d):
    """A title's words as one text, and the length of two texts' words one after the other."""
    words = tokens(F.col("title"))
    return documents(spark, d).select("document_id", F.array_join(F.array_sort(words), " ").alias("lexemes"), F.size(F.concat(words, tokens(F.col("source_channel")))).cast("long").alias("both"))


_MONEY = "case when o_orderkey % 3 = 0 then -o_totalprice * 1000 when o_orderkey % 3 = 1 then o_totalprice / 1000 else o_totalprice end"


@query(f"SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END || '€' || CASE WHEN abs(v) >= 1000000 THEN printf('%.1f', round(abs(v) / 1000000, 1)) || 'M' WHEN abs(v) >= 1000 THEN printf('%.0f', round(abs(v) / 1000)) || 'K' ELSE printf('%.0f', round(abs(v))) END AS label, "
       f"cast(least(100, greatest(0, o_orderkey % 130 - 10)) AS bigint) AS progress, cast(ceil(length(o_orderpriority) / 4.0) AS bigint) AS estimate FROM (SELECT *, {_MONEY} AS v FROM orders)")
def card_figures(spark, d):
    """Compact money, progress within 0 and 100, and a token estimate of a quarter of the characters."""
    return table(spark, d, "orders").select("o_orderkey", n.compact(F.expr(_MONEY)).alias("label"), F.least(F.lit(100), F.greatest(F.lit(0), F.col("o_orderkey") % 130 - 10)).cast("long").alias("progress"), F.ceil(F.length("o_orderpriority") / 4.0).alias("estimate"))


_PAGE = "case doc_id % 5 when 0 then '3' when 1 then '2.5' when 2 then '0' when 3 then 'x' else cast(doc_id as string) end"


@query(f"SELECT doc_id, CASE WHEN try_cast(p AS double) >= 1 AND try_cast(p AS double) = floor(try_cast(p AS double)) THEN cast(try_cast(p AS double) AS integer) END AS page, coalesce(trim(CASE WHEN doc_id % 4 = 1 THEN NULL WHEN doc_id % 4 = 2 THEN ' ' ELSE 'uploads/x' END) <> '', false) OR doc_id % 10 = 1 AS stored FROM (SELECT *, {_sql(_PAGE)} AS p FROM documents)")
def citation_links(spark, d):
    path = F.when(F.col("doc_id") % 4 == 1, None).when(F.col("doc_id") % 4 == 2, " ").otherwise("uploads/x")
    return table(spark, d, "documents").select("doc_id", n.page_of(F.expr(_PAGE)).alias("page"), (n.string_value(path).isNotNull() | (F.col("doc_id") % 10 == 1)).alias("stored"))


_SCORES = tuple(f"doc_id * {k} % 6" for k in (5, 7, 11))
_SAID = "case doc_id % 4 when 0 then ' PASS ' when 1 then 'weak' when 2 then 'garbled' end"


@query(f"WITH j AS (SELECT doc_id, {_SAID} AS said, {', '.join(f'{e} AS s{i}' for i, e in enumerate(_SCORES))}, doc_id % 3 <> 0 AS found, doc_id % 5 <> 0 AS behaved FROM documents), "
       "v AS (SELECT *, CASE WHEN lower(trim(said)) IN ('pass','weak','fail') THEN lower(trim(said)) WHEN (s0 + s1 + s2) / 3 >= 4 THEN 'pass' WHEN (s0 + s1 + s2) / 3 >= 3 THEN 'weak' ELSE 'fail' END AS verdict FROM j) "
       "SELECT doc_id, verdict, nullif(concat_ws(',', CASE WHEN NOT (verdict = 'pass' OR (verdict = 'weak' AND s0 >= 4 AND s1 >= 4 AND s2 >= 4 AND found AND behaved)) THEN 'verdict=' || verdict END, CASE WHEN NOT found THEN 'missing_ground_truth' END, CASE WHEN NOT behaved THEN 'behavior_incorrect' END), '') AS failure FROM v")
def judge_gate(spark, d):
    """A judge's JSON answer read into a verdict, and why the answer does not pass; a weak one passes if all its scores are high."""
    scores = F.struct(*(F.expr(e).alias(f"s{i}") for i, e in enumerate(_SCORES)), F.expr(_SAID).alias("verdict"))
    rows = table(spark, d, "documents").select("doc_id", F.to_json(scores).alias("answer"), (F.col("doc_id") % 3 != 0).alias("found"), (F.col("doc_id") % 5 != 0).alias("behaved"))
    v = rows.withColumn("a", F.from_json("answer", "s0 int, s1 int, s2 int, verdict string")).withColumn("verdict", n.verdict(F.col("a.verdict"), F.col("a.s0"), F.col("a.s1"), F.col("a.s2")))
    weak = (F.col("verdict") == "weak") & (F.col("a.s0") >= 4) & (F.col("a.s1") >= 4) & (F.col("a.s2") >= 4) & F.col("found") & F.col("behaved")
    reasons = F.concat_ws(",", F.when(~((F.col("verdict") == "pass") | weak), F.concat(F.lit("verdict="), "verdict")), F.when(~F.col("found"), "missing_ground_truth"), F.when(~F.col("behaved"), "behavior_incorrect"))
    return v.select("doc_id", "verdict", F.nullif(reasons, F.lit("")).alias("failure"))


_REASONING = ("stand", "nation", "heation", "compare")


@query("SELECT conv_id, turn, CASE WHEN " + " OR ".join(f"contains(lower(text), '{t}')" for t in _REASONING) + " THEN 'reasoning' ELSE 'fast' END AS model FROM conversations WHERE role = 'user'")
def model_routing(spark, d):
    hit = F.lit(False)
    for t in _REASONING:
        hit = hit | F.lower("text").contains(t)
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.when(hit, "reasoning").otherwise("fast").alias("model"))


@query(f"WITH {_ENTITIES_SQL} SELECT conv_id, turn, kind, string_agg(DISTINCT entity, ' ' ORDER BY entity) AS entities FROM (SELECT conv_id, turn, {_FOLD.format('text')} AS t FROM conversations WHERE role = 'user') q, al_ JOIN ent USING (entity) WHERE {_NAMES.format('t')} GROUP BY ALL")
def query_entities(spark, d):
    """The entities that each question names, by kind."""
    found = named(questions(spark, d), entities(spark), "query_id").select("query_id", F.explode("entities").alias("entity")).join(entities(spark).select("entity", "kind"), "entity")
    each = found.groupBy("query_id", "kind").agg(F.array_join(F.array_sort(F.collect_list("entity")), " ").alias("entities"))
    return each.select(F.expr("query_id div 1000").alias("conv_id"), (F.col("query_id") % 1000).alias("turn"), "kind", "entities")


_ALIASES = {"informe": "report", "capex report": "capex", "loan": "funding", "minutes": "board", "opinion": "legal"}


@query(f"{DOCS} SELECT document_id, CASE lower(split_part(title, ' ', 2)) " + " ".join(f"WHEN '{a}' THEN '{t}'" for a, t in _ALIASES.items()) + " ELSE doc_type END AS doc_type FROM rag_documents")
def type_aliases(spark, d):
    names = F.create_map(*(F.lit(v) for kv in _ALIASES.items() for v in kv))
    return documents(spark, d).select("document_id", F.coalesce(names[F.lower(F.split_part(F.col("title"), F.lit(" "), F.lit(2)))], "doc_type").alias("doc_type"))


_TIERS, _LIVES = (("audited", "audited"), ("agreement", "executed"), ("minutes", "board_pack"), ("diligence", "dd_memo"), ("newsletter", "narrative")), (("signed", "signed"), ("draft", "draft"), ("audited", "filed"))


@query(f"{DOCS} SELECT document_id, CASE " + " ".join(f"WHEN contains(lower(title), '{p}') THEN '{v}'" for p, v in _TIERS) + " ELSE 'unverified' END AS tier, CASE " + " ".join(f"WHEN contains(lower(title), '{p}') THEN '{v}'" for p, v in _LIVES) + " END AS lifecycle FROM rag_documents")
def title_governance(spark, d):
    first = lambda rules, default: F.coalesce(*(F.when(F.lower("title").contains(p), v) for p, v in rules), F.lit(default))
    return documents(spark, d).select("document_id", first(_TIERS, "unverified").alias("tier"), first(_LIVES, None).cast("string").alias("lifecycle"))


_ALLOWED = ("pending", "approved", "rejected", "needs_review")


@query(f"{DOCS} SELECT v AS value, cast((SELECT count(*) FROM rag_documents WHERE v = 'any' OR review_status = v) AS bigint) AS n FROM (VALUES ('any'), ('approved'), ('bogus'), ('needs_review')) t(v)")
def invalid_filter(spark, d):
    """A value outside the list finds nothing, rather than being no filter; no value finds all."""
    docs, out = documents(spark, d), None
    for value in (None, "approved", "bogus", "needs_review"):
        part = x.one_of(docs, "review_status", value, _ALLOWED).agg(F.count("*").alias("n")).select(F.lit(value or "any").alias("value"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{DOCS} SELECT document_id FROM rag_documents WHERE status = 'error' AND replace(title, 'Working', '50%_') ILIKE '%50\\%\\_ note%' ESCAPE '\\' AND coalesce(project_id, '') <> 'P9'")
def document_list_errors(spark, d):
    """Failed documents only, with a text that has the wildcards' own characters."""
    return documents(spark, d).where((F.col("status") == "error") & F.expr(r"replace(title, 'Working', '50%_') ilike '%50!%!_ note%' escape '!'") & (F.coalesce("project_id", F.lit("")) != "P9")).select("document_id")


@query(f"{DOCS} SELECT document_id FROM rag_documents WHERE status = 'indexed' AND authority_score >= 90 AND review_status = 'approved' AND NOT coalesce(classification_source IN {HUMAN_VALIDATED}, false) AND classification_source IS DISTINCT FROM 'agent_rejected'")
def endorsable_docs(spark, d):
    validated = F.coalesce(F.col("classification_source").isin(*HUMAN_VALIDATED), F.lit(False))
    return documents(spark, d).where((F.col("status") == "indexed") & (F.col("authority_score") >= 90) & (F.col("review_status") == "approved") & ~validated & ~F.col("classification_source").eqNullSafe(F.lit("agent_rejected"))).select("document_id")


@query(f"{DOCS} SELECT document_id, CASE WHEN status <> 'error' THEN 'not failed' WHEN storage_path IS NULL THEN 'no original' WHEN trim(title) = '' THEN 'no name' END AS retry, CASE WHEN status <> 'error' THEN 'not failed' END AS \"delete\" FROM rag_documents")
def failed_document_actions(spark, d):
    return x.retry_state(documents(spark, d))


@query(f"{DOCS} SELECT document_id FROM rag_documents WHERE review_status IS DISTINCT FROM 'rejected' AND classification_source IN ('agent', 'rule') AND document_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def backfill_queue(spark, d):
    """Documents classified by machine that the backfill has not marked yet."""
    done = table(spark, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("document_id"))
    return documents(spark, d).where(~F.col("review_status").eqNullSafe(F.lit("rejected")) & F.col("classification_source").isin("agent", "rule")).join(done, "document_id", "left_anti").select("document_id")


_LINKS = "SELECT event_id AS document_id, user_id AS old_id FROM events WHERE event_type = 'signup'"


@query(f"{DOCS}, l AS ({_LINKS}), a AS (SELECT document_id, CASE WHEN document_id % 6 = 0 THEN document_id WHEN document_id % 6 = 1 THEN -5 ELSE document_id % 150 END AS old_id FROM rag_documents) "
       "SELECT document_id, old_id, CASE WHEN old_id = document_id THEN 'itself' WHEN old_id NOT IN (SELECT document_id FROM rag_documents) THEN 'unknown' WHEN EXISTS (SELECT 1 FROM l WHERE l.old_id = a.old_id AND l.document_id <> a.document_id) THEN 'already superseded' END AS error FROM a")
def supersede_guards(spark, d):
    docs = documents(spark, d)
    i = F.col("document_id")
    asked = docs.select("document_id", F.when(i % 6 == 0, i).when(i % 6 == 1, F.lit(-5)).otherwise(i % 150).alias("old_id"))
    return x.supersede_errors(asked, docs, table(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("document_id"), F.col("user_id").alias("old_id")))


@query(f"{DOCS} SELECT document_id, CASE WHEN title ILIKE '%annex%' THEN 'other' WHEN title ILIKE '%memo%' THEN 'dd' ELSE doc_type END AS doc_type, current_version + CASE WHEN title ILIKE '%annex%' OR title ILIKE '%memo%' THEN 1 ELSE 0 END AS current_version FROM rag_documents")
def update_from_join(spark, d):
    docs = documents(spark, d)
    value = F.when(F.col("title").ilike("%annex%"), "other").when(F.col("title").ilike("%memo%"), "dd")
    return x.updated_from(docs, docs.select("document_id", value.alias("value")).where("value is not null"), "document_id", "doc_type").select("document_id", "doc_type", "current_version")


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def dim_filter_tasks(spark, d):
    """The dimension is filtered before the join."""
    dim = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("priority")).join(dim, F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("priority").agg(F.count("*").alias("n"))


@query(f"{DOCS} SELECT document_id, confidence FROM (SELECT *, CASE WHEN document_id % 7 = 0 THEN NULL ELSE confidence END AS c FROM rag_documents) WHERE review_status = 'needs_review' ORDER BY c NULLS FIRST, created_at, document_id LIMIT 50")
def review_priority(spark, d):
    unsure = F.when(F.col("document_id") % 7 != 0, F.col("confidence"))
    return documents(spark, d).where("review_status = 'needs_review'").orderBy(unsure.asc_nulls_first(), "created_at", "document_id").limit(50).select("document_id", "confidence")


@query(f"{DOCS}, h AS (SELECT document_id % 20 AS query_id, document_id, contains(title, '(copy)') AS exact, row_number() OVER (PARTITION BY document_id % 20 ORDER BY (document_id * 53) % 97 DESC, document_id) AS place FROM rag_documents) "
       "SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, place) AS final FROM h WHERE place <= 12")
def exact_first(spark, d):
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "document_id"))
    rows = documents(spark, d).select((F.col("document_id") % 20).alias("query_id"), "document_id", F.col("title").contains("(copy)").alias("exact"), ((F.col("document_id") * 53) % 97).alias("s"))
    return x.identifiers_first(rows.withColumn("place", place).where("place <= 12"), "query_id").select("query_id", "document_id", "final")


@query("SELECT * FROM (SELECT 'tasks' AS list, event_id AS id, cast(-event_id % 40 AS bigint) AS key FROM events WHERE event_type = 'error' ORDER BY key, id LIMIT 8) UNION ALL SELECT * FROM (SELECT 'decisions', o_orderkey, cast(o_custkey AS bigint) AS key FROM orders WHERE o_orderstatus = 'O' ORDER BY key, o_orderkey LIMIT 6) "
       "UNION ALL SELECT * FROM (SELECT 'actions', event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY user_id, event_id LIMIT 6)")
def dashboard_lists(spark, d):
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    return x.top_of_each([("tasks", e.where("event_type = 'error'").select(F.col("event_id").alias("id"), (-F.col("event_id") % 40).alias("key")), 8),
                          ("decisions", o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key")), 6),
                          ("actions", e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), F.col("user_id").alias("key")), 6)])


_SEEN = "job_id, cast(attempts - CASE WHEN job_id % 4 = 0 THEN 1 ELSE 0 END AS integer) AS seen_attempts, CASE WHEN job_id % 5 = 0 THEN NULL ELSE lease_expires_at END AS seen_lease, CASE job_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'error' ELSE 'retry' END AS outcome"


@query(f"""{JOBS}, r AS (SELECT {_SEEN} FROM ingest_job WHERE job_id % 7 <> 0), h AS (SELECT j.*, outcome, coalesce(status = 'processing' AND attempts = seen_attempts AND lease_expires_at IS NOT DISTINCT FROM seen_lease, false) AND outcome IS NOT NULL AS mine FROM ingest_job j LEFT JOIN r USING (job_id))
SELECT job_id, CASE WHEN mine AND outcome = 'retry' THEN 'queued' WHEN mine THEN outcome ELSE status END AS status, CASE WHEN mine AND outcome = 'retry' THEN timestamp '{NOW}' + to_seconds(least(900, greatest(30, attempts * attempts * 30))) ELSE queued_at END AS queued_at, CASE WHEN NOT mine THEN lease_expires_at END AS lease_expires_at, mine AS written FROM h""")
def job_finish_guarded(spark, d):
    rows = ledger(spark, d)
    return x.finish(rows, rows.where("job_id % 7 <> 0").selectExpr(*(e for e in _SEEN.replace("integer", "int").split(", "))), NOW, jobs.backoff_seconds(F.col("attempts")))


@query(f"{JOBS}, g AS (SELECT 0 AS place, job_id, status FROM ingest_job WHERE job_id IN (3, 4, 5, 6) UNION ALL SELECT 1, job_id, status FROM ingest_job WHERE status = 'error' AND job_id % 50 = 1 UNION ALL SELECT 2, job_id, status FROM ingest_job WHERE status = 'processing' AND lease_expires_at < timestamp '2024-01-03 00:00:00') "
       "SELECT job_id, cast(min(place) AS integer) AS place FROM g WHERE status NOT IN ('done', 'canceled') GROUP BY job_id ORDER BY 2, 1 LIMIT 25")
def job_selection(spark, d):
    j = ledger(spark, d)
    return x.select_jobs([j.where("job_id in (3, 4, 5, 6)"), j.where("status = 'error' and job_id % 50 = 1"), j.where("status = 'processing' and lease_expires_at < timestamp_ntz '2024-01-03 00:00:00'")], 25)


@query("SELECT 'documents' AS part, count(*) AS n FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 = 3) UNION ALL SELECT 'events', count(*) FROM (SELECT event_id AS doc_id FROM events) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 = 3)")
def delete_cascade(spark, d):
    """Rows left of documents and what hangs on them when some are deleted."""
    docs = table(spark, d, "documents").select("doc_id")
    left = x.cascade(docs, docs.where("doc_id % 10 = 3"), "doc_id", table(spark, d, "labels").select("doc_id"), table(spark, d, "events").select(F.col("event_id").alias("doc_id")))
    out = None
    for name, rows in zip(("documents", "labels", "events"), left, strict=True):
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionByName(part)
    return out


_EVENTS = "ev AS (SELECT event_id, event_id % 400 AS document_id, event_type AS action FROM events)"


@query(f"""{BOTH}, {_EVENTS}, p AS (SELECT document_id, count(*) AS fetched, string_agg(trim(content), chr(10) || chr(10) ORDER BY chunk_index) FILTER (trim(content) <> '') AS markdown FROM rag_chunks WHERE chunk_index < 3 GROUP BY ALL), e AS (SELECT document_id, count(*) AS events, arg_max(action, event_id) AS last_action FROM ev GROUP BY ALL)
SELECT document_id, title, cast(coalesce(fetched, 0) AS integer) AS fetched, chunk_count > coalesce(fetched, 0) AS truncated, coalesce(events, 0) AS events, last_action, CASE WHEN md_path IS NOT NULL THEN 'artifact' ELSE 'reconstructed' END AS source, sha256(coalesce(markdown, '')) AS digest FROM rag_documents LEFT JOIN p USING (document_id) LEFT JOIN e USING (document_id)""")
def document_detail(spark, d):
    """With a cap of three chunks, so that some documents are cut."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 400).alias("document_id"), F.col("event_type").alias("action"))
    return x.document_detail(documents(spark, d), chunks(spark, d), e, cap=3).withColumn("digest", F.sha2("markdown", 256)).drop("markdown")


_FOLDER = "CASE WHEN document_id % 3 = 0 THEN NULL ELSE 'F' || (document_id % 4) END AS folder, CASE WHEN document_id % 5 = 0 THEN NULL ELSE 'file' || document_id || '.pdf' END AS source_file"


@query(f"{as_sql(DOCUMENTS_SQL)}, c AS (SELECT o_orderkey AS candidate_id, o_orderkey % 700 AS document_id FROM orders), k AS (SELECT document_id, {_FOLDER} FROM (SELECT DISTINCT o_orderkey % 700 AS document_id FROM orders) WHERE document_id % 7 <> 0) "
       "SELECT candidate_id, coalesce(title, source_file) AS title, source_file, folder || '/' || source_file AS path FROM c LEFT JOIN rag_documents USING (document_id) LEFT JOIN k USING (document_id) WHERE title IS NOT NULL OR source_file IS NOT NULL")
def grounding_documents(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id"), (F.col("o_orderkey") % 700).alias("document_id"))
    i = F.col("document_id")
    k = c.select("document_id").distinct().where("document_id % 7 <> 0").select("document_id", F.when(i % 3 != 0, F.concat(F.lit("F"), i % 4)).alias("folder"), F.when(i % 5 != 0, F.concat(F.lit("file"), i, F.lit(".pdf"))).alias("source_file"))
    return x.grounding_rows(c, documents(spark, d), k)


_GOLDEN = "SELECT conv_id AS question, 'cross' AS mode, cast(conv_id * 7 % 13 AS integer) AS rank, conv_id % 4 <> 0 AS pinned, conv_id % 9 = 0 AS degraded FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT conv_id, 'scoped', cast(conv_id * 5 % 15 AS integer), conv_id % 4 <> 0, false FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 2 = 0"


@query(f"""WITH r AS ({_GOLDEN}), w AS (SELECT question, max(rank) FILTER (mode = 'cross') AS c, max(rank) FILTER (mode = 'scoped') AS s, bool_or(pinned) AS pinned, bool_or(degraded) FILTER (mode = 'cross') AS degraded FROM r GROUP BY question),
f AS (SELECT question, 'missed' AS failure FROM w WHERE pinned AND NOT c BETWEEN 1 AND 5 UNION ALL SELECT question, 'scoping' FROM w WHERE pinned AND s IS NOT NULL AND c BETWEEN 1 AND 10 AND NOT s BETWEEN 1 AND 10 UNION ALL SELECT question, 'unpinned' FROM w WHERE NOT pinned UNION ALL SELECT question, 'degraded' FROM w WHERE degraded)
SELECT failure, count(*) AS n, min(question) AS first FROM f GROUP BY failure""")
def retrieval_eval(spark, d):
    """What a retrieval evaluation lists as failures; ranks are made up."""
    q = table(spark, d, "conversations").select(F.col("conv_id").alias("question")).distinct()
    i = F.col("question")
    cross = q.select("question", F.lit("cross").alias("mode"), (i * 7 % 13).alias("rank"), (i % 4 != 0).alias("pinned"), (i % 9 == 0).alias("degraded"))
    scoped = q.where(i % 2 == 0).select("question", F.lit("scoped").alias("mode"), (i * 5 % 15).alias("rank"), (i % 4 != 0).alias("pinned"), F.lit(False).alias("degraded"))
    return x.retrieval_report(cross.unionByName(scoped))


@query("SELECT count(*) AS total, count(*) FILTER (conv_id % 3 = 1) AS pass, count(*) FILTER (conv_id * 7 % 5 = 1) AS doc_at_1, count(*) FILTER (conv_id * 7 % 5 BETWEEN 1 AND 3) AS doc_at_3, round(avg(conv_id * 11 % 97), 4) AS avg_ms FROM (SELECT DISTINCT conv_id FROM conversations)")
def smart_search_eval(spark, d):
    i = F.col("conv_id")
    return x.smart_summary(table(spark, d, "conversations").select("conv_id").distinct().select((i * 7 % 5).alias("rank"), (i % 3 == 1).alias("pass"), (i * 11 % 97).alias("ms")))


@query("WITH t AS (SELECT 'P' || l_suppkey % 6 AS project_id, cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) AS total FROM lineitem GROUP BY 1), c AS (SELECT 'P' || o_orderkey % 6 AS project_id, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS value FROM orders GROUP BY 1) "
       "SELECT project_id, round(abs(total - value), 2) AS delta, round(abs(total - value) / value, 6) AS share, CASE WHEN abs(total - value) / value > 0.3 THEN 'high' ELSE 'medium' END AS severity FROM t JOIN c USING (project_id) WHERE total <> 0 AND value <> 0")
def fact_total_contradiction(spark, d):
    money = lambda c, a: F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(a)
    t = table(spark, d, "lineitem").groupBy(F.concat(F.lit("P"), F.col("l_suppkey") % 6).alias("project_id")).agg(money("l_extendedprice", "total"))
    return x.total_against_candidate(t, table(spark, d, "orders").groupBy(F.concat(F.lit("P"), F.col("o_orderkey") % 6).alias("project_id")).agg(money("o_totalprice", "value")))


@query(f"{DOCS} SELECT document_id, CASE WHEN chunk_count = 0 THEN 'empty' ELSE 'junk name' END AS reason FROM (SELECT *, CASE WHEN document_id % 31 = 2 THEN '._' || title ELSE title END AS name FROM rag_documents) WHERE lifecycle IS DISTINCT FROM 'superseded' AND (chunk_count = 0 OR starts_with(name, '._'))")
def junk_supersede(spark, d):
    docs = documents(spark, d).withColumn("name", F.when(F.col("document_id") % 31 == 2, F.concat(F.lit("._"), "title")).otherwise(F.col("title")))
    return docs.where(~F.col("lifecycle").eqNullSafe(F.lit("superseded")) & ((F.col("chunk_count") == 0) | F.col("name").startswith("._"))).select("document_id", F.when(F.col("chunk_count") == 0, "empty").otherwise("junk name").alias("reason"))


@query("SELECT vec_id, coalesce(nullif(CASE vec_id % 10 WHEN 3 THEN 'other' WHEN 4 THEN '' END, ''), 'default') AS model, len(embedding) = 64 AS right_size FROM embeddings")
def embedding_model_backfill(spark, d):
    """The model that each vector was made with, the default where none is named, and whether it has the dimension."""
    named = F.when(F.col("vec_id") % 10 == 3, "other").when(F.col("vec_id") % 10 == 4, "")
    return table(spark, d, "embeddings").select("vec_id", F.coalesce(F.nullif(named, F.lit("")), F.lit("default")).alias("model"), (F.size("embedding") == 64).alias("right_size"))


@query(f"{DOCS}, v AS (SELECT e.vec_id AS document_id, {COS.replace('a::', 'e.embedding::').replace('b::', 'q.embedding::')} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id % 10 <> 3) "
       f"SELECT document_id, similarity FROM v JOIN rag_documents USING (document_id) WHERE similarity >= 0.18 AND {RETRIEVABLE} AND project_id = 'P2' ORDER BY similarity DESC, authority_score DESC NULLS LAST, created_at DESC, document_id LIMIT 10")
def vector_topk_filtered(spark, d):
    """One project, and only vectors of the query's own model."""
    from evidora.operators.search import vector_lane

    model = embedding_model_backfill(spark, d).where("model = 'default'").select("vec_id")
    e = table(spark, d, "embeddings").select("vec_id", "embedding").join(model, "vec_id", "left_semi")
    q = table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    return vector_lane(e, documents(spark, d).where("project_id = 'P2'"), q, k=10).select("document_id", "similarity")


@query(f"{DOCS} SELECT document_id FROM rag_documents WHERE {RETRIEVABLE} AND doc_type = 'board' AND review_status = 'approved' AND coalesce(authority_score, 0) >= 60 AND document_id IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def smart_filter(spark, d):
    """What a search lets through of the documents it found."""
    found = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("document_id"))
    return documents(spark, d).where(retrievable() & (F.col("doc_type") == "board") & (F.col("review_status") == "approved") & (F.coalesce("authority_score", F.lit(0)) >= 60)).join(found, "document_id", "left_semi").select("document_id")


@query(f"{DOCS} SELECT document_id FROM rag_documents WHERE length(text) * 1000 > 5000000 AND document_id % 3 < 2")
def large_files(spark, d):
    """Files that were too large for a job and are of a kind that can be read in parts."""
    name = F.concat("title", F.when(F.col("document_id") % 3 == 0, ".pdf").when(F.col("document_id") % 3 == 1, ".PPTX").otherwise(".csv"))
    return documents(spark, d).select("document_id", name.alias("name"), (F.length("text") * 1000).alias("size")).where((F.col("size") > 5_000_000) & F.col("name").rlike(r"(?i)\.(pdf|pptx)$")).select("document_id")


@query(f"{DOCS}, t AS (SELECT document_id, title, contains(lower(title), 'capex report') OR contains(lower(title), 'board minutes') AS by_title, document_id IN (8, 20, 44) AS by_id, document_id % 2 = 0 AS pinned FROM rag_documents) SELECT document_id, CASE WHEN pinned THEN by_id ELSE by_title END AS relevant, CASE WHEN pinned THEN 'id' WHEN by_title THEN 'title' END AS scored_by FROM t")
def ground_truth_match(spark, d):
    """Whether a result is what was asked for: by id where one is pinned, and only then by title."""
    pinned, by_title = F.col("document_id") % 2 == 0, F.exists(F.array(F.lit("capex report"), F.lit("board minutes")), lambda t: F.contains(F.lower("title"), t))
    return documents(spark, d).select("document_id", F.when(pinned, F.col("document_id").isin(8, 20, 44)).otherwise(by_title).alias("relevant"), F.when(pinned, "id").when(by_title, "title").alias("scored_by"))


_CLAUSES = "concat('Code ABX9', cast(doc_id as string), '00000 has a margin of ', cast(1 + doc_id % 5 as string), '.', cast(doc_id % 100 as string), '% unless waived')"


@query(f"SELECT doc_id, nullif(regexp_extract({_sql(_CLAUSES)}, 'margin of ([0-9]+\\.[0-9]+) ?%', 1), '') AS margin FROM documents WHERE contains({_sql(_CLAUSES)}, 'ABX91') ORDER BY doc_id LIMIT 20")
def identifier_evidence(spark, d):
    """The figure that stands with an identifier, from the first texts that hold it."""
    t = table(spark, d, "documents").select("doc_id", F.expr(_CLAUSES).alias("t")).where(F.col("t").contains("ABX91")).orderBy("doc_id").limit(20)
    return t.select("doc_id", F.nullif(F.regexp_extract("t", r"margin of ([0-9]+\.[0-9]+) ?%", 1), F.lit("")).alias("margin"))


@query(f"{DOCS} SELECT count(DISTINCT lexeme) AS lexemes, date '2024-02-01' AS refreshed FROM (SELECT unnest({_TOKENS.format('title')}) AS lexeme FROM rag_documents)")
def term_meta(spark, d):
    """The one row that a refresh of the word counts overwrites."""
    return documents(spark, d).select(F.explode(tokens(F.col("title"))).alias("lexeme")).agg(F.countDistinct("lexeme").alias("lexemes")).select("lexemes", F.lit("2024-02-01").cast("date").alias("refreshed"))


@query(f"{DOCS} SELECT project_id, count(DISTINCT doc_type) FILTER (doc_type IN ('board','capex','cash_flow','funding')) AS received, 4 AS expected FROM rag_documents WHERE {RETRIEVABLE} GROUP BY project_id")
def pack_areas(spark, d):
    areas = ("board", "capex", "cash_flow", "funding")
    return documents(spark, d).where(retrievable()).groupBy("project_id").agg(F.countDistinct(F.when(F.col("doc_type").isin(*areas), F.col("doc_type"))).alias("received")).withColumn("expected", F.lit(len(areas)))


@query(f"{WITH_METRICS}, {PAIRS}, r AS (SELECT arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS run FROM orders) SELECT (SELECT run FROM r) AS latest_run, (SELECT count(*) FROM (SELECT * FROM x LIMIT 20)) AS shown, (SELECT count(*) FROM metric_candidate WHERE status = 'pending_review') AS pending")
def pipeline_dashboard(spark, d):
    """One row: the latest run, how many open contradictions are shown, and what waits for review."""
    c = candidates(spark, d)
    latest = table(spark, d, "orders").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_run"))
    shown = evidence.contradictions_up_to(c, 20).withColumnRenamed("n", "shown")
    return latest.join(F.broadcast(shown)).join(F.broadcast(c.agg(F.count_if(F.col("status") == "pending_review").alias("pending"))))


_OVER = _MANY.format("true").replace("WHERE place <= 10", "WHERE place <= 40").replace(")\nSELECT query_id, vec_id AS document_id", "),\nn AS (SELECT query_id, vec_id AS document_id", 1)


@query(f"""{_OVER}), t AS (SELECT query_id, place, {_TRUST} >= 2 AS trusted FROM n JOIN (SELECT *, {TIER} AS tier FROM rag_documents) USING (document_id))
SELECT query_id, count(*) AS fetched, count(*) FILTER (trusted) AS trusted, count(*) FILTER (trusted AND place <= 10) AS without, least(10, count(*) FILTER (trusted)) AS returned FROM t GROUP BY query_id""")
def over_fetch(spark, d):
    """Strict grounding drops many rows, so four times as many are fetched: how many of ten are left with and without."""
    vectors, _ = over_fetched(10)
    asked = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = vi.search(vector_index(spark, d), asked, vi.allowed(documents(spark, d)), vectors, exact=True)
    trusted = documents(spark, d).select(F.col("document_id").alias("vec_id"), (trust(verification_tier()) >= 2).alias("trusted"))
    rows = found.join(trusted, "vec_id").groupBy("query_id").agg(F.count("*").alias("fetched"), F.count_if("trusted").alias("trusted"), F.count_if(F.col("trusted") & (F.col("place") <= 10)).alias("without"))
    return rows.withColumn("returned", F.least(F.lit(10), "trusted"))

