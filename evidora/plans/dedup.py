"""Duplicate and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora.functions.columns import first_rule
from evidora.operators import dedup as u
from evidora.plans.governance import DOCS
from evidora.plans.registry import ORACLE, query
from evidora.sources.views import documents, table

FOLD = "lower(translate({}, 'áàâäãåāéèêëēíìîïīóòôöõōúùûüūñçýÿÁÀÂÄÃÅĀÉÈÊËĒÍÌÎÏĪÓÒÔÖÕŌÚÙÛÜŪÑÇÝ', 'aaaaaaaeeeeeiiiiioooooouuuuuncyyAAAAAAAEEEEEIIIIIOOOOOOUUUUUNCY'))"
HASH = "sha256(trim(regexp_replace(text, '\\s+', ' ', 'g')) || chr(10))"
_BARE = f"regexp_replace({FOLD.format('title')}, '\\.[a-z0-9]{{2,4}}$', '')"
STEM = f"regexp_replace(regexp_replace(regexp_replace({_BARE}, '\\b(v[0-9]+|rev[0-9]*|draft|signed|final|copy)\\b', '', 'g'), '[0-9]{{4}}[-_]?[0-9]{{2}}[-_]?[0-9]{{2}}', '', 'g'), '[^a-z0-9]', '', 'g')"
TIGHT = f"regexp_replace(regexp_replace(regexp_replace({_BARE}, '\\b(draft|signed|final|copy)\\b', '', 'g'), '\\([ ]*[0-9]{{1,3}}[ ]*\\)', '', 'g'), '[^a-z0-9]', '', 'g')"
LANGUAGE = f"nullif(regexp_extract({FOLD.format('title')}, '\\b(en|es|fr|de|eng|esp)\\b', 1), '')"


@query(f"{DOCS}, h AS (SELECT *, {HASH} AS h FROM rag_documents), s AS (SELECT document_id, h, count(*) OVER (PARTITION BY h) AS copies, first_value(document_id) OVER (PARTITION BY h ORDER BY coalesce(authority_score, -1) DESC, created_at, document_id) AS survivor FROM h) "
       "SELECT document_id, survivor, copies, document_id <> survivor AS superseded FROM s WHERE copies > 1")
def exact_dedup(spark, d):
    return u.exact_duplicates(documents(spark, d))


@query(f"{DOCS} SELECT document_id, {STEM} AS stem, {TIGHT} AS tight, {LANGUAGE} AS language FROM rag_documents")
def title_keys(spark, d):
    return documents(spark, d).select("document_id", u.stem(F.col("title")).alias("stem"), u.tight_key(F.col("title")).alias("tight"), u.language_tag(F.col("title")).alias("language"))


@query("""WITH t AS (SELECT text, min(doc_id) AS id FROM documents GROUP BY text), w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
g AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s), p AS (SELECT a.id AS a_id, b.id AS b_id, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT a_id, b_id, round(shared / (an + bn - shared), 6) AS jaccard FROM p WHERE round(shared / (an + bn - shared), 6) >= 0.8""")
def near_dup_jaccard(spark, d):
    docs = table(spark, d, "documents").select(F.lit(0).alias("all"), F.col("doc_id").alias("document_id"), "text")
    return u.similar_pairs(docs, "all")


@query(f"""WITH q AS ({ORACLE["near_dup_jaccard"]}), t AS (SELECT text, min(doc_id) AS class_id FROM documents GROUP BY text),
l AS (SELECT class_id, count(*) AS links FROM (SELECT a_id AS class_id FROM q UNION ALL SELECT b_id FROM q) GROUP BY class_id)
SELECT doc_id AS document_id, t.class_id, coalesce(links, 0) AS links FROM documents d JOIN t ON d.text IS NOT DISTINCT FROM t.text LEFT JOIN l ON t.class_id = l.class_id""")
def near_dup_classes(spark, d):
    """The membership of ``near_dup_jaccard``: each document's representative, and its number of links."""
    docs = table(spark, d, "documents").select(F.lit(0).alias("all"), F.col("doc_id").alias("document_id"), "text")
    return u.text_classes(docs, "all")


_GRAMS = "(SELECT doc_id, w, length(text) AS len, CASE WHEN len(w) < 3 THEN []::varchar[] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents))"


@query(f"""{DOCS}, x AS (SELECT document_id, coalesce(project_id, '') AS p, coalesce(doc_type, '') AS t, title, lifecycle, coalesce(chunk_count, 0) AS cc, {HASH} AS h, {STEM} AS stem, {TIGHT} AS tight, {LANGUAGE} AS lang FROM rag_documents),
c AS (SELECT stem, p, bool_or(t IN {u.FINANCIAL}) AS fin, bool_and(t IN {u.CONTRACTS}) AS con FROM x WHERE length(stem) >= 8 GROUP BY stem, p HAVING count(*) > 1 AND count(DISTINCT h) > 1),
m AS (SELECT x.*, CASE WHEN fin THEN 'financial-versions' WHEN NOT con THEN 'mixed-type' END AS whole FROM x JOIN c USING (stem, p)),
s AS (SELECT *, count(*) OVER g AS n, min(h) OVER g <> max(h) OVER g AS differ, coalesce(min(lang) OVER g <> max(lang) OVER g, false) AS langs, first_value(document_id) OVER (PARTITION BY stem, p, tight ORDER BY CASE lifecycle WHEN 'signed' THEN 5 WHEN 'executed' THEN 4 WHEN 'filed' THEN 4
 WHEN 'working_paper' THEN 3 WHEN 'draft' THEN 2 ELSE 1 END DESC, title ILIKE '%signed%' DESC, title ILIKE '%.pdf' DESC, cc DESC, document_id) AS canonical FROM m WHERE whole IS NULL WINDOW g AS (PARTITION BY stem, p, tight)),
q AS (SELECT s.document_id, canonical, coalesce(len(list_intersect(a.g, b.g)) / nullif(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)), 0), 0) AS sim, least(a.len, b.len) / greatest(a.len, b.len, 1) AS ratio
 FROM s JOIN {_GRAMS} a ON a.doc_id = s.document_id JOIN {_GRAMS} b ON b.doc_id = canonical WHERE n > 1 AND differ AND NOT langs AND s.document_id <> canonical)
SELECT document_id, NULL::bigint AS canonical, 'review' AS decision, whole AS reason FROM m WHERE whole IS NOT NULL UNION ALL SELECT document_id, NULL, 'review', 'translations' FROM s WHERE n > 1 AND differ AND langs
UNION ALL SELECT document_id, canonical, CASE WHEN sim >= 0.95 AND ratio >= 0.9 THEN 'supersede' ELSE 'review' END, CASE WHEN sim >= 0.95 AND ratio >= 0.9 THEN 'near-duplicate' ELSE 'differs' END FROM q""")
def near_dup_decisions(spark, d):
    return u.near_duplicate_decisions(documents(spark, d))


@query(f"{DOCS}, c AS (SELECT title, project_id, doc_type, chunk_count, count(*) AS n FROM rag_documents GROUP BY ALL HAVING count(*) > 1) SELECT count(*) AS clusters, cast(sum(n - 1) AS bigint) AS redundant, max(n) AS largest, (SELECT count(*) FROM rag_documents WHERE chunk_count = 0) AS empty_documents FROM c")
def dup_cluster_report(spark, d):
    docs = documents(spark, d)
    clusters = docs.groupBy("title", "project_id", "doc_type", "chunk_count").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("clusters"), F.sum(F.col("n") - 1).alias("redundant"), F.max("n").alias("largest"))
    return clusters.join(F.broadcast(docs.agg(F.count_if(F.col("chunk_count") == 0).alias("empty_documents"))), how="inner")


@query(f"{DOCS} SELECT title, project_id, doc_type, chunk_count, count(*) AS n, starts_with(title, '._') AS junk FROM rag_documents GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, title, project_id NULLS FIRST, doc_type NULLS FIRST, chunk_count LIMIT 10")
def dup_cluster_top(spark, d):
    """The ten largest clusters."""
    keys = ["title", "project_id", "doc_type", "chunk_count"]
    return documents(spark, d).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *keys).limit(10).withColumn("junk", F.col("title").startswith("._"))


@query(f"{DOCS} SELECT sha256(text) AS source_hash, project_id, count(*) AS n, count(DISTINCT doc_type) AS types FROM rag_documents GROUP BY ALL HAVING count(*) > 1")
def hash_dup_probe(spark, d):
    return documents(spark, d).groupBy(F.sha2("text", 256).alias("source_hash"), "project_id").agg(F.count("*").alias("n"), F.countDistinct("doc_type").alias("types")).where("n > 1")


_STATES = ("missing", "unmapped", "job_exists", "changed")


@query(f"{DOCS}, f AS (SELECT document_id AS file_id, project_id, sha256(text) AS h, ({list(_STATES)})[document_id % 4 + 1] AS action FROM rag_documents), "
       "m AS (SELECT project_id, h, min(file_id) AS first FROM f WHERE project_id IS NOT NULL AND action <> 'unmapped' GROUP BY ALL) "
       "SELECT file_id, CASE WHEN action IN ('missing', 'changed') AND file_id > first THEN 'duplicate_in_batch' ELSE action END AS action FROM f LEFT JOIN m ON f.project_id = m.project_id AND f.h = m.h")
def batch_dup_mark(spark, d):
    action = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("document_id") % 4 + 1).cast("int"))
    files = documents(spark, d).select(F.col("document_id").alias("file_id"), "project_id", F.sha2("text", 256).alias("source_hash"), action.alias("action"))
    return u.mark_batch_duplicates(files).select("file_id", "action")


# Every document comes again as a file: under another hash if it is changed, from another project, unreadable or too large.
_FILE = {"file_id": "document_id", "name": "concat(title, case document_id % 11 when 0 then '_error.txt' when 1 then '.exe' when 2 then ' new.docx' else '.pdf' end)", "project_id": "case when document_id % 17 = 3 then null else project_id end",
         "hashed": "case when document_id % 3 = 0 then concat(text, '+') else text end", "size": "length(text) * 1000", "storage_path": "coalesce(storage_path, concat('in/', cast(document_id as string)))", "unavailable": "document_id % 23 = 4"}
_HASHED = "case when document_id % 4 = 2 then null else text end"  # documents of old have no hash
_JOB = "case event_type when 'view' then 'queued' when 'click' then 'processing' when 'signup' then 'canceled' else 'done' end"


@query(f"""{DOCS}, f AS (SELECT {', '.join(f"{e} AS {n}" for n, e in _FILE.items()).replace('as string)', 'as varchar)')} FROM rag_documents), g AS (SELECT *, coalesce(project_id, '') AS p, sha256(hashed) AS source_hash, lower(trim(regexp_replace(name, '\\.[A-Za-z0-9]{{1,5}}$', ''))) AS key, lower(regexp_extract(name, '\\.([A-Za-z0-9]{{1,5}})$', 1)) AS ext FROM f),
k AS (SELECT *, coalesce(project_id, '') AS p, CASE WHEN {_HASHED} IS NOT NULL THEN sha256(text) END AS source_hash_of FROM rag_documents),
bh AS (SELECT p, source_hash_of AS source_hash, count(*) FILTER (status = 'indexed' AND lifecycle IS DISTINCT FROM 'superseded' AND chunk_count > 0) AS usable, count(*) FILTER (status = 'indexed' AND lifecycle = 'superseded' AND chunk_count > 0) AS replaced, count(*) FILTER (status = 'error') AS failed FROM k WHERE source_hash_of IS NOT NULL GROUP BY ALL),
bt AS (SELECT p, lower(trim(regexp_replace(title, '\\.[A-Za-z0-9]{{1,5}}$', ''))) AS key, count(source_hash_of) AS hashed_docs FROM k WHERE lifecycle IS DISTINCT FROM 'superseded' GROUP BY ALL),
j AS (SELECT 'uploads/' || event_id AS storage_path, {_JOB} AS job_status FROM events),
a AS (SELECT file_id, g.project_id, g.source_hash, CASE WHEN regexp_matches(name, '(?i)_error\\.txt$') OR ext NOT IN ('pdf','docx','xlsx','pptx','txt','md','csv') THEN 'unsupported' WHEN unavailable THEN 'unavailable' WHEN g.project_id IS NULL THEN 'unmapped' WHEN usable > 0 THEN 'already_indexed_hash'
 WHEN replaced > 0 THEN 'duplicate_content_superseded' WHEN failed > 0 THEN 'failed_unextractable' WHEN usable IS NOT NULL THEN 'reingest_same_hash' WHEN size > 20000000 THEN 'too_large' WHEN job_status IN ('queued','processing','done') THEN 'job_exists' WHEN hashed_docs > 0 THEN 'changed' WHEN hashed_docs = 0 THEN 'legacy_title_match' ELSE 'missing' END AS action
 FROM g LEFT JOIN bh USING (p, source_hash) LEFT JOIN bt USING (p, key) LEFT JOIN j USING (storage_path)),
m AS (SELECT project_id, source_hash, min(file_id) AS first FROM a WHERE project_id IS NOT NULL AND action NOT IN {u.KEPT_ACTIONS} GROUP BY ALL)
SELECT file_id, CASE WHEN action IN {u.QUEUED_ACTIONS} AND file_id > first THEN 'duplicate_in_batch' ELSE action END AS action FROM a LEFT JOIN m ON a.project_id = m.project_id AND a.source_hash = m.source_hash""")
def reconcile_actions(spark, d):
    """All documents arrive as files and are known as documents."""
    docs = documents(spark, d)
    files = docs.select(*(F.expr(e).alias(n) for n, e in _FILE.items())).withColumn("source_hash", F.sha2("hashed", 256)).drop("hashed")
    jobs = table(spark, d, "events").select(F.concat(F.lit("uploads/"), "event_id").alias("storage_path"), F.expr(_JOB).alias("job_status"))
    known = docs.withColumn("source_hash", F.sha2(F.expr(_HASHED), 256))
    return u.reconcile(files, known, jobs, max_bytes=20_000_000).select("file_id", "action")


@query(f"SELECT action, count(*) AS n FROM ({ORACLE['reconcile_actions']}) GROUP BY action")
def reconcile_summary(spark, d):
    return reconcile_actions(spark, d).groupBy("action").agg(F.count("*").alias("n"))


_PATHS = ((r"^https?://[^/]*spam", "quarantine"), (r"/en/", "english"), (r"/fr/", "french"), (r"/de/", "german"), (r"/es/", "spanish"))


@query("SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{v}'" for p, v in _PATHS) + " ELSE 'unknown' END AS project, lower(nullif(regexp_extract(url, '\\.([A-Za-z0-9]{2,4})$', 1), '')) AS extension FROM pages")
def path_rules(spark, d):
    return table(spark, d, "pages").select("page_id", first_rule(F.col("url"), _PATHS, "unknown").alias("project"), F.lower(F.nullif(F.regexp_extract("url", r"\.([A-Za-z0-9]{2,4})$", 1), F.lit(""))).alias("extension"))
