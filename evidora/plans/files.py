"""Queries over file names, artifacts and results that others bring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidora.operators.governance import retrievable
from evidora.plans.governance import DOCS, RETRIEVABLE
from evidora.plans.registry import query
from evidora.sources import archives, files
from evidora.sources.versions import kept_folder
from evidora.sources.views import DOCUMENTS_SQL, METRICS_SQL, as_sql, documents, metrics, table

_EXT = "lower(nullif(regexp_extract(path, '\\.([A-Za-z0-9]{1,5})$', 1), ''))"
_PATH = "concat('uploads/', cast(doc_id as varchar), case doc_id % 5 when 0 then '.pdf' when 1 then '.TXT' when 2 then '/../x.md' when 3 then '.exe' else '' end)"
_PATHS = "case doc_id % 5 when 0 then '.pdf' when 1 then '.TXT' when 2 then '/../x.md' when 3 then '.exe' else '' end"
_MIME = "CASE " + " ".join(f"WHEN {_EXT} = '{e}' THEN '{m}'" for e, m in files.MIME.items()) + " ELSE 'application/octet-stream' END"


@query(f"WITH p AS (SELECT doc_id, n_chars * 1000 AS size, {_PATH} AS path FROM documents) SELECT doc_id, {_MIME} AS mime, coalesce({_EXT} IN {tuple(files.MIME)} AND size > 0 AND size <= 52428800 AND NOT contains(path, '..'), false) AS accepted FROM p")
def upload_validation(spark, d):
    p = table(spark, d, "documents").select("doc_id", (F.col("n_chars") * 1000).alias("size"), F.concat(F.lit("uploads/"), "doc_id", F.expr(_PATHS)).alias("path"))
    return p.select("doc_id", files.mime_type(F.col("path")).alias("mime"), files.accepted(F.col("path"), F.col("size")).alias("accepted"))


_UPLOAD = ("document_id",
           "concat(CASE WHEN document_id % 11 = 0 THEN 'up' ELSE 'uploads' END, '/', substr(md5(coalesce(text, '')), 1, 18), CASE WHEN document_id % 7 = 0 THEN '-' ELSE substr(md5(title), 1, 18) END, CASE WHEN document_id % 13 = 0 THEN '/a' ELSE '' END, '/f') AS storage_path",
           "concat(title, CASE document_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX ' WHEN 2 THEN '.exe' WHEN 3 THEN '.csv' ELSE '' END) AS file_name",
           "CASE WHEN document_id % 6 = 0 THEN NULL ELSE (document_id % 9) * 10000000 END AS size")
_JOB_PROJECTS = "SELECT DISTINCT project_id FROM metric_definition WHERE project_id <> 'P3'"


@query(f"""{as_sql(DOCUMENTS_SQL, METRICS_SQL)}, u AS (SELECT {', '.join(_UPLOAD)}, project_id AS asked FROM rag_documents), e AS (SELECT *, coalesce(lower(nullif(regexp_extract(trim(file_name), '\\.([A-Za-z0-9]{{1,5}})$', 1), '')), '') AS ext FROM u)
SELECT storage_path, file_name, CASE WHEN NOT regexp_full_match(storage_path, 'uploads/[0-9a-fA-F-]{{36}}/[^/]+') THEN 'path' WHEN trim(coalesce(file_name, '')) = '' THEN 'no name' WHEN ext NOT IN {files.JOB_TYPES} THEN 'type' WHEN size <= 0 THEN 'empty' WHEN size > 52428800 THEN 'too large' END AS issue,
nullif(ext, '') AS file_type, p.project_id FROM e LEFT JOIN ({_JOB_PROJECTS}) p ON p.project_id = asked""")
def upload_jobs(spark, d):
    """All documents as uploads, with what is wrong with each and the projects that are known."""
    uploads = documents(spark, d).selectExpr(*_UPLOAD, "project_id")
    return files.job_inputs(uploads, metrics(spark, d).where("project_id <> 'P3'").select("project_id"))


@query(f"{DOCS} SELECT document_id, sha256(concat_ws(chr(10), '---', 'title: \"' || title || '\"', CASE WHEN project_id IS NOT NULL THEN 'project: \"' || project_id || '\"' END, CASE WHEN period IS NOT NULL THEN 'period: \"' || period || '\"' END, '---', '', text)) AS digest FROM rag_documents")
def markdown_artifacts(spark, d):
    """Digests of the artifacts of all documents."""
    return documents(spark, d).select("document_id", F.sha2(files.markdown_artifact(F.col("text"), title=F.col("title"), project=F.col("project_id"), period=F.col("period")), 256).alias("digest"))


@query("SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size, sha256(coalesce(text, '')) AS digest, CAST(NULL AS VARCHAR) AS error FROM documents")
def archive_members(spark, d):
    """All documents, packed in archives and read from them member by member."""
    rows = table(spark, d, "documents").select(F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("member"), F.col("text").alias("content"))
    folder = kept_folder(spark, "archives", d, ("documents",), lambda f: archives.write_archives(rows, f).agg(F.sum("members")).collect())
    found = archives.read_members(archives.members(archives.archives_in(spark, folder)))
    return found.select(F.regexp_extract("path", r"(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), "size", F.sha2("content", 256).alias("digest"), "error")


_HITS = f"{DOCS}, h AS (SELECT document_id, row_number() OVER (ORDER BY (document_id * 53) % 97 DESC, document_id) AS place FROM rag_documents WHERE {RETRIEVABLE}), c AS (SELECT * FROM h WHERE place <= 40)"


@query(f"{_HITS} SELECT document_id, row_number() OVER (ORDER BY CASE WHEN place <= 16 AND document_id % 3 = 0 THEN 0 WHEN place <= 16 THEN 1 ELSE 2 END, CASE WHEN place <= 16 AND document_id % 3 = 0 THEN -(document_id % 10) ELSE 0 END, place) AS final FROM c")
def rerank_merge(spark, d):
    """Scores that a reranker brings for some of the first sixteen: scored, then unscored, then the rest."""
    ranked = (documents(spark, d).where(retrievable()).orderBy(F.desc((F.col("document_id") * 53) % 97), "document_id").limit(40)
              .select("document_id", F.row_number().over(Window.orderBy(F.desc((F.col("document_id") * 53) % 97), "document_id")).alias("place")))
    scored = (F.col("place") <= 16) & (F.col("document_id") % 3 == 0)
    order = Window.orderBy(F.when(scored, 0).when(F.col("place") <= 16, 1).otherwise(2), F.when(scored, -(F.col("document_id") % 10)).otherwise(0), "place")
    return ranked.select("document_id", F.row_number().over(order).alias("final"))


@query(f"{DOCS} SELECT document_id, coalesce({RETRIEVABLE}, false) AS usable FROM rag_documents WHERE title ILIKE '%accounts%' OR title ILIKE '%opinion%'")
def resolve_ids(spark, d):
    """Documents that any of some terms name, and whether they may be used."""
    return documents(spark, d).where(F.col("title").ilike("%accounts%") | F.col("title").ilike("%opinion%")).select("document_id", F.coalesce(retrievable(), F.lit(False)).alias("usable"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def tally(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")
