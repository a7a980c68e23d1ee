"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora.llm import audit, chat, decontaminate, html_text, merkle, mixing, quality, simhash, substring, topk, toxicity, urlfilter, warc
from evidora.llm.common import table


def op1_mixing(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op2_topk_search(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_html_text(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark, sf_dir):
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op7_warc(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("url", "warc_date")


def op8_suffix_dedup(spark, sf_dir):
    return substring.dedup_digest(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.digests(chat.formatted(turns))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.proofs(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


# SQL for the operators that it can express; the others are held against brute force in the tests.
TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_dot_product(q.v, c.v) AS bigint) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, cast(r AS integer) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5"""
ARCHIVES = """WITH p AS (SELECT page_id, cast(octet_length(encode(coalesce(html, ''))) AS bigint) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to FROM f"""
SUBSTRINGS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM w) WHERE first < doc_id),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
j AS (SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM d JOIN k USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, cast(length(h) // 2 AS bigint) AS n_bytes, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, cast(coalesce(n_spans, 0) AS bigint) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)"""

FILTERS = r"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT w.doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
 || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (l.good) AS good, count(*) FILTER (l.toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, CAST(s AS integer) AS step, o[s] AS own FROM o, (SELECT unnest(range(1, 6)) AS s)),
r AS (SELECT m.*, o, (SELECT min(s) FROM unnest(range(1, 6)) AS u(s) WHERE contains(fails, o[s])) AS gone FROM m, o),
c AS (SELECT part, o, step, own, sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone < step AND contains(fails, own) THEN n ELSE 0 END) AS redundant,
 sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost FROM r JOIN s USING (o) GROUP BY part, o, step, own)
SELECT part, o AS filter_order, step, CAST(kept AS bigint) AS kept, CAST(removed AS bigint) AS removed, CAST(redundant AS bigint) AS redundant, CAST(unique_fails AS bigint) AS unique_fails, CAST(good_lost AS bigint) AS good_lost, CAST(toxic_lost AS bigint) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, own) AS bigint) AS shapley FROM c"""
CHATS = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[]\\*)(/?s>|/?INST\])', '\1\\\2', 'g') AS safe,
 regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '([<\[]\\*)(/?s>|/?INST\])', '\1\\\2', 'g') AS head FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS bigint) AS loss_chars,
 sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(length('<s>[INST] ' || head || chr(10) || safe || ' [/INST]</s>')) AS bigint) AS formatted_chars FROM e GROUP BY conv_id"""
MERKLE = """WITH RECURSIVE d AS (SELECT *, row_number() OVER (ORDER BY doc_id, text) AS k, coalesce(list_reduce(list_prepend(CAST(4294967295 AS bigint), list_transform(string_split(CAST(doc_id AS varchar), ''), lambda x: CAST(ascii(x) AS bigint))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS bigint[])), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 0) AS c FROM documents),
a AS (SELECT *, xor(c, 4294967295) % 7 = 0 AND doc_id IS NOT NULL AS changed,
  CASE WHEN doc_id IS NULL THEN '-' ELSE length(CAST(doc_id AS varchar)) || ':' || doc_id END || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM d),
f AS (SELECT k, doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS varchar)) || ':' || n_chars, '-') || tail) AS leaf,
  CASE WHEN changed THEN sha256(head || coalesce(length(CAST(n_chars + 1 AS varchar)) || ':' || (n_chars + 1), '-') || tail) END AS tampered FROM a),
p AS (SELECT *, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM f),
t AS (SELECT g, 0 AS l, i, n, leaf AS h FROM p UNION ALL SELECT g, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, l, i // 2, n),
s AS (SELECT g, row_number() OVER (ORDER BY encode(g)) - 1 AS j, count(*) OVER () AS m, h FROM t WHERE n = 1),
u AS (SELECT 0 AS l, j AS i, m AS n, h FROM s UNION ALL SELECT l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY l, i // 2, n),
q AS (SELECT p.k, t.l, 0 AS part, CASE WHEN t.i % 2 = 0 THEN 'l' ELSE 'r' END AS side, t.h FROM p JOIN t ON t.g = p.g AND t.n > 1 AND t.i = xor(p.i >> t.l, 1)
  UNION ALL SELECT p.k, t.l, 0, '=', '' FROM p JOIN t ON t.g = p.g AND t.n > 1 AND t.i = p.i >> t.l AND t.i % 2 = 0 AND t.i + 1 = t.n
  UNION ALL SELECT p.k, u.l, 1, CASE WHEN u.i % 2 = 0 THEN 'l' ELSE 'r' END, u.h FROM p JOIN s USING (g) JOIN u ON u.n > 1 AND u.i = xor(s.j >> u.l, 1)
  UNION ALL SELECT p.k, u.l, 1, '=', '' FROM p JOIN s USING (g) JOIN u ON u.n > 1 AND u.i = s.j >> u.l AND u.i % 2 = 0 AND u.i + 1 = u.n),
w AS (SELECT k, list(side || h ORDER BY part, l) AS path FROM q GROUP BY k),
z AS (SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x[2:]), '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(path, [])), lambda x, y: CASE y[1] WHEN 'l' THEN sha256(y[2:] || x) WHEN 'r' THEN sha256(x || y[2:]) ELSE sha256(x) END) AS folded_root FROM p JOIN s USING (g) LEFT JOIN w USING (k))
SELECT *, folded_root = root AS verified FROM z"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": FILTERS, "op12_chat_format": CHATS, "op13_merkle_manifest": MERKLE, "op2_topk_search": TOP_K, "op7_warc": ARCHIVES, "op8_suffix_dedup": SUBSTRINGS}
