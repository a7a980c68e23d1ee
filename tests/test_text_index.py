"""Stems by their rules, the inverted index and cover density against plain Python, many questions against single ones."""

from __future__ import annotations

import itertools
import random
import re
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidora.functions import stemming
from evidora.operators import text_index as ti
from evidora.plans import search as plans
from evidora.sources.versions import kept_already
from evidora.sources.views import chunks, documents

# Words of one stem in a row (a folded word stands for itself).
FAMILIES_EN = ("loan loans", "company companies", "rate rates", "box boxes", "class classes", "value valued values valuing valuation valuations", "finance financed financing finances", "sign signed signing signs", "plan planned planning plans", "lend lending lends",
               "business", "analysis", "string strings", "report reported reporting reports", "bank banks banking banked", "budget budgets budgeted", "agree agreed agreeing", "party parties", "facility facilities", "quarter quarterly quarters", "wave waves", "build building buildings builds",
               "approve approved approving approves", "invest invested investing invests", "permit permitted permitting permits", "cost costs costing", "add added adding adds", "formation form formed forming forms", "gas", "bus", "bring bringing")
FAMILIES_ES = ("contrato contratos", "cuenta cuentas", "firmado firmada firmar firmados firmando firmaron", "financiacion financiaciones financiar", "anual anualmente anuales", "socio socios socia", "junta juntas", "vez veces", "proyecto proyectos", "vender vendido vendidas vendiendo vendieron",
               "poder poderes", "obra obras", "pago pagos pagado", "aprobado aprobada aprobados aprobar", "banco bancos", "reunion reuniones", "licencia licencias", "mes meses", "parcela parcelas", "coste costes", "margen", "ingreso ingresos ingresado")


@pytest.mark.parametrize("families,rules", [(FAMILIES_EN, stemming.ENGLISH), (FAMILIES_ES, stemming.SPANISH)])
def test_words_of_a_family_share_a_stem_of_their_own(spark, families, rules):
    stems = [{stemming.stem(w, rules) for w in f.split()} for f in families]
    assert all(len(s) == 1 for s in stems), [f for f, s in zip(families, stems, strict=True) if len(s) > 1]
    assert len(set.union(*stems)) == len(families)
    words = [w for f in families for w in f.split()] + ["", "a", "e", "ss", "yy", "x" * 300, "1234", "ers"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", stemming.stemmed(F.col("w"), rules).alias("s")).collect()
    assert all(r.s == stemming.stem(r.w, rules) for r in got)
    import duckdb

    con = duckdb.connect()
    sql = con.execute(f"SELECT w, {stemming.stem_sql('w', rules)} FROM (SELECT unnest({words}) AS w)").fetchall()
    assert all(s == stemming.stem(w, rules) for w, s in sql)


def test_folding_knows_ascii_and_marks(spark):
    texts = ["Plain ASCII Text", "Financiación ÉTÉ", "", "\x00\x7f", None]
    from evidora.functions.columns import fold

    assert [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fold(F.col("t")).alias("f")).collect()] == ["plain ascii text", "financiacion ete", "", "\x00\x7f", None]


def covers(spots, terms):
    """Every shortest span that holds all terms, by trying all spans."""
    n = len(spots)
    full = [(i, j) for i in range(n) for j in range(i, n) if len({t for _, t in spots[i:j + 1]}) == terms]
    spans = {(spots[i][0], spots[j][0]) for i, j in full}
    least = [(a, b) for a, b in spans if not any((a <= c and d <= b) and (c, d) != (a, b) for c, d in spans)]
    rank = 0.0
    for a, b in least:
        inside = sum(a <= p <= b for p, _ in spots) - 1
        noise = b - a - inside
        rank += 0.1 / (1 + (noise if noise >= 0 else inside // 2))
    return round(rank, 6)


def test_cover_density_is_that_of_all_shortest_spans(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        terms = rng.randrange(1, 4)
        places = sorted(rng.sample(range(40), rng.randrange(1, 12)))
        rows.append((i, terms, [(p, rng.randrange(1, terms + 1)) for p in places]))
    got = spark.createDataFrame(rows, "id long, terms int, spots array<struct<position:int,term:int>>").select("id", F.round(ti.cover_density(F.col("spots"), F.col("terms")), 6).alias("rank")).collect()
    assert {r.id: r["rank"] for r in got} == {i: covers(s, t) for i, t, s in rows}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = "loan loans lending facility board minutes contrato contratos capex report reports the of wave waves río licencias".split()
    rows = [(i, i // 3, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), "P9" if i % 4 == 0 else None, None) for i in range(120)] + [(900, 300, "", None, None), (901, 300, None, None, None), (902, 301, "loan " * 3000, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, content string, chunk_project string, chunk_doc_type string")
    state = [(i, f"P{i % 3}" if i % 5 else None, "legal", ("approved", "rejected", "pending", None)[i % 4], "rule" if i % 6 else "agent_rejected", "indexed" if i % 7 else "retired", "filed" if i % 9 else "superseded") for i in {r[1] for r in rows}]
    docs = spark.createDataFrame(state, "document_id long, project_id string, doc_type string, review_status string, classification_source string, status string, lifecycle string")
    live = {s[0]: s[1] for s in state if s[3] in ("approved", "pending") and s[4] != "agent_rejected" and s[5] == "indexed" and s[6] != "superseded"}
    return chunks, docs, rows, live


def brute(rows, live, text, project, k, ceiling, any_of=6, all_of=3):
    held = {}
    for chunk, doc, content, own, _ in rows:
        if doc in live:
            folded = (content or "").lower().replace("í", "i")
            spots = {}
            for p, w in enumerate(re.split("[^a-z0-9]+", folded)):
                for x in stemming.lexemes_of(w) if w else ():
                    spots.setdefault(x, []).append(p)
            held[chunk] = (doc, live[doc] or own or "", spots)
    asked = stemming.lexemes_of(text)
    df = {x: sum(x in h[2] for h in held.values()) for x in asked}
    order = sorted(asked, key=lambda x: (df[x], x))
    selective = [x for x in order if df[x] <= ceiling][:any_of]
    chosen = selective or order[:all_of]
    out = []
    for chunk, (doc, project_of, spots) in held.items():
        if project in (None, project_of) and any(x in spots for x in chosen):
            if selective:
                out.append((-round(0.1 * sum(len(spots.get(x, ())) for x in chosen), 6), chunk, doc))
            elif all(x in spots for x in chosen):
                out.append((-covers(sorted((p, chosen.index(x) + 1) for x in chosen for p in spots[x]), len(chosen)), chunk, doc))
    return [(c, d, -r) for r, c, d in sorted(out)[:k]]


ASKED = ("Loan facility", "the board of contratos", "capex REPORTS waves", "río", "unknown words", "", "of the", "loan lending licencias board minutes waves report")


def test_questions_find_what_brute_force_finds(spark, corpus):
    chunks, docs, rows, live = corpus
    index = ti.postings(chunks)
    table = [(i, t, p) for i, (t, p) in enumerate(itertools.product(ASKED, (None, "P1", "P9")))]
    questions = spark.createDataFrame(table, "query_id long, text string, project string")
    for ceiling in (0, 25, 1500):
        got = {}
        for r in ti.search(index, docs, questions, k=7, ceiling=ceiling).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, r.document_id, r["rank"]))
        assert {i: v for i, t, p in table if (v := brute(rows, live, t, p, 7, ceiling))} == got
    one = [tuple(r) for r in ti.search_one(index, docs, ASKED[-1], "P1", k=7, ceiling=25).collect()]
    assert sorted(one) == sorted(brute(rows, live, ASKED[-1], "P1", 7, 25))
    counted = {r.lexeme: r.df for r in ti.document_frequency(index, docs).collect()}
    assert counted["loan"] == sum(bool(re.search(r"\bloans?\b", r[2] or "")) for r in rows if r[1] in live)


def test_many_questions_are_as_single_ones(spark, small):
    asked = plans.questions(spark, small).orderBy("query_id").limit(6)
    docs, index = documents(spark, small), plans.postings(spark, small)
    together = ti.search(index, docs, asked, ceiling=40)
    for q in asked.collect():
        one = ti.search_one(index, docs, q.text, ceiling=40)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, together.where(f"query_id = {q.query_id}").select("chunk_id", "document_id", "rank").collect()))


def test_a_scan_for_few_lexemes_names_them(spark, small):
    plan = ti.search_one(plans.postings(spark, small), documents(spark, small), "erin thon")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(lexeme" in plan or "PushedFilters: [IsNotNull(lexeme), In(lexeme" in plan or "In(lexeme, [" in plan


def test_kept_counts_follow_a_series_of_changes(spark, corpus):
    """Documents come, change their text, are retired and go: the kept counts are always those of a full count."""
    import tempfile

    from evidora.sources.versions import VersionedTable

    chunks, docs, _, _ = corpus
    kept = VersionedTable(spark, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/df", ["lexeme"], buckets=16)
    full = lambda state: sorted(map(tuple, ti.document_frequency(ti.postings(state[0]), state[1]).collect()))
    empty = chunks.where("false"), docs.where("false")
    some = chunks.where("document_id < 20"), docs.where("document_id < 20")
    edited = some[0].withColumn("content", F.when(F.col("document_id") % 3 == 1, "quay loan quay").otherwise(F.col("content"))), some[1]
    retired = edited[0], edited[1].withColumn("status", F.when(F.col("document_id") % 4 == 0, "retired").otherwise(F.col("status")))
    smaller = retired[0].where("document_id > 5"), retired[1].where("document_id > 5")
    steps = [(empty, some, "document_id < 20"), (some, (chunks, docs), "document_id >= 20"), ((chunks, docs), some, "document_id >= 20"), (some, edited, "document_id % 3 = 1"), (edited, retired, "document_id % 4 = 0"), (retired, smaller, "document_id <= 5")]
    for i, (before, after, which) in enumerate(steps):
        changed = before[1].unionByName(after[1]).where(which)
        version = ti.refresh_frequency(kept, changed, before, after, txn=f"step {i}")
        assert sorted(map(tuple, kept.read().select("lexeme", "df").collect())) == full(after)
        assert ti.refresh_frequency(kept, changed, before, after, txn=f"step {i}") == version  # a retry adds nothing


def test_postings_are_made_without_a_shuffle(spark):
    texts = [(10, 1, "P1", None, "The loan, the loans: financiación firmada. Loan!"), (20, 2, None, "tax", ""), (30, 3, None, None, None), (40, 4, None, None, "¡Contratos y cuentas, the and x")]
    parts = spark.createDataFrame(texts, "chunk_id long, document_id long, chunk_project string, chunk_doc_type string, content string")
    rows = ti.postings(parts)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r.lexeme, r.chunk_id): (r.document_id, r.chunk_project, r.chunk_doc_type, r.positions) for r in rows.collect()}
    # The definition, by the column functions.
    word = parts.select("chunk_id", F.posexplode(stemming.words(F.col("content"))).alias("position", "word")).where(stemming.counts(F.col("word")))
    want = {(r.lexeme, r.chunk_id): r.positions for r in word.select("chunk_id", "position", F.explode(stemming.lexemes(F.col("word"))).alias("lexeme")).groupBy("lexeme", "chunk_id").agg(F.sort_array(F.collect_list("position")).alias("positions")).collect()}
    assert {k: v[3] for k, v in got.items()} == want and got[("loan", 10)][:3] == (1, "P1", None)


def test_counts_of_chunks_are_those_of_their_postings(spark, small, monkeypatch):
    monkeypatch.setattr(ti, "MOST", 50)
    parts, docs = chunks(spark, small), documents(spark, small)
    want = {r.lexeme: r.df for r in ti.document_frequency(ti.postings(parts), docs).collect()}
    assert {r.lexeme: r.df for r in ti.chunk_frequency(parts, docs).collect()} == want


def test_chunks_are_counted_together_and_words_stemmed_once(monkeypatch):
    rng = random.Random(11)
    words = "loan loans lending the of board contratos financed financing x1 ab río ñandú über 2024".split()
    texts = [None, "", " ", "loan", "loans", "ñ", *(rng.choice((" ", ", ", "ñ", "")).join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(500)), "", None]
    want = {}
    for text in texts:
        for lexeme in {x for w in re.split("[^a-z0-9]+", text or "") if w for x in ti._stems(w)}:
            want[lexeme] = want.get(lexeme, 0) + 1
    asked, stems = [], ti._stems
    monkeypatch.setattr(ti, "_stems", lambda word: asked.append(word) or stems(word))
    for kind in (pa.string(), pa.large_string()):
        assert ti._chunk_counts(pa.array(["before", *texts, "after"], kind).slice(1, len(texts))) == want
        assert ti._chunk_counts(pa.array([None, "", "the"], kind)) == ti._chunk_counts(pa.array([], kind)) == {}
    asked.clear()
    assert ti._chunk_counts(pa.array(["loan board loans"] * 1000)) == {"loan": 1000, "board": 1000, "loans": 1000} | {x: 1000 for w in ("loan", "board", "loans") for x in stems(w)}
    assert sorted(asked) == ["board", "loan", "loans"]


def test_rules_that_are_not_tried_change_nothing():
    rng = random.Random(12)
    ends = "es ies s ation ations ing ings ed ly bb dd gg mm nn pp rr tt e ee y ces amente mente acion acione a o and iend aron ieron ad id ab ar er ir".split()
    for _ in range(20000):
        word = "".join(rng.choice("aeiounrstldcmb17xyz") for _ in range(rng.randrange(9))) + rng.choice(["", *ends])
        for rules in stemming.LANGUAGES:
            plain = word
            for found, left in rules:
                plain = re.sub(found, left, plain)
            assert stemming.stem(word, rules) == plain


def test_a_search_of_many_lexemes_is_the_same(spark, small, monkeypatch):
    """Past ``FEW`` lexemes only the postings of those that were chosen are read."""
    docs, rows = documents(spark, small), ti.postings(chunks(spark, small)).persist()
    asked = docs.where("document_id % 9 = 0").select(F.col("document_id").alias("query_id"), F.substring("text", 1, 300).alias("text"))
    for limits in ({}, {"ceiling": 40, "all_of": 0}, {"ceiling": 0}, {"ceiling": 40, "term_df": ti.document_frequency(rows, docs)}):
        monkeypatch.setattr(ti, "FEW", 1 << 20)
        want = sorted(map(tuple, ti.search(rows, docs, asked, **limits).collect()))
        monkeypatch.setattr(ti, "FEW", 3)
        assert sorted(map(tuple, ti.search(rows, docs, asked, **limits).collect())) == want and want
    rows.unpersist()


def test_postings_on_demand_are_those_of_the_index(spark, small):
    parts = chunks(spark, small)
    whole = ti.postings(parts).persist()
    for text in (plans.QUERY, plans._QUERY, plans.COMMON, "río companies"):
        named = stemming.lexemes_of(text)
        assert sorted(map(repr, ti.postings(parts, ti.only_named(named)).collect())) == sorted(map(repr, whole.where(F.col("lexeme").isin(named)).collect()))
    docs, asked = documents(spark, small), plans.questions(spark, small)
    for limits in ({}, {"ceiling": 40, "all_of": 0}, {"ceiling": 0}):
        assert sorted(map(tuple, ti.search_chunks(parts, docs, asked, **limits).collect())) == sorted(map(tuple, ti.search(whole, docs, asked, **limits).collect()))
    whole.unpersist()


def test_no_query_makes_an_index_of_all(spark, small, tmp_path):
    own = shutil.copytree(small, tmp_path / "tables")
    for made in (plans.hybrid_retrieve, plans.retrieve_standard, plans.retrieve_trusted, plans.retrieve_diagnostics, plans.keyword_many):
        got = made(spark, str(own)).collect()
        assert kept_already(spark, "postings", str(own), ("documents",)) is None
        plans.postings(spark, small)
        assert sorted(map(repr, got)) == sorted(map(repr, made(spark, small).collect())) and got
