"""Operators on small tables: ties, nulls and the cases that the driver's tables lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidora.functions.columns import fold, shingles, tokens
from evidora.operators import chunking, dedup, evaluation, evidence, governance, reporting, search
from evidora.streaming import windows


def test_tables_keep_their_head_in_every_fragment():
    rows = [f"| row {i} | {'x' * 60} |" for i in range(60)]
    blocks = chunking.tables(["Prices", "", "| a | b |", "|---|---|", *rows, "after"])
    tables = [b for k, b in blocks if k == "table"]
    assert len(tables) > 1 and all(t.startswith("| a | b |\n|---|---|\n") and len(t) <= 2000 for t in tables)
    assert [r for t in tables for r in t.split("\n")[2:]] == rows
    assert blocks[0] == ("text", "Prices") and blocks[-1] == ("text", "after")


def test_legal_texts_are_cut_at_clauses():
    text = "Preamble\nArticle 1 One\nbody\nClause 2 Two\nbody\nSección tercera\nbody"
    assert [k for k, _ in chunking.chunk(text, "legal")] == ["clause"] * 4
    assert [k for k, _ in chunking.chunk(text, "tax")] == ["narrative"]
    assert [k for k, _ in chunking.chunk("Article 1\nx\nArticle 2\ny", "legal")] == ["narrative"]


def test_paragraphs_overlap_and_long_ones_stay_whole():
    words = " ".join(f"w{i}" for i in range(300))
    one, two = chunking.narrative(f"{words}\n\n{'z' * 1500}")
    assert one == words and two.startswith(" ".join(words.split()[-39:])) and two.endswith("z" * 1500)
    assert chunking.narrative("y" * 9000) == ["y" * 9000] and chunking.narrative("") == [] and chunking.chunk(None) == []


def test_tabbed_sections():
    text = "Income\n" + "\n".join(f"a\t{i}\tb" for i in range(4)) + "\nCOSTS\n" + "\n".join(f"c\t{i}\td" for i in range(4))
    got = chunking.chunk(text)
    assert [k for k, _ in got] == ["structured"] * 2 and got[1][1].startswith("COSTS")


def test_folding_and_tokens(spark):
    df = spark.createDataFrame([("Ñandú çà É the THE a1b",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(fold(F.col("t")), tokens(F.col("t"))).collect()]
    assert got[0] == ("nandu ca e the the a1b", ["nandu", "the", "a1b"]) and got[1] == ("", []) and got[2] == (None, None)


def test_shingles_of_short_texts(spark):
    df = spark.createDataFrame([("a b",), ("A b c",), ("a b c a b c",)], "t string")
    assert [r[0] for r in df.select(shingles(F.col("t"))).collect()] == [[], ["a b c"], ["a b c", "b c a", "c a b"]]


def test_similar_pairs_against_brute_force(spark):
    base = [f"w{i}" for i in range(40)]
    texts = [base, base[:36] + ["x"] * 4, base[:20] + ["y"] + base[21:], ["q"] * 3, base, base[::-1]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {(r.a_id, r.b_id) for r in dedup.similar_pairs(spark.createDataFrame([("k", i, t) for i, t in rows], "k string, document_id long, text string"), "k").collect()}
    sets = {i: {tuple(t.split()[j:j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows if i != 4}
    want = {(a, b) for a in sets for b in sets if a < b and round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) >= 0.8}
    assert got == want and want


def test_every_copy_has_its_class_and_links(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(0, i, text) for i in range(5)] + [(0, 9, text + " more"), (0, 10, "quite another text"), (0, 11, None), (0, 12, None)]
    got = dedup.text_classes(spark.createDataFrame(rows, "all int, document_id long, text string"), "all")
    want = [(i, 0, 1) for i in range(5)] + [(9, 9, 1), (10, 10, 0), (11, 11, 0), (12, 11, 0)]
    assert sorted(map(tuple, got.collect())) == want


def test_retrievable_treats_nulls_as_the_rules_say(spark):
    rows = [("approved", None, "indexed", None), (None, "user", "indexed", "draft"), ("rejected", "user", "indexed", None), ("pending", "agent_rejected", "indexed", None), ("pending", "user", "indexed", "superseded"), ("pending", "user", "error", None)]
    df = spark.createDataFrame(rows, "review_status string, classification_source string, status string, lifecycle string")
    assert [r[0] for r in df.select(F.coalesce(governance.retrievable(), F.lit(False))).collect()] == [True, False, False, False, False, False]


def test_relevance_floor_is_never_empty(spark):
    df = spark.createDataFrame([(1, 1, 0.2, False), (1, 2, 0.3, False), (2, 3, 0.1, True), (2, 4, 0.2, False)], "query_id int, document_id long, relevance double, protected boolean")
    assert sorted(r.document_id for r in search.relevance_floor(df, 0.5).collect()) == [2, 3]
    assert search.relevance_floor(df, 0).count() == 4


def test_minmax_without_spread(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.3), (2, 0.0), (2, 1.0)], "g int, x double")
    assert sorted(r.scaled for r in search.minmax(df, "x", "g").collect()) == [0.0, 0.5, 0.5, 1.0]


def test_contradictions_skip_zero_and_match_missing_periods(spark):
    rows = [(1, "M", None, None, 100.0, 50, "x"), (2, "M", None, None, 150.0, 50, "x"), (3, "M", "Q1", None, 0.0, 50, "x"), (4, "M", "Q1", None, 50.0, 90, "x"), (5, "M", "Q1", None, 50.6, 50, "x"), (6, "M", None, None, 99.0, 50, "rejected")]
    df = spark.createDataFrame(rows, "candidate_id long, metric_id string, period_label string, period_date date, value double, authority_score int, status string")
    assert {(r.a_id, r.b_id, r.severity) for r in evidence.contradictions(df).collect()} == {(1, 2, "critical"), (4, 5, "low")}


def test_latest_breaks_ties_by_the_last_key(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 2, "y"), ("b", 5, 3, None)], "k string, t int, id int, v string")
    assert {(r.k, r.v) for r in reporting.latest(df, ["k"], "t", "id").collect()} == {("a", "y"), ("b", None)}


def test_scores_without_a_relevant_result(spark):
    df = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False)], "query_id int, place int, relevant boolean")
    r = evaluation.retrieval_scores(df).first()
    assert (r.queries, r.recall_1, r.recall_3, r.mrr, r.precision_5) == (2, 0.0, 0.5, 0.25, 0.1)


def test_windows_over_a_stream_match_the_table(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "6 hours", "60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    whole = windows.tumbling(events, "6 hours").withColumn("start", F.col("start").cast("timestamp"))
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, whole.collect()))


def test_entry_and_queries_without_the_optional_package(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns and set(e.oracle_sql()) <= set(e.queries())


def test_files_zips_and_reports(spark, tmp_path):
    import io
    import zipfile

    from evidora.sources import files

    def zipped(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(name, data)
        return out.getvalue()

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(zipped({"x.txt": "one", "__MACOSX/y": "no", "d/z.md": "two"}))
    (tmp_path / "in" / "broken.zip").write_bytes(b"PK nothing")
    (tmp_path / "in" / "._a.zip").write_bytes(b"junk")
    (tmp_path / "in" / "t.docx").write_bytes(zipped({"word/document.xml": '<w:p><w:r><w:t>A &amp; </w:t><w:t xml:space="preserve">B</w:t></w:r></w:p><w:p></w:p><w:p><w:t>C</w:t></w:p>'}))
    found = files.folder(spark, str(tmp_path / "in"))
    assert found.count() == 3
    members = {r.path.rsplit("!", 1)[-1]: r for r in files.zip_members(found).collect()}
    assert bytes(members["x.txt"].content) == b"one" and bytes(members["d/z.md"].content) == b"two" and any(r.error for r in members.values()) and len(members) == 3
    assert [r.text for r in files.office_text(found).collect()] == ["A & B\nC"]
    files.write_report(spark.createDataFrame([(1, 'a "b", c')], "i int, t string"), str(tmp_path / "out"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out/csv")).first().t == 'a "b", c'
    art = spark.createDataFrame([("body", 'a "q"', None)], "b string, t string, n string").select(files.markdown_artifact(F.col("b"), title=F.col("t"), none=F.col("n"))).first()[0]
    assert art == '---\ntitle: "a \\"q\\""\n---\n\nbody'


def test_hybrid_retrieval_fuses_scales_boosts_and_orders(spark):
    """A document that both lanes find leads; each of the others has its own relevance, whatever lane found it; equal ones keep the fusion's order."""
    about = "document_id long, title string, status string, review_status string, classification_source string, lifecycle string, authority_score int"
    docs = spark.createDataFrame([(i, "Nation report" if i == 4 else "Memo", "indexed", "approved" if i == 5 else "rejected" if i == 8 else "pending", "rule", "signed", 70 if i == 7 else 10) for i in range(1, 9)], about)
    vector = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (8, 4)], "document_id long, place int")
    words = spark.createDataFrame([(3, 1), (4, 2), (5, 3), (6, 4), (7, 5)], "document_id long, place int")
    got = [(r.document_id, r.relevance) for r in search.hybrid([vector, words], docs, ["nation"]).orderBy("place").collect()]
    fused = {1: 1 / 61, 2: 1 / 62, 3: 1 / 63 + 1 / 61, 4: 1 / 62, 5: 1 / 63, 6: 1 / 64, 7: 1 / 65}
    low, span = 1 / 65, 1 / 63 + 1 / 61 - 1 / 65
    want = {i: (f - low) / span + {4: 0.2, 5: 0.4, 7: 0.5}.get(i, 0) for i, f in fused.items()}
    assert {i for i, _ in got} == set(want) and all(abs(x - want[i]) < 1e-5 for i, x in got)  # 8 was rejected
    assert [i for i, _ in got][:2] == [3, 7]  # the only ones of high relevance
    tied = spark.createDataFrame([(0, i, 0.6, "pending", "rule", 10, n) for i, n in ((1, 0.1), (2, 0.3), (3, 0.2))], "query_id int, document_id int, relevance double, review_status string, classification_source string, authority_score int, score double")
    assert [r.document_id for r in search.trust_order(tied, "standard", F.desc("score")).orderBy("place").collect()] == [2, 3, 1]
