"""Near-duplicate decisions on documents that exercise every branch: superseded, differing, of mixed types, financial, translated."""

from __future__ import annotations

import re
from random import Random

from evidora.operators import dedup, evaluation

SCHEMA = "document_id long, project_id string, doc_type string, title string, lifecycle string, chunk_count int, text string"
BASE = " ".join(f"word{i}" for i in range(400))


def test_every_decision(spark):
    edited = BASE.replace("word200", "changed")
    other = " ".join(f"thing{i}" for i in range(400))
    rows = [
        (1, "P1", "legal", "Lease agreement signed.pdf", "signed", 3, BASE), (2, "P1", "legal", "Lease agreement (copy).pdf", "draft", 3, edited), (3, "P1", "legal", "Lease agreement.pdf", None, 3, other), (4, "P1", "legal", "Lease agreement draft.docx", None, 9, BASE[:1000]),
        (10, "P1", "capex", "Capital costs v1", None, 1, "a b c"), (11, "P1", "legal", "Capital costs v2", None, 1, "d e f"),
        (20, "P2", "legal", "Survey report v1", None, 1, "a b c"), (21, "P2", "tax", "Survey report v2", None, 1, "d e f"),
        (30, None, "legal", "Shareholder pact eng es", None, 1, "a b c d"), (31, None, "legal", "Shareholder pacteng es", None, 1, "e f g h"),
        (40, "P3", "legal", "Same content v1", None, 1, "x y z"), (41, "P3", "legal", "Same content v2", None, 1, "x  y z"),
        (50, "P4", "legal", "Lease agreement.pdf", None, 1, BASE), (60, "P5", "legal", "Short", None, 1, "q"), (61, "P5", "legal", "Short", None, 1, "r"),
        (70, "P6", "board", "Minutes of board", None, 2, None), (71, "P6", "board", "Minutes of board", None, 1, "one two three"),
    ]
    got = {r.document_id: (r.canonical, r.decision, r.reason) for r in dedup.near_duplicate_decisions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        2: (1, "supersede", "near-duplicate"), 3: (1, "review", "differs"), 4: (1, "review", "differs"),
        10: (None, "review", "financial-versions"), 11: (None, "review", "financial-versions"), 20: (None, "review", "mixed-type"), 21: (None, "review", "mixed-type"),
        30: (None, "review", "translations"), 31: (None, "review", "translations"),  # 70 has no text, so 71 is the only content of its cluster
    }


def test_a_run_counts_questions_without_results(spark):
    golden = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "query_id long, expected long")
    found = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (1, 10, 5), (2, 21, 1), (2, 21, 2), (2, 22, 3)], "query_id long, document_id long, place int")
    run = evaluation.searched(golden, found)
    assert {r.query_id: (r["first"], r.returned) for r in run.collect()} == {1: (2, 2), 2: (0, 2), 3: (0, 0)}
    r = evaluation.run_scores(run).first()
    assert (r.queries, r.recall_1, r.recall_3, r.mrr, r.empty) == (3, 0.0, 0.333333, 0.166667, 1)


def test_similarity_counts_to_six_digits(spark):
    rows = [(0, 1, "a b c d"), (0, 2, "a b c d e"), (0, 3, "x y z")]  # two of three trigrams, 0.666667 when rounded
    got = dedup.similar_pairs(spark.createDataFrame(rows, "all int, document_id long, text string"), "all", least=0.666667)
    assert [tuple(r) for r in got.collect()] == [(1, 2, 0.666667)]


def test_common_runs_lose_no_pair_and_no_text_is_grouped(spark):
    random = Random(3)
    common = [f"c{i}" for i in range(60)]
    texts = []
    for i in range(150):
        body = common[:random.randint(0, 60)] + [f"w{random.randint(0, 400)}" for _ in range(random.randint(0, 60))]
        texts += [body, body[:-1] + ["end"], body * 2, body[3:]]
    rows = [(i % 2 if i % 50 else None, i, None if i % 97 == 5 else random.choice((" ", "\n\n", " \t")).join(t).upper()) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "all int, document_id long, text string")
    smallest = {}
    for key, i, text in rows:
        if text is not None:
            smallest.setdefault((key, text), i)
    sets = {i: (key, {tuple(w[j:j + 3]) for w in [text.lower().split()] for j in range(len(w) - 2)}) for (key, text), i in smallest.items() if key is not None}
    want = {}
    for a, (k, x) in sets.items():
        for b, (m, y) in sets.items():
            if a < b and k == m and x and y and round(len(x & y) / len(x | y), 6) >= 0.8:
                want[a, b] = round(len(x & y) / len(x | y), 6)
    assert {(r.a_id, r.b_id): r.jaccard for r in dedup.similar_pairs(docs, "all").collect()} == want and len(want) > 100
    classes = dedup.text_classes(docs, "all")
    assert classes.count() == len(rows)
    assert not re.search(r"hashpartitioning\([^)]*text", classes._jdf.queryExecution().toString())
