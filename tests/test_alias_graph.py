"""Aliases against brute force, scopes by their rules, and governance in every lane."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from evidora.operators import alias_graph as ag
from evidora.operators.governance import retrievable
from evidora.plans import search as plans
from evidora.plans.catalogue import QUERIES
from evidora.sources.views import chunks, documents


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (9 - len(r))) for r in rows], ag.ENTITY)


@pytest.mark.parametrize("many,at_once", [(10, 50_000), (3000, 50_000), (3000, 700)])
def test_aliases_are_found_as_by_brute_force(spark, many, at_once, monkeypatch):
    monkeypatch.setattr(ag, "AT_ONCE", at_once)
    rng = random.Random(many)
    part = lambda: "".join(rng.choice("abcdé1") for _ in range(rng.randrange(1, 4)))
    aliases = {f"e{i}": [" ".join(part() for _ in range(rng.randrange(1, 3))) for _ in range(3)] for i in range(many // 3)}
    texts = [(i, " ".join(part() for _ in range(rng.randrange(0, 60))) + rng.choice(("", ".", "-b", "É"))) for i in range(200)] + [(900, ""), (901, None), (902, "ab cd " * 20000)]
    got = {r.id: r.entities for r in ag.named(spark.createDataFrame(texts, "id long, text string"), table(spark, [(e, "k", 1, a) for e, a in aliases.items()]), "id").collect()}
    plain = lambda t: (t or "").lower().replace("é", "e")
    want = {}
    for i, t in texts:
        hit = [e for e, a in aliases.items() if any(len(plain(x).strip()) >= 2 and re.search(rf"(?<![a-z0-9]){re.escape(plain(x).strip())}(?![a-z0-9])", plain(t)) for x in a)]
        if hit:
            want[i] = sorted(hit)
    assert got == want and want


RULES = [("A", "project", 7, ["alpha"], "PA"), ("B", "project", 6, ["beta site"], "PB"), ("bank", "bank", 8, ["bank"], None, ["funding"]), ("pact", "legal_term", 8, ["pact"], None, ["legal"], None, ["PC"], "PA"),
         ("tower", "asset", 4, ["tower"], None, None, "PB"), ("word", "other", 1, ["word"])]


def test_scopes_and_types_follow_from_what_is_named(spark):
    asked = [(0, "Alpha and the bank", None, None), (1, "a pact", None, None), (2, "beta site pact", None, None), (3, "alpha pact", None, None), (4, "only a word", None, None), (5, "nothing", None, None), (6, "the bank", "PB", None), (7, "the tower's bank", "PA", None),
             (8, "tower bank", "PB", "legal"), (9, "alpha", "PB", None), (10, None, None, None)]
    got = {r.query_id: (r.scopes, r.types) for r in ag.understood(spark.createDataFrame(asked, "query_id long, text string, project string, doc_type string"), table(spark, RULES)).collect()}
    assert got == {0: (["PA"], ["funding"]), 1: (["PC"], ["legal"]), 2: (["PB"], ["legal"]), 3: (["PA", "PC"], ["legal"]), 6: (["PB"], ["funding"]), 8: (["PB"], ["legal"])}


def test_chunks_of_the_best_documents_in_scope(spark):
    docs = spark.createDataFrame([(i, f"{'Bank' if i % 2 else 'Note'} {i}", "PA" if i < 40 else "PB", "funding", "approved" if i % 4 else "rejected", "rule", "indexed", "filed", 95 if i % 10 == 1 else 10) for i in range(50)],
                                 "document_id long, title string, project_id string, doc_type string, review_status string, classification_source string, status string, lifecycle string, authority_score int")
    chunks = spark.createDataFrame([(i * 10 + j, i, "the bank of alpha beats" if j == 0 else "nothing", None) for i in range(50) for j in range(2)], "chunk_id long, document_id long, content string, x string")
    asked = spark.createDataFrame([(1, "alpha bank beats", None, None), (2, "nobody", None, None)], "query_id long, text string, project string, doc_type string")
    got = ag.expand(chunks, docs, asked, table(spark, RULES)).orderBy("place").collect()
    top = sorted((i for i in range(40) if i % 4), key=lambda i: (-((8 if i % 2 else 0) + 3 + (3 if i % 10 == 1 else 0)), i))[:32]
    want = {}
    for i in top:
        doc = (8 if i % 2 else 0) + 3 + (3 if i % 10 == 1 else 0)
        want[i * 10] = 0.45 * doc + 7 + 8 + 3 - 1 + (1 if True else 0) + 4
        want[i * 10 + 1] = 0.45 * doc + (8 + 1 if i % 2 else 0)
    # alpha, bank and beats are words of four letters and more; both entities are in the first chunk.
    order = sorted((c for c, s in want.items() if s >= 7), key=lambda c: (-round(want[c], 4), c))[:28]
    assert [r.chunk_id for r in got] == order and {r.chunk_id: r.score for r in got} == {c: round(want[c], 4) for c in order}
    assert ag.expand(chunks, docs, asked, table(spark, [])).count() == 0


# Single lanes and whole retrievals; those that put the same lanes together otherwise are left out.
LANES = ("vector_topk", "vector_topk_filtered", "keyword_search_filtered", "keyword_topk", "hybrid_many", "graph_many", "supplement_rules", "retrieve_standard", "retrieve_trusted")


@pytest.mark.parametrize("name", LANES)
def test_no_lane_returns_an_excluded_document(spark, small, name):
    found = QUERIES[name](spark, small).select("document_id").distinct()
    allowed = documents(spark, small).where(retrievable()).select("document_id", F.lit(True).alias("allowed"))
    assert found.join(allowed, "document_id", "left").where("allowed is null").count() == 0


def test_documents_are_ranked_once_for_questions_that_name_the_same(spark, small, monkeypatch):
    asked = spark.range(300).selectExpr("id as query_id", "concat(case when id % 2 = 0 then 'the board minutes of loan ' else 'capex and cash flow ' end, cast(id as string)) as text")
    ranked, whole = [], ag.documents_for
    monkeypatch.setattr(ag, "documents_for", lambda q, *rest: ranked.append(q.count()) or whole(q, *rest))
    got = ag.expand(chunks(spark, small), documents(spark, small), asked, plans.entities(spark))
    assert got.select("query_id").distinct().count() > 200 and ranked == [2]
