"""The corpus pipeline: every stage on its own input, and the whole."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidora.llm import decontaminate, quality, registry, simhash, substring
from evidora.llm.common import crc_mod, staged, table


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = staged(stage(spark, docs, sf), "stage")
        if i < 4:
            assert out.columns == docs.columns
        kept[name] = out.count()
        if i == 0:
            model = quality.fit(docs, table(spark, sf, "labels"), crc_mod("doc_id", 3) != 1)
            texts = docs.collect()
            good = {r.doc_id for r, s in zip(texts, model.scores([r.text.encode() for r in texts]), strict=True) if s >= 0.5}
            assert {r.doc_id for r in out.collect()} == good
        if i == 1:
            assert {r.doc_id for r in out.collect()} == {r.component_id for r in simhash.near_duplicates(docs).collect()}
        if i == 2:
            assert substring.dedup_digest(docs).where("n_removed > 0").count() == docs.join(out.withColumnRenamed("text", "t"), "doc_id").where("t != text").count()
        if i == 3:
            items = [(r.item_id, decontaminate.normalise(r.text)) for r in table(spark, sf, "benchmark").collect()]
            leaky = {d.doc_id for d in docs.collect() if any(len(t) >= 8 and t in decontaminate.normalise(d.text) for _, t in items)}
            assert not leaky & {r.doc_id for r in out.collect()}
        docs = out
    assert kept["quality classifier"] < 200 and docs.select("doc_id").distinct().count() > 50
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.select("doc_id", "mix_epoch").collect())) == sorted(map(tuple, docs.select("doc_id", "mix_epoch").collect()))


def test_stages_on_empty_and_awkward_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").withColumn("extra", F.lit("x"))
    passage = " ".join(f"shared{i}" for i in range(40))
    odd = spark.createDataFrame([(9001, None, None, None, None, "a"), (9002, "", "en", "s", 0, "b"), (None, "some words " + passage, "en", "s", 1, "c"), (9003, passage * 4000, "en", "s", 2, None), (9003, passage * 4000, "en", "s", 2, None), (9004, passage, "en", None, 3, "d")],
                                "doc_id long, text string, lang string, source string, n_chars long, extra string")
    for rows, empty in ((docs.where("false"), True), (docs.unionByName(odd), False)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = staged(stage(spark, rows, sf), "stage")
            assert (rows.count() == 0) == empty and rows.columns[:6] == docs.columns
            if i == 1:
                assert rows.where("doc_id = 9003").count() <= 1 and rows.where("text is null or text = ''").count() <= 1


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_gives_the_same_rows(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
