"""The corpus pipeline: documents become a training mixture.

Low-quality documents go, one of each group of near copies stays, repeated
passages are cut out, documents that leak a benchmark item go, and what is left
is mixed by source.  The first four stages return the columns of ``documents``;
the last adds a document's weight, pass and place in the mixture.

Cases: a null or empty text has the classifier's score of no bytes, is a near copy
of every other empty text, loses and leaks nothing, and is in no mixture; rows
without a doc_id are never near copies to be dropped and lose no passages; of rows
that repeat one stays; texts of any length are worked on whole; extra columns are
carried through, and ``mix_weight``, ``mix_epoch`` and ``mix_progress`` are
replaced; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidora.llm import decontaminate, mixing, quality, simhash, substring
from evidora.llm.common import staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
]

# SQL cannot express the classifier, the fingerprints or the alignments; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
