"""Retrieval quality: recall, reciprocal rank, precision, discounted gain and rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_relevant(results: DataFrame) -> DataFrame:
    """Place of each query's first relevant result (0 if none) and the number of relevant ones among five."""
    return results.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("relevant"), F.col("place"))), F.lit(0)).alias("first"), F.count_if(F.col("relevant") & (F.col("place") <= 5)).alias("good"))


def retrieval_scores(results: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """One row: recall at each k, mean reciprocal rank and mean precision at five."""
    first = first_relevant(results)
    found = lambda k: (F.col("first") > 0) & (F.col("first") <= k)
    return first.agg(F.count("*").alias("queries"), *(F.round(F.count_if(found(k)) / F.count("*"), 6).alias(f"recall_{k}") for k in ks),
                     F.round(F.avg(F.when(F.col("first") > 0, 1.0 / F.col("first")).otherwise(0.0)), 6).alias("mrr"), F.round(F.avg(F.col("good") / 5), 6).alias("precision_5"))


def ndcg(place: Column, k: int) -> Column:
    """Discounted gain with one relevant document."""
    return F.when((place >= 1) & (place <= k), 1 / F.log2(place + 1)).otherwise(0.0)


def spearman(pairs: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Rank correlation of two rankings without ties in each group; null for a single member."""
    n = F.count("*")
    return pairs.groupBy(by).agg(F.round(1 - F.try_divide(6 * F.sum(F.pow(F.col(a) - F.col(b), 2)), n * (n * n - 1)), 6).alias("spearman"), n.alias("n"))


def searched(golden: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, first and returned: at which document of its results (query_id, document_id, place; chunks of a document count once) each question has the expected one, 0 if it has not.

    A question without results counts as well.
    """
    best = found.groupBy("query_id", "document_id").agg(F.min("place").alias("best"))
    places = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "document_id")))
    rows = golden.join(places, "query_id", "left").groupBy("query_id")
    return rows.agg(F.coalesce(F.min(F.when(F.col("document_id") == F.col("expected"), F.col("n"))), F.lit(0)).alias("first"), F.count("document_id").alias("returned"))


def run_scores(run: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: queries, recall at each k, mrr, and how many questions came back empty."""
    n = F.count("*")
    return run.agg(n.alias("queries"), *(F.round(F.count_if((F.col("first") >= 1) & (F.col("first") <= k)) / n, 6).alias(f"recall_{k}") for k in ks),
                   F.round(F.avg(F.when(F.col("first") > 0, 1.0 / F.col("first")).otherwise(0.0)), 6).alias("mrr"), F.count_if(F.col("returned") == 0).alias("empty"))
