"""Retrieval: the vector lane, fusion, boosts, floors and trust ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions.columns import MARKED, PLAIN, cosine, fold
from evidora.operators.governance import retrievable, trust, verification_tier

THRESHOLD, VECTOR_K, FINAL_K = 0.18, 25, 10
RRF_K = 60
HIGH_RELEVANCE = 0.5


def vector_lane(vectors: DataFrame, docs: DataFrame, query: DataFrame, k: int = VECTOR_K, threshold: float = THRESHOLD) -> DataFrame:
    """The k governed documents nearest to a one-row ``query`` (column ``q``), by cosine, then authority, date and id.

    The query is one vector, which comes to the driver and stands in the plan as a literal, so that vectors are scanned and
    scored where they lie and only those past the threshold are joined with their documents.
    """
    asked = query.select("q").first()
    q = [] if asked is None or asked.q is None else [float(x) for x in asked.q]
    literal = F.array(*map(F.lit, q)) if q else F.array().cast("array<double>")
    near = vectors.select("vec_id", cosine(F.col("embedding"), literal).alias("similarity")).where(F.col("similarity") >= threshold)
    return (near.join(docs.where(retrievable()), near.vec_id == docs.document_id)
            .orderBy(F.desc("similarity"), F.desc_nulls_last("authority_score"), F.desc("created_at"), "document_id").limit(k)
            .select("document_id", "project_id", "similarity", "authority_score", "review_status", "classification_source"))


def over_fetched(k: int, strict: bool = True) -> tuple[int, int]:
    """Rows that the vector and the keyword lane are asked for; strict grounding drops many, so it asks for more."""
    return (min(4 * k, 100), min(4 * k, 80)) if strict else (k, k)


def ranked(lane: DataFrame, *order) -> DataFrame:
    """A lane's rows with their place in it; a lane has at most its k rows."""
    return lane.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def reciprocal_rank_fusion(lanes: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + place) over the lanes (document_id, place) that hold a document."""
    out = None
    for lane in lanes:
        part = lane.select("document_id", (1.0 / (k + F.col("place"))).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("document_id").agg(F.round(F.sum("s"), 8).alias("score"), F.count("*").alias("lanes"))


def union_lanes(lanes: list[DataFrame]) -> DataFrame:
    """Rows of all lanes (document_id, place), each document from the first lane that has it."""
    out = None
    for i, lane in enumerate(lanes):
        part = lane.select(F.lit(i).alias("lane"), "document_id", "place")
        out = part if out is None else out.unionByName(part)
    first = Window.partitionBy("document_id").orderBy("lane", "place")
    return out.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def relevance_floor(rows: DataFrame, floor: float) -> DataFrame:
    """Rows that are protected or at the floor; if that leaves none, the single best."""
    whole = Window.partitionBy("query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "document_id")
    keep = F.col("protected") | (F.col("relevance") >= floor) if floor > 0 else F.lit(True)
    return (rows.withColumn("keep", keep).withColumn("any", F.max("keep").over(whole)).withColumn("r", F.row_number().over(best))
            .where(F.col("keep") | (~F.col("any") & (F.col("r") == 1))).drop("keep", "any", "r"))


def minmax(rows: DataFrame, column: str, by: str) -> DataFrame:
    """``scaled``: the column between 0 and 1 within each group; one half where the group has no spread."""
    w = Window.partitionBy(by)
    low, span = F.min(column).over(w), F.max(column).over(w) - F.min(column).over(w)
    return rows.withColumn("scaled", F.round(F.when(span < 1e-9, 0.5).otherwise((F.col(column) - low) / span), 6))


def trust_order(rows: DataFrame, mode: str = "trust", *before: Column) -> DataFrame:
    """``place`` of each row of a query by trust, or in ``standard`` mode with highly relevant rows first; equal rows stay in the order ``before``."""
    tier, approved = trust(verification_tier()), F.coalesce(F.col("review_status") == "approved", F.lit(False))
    by = [F.desc(tier), F.desc(approved), F.desc("relevance")]
    if mode == "standard":
        high = F.col("relevance") >= HIGH_RELEVANCE
        by = [F.desc(high), F.desc(F.when(high, F.col("relevance")).otherwise(-1.0)), F.desc(tier), F.desc(approved), F.desc("relevance")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*by, *before, "document_id")))


def rule_boosts(terms: list[str]) -> tuple[Column, Column]:
    """What governance adds to a document's relevance, and what query words in its title do."""
    metadata = F.when(F.col("authority_score") >= 60, 0.5).otherwise(0.0) + F.when(F.col("review_status") == "approved", 0.4).otherwise(0.0)
    return metadata, sum((F.when(F.contains(fold(F.col("title")), F.lit(t)), 0.2).otherwise(0.0) for t in terms), F.lit(0.0))


def boosted(relevance: Column, metadata: Column, content: Column) -> Column:
    """Relevance with rule boosts, each kind and the whole within its limit."""
    return F.round(F.least(relevance + F.least(metadata, F.lit(0.75)) + F.least(content, F.lit(0.35)), F.lit(1.5)), 6)


def hybrid(lanes: list[DataFrame], docs: DataFrame, terms: list[str], k: int = FINAL_K) -> DataFrame:
    """The k best documents of lanes (document_id, place): document_id, relevance, trust and place.

    Lanes are fused by reciprocal rank, as their own scores cannot be compared.  The fused score, scaled over the pool, stands in for a
    reranker's; then come governance, boosts and the standard order, in which equal documents stay as the fusion had them.
    """
    pool = reciprocal_rank_fusion(lanes).join(docs.where(retrievable()), "document_id").withColumn("query_id", F.lit(0))
    rows = minmax(pool, "score", "query_id").withColumn("relevance", boosted(F.col("scaled"), *rule_boosts(terms))).withColumn("trust", trust(verification_tier()))
    return trust_order(rows, "standard", F.desc("score")).where(F.col("place") <= k).select("document_id", "relevance", "trust", "place")


def roll_up(hits: DataFrame, snippets: int = 5, length: int = 420) -> DataFrame:
    """Chunk hits (document_id, chunk_id, score, content) by document: best score and the first snippets."""
    w = Window.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id")
    text = F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, length)
    kept = hits.withColumn("r", F.row_number().over(w))
    return kept.groupBy("document_id").agg(F.max("score").alias("score"), F.count("*").alias("chunks"),
                                           F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= snippets, F.struct("r", text.alias("t"))))), lambda s: s["t"]), "\n").alias("snippets"))


def find_documents(docs: DataFrame, name: str, k: int = 25) -> DataFrame:
    """Documents whose title holds the name; if none does, those that hold most of its words."""
    plain = fold(F.col("title"))
    words = [w for w in name.lower().split() if len(w) >= 4]
    exact = docs.where(plain.contains(name.lower())).withColumn("score", F.lit(100))
    score = sum((F.when(plain.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    loose = docs.withColumn("score", score).where("score > 0")
    none = exact.limit(1).agg((F.count("*") == 0).alias("none"))
    loose = loose.crossJoin(F.broadcast(none)).where("none").drop("none")
    return exact.unionByName(loose).orderBy(F.desc("score"), F.when(F.col("status") == "indexed", 0).otherwise(1), "document_id").limit(k)


def expanded_query(query: str, rules) -> str:
    """The query with the words that rules (word, words to add) give for what it names."""
    named = fold_text(query)
    return " ".join([query, *(more for word, more in rules if word in named)])


def fold_text(text: str) -> str:
    return text.translate(str.maketrans(MARKED, PLAIN)).lower()


def best_of_document(lane: DataFrame, score: str) -> DataFrame:
    """A lane of chunks as one of documents: each with its best score."""
    return lane.groupBy("document_id").agg(F.max(score).alias("similarity"))


def retrieve(vector: DataFrame, keyword: DataFrame, supplements: DataFrame, docs: DataFrame, terms: list[str], mode: str = "standard", scores: DataFrame | None = None, floor: float = 0.3, model_order: DataFrame | None = None,
             k: int = FINAL_K) -> tuple[DataFrame, DataFrame]:
    """The k best documents of three lanes (document_id, similarity), and one row of diagnostics.

    The first lane that has a document wins; ``mode`` keeps only sources trusted enough.  Relevance is a reranker's score
    (``scores``) or, without one (degraded), similarity scaled over the pool.  Documents that may not be retrieved go, whatever
    lane brought them; with scores those below ``floor`` go, unless the source is trusted or nothing would be left.  Then come
    boosts for governance and for query words in the title, a model's order where it brings one, a small lead for supplements,
    and the order of the mode.  Lanes hold a bounded number of rows, so the windows are over few rows.
    """
    out = None
    for i, lane in enumerate((vector, keyword, supplements)):
        part = lane.select("document_id", F.lit(i).alias("lane"), F.col("similarity").cast("double").alias("similarity"))
        out = part if out is None else out.unionByName(part)
    fused = out.groupBy("document_id").agg(F.min(F.struct("lane", (-F.col("similarity")).alias("s"))).alias("b"), F.count_distinct("lane").alias("lanes"))
    pool = fused.select("document_id", F.col("b.lane").alias("lane"), (-F.col("b.s")).alias("similarity"), "lanes").join(docs, "document_id").withColumn("query_id", F.lit(0)).withColumn("trust", trust(verification_tier()))
    allowed = pool.where(F.col("trust") >= {"standard": 0, "trusted_only": 2, "official_only": 3}[mode])
    if scores is None:
        rows = minmax(allowed, "similarity", "query_id").withColumnRenamed("scaled", "relevance")
    else:
        rows = allowed.join(scores, "document_id", "left").withColumn("relevance", F.coalesce("score", F.lit(0.0)))
    rows = rows.where(retrievable())
    if scores is not None:
        rows = relevance_floor(rows.withColumn("protected", F.col("trust") >= 2), floor)
    rows = rows.withColumn("relevance", boosted(F.col("relevance"), *rule_boosts(terms)))
    if model_order is not None:
        rows = rows.join(model_order, "document_id", "left").withColumn("relevance", F.coalesce("model_score", "relevance"))
    rows = rows.withColumn("relevance", F.round(F.col("relevance") + F.when(F.col("lane") == 2, 0.02).otherwise(0.0), 6))
    ranked_rows = trust_order(rows, "standard" if mode == "standard" else "trust").where(F.col("place") <= k)
    counts = out.groupBy("lane").agg(F.count("*").alias("n")).agg(*(F.coalesce(F.sum(F.when(F.col("lane") == i, F.col("n"))), F.lit(0)).alias(c) for i, c in enumerate(("vector_count", "keyword_count", "graph_count"))))
    pools = pool.agg(F.count("*").alias("pool_count"), F.count_if(F.col("lanes") > 1).alias("overlap_count"), F.count_if(F.col("trust") < {"standard": 0, "trusted_only": 2, "official_only": 3}[mode]).alias("grounding_filtered"))
    used = ranked_rows.agg(F.count("*").alias("returned"), F.count_if(F.coalesce(F.col("review_status").isin("pending", "needs_review"), F.lit(True))).alias("unreviewed_used"))
    diagnostics = counts.join(F.broadcast(pools)).join(F.broadcast(used)).withColumns({"degraded": F.lit(scores is None), "model_used": F.lit(model_order is not None), "grounding_mode": F.lit(mode)})
    return ranked_rows.select("document_id", "relevance", "trust", "lane", "place"), diagnostics


def smart_results(ranked_rows: DataFrame, docs: DataFrame, hits: DataFrame, limit: int = 12) -> DataFrame:
    """Found documents with a score of relevance, authority and review, and the first snippets of their hits (document_id, chunk_id, score, content)."""
    rolled = roll_up(hits.join(ranked_rows.select("document_id"), "document_id", "left_semi"))
    lift = F.coalesce(F.col("authority_score"), F.lit(0)) / 100 * 0.12 + F.when(F.col("review_status") == "approved", 0.08).when(F.col("review_status") == "needs_review", -0.04).otherwise(0.0)
    score = F.round(F.least(F.greatest(F.col("relevance") + lift, F.lit(0.0)), F.lit(1.5)), 6)
    return (ranked_rows.join(docs.select("document_id", "title", "authority_score", "review_status"), "document_id").join(rolled.select("document_id", "snippets"), "document_id", "left")
            .select("document_id", "title", score.alias("smart_score"), "snippets").orderBy(F.desc("smart_score"), "document_id").limit(limit))
