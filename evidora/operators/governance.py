"""Document governance: who may be retrieved, how far a source is trusted, and how a document's state changes.

Every function maps DataFrames to DataFrames; a change of state is a new frame of
documents and a frame of events, never an update in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions.columns import first_rule, ratio

HUMAN_VALIDATED = ("user", "admin", "import")
TIER_OF_SCORE = ((95, "audited"), (90, "executed"), (80, "controller"), (70, "board_pack"), (60, "dd_memo"), (40, "internal"), (10, "narrative"))
# What a tier stands for where no score is given (fixed values).
SCORE_OF_TIER = {"audited": 100, "executed": 90, "controller": 80, "board_pack": 70, "dd_memo": 60, "internal": 40, "narrative": 10, "unverified": 0}
TRUST = {"source_of_record": 3, "supporting": 2, "context": 1, "unverified": 0}
FINAL_LIFECYCLES = ("executed", "signed", "filed", "audited")
STICKY_TIERS = ("audited", "executed", "controller")
HIGH_STAKES = ("funding", "board", "legal")
# Columns that a chunk always has from its document, null or not.
GOVERNED = ("review_status", "classification_source", "status", "lifecycle", "authority_score", "confidence", "source_channel", "current_version", "md_path", "storage_path")
TITLE_TYPES = ((r"(?i)\bboard\b", "board"), (r"(?i)\b(loan|funding|facility)\b", "funding"), (r"(?i)\bcapex\b", "capex"), (r"(?i)\bcash ?flow\b", "cash_flow"),
               (r"(?i)\bbusiness plan\b", "bp_model"), (r"(?i)\bannual accounts\b", "financial_statements"), (r"(?i)\btax\b", "tax"), (r"(?i)\bdue diligence\b", "dd"), (r"(?i)\blegal\b", "legal"))


def retrievable() -> Column:
    """Whether a document may be retrieved; one without a review status may not."""
    return ((F.col("review_status") != "rejected") & ~F.col("classification_source").eqNullSafe(F.lit("agent_rejected"))
            & (F.col("status") == "indexed") & ~F.col("lifecycle").eqNullSafe(F.lit("superseded")))


def tier_of_score(score: Column) -> Column:
    out = F.lit("unverified")
    for least, tier in reversed(TIER_OF_SCORE):
        out = F.when(score >= least, tier).otherwise(out)
    return out


def verification_tier() -> Column:
    validated = F.col("classification_source").isin(*HUMAN_VALIDATED)
    approved = F.col("review_status") == "approved"
    return (F.when(F.col("review_status").eqNullSafe(F.lit("rejected")) | F.col("authority_score").isNull(), "unverified")
            .when((F.col("authority_score") >= 90) & approved & validated, "source_of_record")
            .when((F.col("authority_score") >= 75) & approved, "supporting").otherwise("context"))


def trust(tier: Column) -> Column:
    out = F.lit(0)
    for name, value in TRUST.items():
        out = F.when(tier == name, value).otherwise(out)
    return out


def overlay(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with their document's metadata: the document's project, type and period where it has them, its governance columns always."""
    parent = docs.select("document_id", "project_id", "doc_type", "period", *GOVERNED)
    return (chunks.join(parent, "document_id")
            .select("chunk_id", "document_id", F.coalesce("project_id", "chunk_project").alias("project_id"), F.coalesce("doc_type", "chunk_doc_type").alias("doc_type"),
                    F.coalesce("period", "chunk_period").alias("period"), *GOVERNED))


def grounded(docs: DataFrame, mode: str) -> DataFrame:
    """``standard`` keeps all, ``trusted_only`` supporting sources and better, ``official_only`` sources of record."""
    least = {"standard": 0, "trusted_only": 2, "official_only": 3}[mode]
    return docs.where(trust(verification_tier()) >= least)


def triage(docs: DataFrame, aggressive: bool = False) -> DataFrame:
    """``decision`` for each document: approved or needs_review, by tier, confidence and type."""
    tier, typed = F.col("authority_tier"), F.col("doc_type").isNotNull() & ~F.col("doc_type").isin("other", "general")
    sticky = tier.isin(*STICKY_TIERS)
    approve = (sticky | ((F.col("confidence") >= 0.5) & (tier != "unverified"))) & typed
    if aggressive:
        final = F.coalesce(F.col("lifecycle").isin(*FINAL_LIFECYCLES), F.lit(False))
        approve = approve | (typed & F.when(final, F.col("confidence") >= 0.6).otherwise(F.col("confidence") >= 0.75))
    return docs.withColumn("decision", F.when(approve, "approved").otherwise("needs_review"))


def finalise_backlog(docs: DataFrame) -> DataFrame:
    """What becomes of each document that still needs review: approve, downgrade or keep."""
    risky = F.coalesce(F.col("doc_type").isin(*HIGH_STAKES), F.lit(False))
    return (docs.where("review_status = 'needs_review'")
            .withColumn("outcome", F.when(~risky & (F.col("confidence") >= 0.7), "approve").when(risky & (F.col("confidence") >= 0.8), "downgrade").otherwise("keep")))


def score_of_tier(tier: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, score in SCORE_OF_TIER.items():
        out = F.when(tier == name, score).otherwise(out)
    return out


def transition(docs: DataFrame, actions: DataFrame, doc_types, lifecycles) -> DataFrame:
    """One action a document: its state afterwards, or why a guard forbids it; then the state is as it was.

    ``actions`` has document_id, action, old_id (what a supersede replaces) and what a reclassify sets: new_doc_type,
    new_period, new_lifecycle, new_tier and new_score, null where it leaves them.  A score given without a tier names the
    tier, and a tier without a score the score.  ``events`` counts the audit events that the action leaves.
    """
    old = docs.select(F.col("document_id").alias("old_id"), F.col("current_version").alias("old_version"))
    both = docs.join(actions, "document_id").join(old, "old_id", "left")
    act = lambda name: F.col("action") == name
    said_no = F.col("classification_source").eqNullSafe(F.lit("agent_rejected"))
    rejected, retired, gone = F.col("review_status").eqNullSafe(F.lit("rejected")), F.col("status").eqNullSafe(F.lit("retired")), F.col("lifecycle").eqNullSafe(F.lit("superseded"))
    fields = ("new_doc_type", "new_period", "new_lifecycle", "new_tier", "new_score")
    none_set = F.coalesce(*(F.col(c).cast("string") for c in fields)).isNull()
    guards = (("approve", said_no, "rejected by the agent"), ("endorse", said_no, "rejected by the agent"), ("endorse", F.coalesce(F.col("authority_score"), F.lit(0)) < 90, "authority below 90"),
              ("endorse", retired | rejected, "not live"), ("reject", rejected, "already rejected"), ("reclassify", none_set, "nothing to set"),
              ("reclassify", ~F.coalesce("new_doc_type", F.lit(doc_types[0])).isin(*doc_types), "unknown type"), ("reclassify", ~F.coalesce("new_lifecycle", F.lit(lifecycles[0])).isin(*lifecycles), "unknown lifecycle"),
              ("reclassify", ~F.coalesce("new_tier", F.lit("audited")).isin(*SCORE_OF_TIER), "unknown tier"), ("retire", retired, "already retired"), ("restore", ~retired, "not retired"), ("restore", gone, "superseded"),
              ("supersede", F.col("old_id").isNull(), "replaces nothing"), ("supersede", F.col("old_id") == F.col("document_id"), "replaces itself"), ("supersede", F.col("old_version").isNull(), "replaces nothing known"),
              ("supersede", (F.coalesce("status", F.lit("")) != "indexed") | rejected, "not live"))
    error = F.lit(None).cast("string")
    for name, holds, text in reversed(guards):
        error = F.when(act(name) & holds, text).otherwise(error)
    both = both.withColumn("error", error)
    ok = F.col("error").isNull()
    sets = lambda c: F.when(ok & act("reclassify") & F.col(f"new_{c}").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    official = ok & act("endorse") | ok & act("approve")
    source = F.when(official & ~F.coalesce(F.col("classification_source").isin(*HUMAN_VALIDATED), F.lit(False)), "agent_reviewed").when(ok & act("reclassify"), "agent_corrected").otherwise(F.col("classification_source"))
    re = ok & act("reclassify")
    score = F.when(re & F.col("new_score").isNotNull(), F.col("new_score")).when(re & F.col("new_tier").isNotNull(), score_of_tier(F.col("new_tier"))).otherwise(F.col("authority_score"))
    tier = F.when(re & F.col("new_tier").isNotNull(), F.col("new_tier")).when(re & F.col("new_score").isNotNull(), tier_of_score(F.col("new_score"))).otherwise(F.col("authority_tier"))
    one = lambda c: F.when(c, 1).otherwise(0)
    told = (1 + one(F.col("new_doc_type").isNotNull()) + one(F.col("new_period").isNotNull()) + one(F.col("new_lifecycle").isNotNull())
            + F.when(F.col("new_tier").isNotNull(), 2).when(F.col("new_score").isNotNull(), 1 + one(tier_of_score(F.col("new_score")) != F.coalesce("authority_tier", F.lit("")))).otherwise(0))
    return both.select("document_id", "action", "error", F.when(official, "approved").when(ok & act("reject"), "rejected").otherwise(F.col("review_status")).alias("review_status"), source.alias("classification_source"),
                       F.when(ok & act("retire"), "retired").when(ok & act("restore"), "indexed").otherwise(F.col("status")).alias("status"), sets("lifecycle"), sets("doc_type"), sets("period"), tier.alias("authority_tier"), score.alias("authority_score"),
                       F.when(ok & act("supersede"), F.col("old_id")).alias("supersedes_document_id"),
                       F.when(ok & act("supersede"), F.greatest(F.col("current_version"), F.col("old_version")) + 1).when(ok, F.col("current_version") + 1).otherwise(F.col("current_version")).alias("current_version"),
                       F.when(~ok, 0).when(act("reclassify"), told).when(act("supersede"), 3).otherwise(1).alias("events"))


def superseded(after: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents that accepted supersedes replaced: retired, with their lifecycle; the first of several by id counts."""
    by = after.where("supersedes_document_id is not null").groupBy(F.col("supersedes_document_id").alias("document_id")).agg(F.min("document_id").alias("superseded_by"))
    return docs.select("document_id", F.col("status").alias("old_status"), F.col("lifecycle").alias("old_lifecycle")).join(by, "document_id").withColumns({"status": F.lit("retired"), "lifecycle": F.lit("superseded")})


def apply_changes(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Ordered changes (document_id, seq, expected_version, review_status, doc_type, clears_type) applied one after the other.

    A change is refused where it expects another version than it finds.  A null review_status leaves it as it is; doc_type is
    set where given and set to null where ``clears_type``: a key that is there with null differs from one that is not.
    Every accepted change is a new version.  A document's changes are folded in one row, so they should be few.
    """
    ordered = changes.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("seq", "expected_version", "review_status", "doc_type", "clears_type"))).alias("changes"))

    def step(state, c):
        ok = c["expected_version"].isNull() | (c["expected_version"] == state["version"])
        kind = F.when(c["clears_type"], F.lit(None).cast("string")).otherwise(F.coalesce(c["doc_type"], state["doc_type"]))
        return F.struct((state["version"] + F.when(ok, 1).otherwise(0)).cast("int").alias("version"), F.when(ok, F.coalesce(c["review_status"], state["review_status"])).otherwise(state["review_status"]).alias("review_status"),
                        F.when(ok, kind).otherwise(state["doc_type"]).alias("doc_type"), (state["applied"] + F.when(ok, 1).otherwise(0)).cast("int").alias("applied"))

    start = F.struct(F.col("current_version").alias("version"), "review_status", "doc_type", F.lit(0).alias("applied"))
    out = docs.select("document_id", "current_version", "review_status", "doc_type").join(ordered, "document_id").select("document_id", F.size("changes").alias("asked"), F.aggregate("changes", start, step).alias("s"))
    return out.select("document_id", "s.version", "s.review_status", "s.doc_type", "s.applied", (F.col("asked") - F.col("s.applied")).alias("refused"))


def revert(docs: DataFrame, events: DataFrame) -> DataFrame:
    """Restore what the oldest event of each document replaced, where the document still has what its newest event set."""
    ends = events.groupBy("document_id").agg(F.min_by("old_value", "event_id").alias("old_value"), F.max_by("new_value", "event_id").alias("new_value"))
    return (docs.join(ends, "document_id").withColumn("reverted", F.col("review_status").eqNullSafe(F.col("new_value")))
            .select("document_id", F.when(F.col("reverted"), F.col("old_value")).otherwise(F.col("review_status")).alias("review_status"), "reverted"))


def corpus_health(docs: DataFrame) -> DataFrame:
    """One row of counts and ratios over all documents."""
    live = ~F.col("lifecycle").eqNullSafe(F.lit("superseded"))
    return docs.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("review_status") == "approved").alias("approved"), F.count_if(F.col("review_status") == "needs_review").alias("needs_review"),
        F.count_if(F.col("review_status") == "rejected").alias("rejected"), F.count_if(live & (F.col("authority_score") >= 90) & (F.col("review_status") == "approved")).alias("source_of_record"),
        F.count_if(F.col("md_path").isNotNull()).alias("with_markdown"), F.coalesce(F.sum(F.when(F.col("status") == "indexed", F.col("chunk_count"))), F.lit(0)).alias("chunks"),
        F.round(F.avg("authority_score"), 4).alias("avg_authority"), ratio(F.count_if(F.col("md_path").isNotNull()), F.count("*")).alias("pct_markdown"))


def modes(chunks: DataFrame, column: str) -> DataFrame:
    """Each document's most frequent value of a column (ties to the smaller value) and its share of the chunks that have one."""
    counts = chunks.where(F.col(column).isNotNull()).groupBy("document_id", column).count()
    best = Window.partitionBy("document_id").orderBy(F.desc("count"), column)
    whole = Window.partitionBy("document_id")
    return (counts.withColumn("rank", F.row_number().over(best)).withColumn("total", F.sum("count").over(whole)).where("rank = 1")
            .select("document_id", F.col(column), F.round(F.col("count") / F.col("total"), 4).alias(f"{column}_share")))


def lift_up(chunks: DataFrame) -> DataFrame:
    """Metadata of a document from its chunks: largest valid authority, modes and their shares."""
    best = chunks.groupBy("document_id").agg(F.max(F.when(F.col("chunk_authority").between(0, 100), F.col("chunk_authority"))).alias("authority_score"))
    return best.join(modes(chunks, "chunk_project"), "document_id", "left").join(modes(chunks, "chunk_doc_type"), "document_id", "left")


def title_types(docs: DataFrame) -> DataFrame:
    """``new_type`` from the title where the document has no useful type."""
    vague = F.col("doc_type").isNull() | F.col("doc_type").isin("general", "unknown", "")
    return docs.withColumn("new_type", F.when(vague, F.coalesce(first_rule(F.col("title"), TITLE_TYPES), F.lit("unknown"))).otherwise(F.col("doc_type")))
