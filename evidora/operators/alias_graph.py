"""What questions name, the scope that follows from it, and the governed documents and chunks that name the same.

Entities come as a table: entity, kind, weight, aliases, scope (the project it stands
for), doc_types (that it points to), only_project (to which it belongs), and adds with
adds_for (projects to look into as well, if no project or the one of ``adds_for`` is
named).  All aliases are found in one pass over a text by an automaton that each task
builds once, so ten thousand aliases cost about what ten do; an alias counts where no
letter or digit stands on either side.  A table of more than ``AT_ONCE`` aliases is
gone through in parts, each an automaton of that size.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions.columns import fold
from evidora.operators.governance import retrievable
from evidora.sources.versions import staged

AT_ONCE = 50_000         # aliases of an automaton: a few MB in each task
LEAST_DOC, LEAST_CHUNK = 3, 7
TOP_DOCS, TOP_CHUNKS = 32, 28
WORDS = 8                # points that a chunk can have for a question's words
ENTITY = "entity string, kind string, weight int, aliases array<string>, scope string, doc_types array<string>, only_project string, adds array<string>, adds_for string"


def _automata(entities: DataFrame):
    """(alias, entity) lists of at most ``AT_ONCE`` aliases each, in the order of the aliases."""
    pairs = entities.select(F.explode("aliases").alias("a"), "entity").select(fold(F.trim("a")).alias("alias"), "entity").where(F.length("alias") >= 2).distinct().orderBy("alias", "entity")
    part: list[tuple[str, str]] = []
    for r in pairs.toLocalIterator():
        part.append((r.alias, r.entity))
        if len(part) == AT_ONCE:
            yield part
            part = []
    if part:
        yield part


def named(texts: DataFrame, entities: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key`` and entities (sorted) of every text that names any."""
    out = None
    for part in _automata(entities):
        found = _scan(texts.select(F.col(key).cast("long").alias(key), fold(F.col(text)).alias("t")), part, key)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return texts.select(F.col(key).cast("long").alias(key), F.array().cast("array<string>").alias("entities")).where("false")
    # One row a key already, unless the aliases were too many for one pass.
    return out.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("entities"))


def _scan(rows: DataFrame, pairs: list[tuple[str, str]], key: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(pairs)

    def run(batches):
        owners: dict[str, list[str]] = {}
        for alias, entity in shared.value:
            owners.setdefault(alias, []).append(entity)
        automaton = ahocorasick.Automaton()
        for alias, of in owners.items():
            automaton.add_word(alias, (len(alias), of))
        automaton.make_automaton()
        inside = lambda t, i: 0 <= i < len(t) and (t[i].isascii() and t[i].isalnum())
        for b in batches:
            keys, lists = [], []
            for k, t in zip(b.column(key).to_pylist(), b.column("t").to_pylist(), strict=True):
                hit = set()
                for end, (length, of) in automaton.iter(t or ""):
                    if not inside(t, end + 1) and not inside(t, end - length):
                        hit.update(of)
                if hit:
                    keys.append(k)
                    lists.append(sorted(hit))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.string()))], [key, "entities"])

    return rows.mapInArrow(run, f"`{key}` long, entities array<string>")


def understood(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, entities, scopes and types of the questions (query_id, text and, where asked for, project and doc_type) that can be looked up.

    A question that asks for a project keeps it, and has no result if what it names belongs to others only; else its scopes
    are the projects that it names.  Types are the asked one, or those that its entities point to.  A question without
    entities, or with neither scopes nor types, is left out.
    """
    for f in ("project", "doc_type"):
        if f not in questions.columns:
            questions = questions.withColumn(f, F.lit(None).cast("string"))
    about = entities.select("entity", "kind", "weight", "scope", "doc_types", "only_project", "adds", "adds_for")
    said = named(questions, entities, "query_id").select("query_id", F.explode("entities").alias("entity")).join(about, "entity")
    none = F.array().cast("array<string>")
    lists = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(c), none)))))
    of = said.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("entity", "kind", "weight"))).alias("entities"), F.array_sort(F.collect_set("scope")).alias("own"), lists("doc_types").alias("pointed"),
                                      F.collect_set(F.coalesce("only_project", "scope")).alias("belongs"), F.collect_list(F.when(F.col("adds").isNotNull(), F.struct("adds", "adds_for"))).alias("more"))
    q = questions.join(of, "query_id")
    named_scopes = F.when(F.col("project").isNotNull(), F.array("project")).otherwise(F.col("own"))
    q = q.withColumn("first", named_scopes)
    added = F.flatten(F.transform(F.filter("more", lambda m: (F.size("first") == 0) | F.array_contains(F.col("first"), m.adds_for)), lambda m: m.adds))
    scopes = F.array_sort(F.array_distinct(F.concat("first", added)))
    types = F.when(F.col("doc_type").isNotNull(), F.array("doc_type")).otherwise(F.col("pointed"))
    elsewhere = F.col("project").isNotNull() & (F.size("belongs") > 0) & ~F.array_contains("belongs", F.col("project"))
    return q.where(~elsewhere).select("query_id", "text", "entities", scopes.alias("scopes"), types.alias("types")).where((F.size("scopes") > 0) | (F.size("types") > 0))


def _weight(own: str, held: str):
    """The summed weight of a question's entities that a text holds, and how many there are."""
    both = F.filter(own, lambda e: F.array_contains(F.col(held), e.entity))
    return F.aggregate(both, F.lit(0).cast("long"), lambda s, e: s + e.weight), F.size(both)


def documents_for(understood_questions: DataFrame, docs: DataFrame, entities: DataFrame, top: int = TOP_DOCS) -> DataFrame:
    """query_id, document_id and doc_score: the best governed documents within each question's scopes and types."""
    live = docs.where(retrievable())
    about = live.select("document_id", F.concat_ws(" ", "title", "project_id", "doc_type").alias("text"))
    live = live.select("document_id", "project_id", "doc_type", "review_status", "authority_score").join(named(about, entities, "document_id"), "document_id", "left").withColumn("held", F.coalesce("entities", F.array().cast("array<string>"))).drop("entities")
    q = understood_questions
    scoped = q.where(F.size("scopes") > 0).withColumn("project_id", F.explode("scopes")).join(live, "project_id").where((F.size("types") == 0) | F.array_contains("types", F.col("doc_type")))
    typed = q.where(F.size("scopes") == 0).withColumn("doc_type", F.explode("types")).join(live, "doc_type")
    columns = ["query_id", "document_id", "entities", "types", "held", "review_status", "authority_score"]
    rows = scoped.select(*columns).unionByName(typed.select(*columns))
    weight, _ = _weight("entities", "held")
    bonus = F.when(F.col("review_status") == "approved", 3).otherwise(0) + F.when(F.col("authority_score") >= 90, 3).when(F.col("authority_score") >= 75, 1).otherwise(0)
    rows = rows.withColumn("doc_score", weight + bonus).where((F.col("doc_score") >= LEAST_DOC) | (F.size("types") > 0))
    best = Window.partitionBy("query_id").orderBy(F.desc("doc_score"), "document_id")
    return rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).select("query_id", "document_id", "doc_score")


def _profiles(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct entities, scopes and types of understood questions, numbered by ``query_id`` (the least of their questions), and each question's profile."""
    same = ["entities", "scopes", "types"]
    profiles = asked.groupBy(*same).agg(F.min("query_id").alias("profile"))
    return profiles.withColumnRenamed("profile", "query_id"), asked.join(profiles, same).select(F.col("query_id"), "text", "profile")


def expand(chunks: DataFrame, docs: DataFrame, questions: DataFrame, entities: DataFrame, top: int = TOP_CHUNKS) -> DataFrame:
    """query_id, chunk_id, document_id, score, similarity and place of the chunks that name what a question names.

    A chunk has 0.45 of its document's score, the weights of the question's entities that its title and text hold, a point for
    each of up to eight of the question's longer words, and four more from two and again from three entities on.
    """
    profiles, asked = _profiles(staged(understood(questions, entities), "understood"))
    profiles = staged(profiles, "profiles")
    # What a document or a chunk has by a question's entities, scopes and types is the same for all questions of a profile.
    found = staged(documents_for(profiles, docs, entities), "graph-documents").withColumnRenamed("query_id", "profile")
    some = staged(found.select("document_id").distinct(), "graph-ids")  # a profile has ``TOP_DOCS`` documents at most
    titled = chunks.join(some, "document_id", "left_semi").join(docs.join(some, "document_id", "left_semi").select("document_id", "title"), "document_id")
    titled = staged(titled.select("chunk_id", "document_id", fold(F.concat_ws(" ", "title", "content")).alias("text")), "graph-chunks")
    rows = titled.join(named(titled, entities, "chunk_id"), "chunk_id", "left").withColumn("held", F.coalesce("entities", F.array().cast("array<string>"))).drop("entities")
    of = profiles.select(F.col("query_id").alias("profile"), "entities")
    weight, kinds = _weight("entities", "held")
    base = 0.45 * F.col("doc_score") + weight + F.when(kinds >= 3, 8).when(kinds >= 2, 4).otherwise(0)
    offered = staged(found.join(of, "profile").join(rows, "document_id").select("profile", "document_id", "chunk_id", base.cast("double").alias("base")), "graph-offered")
    # A chunk gains ``WORDS`` at most, so one that is further behind the last that is wanted can't come in.
    order = Window.partitionBy("profile").orderBy(F.desc("base"), "chunk_id")
    last = offered.withColumn("r", F.row_number().over(order)).where(F.col("r") == top).select("profile", F.col("base").alias("last"))
    offered = staged(offered.join(last, "profile", "left").where((F.coalesce("last", F.lit(float("-inf"))) <= F.col("base") + WORDS + 1e-3) & (F.col("base") + WORDS + 1e-3 >= LEAST_CHUNK)).drop("last"), "graph-offered")
    words = F.array_distinct(F.filter(F.split(fold(F.col("text")), "[^a-z0-9]+"), lambda w: F.length(w) >= 4))
    said = staged(asked.select("query_id", "profile", F.explode(words).alias("word")), "graph-words")
    wanted = offered.select("chunk_id").distinct()
    held = _held_words(titled.join(wanted, "chunk_id", "left_semi"), said.select("word").distinct())
    hits = said.join(held.join(offered.select("profile", "chunk_id"), "chunk_id"), ["profile", "word"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("hits"))
    both = asked.select("query_id", "profile").join(offered, "profile").join(hits, ["query_id", "chunk_id"], "left")
    score = F.col("base") + F.least(F.lit(WORDS), F.coalesce("hits", F.lit(0)))
    scored = both.withColumn("score", F.round(score, 4)).where(F.col("score") >= LEAST_CHUNK)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    similarity = F.round(F.least(F.greatest(0.52 + F.col("score") / 42, F.lit(0.52)), F.lit(0.98)), 6)
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).select("query_id", "chunk_id", "document_id", "score", similarity.alias("similarity"), "place")


def _held_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """chunk_id and word for each of the distinct ``words`` that a text (chunk_id, text) holds anywhere, by one automaton for ``AT_ONCE`` words."""
    out = None
    part: list[str] = []

    def scan(part):
        shared = texts.sparkSession.sparkContext.broadcast(part)

        def run(batches):
            automaton = ahocorasick.Automaton()
            for word in shared.value:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for b in batches:
                keys, found = [], []
                for k, t in zip(b.column("chunk_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    hit = {w for _, w in automaton.iter(t or "")}
                    keys += [k] * len(hit)
                    found += hit
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string())], ["chunk_id", "word"])

        return texts.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text").mapInArrow(run, "chunk_id long, word string")

    for r in words.toLocalIterator():
        part.append(r.word)
        if len(part) == AT_ONCE:
            out = scan(part) if out is None else out.unionByName(scan(part))
            part = []
    if part or out is None:
        out = (scan(part) if out is None else out.unionByName(scan(part))) if part else texts.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lit("").alias("word")).where("false")
    return out
