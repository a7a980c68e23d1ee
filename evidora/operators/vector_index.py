"""Nearest neighbours through cells: an index of vectors, probed in waves until enough rows pass a question's filters.

``build`` fits centroids on a bounded sample and writes every vector into the folder of
its nearest centroid, so a probe reads the folders of a few cells and nothing else.
``search`` takes a table of questions.  Each wave looks into the next cells of every
question that is not settled yet, twice as many as the wave before; rows that governance
or a question's own filters exclude never count, so a narrow filter makes a question go
on instead of coming back with too few rows.  A question is settled when it has its k
rows after the calibrated number of cells, or all cells are done.  With ``exact`` it is
settled when no vector of a cell that is left can be better than its k-th: the angle to a
vector is at least that to the cell's centroid less the cell's widest angle.

In a wave the vectors of a cell and the questions that look into it meet in blocks, so a
cell or a question list of any size is spread over tasks.  Questions with the same vector
and filters are one question until their rows are known.

Cases: a vector that is null, empty, all zero or not finite is in no cell, and such a
question has no rows; a vector of another length than the first takes no part; of equal
similarities the higher authority, the later date and the smaller id come first.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidora.operators.governance import retrievable
from evidora.sources.versions import Files, staged

SAMPLE = 65536           # vectors that centroids are fitted on, about, at most
MAX_CELLS = 4096         # so a list of cells is small wherever it goes
ROUNDS = 12              # of k-means
CALIBRATION = 200        # stored vectors whose neighbours say how many cells to probe
RECALL = 0.95            # of the calibration's neighbours within those cells
BLOCK = 1024             # vectors, or questions, of a block
NO_DATE = -(1 << 31)


def usable(vector: Column) -> Column:
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce((square > 0) & (square < float("inf")), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def centroids_of(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit vectors, scored in blocks; a cell that is left empty takes the vector that is worst placed."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), cells, replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        sums, held, worst = np.zeros_like(c), np.zeros(cells, int), np.empty(len(sample))
        for i in range(0, len(sample), BLOCK):
            part = sample[i:i + BLOCK]
            score = part @ c.T
            at = score.argmax(1)
            np.add.at(sums, at, part)
            held += np.bincount(at, minlength=cells)
            worst[i:i + BLOCK] = score.max(1)
        empty = np.flatnonzero(held == 0)
        sums[empty] = sample[np.argsort(worst)[:len(empty)]]
        c = _unit(sums + 1e-12)
    return c


def _sample(vectors: DataFrame, n: int) -> np.ndarray:
    """About ``SAMPLE`` of ``n`` usable vectors by a hash of their ids, in the order of their ids, as unit vectors; they come as Arrow batches of floats."""
    part = min(1.0, SAMPLE / max(n, 1))
    rows = vectors.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 30)) < int(part * (1 << 30))).select("vec_id", "embedding").toArrow()
    if not rows.num_rows:
        return np.zeros((0, 1), np.float32)
    column = rows.column("embedding").combine_chunks()
    points = column.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)[np.argsort(rows.column("vec_id").to_numpy(), kind="stable")]
    for i in range(0, len(points), BLOCK):
        points[i:i + BLOCK] = _unit(points[i:i + BLOCK].astype(np.float64))
    return points


@dataclass
class VectorIndex:
    """An index on disk: rows by cell, and what is known of its cells (at most ``MAX_CELLS``)."""

    rows: DataFrame          # cell, vec_id, embedding
    centroids: np.ndarray
    widest: np.ndarray       # the largest angle of a vector to its centroid, by cell
    counts: np.ndarray
    probes: int              # cells within which the calibration found ``RECALL`` of all neighbours


def build(vectors: DataFrame, path: str, cells: int | None = None, k: int = 10, recall: float = RECALL) -> VectorIndex:
    """Write the index of ``vectors`` (vec_id, embedding) to a folder."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where(usable(F.col("embedding")))
    first = v.agg(F.min_by(F.size("embedding"), F.struct(F.xxhash64(F.lit(3), "vec_id"), "vec_id")).alias("dim")).first()
    dim = first.dim or 0
    n = v.where(F.size("embedding") == dim).count()
    points = _sample(v.where(F.size("embedding") == dim), n)
    cells = max(1, min(cells or int(np.ceil(np.sqrt(n))), MAX_CELLS, max(len(points) // 4, 1)))
    c = centroids_of(points, cells) if len(points) else np.zeros((1, 1))

    def assign(batches):
        for b in batches:
            if b.num_rows:
                score = _unit(_matrix(b.column("embedding"), dim)) @ c.T
                at = score.argmax(1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(at.astype(np.int32)), pa.array(np.arccos(np.clip(score[np.arange(len(at)), at], -1, 1)))], ["vec_id", "embedding", "cell", "angle"])

    placed = v.where(F.size("embedding") == dim).mapInArrow(assign, "vec_id long, embedding array<float>, cell int, angle double")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")  # a large cell gets several files
    rows = _rows(spark, path)
    facts = {r.cell: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}
    index = VectorIndex(rows.select("cell", "vec_id", "embedding"), c, np.array([facts[i].angle if i in facts else 0.0 for i in range(cells)]), np.array([facts[i].n if i in facts else 0 for i in range(cells)]), cells)
    index.probes = _calibrated(index, k, recall)
    saved = {"centroids": c.tolist(), "widest": index.widest.tolist(), "counts": index.counts.tolist(), "probes": index.probes}
    Files(spark, path).write(f"{path}/cells.json", json.dumps(saved))
    return index


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id long, embedding array<float>, angle double, cell int").parquet(f"{path}/rows")


def load(spark: SparkSession, path: str) -> VectorIndex:
    s = json.loads(Files(spark, path).read(f"{path}/cells.json"))
    return VectorIndex(_rows(spark, path).select("cell", "vec_id", "embedding"), np.array(s["centroids"]), np.array(s["widest"]), np.array(s["counts"]), s["probes"])


def _calibrated(index: VectorIndex, k: int, recall: float) -> int:
    """How many cells hold the asked share of the true neighbours of some stored vectors, whose neighbours are found in all cells."""
    asked = index.rows.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(CALIBRATION).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    asked = asked.sparkSession.createDataFrame(asked.collect(), "query_id long, q array<float>")
    every = index.rows.select("vec_id", *_no_filters())
    found = search(index, asked, every, k + 1, -1.0, exact=True).join(index.rows.select("vec_id", "cell"), "vec_id").where("vec_id <> query_id").groupBy("query_id").agg(F.collect_list("cell").alias("cells")).collect()
    at = {r.query_id: _unit(np.array([r.q], np.float64)) for r in asked.collect()}
    needed = []
    for r in found:
        place = np.empty(len(index.centroids), int)
        place[np.argsort(-(at[r.query_id] @ index.centroids.T)[0], kind="stable")] = np.arange(len(index.centroids))
        needed += [int(place[c]) + 1 for c in r.cells]
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


def _no_filters():
    return [F.lit(None).cast("string").alias("project"), F.lit(None).cast("string").alias("doc_type"), F.lit(None).cast("int").alias("authority"), F.lit(None).cast("date").alias("created")]


def allowed(docs: DataFrame) -> DataFrame:
    """vec_id, project, doc_type, authority and created of the documents that may be retrieved; a document's vector has its id."""
    return docs.where(retrievable()).select(F.col("document_id").alias("vec_id"), F.col("project_id").alias("project"), "doc_type", F.col("authority_score").cast("int").alias("authority"), F.col("created_at").cast("date").alias("created"))


def _probes(active: DataFrame, index: VectorIndex, first: int, last: int, exact: bool) -> DataFrame:
    """The cells with places from ``first`` up to ``last`` in each question's own order; in exact search those only that could still matter."""
    c, widest, held = index.centroids, index.widest, index.counts > 0
    dim = c.shape[1]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            score = _unit(_matrix(b.column("q"), dim)) @ c.T
            order = np.argsort(-score, axis=1, kind="stable")[:, first:last]
            row = np.repeat(np.arange(len(order)), order.shape[1])
            cell = order.ravel()
            keep = held[cell]
            if exact:
                angle = np.arccos(np.clip(score[row, cell], -1, 1))
                keep &= np.cos(np.maximum(angle - widest[cell], 0)) >= b.column("floor").to_numpy(zero_copy_only=False)[row] - 1e-6
            at = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(at) for x in ("query_id", "q", "project", "doc_type")), pa.array(cell[keep].astype(np.int32))], ["query_id", "q", "project", "doc_type", "cell"])

    return active.select("query_id", "q", "project", "doc_type", "floor").mapInArrow(run, "query_id long, q array<float>, project string, doc_type string, cell int")


def _blocks(rows: DataFrame, key: str, item: Column, name: str) -> DataFrame:
    """``rows`` of each cell in blocks of about ``BLOCK``, as lists of structs."""
    many = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("many"))  # a row for each cell, MAX_CELLS at most
    dealt = rows.join(F.broadcast(many), "cell").withColumn("block", F.pmod(F.xxhash64(F.lit(9), key), F.col("many")))
    return dealt.groupBy("cell", "block").agg(F.collect_list(item).alias(name)).drop("block")


def _met(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """Each block of a cell's rows (r) with each block of the questions that look into it (p).

    Both sides go through a shuffle by cell: a probe's file is far smaller than the probes, as a question's vector stands there once
    for each of its cells, so by the file's size Spark would send all blocks through the driver to every executor.
    """
    code = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c)
    item = F.struct("vec_id", "embedding", code("project"), code("doc_type"), F.coalesce("authority", F.lit(-1)).alias("authority"), F.coalesce(F.unix_date("created"), F.lit(NO_DATE)).alias("created"))
    asked = _blocks(probes, "query_id", F.struct("query_id", "q", code("project"), code("doc_type")), "p")
    return asked.join(_blocks(rows, "vec_id", item, "r").hint("merge"), "cell").select("r", "p")  # a merge holds what is on the right of a cell: its rows


def _scored(rows: DataFrame, probes: DataFrame, k: int, threshold: float, dim: int) -> DataFrame:
    """The best k of each question in each pair of blocks: query_id, vec_id, similarity, authority, created."""

    def run(batches):
        for b in batches:
            for r, p in zip(b.column("r"), b.column("p"), strict=True):
                r, p = r.values, p.values
                x, q = _matrix(r.field("embedding"), dim), _matrix(p.field("q"), dim)
                s = np.round((q @ x.T) / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None, :], 6)
                fits = s >= threshold
                for f in ("project", "doc_type"):
                    own, want = r.field(f), p.field(f)
                    free = want.is_null().to_numpy(zero_copy_only=False)[:, None]
                    same = (want.fill_null(0).to_numpy()[:, None] == own.fill_null(0).to_numpy()[None, :]) & own.is_valid().to_numpy(zero_copy_only=False)[None, :]
                    fits &= free | same
                i, j = np.nonzero(fits)
                ids, authority, created = (r.field(f).to_numpy(zero_copy_only=False) for f in ("vec_id", "authority", "created"))
                order = np.lexsort((ids[j], -created[j].astype(np.int64), -authority[j].astype(np.int64), -s[i, j], i))
                i, j = i[order], j[order]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[top], j[top]
                yield pa.RecordBatch.from_arrays([p.field("query_id").take(pa.array(i)), pa.array(ids[j]), pa.array(s[i, j]), pa.array(authority[j].astype(np.int32)), pa.array(created[j].astype(np.int32))], ["query_id", "vec_id", "similarity", "authority", "created"])

    return _met(rows, probes).mapInArrow(run, "query_id long, vec_id long, similarity double, authority int, created int")


def search(index: VectorIndex, questions: DataFrame, rows: DataFrame, k: int = 25, threshold: float = 0.18, exact: bool = False) -> DataFrame:
    """query_id, vec_id, similarity and place of the k best rows of every question.

    ``questions`` has query_id (one row each), q and, where a question asks for one, project and doc_type; ``rows`` are the
    rows that may be found at all, as :func:`allowed` gives them.
    """
    dim, cells = index.centroids.shape[1], len(index.centroids)
    for f in ("project", "doc_type"):
        if f not in questions.columns:
            questions = questions.withColumn(f, F.lit(None).cast("string"))
    asked = questions.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<float>").alias("q"), "project", "doc_type")
    asked = staged(asked.where(usable(F.col("q")) & (F.size("q") == dim)), "asked")
    # Questions that ask for the same are searched once, by the smallest of their ids.
    active = staged(asked.groupBy("q", "project", "doc_type").agg(F.min("query_id").alias("query_id")).select("query_id", "q", "project", "doc_type", F.lit(float(threshold)).alias("floor")), "questions")
    best, first, width = None, 0, min(index.probes, cells)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("authority"), F.desc("created"), "vec_id")
    whole = active
    while first < cells:
        last = min(first + width, cells)
        probes = staged(_probes(active, index, first, last, exact), "probes")
        seen = sorted(r.cell for r in probes.select("cell").distinct().collect())  # at most MAX_CELLS
        if seen:
            found = _scored(index.rows.where(F.col("cell").isin(seen)).join(rows, "vec_id"), probes, k, threshold, dim)
            best = found if best is None else best.unionByName(found)
            best = staged(best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"), "best")
        first, width = last, 2 * width
        if first >= cells:
            break
        state = whole.drop("floor")
        if best is not None:
            held = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("kth"))
            state = state.join(held, "query_id", "left")
        else:
            state = state.withColumn("n", F.lit(0)).withColumn("kth", F.lit(None).cast("double"))
        full = F.coalesce(F.col("n") >= k, F.lit(False))
        state = state.withColumn("floor", F.when(full, F.greatest(F.col("kth"), F.lit(float(threshold)))).otherwise(float(threshold)))
        active = staged((state if exact else state.where(~full)).select("query_id", "q", "project", "doc_type", "floor"), "questions")
        if not exact and active.isEmpty():
            break
    if best is None:
        return active.sparkSession.createDataFrame([], "query_id long, vec_id long, similarity double, place int")
    placed = best.select(F.col("query_id").alias("asked_as"), "vec_id", "similarity", F.row_number().over(order).alias("place"))
    same = F.struct("q", "project", "doc_type").alias("same")
    named = asked.select("query_id", same).join(whole.select(F.col("query_id").alias("asked_as"), same).hint("merge"), "same").select("query_id", "asked_as")
    return named.join(placed, "asked_as").select("query_id", "vec_id", "similarity", "place")
