"""Reading, staging and small numeric helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one if Spark runs in one process (tests), else an error."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="evidora-")
    return "file://" + _own_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing before it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_hash(df: DataFrame):
    """A hash of all columns of a row."""
    return F.xxhash64(*(F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in df.schema))


def crc_mod(column: str, modulus: int):
    """crc32 of a column as text, modulo; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """An L2-penalised logistic regression by damped Newton steps; the last column of ``x`` is ones and is not penalised.

    Columns are standardised for the fit, and a step is halved until the penalised loss falls, so a fit cannot diverge;
    a loss that is no number raises.
    """
    mean, scale = x[:, :-1].mean(0), x[:, :-1].std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.c_[(x[:, :-1] - mean) / scale, np.ones(len(x))]
    penalty = np.r_[np.full(z.shape[1] - 1, ridge), 1e-6]
    sign = 2 * y - 1

    def loss(w):
        return np.logaddexp(0, -sign * (z @ w)).sum() + (penalty * w * w).sum() / 2

    w = np.zeros(z.shape[1])
    now = loss(w)
    if not np.isfinite(now):
        raise ValueError("a logistic regression needs finite values")
    for _ in range(steps):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        rate = 1.0
        while rate > 1e-9 and not loss(w + rate * step) < now:
            rate /= 2
        if rate <= 1e-9:  # no step lowers it any more
            break
        w = w + rate * step
        now = loss(w)
        if np.abs(rate * step).max() < 1e-9:
            break
    w[:-1] /= scale
    w[-1] -= (w[:-1] * mean).sum()
    return w


def odds_of(labels: DataFrame, label: str, train) -> float:
    """How many rows of ``train`` are labelled 1 for each labelled 0; there are some of both."""
    n = labels.where(F.col(label).isin(0, 1) & F.coalesce(train, F.lit(False))).agg(F.sum(label).alias("ones"), F.count("*").alias("all")).first()
    return n.ones / (n.all - n.ones)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int, max_chars: int) -> list:
    """At most ``per_class`` labelled texts of each class, each of at most ``max_chars`` characters: the bounded sample a classifier is fitted on.

    The rows are those with the smallest hash of doc_id among ``train``, so the choice does not depend on partitions.
    A doc_id labelled twice counts once, with its larger label; of a doc_id's texts the smallest is taken.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & F.coalesce(train, F.lit(False)))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    texts = docs.where(F.length("text") <= max_chars).select("doc_id", "text")
    chosen = None
    for y in (0, 1):
        # 2 x per_class ids are few and bounded, so they can be broadcast.
        part = known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).collect()
    return sorted(rows, key=lambda r: (hash_order(r.doc_id), r.doc_id))


def hash_order(n: int) -> int:
    """A fixed scramble of an integer, to split and order samples."""
    return ((n * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (2**64 - 1)) >> 17
