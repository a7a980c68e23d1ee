"""Quality classifier by compression with dictionaries of good and bad text.

Two zstandard dictionaries are trained, one on texts labelled good and one on
texts labelled bad.  A text is compressed with each in blocks of ``BLOCK`` bytes,
so that what it resembles counts and not how often it repeats itself; the
difference of the two sizes for each byte is all that is known of it.  A rising
step function (isotonic regression) fitted on labelled texts that no dictionary
has seen turns it into a probability, for the classes in the shares in which they
come.

Cases: a null or empty text has no bytes and the score of a difference of 0; a text of any length is scored whole, in
blocks; a null doc_id is scored, with ``held_out`` false, and never used for
training; rows that repeat are each scored, and equal texts score alike; extra
columns are ignored, whatever their names; an empty table gives an empty result;
with one class or none in the labels every score is that class's share, or 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import crc_mod, labelled_sample, odds_of

PER_CLASS = 1500      # labelled texts of each class that the model is fitted on, at most
TRAIN_CHARS = 20000   # longer labelled texts are not in the sample (all texts are scored whole)
DICTIONARY_BYTES = 112640
LEVEL = 3
BLOCK = 512           # bytes that are compressed at once
LEAST = 16            # bytes added to every length, so that a few bytes are no evidence

_compressors: dict = {}


def _pair(dictionaries: tuple[bytes, bytes]):
    if dictionaries not in _compressors:
        _compressors.clear()
        made = []
        for raw in dictionaries:
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False).compress)
        _compressors[dictionaries] = tuple(made)
    return _compressors[dictionaries]


def difference(dictionaries: tuple[bytes, bytes], text: bytes) -> float:
    """Bytes more that the text takes with the dictionary of bad text than with that of good, for each of its bytes."""
    good, bad = _pair(dictionaries)
    more = 0
    for at in range(0, len(text), BLOCK):
        block = text[at:at + BLOCK]
        more += len(bad(block)) - len(good(block))
    return more / (len(text) + LEAST)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising function nearest to ``y`` over ``x``: neighbours that fall are pooled.

    A pool's value counts one observation more, half of it of either class, so that no score is 0 or 1.
    """
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for at, label, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        pools.append([at, at, label * w, w])
        while len(pools) > 1 and (pools[-2][1] == pools[-1][0] or pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]):
            _, high, positive, n = pools.pop()
            pools[-1][1:] = [high, pools[-1][2] + positive, pools[-1][3] + n]
    value = np.maximum.accumulate([(positive + 0.5) / (n + 1) for _, _, positive, n in pools])
    return np.array([e for p in pools for e in p[:2]]), np.repeat(value, 2)


class QualityModel:
    def __init__(self, dictionaries=None, knots=None, constant: float = 0.5):
        self.dictionaries, self.knots, self.constant = dictionaries, knots, constant

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.knots is None or not texts:
            return np.full(len(texts), self.constant)
        return np.interp([difference(self.dictionaries, t) for t in texts], *self.knots)


def _dictionary(samples: list[bytes]) -> bytes:
    blocks = [t[at:at + BLOCK] for t in samples for at in range(0, len(t), BLOCK)]
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, blocks)) // 4))
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer: their own bytes serve as a raw dictionary
        return b"\n".join(samples)[-DICTIONARY_BYTES:] or b" " * 8


def fit_texts(good: list[bytes], bad: list[bytes], odds: float | None = None) -> QualityModel:
    """Dictionaries from every other text of each class, calibrated on the rest for classes that come good to bad as ``odds`` (as they are here)."""
    dictionaries = _dictionary(good[::2]), _dictionary(bad[::2])
    fresh = bad[1::2] + good[1::2]
    y = np.repeat([0.0, 1.0], [len(bad) // 2, len(good) // 2])
    weight = np.where(y == 1, (odds or len(good) / len(bad)) * len(bad) / len(good), 1.0)
    return QualityModel(dictionaries, isotonic(np.array([difference(dictionaries, t) for t in fresh]), y, weight))


def fit(docs: DataFrame, labels: DataFrame, train, per_class: int = PER_CLASS) -> QualityModel:
    rows = labelled_sample(docs, labels, "quality", train, per_class, TRAIN_CHARS)
    texts = {y: [r.text.encode() for r in rows if r.y == y] for y in (0, 1)}
    if min(map(len, texts.values())) < 2:
        return QualityModel(constant=float(np.mean([r.y for r in rows])) if rows else 0.5)
    return fit_texts(texts[1], texts[0], odds_of(labels, "quality", train))


def score_documents(docs: DataFrame, model: QualityModel, keep: list[str], score: str = "score") -> DataFrame:
    """``keep`` columns of each row, with the score of its whole text under the name ``score``, which none of them has."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of at most 110 KB and the knots of at most 1500 texts

    def run(batches):
        for b in batches:
            texts = [(t or "").encode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(shared.value.scores(texts), pa.float64())], [*keep, score])

    source = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    return source.mapInArrow(run, docs.select(*keep).schema.add(score, "double"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; labels of held-out rows are not learnt from."""
    model = fit(docs, labels, crc_mod("doc_id", 3) != 1)
    return (score_documents(docs, model, ["doc_id"])
            .select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is at least one half, with their own columns."""
    model = fit(docs, labels, crc_mod("doc_id", 3) != 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.scores([(t or "").encode() for t in b.column("text").to_pylist()]) >= 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
