"""The quality classifier on held-out labels, over many orders of its training texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from evidora.llm import quality
from evidora.llm.common import fit_logistic, table


@pytest.mark.parametrize("sf,least", [("sf0.01", 0.95), ("sf0.1", 0.98)])
def test_every_training_order_gives_a_good_model(spark, sf, least):
    rows = table(spark, f"/root/testdata/{sf}", "documents").join(table(spark, f"/root/testdata/{sf}", "labels"), "doc_id").select("doc_id", "text", "quality").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    texts, y = [r.text.encode() for r in held], np.array([r.quality for r in held])
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and len(r.text) <= quality.TRAIN_CHARS]
    for seed in range(50 if sf == "sf0.01" else 4):
        order = random.Random(seed).sample(train, len(train))
        model = quality.fit_texts(*([r.text.encode() for r in order if r.quality == k] for k in (1, 0)))
        predicted = model.scores(texts) >= 0.5
        assert (predicted == y).mean() >= least and predicted[y == 1].mean() >= 0.97 and (~predicted)[y == 0].mean() >= 0.85


def test_a_fit_cannot_diverge():
    rng = np.random.default_rng(3)
    for seed in range(50):  # separable, collinear and wildly scaled columns
        x = np.c_[rng.normal(size=40) * 1e4, rng.normal(size=40) * 1e-6, np.ones(40)]
        y = (x[:, 0] + 1e9 * x[:, 1] * (seed % 3) > 0).astype(float)
        w = fit_logistic(x, y)
        assert np.isfinite(w).all() and ((x @ w > 0) == y).mean() > 0.7
    with pytest.raises(ValueError):
        fit_logistic(np.array([[np.nan, 1.0], [1.0, 1.0]]), np.array([0.0, 1.0]))


def test_clashing_names_and_long_texts(spark):
    rng = random.Random(5)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    good, bad = "the cat sat on a mat and it was warm".split(), "zz## qq&& xx%% ||| !!!! WWW".split()
    rows = [(i, text(good if i % 2 else bad, 60), "a") for i in range(200)] + [(900, text(good, 200_000), "b"), (901, None, "b"), (902, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _quality string").withColumnRenamed("_quality", "score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {i for i in range(1, 200, 2)} <= ids and 900 in ids and not ids & set(range(0, 200, 2))
    assert quality.keep_good(docs.where("false"), labels).count() == 0
