"""The vector index against exact search: recall, bytes, filters, waves and awkward vectors."""

from __future__ import annotations

import re
import tempfile
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidora.operators import vector_index as vi

DIM = 16


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(24, DIM))
    x = np.concatenate([c + 0.35 * rng.normal(size=(70, DIM)) for c in centres] + [np.repeat(centres[:1], 600, axis=0)]).astype(np.float32)  # a hot vector
    rng.shuffle(x)
    rows = [(i, v.tolist(), f"P{i % 7}" if i % 11 else None, "board" if i % 3 else "legal", i % 5, None) for i, v in enumerate(x)]
    odd = [(90001, None), (90002, []), (90003, [0.0] * DIM), (90004, [float("nan")] * DIM), (90005, [float("inf")] * DIM), (90006, [1.0] * 3)]
    vectors = spark.createDataFrame([(r[0], r[1]) for r in rows] + odd, "vec_id long, embedding array<float>")
    about = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "vec_id long, project string, doc_type string, authority int, created date")
    path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index"
    vi.build(vectors, path, cells=32)
    return vi.load(spark, path), x.astype(np.float64), rows, about, path


def exact(x, rows, q, k, threshold, fits=lambda r: True):
    s = np.round(x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), 6)
    order = sorted((i for i in range(len(x)) if s[i] >= threshold and fits(rows[i])), key=lambda i: (-s[i], -rows[i][4], i))
    return [(rows[i][0], s[i]) for i in order[:k]]


def asked(spark, x, ids, extra=()):
    rows = [(i, x[i].tolist(), *(e(i) for e in extra)) for i in ids]
    return spark.createDataFrame(rows, "query_id long, q array<float>" + ", project string, doc_type string" * bool(extra))


def results(df):
    out = {}
    for r in df.orderBy("query_id", "place").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.similarity, 6)))
    return out


def broadcast_blocks(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [lines for lines in re.findall(r"BroadcastExchange.*\n.*(?:Project.*\n.*)?", plan) if "collect_list" in lines]


def test_exact_search_is_brute_force(spark, data):
    index, x, rows, about, _ = data
    ids = [*range(0, 400, 20), 1500]
    got = results(vi.search(index, asked(spark, x, ids), about, 10, 0.18, exact=True))
    assert got == {i: exact(x, rows, x[i], 10, 0.18) for i in ids}


def test_filters_count_inside_the_search(spark, data):
    index, x, rows, about, _ = data
    ids = list(range(0, 300, 15))
    narrow = (lambda i: f"P{i % 7}", lambda i: "legal" if i % 2 else None)
    want = {i: exact(x, rows, x[i], 10, -1.0, lambda r, i=i: r[2] == f"P{i % 7}" and (i % 2 == 0 or r[3] == "legal")) for i in ids}
    assert results(vi.search(index, asked(spark, x, ids, narrow), about, 10, -1.0, exact=True)) == want
    got = results(vi.search(index, asked(spark, x, ids, narrow), about, 10, -1.0))
    assert all(len(got[i]) == len(want[i]) for i in ids)  # a question goes on until it has its rows
    rare = about.where("vec_id % 211 = 0")
    got = results(vi.search(index, asked(spark, x, ids), rare, 10, -1.0))
    left = len([r for r in rows if r[0] % 211 == 0])
    assert all(len(got[i]) == min(10, left) for i in ids)


def test_recall_and_cells_read(spark, data):
    index, x, rows, about, _ = data
    ids = list(range(3, 2000, 20))
    got = results(vi.search(index, asked(spark, x, ids), about, 10, 0.18))
    want = {i: exact(x, rows, x[i], 10, 0.18) for i in ids}
    hit = sum(len({s for _, s in got[i]} & {s for _, s in want[i]}) / len({s for _, s in want[i]}) for i in ids) / len(ids)
    assert hit >= 0.9
    one = vi._probes(asked(spark, x, ids[:1]).withColumns({"project": F.lit(None).cast("string"), "doc_type": F.lit(None).cast("string"), "floor": F.lit(0.18)}), index, 0, index.probes, False)
    cells = [r.cell for r in one.collect()]
    assert index.counts[cells].sum() < 0.75 * index.counts.sum()  # of which the hot vector's cell is a quarter
    plan = index.rows.where(F.col("cell").isin(cells))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    bound = vi._probes(asked(spark, x, ids[:1]).withColumns({"project": F.lit(None).cast("string"), "doc_type": F.lit(None).cast("string"), "floor": F.lit(0.9)}), index, 0, 32, True)
    assert bound.count() < 32  # exact search leaves out cells too


def test_no_vectors_and_odd_questions(spark, data):
    index, x, _, about, _ = data
    odd = spark.createDataFrame([(1, None), (2, [0.0] * DIM), (3, [1.0] * 3), (4, [])], "query_id long, q array<float>")
    assert vi.search(index, odd, about).count() == 0
    assert vi.search(index, asked(spark, x, [1]), about.where("false")).count() == 0
    path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index"
    empty = vi.build(spark.createDataFrame([], "vec_id long, embedding array<float>"), path)
    assert vi.search(empty, asked(spark, x, [1]), about).count() == 0


def test_centroids_are_fitted_in_little_memory():
    """The scores of all sampled vectors against all cells never stand in memory at once (they would be 268 MB here)."""
    x = unit(np.random.default_rng(4).normal(size=(65536, 4))).astype(np.float32)
    tracemalloc.start()
    c = vi.centroids_of(x, 512)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert c.shape == (512, 4) and np.allclose(np.linalg.norm(c, axis=1), 1)
    assert peak < 40e6


def test_the_sample_is_bounded_and_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(vi, "SAMPLE", 500)
    v = spark.range(5000).select(F.col("id").alias("vec_id"), F.array(*(F.rand(i).cast("float") + 0.1 for i in range(3))).alias("embedding"))
    v = spark.createDataFrame(v.collect(), v.schema)
    some = vi._sample(v, 5000)
    assert 400 < len(some) < 600 and np.allclose(np.linalg.norm(some, axis=1), 1, atol=1e-6)
    assert np.array_equal(some, vi._sample(v.repartition(7), 5000))


def test_blocks_do_not_go_through_the_driver(spark, data):
    """Probes' files are small, as a question's vector stands in them again and again; the blocks that are made of them are not."""
    index, x, _, about, _ = data
    given = asked(spark, x, range(40)).withColumns({"project": F.lit(None).cast("string"), "doc_type": F.lit(None).cast("string"), "floor": F.lit(0.18)})
    probes = vi.staged(vi._probes(given, index, 0, 32, False), "probes")
    met = vi._scored(index.rows.join(about, "vec_id"), probes, 10, 0.18, DIM)
    assert met.count() > 0
    assert not broadcast_blocks(met)


def test_same_questions_are_searched_once(spark, data, monkeypatch):
    index, x, rows, about, _ = data
    given = spark.createDataFrame([(1000 * i + j, [float(v) for v in x[i]], "P3" if j % 3 == 0 else None, None) for i in (5, 40) for j in range(30)] + [(9, [-0.0, *([1.0] * (DIM - 1))], None, None), (8, [0.0, *([1.0] * (DIM - 1))], None, None)],
                                  "query_id long, q array<float>, project string, doc_type string")
    searched, probes = [], vi._probes
    monkeypatch.setattr(vi, "_probes", lambda active, *a: searched.append(active.count()) or probes(active, *a))
    got = results(vi.search(index, given, about, 10, -1.0, exact=True))
    assert max(searched) == 5  # two vectors with and without a project, and one more
    for i in (5, 40):
        for j in range(30):
            assert got[1000 * i + j] == exact(x, rows, x[i], 10, -1.0, lambda r, j=j: j % 3 or r[2] == "P3")
    assert got[8] == got[9] and len(got[8]) == 10


def test_over_fetching_sends_no_blocks_through_the_driver(spark, small, monkeypatch):
    from evidora.plans.catalogue import QUERIES

    waves, scored = [], vi._scored

    def watched(*a):
        made = scored(*a)
        waves.append(broadcast_blocks(made))
        return made

    monkeypatch.setattr(vi, "_scored", watched)
    assert QUERIES["over_fetch"](spark, small).count() > 0
    assert waves and not any(waves)
