"""Commits: racing and killed writers, retries, upserts that touch their own buckets only."""

from __future__ import annotations

import tempfile
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from evidora.sources.versions import Stale, VersionedTable, kept


@pytest.fixture
def root():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def held(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def test_versions_upserts_and_retries(spark, root):
    t = VersionedTable(spark, root, ["k"], buckets=8)
    assert t.version() == 0
    with pytest.raises(ValueError):
        t.read()
    assert t.replace(frame(spark, [(i, "a") for i in range(50)]), expected=0, txn="first") == 1
    assert t.replace(frame(spark, []), txn="first") == 1  # a retry adds nothing
    before = t.manifest(1)["buckets"]
    assert t.upsert(frame(spark, [(3, "b"), (99, "new"), (4, None)]), expected=1, gone="v is null") == 2
    assert held(t) == sorted([(i, "a") for i in range(50) if i not in (3, 4)] + [(3, "b"), (99, "new")])
    assert held(t, 1) == [(i, "a") for i in range(50)]  # an older version is as it was
    after = t.manifest(2)["buckets"]
    touched = {str(r[0]) for r in frame(spark, [(3, ""), (99, ""), (4, "")]).select(F.pmod(F.xxhash64("k"), F.lit(8))).collect()}
    assert len(touched) < 8 and {b for b in after if before.get(b) != after[b]} <= touched
    assert t.append(frame(spark, [(200, "x")]), txn="add") == 3 and t.append(frame(spark, [(200, "x")]), txn="add") == 3
    assert held(t)[-1] == (200, "x") and t.read().where("k = 200").count() == 1
    with pytest.raises(Stale):
        t.upsert(frame(spark, [(1, "late")]), expected=2)
    rows = held(t)
    t.vacuum()
    assert held(t) == rows and t.version() == 3


def test_of_two_racing_writers_one_is_stale(spark, root):
    t = VersionedTable(spark, root, ["k"], buckets=4)
    t.replace(frame(spark, [(1, "a")]))

    def write(name):
        try:
            return VersionedTable(spark, root, ["k"], buckets=4).upsert(frame(spark, [(1, name)]), expected=1)
        except Stale:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(write, "wxyz"))
    assert sorted(done, key=str) == sorted([2, None, None, None], key=str)
    assert t.version() == 2 and len(held(t)) == 1 and held(t)[0][1] in "wxyz"


def test_a_killed_writer_is_not_seen(spark, root, monkeypatch):
    t = VersionedTable(spark, root, ["k"])
    t.replace(frame(spark, [(1, "a")]))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(t.files, "publish", killed)
    with pytest.raises(KeyboardInterrupt):
        t.upsert(frame(spark, [(1, "b")]))
    again = VersionedTable(spark, root, ["k"])
    assert held(again) == [(1, "a")] and again.version() == 1
    assert len(again.vacuum()) == 1 and held(again) == [(1, "a")]


def test_a_derived_table_is_kept_until_its_source_changes(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.range(10).write.parquet(f"{folder}/n.parquet")
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(f"{folder}/n.parquet").where("id % 2 = 0")

    for _ in range(3):
        assert kept(spark, "even", folder, ("n",), build).count() == 5
    assert len(built) == 1
    spark.range(20).write.mode("overwrite").parquet(f"{folder}/n.parquet")
    assert kept(spark, "even", folder, ("n",), build).count() == 10 and len(built) == 2
