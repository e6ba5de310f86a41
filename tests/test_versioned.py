"""Versioned tables: whole rows after any order of changes, one race, lost drivers, repeated batches, vacuum."""

import random

import pytest
from pyspark.sql import functions as F

from fieldhouse.sources.versioned import LostRace, VersionedTable

SCHEMA = "k long, t long, v string"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], parts=8)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upserts_equal_a_dict(spark, table):
    r, want = random.Random(1), {}
    for step in range(6):
        new = [(r.randrange(40), r.randrange(100), f"{step}-{i}") for i in range(r.choice([1, 5, 60]))]
        assert table.upsert(spark.createDataFrame(new, SCHEMA), ["t"], "w", step)
        for k, t, v in new:
            want[k] = max(want.get(k, (-1, "")), (t, v))
        assert rows(table.read()) == sorted((k, *x) for k, x in want.items())
    assert table.versions() == list(range(6))


def test_only_touched_partitions_are_written(spark, table):
    table.upsert(spark.createDataFrame([(k, 1, "a") for k in range(100)], SCHEMA), ["t"])
    before = table.manifest()["parts"]
    table.upsert(spark.createDataFrame([(7, 2, "b")], SCHEMA), ["t"])
    after = table.manifest()["parts"]
    assert len(before) == 8 and sum(before[p] != after[p] for p in before) == 1
    assert rows(table.read(0)) == [(k, 1, "a") for k in range(100)]


def test_a_repeated_batch_changes_nothing(spark, table):
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("t").alias("t"), F.max("v").alias("v"))
    one = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], SCHEMA)
    assert table.change(one, add, "w", 0)
    assert not table.change(one, add, "w", 0)
    assert table.change(one, add, "other", 0)
    assert rows(table.read()) == [(1, 10, "a"), (2, 12, "b")] and table.manifest()["seen"] == {"w": 0, "other": 0}


def test_a_driver_lost_before_its_commit_leaves_nothing(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([(1, 1, "a")], SCHEMA), ["t"], "w", 0)
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.upsert(spark.createDataFrame([(1, 2, "half")], SCHEMA), ["t"], "w", 1)
    assert rows(table.read()) == [(1, 1, "a")]
    assert table.upsert(spark.createDataFrame([(1, 2, "b")], SCHEMA), ["t"], "w", 1)  # the batch comes again
    assert rows(table.read()) == [(1, 2, "b")]
    gone = table.vacuum(keep=1)
    assert len(gone) == 2 and rows(table.read()) == [(1, 2, "b")] and table.versions() == [1]


def test_of_two_writers_one_wins(spark, table, monkeypatch):
    table.upsert(spark.createDataFrame([(1, 1, "a")], SCHEMA), ["t"])
    stale = table.manifest()
    table.upsert(spark.createDataFrame([(1, 3, "first")], SCHEMA), ["t"])
    now = table.manifest
    with monkeypatch.context() as m:
        m.setattr(table, "manifest", lambda version=None: stale if version is None else now(version))
        with pytest.raises(LostRace):
            table.upsert(spark.createDataFrame([(1, 2, "second")], SCHEMA), ["t"])
    assert rows(table.read()) == [(1, 3, "first")]


def test_rows_may_go_and_nulls_stay(spark, table):
    table.upsert(spark.createDataFrame([(None, 1, None), (2, None, "x"), (3, 1, "y")], SCHEMA), ["t"])
    assert {tuple(r) for r in table.read().collect()} == {(None, 1, None), (2, None, "x"), (3, 1, "y")}
    table.change(spark.createDataFrame([(3, 0, "")], SCHEMA), lambda old, new: old.join(new.select("k"), "k", "left_anti"))
    assert {tuple(r) for r in table.read().collect()} == {(None, 1, None), (2, None, "x")}
    assert table.change(spark.createDataFrame([], SCHEMA), lambda old, new: old)
    with pytest.raises(ValueError, match="partitions"):
        table.change(spark.createDataFrame([(2, 0, "")], SCHEMA), lambda old, new: old.unionByName(spark.createDataFrame([(k, 0, "") for k in range(50)], SCHEMA)))


def test_empty(table):
    assert table.read().count() == 0 and table.manifest()["version"] == -1 and table.vacuum() == []
