"""Stored rollups: any order of new, changed and deleted partitions equals a full rebuild; unchanged ones are not touched."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from fieldhouse.operators import rollups as R

SCHEMA = "season long, week long, team long, v double"


def store(spark, path):
    measures = dict([R.count("n"), R.count("high", F.col("v") > 5), R.total("sum", "v"), R.mean("mean", "v"), R.deviation("dev", "v"), R.extreme("low", "v", "min"), R.extreme("top", "v", "max")])
    return R.Rollup(spark, f"file://{path}", {"season": "long", "week": "long"}, {"team": "long"}, measures, parts=4)


def plain(rows):
    out = {}
    for s, w, team, v in rows:
        if s is not None and w is not None:
            out.setdefault(team, []).append(v)
    res = {}
    for team, vs in out.items():
        x = [v for v in vs if v is not None]
        res[team] = (len(vs), sum(v > 5 for v in x), sum(x) if x else None, statistics.fmean(x) if x else None, statistics.stdev(x) if len(x) > 1 else None, min(x, default=None), max(x, default=None))
    return res


def same(rollup, rows):
    got = {r.team: tuple(r)[1:] for r in rollup.read().collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_refreshes_equal_full_rebuilds(spark, tmp_path):
    r = random.Random(2)
    make = lambda s, w: [(s, w, r.choice([1, 2, 3, None]), r.choice([None, float(r.randrange(10))])) for _ in range(r.randrange(1, 12))]
    parts = {(s, w): make(s, w) for s in (2020, 2021) for w in range(3)}
    rows = lambda: [x for p in parts.values() for x in p]
    df = lambda extra=(): spark.createDataFrame([*rows(), *extra], SCHEMA).repartition(3)
    assert store(spark, tmp_path).refresh(df()) == {"new": 6, "changed": 0, "gone": 0, "unchanged": 0}
    same(store(spark, tmp_path), rows())
    before = store(spark, tmp_path).partials.versions()
    assert store(spark, tmp_path).refresh(df([(None, 1, 1, 99.0), (2020, None, 1, 99.0)])) == {"new": 0, "changed": 0, "gone": 0, "unchanged": 6}
    assert store(spark, tmp_path).partials.versions() == before
    parts[2020, 1] = make(2020, 1) + [(2020, 1, 9, 7.0)]
    del parts[2021, 2]
    parts[2022, 0] = make(2022, 0)
    assert store(spark, tmp_path).refresh(df()) == {"new": 1, "changed": 1, "gone": 1, "unchanged": 4}
    same(store(spark, tmp_path), rows())
    for k in list(parts)[:-1]:
        del parts[k]
    store(spark, tmp_path).refresh(df())
    same(store(spark, tmp_path), rows())
    parts.clear()
    assert store(spark, tmp_path).refresh(df())["gone"] == 1
    assert store(spark, tmp_path).read().count() == 0


def test_only_changed_partitions_are_read(spark, tmp_path):
    """Values of unchanged partitions do not matter to a refresh: their partials stay."""
    rows = [(2020, w, w % 2, float(w)) for w in range(6)]
    s = store(spark, tmp_path)
    s.refresh(spark.createDataFrame(rows, SCHEMA))
    seen = []
    fold = s._fold
    s._fold = lambda df, keys, stored: (seen.append(sorted(r.week for r in df.collect())) if not stored else None, fold(df, keys, stored))[1]
    rows[3] = (2020, 3, 1, 50.0)
    s.refresh(spark.createDataFrame(rows, SCHEMA))
    assert seen == [[3]]
    same(s, rows)


def test_a_run_lost_between_its_commits_is_done_again(spark, tmp_path, monkeypatch):
    rows = [(2020, w, 1, float(w)) for w in range(4)]
    s = store(spark, tmp_path)
    s.refresh(spark.createDataFrame(rows, SCHEMA))
    rows[0] = (2020, 0, 1, 100.0)
    with monkeypatch.context() as m:
        m.setattr(s.marks, "change", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            s.refresh(spark.createDataFrame(rows, SCHEMA))
    again = store(spark, tmp_path)
    assert again.refresh(spark.createDataFrame(rows, SCHEMA))["changed"] == 1
    same(again, rows)


def test_by_other_columns(spark, tmp_path):
    rows = [(2020 + w % 2, w, w % 3, float(w)) for w in range(12)]
    s = store(spark, tmp_path)
    s.refresh(spark.createDataFrame(rows, SCHEMA))
    assert {r.p_season: r["sum"] for r in s.read(["p_season"]).collect()} == {2020: 30.0, 2021: 36.0}
