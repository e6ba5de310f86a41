"""Player props on large tables: rows are narrow where they are shuffled, models read one wide table, tails of many lines."""

import datetime
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldhouse.features import props as P
from fieldhouse.functions import scalars as S
from fieldhouse.plans import props as M
from fieldhouse.plans.fixtures import Tables

STATS = ("pts", "reb", "ast", "minutes", "double_double")


@pytest.fixture(scope="module")
def wide(spark, sf):
    t = Tables(spark, sf)
    d = P.wide_features(t.player_stats, t.games, STATS)
    return d.sparkSession.createDataFrame(d.toPandas(), d.schema)


def test_games_before_reach_over_batches(spark):
    """Three rows a batch, players of many games, of one, and without an id; values of one player do not reach another."""
    r, day = np.random.default_rng(2), datetime.date(2022, 1, 1)
    rows = [(p, g, day + datetime.timedelta(days=g // 2), float(r.integers(0, 9)), float(np.round(r.normal(20, 5), 3))) for p, n in ((1, 40), (2, 1), (3, 17), (None, 7)) for g in range(n)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(x.player_id, x.game_id): x for x in P.rolling(spark.createDataFrame(rows, "player_id long, game_id long, date date, pts double, reb double").repartition(3), ("pts", "reb")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == len(rows)
    for i, stat in ((3, "pts"), (4, "reb")):
        for p in (1, 2, 3, None):
            y = [x[i] for x in rows if x[0] == p]
            hot = [bool(k and round(v - statistics.fmean(y[max(0, k - 15) : k]), 9) > 0) for k, v in enumerate(y)]
            for k in range(len(y)):
                x, five, last = got[p, k], y[max(0, k - 5) : k], y[max(0, k - 15) : k]
                assert x.n_before == k and x[f"{stat}_above_5"] == sum(hot[max(0, k - 5) : k])
                want = [statistics.fmean(five), statistics.fmean(last), max(five), y[k - 1]] if k else [None] * 4
                assert [x[f"{stat}_{c}"] for c in ("mean_5", "mean_15", "max_5", "last")] == (pytest.approx(want, rel=1e-12) if k else want)
                assert x[f"{stat}_std_15"] == pytest.approx(statistics.stdev(last) if k > 1 else 0.0, abs=1e-9)


def exchanges(d):
    mode = d.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return [p for p in d._jdf.queryExecution().explainString(mode).split("\n\n") if ") Exchange" in p]


def test_made_features_are_not_shuffled(spark, sf):
    t = Tables(spark, sf)
    dealt = exchanges(P.prop_features(t.player_stats, t.games, STATS))
    assert dealt and not any("std_15" in p or "mean_15" in p for p in dealt)


def test_wide_rows_give_what_long_rows_give(spark, wide):
    """Models, predictions and chances of both forms; of wide rows nothing is shuffled, combined props are made in the row."""
    row = lambda s: F.struct(F.lit(s).alias("stat"), F.array(*P.own_columns(s), *P.SHARED).alias("x"), F.col(s).alias("y"))
    long_ = wide.select("player_id", "game_id", "date", F.inline(F.array(*map(row, STATS))))
    a, b = M.fit(wide), M.fit(long_)
    assert len(a.report) == len(b.report) == len(M.PROPS) and set(a.deviation) == set(b.deviation) == {p.name for p in M.PROPS} | set(M.COMBOS)
    for x, y in zip(a.report, b.report, strict=True):
        assert x[:4] == y[:4] and x[4:7] == pytest.approx(y[4:7], rel=1e-9)
    assert a.deviation == pytest.approx(b.deviation, rel=1e-9)
    made = a.chances(a.predict(wide, line={"points": F.floor("pts_mean_15") + 0.5}))
    assert not exchanges(made)
    lines = wide.select("player_id", "game_id", F.lit("points").alias("prop"), (F.floor("pts_mean_15") + 0.5).alias("line"))
    key = ("player_id", "game_id", "prop")
    want = {tuple(r[c] for c in key): r for r in b.chances(b.predict(long_), lines).collect()}
    got = {tuple(r[c] for c in key): r for r in made.collect()}
    assert set(got) == set(want) and len(got) == wide.count() * (len(M.PROPS) + len(M.COMBOS))
    for k, x in got.items():
        assert [x[c] for c in ("predicted", "y", "line", "over_prob", "under_prob")] == pytest.approx([want[k][c] for c in ("predicted", "y", "line", "over_prob", "under_prob")], abs=1e-9)


def test_thin_wide_tables(wide):
    few = M.fit(wide.limit(20))
    assert few.report == [] and few.predict(wide).count() == 0 and few.chances(few.predict(wide)).count() == 0


def test_poisson_tails(spark):
    cases = [(n, m) for n in (-3.0, -0.5, 0.0, 0.5, 3.0, 3.5, 190.0, 400.0) for m in (0.0, 1e-3, 2.5, 60.0, 199.0, 650.0)]
    d = spark.createDataFrame(cases, "n double, m double")
    for r in d.select("*", S.poisson_over("n", "m").alias("over"), F.when(F.col("n") >= 0, S.poisson_at(F.floor("n"), "m")).alias("at")).collect():
        m = max(r.m, 1e-9)
        term = lambda k: math.exp(k * math.log(m) - m - math.lgamma(k + 1))  # noqa: B023, E731
        assert r.over == pytest.approx(sum(term(k) for k in range(max(0, math.floor(r.n) + 1), 1500)), abs=1e-9)
        assert r.n < 0 or r.at == pytest.approx(term(math.floor(r.n)), abs=1e-12)
