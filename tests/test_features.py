"""As-of features: brute force, no look-ahead, Elo, models."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fieldhouse.features import asof, elo
from fieldhouse.plans import models
from fieldhouse.plans.fixtures import Tables

SCHEMA = "game_id long, sport string, date date, season long, home_team_id long, away_team_id long, home_score double, away_score double, status string"


@pytest.fixture(scope="module")
def small(spark):
    """Few teams, many same-day games, draws, upcoming games and an empty history."""
    rows, d0 = [], date(2024, 1, 1)
    for i in range(150):
        h, a = i * 7 % 5, (i * 3 + 1) % 5
        if h == a:
            a = 5
        done = i % 11 != 0
        rows.append((i, "x", d0 + timedelta(days=i // 4), 2024, h, a, float(70 + i * 13 % 40) if done else None, float(70 + i * 29 % 40) if done else None, "final" if done else "scheduled"))
    rows.append((999, "x", d0 + timedelta(days=5), 2024, 77, 78, None, None, "scheduled"))
    return spark.createDataFrame(rows, SCHEMA), rows


def brute_form(rows, n=10):
    out = {}
    for g in rows:
        for me in (4, 5):
            t = g[me]
            past = [r for r in rows if t in (r[4], r[5]) and r[6] is not None and r[2] < g[2]]
            past = sorted(past, key=lambda r: (r[2], r[0]))[-n:]
            pf = [r[6] if r[4] == t else r[7] for r in past]
            pa = [r[7] if r[4] == t else r[6] for r in past]
            k = len(past)
            out[g[0], t] = (k, round(sum(x > y for x, y in zip(pf, pa)) / k, 9) if k else 0.0, round(sum(pf) / k, 9) if k else 0.0)
    return out


def test_form_brute_force(small):
    df, rows = small
    got = {(r.game_id, r.team_id): (r.form_games, round(r.form_win_pct, 9), round(r.form_ppg, 9)) for r in asof.form(df).collect()}
    assert got == brute_form(rows)


@pytest.mark.parametrize("f", [asof.form, asof.venue_form, asof.head_to_head, asof.rest, asof.momentum, asof.scoring, asof.short_trend, asof.trend_slope, asof.current_streak, asof.quality_form, elo.elo])
def test_no_look_ahead(small, f):
    df, _ = small
    cut = date(2024, 1, 20)
    early = df.where(F.col("date") <= F.lit(cut))
    later = df.withColumn("home_score", F.when(F.col("date") >= F.lit(cut), F.col("home_score") + 50).otherwise(F.col("home_score")))
    ids = early.select("game_id")
    rows = lambda d: sorted(map(str, f(d).join(ids, "game_id").collect()))
    assert rows(early) == rows(df)
    upto = early.where(F.col("date") <= F.lit(cut)).select("game_id")
    assert sorted(map(str, f(later).join(upto, "game_id").collect())) == rows(df)


def test_elo_plain(small):
    import math

    df, rows = small
    r, out, day, todo = {}, {}, None, []
    for g in sorted(rows, key=lambda g: (g[2], g[0])):
        if g[2] != day:
            for t, d in todo:
                r[t] = r.get(t, 1500) + d
            todo, day = [], g[2]
        h, a = r.get(g[4], 1500), r.get(g[5], 1500)
        out[g[0]] = (h, a)
        if g[6] is not None:
            m = g[6] - g[7]
            p = 1 / (1 + 10 ** ((a - h) / 400))
            lead = h - a if m > 0 else a - h
            c = 32 * math.log(abs(m) + 1) * 2.2 / (lead * 0.001 + 2.2) * ((m > 0) - p if m else 0.5 - p)
            todo += [(g[4], c), (g[5], -c)]
    got = {x.game_id: (x.home_elo, x.away_elo) for x in elo.elo(df).collect()}
    assert set(got) == set(out)
    assert all(got[k] == pytest.approx(out[k]) for k in out)


def test_models(spark, sf):
    m = models.temporal_split(models.feature_matrix(Tables(spark, sf).games), 0.2).cache()
    train, test = m.where("NOT test"), m.where("test")
    assert train.agg(F.max("date")).first()[0] <= test.agg(F.min("date")).first()[0]
    e = models.Ensemble.fit(train, test, models.FEATURES)
    assert set(e.weights) == {"logistic", "forest", "boosted"} and all(w >= 0.01 for w in e.weights.values())
    s = e.score(test)
    assert s.where("home_win_prob < 0 OR home_win_prob > 1 OR consensus < 0.3").count() == 0
    assert sum(e.importance(models.FEATURES).values()) == pytest.approx(1.0, abs=1e-6)
    name, f = models.calibrate(s)
    assert name in ("isotonic", "platt") and f(s).where("calibrated < 0.05 OR calibrated > 0.95").count() == 0
    assert "home_score" not in models.usable(m, ["game_id"])
    _, w = models.fit_regressors(train.withColumn("total", F.col("home_score") + F.col("away_score")), test.withColumn("total", F.col("home_score") + F.col("away_score")), models.FEATURES, "total")
    assert sum(w.values()) == pytest.approx(1.0)
