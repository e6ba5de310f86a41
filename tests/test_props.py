"""Player props: fits by sums against plain least squares and plain Newton steps, tails, combined props, thin tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldhouse.features import props as P
from fieldhouse.plans import props as M

ROWS = "player_id long, game_id long, team_id long, date date, n_before int, stat string, x array<double>, y double"


@pytest.fixture(scope="module")
def features(spark):
    """Made from known weights: pts and reb depend on the same draw, so their errors go together."""
    import datetime

    r, rows = np.random.default_rng(5), []
    for g in range(400):
        for p in range(3):
            x = np.round(r.normal(10, 3, len(P.NAMES)), 4)
            x[7] = g % 2  # two features that say little
            x[9] = 50.0
            e = r.normal(0, 2)
            day = datetime.date(2020, 1, 1) + datetime.timedelta(days=g // 4)
            for stat, w, b in (("pts", 0.8, 3.0), ("reb", 0.5, 1.0), ("ast", 0.2, 2.0)):
                rows.append((p, g, p % 2, day, 9, stat, [float(v) for v in x], float(max(0, b + w * x[0] + 0.1 * x[6] + e + r.normal(0, 1)))))
    return spark.createDataFrame(rows, ROWS).repartition(4)


PROPS = (M.Prop("points", "pts"), M.Prop("rebounds", "reb", "real"), M.Prop("assists", "ast"), M.Prop("pts_over_12", "pts", "flag", 12.0), M.Prop("none", "blk"))


def split(features, stat):
    """Training and validation rows as the plain rule says: days until 80 of 100 rows."""
    rows = sorted((r.date, r.x, r.y) for r in features.where(f"stat = '{stat}'").collect())
    days = sorted({r[0] for r in rows})
    until, valid = 0, set()
    for d in days:
        until += sum(r[0] == d for r in rows)
        if until > 0.8 * len(rows):
            valid.add(d)
    return [r for r in rows if r[0] not in valid], [r for r in rows if r[0] in valid]


@pytest.fixture(scope="module")
def models(features):
    return M.fit(features, PROPS, l2=1e-9)


def test_regressions_equal_least_squares(features, models):
    for prop, stat in (("points", "pts"), ("rebounds", "reb"), ("assists", "ast")):
        train, _ = split(features, stat)
        x = np.array([[1, *r[1]] for r in train])
        y = np.array([r[2] for r in train])
        keep = [i for i in range(x.shape[1]) if i == 0 or x[:, i].std() > 0]
        want = np.zeros(x.shape[1])
        want[keep] = np.linalg.lstsq(x[:, keep], y, rcond=None)[0]
        assert np.allclose(models.beta[prop], want, atol=1e-5)


def test_flags_equal_plain_newton(features, models):
    train, _ = split(features, "pts")
    x = np.array([[1, *r[1]] for r in train])
    y = np.array([r[2] > 12 for r in train], float)
    x = x[:, [i for i in range(x.shape[1]) if i == 0 or x[:, i].std() > 0]]
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(len(b)), x.T @ (y - p))
    got = models.beta["pts_over_12"]
    assert np.allclose(got[np.abs(got) > 0], b, atol=1e-3)


def test_report_and_predictions(spark, features, models):
    report = {r[0]: r for r in models.report}
    assert set(report) == {"points", "rebounds", "assists", "pts_over_12"}
    got = {(r.player_id, r.game_id, r.prop): r for r in models.chances(models.predict(features)).collect()}
    assert len(got) == 400 * 3 * (4 + 4)
    for prop, stat in (("points", "pts"), ("rebounds", "reb")):
        train, valid = split(features, stat)
        assert report[prop][2:4] == (len(train), len(valid))
        b = models.beta[prop]
        z = lambda rows: np.array([[1, *r[1]] for r in rows]) @ b
        y = np.array([r[2] for r in valid])
        rmse = [np.sqrt(np.mean((v - y) ** 2)) for v in (z(valid), np.array([r[1][0] for r in valid]), np.array([r[1][1] for r in valid]))]
        want = np.array([1 / e for e in rmse]) / sum(1 / e for e in rmse)
        assert np.allclose(report[prop][8:], want)
        mixed = np.maximum(0, want[0] * z(valid) + want[1] * np.array([r[1][0] for r in valid]) + want[2] * np.array([r[1][1] for r in valid]))
        assert math.isclose(report[prop][4], np.sqrt(np.mean((mixed - y) ** 2)), rel_tol=1e-9)
    for (p, g, prop), r in got.items():
        if prop == "pts_reb":
            assert math.isclose(r.predicted, got[p, g, "points"].predicted + got[p, g, "rebounds"].predicted, rel_tol=1e-9)
        assert 0 <= r.over_prob <= 1 and 0 <= r.under_prob <= 1 and r.over_prob + r.under_prob <= 1 + 1e-9


def test_combined_deviation_carries_dependence(models):
    """Errors of points and rebounds go together, so the sum's deviation is over that of independent parts."""
    a, b = models.deviation["points"], models.deviation["rebounds"]
    assert models.deviation["pts_reb"] > 1.15 * math.hypot(a, b)


@pytest.mark.parametrize(("kind", "line", "mean", "deviation"), [("count", 7.5, 6.2, 1.0), ("count", 7.0, 6.2, 1.0), ("count", 0.0, 0.3, 1.0), ("count", 180.0, 190.0, 1.0), ("count", 260.5, 250.0, 16.0), ("real", 31.0, 28.5, 6.0), ("combo", 40.5, 44.0, 9.0), ("combo", 1.0, 1.0, 0.1)])
def test_tails(spark, kind, line, mean, deviation):
    from pyspark.sql import functions as F

    r = M.recommended(spark.createDataFrame([(kind, line, mean, deviation)], "kind string, line double, predicted double, deviation double"), 0.55).withColumn("e", F.expr("1")).first()
    if kind == "count" and mean <= 200:
        term = lambda k: math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        over, under = sum(term(k) for k in range(math.floor(line) + 1, 600)), sum(term(k) for k in range(math.ceil(line)))
    else:
        over = 0.5 * math.erfc((line - mean) / max(deviation, 0.5) / math.sqrt(2))
        under = 1 - over
    assert math.isclose(r.over_prob, over, abs_tol=2e-6) and math.isclose(r.under_prob, under, abs_tol=2e-6)
    assert r.recommendation == ("PASS" if max(over, under) < 0.55 else "OVER" if over >= under else "UNDER")


def test_thin_tables(spark, features):
    few = M.fit(features.where("game_id < 10"), PROPS)
    assert few.report == [] and few.predict(features).count() == 0
    assert few.chances(few.predict(features)).count() == 0


def test_features_of_one_player(spark):
    """Three games of history are needed; rows of one game add up; nulls are 0."""
    import datetime

    day = lambda i: datetime.date(2021, 3, 1) + datetime.timedelta(days=i)
    players = spark.createDataFrame([(1, i, 10, day(i), float(i), None if i == 2 else 1.0, 2.0) for i in range(6)] + [(1, 5, 10, day(5), 7.0, 3.0, 8.0)], "player_id long, game_id long, team_id long, date date, pts double, reb double, ast double")
    games = spark.createDataFrame([(i, "s", day(i), 2021, 10, 20, 1.0, 2.0, "final") for i in range(6)], "game_id long, sport string, date date, season int, home_team_id long, away_team_id long, home_score double, away_score double, status string")
    got = {(r.game_id, r.stat): r for r in P.prop_features(players, games, ("pts", "double_double")).collect()}
    assert set(got) == {(g, s) for g in (3, 4, 5) for s in ("pts", "double_double")}
    assert got[5, "pts"].y == 12.0 and got[5, "double_double"].y == 1.0 and got[4, "double_double"].y == 0.0
    assert dict(zip(P.NAMES, got[3, "pts"].x)) == {"mean_5": 1.0, "mean_15": 1.0, "std_15": 1.0, "max_5": 2.0, "last": 2.0, "above_5": 2.0, "allowed": 1.0, "is_home": 1.0, "rest_days": 1.0, "games": 3.0}


def test_long_rows_are_not_shuffled(features):
    """Validation days are a row for each prop, so that every row stays where it is read; rows without a date are left out."""
    d = M.by_time(M.long_table(features.unionByName(features.limit(3).withColumn("date", F.lit(None).cast("date"))), PROPS))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    for prop, stat in (("points", "pts"), ("assists", "ast")):
        train, valid = split(features, stat)
        assert [d.where(f"prop = '{prop}' AND {c}").count() for c in ("NOT valid", "valid")] == [len(train), len(valid)]
