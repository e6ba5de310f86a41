"""Parlays of the legs that can be among the best, against those of all legs."""

import datetime
import random

import pytest

from fieldhouse.operators import market as M
from fieldhouse.operators import more

DAY = datetime.date(2024, 5, 1)
CANDS = "date date, game_id long, selection string, prob double, price double"


def made(seed, games, step):
    r = random.Random(seed)
    days = [DAY + datetime.timedelta(days=d) for d in range(4)]
    return [(days[g % 3] if g > 2 else days[3], g, s, round(0.55 + 0.4 * r.randrange(step) / step, 6), round(1.02 + 2.5 * r.randrange(step) / step, 6)) for g in range(games) for s in ("home", "away") if r.random() < 0.7]


def rows(d):
    return sorted(map(tuple, d.collect()), key=str)


@pytest.mark.parametrize(("seed", "step"), [(1, 3), (2, 8), (3, 1000)])
@pytest.mark.parametrize(("legs", "most"), [(2, 3), (3, 2)])
def test_disjoint_parlays_of_contenders_are_those_of_all(spark, seed, step, legs, most):
    d = spark.createDataFrame(made(seed, 90 if legs == 2 else 45, step), CANDS).repartition(3)
    want = rows(M.disjoint(M.parlays(d, legs), most))
    assert want and rows(M.disjoint(M.parlays(M.contenders(d, legs, most), legs), most)) == want


@pytest.mark.parametrize("least", [0.0, 3.0, 9.0, 40.0])
def test_ladder_of_contenders_is_that_of_all(spark, least, monkeypatch):
    d = spark.createDataFrame(made(4, 80, 9), CANDS)
    got = rows(more.ladder(d, [("double", 2, 0.6, least)]))
    monkeypatch.setattr(more, "contenders", lambda cands, *_, **__: cands)
    assert got == rows(more.ladder(d, [("double", 2, 0.6, least)]))


def test_few_legs_of_a_large_day_meet_others(spark):
    """Of a day of 4,000 games, and of one whose legs are all alike, only a few are left."""
    r = random.Random(5)
    many = [(DAY, g, "home", round(r.uniform(0.55, 0.95), 6), round(r.uniform(1.5, 4.0), 6)) for g in range(4000)]
    alike = [(DAY + datetime.timedelta(days=1), g, "home", 0.7, 2.0) for g in range(4000)]
    left = {x["date"]: x["count"] for x in M.contenders(spark.createDataFrame(many + alike, CANDS), 2, 3).groupBy("date").count().collect()}
    assert left[DAY] < 100 and left[DAY + datetime.timedelta(days=1)] == 6
