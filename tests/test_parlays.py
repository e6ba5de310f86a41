"""All parlays of a day against plain combinations; a pair costs arithmetic on columns only."""

import datetime
import itertools
import math
import random

import pytest

from fieldhouse.operators import market as M

DAY = datetime.date(2024, 5, 1)
CANDS = "date date, game_id long, selection string, prob double, price double"


@pytest.mark.parametrize("legs", [1, 2, 3])
def test_parlays_equal_all_combinations(spark, legs):
    r = random.Random(legs)
    rows = [(DAY + datetime.timedelta(days=g % 2), g, s, round(r.uniform(0.5, 0.9), 3), round(r.uniform(1.0, 2.2), 2)) for g in range(24) for s in ("home", "away") if r.random() < 0.8]
    rows += [(None, 90, "home", 0.9, 2.0), (None, 91, "home", 0.9, 2.0), (DAY, 92, "home", None, 2.0), (DAY, 93, "home", 0.9, None), (DAY + datetime.timedelta(days=2), 94, "home", 0.9, 2.0)]
    want = {}
    for c in itertools.combinations(sorted((x for x in rows if None not in x), key=lambda x: x[1:3]), legs):
        p, o = math.prod(x[3] for x in c) * 0.97 ** (legs - 1), math.prod(x[4] for x in c)
        if len({x[0] for x in c}) == 1 and len({x[1] for x in c}) == legs and min(x[3] for x in c) >= 0.55 and p * (o - 1) - (1 - p) >= 0:
            want[c[0][0], tuple(x[1:3] for x in c)] = (p, o)
    got = M.parlays(spark.createDataFrame(rows, CANDS).where("date IS NOT NULL"), legs).collect()
    assert want and len(got) == len(want)
    for x in got:
        p, o = want[x.date, tuple(map(tuple, x.key))]
        assert x.games == [g for g, _ in x.key] and math.isclose(x.prob, p, rel_tol=1e-12) and math.isclose(x.price, o, rel_tol=1e-12) and x.ev >= 0


def test_pairs_are_judged_in_the_join_and_days_are_spread(spark):
    """No lambda over an array runs per pair, the value is a condition of the join, and a few bytes of days are not one task."""
    d = spark.createDataFrame([(DAY + datetime.timedelta(days=i % 50), i, "home", 0.7, 2.0) for i in range(500)], CANDS)
    p = M.parlays(d).select("date", "price", "prob")
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    (join,) = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "lambda" not in plan and "price" in join and "game_id" in join
    assert p.count() == 50 * 45 and p.rdd.getNumPartitions() >= 16
