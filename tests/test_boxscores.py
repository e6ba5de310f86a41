"""Box-score families: formulas against plain Python on odd games, every feature moves, whole passes share one sort."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldhouse.features import boxscores as B
from fieldhouse.plans.box_queries import box_sql
from fieldhouse.plans.fixtures import Tables

TOY = B.Family(
    ("score", "shots", "pct"),
    {"won": "CASE WHEN m_score > o_score THEN 1.0 ELSE 0.0 END"},
    {"shots_pg": (4, "my.shots / n", -1.0), "share": (4, "my.shots / nullif(my.shots + op.shots, 0)", 0.5), "pct": (4, "avg.pct", 9.0), "pos": (4, "pos.pct", 8.0), "spread": (4, "sd.pct", 7.0), "trend": (4, "my2.score / n2 - my.score / n", 0.0), "won": (4, "my.won / n", 0.5)},
)
COLUMNS = "game_id long, date date, home_team_id long, away_team_id long, home_score double, away_score double, home_shots double, away_shots double, home_pct double, away_pct double"


def games():
    r, rows = random.Random(9), []
    value = lambda: r.choice([None, 0.0, 1.0, 2.0, 5.0])
    for i in range(60):
        a, b = r.sample(range(5), 2)
        score = (float(r.randrange(4)), float(r.randrange(4))) if r.random() < 0.9 else r.choice([(None, 1.0), (None, None)])
        rows.append((i, datetime.date(2024, 1, 1) + datetime.timedelta(days=i // 3), a, b, *score, value(), value(), value(), value()))
    return rows


def plain(rows):
    out = {}
    mean = lambda v: sum(v) / len(v) if v else None
    sides = [(g[0], g[1], g[2], True, *g[4::2], *g[5::2]) for g in rows] + [(g[0], g[1], g[3], False, *g[5::2], *g[4::2]) for g in rows]
    for game, day, team, home, *_ in sides:
        past = sorted((s for s in sides if s[2] == team and s[1] < day and s[4] is not None and s[7] is not None), key=lambda s: (s[1], s[0]))[-4:]
        if not past:
            out[game, home] = (-1.0, 0.5, 9.0, 8.0, 7.0, 0.0, 0.5)
            continue
        n, shots, against = len(past), sum(s[5] or 0 for s in past), sum(s[8] or 0 for s in past)
        pct = [s[6] for s in past if s[6] is not None]
        last = past[-2:]
        sd = math.sqrt(mean([(x - mean(pct)) ** 2 for x in pct])) if pct else None
        or_ = lambda v, d: d if v is None else v
        out[game, home] = (shots / n, shots / (shots + against) if shots + against else 0.5, or_(mean(pct), 9.0), or_(mean([x for x in pct if x > 0]), 8.0), or_(sd, 7.0), sum(s[4] for s in last) / len(last) - sum(s[4] for s in past) / n, sum(s[4] > s[7] for s in past) / n)
    return out


def test_formulas_equal_plain_python(spark):
    got = {(r.game_id, r.is_home): tuple(r)[3:] for r in B.box_features(spark.createDataFrame(games(), COLUMNS).repartition(3), TOY).collect()}
    want = plain(games())
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


ALL = B.FAMILIES | B.SCHEMES | {"last five": B.LAST_FIVE}


@pytest.mark.parametrize("name", sorted(ALL))
def test_every_feature_moves(spark, sf, name):
    family = ALL[name]
    d = B.box_features(spark.sql(box_sql(family), orders=Tables(spark, sf).base("orders")), family)
    kinds = d.agg(*(F.count_distinct(c).alias(c) for c in family.features), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in family.features)).first()
    assert all(kinds[c] > 1 and kinds[f"null_{c}"] == 0 for c in family.features), [c for c in family.features if kinds[c] < 2]


@pytest.mark.parametrize("name", sorted(ALL))
def test_formulas_name_what_is_there(name):
    family = ALL[name]
    there = {*family.stats, *family.derived}
    assert {x for kind, _, x in B.needs(family) if kind != "games"} <= there
    assert all(x in family.stats for kind, _, x in B.needs(family) if kind in ("op", "avgop", "posop"))
    assert all(m in family.stats for e in family.derived.values() for m in re.findall(r"\b[mo]_(\w+)", e))


def test_one_shuffle_for_a_family(spark):
    plan = B.box_features(spark.createDataFrame(games(), COLUMNS), TOY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2
