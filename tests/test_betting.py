"""Parlays by bound against all combinations, legs that cannot be graded, markets without quotes."""

import datetime
import itertools
import random

import pytest

from fieldhouse.operators import betting as B

DAY = datetime.date(2024, 5, 1)
LEGS = "date date, leg string, game_id long, side string, is_prop boolean, prob double, price double"


def all_combinations(legs, rules):
    out = []
    for c in itertools.combinations(sorted(legs), rules.legs):
        sides = [x[2] for x in c]
        if len({x[1] for x in c}) < len(c) or sum(x[3] for x in c) > rules.most_props or max(map(sides.count, sides)) > int(rules.most_same * rules.legs + 1e-9):
            continue
        p = o = 1.0
        for x in c:
            p, o = p * x[4], o * x[5]
        ev = p * (o - 1) - (1 - p)
        if p >= rules.least_prob and ev >= 0:
            out.append((-round((rules.weight * p + (1 - rules.weight) * ev) * rules.penalty, 9), tuple(x[0] for x in c)))
    return sorted(out)[: rules.most]


def made(seed, n, games):
    r = random.Random(seed)
    return [(f"{i:04}", r.randrange(games), r.choice(["home", "away", "over"]), r.random() < 0.4, round(r.uniform(0.4, 0.9), 3), round(r.uniform(1.1, 2.6), 2)) for i in range(n)]


@pytest.mark.parametrize(("legs", "most", "same", "weight"), [(2, 3, 0.5, 0.6), (3, 10, 0.67, 0.6), (3, 1, 1.0, 0.0), (4, 6, 0.5, 1.0)])
@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_all_combinations(seed, legs, most, same, weight):
    rules = B.ParlayRules(legs, most, 0.05, 1, same, weight)
    rows = made(seed, 26, 12)
    assert [(s, k) for s, k, _, _ in B.search(rows, rules)] == all_combinations(rows, rules)


def test_ties_go_by_key():
    rows = [(f"{i}", i, "home" if i % 2 else "away", False, 0.7, 1.6) for i in range(8)]
    rules = B.ParlayRules(2, 4, 0.0, 2, 0.5)
    assert [k for _, k, _, _ in B.search(rows, rules)] == [k for _, k in all_combinations(rows, rules)]


def test_days_equal_all_combinations_and_far_legs_go(spark):
    """A day of 400 legs, a small one, one without any parlay; the bound leaves few legs of the large day for the search."""
    rules = B.ParlayRules(3, 4, 0.05, 1, 0.67)
    days = {DAY: made(3, 90, 40), DAY + datetime.timedelta(days=1): made(4, 9, 9), DAY + datetime.timedelta(days=2): made(5, 2, 2)}
    rows = [(d, *x) for d, legs in days.items() for x in legs] + [(None, "x", 1, "home", False, 0.9, 2.0), (DAY, "bad", 1, "home", False, None, 2.0), (DAY, "none", 1, "home", False, 0.9, 1.0)]
    got = {}
    for r in B.best_parlays(spark.createDataFrame(rows, LEGS).repartition(4), rules).collect():
        got.setdefault(r.date, []).append((r["rank"], -r.score, tuple(r["keys"])))
    want = {d: [(i, *x) for i, x in enumerate(all_combinations(legs, rules), 1)] for d, legs in days.items()}
    assert {d: sorted(x) for d, x in got.items()} == {d: x for d, x in want.items() if x}
    assert B.best_parlays(spark.createDataFrame([], LEGS)).count() == 0


GAMES = "game_id long, home_score double, away_score double, home_q1 double, home_q2 double, away_q1 double, away_q2 double"


def test_legs_that_cannot_be_graded(spark):
    games = spark.createDataFrame([(1, 3.0, 3.0, 0.0, 0.0, 0.0, 0.0), (2, None, 1.0, 1.0, 1.0, 1.0, 1.0), (3, 0.0, 0.0, None, None, None, None), (4, 2.0, 0.0, 1.0, 0.0, 0.0, 0.0)], GAMES)
    legs = [(1, "halftime_winner", "home", None), (1, "winner", "home", None), (1, "winner", "nobody", None), (1, "total", "over", None), (1, "spread", "home", None), (1, "draw", "yes", None), (2, "winner", "home", None), (3, "halftime_winner", "home", None), (3, "esports_clean_sweep", "yes", None), (3, "q4_winner", "home", None), (4, "halftime_winner", "home", None), (4, "overtime", "no", None), (4, "made up", "yes", None), (9, "winner", "home", None), (4, "total", "OVER ", 2.0), (4, "prop", "over", 1.0)]
    d = spark.createDataFrame([(g, k, s, x, None, None) for g, k, s, x in legs], "game_id long, kind string, selection string, line double, player_id long, stat string")
    got = {(r.game_id, r.kind, r.selection): r.result for r in B.graded(d, games).collect()}
    want = ["void", "push", "void", "void", "void", "won", "open", "void", "void", "void", "won", "won", "void", "open", "push", "void"]
    assert [got[g, k, s] for g, k, s, _ in legs] == want


def test_markets_are_whole(spark):
    """Every market has its sides together; a game without quotes or with excluded books alone has no candidates."""
    names = [s.market for s in B.SELECTIONS]
    assert len(set(names)) >= 30 and len({(s.market, s.selection) for s in B.SELECTIONS}) == len(names)
    p = spark.createDataFrame([(1, "a", DAY, {"btts_prob": 0.3, "draw_prob": 0.005}, 3.0, 150.0, 0.6), (2, "a", DAY, {"btts_prob": 0.9}, 0.0, 150.2, 0.6)], "game_id long, sport string, date date, probs map<string,double>, predicted_margin double, predicted_total double, confidence double")
    q = spark.createDataFrame([(1, 5, {"btts_odds": 2.0, "draw_odds": 90.0}, {"total_line": 150.0}), (1, 4, {"btts_no_odds": 3.0}, {}), (2, 9, {"btts_odds": 5.0}, {})], "game_id long, bookmaker long, prices map<string,double>, lines map<string,double>")
    got = [(r.game_id, r.market, r.selection, r.bookmaker, r.price, r.tier) for r in B.candidates(p, q, exclude=(9,)).collect()]
    assert got == [(1, "btts", "no", 4, 3.0, "A")]
    strict = spark.createDataFrame([("a", 0.8)], "sport string, threshold double")
    assert B.candidates(p, q, thresholds=strict).select("game_id").collect() == [(2,)]
