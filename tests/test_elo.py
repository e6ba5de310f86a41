"""Elo: linked teams, ratings by groups, and stored ratings that go on day by day over restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fieldhouse.features import elo

GAMES = "sport string, game_id long, date date, home_team_id long, away_team_id long, home_score double, away_score double"
DAY = datetime.date(2023, 1, 1)


def season(seed=1, leagues=3, days=30):
    """Leagues of one pool that never meet, two games a day for some teams, some games without scores, dates or teams."""
    r, rows = random.Random(seed), []
    for i in range(leagues * days * 3):
        league, day = r.randrange(leagues), r.randrange(days)
        a, b = r.sample(range(league * 10, league * 10 + 6), 2)
        score = (float(r.randrange(5)), float(r.randrange(5))) if r.random() < 0.9 else (None, None)
        rows.append((f"s{league % 2}", i, DAY + datetime.timedelta(days=day), a, b, *score))
    return rows + [("s0", 9001, None, 0, 1, 2.0, 1.0), ("s0", 9002, DAY, None, 1, 2.0, 1.0), ("s1", 9003, DAY, 12, None, 1.0, 1.0)]


def plain(rows):
    """Ratings before each game, and after all of them."""
    rating, out, day, todo = {}, {}, None, []
    for s, g, d, h, a, x, y in sorted(rows, key=lambda r: (r[2] is None, r[2] or DAY, r[1])):
        if h is None or a is None:
            continue
        if d != day:
            for t, c in todo:
                rating[t] = rating.get(t, 1500.0) + c
            todo, day = [], d
        out[g] = eh, ea = rating.get((s, h), 1500.0), rating.get((s, a), 1500.0)
        if x is not None:
            c = elo.change(eh, ea, x - y)
            todo += [((s, h), c), ((s, a), -c)]
    for t, c in todo:
        rating[t] = rating.get(t, 1500.0) + c
    return out, rating


def test_groups_that_never_meet(spark):
    rows = season()
    got = {(r.sport, r.team_id): r.component for r in elo.linked_teams(spark.createDataFrame(rows, GAMES).repartition(5)).collect()}
    links = {(r[0], *p) for r in rows if None not in r[3:5] for p in ((r[3], r[4]), (r[4], r[3]))}
    assert {k[1] // 10 for k in got} == {0, 1, 2} and len({(k[0], c) for k, c in got.items()}) == 3
    assert all(got[s, a] == got[s, b] for s, a, b in links) and all(c <= k[1] for k, c in got.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_ratings_equal_one_pass(spark, seed):
    rows = season(seed)
    want, final = plain(rows)
    history = elo.rated(spark.createDataFrame(rows, GAMES).repartition(5))
    got = {r.game_id: (r.home_elo, r.away_elo) for r in history.collect()}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)
    last = {(r.sport, r.team_id): r.rating for r in elo.ratings(history).collect()}
    assert all(last[t] == pytest.approx(final[t]) for t in final)


def test_column_and_task_formulas_agree(spark):
    r = random.Random(3)
    rows = [(r.uniform(900, 2200), r.uniform(900, 2200), float(r.randrange(-30, 31))) for _ in range(200)] + [(4000.0, 1000.0, 1.0), (1000.0, 4000.0, 3.0)]
    d = spark.createDataFrame(rows, "h double, a double, m double").withColumn("c", elo.change_column("h", "a", F.col("m")))
    assert all(x.c == pytest.approx(elo.change(x.h, x.a, x.m)) for x in d.collect())


def test_book_goes_on_over_restarts(spark, tmp_path, monkeypatch):
    """Founded on 20 days, then a day at a time by new objects, one of which is lost half-way: as one pass over all."""
    rows = [r for r in season() if r[2] is not None]
    games, path = spark.createDataFrame(rows, GAMES).repartition(3), f"file://{tmp_path}/book"
    until = lambda n: games.where(F.col("date") <= F.lit(DAY + datetime.timedelta(days=n)))
    elo.EloBook(spark, path, parts=4).found(games, DAY + datetime.timedelta(days=19))
    with pytest.raises(ValueError, match="begun"):
        elo.EloBook(spark, path, parts=4).found(games, DAY)
    got = {}
    for n in (21, 21, 24):
        for t in elo.EloBook(spark, path, parts=4).advance(until(n)):
            got |= {r.game_id: (r.home_elo, r.away_elo) for r in t.collect()}
    book, tries = elo.EloBook(spark, path, parts=4), []
    commit = book.table._commit
    monkeypatch.setattr(book.table, "_commit", lambda *a: commit(*a) if tries.append(1) or len(tries) < 3 else (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        book.advance(games)  # two days are committed, the third is not
    assert book.day() == DAY + datetime.timedelta(days=26)
    for t in elo.EloBook(spark, path, parts=4).advance(games):
        got |= {r.game_id: (r.home_elo, r.away_elo) for r in t.collect()}
    want, final = plain(rows)
    late = {r[1] for r in rows if r[2] > DAY + datetime.timedelta(days=19) and None not in r[3:5]}
    lost = {r[1] for r in rows if r[2] in (DAY + datetime.timedelta(days=25), DAY + datetime.timedelta(days=26))}
    assert set(got) == late - lost and all(got[g] == pytest.approx(want[g]) for g in got)
    stored = {(r.sport, r.team_id): r.rating for r in elo.EloBook(spark, path, parts=4).table.read().collect()}
    assert all(stored[t] == pytest.approx(final[t]) for t in final)
    assert elo.EloBook(spark, path, parts=4).advance(games) == []


def test_rewind_for_late_results(spark, tmp_path):
    rows = [r for r in season(5, days=6) if r[2] is not None]
    late = [r for r in rows if r[2] == DAY + datetime.timedelta(days=4)][0]
    book = elo.EloBook(spark, f"file://{tmp_path}/book", parts=4)
    book.advance(spark.createDataFrame([r for r in rows if r != late], GAMES))
    book.rewind(late[2])
    assert book.day() == DAY + datetime.timedelta(days=3)
    book.advance(spark.createDataFrame(rows, GAMES))
    _, final = plain(rows)
    stored = {(r.sport, r.team_id): r.rating for r in book.table.read().collect()}
    assert all(stored[t] == pytest.approx(final[t]) for t in final)
    with pytest.raises(ValueError, match="before"):
        book.rewind(DAY)


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], GAMES)
    assert elo.elo(none).count() == 0 and elo.linked_teams(none).count() == 0
    book = elo.EloBook(spark, f"file://{tmp_path}/book")
    assert book.day() is None and book.advance(none) == []
