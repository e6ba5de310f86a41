"""Reports by run, and as-of features of games without dates."""

import datetime
import random

import pytest

from fieldhouse.features import asof
from fieldhouse.operators import history as H
from fieldhouse.sources.versioned import VersionedTable


def test_runs_against_their_predecessors(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "run long, k string, v long", ["run", "k"], 4)
    put = lambda run, rows: H.log(table, spark.createDataFrame([(run, *r) for r in rows], "run long, k string, v long"), "run")
    put(10, [("a", 1), ("b", 5), (None, 2)])
    put(30, [("a", 9)])
    put(20, [("a", 3), ("c", 1)])
    put(20, [("a", 4), ("c", 1)])  # the run is done again
    got = {(r.run, r.k): (r.v, r.v_before, r.v_change, r.state) for r in H.against_previous(table.read(), "run", ["k"], ["v"]).collect()}
    assert got == {
        (10, "a"): (1, None, None, "first"), (10, "b"): (5, None, None, "first"), (10, None): (2, None, None, "first"), (20, "a"): (4, 1, 3, "up"), (20, "b"): (None, 5, None, "gone"), (20, None): (None, 2, None, "gone"),
        (20, "c"): (1, None, None, "new"), (30, "a"): (9, 4, 5, "up"), (30, "c"): (None, 1, None, "gone"),
    }
    t = {r.k: (r.latest, r.previous, r.runs, r.direction) for r in H.trend(table.read(), "run", ["k"], "v", 2).collect()}
    assert t == {"a": (9, 4, 2, "rising"), "b": (5, None, 1, "short"), "c": (1, None, 1, "short"), None: (2, None, 1, "short")}


GAMES = "sport string, game_id long, date date, season int, home_team_id long, away_team_id long, home_score double, away_score double, status string"


@pytest.mark.parametrize("dated", [1.0, 0.5, 0.0])
def test_undated_games_see_nothing_later(spark, dated):
    """Ids in order of time, some dates gone: what is seen lies before in truth; without gaps it is ``as_of``."""
    r, rows = random.Random(3), []
    for i in range(120):
        a, b = r.sample(range(6), 2)
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=i // 3)
        rows.append(("s", i, day if r.random() < dated else None, 2024, a, b, *((float(r.randrange(5)), float(r.randrange(5))) if i < 110 else (None, None)), "final" if i < 110 else "scheduled"))
    tg = asof.team_games(spark.createDataFrame(rows, GAMES))
    seen = asof.as_of_undated(tg, {"ids": (0, lambda w: asof.F.collect_list("game_id").over(w))}).collect()
    assert len(seen) == 240
    date = {x[1]: x[2] for x in rows}
    for x in seen:
        ids = x.ids or []
        if dated == 1.0:
            mine = [i for i in ids]
            assert all(date[i] < date[x.game_id] for i in mine)
        for i in ids:
            assert i < x.game_id
        if dated == 0.0:
            assert sorted(ids) == sorted(g for _, g, _, _, h, a, s, _, _ in rows if x.team_id in (h, a) and g < x.game_id and s is not None)
    if dated == 1.0:
        plain = {(x.game_id, x.team_id): x.ids for x in asof.as_of(tg, {"ids": (0, lambda w: asof.F.collect_list("game_id").over(w))}).collect()}
        assert {(x.game_id, x.team_id): x.ids for x in seen} == plain
