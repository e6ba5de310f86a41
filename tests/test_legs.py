"""Legs of many kinds: what they need is made once a game, and only legs of players meet players."""

from fieldhouse.operators import betting as B

GAMES = "game_id long, home_score double, away_score double, home_q1 double, home_q2 double, away_q1 double, away_q2 double"
LEGS = "game_id long, kind string, selection string, line double, player_id long, stat string"


def test_numbers_are_made_once_a_game(spark):
    games = spark.createDataFrame([(1, 3.0, 2.0, 1.0, 1.0, 2.0, 0.0)], GAMES)
    players = spark.createDataFrame([(1, 7, 10.0, 4.0, None), (1, 7, 5.0, 1.0, None)], "game_id long, player_id long, pts double, reb double, ast double")
    legs = [(1, "prop", "over", 14.0, 7, "pts"), (1, "prop", "under", 5.0, 7, "reb"), (1, "prop", "over", 1.0, 7, "ast"), (1, "prop", "over", 1.0, 8, "pts"), (1, "prop", "over", 1.0, 7, None), (1, "btts", None, None, None, None), (1, "q1_winner", "away", None, None, None), (1, "total_band", "low", None, None, None), (1, "winner", "home", None, 7, "pts")]
    d = B.graded(spark.createDataFrame(legs, LEGS), games, players)
    got = {(r.kind, r.selection, r.player_id, r.stat): (r.result, r.stat_value) for r in d.collect()}
    want = [("won", 15.0), ("push", 5.0), ("void", None), ("void", None), ("void", None), ("lost", None), ("won", None), ("won", None), ("won", 15.0)]
    assert [got[k, s, p, t] for _, k, s, _, p, t in legs] == want
    lines = d._jdf.queryExecution().optimizedPlan().toString().splitlines()
    above = lines[: next(i for i, line in enumerate(lines) if "Join" in line)]
    assert above and not any("home_q1" in line or "away_q2" in line for line in above)
