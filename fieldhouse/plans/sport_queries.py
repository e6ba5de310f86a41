"""Features of single sports and all markets' outcomes as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..features import sports
from ..operators import outcomes as O
from .feature_queries import KEY, WIN
from .registry import query
from .table_queries import TG, rounded

BTG = TG.replace("FROM games", "FROM bouts")

_KINDS = {"finish": "regexp_matches(method, 'ko|sub') OR (method = '' AND fr <= 2)", "decision": "method LIKE '%dec%' OR (method = '' AND fr > 2)", "knockout": "method LIKE '%ko%'", "submission": "method LIKE '%sub%'", "early": "fr <= 2"}


@query(
    "i33_fighter_record",
    f"""WITH {BTG}, w AS (SELECT tg.*, {WIN} AS win, lower(coalesce(b.method, '')) AS method, b.finish_round AS fr FROM tg JOIN bouts b ON tg.game_id = b.game_id WHERE completed),
 c AS (SELECT *, CASE WHEN lag(win) OVER (PARTITION BY team_id ORDER BY date, game_id) = win THEN 0 ELSE 1 END AS ch FROM w), g AS (SELECT *, sum(ch) OVER (PARTITION BY team_id ORDER BY date, game_id) AS grp FROM c),
 r AS (SELECT *, CASE WHEN win = 1 THEN 1 ELSE -1 END * row_number() OVER (PARTITION BY team_id, grp ORDER BY date, game_id) AS run FROM g),
 past AS (SELECT t.game_id, t.team_id, t.is_home, t.date, p.game_id AS pg, p.date AS pdate, p.win, p.method, p.fr, p.run, row_number() OVER (PARTITION BY t.game_id, t.team_id, t.is_home ORDER BY p.date DESC, p.game_id DESC) AS k FROM tg t LEFT JOIN r p ON p.team_id = t.team_id AND p.date < t.date),
 a AS (SELECT {KEY}, date, avg(win) AS wp, sum(win) AS wins, count(pg) AS fights, coalesce(max(CASE WHEN k = 1 THEN run END), 0) AS run, max(pdate) AS last, avg(CASE WHEN win = 1 THEN fr END) AS ar, {', '.join(f"count(CASE WHEN win = 1 AND ({c}) THEN 1 END) AS {n}" for n, c in _KINDS.items())} FROM past WHERE k <= 10 GROUP BY {KEY}, date)
 SELECT {KEY}, round(coalesce(wp, 0), 6) AS win_pct, greatest(least(run, 10), 0) AS win_streak, greatest(least(-run, 10), 0) AS loss_streak, {', '.join(f'round(coalesce({n} / nullif(wins, 0), 0), 6) AS {n}_rate' for n in _KINDS)},
  round(coalesce(ar, 3), 6) AS avg_finish_round, fights, coalesce(least(date_diff('day', last, date), 730), 365) AS days_off FROM a""",
)
def _(t):
    return rounded(sports.fighter_record(t.bouts))


@query(
    "i32_surface_form",
    f"""WITH {BTG}, w AS (SELECT tg.*, {WIN} AS win, lower(b.surface) AS surface FROM tg JOIN bouts b ON tg.game_id = b.game_id),
 p AS (SELECT t.game_id, t.team_id, t.is_home, t.surface, p.game_id AS pg, p.win, p.opp_id = t.opp_id AS same, row_number() OVER (PARTITION BY t.game_id, t.team_id, t.is_home ORDER BY p.date DESC, p.game_id DESC) AS k,
  row_number() OVER (PARTITION BY t.game_id, t.team_id, t.is_home, p.opp_id = t.opp_id ORDER BY p.date DESC, p.game_id DESC) AS kh FROM w t LEFT JOIN w p ON p.team_id = t.team_id AND p.surface = t.surface AND p.completed AND p.date < t.date)
 SELECT {KEY}, surface, round(coalesce(avg(CASE WHEN k <= 20 THEN win END), 0), 6) AS surface_win_pct, count(CASE WHEN k <= 20 THEN pg END) AS surface_matches, round(coalesce(avg(CASE WHEN same AND kh <= 15 THEN win END), 0.5), 6) AS h2h_surface_win_pct FROM p GROUP BY {KEY}, surface""",
)
def _(t):
    return rounded(sports.surface_form(t.bouts))


@query(
    "i37_track_history",
    """WITH p AS (SELECT t.game_id, t.player_id, t.circuit_id, p.game_id AS pg, p.position, row_number() OVER (PARTITION BY t.game_id, t.player_id ORDER BY p.date DESC, p.game_id DESC) AS k FROM finishes t LEFT JOIN finishes p ON p.player_id = t.player_id AND p.circuit_id = t.circuit_id AND p.date < t.date)
 SELECT game_id, player_id, circuit_id, round(coalesce(avg(CASE WHEN position > 0 THEN position END), 0), 6) AS track_avg_finish, count(pg) AS track_races FROM p WHERE k <= 5 GROUP BY 1, 2, 3""",
)
def _(t):
    return rounded(sports.track_history(t.finishes))


_TEN = lambda x: f"CASE WHEN k <= 10 THEN {x} END"
_PART = lambda c, n: f"count(CASE WHEN k <= {n} AND {c} THEN 1 END) / nullif(count(CASE WHEN k <= {n} THEN pg END), 0)"
_FORM = {
    "avg_finish": f"avg({_TEN('position')})", "finish_std": f"stddev_samp({_TEN('position')})", "avg_to_par": f"avg({_TEN('score_to_par')})", "avg_rounds": f"avg({_TEN('rounds')})", "to_par_std": f"stddev_samp({_TEN('score_to_par')})",
    "best_to_par": f"min({_TEN('score_to_par')})", "worst_to_par": f"max({_TEN('score_to_par')})", "long_avg_finish": "avg(CASE WHEN k <= 20 THEN position END)", "long_to_par": "avg(CASE WHEN k <= 20 THEN score_to_par END)",
    "top_10_rate": _PART("position <= 10", 10), "top_25_rate": _PART("position <= 25", 10), "win_rate": _PART("position = 1", 10), "cut_rate": _PART("position > 0", 10), "long_top_10_rate": _PART("position <= 10", 20),
}
_TWO = lambda x: f"CASE WHEN count(CASE WHEN k <= 5 THEN position END) >= 2 THEN {x} END"
_TREND = {"finish_trend": "-regr_slope(CASE WHEN k <= 5 THEN position END, i)", "to_par_trend": "-regr_slope(CASE WHEN k <= 5 THEN score_to_par END, j)", "cuts_in_a_row": "max(CASE WHEN k = 1 THEN run END)", "top_5_last_3": "count(CASE WHEN k <= 3 AND position <= 5 THEN 1 END)"}


@query(
    "i36_tournament_form",
    f"""WITH c AS (SELECT *, count(CASE WHEN position IS NULL THEN 1 END) OVER x AS g, CAST(count(position) OVER x AS DOUBLE) AS i, CAST(count(score_to_par) OVER x AS DOUBLE) AS j FROM finishes WINDOW x AS (PARTITION BY player_id ORDER BY date, game_id)),
 r AS (SELECT *, count(position) OVER (PARTITION BY player_id, g ORDER BY date, game_id) AS run FROM c),
 past AS (SELECT t.game_id, t.player_id, t.date, p.game_id AS pg, p.date AS pdate, p.position, p.score_to_par, p.rounds, p.i, p.j, p.run, row_number() OVER (PARTITION BY t.game_id, t.player_id ORDER BY p.date DESC, p.game_id DESC) AS k FROM finishes t LEFT JOIN r p ON p.player_id = t.player_id AND p.date < t.date),
 a AS (SELECT game_id, player_id, {', '.join(f'coalesce({e}, 0) AS {n}' for n, e in (_FORM | {n: _TWO(e) for n, e in _TREND.items()}).items())}, count(CASE WHEN k <= 10 THEN pg END) AS played, coalesce(date_diff('day', max(pdate), date), 14) AS rest_days, count(CASE WHEN pdate >= date - INTERVAL 30 DAY THEN 1 END) AS last_30d FROM past GROUP BY game_id, player_id, date)
 SELECT game_id, player_id, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in (*_FORM, *_TREND))}, played, rest_days, last_30d, round(coalesce(avg(CASE WHEN played > 0 THEN avg_finish END) OVER (PARTITION BY game_id), 0), 6) AS field_strength FROM a""",
)
def _(t):
    return rounded(sports.tournament_form(t.finishes))


@query(
    "i12_standings_features",
    f"""WITH {TG}, w AS (SELECT *, {WIN} AS win, row_number() OVER (PARTITION BY season, team_id ORDER BY date DESC, game_id DESC) AS k FROM tg WHERE completed),
 a AS (SELECT season, w.team_id, any_value(conference) AS conference, count(*) AS games, avg(win) AS p, avg(CASE WHEN is_home THEN win END) AS h, avg(CASE WHEN NOT is_home THEN win END) AS aw, avg(CASE WHEN k <= 10 THEN win END) AS l10, sum(pf) AS f, sum(pa) AS ag, min(CASE WHEN win = 1 THEN k END) AS kw, min(CASE WHEN win = 0 THEN k END) AS kl
  FROM w LEFT JOIN teams t ON t.team_id = w.team_id GROUP BY 1, 2)
 SELECT season, team_id, games, round(p, 6) AS win_pct, round(coalesce(h, 0), 6) AS home_win_pct, round(coalesce(aw, 0), 6) AS away_win_pct, round(l10, 6) AS last_ten_win_pct, round(CASE WHEN conference IS NOT NULL THEN (max(p) OVER (PARTITION BY season, conference) - p) * games / 2 ELSE 0 END, 6) AS games_behind,
  CASE WHEN conference IS NOT NULL THEN row_number() OVER (PARTITION BY season, conference ORDER BY p DESC, team_id) ELSE 0 END AS conference_rank, CASE WHEN kw = 1 THEN coalesce(kl - 1, games) ELSE -coalesce(kw - 1, games) END AS streak, f - ag AS points_difference, round(coalesce(ag / nullif(f + ag, 0), 0), 6) AS schedule_strength FROM a""",
)
def _(t):
    return rounded(sports.standings_features(t.games, t.teams))


# ---------------------------------------------------------------- markets

H, A = "home_score", "away_score"
_REG = lambda s, o: f"CASE WHEN home_ot IS NOT NULL AND away_ot IS NOT NULL AND home_score <> away_score THEN {s} - {o} ELSE {s} END"
_RH, _RA = _REG(H, "home_ot"), _REG(A, "away_ot")
_HALF = ("home_q1 + home_q2", "away_q1 + away_q2")
OUTCOMES = {
    "winner": f"{H} > {A}", "draw": f"{H} = {A}", "overtime": "home_ot IS NOT NULL AND away_ot IS NOT NULL", "first_period_home": "home_q1 > away_q1", "halftime_home": f"{_HALF[0]} > {_HALF[1]}", "second_half_home": "home_q3 + home_q4 > away_q3 + away_q4",
    "regulation_home": f"{_RH} > {_RA}", "regulation_draw": f"{_RH} = {_RA}", "both_score": f"{H} > 0 AND {A} > 0", "clean_sheet_home": f"{A} = 0", "clean_sheet_away": f"{H} = 0",
    "straight_sets": f"({H} > {A} AND home_q1 > away_q1 AND home_q2 > away_q2) OR ({H} <= {A} AND home_q1 < away_q1 AND home_q2 < away_q2)", "dominant_win": f"abs({H} - {A}) >= 4",
    "total_over": f"{H} + {A} > total_line", "home_total_over": f"{H} > home_line", "away_total_over": f"{A} > away_line", "comeback_home": f"CASE WHEN {_HALF[0]} < {_HALF[1]} THEN {H} > {A} END", "comeback_away": f"CASE WHEN {_HALF[0]} > {_HALF[1]} THEN {A} > {H} END",
    "clean_sweep": f"least({H}, {A}) = 0", "maps_over_2": f"{H} + {A} > 2", "decider_map": f"greatest({H}, {A}) > 0 AND {H} + {A} = 2 * greatest({H}, {A}) - 1", "home_sweep": f"{H} > {A} AND {A} = 0", "away_sweep": f"{A} > {H} AND {H} = 0",
}
BAND = f"CASE WHEN {H} + {A} <= 5 THEN 'low' WHEN {H} + {A} <= 8 THEN 'mid' ELSE 'high' END"
NAMES = [*OUTCOMES, "total_low", "total_mid", "total_high"]
_PROB = {n: f"CAST((game_id * {2 * i + 3} + {i}) % 101 AS DOUBLE) / 100" for i, n in enumerate(NAMES)}
_CALL = {n: f"{_PROB[n]} >= 0.5" for n in OUTCOMES} | {"regulation_draw": f"{_PROB['regulation_draw']} > {_PROB['regulation_home']} AND {_PROB['regulation_draw']} > 1 - {_PROB['regulation_home']} AND {_PROB['regulation_draw']} > 0.28"}
_TOP = f"greatest({_PROB['total_low']}, {_PROB['total_mid']}, {_PROB['total_high']})"


@query("n7_outcome_labels", f"WITH m AS (SELECT median(abs({H} - {A})) AS m FROM period_scores) SELECT game_id, {', '.join(f'CAST(({c}) AS INT) AS {n}' for n, c in OUTCOMES.items())}, {BAND} AS total_band, CASE WHEN abs({H} - {A}) <= m THEN 'close' ELSE 'wide' END AS margin_band FROM period_scores, m")
def _(t):
    return O.labels(t.period_scores)


@query(
    "k7_market_report",
    "WITH u AS (" + " UNION ALL ".join(f"SELECT '{n}' AS bet_type, ({_CALL[n]}) = ({c}) AS hit, ({c}) AS happened, {_PROB[n]} AS prob FROM period_scores" for n, c in OUTCOMES.items())
    + f" UNION ALL SELECT 'total_band', CASE WHEN {_PROB['total_low']} = {_TOP} THEN 'low' WHEN {_PROB['total_mid']} = {_TOP} THEN 'mid' ELSE 'high' END = {BAND}, NULL, NULL FROM period_scores)"
    + " SELECT bet_type, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN happened THEN 1.0 WHEN NOT happened THEN 0.0 END), 6) AS base_rate, round(avg(pow(prob - CASE WHEN happened THEN 1.0 WHEN NOT happened THEN 0.0 END, 2)), 6) AS brier FROM u WHERE hit IS NOT NULL GROUP BY 1",
)
def _(t):
    markets = F.create_map(*(x for n in NAMES for x in (F.lit(n), F.expr(_PROB[n]))))
    return rounded(O.report(t.period_scores.withColumn("markets", markets)))
