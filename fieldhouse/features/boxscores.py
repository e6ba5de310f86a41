"""Rolling features of box scores, sport by sport.

A family names a sport's box-score columns, what is derived of them in each game, and its features: formulas over what the team's
last games of earlier dates add up to. All of a family comes from one as-of pass: one shuffle and one sort by team,
however many features it has. In formulas, over the feature's window:

  my.x, op.x      sum of the team's, the opponent's x (nulls as 0)
  avg.x, avgop.x  mean over games that have x
  pos.x, posop.x  mean over games where x is above 0
  sd.x            deviation of x over games that have it (of the whole, not of a sample)
  n               games
  my3.x, n3, ...  the same over the last 3 games (any number)

A feature is its default where the formula is null: no games, or nothing to divide by.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import asof


@dataclass(frozen=True)
class Family:
    """``stats``: columns ``home_<x>`` and ``away_<x>``; ``derived``: SQL over m_<x> and o_<x>; ``features``: window, formula, default;
    ``within``: what a game must share with the games it looks back on, besides the team."""

    stats: tuple[str, ...]
    derived: dict[str, str]
    features: dict[str, tuple[int, str, float]]
    within: tuple[str, ...] = ()


def _per_game(n: int, **of: str) -> dict[str, tuple[int, str, float]]:
    """Sums per game."""
    return {name: (n, f"my.{x} / n", 0.0) for name, x in of.items()}


def _means(n: int, default: float = 0.0, **of: str) -> dict[str, tuple[int, str, float]]:
    return {name: (n, f"avg{'op' if x.startswith('-') else ''}.{x.lstrip('-')}", default) for name, x in of.items()}


_RESULT = {"won": "CASE WHEN m_score > o_score THEN 1.0 ELSE 0.0 END", "gap": "abs(m_score - o_score)"}

BASKETBALL = Family(
    ("score", "fast_break_points", "points_in_paint", "second_chance_points", "turnover_points", "offensive_rebounds", "defensive_rebounds", "turnovers", "steals", "blocks", "fouls", "largest_lead", "fgm", "fga", "three_m", "three_a", "ftm", "fta", "assists", "possessions", "offensive_rating"),
    {"net": "m_offensive_rating - o_offensive_rating"},
    _per_game(10, fast_break_pg="fast_break_points", paint_pts_pg="points_in_paint", second_chance_pg="second_chance_points", turnover_pts_pg="turnover_points", off_reb_pg="offensive_rebounds", def_reb_pg="defensive_rebounds", to_pg="turnovers", stl_pg="steals", blk_pg="blocks", fouls_pg="fouls", largest_lead_pg="largest_lead", three_a_pg="three_a")
    | {
        "efg_pct": (10, "(my.fgm + 0.5 * my.three_m) / greatest(my.fga, 1)", 0.0), "ts_pct": (10, "my.score / greatest(2 * (my.fga + 0.44 * my.fta), 1)", 0.0),
        "possessions_pg": (10, "coalesce(pos.possessions, (my.fga + 0.44 * my.fta - my.offensive_rebounds + my.turnovers) / n)", 0.0),
        "off_rtg_pg": (10, "pos.offensive_rating", 0.0), "def_rtg_pg": (10, "posop.offensive_rating", 0.0), "net_rtg_pg": (10, "avg.net", 0.0),
        "three_pct": (10, "my.three_m / greatest(my.three_a, 1)", 0.0), "ft_pct": (10, "my.ftm / greatest(my.fta, 1)", 0.0), "ast_to_ratio": (10, "my.assists / greatest(my.turnovers, 1)", 0.0),
        "ftr": (10, "my.fta / greatest(my.fga, 1)", 0.0), "tov_pct": (10, "100 * my.turnovers / greatest(my.fga + 0.44 * my.fta + my.turnovers, 1)", 0.0),
        "three_p_rate": (10, "my.three_a / greatest(my.fga, 1)", 0.0), "pts_per_fga": (10, "my.score / greatest(my.fga, 1)", 0.0),
    },
)

HOCKEY = Family(
    ("score", "shots_on_goal", "blocked_shots", "power_play_goals", "power_play_attempts", "penalty_minutes", "hits", "faceoffs_won", "faceoffs_lost", "takeaways", "giveaways", "shooting_pct", "shorthanded_goals", "shootout_goals", "p1", "p2", "ot"),
    _RESULT | {
        "extra": "CASE WHEN m_ot IS NOT NULL THEN 1.0 ELSE 0.0 END", "extra_won": "CASE WHEN m_ot IS NOT NULL AND m_score > o_score THEN 1.0 ELSE 0.0 END",
        "led1": "CASE WHEN m_p1 > o_p1 THEN 1.0 ELSE 0.0 END", "held1": "CASE WHEN m_p1 > o_p1 AND m_score > o_score THEN 1.0 ELSE 0.0 END",
        "led2": "CASE WHEN m_p1 + m_p2 > o_p1 + o_p2 THEN 1.0 ELSE 0.0 END", "held2": "CASE WHEN m_p1 + m_p2 > o_p1 + o_p2 AND m_score > o_score THEN 1.0 ELSE 0.0 END",
        "close": "CASE WHEN abs(m_score - o_score) <= 1 THEN 1.0 ELSE 0.0 END", "close_won": "CASE WHEN abs(m_score - o_score) <= 1 AND m_score > o_score THEN 1.0 ELSE 0.0 END",
        "far": "CASE WHEN abs(m_score - o_score) >= 3 THEN 1.0 ELSE 0.0 END", "far_won": "CASE WHEN abs(m_score - o_score) >= 3 AND m_score > o_score THEN 1.0 ELSE 0.0 END",
    },
    {
        "corsi_pct": (10, "100 * my.shots_on_goal / nullif(my.shots_on_goal + op.shots_on_goal, 0)", 50.0),
        "fenwick_pct": (10, "100 * greatest(my.shots_on_goal - my.blocked_shots, 0) / nullif(greatest(my.shots_on_goal - my.blocked_shots, 0) + greatest(op.shots_on_goal - op.blocked_shots, 0), 0)", 50.0),
        "shots_for_pg": (10, "my.shots_on_goal / n", 0.0), "shots_against_pg": (10, "op.shots_on_goal / n", 0.0),
        "pp_pct": (10, "100 * my.power_play_goals / nullif(coalesce(nullif(my.power_play_attempts, 0), op.penalty_minutes / 2), 0)", 0.0),
        "pk_pct": (10, "100 * (1 - op.power_play_goals / nullif(coalesce(nullif(op.power_play_attempts, 0), my.penalty_minutes / 2), 0))", 0.0),
        "pp_opportunities_pg": (10, "coalesce(nullif(my.power_play_attempts, 0), op.penalty_minutes / 2) / n", 0.0), "pim_pg": (10, "my.penalty_minutes / n", 0.0),
        "pp_trend": (10, "100 * my3.power_play_goals / nullif(coalesce(nullif(my3.power_play_attempts, 0), op3.penalty_minutes / 2), 0) - 100 * my.power_play_goals / nullif(coalesce(nullif(my.power_play_attempts, 0), op.penalty_minutes / 2), 0)", 0.0),
        "goalie_sv_pct": (10, "100 * (1 - op.score / nullif(greatest(op.shots_on_goal, op.score), op.score))", 0.0), "goalie_gaa": (10, "op.score / n", 0.0), "goalie_win_pct": (10, "my.won / n", 0.0),
        "ot_rate": (30, "my.extra / n", 0.25), "ot_win_rate": (30, "my.extra_won / nullif(my.extra, 0)", 0.5),
        "lead_p1_protection_rate": (20, "my.held1 / nullif(my.led1, 0)", 0.70), "lead_p2_protection_rate": (20, "my.held2 / nullif(my.led2, 0)", 0.75),
        "close_game_win_pct": (20, "my.close_won / nullif(my.close, 0)", 0.5), "blowout_win_pct": (20, "my.far_won / nullif(my.far, 0)", 0.5), "one_goal_rate": (20, "my.close / n", 0.0),
        "hits_pg": (10, "my.hits / n", 0.0), "blocked_shots_pg": (10, "my.blocked_shots / n", 0.0), "faceoff_pct": (10, "100 * my.faceoffs_won / nullif(my.faceoffs_won + my.faceoffs_lost, 0)", 50.0),
        "takeaway_giveaway_ratio": (10, "my.takeaways / nullif(my.giveaways, 0)", 1.0), "shooting_pct": (10, "avg.shooting_pct", 8.0), "shorthanded_goals_pg": (10, "my.shorthanded_goals / n", 0.0), "shootout_goals_pg": (10, "my.shootout_goals / n", 0.0),
        "goals_l3": (3, "my.score / n", 0.0), "goals_trend": (7, "my3.score / n3 - my.score / n", 0.0),
    },
)

FOOTBALL = Family(
    ("score", "passing_yards", "rushing_yards", "turnovers", "sacks", "penalties", "sacks_allowed", "completion_pct", "first_downs", "penalty_yards", "passing_touchdowns", "rushing_touchdowns", "yards_per_play", "receiving_yards", "interceptions_thrown", "tackles", "fumbles_lost", "passing_epa", "rushing_epa", "air_yards", "yac", "third_down_conv", "third_down_att", "fourth_down_conv", "fourth_down_att", "red_zone_pct", "possession_seconds", "defensive_tds", "rushing_attempts", "pass_attempts", "field_goals_made", "field_goals_attempted", "punt_yards"),
    {"held": "coalesce(m_possession_seconds, 1800.0) / 60.0"},
    _means(10, pass_yds_pg="passing_yards", rush_yds_pg="rushing_yards", pass_yds_allowed_pg="-passing_yards", rush_yds_allowed_pg="-rushing_yards", turnovers_pg="turnovers", takeaways_pg="-turnovers", sacks_pg="sacks", penalties_pg="penalties", sacks_allowed_pg="sacks_allowed", completion_pct="completion_pct", first_downs_pg="first_downs", penalty_yards_pg="penalty_yards", passing_tds_pg="passing_touchdowns", rushing_tds_pg="rushing_touchdowns", game_yards_per_play="yards_per_play", yards_per_play_allowed="-yards_per_play", receiving_yds_pg="receiving_yards", int_thrown_pg="interceptions_thrown", int_thrown_allowed_pg="-interceptions_thrown", tackles_pg="tackles", fumbles_lost_pg="fumbles_lost", epa_pass_off="passing_epa", epa_rush_off="rushing_epa", epa_pass_def="-passing_epa", epa_rush_def="-rushing_epa", air_yards_pg="air_yards", yac_pg="yac", air_yards_allowed_pg="-air_yards", yac_allowed_pg="-yac", time_of_possession="held")
    | {
        "total_yds_pg": (10, "coalesce(avg.passing_yards, 0) + coalesce(avg.rushing_yards, 0)", 0.0), "total_tds_pg": (10, "coalesce(avg.passing_touchdowns, 0) + coalesce(avg.rushing_touchdowns, 0)", 0.0), "tds_allowed_pg": (10, "coalesce(avgop.passing_touchdowns, 0) + coalesce(avgop.rushing_touchdowns, 0)", 0.0),
        "epa_total_off": (10, "coalesce(avg.passing_epa, 0) + coalesce(avg.rushing_epa, 0)", 0.0), "epa_total_def": (10, "coalesce(avgop.passing_epa, 0) + coalesce(avgop.rushing_epa, 0)", 0.0),
        "third_down_pct": (10, "my.third_down_conv / nullif(my.third_down_att, 0)", 0.0), "fourth_down_pct": (10, "my.fourth_down_conv / nullif(my.fourth_down_att, 0)", 0.0), "red_zone_pct": (10, "pos.red_zone_pct", 0.0),
        "turnover_margin": (10, "(op.turnovers - my.turnovers) / n", 0.0), "defensive_td_pg": (10, "my.defensive_tds / n", 0.0),
        "rush_pct": (10, "my.rushing_attempts / nullif(my.rushing_attempts + my.pass_attempts, 0)", 0.5), "pass_pct": (10, "my.pass_attempts / nullif(my.rushing_attempts + my.pass_attempts, 0)", 0.5), "yards_per_play": (10, "(my.rushing_yards + my.passing_yards) / nullif(my.rushing_attempts + my.pass_attempts, 0)", 0.0),
        "fg_pct": (10, "my.field_goals_made / nullif(my.field_goals_attempted, 0)", 0.0), "punt_avg": (10, "my.punt_yards / n", 0.0),
    },
)

SOCCER = Family(
    ("score", "xg", "possession", "passes_completed", "passes", "pressures", "shots", "shots_on_target", "saves", "crosses", "accurate_crosses", "penalty_goals", "h1", "h2", "corners", "set_piece_goals", "fouls", "yellow_cards", "red_cards", "tackle_pct", "clearances", "longball_pct", "cross_pct", "offsides", "interceptions", "blocked_shots"),
    _RESULT | {
        "clean": "CASE WHEN o_score = 0 THEN 1.0 ELSE 0.0 END", "scored": "CASE WHEN m_score > 0 THEN 1.0 ELSE 0.0 END", "level": "CASE WHEN m_score = o_score THEN 1.0 ELSE 0.0 END",
        "both_for": "CASE WHEN m_h1 > 0 AND m_h2 > 0 THEN 1.0 ELSE 0.0 END", "both_against": "CASE WHEN o_h1 > 0 AND o_h2 > 0 THEN 1.0 ELSE 0.0 END",
        "led": "CASE WHEN m_h1 > o_h1 THEN 1.0 ELSE 0.0 END", "led_won": "CASE WHEN m_h1 > o_h1 AND m_score > o_score THEN 1.0 ELSE 0.0 END",
        "behind": "CASE WHEN m_h1 < o_h1 THEN 1.0 ELSE 0.0 END", "behind_saved": "CASE WHEN m_h1 < o_h1 AND m_score >= o_score THEN 1.0 ELSE 0.0 END",
    },
    {
        "xg": (10, "avg.xg", 0.0), "xga": (10, "avgop.xg", 0.0), "xg_diff": (10, "avg.xg - avgop.xg", 0.0), "xg_overperformance": (10, "avg.score - avg.xg", 0.0),
        "clean_sheet_rate": (10, "my.clean / n", 0.0), "scoring_rate": (10, "my.scored / n", 0.0), "avg_goals_scored": (10, "my.score / n", 0.0), "avg_goals_conceded": (10, "op.score / n", 0.0),
        "possession_pct": (10, "avg.possession", 50.0), "pass_completion_pct": (10, "100 * my.passes_completed / nullif(my.passes, 0)", 0.0), "passes_pg": (10, "my.passes / n", 0.0), "pressing_intensity": (10, "avg.pressures", 0.0),
        "shots_pg": (10, "my.shots / n", 0.0), "shots_on_target_pg": (10, "my.shots_on_target / n", 0.0), "shot_accuracy": (10, "100 * my.shots_on_target / nullif(my.shots, 0)", 0.0), "shot_conversion": (10, "100 * my.score / nullif(my.shots, 0)", 0.0),
        "xg_proxy": (10, "my.shots_on_target / n * my.score / nullif(my.shots, 0)", 0.0), "shot_quality_idx": (10, "100 * my.shots_on_target / nullif(my.shots, 0) * my.score / nullif(my.shots, 0)", 0.0),
        "crosses_pg": (10, "my.crosses / n", 0.0), "cross_accuracy": (10, "100 * my.accurate_crosses / nullif(my.crosses, 0)", 0.0), "non_pen_goals_pg": (10, "(my.score - my.penalty_goals) / n", 0.0),
        "gf_l5": (5, "my.score / n", 0.0), "ga_l5": (5, "op.score / n", 0.0), "draw_rate_l5": (5, "my.level / n", 0.0), "scored_both_halves_rate": (5, "my.both_for / n", 0.0), "conceded_both_halves_rate": (5, "my.both_against / n", 0.0), "first_half_goals_pg": (5, "my.h1 / n", 0.0), "second_half_goals_pg": (5, "my.h2 / n", 0.0),
        "ht_lead_hold_rate": (15, "my.led_won / nullif(my.led, 0)", 0.0), "ht_lead_rate": (15, "my.led / n", 0.0), "ht_comeback_rate": (15, "my.behind_saved / nullif(my.behind, 0)", 0.0),
        "tackle_pct": (10, "pos.tackle_pct", 0.0), "longball_pct": (10, "pos.longball_pct", 0.0), "cross_pct": (10, "pos.cross_pct", 0.0), "goals_trend": (7, "my3.score / n3 - my.score / n", 0.0),
    }
    | _per_game(10, corners_pg="corners", set_piece_goals_pg="set_piece_goals", fouls_pg="fouls", yellow_cards_pg="yellow_cards", red_cards_pg="red_cards", clearances_pg="clearances", saves_pg="saves", offsides_pg="offsides", interceptions_pg="interceptions", blocked_shots_pg="blocked_shots"),
)

BASEBALL = Family(
    ("score", "hits", "at_bats", "walks", "hbp", "sac_flies", "total_bases", "home_runs", "strikeouts", "bullpen_era", "bullpen_ip", "era", "innings_pitched", "errors", "balls_in_play", "whip", "pitching_strikeouts", "pitching_walks", "pitching_home_runs", "batters_faced", "ground_outs", "fly_outs", "earned_runs", "hits_allowed", "i1", "i7", "i8", "i9", "extras"),
    _RESULT | {
        "one": "CASE WHEN abs(m_score - o_score) = 1 THEN 1.0 ELSE 0.0 END", "one_won": "CASE WHEN m_score - o_score = 1 THEN 1.0 ELSE 0.0 END", "long": "CASE WHEN m_extras > 0 OR o_extras > 0 THEN 1.0 ELSE 0.0 END",
        "first": "CASE WHEN m_i1 IS NOT NULL AND o_i1 IS NOT NULL THEN CASE WHEN m_i1 > 0 THEN 1.0 ELSE 0.0 END END", "good_start": "CASE WHEN m_innings_pitched > 0 THEN CASE WHEN 9 * m_earned_runs / m_innings_pitched < 4.5 THEN 1.0 ELSE 0.0 END END",
        "late": "m_i7 + m_i8 + m_i9", "relief_era": "coalesce(nullif(m_bullpen_era, 0), m_era)", "relief_ip": "coalesce(nullif(m_bullpen_ip, 0), m_innings_pitched)",
    },
    {
        "batting_avg": (10, "my.hits / nullif(my.at_bats, 0)", 0.0), "obp": (10, "(my.hits + my.walks + my.hbp) / nullif(my.at_bats + my.walks + my.hbp + my.sac_flies, 0)", 0.0), "slg": (10, "my.total_bases / nullif(my.at_bats, 0)", 0.0),
        "ops": (10, "(my.hits + my.walks + my.hbp) / nullif(my.at_bats + my.walks + my.hbp + my.sac_flies, 0) + my.total_bases / nullif(my.at_bats, 0)", 0.0), "iso": (10, "(my.total_bases - my.hits) / nullif(my.at_bats, 0)", 0.0),
        "k_rate": (10, "my.strikeouts / nullif(my.at_bats, 0)", 0.0), "bb_rate": (10, "my.walks / nullif(my.at_bats + my.walks + my.hbp + my.sac_flies, 0)", 0.0),
        "bullpen_era": (7, "avg.relief_era", 0.0), "bullpen_ip_avg": (7, "avg.relief_ip", 0.0), "bullpen_usage": (7, "my.relief_ip", 0.0),
        "def_efficiency": (10, "1 - my.errors / nullif(my.balls_in_play, 0)", 0.0), "errors_pg": (10, "my.errors / n", 0.0), "runs_l5": (5, "my.score / n", 0.0), "runs_against_l5": (5, "op.score / n", 0.0), "run_diff_l5": (5, "(my.score - op.score) / n", 0.0),
        "team_whip": (10, "pos.whip", 0.0), "team_era": (10, "pos.era", 0.0), "team_k_rate": (10, "my.pitching_strikeouts / nullif(my.batters_faced, 0)", 0.0), "team_bb_rate": (10, "my.pitching_walks / nullif(my.batters_faced, 0)", 0.0), "team_hr_rate": (10, "my.pitching_home_runs / nullif(my.batters_faced, 0)", 0.0), "team_go_ao_ratio": (10, "my.ground_outs / nullif(my.fly_outs, 0)", 1.0),
        "one_run_win_pct": (20, "my.one_won / nullif(my.one, 0)", 0.5), "extra_innings_rate": (20, "my.long / n", 0.1), "first_to_score_rate": (20, "avg.first", 0.5), "late_innings_scoring": (20, "avg.late / 3", 0.0),
        "sp_era": (10, "least(9 * my.earned_runs / nullif(my.innings_pitched, 0), 27)", 0.0), "sp_k_per_9": (10, "9 * my.pitching_strikeouts / nullif(my.innings_pitched, 0)", 0.0), "sp_bb_per_9": (10, "9 * my.pitching_walks / nullif(my.innings_pitched, 0)", 0.0), "sp_k_bb_ratio": (10, "my.pitching_strikeouts / nullif(my.pitching_walks, 0)", 0.0),
        "sp_era_plus": (10, "least(200, 450 / nullif(least(9 * my.earned_runs / nullif(my.innings_pitched, 0), 27), 0))", 100.0), "sp_whip": (10, "(my.hits_allowed + my.pitching_walks) / nullif(my.innings_pitched, 0)", 0.0),
        "sp_fip": (10, "greatest(0, least((13 * my.pitching_home_runs + 3 * my.pitching_walks - 2 * my.pitching_strikeouts) / nullif(my.innings_pitched, 0) + 3.2, 10))", 4.5), "sp_qs_rate": (10, "avg.good_start", 0.5), "sp_avg_ip": (10, "my.innings_pitched / n", 0.0),
        "sp_era_trend": (10, "least(9 * my3.earned_runs / nullif(my3.innings_pitched, 0), 27) - least(9 * my.earned_runs / nullif(my.innings_pitched, 0), 27)", 0.0), "sp_k_trend": (10, "my3.pitching_strikeouts / n3 - my.pitching_strikeouts / n", 0.0), "sp_batters_faced_pg": (10, "my.batters_faced / n", 0.0),
    }
    | _per_game(10, runs_pg="score", hits_pg="hits", hr_pg="home_runs", bb_pg="walks", k_pg="strikeouts"),
)

ESPORTS = Family(
    ("score", "kills", "deaths", "assists", "duration", "objectives", "first_objective", "towers", "dragons", "gold_per_min", "cs_per_min", "gold_diff_at_15", "wards_placed", "wards_destroyed", "vision_score"),
    _RESULT,
    _per_game(10, kills_pg="kills", deaths_pg="deaths", assists_pg="assists", objectives_pg="objectives", first_objective_rate="first_objective", towers_pg="towers", dragons_pg="dragons", wards_placed_pg="wards_placed", wards_destroyed_pg="wards_destroyed", vision_score_pg="vision_score")
    | _means(10, avg_duration_min="duration", gold_per_min="gold_per_min", cs_per_min="cs_per_min", gold_diff_at_15="gold_diff_at_15")
    | {"kda": (10, "(my.kills + my.assists) / nullif(my.deaths, 0)", 0.0), "duration_std": (10, "sd.duration", 0.0), "win_pct": (10, "my.won / n", 0.0), "kd_trend": (10, "my3.kills / nullif(my3.deaths, 0) - my.kills / nullif(my.deaths, 0)", 0.0)},
)

_SETS = range(1, 6)
TENNIS = Family(
    ("score", "first_serves_in", "first_serves", "first_serves_won", "second_serves", "second_serves_won", "aces", "double_faults", "service_games", "service_games_won", "break_points", "break_points_won", "break_points_faced", "break_points_saved", "return_points", "return_points_won", "winners", "unforced_errors", "net_points_won", "sets_won", "s1", "s2", "s3", "s4", "s5", "ranking"),
    _RESULT | {
        "breakers": " + ".join(f"CASE WHEN m_s{i} = 7 OR o_s{i} = 7 THEN 1.0 ELSE 0.0 END" for i in _SETS), "breakers_won": " + ".join(f"CASE WHEN m_s{i} = 7 THEN 1.0 ELSE 0.0 END" for i in _SETS),
        "played": "coalesce(m_sets_won, 0) + coalesce(o_sets_won, 0)",
        "quality": "(CASE WHEN m_score > o_score THEN 1.0 ELSE -1.0 END) * greatest(0.0, 1.0 - (coalesce(nullif(o_ranking, 0), 200.0) - 1.0) / 200.0)",
    },
    {
        "first_serve_pct": (10, "100 * my.first_serves_in / nullif(my.first_serves, 0)", 0.0), "first_serve_won_pct": (10, "100 * my.first_serves_won / nullif(my.first_serves_in, 0)", 0.0), "second_serve_won_pct": (10, "100 * my.second_serves_won / nullif(my.second_serves, 0)", 0.0),
        "aces_per_match": (10, "my.aces / n", 0.0), "double_faults_per_match": (10, "my.double_faults / n", 0.0), "ace_df_ratio": (10, "coalesce(my.aces / nullif(my.double_faults, 0), 2 * my.aces / n)", 0.0), "service_games_won_pct": (10, "100 * my.service_games_won / nullif(my.service_games, 0)", 0.0),
        "break_point_conversion": (10, "100 * my.break_points_won / nullif(my.break_points, 0)", 0.0), "break_points_saved_pct": (10, "100 * my.break_points_saved / nullif(my.break_points_faced, 0)", 0.0), "return_points_won_pct": (10, "100 * my.return_points_won / nullif(my.return_points, 0)", 0.0),
        "winners_per_match": (10, "my.winners / n", 0.0), "unforced_errors_per_match": (10, "my.unforced_errors / n", 0.0), "winner_ue_ratio": (10, "coalesce(my.winners / nullif(my.unforced_errors, 0), 0.1 * my.winners / n)", 0.0), "net_points_won_pm": (10, "my.net_points_won / n", 0.0),
        "set_win_rate": (10, "my.sets_won / nullif(my.sets_won + op.sets_won, 0)", 0.0), "avg_sets_recent": (5, "my.played / n", 0.0), "tiebreak_win_pct": (20, "my.breakers_won / nullif(my.breakers, 0)", 0.0), "tiebreaks_won_pm": (10, "my.breakers_won / n", 0.0),
        "avg_opponent_ranking": (10, "posop.ranking", 200.0), "ranking_quality_form": (15, "my.quality / n", 0.0),
    },
)
PRESTIGE = Family(("score", "prestige"), _RESULT | {"level": "coalesce(m_prestige, 0)"}, {"prestige_win_pct": (20, "my.won / n", 0.0), "prestige_matches": (20, "n", 0.0)}, ("level",))
COMBAT = Family(
    ("score", "sig_strikes_landed", "sig_strikes_attempted", "total_strikes_landed", "takedown_pct", "submission_attempts", "knockdowns", "control_time_seconds"),
    {
        "sig_pct": "CASE WHEN m_sig_strikes_attempted > 0 THEN 100 * coalesce(m_sig_strikes_landed, 0) / m_sig_strikes_attempted ELSE 0.0 END",
        "per_minute": "CASE WHEN m_control_time_seconds > 0 THEN 60 * coalesce(m_total_strikes_landed, 0) / m_control_time_seconds ELSE 0.0 END",
    },
    _per_game(10, sig_strikes_per_fight="sig_strikes_landed", total_strikes_per_fight="total_strikes_landed", takedown_pct="takedown_pct", submission_attempts="submission_attempts", knockdowns_per_fight="knockdowns", control_time_avg="control_time_seconds")
    | {
        "sig_strike_pct": (10, "my.sig_pct / n", 0.0), "strike_differential": (10, "(my.sig_strikes_landed - op.sig_strikes_landed) / n", 0.0), "sig_strikes_absorbed": (10, "op.sig_strikes_landed / n", 0.0), "total_strikes_per_min": (10, "my.per_minute / n", 0.0),
        "sig_strike_defense": (10, "1 - op.sig_strikes_landed / nullif(op.sig_strikes_attempted, 0)", 0.5), "volume_vs_accuracy": (10, "my.total_strikes_landed / n * my.sig_pct / n / 100", 0.0),
    },
)


def period_family(names: tuple[str, ...], half: int, n: int = 10) -> Family:
    """Scoring by period: the first one, the first ``half`` of them and the rest, comebacks (behind then, won in the end), overtime.

    A game whose first periods are all missing counts for nothing; single missing ones are 0. ``half`` 0: the scheme has no halves.
    """
    add = lambda side, part: " + ".join(f"coalesce({side}_{x}, 0)" for x in part)
    there = lambda side: f"coalesce({', '.join(f'{side}_{x}' for x in names[:half])}) IS NOT NULL" if half > 1 else f"{side}_{names[0]} IS NOT NULL"
    first = names[0]
    derived = {"first": f"CASE WHEN o_{first} IS NOT NULL THEN m_{first} END", "first_opp": f"CASE WHEN m_{first} IS NOT NULL THEN o_{first} END", "first_won": f"CASE WHEN m_{first} IS NOT NULL AND o_{first} IS NOT NULL THEN CASE WHEN m_{first} > o_{first} THEN 1.0 ELSE 0.0 END END", "extra": "CASE WHEN coalesce(m_ot, 0) > 0 OR coalesce(o_ot, 0) > 0 THEN 1.0 ELSE 0.0 END"}
    means = {"period_first_ppg": "first", "period_first_opp_ppg": "first_opp", "period_first_win_pct": "first_won", "period_ot_rate": "extra"}
    if half:
        mine, theirs, know = add("m", names[:half]), add("o", names[:half]), there("m")
        derived |= {
            "half": f"CASE WHEN {know} THEN {mine} END", "half_opp": f"CASE WHEN {know} THEN {theirs} END", "half_won": f"CASE WHEN {know} THEN CASE WHEN {mine} > {theirs} THEN 1.0 ELSE 0.0 END END",
            "late": f"CASE WHEN {know} THEN {add('m', names[half:])} END", "back": f"CASE WHEN {know} THEN CASE WHEN {mine} < {theirs} AND m_score > o_score THEN 1.0 ELSE 0.0 END END",
        }
        means |= {"period_first_half_ppg": "half", "period_first_half_opp_ppg": "half_opp", "period_first_half_win_pct": "half_won", "period_second_half_ppg": "late", "period_comeback_rate": "back"}
    return Family(("score", *names, "ot"), derived, {k: (n, f"avg.{x}", 0.0) for k, x in means.items()})


#: fixed values: periods of a game and how many of them are its first half
SCHEMES = {"quarters": period_family(("q1", "q2", "q3", "q4"), 2), "thirds": period_family(("p1", "p2", "p3"), 1), "halves": period_family(("h1", "h2"), 1), "innings": period_family(tuple(f"i{i}" for i in range(1, 10)), 0)}
#: scoring of the last five games
LAST_FIVE = Family(("score",), {}, {"last5_ppg": (5, "my.score / n", 0.0), "last5_opp_ppg": (5, "op.score / n", 0.0), "last5_margin": (5, "(my.score - op.score) / n", 0.0), "last5_games": (5, "n", 0.0), "last5_spread": (5, "sd.score", 0.0)})

FAMILIES = {"basketball": BASKETBALL, "hockey": HOCKEY, "football": FOOTBALL, "soccer": SOCCER, "baseball": BASEBALL, "esports": ESPORTS, "tennis": TENNIS, "tennis_prestige": PRESTIGE, "combat": COMBAT}

_TOKEN = re.compile(r"\b(my|op|avg|avgop|pos|posop|sd)(\d*)\.(\w+)")
_GAMES = re.compile(r"\bn(\d*)\b")


def compiled(window: int, formula: str) -> tuple[str, set[tuple[str, int, str]]]:
    """The formula over columns ``<kind><n>_<x>`` and ``games<n>``, and the (kind, n, x) that it needs."""
    need: set[tuple[str, int, str]] = set()

    def one(m: re.Match) -> str:
        n = int(m[2] or window)
        need.add((m[1], n, m[3]))
        return f"{m[1]}{n}_{m[3]}"

    def games(m: re.Match) -> str:
        need.add(("games", int(m[1] or window), ""))
        return f"games{m[1] or window}_"

    return _GAMES.sub(games, _TOKEN.sub(one, formula)), need


def needs(family: Family) -> list[tuple[str, int, str]]:
    return sorted(set().union(*(compiled(w, f)[1] for w, f, _ in family.features.values())))


def team_rows(games: DataFrame, family: Family) -> DataFrame:
    """Two rows a game with ``m_<x>`` and ``o_<x>``; games without both scores are not completed."""
    def side(me: str, they: str) -> Column:
        own = [F.col(f"{me}_{x}").cast("double").alias(f"m_{x}") for x in family.stats]
        other = [F.col(f"{they}_{x}").cast("double").alias(f"o_{x}") for x in family.stats]
        return F.struct(F.col(f"{me}_team_id").alias("team_id"), F.lit(me == "home").alias("is_home"), *own, *other)

    d = games.select("game_id", "date", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("x")).select("game_id", "date", "x.*")
    d = d.withColumns({f"m_{k}": F.expr(e).cast("double") for k, e in family.derived.items()})
    return d.withColumn("completed", F.col("m_score").isNotNull() & F.col("o_score").isNotNull())


def _state(kind: str, x: str):
    c = F.col(f"{'o' if kind in ('op', 'avgop', 'posop') else 'm'}_{x}") if x else None
    if kind == "games":
        return asof.count()
    if kind in ("my", "op"):
        return asof.total(F.coalesce(c, F.lit(0.0)))
    if kind == "sd":
        return lambda w: F.stddev_pop(c).over(w)
    return asof.mean(F.when(c > 0, c) if kind.startswith("pos") else c)


def box_features(games: DataFrame, family: Family) -> DataFrame:
    """All features of a family for both teams of every game (game_id, team_id, is_home, ...)."""
    states = {f"{kind}{n}_{x}": (n, _state(kind, x)) for kind, n, x in needs(family)}
    d = asof.as_of(team_rows(games, family), states, ("team_id", *(f"m_{x}" for x in family.within)))
    return d.select("game_id", "team_id", "is_home", *(F.coalesce(F.expr(compiled(w, f)[0]).cast("double"), F.lit(default)).alias(name) for name, (w, f, default) in family.features.items()))
