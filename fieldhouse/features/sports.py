"""Features of single sports, from columns of their own, on the as-of primitive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.games import team_games
from .asof import as_of, count, deviation, mean, total


def _or(name: str, default: float) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def fighter_record(bouts: DataFrame, n: int = 10, most_days: int = 730) -> DataFrame:
    """Record of a fighter's last n bouts of earlier dates: wins, streaks, how the wins came, days off.

    A win without a method counts as a finish up to round 2 and as a decision after it. Without bouts: rates 0, round 3,
    365 days off; days off are at most ``most_days``.
    """
    tg = team_games(bouts, ("method", "finish_round"))
    w = W.partitionBy("team_id", "completed").orderBy("date", "game_id")
    tg = tg.withColumn("_c", F.when(F.lag("win").over(w) == F.col("win"), 0).otherwise(1)).withColumn("_g", F.sum("_c").over(w))
    tg = tg.withColumn("_run", F.row_number().over(W.partitionBy("team_id", "completed", "_g").orderBy("date", "game_id")))
    won, method, round_ = F.col("win") == 1, F.lower(F.coalesce("method", F.lit(""))), F.col("finish_round")
    kinds = {
        "finish": method.rlike("ko|sub") | ((method == "") & (round_ <= 2)),
        "decision": method.contains("dec") | ((method == "") & (round_ > 2)),
        "knockout": method.contains("ko"), "submission": method.contains("sub"), "early": round_ <= 2,
    }
    states = {"_p": (n, mean("win")), "_wins": (n, total("win")), "_n": (n, count()), "_round": (n, mean(F.when(won, round_))), "_day": (1, lambda w: F.max("date").over(w)), "_streak": (1, lambda w: F.max(F.when(won, F.col("_run")).otherwise(-F.col("_run"))).over(w))}
    f = as_of(tg, {**states, **{f"_{k}": (n, count(won & c)) for k, c in kinds.items()}})
    streak = _or("_streak", 0)
    return f.select(
        "game_id", "team_id", "is_home", _or("_p", 0.0).alias("win_pct"), F.greatest(F.least(streak, F.lit(n)), F.lit(0)).alias("win_streak"), F.greatest(F.least(-streak, F.lit(n)), F.lit(0)).alias("loss_streak"),
        *(_ratio(f"_{k}", "_wins").alias(f"{k}_rate") for k in kinds), _or("_round", 3.0).alias("avg_finish_round"), _or("_n", 0).alias("fights"),
        F.coalesce(F.least(F.datediff("date", "_day"), F.lit(most_days)), F.lit(365)).alias("days_off"),
    )


def surface_form(matches: DataFrame, n: int = 20, n_head: int = 15) -> DataFrame:
    """Share of wins on the match's surface, in all (0 without any) and against this opponent (0.5 without any)."""
    tg = team_games(matches, ("surface",)).withColumn("surface", F.lower("surface"))
    tg = tg.withColumn("completed", F.col("completed") & F.col("surface").isNotNull())
    f = as_of(tg, {"_p": (n, mean("win")), "_n": (n, count())}, ("team_id", "surface"))
    f = as_of(f, {"_h": (n_head, mean("win"))}, ("team_id", "opp_id", "surface"))
    return f.select("game_id", "team_id", "is_home", "surface", _or("_p", 0.0).alias("surface_win_pct"), _or("_n", 0).alias("surface_matches"), _or("_h", 0.5).alias("h2h_surface_win_pct"))


def track_history(finishes: DataFrame, n: int = 5) -> DataFrame:
    """Mean finish (retirements have none) and races of the last n at this circuit."""
    d = finishes.withColumn("completed", F.col("circuit_id").isNotNull())
    f = as_of(d, {"_a": (n, mean(F.when(F.col("position") > 0, F.col("position")))), "_n": (n, count())}, ("player_id", "circuit_id"))
    return f.select("game_id", "player_id", "circuit_id", _or("_a", 0.0).alias("track_avg_finish"), _or("_n", 0).alias("track_races"))


def tournament_form(finishes: DataFrame, n: int = 10, long_: int = 20, short: int = 5) -> DataFrame:
    """Golf form before a tournament: finishes, scores to par, rest, trends, cuts made in a row, strength of the field.

    A row without a position is a missed cut. Trends need two positions among the last ``short`` rows, else they are 0;
    a falling position or score is a positive trend. The field's strength is the mean form of its players with a history.
    """
    by = W.partitionBy("player_id").orderBy("date", "game_id")
    pos, par = F.col("position"), F.col("score_to_par")
    d = finishes.withColumn("completed", F.lit(True)).withColumn("_i", F.count("position").over(by).cast("double")).withColumn("_j", F.count("score_to_par").over(by).cast("double"))
    d = d.withColumn("_g", F.count_if(pos.isNull()).over(by)).withColumn("_run", F.count("position").over(W.partitionBy("player_id", "_g").orderBy("date", "game_id")))
    f = as_of(
        d,
        {
            "_n": (n, count()), "avg_finish": (n, mean("position")), "finish_std": (n, deviation("position")), "_t10": (n, count(pos <= 10)), "_t25": (n, count(pos <= 25)), "_t1": (n, count(pos == 1)), "_cut": (n, count(pos > 0)),
            "avg_to_par": (n, mean("score_to_par")), "avg_rounds": (n, mean("rounds")), "to_par_std": (n, deviation("score_to_par")), "best_to_par": (n, lambda w: F.min("score_to_par").over(w)), "worst_to_par": (n, lambda w: F.max("score_to_par").over(w)),
            "_ln": (long_, count()), "long_avg_finish": (long_, mean("position")), "_l10": (long_, count(pos <= 10)), "long_to_par": (long_, mean("score_to_par")),
            "_two": (short, count(pos.isNotNull())), "_slope": (short, lambda w: F.regr_slope(pos, F.col("_i")).over(w)), "_par": (short, lambda w: F.regr_slope(par, F.col("_j")).over(w)),
            "_made": (1, lambda w: F.max("_run").over(w)), "_top5": (3, count(pos <= 5)), "_last": (1, lambda w: F.max("date").over(w)),
        },
        ("player_id",),
    )
    f = f.withColumn("_day", F.unix_date("date"))
    month = F.count("*").over(W.partitionBy("player_id").orderBy("_day").rangeBetween(-30, -1))
    trend = lambda c: F.coalesce(F.when(F.col("_two") >= 2, c), F.lit(0.0))
    plain = ("avg_finish", "finish_std", "avg_to_par", "avg_rounds", "to_par_std", "best_to_par", "worst_to_par", "long_avg_finish", "long_to_par")
    f = f.select(
        "game_id", "player_id", *(_or(c, 0.0).alias(c) for c in plain), *(_ratio(c, "_n").alias(name) for c, name in (("_t10", "top_10_rate"), ("_t25", "top_25_rate"), ("_t1", "win_rate"), ("_cut", "cut_rate"))),
        _ratio("_l10", "_ln").alias("long_top_10_rate"), _or("_n", 0).alias("played"), F.coalesce(F.datediff("date", "_last"), F.lit(14)).alias("rest_days"), month.alias("last_30d"),
        trend(-F.col("_slope")).alias("finish_trend"), trend(-F.col("_par")).alias("to_par_trend"), trend(F.col("_made").cast("double")).alias("cuts_in_a_row"), trend(F.col("_top5").cast("double")).alias("top_5_last_3"),
    )
    field = F.avg(F.when(F.col("played") > 0, F.col("avg_finish"))).over(W.partitionBy("game_id"))
    return f.withColumn("field_strength", F.coalesce(field, F.lit(0.0)))


def standings_features(games: DataFrame, teams: DataFrame, n: int = 10) -> DataFrame:
    """A season's table (of the whole season, for use in later ones): records by venue, last n, games behind the
    conference's best, rank in it, streak, points difference, and the share of points against as schedule strength."""
    newest = W.partitionBy("season", "team_id").orderBy(F.desc("date"), F.desc("game_id"))
    d = team_games(games).where("completed").withColumn("_k", F.row_number().over(newest))
    win, k = F.col("win"), F.col("_k")
    t = d.groupBy("season", "team_id").agg(
        F.count("*").alias("games"), F.avg("win").alias("win_pct"), F.avg(F.when(F.col("is_home"), win)).alias("home_win_pct"), F.avg(F.when(~F.col("is_home"), win)).alias("away_win_pct"),
        F.avg(F.when(k <= n, win)).alias("last_ten_win_pct"), F.sum("pf").alias("_f"), F.sum("pa").alias("_a"), F.min(F.when(win == 1, k)).alias("_w"), F.min(F.when(win == 0, k)).alias("_l"),
    )
    t = t.join(teams.select("team_id", "conference"), "team_id", "left")
    conf = W.partitionBy("season", "conference")
    behind = F.when(F.col("conference").isNotNull(), (F.max("win_pct").over(conf) - F.col("win_pct")) * F.col("games") / 2).otherwise(0.0)
    rank = F.when(F.col("conference").isNotNull(), F.row_number().over(conf.orderBy(F.desc("win_pct"), "team_id"))).otherwise(0)
    streak = F.when(F.col("_w") == 1, F.coalesce(F.col("_l") - 1, F.col("games"))).otherwise(-F.coalesce(F.col("_w") - 1, F.col("games")))
    return t.select(
        "season", "team_id", "games", "win_pct", _or("home_win_pct", 0.0).alias("home_win_pct"), _or("away_win_pct", 0.0).alias("away_win_pct"), "last_ten_win_pct", behind.alias("games_behind"), rank.alias("conference_rank"),
        streak.alias("streak"), (F.col("_f") - F.col("_a")).alias("points_difference"), F.coalesce(F.col("_a") / F.nullif(F.col("_f") + F.col("_a"), F.lit(0.0)), F.lit(0.0)).alias("schedule_strength"),
    )
