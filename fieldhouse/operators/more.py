"""Smaller joins and counts: officials, lineups, signals, market catalogs, drives, nested filters, ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import ratio
from .games import keep_first
from .market import contenders, parlays


def game_people(games: DataFrame, people: DataFrame, role: str) -> DataFrame:
    """Games with their officials or coaches, one row per person, games without any kept."""
    p = people.where(F.col("role") == role).select("game_id", F.col("person").alias(role))
    return games.join(p, "game_id", "left")


def lineups(players: DataFrame, games: DataFrame) -> DataFrame:
    """Player rows with their game's date and sport, from the game where it is known, else from the row."""
    g = keep_first(games, [F.col("game_id")], [F.col("date")]).select("game_id", F.col("date").alias("_d"), "sport", "home_team_id")
    d = players.join(g, "game_id", "left").withColumn("date", F.coalesce("_d", "date"))
    return d.withColumn("side", F.when(F.col("team_id") == F.col("home_team_id"), "home").otherwise("away")).drop("_d", "home_team_id")


def guarded_rates(rollup: DataFrame, stats: list[str], games: str = "games") -> DataFrame:
    """Totals per game, 0 without games."""
    return rollup.select("*", *(ratio(s, games).alias(f"{s}_per_game") for s in stats))


def sharp_signals(trends: DataFrame, signals: DataFrame) -> DataFrame:
    """Trends with the first signal of their game; signals of other games follow alone."""
    s = keep_first(signals, [F.col("game_id")], [F.col("bookmaker")]).select("game_id", "move", "regime")
    rest = s.join(trends.select("game_id"), "game_id", "left_anti")
    return trends.join(s, "game_id", "left").unionByName(rest, allowMissingColumns=True)


def market_catalog(props: DataFrame) -> DataFrame:
    """Entries of an array of markets by type and tier."""
    d = props.select("sport", F.explode("markets").alias("m")).select("sport", "m.*")
    return d.groupBy("sport", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("tier") == "high").alias("high"), F.count_if(F.col("tier") == "medium").alias("medium"), F.count_if(F.col("tier") == "low").alias("low"))


def drives(plays: DataFrame, team: int, scoring_only: bool) -> DataFrame:
    """Plays with a team on either side, scoring ones only if asked."""
    d = plays.where((F.col("offence") == team) | (F.col("defence") == team))
    return d.where("scoring") if scoring_only else d


def severity_counts(reports: DataFrame, field: str, value: str) -> DataFrame:
    """Counts by severity of reports whose nested field has a value."""
    return reports.where(F.col(field) == value).groupBy("detail.severity").agg(F.count("*").alias("n"))


def ladder(cands: DataFrame, steps: list[tuple[str, int, float, float]]) -> DataFrame:
    """The day's best parlay for several sizes and cuts: (name, legs, least probability of a leg, least price)."""
    out = None
    for name, legs, least_prob, least in steps:
        p = parlays(contenders(cands, legs, 1, least_prob, least_price=least), legs, least_prob).where(F.col("price") >= least).withColumn("step", F.lit(name))
        p = p.withColumn("ev", F.round("ev", 9)).groupBy("step", "date").agg(F.min_by(F.struct("games", "price", "ev"), F.struct(-F.col("ev"), "key")).alias("b")).select("step", "date", "b.*")
        out = p if out is None else out.unionByName(p)
    return out


def opportunities_joined(predictions: DataFrame, games: DataFrame, latest: DataFrame) -> DataFrame:
    """Predictions with their game's state and its live score, where there is one."""
    g = games.select("game_id", F.col("status").alias("game_status"))
    v = latest.select("game_id", F.col("home_score").alias("live_home"), F.col("away_score").alias("live_away"))
    return predictions.select("game_id", "home_win_prob").join(g, "game_id", "left").join(v, "game_id", "left")


def cross_sport(tables: dict[str, DataFrame], columns: list[str], per_sport: int) -> DataFrame:
    """Rows of several sports by name, each with its sport, at most so many of each, newest first."""
    from .filters import capped
    from .games import union_kinds

    d = union_kinds(tables, "sport").select("sport", *columns)
    return capped(d, ["sport"], [F.desc("date"), F.col("game_id")], per_sport)
