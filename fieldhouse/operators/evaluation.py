"""Prediction evaluation: accuracy, calibration, trends, drift, backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import brier, confidence_band, log_loss


def scored(predictions: DataFrame) -> DataFrame:
    """Evaluable rows (both scores, a sound probability, no draw) with confidence, outcome and correctness."""
    p = F.col("home_win_prob")
    ok = F.col("home_score").isNotNull() & F.col("away_score").isNotNull() & (F.col("home_score") != F.col("away_score")) & ~F.isnan(p) & p.between(0, 1)
    d = predictions.where(F.coalesce(ok, F.lit(False)))
    y = (F.col("home_score") > F.col("away_score")).cast("int")
    return d.withColumn("outcome", y).withColumn("confidence", F.greatest(p, 1 - p)).withColumn("correct", ((p >= 0.5).cast("int") == y).cast("int"))


def accuracy_leaderboard(predictions: DataFrame, least: int = 20) -> DataFrame:
    """Accuracy, Brier score and log loss per sport, ranked."""
    d = scored(predictions).groupBy("sport").agg(F.count("*").alias("evaluated"), F.avg("correct").alias("accuracy"), F.avg(brier("home_win_prob", "outcome")).alias("brier"), F.avg(log_loss("home_win_prob", "outcome")).alias("log_loss"))
    return d.where(F.col("evaluated") >= least).withColumn("rank", F.row_number().over(W.orderBy(F.desc("accuracy"), "sport")))


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Reliability bins of the home probability; empty bins stay, the last is closed."""
    d = scored(predictions)
    b = F.least(F.floor(F.col("home_win_prob") * bins), F.lit(bins - 1)).cast("long")
    g = d.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("home_win_prob").alias("mean_prob"), F.avg("outcome").alias("share"))
    return d.sparkSession.range(bins).select(F.col("id").alias("bin")).join(g, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_summary(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score, log loss and expected calibration error."""
    g = calibration(predictions, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("share"))) / F.sum("n")).alias("ece"))
    m = scored(predictions).agg(F.count("*").alias("n"), F.avg(brier("home_win_prob", "outcome")).alias("brier"), F.avg(log_loss("home_win_prob", "outcome")).alias("log_loss"))
    return m.join(F.broadcast(g))  # one row each


def calibration_trend(predictions: DataFrame, as_of: str, window_days: int, bucket_days: int) -> DataFrame:
    """Accuracy and Brier score in buckets of days backward from a date; empty buckets stay."""
    age = F.datediff(F.lit(as_of).cast("date"), "date")
    d = scored(predictions).where((age > 0) & (age <= window_days)).groupBy(F.floor((age - 1) / bucket_days).cast("long").alias("bucket"))
    g = d.agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg(brier("home_win_prob", "outcome")).alias("brier"))
    n = -(-window_days // bucket_days)
    return predictions.sparkSession.range(n).select(F.col("id").alias("bucket")).join(g, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def tier_table(predictions: DataFrame, stake: float = 100.0) -> DataFrame:
    """Win rate and return of flat even-money stakes by confidence band."""
    d = scored(predictions).withColumn("band", confidence_band("confidence"))
    pnl = F.when(F.col("correct") == 1, stake * (1 / F.col("confidence") - 1)).otherwise(-stake)
    return d.groupBy("band").agg(F.count("*").alias("n"), F.avg("correct").alias("win_rate"), F.sum(pnl).alias("pnl"), (F.sum(pnl) / (F.count("*") * stake)).alias("roi"))


def daily(predictions: DataFrame) -> DataFrame:
    return scored(predictions).groupBy("date").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg(brier("home_win_prob", "outcome")).alias("brier"))


def market_outcomes(games: DataFrame, total: float = 180.0) -> list[tuple[str, Column]]:
    """(bet type, what happened) of a final game."""
    h, a = F.col("home_score"), F.col("away_score")
    return [("home_win", h > a), ("over", h + a > total), ("margin_3", F.abs(h - a) <= 3), ("margin_10", F.abs(h - a) <= 10), ("both_80", (h >= 80) & (a >= 80)), ("even_total", (h + a) % 2 == 0), ("home_100", h >= 100), ("away_100", a >= 100)]


def backtest(predictions: DataFrame, total: float = 180.0) -> DataFrame:
    """Hit rate of every bet type, called by the home probability, as one unpivot and one aggregation."""
    d = scored(predictions)
    call = F.col("home_win_prob") >= 0.5
    rows = F.array(*(F.struct(F.lit(n).alias("bet_type"), (c == call).cast("int").alias("hit"), c.cast("int").alias("happened")) for n, c in market_outcomes(d, total)))
    return d.select("sport", F.explode(rows).alias("x")).groupBy("x.bet_type").agg(F.count("*").alias("n"), F.avg("x.hit").alias("hit_rate"), F.avg("x.happened").alias("base_rate"))


def backtest_summary(predictions: DataFrame) -> DataFrame:
    """Accuracy by sport, by band and in all."""
    d = scored(predictions).withColumn("band", confidence_band("confidence"))
    return d.groupingSets([["sport"], ["band"], []], "sport", "band").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg(brier("home_win_prob", "outcome")).alias("brier"))


def completed_games(games: DataFrame) -> DataFrame:
    """Final games once each, without 0-0 placeholders."""
    d = games.where("home_score IS NOT NULL AND away_score IS NOT NULL AND NOT (home_score = 0 AND away_score = 0)")
    w = W.partitionBy("game_id").orderBy(F.desc("date"))
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def drift(predictions: DataFrame, as_of: str, recent: int = 30, baseline: int = 90, least: int = 20, threshold: float = 0.02) -> DataFrame:
    """Accuracy of the recent days against the days before them, per sport, in one pass."""
    age = F.datediff(F.lit(as_of).cast("date"), "date")
    new, old = (age > 0) & (age <= recent), (age > recent) & (age <= recent + baseline)
    d = scored(predictions).groupBy("sport").agg(F.count_if(new).alias("n_recent"), F.count_if(old).alias("n_base"), F.avg(F.when(new, F.col("correct"))).alias("recent"), F.avg(F.when(old, F.col("correct"))).alias("base"))
    gap = F.col("recent") - F.col("base")
    state = F.when((F.col("n_recent") < least) | (F.col("n_base") < least), "too_few").when(gap < -threshold, "worse").when(gap > threshold, "better").otherwise("stable")
    return d.select("*", gap.alias("gap"), state.alias("state"))


def health(predictions: DataFrame, as_of: str, stale_hours: int = 48, least: float = 0.52) -> DataFrame:
    """State of each sport's model at a date: stale, poor, idle or healthy."""
    d = predictions.groupBy("sport").agg(F.max("date").alias("last"), F.count_if(F.col("date") == F.lit(as_of).cast("date")).alias("today"))
    a = scored(predictions).groupBy("sport").agg(F.avg("correct").alias("accuracy"))
    old = F.datediff(F.lit(as_of).cast("date"), "last") * 24 > stale_hours
    return d.join(a, "sport", "left").withColumn("state", F.when(old, "stale").when(F.col("accuracy") < least, "poor").when(F.col("today") == 0, "idle").otherwise("healthy"))


def live_gap(backtested: DataFrame, live: DataFrame) -> DataFrame:
    """Accuracy lost between backtest and live rows per sport, with a priority of gap times the root of the rows."""
    b = scored(backtested).groupBy("sport").agg(F.avg("correct").alias("backtest"))
    v = scored(live).groupBy("sport").agg(F.avg("correct").alias("live"), F.count("*").alias("n"))
    gap = F.col("backtest") - F.col("live")
    return b.join(v, "sport").select("sport", "backtest", "live", "n", gap.alias("gap"), (F.greatest(gap, F.lit(0.0)) * F.sqrt("n")).alias("priority"))
