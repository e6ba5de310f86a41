"""Odds, candidates, parlays, grading and settlement."""

from __future__ import annotations

from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import american_to_decimal, decimal_to_implied, expected_value, grade, kelly, moneyline_probability, profit, tier
from .games import latest_odds


def consensus(odds: DataFrame, warn: float = 0.03) -> DataFrame:
    """Agreement of bookmakers per game: 100 less 1000 times the deviation of implied probabilities, in [0, 100]."""
    p = moneyline_probability("h2h_home")
    w = W.partitionBy("game_id")
    d = odds.withColumn("_p", p)
    n, dev = F.count("*").over(w), F.stddev_pop("_p").over(w)
    score = F.when(n >= 2, F.greatest(F.least(100 - 1000 * dev, F.lit(100.0)), F.lit(0.0)))
    return d.select(*odds.columns, F.when(n >= 2, dev).alias("deviation"), score.alias("consensus"), F.when(n >= 2, dev > warn).alias("warning"))


def consensus_features(odds: DataFrame) -> DataFrame:
    """Mean lines over the books' latest quotes (zeros are none), implied probability, books, agreement on the favourite."""
    o = latest_odds(odds)
    nz = lambda c: F.when(F.col(c) != 0, F.col(c))
    home = F.avg(F.when(F.col("h2h_home") < F.col("h2h_away"), 1.0).otherwise(0.0))
    return o.groupBy("game_id").agg(
        F.avg(nz("h2h_home")).alias("home_ml"), F.avg(nz("h2h_away")).alias("away_ml"), F.avg(nz("spread_home")).alias("spread"), F.avg(nz("total_line")).alias("total"),
        F.avg(moneyline_probability("h2h_home")).alias("home_implied"), F.count("*").alias("books"), F.greatest(home, 1 - home).alias("agreement"),
    )


def best_price(odds: DataFrame, exclude: tuple[int, ...] = ()) -> DataFrame:
    """Highest decimal price and its book per game and selection."""
    o = latest_odds(odds)
    if exclude:
        o = o.where(~F.col("bookmaker").isin(*exclude))
    both = F.array(*(F.struct(F.lit(s).alias("selection"), american_to_decimal(c).alias("price")) for s, c in (("home", "h2h_home"), ("away", "h2h_away"))))
    long_ = o.select("game_id", "bookmaker", F.explode(both).alias("x")).select("game_id", "bookmaker", "x.*").where("price > 1")
    best = F.max_by(F.struct("bookmaker", "price"), F.struct("price", -F.col("bookmaker")))
    return long_.groupBy("game_id", "selection").agg(best.alias("b")).select("game_id", "selection", "b.bookmaker", "b.price")


def candidates(predictions: DataFrame, odds: DataFrame, least_edge: float = 0.02, bank: float = 1000.0) -> DataFrame:
    """Every (game, selection) with a price: edge, value, grade, tier and stake, as one expression over unpivoted markets."""
    sides = F.array(*(F.struct(F.lit(s).alias("selection"), F.col(c).alias("prob")) for s, c in (("home", "home_win_prob"), ("away", "away_win_prob"))))
    p = predictions.select("game_id", "sport", "date", F.explode(sides).alias("x")).select("game_id", "sport", "date", "x.*")
    d = p.join(best_price(odds), ["game_id", "selection"])
    d = d.withColumn("edge", F.col("prob") - decimal_to_implied("price")).where(F.col("edge") >= least_edge)
    return d.select("*", expected_value("prob", "price").alias("ev"), grade("prob").alias("grade"), tier("prob").alias("tier"), (bank * kelly("prob", "price")).alias("stake"))


def dynamic_thresholds(bets: DataFrame, base: float = 0.55, target: float = 0.55, dead: float = 0.02, most: float = 0.05, least: int = 10) -> DataFrame:
    """Threshold per sport, moved against the weighted win rate outside a dead band, at most ``most``."""
    from .windows import ema_rate

    v = F.when(F.col("result") == "won", 1.0).when(F.col("result") == "push", 0.5).otherwise(0.0)
    e = ema_rate(bets.withColumn("_v", v), ["sport"], "date", [F.desc("game_id")], "_v")
    gap = F.lit(target) - F.col("ema")
    move = F.when((F.col("n") >= least) & (F.abs(gap) > dead), F.greatest(F.least(gap, F.lit(most)), F.lit(-most))).otherwise(0.0)
    return e.select("sport", "n", "ema", (base + move).alias("threshold"))


def unmerged(spark: SparkSession) -> int:
    """Partitions for rows that become many or wide in their tasks, and so must not be merged by their few bytes."""
    sizes = (spark.conf.get(k, None) or 0 for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
    return max(4 * spark.sparkContext.defaultParallelism, *map(int, sizes))


def parlays(cands: DataFrame, legs: int = 2, least_prob: float = 0.55, penalty: float = 0.97) -> DataFrame:
    """All combinations of a day's candidates of different games, with their product price and value, that are worth their stake.

    Thresholds on each leg and on the value of the whole thin the combinations out; none is dropped by rank. Legs are plain columns
    until a combination is kept: the join's condition has its value, and arrays that are not asked for are not made.
    """
    c = cands.where(F.col("prob") >= least_prob).select("date", "game_id", "selection", "prob", "price").repartition(unmerged(cands.sparkSession), "date")
    nth = lambda i: c.select("date", *(F.col(x).alias(f"{x}{i}") for x in ("game_id", "selection", "prob", "price")))
    d = nth(0)
    for i in range(1, legs):
        d = d.join(nth(i), "date").where(F.col(f"game_id{i}") > F.col(f"game_id{i - 1}"))
    times = lambda f: reduce(mul, (F.col(f"{f}{i}") for i in range(legs)))
    key = F.array(*(F.struct(F.col(f"game_id{i}").alias("game_id"), F.col(f"selection{i}").alias("selection")) for i in range(legs)))
    d = d.select("date", key.alias("key"), F.array(*(F.col(f"game_id{i}") for i in range(legs))).alias("games"), times("price").alias("price"), (times("prob") * penalty ** (legs - 1)).alias("prob"))
    return d.withColumn("ev", expected_value("prob", "price")).where("ev >= 0")


def contenders(cands: DataFrame, legs: int = 2, most: int = 1, least_prob: float = 0.55, penalty: float = 0.97, least_price: float = 0.0) -> DataFrame:
    """The candidates that can be in one of the day's ``most`` best ``parlays`` that share no game, before any leg meets another.

    A parlay's value is the product of its legs' (chance times price) and of the penalties, less 1. Parlays chosen earlier take at most
    ``legs`` games each, so of ``legs * (most - 1) + 1`` parlays without a common game one is left: the day's best games, at prices whose
    product is enough, give that many, and the value of the last is a floor. A leg that with the day's best ones cannot reach it goes;
    of two-leg parlays' legs with equal chance and price those with the smallest ids stay, as ties go by key. Exact for chances and
    prices of at least 0.
    """
    games = legs * (legs * (most - 1) + 1)
    day, game = W.partitionBy("date"), W.partitionBy("date", "game_id")
    c = cands.where((F.col("prob") >= least_prob) & F.col("date").isNotNull()).withColumn("_v", F.col("prob") * F.col("price"))
    sure = F.when(F.col("price") >= least_price ** (1 / legs) * (1 + 1e-9), F.col("_v"))
    c = c.withColumn("_sure", sure).withColumn("_k", F.row_number().over(game.orderBy(F.desc_nulls_last("_sure"), "selection")))
    c = c.withColumn("_sure", F.when(F.col("_k") == 1, F.col("_sure"))).withColumn("_n", F.row_number().over(day.orderBy(F.desc_nulls_last("_sure"), "game_id", "selection")))
    c = c.withColumns({"_top": F.max("_v").over(day), "_floor": F.max(F.when(F.col("_n") == games, F.col("_sure"))).over(day)})
    thin = penalty ** (legs - 1)
    floor = F.greatest(F.coalesce(thin * F.pow("_floor", F.lit(legs)) - 1, F.lit(0.0)), F.lit(0.0))
    c = c.where(thin * F.col("_v") * F.pow("_top", F.lit(legs - 1)) - 1 >= floor - 1e-8)
    if legs == 2:
        same = W.partitionBy("date", "prob", "price").orderBy("game_id")
        c = c.withColumn("_n", F.dense_rank().over(same)).where(F.col("_n") <= legs * most)
    return c.select(*cands.columns)


def disjoint(parlay: DataFrame, most: int = 3) -> DataFrame:
    """Greedy choice per day of at most ``most`` parlays that share no game, best value first: an aggregation for each."""
    left, out = parlay, None
    for rank in range(1, most + 1):
        best = left.groupBy("date").agg(F.min_by(F.struct("games", "price", "prob", "ev"), F.struct(-F.round("ev", 9), "key")).alias("_b"))
        taken = best.select("date", F.lit(rank).alias("rank"), "_b.*")
        out = taken if out is None else out.unionByName(taken)
        if rank < most:
            left = left.join(best, "date").where(~F.arrays_overlap("games", "_b.games")).drop("_b")
    return out


def grade_leg(kind: Column, selection: Column, line: Column, home: Column, away: Column) -> Column:
    """won / lost / push / void of a winner, spread or total leg; open while scores are missing."""
    margin, total = home - away, home + away
    side = F.when(selection == "home", margin).otherwise(-margin)
    x = F.when(kind == "winner", side).when(kind == "spread", side + line).when(kind == "total", F.when(selection == "over", total - line).otherwise(line - total)).when(kind == "draw", F.when(margin == 0, 1).otherwise(-1))
    return F.when(home.isNull() | away.isNull(), "open").when(x.isNull(), "void").when(x > 0, "won").when(x < 0, "lost").otherwise("push")


def grade_bets(bets: DataFrame, games: DataFrame) -> DataFrame:
    """Bets (game_id, kind, selection, line, odds, stake) with result and profit."""
    d = bets.join(games.select("game_id", "home_score", "away_score"), "game_id", "left")
    d = d.withColumn("result", grade_leg(F.col("kind"), F.col("selection"), F.col("line"), F.col("home_score"), F.col("away_score")))
    pnl = F.when(F.col("result") == "won", profit("stake", "odds")).when(F.col("result") == "lost", -F.col("stake")).otherwise(0.0)
    return d.drop("home_score", "away_score").withColumn("pnl", pnl)


def settle_slips(slips: DataFrame) -> DataFrame:
    """Slips with an array of legs (result, price): any loss loses, pushes and voids drop out, the rest multiply."""
    lost, open_ = F.exists("legs", lambda x: x["result"] == "lost"), F.exists("legs", lambda x: x["result"] == "open")
    won = F.filter("legs", lambda x: x["result"] == "won")
    price = F.aggregate(won, F.lit(1.0), lambda s, x: s * x["price"])
    result = F.when(lost, "lost").when(open_, "open").when(F.size(won) == 0, "push").otherwise("won")
    pnl = F.when(result == "won", F.col("stake") * (price - 1)).when(result == "lost", -F.col("stake")).otherwise(0.0)
    return slips.select("*", result.alias("result"), price.alias("price"), pnl.alias("pnl"))


def ledger_stats(bets: DataFrame) -> DataFrame:
    """Counts, profit, turnover and return by sport, by kind and in all, in one pass."""
    n = lambda r: F.count_if(F.col("result") == r)
    d = bets.groupingSets([["sport"], ["kind"], []], "sport", "kind").agg(
        F.grouping_id().alias("level"), F.count("*").alias("bets"), n("won").alias("won"), n("lost").alias("lost"), n("push").alias("push"), F.sum("pnl").alias("pnl"), F.sum("stake").alias("staked")
    )
    return d.withColumn("roi", F.when(F.col("staked") > 0, F.col("pnl") / F.col("staked")))


def leaderboard(bets: DataFrame, user: str, start: float = 1000.0) -> DataFrame:
    """Portfolios by balance."""
    from .windows import ranked

    open_ = F.sum(F.when(F.col("result") == "open", F.col("stake")).otherwise(0.0))
    d = bets.groupBy(user).agg((F.lit(start) + F.sum("pnl") - open_).alias("balance"), open_.alias("exposure"), F.count("*").alias("bets"))
    return ranked(d, [F.desc("balance"), F.asc(user)])


def opportunities(predictions: DataFrame, live: DataFrame, most: int) -> DataFrame:
    """Confidence (0.55 where there is none) moved a tenth of the live lead's sign, graded, best first."""
    lead = live.groupBy("game_id").agg(F.max_by(F.signum(F.col("home_score") - F.col("away_score")), "seq").alias("momentum"))
    d = predictions.join(lead, "game_id", "left")
    c = F.coalesce(F.greatest("home_win_prob", "away_win_prob"), F.lit(0.55)) + 0.1 * F.coalesce("momentum", F.lit(0.0))
    d = d.withColumn("confidence", F.greatest(F.least(c, F.lit(0.95)), F.lit(0.05)))
    return d.select("game_id", "sport", "confidence", grade("confidence").alias("grade"), tier("confidence").alias("tier")).orderBy(F.desc("confidence"), "game_id").limit(most)
