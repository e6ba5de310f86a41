"""The as-of primitive and the features built on it.

A feature of a game may use completed games of strictly earlier dates only. ``as_of`` computes any aggregates over
the last n completed games ending at each completed game, then carries to every row the newest such state of an
earlier date. Both are windows by team, so all features of one call share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.games import team_games

State = dict[str, tuple[int, Callable[[object], Column]]]


def as_of(tg: DataFrame, states: State, keys: tuple[str, ...] = ("team_id",), order: tuple[str, ...] = ("date", "game_id"), known: str = "completed") -> DataFrame:
    """All rows of ``tg`` with, per state name, its value over the last n known rows of earlier dates (null: none).

    ``states`` maps a name to (n, window -> Column); n 0 means all rows before.
    """
    part = W.partitionBy(*keys, known).orderBy(*order)
    frames = {n: part.rowsBetween(-(n - 1) if n else W.unboundedPreceding, 0) for n, _ in states.values()}
    d = tg.select("*", *(agg(frames[n]).alias(f"_s_{name}") for name, (n, agg) in states.items()))
    here = F.struct(*(F.col(f"_s_{name}").alias(name) for name in states))
    d = d.withColumn("_state", F.when(F.col(known), here)).withColumn("_day", F.unix_date(order[0]))
    before = W.partitionBy(*keys).orderBy("_day").rangeBetween(W.unboundedPreceding, -1)
    rank = F.when(F.col(known), F.struct(*order))
    d = d.withColumn("_last", F.max_by("_state", rank).over(before))
    return d.select(*tg.columns, *(F.col(f"_last.{name}").alias(name) for name in states))


_DAY = 1 << 20


def as_of_undated(tg: DataFrame, states: State, keys: tuple[str, ...] = ("team_id",), known: str = "completed") -> DataFrame:
    """``as_of`` where some games have no date, or none has: ids are given in order of time.

    An undated game stands on the newest date of the team's dated games with smaller ids (before all dates where there is none), in
    order of its id. It sees dated games of earlier days and undated ones that stand before it; a dated game sees what stands on
    earlier days. So nothing is seen that may be later, and without any date the order is that of the ids.
    """
    by_id = W.partitionBy(*keys).orderBy("game_id").rowsBetween(W.unboundedPreceding, -1)
    undated = F.col("date").isNull()
    day = F.coalesce(F.unix_date("date"), F.unix_date(F.max("date").over(by_id)), F.lit(-1_000_000)).cast("long")
    d = tg.withColumn("_day", day).withColumn("_undated", undated)
    nth = F.row_number().over(W.partitionBy(*keys, "_day", "_undated").orderBy("game_id"))
    start = F.col("_day") * _DAY
    d = d.withColumn("_nth", nth).withColumn("_place", start + F.when(F.col("_undated"), F.col("_nth")).otherwise(_DAY - 1)).withColumn("_look", start + F.when(F.col("_undated"), F.col("_nth")).otherwise(0))
    part = W.partitionBy(*keys, known).orderBy("_place", "game_id")
    frames = {n: part.rowsBetween(-(n - 1) if n else W.unboundedPreceding, 0) for n, _ in states.values()}
    d = d.select("*", *(agg(frames[n]).alias(f"_s_{name}") for name, (n, agg) in states.items()))
    here = F.struct(*(F.col(f"_s_{name}").alias(name) for name in states))
    d = d.withColumn("_state", F.when(F.col(known), here))
    events = F.array(F.struct(F.col("_place").alias("k"), F.col("_state").alias("s"), F.lit(False).alias("asks")), F.struct(F.col("_look").alias("k"), F.lit(None).alias("s"), F.lit(True).alias("asks")))
    d = d.select(*tg.columns, F.explode(events).alias("_e")).withColumn("_k", F.col("_e.k"))
    before = W.partitionBy(*keys).orderBy("_k").rangeBetween(W.unboundedPreceding, -1)
    rank = F.when(F.col("_e.s").isNotNull(), F.struct("_k", "game_id"))
    d = d.withColumn("_last", F.max_by("_e.s", rank).over(before)).where("_e.asks")
    return d.select(*tg.columns, *(F.col(f"_last.{name}").alias(name) for name in states))


def undated_form(games: DataFrame, n: int = 10, short: int = 5) -> DataFrame:
    """Share of wins and margin of the last games, for tables whose dates are missing in part or altogether."""
    f = as_of_undated(team_games(games), {"form_win_pct": (n, mean("win")), "form_margin": (short, mean(F.col("pf") - F.col("pa"))), "form_games": (n, count())})
    return f.select("game_id", "team_id", "is_home", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("form_win_pct", "form_margin", "form_games")))


def mean(c: str | Column) -> Callable[[object], Column]:
    return lambda w: F.avg(c).over(w)


def total(c: str | Column) -> Callable[[object], Column]:
    return lambda w: F.sum(c).over(w)


def count(cond: Column | None = None) -> Callable[[object], Column]:
    return lambda w: (F.count("*") if cond is None else F.count_if(cond)).over(w)


def share(cond: Column) -> Callable[[object], Column]:
    return lambda w: F.avg(F.when(cond, 1.0).otherwise(0.0)).over(w)


def deviation(c: str | Column) -> Callable[[object], Column]:
    return lambda w: F.stddev_samp(c).over(w)


def form(games: DataFrame, n: int = 10) -> DataFrame:
    """Share of wins, points for and against, margin and number of the last n games; 0 where there are none."""
    m = F.col("pf") - F.col("pa")
    f = as_of(team_games(games), {"form_win_pct": (n, mean("win")), "form_ppg": (n, mean("pf")), "form_opp_ppg": (n, mean("pa")), "form_margin": (n, mean(m)), "form_games": (n, count())})
    return f.select("game_id", "team_id", "is_home", "date", *(F.coalesce(c, F.lit(0)).alias(c) for c in f.columns if c.startswith("form_")))


def venue_form(games: DataFrame, n: int = 10, wide: int = 30, least: int = 3) -> DataFrame:
    """Share of wins at home and away over the last ``wide`` games (n at most of each), all games if under ``least``."""
    def last(flag: Column) -> Callable[[object], Column]:
        return lambda w: F.slice(F.reverse(F.collect_list(F.when(flag, F.col("win"))).over(w)), 1, n)

    f = as_of(team_games(games), {"_h": (wide, last(F.col("is_home"))), "_a": (wide, last(~F.col("is_home"))), "_all": (n, mean("win"))})
    avg = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    pick = lambda a: F.when(F.size(a) >= least, avg(F.when(F.size(a) >= least, F.col(a)))).otherwise(F.col("_all"))
    return f.select("game_id", "team_id", "is_home", "date", F.coalesce(pick("_h"), F.lit(0.5)).alias("home_win_pct"), F.coalesce(pick("_a"), F.lit(0.5)).alias("away_win_pct"))


def head_to_head(games: DataFrame, n: int = 10, n_home: int = 8) -> DataFrame:
    """Share of wins and margin against this opponent, in all and at this venue side."""
    m = F.col("pf") - F.col("pa")
    tg = team_games(games)
    a = as_of(tg, {"h2h_win_pct": (n, mean("win")), "h2h_margin": (n, mean(m)), "h2h_games": (n, count())}, ("team_id", "opp_id"))
    b = as_of(tg, {"h2h_side_win_pct": (n_home, mean("win"))}, ("team_id", "opp_id", "is_home")).select("game_id", "team_id", "is_home", "h2h_side_win_pct")
    d = a.join(b, ["game_id", "team_id", "is_home"])
    return d.select("game_id", "team_id", "is_home", F.coalesce("h2h_win_pct", F.lit(0.5)).alias("h2h_win_pct"), F.coalesce("h2h_margin", F.lit(0.0)).alias("h2h_margin"), F.coalesce("h2h_games", F.lit(0)).alias("h2h_games"), F.coalesce("h2h_side_win_pct", F.lit(0.5)).alias("h2h_side_win_pct"))


def rest(games: DataFrame, default: int = 7) -> DataFrame:
    """Days since the last completed game of an earlier date, back-to-back flag, games in the last 7 and 14 days."""
    tg = team_games(games)
    f = as_of(tg, {"last_date": (1, lambda w: F.max("date").over(w))})
    done = F.when(F.col("completed"), 1).otherwise(0)
    w = W.partitionBy("team_id").orderBy("_day")
    f = f.withColumn("_day", F.unix_date("date")).select("game_id", "team_id", "is_home", "date", "last_date", *(F.coalesce(F.sum(done).over(w.rangeBetween(-n, -1)), F.lit(0)).alias(f"games_{n}d") for n in (7, 14)))
    days = F.coalesce(F.datediff("date", "last_date"), F.lit(default))
    return f.select("game_id", "team_id", "is_home", "date", days.alias("rest_days"), (days <= 1).alias("back_to_back"), "games_7d", "games_14d")


def fatigue(games: DataFrame) -> DataFrame:
    """Schedule fatigue: 30 for a back-to-back, 10 a game in 7 days over 2, 5 a game in 14 days over 5, within [0, 100]."""
    f = rest(games)
    score = F.when(F.col("back_to_back"), 30).otherwise(0) + F.greatest(F.col("games_7d") - 2, F.lit(0)) * 10 + F.greatest(F.col("games_14d") - 5, F.lit(0)) * 5
    score = F.least(score, F.lit(100)).cast("long")
    return f.withColumn("fatigue_score", score).withColumn("fatigue_level", F.when(score >= 50, "high").when(score >= 20, "medium").otherwise("low"))


def momentum(games: DataFrame, n: int = 5) -> DataFrame:
    """Mean of +1 / -1 for wins and losses, weights falling evenly from 1 (newest) to 0.5."""
    f = as_of(team_games(games), {"_w": (n, lambda w: F.collect_list("win").over(w))})
    newest = F.reverse("_w")
    k = F.size("_w")
    weights = F.transform(newest, lambda x, i: F.when(k > 1, 1 - 0.5 * i / (k - 1)).otherwise(1.0))
    signed = F.zip_with(newest, weights, lambda x, v: (2 * x - 1) * v)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return f.select("game_id", "team_id", "is_home", F.coalesce(F.when(k > 0, add(signed) / add(weights)), F.lit(0.0)).alias("momentum"))


def scoring(games: DataFrame, n: int = 10, exponent: float = 13.91) -> DataFrame:
    """Scoring of the last five, Pythagorean expectation, its gap to the record, spread, total points, close-game record."""
    m, close = F.col("pf") - F.col("pa"), F.abs(F.col("pf") - F.col("pa")) <= 5
    f = as_of(
        team_games(games),
        {
            "last5_ppg": (5, mean("pf")), "_pf": (n, total("pf")), "_pa": (n, total("pa")), "_pct": (n, mean("win")), "volatility": (n, deviation(m)),
            "total_points": (n, mean(F.col("pf") + F.col("pa"))), "close_win_pct": (n, mean(F.when(close, F.col("win")))),
        },
    )
    pyth = F.when(F.col("_pf") > 0, 1 / (1 + F.pow(F.col("_pa") / F.when(F.col("_pf") > 0, F.col("_pf")), exponent)))
    return f.select(
        "game_id", "team_id", "is_home", F.coalesce("last5_ppg", F.lit(0.0)).alias("last5_ppg"), F.coalesce(pyth, F.lit(0.5)).alias("pythagorean"), F.coalesce(F.col("_pct") - pyth, F.lit(0.0)).alias("luck"),
        F.coalesce("volatility", F.lit(0.0)).alias("volatility"), F.coalesce("total_points", F.lit(0.0)).alias("total_points"), F.coalesce("close_win_pct", F.lit(0.5)).alias("close_win_pct"),
    )


def short_trend(games: DataFrame, short: int = 3, long_: int = 10) -> DataFrame:
    """Mean margin of the last ``short`` games against the games before them, up to ``long_`` in all."""
    m = F.col("pf") - F.col("pa")
    f = as_of(team_games(games), {"_a": (short, total(m)), "_b": (long_, total(m)), "_na": (short, count()), "_nb": (long_, count())})
    late, early = F.col("_a") / F.col("_na"), (F.col("_b") - F.col("_a")) / F.nullif(F.col("_nb") - F.col("_na"), F.lit(0))
    return f.select("game_id", "team_id", "is_home", F.coalesce(late - early, F.lit(0.0)).alias("trend"))


def trend_slope(games: DataFrame, n: int = 10) -> DataFrame:
    """Slope of the margin over the last n games."""
    m = F.col("pf") - F.col("pa")
    tg = team_games(games).withColumn("_i", F.row_number().over(W.partitionBy("team_id", "completed").orderBy("date", "game_id")).cast("double"))
    f = as_of(tg, {"slope": (n, lambda w: F.regr_slope(m, F.col("_i")).over(w))})
    return f.select("game_id", "team_id", "is_home", F.coalesce("slope", F.lit(0.0)).alias("slope"))


def current_streak(games: DataFrame) -> DataFrame:
    """Signed run of wins or losses before the game, 0 without one."""
    tg = team_games(games)
    w = W.partitionBy("team_id", "completed").orderBy("date", "game_id")
    d = tg.withColumn("_c", F.when(F.lag("win").over(w) == F.col("win"), 0).otherwise(1)).withColumn("_g", F.sum("_c").over(w))
    n = F.row_number().over(W.partitionBy("team_id", "completed", "_g").orderBy("date", "game_id"))
    d = d.withColumn("_run", F.when(F.col("win") == 1, n).otherwise(-n))
    f = as_of(d, {"streak": (1, lambda w: F.max("_run").over(w))})
    return f.select("game_id", "team_id", "is_home", F.coalesce("streak", F.lit(0)).alias("streak"))


def season_split(games: DataFrame) -> DataFrame:
    """Season record at home and away (of the whole season: not a point-in-time feature)."""
    tg = team_games(games).where("completed")
    pct = lambda c: F.coalesce(F.avg(F.when(c, F.col("win"))), F.lit(0.5))
    return tg.groupBy("season", "team_id").agg(F.count("*").alias("games"), F.avg("win").alias("win_pct"), pct(F.col("is_home")).alias("home_win_pct"), pct(~F.col("is_home")).alias("away_win_pct"), F.avg("pf").alias("ppg"))


def quality_form(games: DataFrame, n: int = 10, opponents: int = 20) -> DataFrame:
    """Wins and losses of the last n games weighted by what the opponents' records are at the target's date,
    strength of schedule, and margin corrected by the opponents' margins.

    The opponents of each target's last n games join their states at the target's date: at most n rows a target.
    """
    tg = team_games(games)
    m = F.col("pf") - F.col("pa")
    past = F.struct("opp_id", "win", m.alias("margin"))
    t = as_of(tg, {"past": (n, lambda w: F.collect_list(past).over(w))}).select("game_id", "team_id", "is_home", "date", "past")
    each = t.select("game_id", "team_id", "is_home", "date", F.explode_outer("past").alias("p")).select("game_id", "team_id", "is_home", "date", "p.opp_id", "p.win", "p.margin")
    # states of (opponent, date): the asked dates enter as rows that are no games
    asked = each.where("opp_id IS NOT NULL").select(F.col("opp_id").alias("team_id"), "date").distinct()
    rows = tg.select("team_id", "date", "game_id", "win", m.alias("margin"), "completed").unionByName(asked.withColumn("completed", F.lit(False)), allowMissingColumns=True)
    st = as_of(rows, {"o_pct": (opponents, mean("win")), "o_margin": (opponents, mean("margin"))}).where("game_id IS NULL").select(F.col("team_id").alias("opp_id"), "date", "o_pct", "o_margin")
    d = each.join(st, ["opp_id", "date"], "left")
    pct = F.coalesce("o_pct", F.lit(0.5))
    return d.groupBy("game_id", "team_id", "is_home").agg(
        F.coalesce(F.avg((2 * F.col("win") - 1) * F.when(F.col("opp_id").isNotNull(), pct)), F.lit(0.0)).alias("quality_form"),
        F.coalesce(F.avg(F.when(F.col("opp_id").isNotNull(), pct)), F.lit(0.5)).alias("schedule_strength"),
        F.coalesce(F.avg(F.col("margin") + F.when(F.col("opp_id").isNotNull(), F.coalesce("o_margin", F.lit(0.0)))), F.lit(0.0)).alias("adjusted_margin"),
    )


def tier_form(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Share of wins against top, middle and bottom thirds of the season's table of each conference (whole season)."""
    tg = team_games(games).where("completed")
    table = tg.groupBy("season", "team_id").agg(F.avg("win").alias("pct")).join(teams.select("team_id", "conference"), "team_id")
    third = F.ntile(3).over(W.partitionBy("season", "conference").orderBy(F.desc("pct"), "team_id"))
    table = table.select("season", F.col("team_id").alias("opp_id"), third.alias("third"))
    d = tg.join(table, ["season", "opp_id"])
    return d.groupBy("season", "team_id").agg(*(F.avg(F.when(F.col("third") == i, F.col("win"))).alias(f"vs_{n}") for i, n in enumerate(("top", "middle", "bottom"), 1)), F.count("*").alias("games"))


def wide(games: DataFrame, features: DataFrame) -> DataFrame:
    """Features of both sides in the game's row, with differences."""
    names = [c for c in features.columns if c not in ("game_id", "team_id", "is_home", "date")]
    side = lambda flag, p: features.where(F.col("is_home") == flag).select("game_id", *(F.col(c).alias(f"{p}_{c}") for c in names))
    d = games.join(side(True, "home"), "game_id").join(side(False, "away"), "game_id")
    numbers = [c for c in names if dict(features.dtypes)[c] in ("int", "bigint", "double")]
    return d.select("*", *((F.col(f"home_{c}") - F.col(f"away_{c}")).alias(f"delta_{c}") for c in numbers))


# ---------------------------------------------------------------- players


def player_state(players: DataFrame, stats: list[str], n: int = 10) -> DataFrame:
    """Means of a player's last n rows of earlier dates."""
    d = players.withColumn("completed", F.lit(True))
    f = as_of(d, {**{f"avg_{s}": (n, mean(s)) for s in stats}, "n_games": (n, count())}, ("player_id",), ("date", "game_id", "seq", *stats))
    return f.drop("completed")


def team_players(players: DataFrame) -> DataFrame:
    """Per team and date, from player rows of earlier dates: points a player row, the top scorer's share, roster size.

    Player totals to date are windows by (team, player); the team's state is an aggregate over them by date.
    """
    daily = players.groupBy("team_id", "player_id", "date").agg(F.sum("pts").alias("pts"), F.count("*").alias("n"))
    w = W.partitionBy("team_id", "player_id").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    daily = daily.select("team_id", "player_id", "date", "pts", "n", F.sum("pts").over(w).alias("cum"), F.row_number().over(W.partitionBy("team_id", "player_id").orderBy("date")).alias("k"))
    by = daily.groupBy("team_id", "date").agg(F.sum("pts").alias("pts"), F.sum("n").alias("rows"), F.count_if(F.col("k") == 1).alias("new"), F.max("cum").alias("top"))
    before = W.partitionBy("team_id").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    pts, rows = F.sum("pts").over(before), F.sum("rows").over(before)
    return by.select("team_id", "date", F.coalesce(pts / rows, F.lit(0.0)).alias("ppr"), F.coalesce(F.max("top").over(before) / F.nullif(pts, F.lit(0.0)), F.lit(0.0)).alias("top_share"), F.coalesce(F.sum("new").over(before), F.lit(0)).alias("roster"))


def stars(players: DataFrame, n_games: int = 10, most: int = 3) -> DataFrame:
    """Each season's top players of a team over its last games by minutes, with their points a minute."""
    g = W.partitionBy("season", "team_id")
    d = players.withColumn("_g", F.dense_rank().over(g.orderBy(F.desc("date"), F.desc("game_id")))).where(F.col("_g") <= n_games)
    t = d.groupBy("season", "team_id", "player_id").agg(F.sum("minutes").alias("minutes"), F.sum("pts").alias("pts"))
    t = t.withColumn("star", F.row_number().over(g.orderBy(F.desc("minutes"), "player_id"))).where(F.col("star") <= most)
    return t.select("season", "team_id", "star", "player_id", "minutes", (F.col("pts") / F.col("minutes")).alias("per_minute"))


def star_absence(players: DataFrame, stars_: DataFrame) -> DataFrame:
    """Star players without a row in a game of their team."""
    games = players.select("season", "team_id", "game_id").distinct()
    due = games.join(stars_.select("season", "team_id", "player_id"), ["season", "team_id"])
    return due.join(players.select("game_id", "player_id").distinct(), ["game_id", "player_id"], "left_anti")


def injury_burden(injuries: DataFrame) -> DataFrame:
    """Counts by status and severity 3 out + 2 questionable + 1 day-to-day per team."""
    s = F.lower("status")
    out, q, dtd = F.count_if(s.rlike("out|injured reserve")), F.count_if(s.rlike("question|doubt")), F.count_if(s.rlike("day-to-day|probable"))
    return injuries.groupBy("team_id").agg(out.alias("out"), q.alias("questionable"), dtd.alias("day_to_day"), (3 * out + 2 * q + dtd).alias("severity"))


def defence_allowed(players: DataFrame, games: DataFrame, stat: str = "pts", n: int = 10) -> DataFrame:
    """What a team's opponents' players scored per game, mean of its last n games of earlier dates."""
    tg = team_games(games).select("game_id", "team_id", "opp_id", "is_home", "date")
    made = players.groupBy("game_id", F.col("team_id").alias("opp_id")).agg(F.sum(stat).alias("allowed"))
    d = tg.join(made, ["game_id", "opp_id"], "left").withColumn("completed", F.col("allowed").isNotNull())
    f = as_of(d, {"allowed_avg": (n, mean("allowed"))})
    return f.select("game_id", "team_id", "is_home", F.coalesce("allowed_avg", F.lit(0.0)).alias("allowed_avg"))


def hero_rates(picks: DataFrame, least: int = 5) -> DataFrame:
    """Win rate of each pick over games of earlier dates, 0.5 under ``least`` games; sums per game and side."""
    daily = picks.groupBy("hero", "date").agg(F.sum("win").alias("w"), F.count("*").alias("n"))
    before = W.partitionBy("hero").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    n = F.coalesce(F.sum("n").over(before), F.lit(0))
    rate = F.when(n >= least, F.sum("w").over(before) / n).otherwise(0.5)
    st = daily.select("hero", "date", rate.alias("rate"))
    d = picks.join(st, ["hero", "date"])
    return d.groupBy("game_id", "side").agg(F.sum("rate").alias("sum_rate"), F.avg("rate").alias("avg_rate"), F.max("rate").alias("best"), F.min("rate").alias("worst"))


def series_number(games: DataFrame, gap: int = 6) -> DataFrame:
    """Number of the game in a run of meetings of the same pair at most ``gap`` days apart."""
    pair = [F.least("home_team_id", "away_team_id").alias("lo"), F.greatest("home_team_id", "away_team_id").alias("hi")]
    w = W.partitionBy("lo", "hi").orderBy("date", "game_id")
    d = games.select("game_id", "date", *pair).withColumn("_n", F.when(F.datediff("date", F.lag("date").over(w)) <= gap, 0).otherwise(1)).withColumn("_s", F.sum("_n").over(w))
    return d.select("game_id", "lo", "hi", F.row_number().over(W.partitionBy("lo", "hi", "_s").orderBy("date", "game_id")).alias("series_game"))


def period_features(periods: DataFrame, n: int = 10) -> DataFrame:
    """From per-period scores (arrays mine, theirs): first period and half margins, comebacks, overtime share."""
    cut = lambda a, k: F.aggregate(F.slice(a, 1, k), F.lit(0.0), lambda s, x: s + x)
    first, half = F.get("mine", F.lit(0)) - F.get("theirs", F.lit(0)), cut("mine", 2) - cut("theirs", 2)
    back = (half < 0) & (F.col("win") == 1)
    f = as_of(periods, {"first_period": (n, mean(first)), "first_half": (n, mean(half)), "comeback_rate": (n, share(back)), "overtime_rate": (n, share(F.size("mine") > 4))})
    return f.select("game_id", "team_id", "is_home", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("first_period", "first_half", "comeback_rate", "overtime_rate")))
