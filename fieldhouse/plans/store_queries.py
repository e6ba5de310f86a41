"""Stored state as registered queries: each builds yesterday's state first, and reaches today's by what has changed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..features import asof
from ..operators import evaluation as V, games as G, history as H, rollups as R
from ..sources.stored import shared_dir
from ..sources.versioned import VersionedTable
from .evaluation_queries import SCORED
from .registry import query
from ..streaming import live
from .table_queries import TG, half_up, rounded


def path(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex[:12]}"


def team_rollup(t) -> R.Rollup:
    m = F.col("pf") - F.col("pa")
    measures = dict([R.count("games"), R.count("wins", m > 0), R.mean("avg_for", "pf"), R.mean("avg_against", "pa"), R.deviation("spread", m), R.extreme("best", m, "max"), R.extreme("worst", m, "min")])
    return R.Rollup(t.spark, path(t, "team-rollup"), {"season": "long"}, {"sport": "string", "team_id": "long"}, measures, parts=8)


@query(
    "b5_stored_rollup",
    f"WITH {TG} SELECT sport, team_id, count(*) AS games, CAST(sum(CASE WHEN pf > pa THEN 1 ELSE 0 END) AS BIGINT) AS wins, round(avg(pf), 6) AS avg_for, round(avg(pa), 6) AS avg_against, round(stddev_samp(pf - pa), 5) AS spread, max(pf - pa) AS best, min(pf - pa) AS worst FROM tg WHERE completed AND season IS NOT NULL GROUP BY 1, 2",
)
def _(t):
    """Yesterday: without 1997, with other scores in 1995 and a season that is gone today. Only those three are computed again."""
    today = G.team_games(t.games).where("completed").select("season", "game_id", "sport", "team_id", "pf", "pa")
    other = today.where("season <> 1997").withColumn("pf", F.when(F.col("season") == 1995, F.col("pf") + 1).otherwise(F.col("pf")))
    r = team_rollup(t)
    r.refresh(other.unionByName(today.where("season = 1994").withColumn("season", F.lit(2050).cast("long"))))
    r.refresh(today)
    return r.read().select("sport", "team_id", "games", "wins", half_up("avg_for", 6).alias("avg_for"), half_up("avg_against", 6).alias("avg_against"), half_up("spread", 5).alias("spread"), "best", "worst")


# ---------------------------------------------------------------- reports by run


@query(
    "l10_coverage_trend",
    """WITH r AS (SELECT 1 AS run, * FROM games WHERE date < DATE '1996-07-01' AND NOT (sport = 'BUILDING' AND season = 1995) UNION ALL SELECT 2, * FROM games WHERE date < DATE '1997-07-01' AND season <> 1992),
 c AS (SELECT run, sport, season, count(*) AS games, count(home_score) AS scored FROM r GROUP BY 1, 2, 3), a AS (SELECT * FROM c WHERE run = 1), b AS (SELECT * FROM c WHERE run = 2)
 SELECT coalesce(a.sport, b.sport) AS sport, coalesce(a.season, b.season) AS season, b.games, a.games AS games_before, b.games - a.games AS games_change, b.scored - a.scored AS scored_change,
  CASE WHEN a.games IS NULL THEN 'new' WHEN b.games IS NULL THEN 'gone' WHEN b.games > a.games THEN 'up' WHEN b.games < a.games THEN 'down' ELSE 'same' END AS state FROM a FULL JOIN b ON a.sport = b.sport AND a.season = b.season""",
)
def _(t):
    """Two coverage reports: seasons and sports that came, went or grew since the first; the second run is logged twice."""
    table = VersionedTable(t.spark, path(t, "coverage"), "run long, sport string, season long, games long, scored long", ["run", "sport", "season"], 8)
    runs = {1: t.games.where("date < DATE'1996-07-01' AND NOT (sport = 'BUILDING' AND season = 1995)"), 2: t.games.where("date < DATE'1997-07-01' AND season <> 1992")}
    for run in (1, 2, 2):
        H.log(table, runs[run].groupBy("sport", "season").agg(F.count("*").alias("games"), F.count("home_score").alias("scored")).withColumn("run", F.lit(run).cast("long")), "run")
    d = H.against_previous(table.read(), "run", ["sport", "season"], ["games", "scored"])
    return d.where("run = 2").select("sport", "season", "games", "games_before", "games_change", "scored_change", "state")


@query(
    "k12_accuracy_trend",
    f"""WITH {SCORED}, r AS (SELECT CAST(y AS BIGINT) AS run, sc.* FROM sc, range(1993, 1999) q(y) WHERE year(sc.date) <= y), c AS (SELECT run, sport, avg(correct) AS acc FROM r GROUP BY 1, 2),
 n AS (SELECT *, dense_rank() OVER (ORDER BY run) AS no, row_number() OVER (PARTITION BY sport ORDER BY run DESC) AS k FROM c), l AS (SELECT * FROM n WHERE k <= 4)
 SELECT sport, round(max(CASE WHEN k = 1 THEN acc END), 6) AS latest, round(max(CASE WHEN k = 2 THEN acc END), 6) AS previous, round(max(CASE WHEN k = 1 THEN acc END) - max(CASE WHEN k = 2 THEN acc END), 6) + 0.0 AS change, count(*) AS runs, round(regr_slope(acc, no), 6) + 0.0 AS slope,
  CASE WHEN count(*) < 2 THEN 'short' WHEN regr_slope(acc, no) > 0.0005 THEN 'rising' WHEN regr_slope(acc, no) < -0.0005 THEN 'falling' ELSE 'flat' END AS direction FROM l GROUP BY 1""",
)
def _(t):
    """Accuracy so far at the end of each year, six reports; the direction of the last four."""
    table = VersionedTable(t.spark, path(t, "accuracy"), "run long, sport string, acc double", ["run", "sport"], 4)
    years = F.explode(F.expr("filter(sequence(1993L, 1998L), y -> y >= year(date))"))
    reports = V.scored(t.predictions).select("sport", "correct", years.alias("run")).groupBy("run", "sport").agg(F.avg("correct").alias("acc"))
    H.log(table, reports, "run")
    return rounded(H.trend(table.read(), "run", ["sport"], "acc", 4, 0.0005))


UNDATED = "ug AS (SELECT * REPLACE (CASE WHEN game_id % 3 = 0 OR home_team_id % 10 = 0 THEN NULL ELSE date END AS date) FROM games)"


@query(
    "i34_undated_form",
    f"""WITH {UNDATED}, {TG.replace("FROM games", "FROM ug")}, e AS (SELECT *, coalesce(date, max(date) OVER (PARTITION BY team_id ORDER BY game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), DATE '0001-01-01') AS day, date IS NULL AS u FROM tg),
 p AS (SELECT t.game_id, t.team_id, t.is_home, s.pf, s.pa, row_number() OVER (PARTITION BY t.game_id, t.team_id, t.is_home ORDER BY s.day DESC, s.u, s.game_id DESC) AS k, s.game_id AS sid
  FROM e t LEFT JOIN e s ON s.team_id = t.team_id AND s.completed AND (s.day < t.day OR (t.u AND s.u AND s.day = t.day AND s.game_id < t.game_id)))
 SELECT game_id, team_id, is_home, round(coalesce(avg(CASE WHEN pf > pa THEN 1.0 WHEN pf IS NOT NULL AND pa IS NOT NULL THEN 0.0 END), 0), 6) AS form_win_pct, round(coalesce(avg(CASE WHEN k <= 5 THEN pf - pa END), 0), 6) + 0.0 AS form_margin, count(sid) AS form_games FROM p WHERE k <= 10 GROUP BY 1, 2, 3""",
)
def _(t):
    g = t.games.withColumn("date", F.when((F.col("game_id") % 3 != 0) & (F.col("home_team_id") % 10 != 0), F.col("date")))
    return rounded(asof.undated_form(g))


# ---------------------------------------------------------------- live formulas

_SNAP = """snap AS (SELECT game_id, seq, home_score, away_score, ['basketball', 'football', 'hockey', 'baseball', 'soccer', 'curling'][CAST(seq % 6 AS INT) + 1] AS sport, CAST(seq // 6 % 10 AS INT) AS p, CAST(seq // 60 % 12 AS INT) AS mm, CAST(seq % 60 AS INT) AS ss FROM live_snapshots)"""


@query(
    "m6_live_formulas",
    f"""WITH {_SNAP}, c AS (SELECT *, CASE WHEN seq % 11 = 0 THEN NULL ELSE mm + ss / 60.0 END AS l, CASE WHEN p = 9 THEN 0 ELSE p END AS d FROM snap),
 e AS (SELECT *, CASE sport WHEN 'basketball' THEN greatest(CASE WHEN p = 9 THEN 5 ELSE d END - 1, 0) * 12 + 12 - coalesce(l, 12) WHEN 'football' THEN greatest(d - 1, 0) * 15 + 15 - coalesce(l, 15) WHEN 'hockey' THEN greatest(CASE WHEN p = 9 THEN 4 ELSE d END - 1, 0) * 20 + 20 - coalesce(l, 20)
   WHEN 'baseball' THEN greatest(CASE WHEN d = 0 THEN 1 ELSE d END - 1, 0) + CASE WHEN p % 2 = 0 THEN 0 ELSE 0.5 END WHEN 'soccer' THEN CASE WHEN p >= 7 THEN 120 - coalesce(l, 45) WHEN p >= 4 THEN 90 - coalesce(l, 45) ELSE 45 - coalesce(l, 45) END ELSE 30 END AS el FROM c),
 r AS (SELECT *, CASE sport WHEN 'basketball' THEN greatest(48 - el, 0.1) WHEN 'football' THEN greatest(60 - el, 0.1) WHEN 'hockey' THEN greatest(60 - el, 0.1) WHEN 'baseball' THEN greatest(9 - el, 0.5) WHEN 'soccer' THEN greatest(90 - least(el, 90), 0.1) ELSE 30 END AS rem, home_score - away_score AS m FROM e),
 z AS (SELECT r.game_id, r.seq, r.sport, r.el, ln(coalesce(p.home_win_prob, 0.5) / (1 - coalesce(p.home_win_prob, 0.5))) + CASE r.sport WHEN 'basketball' THEN 0.35 * m / sqrt(rem + 1) + 0.03 WHEN 'football' THEN (0.3 + 0.5 * el / 60) * 0.15 * m - CASE WHEN el / 60 > 0.75 AND m < 0 THEN 0.03 ELSE 0 END
   WHEN 'hockey' THEN m * 0.8 / sqrt(rem / 20 + 0.5) WHEN 'baseball' THEN 0.4 * CASE WHEN 9 - rem >= 8 THEN 2.0 WHEN 9 - rem >= 7 THEN 1.5 ELSE 1.0 END * m / sqrt(rem + 0.5) WHEN 'soccer' THEN m * 1.2 / sqrt(rem / 15 + 0.5) ELSE 0.2 * m / sqrt(rem + 1) END AS z FROM r LEFT JOIN predictions p ON p.game_id = r.game_id)
 SELECT game_id, seq, sport, round(CAST(el AS DOUBLE), 5) AS elapsed, round(1 / (1 + exp(-z)), 6) AS home_win_prob FROM z""",
)
def _(t):
    """Each sport's formula on every snapshot, with periods and clocks written as providers do."""
    seq = F.col("seq")
    sport = F.element_at(F.array(*map(F.lit, ("basketball", "football", "hockey", "baseball", "soccer", "curling"))), (seq % 6 + 1).cast("int"))
    p = F.floor(seq / 6) % 10
    half = F.when(p >= 7, "Extra time").when(p >= 4, "2nd Half").otherwise("1st Half")
    inning = F.concat(F.when(p % 2 == 0, "Top ").otherwise("Bot "), F.when(p == 9, "").otherwise(p.cast("string")))
    period = F.when(sport == "soccer", half).when(sport == "baseball", inning).when((p == 9) & (sport != "football"), "OT").when(p == 9, "").otherwise(F.concat(F.lit("Q"), p.cast("string")))
    clock = F.when(seq % 11 != 0, F.concat((F.floor(seq / 60) % 12).cast("string"), F.lit(":"), F.lpad((seq % 60).cast("string"), 2, "0")))
    d = t.live_snapshots.select("game_id", "seq", "home_score", "away_score", sport.alias("sport"), period.alias("period"), clock.alias("clock"))
    return live.live_win_probability(d, t.predictions).select("game_id", "seq", "sport", half_up("elapsed", 5).alias("elapsed"), half_up("home_win_prob", 6).alias("home_win_prob"))
