"""Markets, evaluation, quality, streaming and models as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V, games as G, market as M, quality as Q, windows
from ..sources.stored import written
from ..streaming import live
from . import models
from .feature_queries import PAST
from .registry import query
from .table_queries import LATEST, half_up, rounded

SCORED = """sc AS (SELECT *, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS outcome, greatest(home_win_prob, 1 - home_win_prob) AS confidence,
 CASE WHEN (home_win_prob >= 0.5) = (home_score > away_score) THEN 1 ELSE 0 END AS correct FROM predictions WHERE home_score IS NOT NULL AND away_score IS NOT NULL AND home_score <> away_score AND home_win_prob BETWEEN 0 AND 1)"""
BRIER = "pow(home_win_prob - outcome, 2)"
LOGLOSS = "-ln(CASE WHEN outcome = 1 THEN greatest(least(home_win_prob, 1 - 1e-9), 1e-9) ELSE 1 - greatest(least(home_win_prob, 1 - 1e-9), 1e-9) END)"
BAND = "CASE WHEN confidence >= 0.9 THEN '90+' WHEN confidence >= 0.8 THEN '80-90' WHEN confidence >= 0.7 THEN '70-80' WHEN confidence >= 0.6 THEN '60-70' ELSE '<60' END"
IMPLIED = "CASE WHEN h2h_home > 0 THEN 100 / (h2h_home + 100) ELSE abs(h2h_home) / (abs(h2h_home) + 100) END"

# ---------------------------------------------------------------- markets


@query("j1_consensus", f"WITH p AS (SELECT *, {IMPLIED} AS p FROM odds), s AS (SELECT game_id, bookmaker, seq, count(*) OVER w AS n, stddev_pop(p) OVER w AS d FROM p WINDOW w AS (PARTITION BY game_id)) SELECT game_id, bookmaker, seq, round(CASE WHEN n >= 2 THEN greatest(least(100 - 1000 * d, 100), 0) END, 6) AS consensus, CASE WHEN n >= 2 THEN d > 0.03 END AS warning FROM s")
def _(t):
    return rounded(M.consensus(t.odds).select("game_id", "bookmaker", "seq", "consensus", "warning"))


@query(
    "i8_consensus_features",
    f"WITH {LATEST}, p AS (SELECT *, {IMPLIED} AS p, CASE WHEN h2h_home < h2h_away THEN 1.0 ELSE 0.0 END AS f FROM latest) SELECT game_id, round(avg(nullif(h2h_home, 0)), 6) AS home_ml, round(avg(nullif(h2h_away, 0)), 6) AS away_ml, round(avg(nullif(spread_home, 0)), 6) + 0.0 AS spread, round(avg(nullif(total_line, 0)), 6) AS total, round(avg(p), 6) AS home_implied, count(*) AS books, round(greatest(avg(f), 1 - avg(f)), 6) AS agreement FROM p GROUP BY 1",
)
def _(t):
    return rounded(M.consensus_features(t.odds))


@query(
    "i10_signal_features",
    "WITH m AS (SELECT game_id, bookmaker, arg_max(total_line, (ts, seq, tie)) - arg_min(total_line, (ts, seq, tie)) AS mv FROM odds GROUP BY 1, 2) SELECT game_id, round(avg(mv), 6) + 0.0 AS avg_move, count(*) AS books, count(CASE WHEN abs(mv) >= 10 THEN 1 END) AS steam FROM m GROUP BY 1",
)
def _(t):
    d = windows.line_movement(t.odds, "total_line")
    return rounded(d.groupBy("game_id").agg(F.avg("move").alias("avg_move"), F.count("*").alias("books"), F.count_if(F.col("regime") == "steam").alias("steam")))


PRICES = f"{LATEST}, pr AS (SELECT game_id, bookmaker, 'home' AS selection, CASE WHEN h2h_home > 0 THEN 1 + h2h_home / 100 ELSE 1 + 100 / abs(h2h_home) END AS price FROM latest UNION ALL SELECT game_id, bookmaker, 'away', CASE WHEN h2h_away > 0 THEN 1 + h2h_away / 100 ELSE 1 + 100 / abs(h2h_away) END FROM latest), best AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY game_id, selection ORDER BY price DESC, bookmaker) = 1)"


@query("j3_best_price", f"WITH {PRICES} SELECT game_id, selection, bookmaker, round(price, 6) AS price FROM best")
def _(t):
    return rounded(M.best_price(t.odds))


CANDS = f"{PRICES}, u AS (SELECT game_id, sport, date, 'home' AS selection, home_win_prob AS prob FROM predictions UNION ALL SELECT game_id, sport, date, 'away', away_win_prob FROM predictions), c AS (SELECT u.*, b.bookmaker, b.price, prob - 1 / price AS edge, prob * (price - 1) - (1 - prob) AS ev FROM u JOIN best b ON u.game_id = b.game_id AND u.selection = b.selection WHERE prob - 1 / price >= 0.02)"


@query("j4_candidates", f"WITH {CANDS} SELECT game_id, selection, bookmaker, round(edge, 6) AS edge, round(ev, 6) AS ev, CASE WHEN prob >= 0.7 THEN 'high' WHEN prob >= 0.55 THEN 'medium' ELSE 'low' END AS tier, round(1000 * least(greatest(0.25 * ((price - 1) * prob - (1 - prob)) / (price - 1), 0), 0.05), 6) AS stake FROM c")
def _(t):
    return rounded(M.candidates(t.predictions, t.odds).select("game_id", "selection", "bookmaker", "edge", "ev", "tier", "stake"))


PAIRS = f"""{CANDS}, s AS (SELECT * FROM c WHERE prob >= 0.55),
 y AS (SELECT a.date, a.game_id AS g1, a.selection AS s1, b.game_id AS g2, b.selection AS s2, a.price * b.price AS price, a.prob * b.prob * 0.97 AS prob FROM s a JOIN s b ON a.date = b.date AND a.game_id < b.game_id),
 yy AS (SELECT *, prob * (price - 1) - (1 - prob) AS ev FROM y WHERE prob * (price - 1) - (1 - prob) >= 0)"""


@query("j6_parlays", f"WITH {PAIRS} SELECT date, g1, g2, round(price, 6) AS price, round(prob, 6) AS prob FROM yy")
def _(t):
    p = M.parlays(M.candidates(t.predictions, t.odds))
    return rounded(p.select("date", F.get("games", F.lit(0)).alias("g1"), F.get("games", F.lit(1)).alias("g2"), "price", "prob"))


_TAKE = "QUALIFY row_number() OVER (PARTITION BY date ORDER BY round(ev, 9) DESC, g1, s1, g2, s2) = 1"
_LEFT = "SELECT r.* FROM {0} r JOIN {1} b ON r.date = b.date WHERE r.g1 NOT IN (b.g1, b.g2) AND r.g2 NOT IN (b.g1, b.g2)"


@query(
    "j6_disjoint_parlays",
    f"""WITH {PAIRS}, b1 AS (SELECT * FROM yy {_TAKE}), r2 AS ({_LEFT.format("yy", "b1")}), b2 AS (SELECT * FROM r2 {_TAKE}), r3 AS ({_LEFT.format("r2", "b2")}), b3 AS (SELECT * FROM r3 {_TAKE}),
 picked AS (SELECT *, 1 AS rank FROM b1 UNION ALL SELECT *, 2 FROM b2 UNION ALL SELECT *, 3 FROM b3) SELECT date, rank, g1, g2, round(price, 6) AS price, round(prob, 6) AS prob, round(ev, 6) AS ev FROM picked""",
)
def _(t):
    d = M.disjoint(M.parlays(written(M.contenders(M.candidates(t.predictions, t.odds), most=3), "contenders")))
    return rounded(d.select("date", "rank", F.get("games", F.lit(0)).alias("g1"), F.get("games", F.lit(1)).alias("g2"), "price", "prob", "ev"))


BETS = "b AS (SELECT game_id, sport, date, CASE game_id % 3 WHEN 0 THEN 'winner' WHEN 1 THEN 'spread' ELSE 'total' END AS kind, CASE WHEN game_id % 3 = 2 THEN (CASE WHEN game_id % 2 = 0 THEN 'over' ELSE 'under' END) ELSE (CASE WHEN game_id % 2 = 0 THEN 'home' ELSE 'away' END) END AS selection, CASE game_id % 3 WHEN 1 THEN CAST(game_id % 11 - 5 AS DOUBLE) WHEN 2 THEN CAST(150 + game_id % 60 AS DOUBLE) END AS line, CASE WHEN game_id % 5 < 2 THEN 120.0 ELSE -110.0 END AS odds, CAST(50 + game_id % 4 * 25 AS DOUBLE) AS stake, home_score, away_score FROM games)"
GRADED = f"{BETS}, x AS (SELECT *, CASE kind WHEN 'winner' THEN CASE WHEN selection = 'home' THEN home_score - away_score ELSE away_score - home_score END WHEN 'spread' THEN CASE WHEN selection = 'home' THEN home_score - away_score ELSE away_score - home_score END + line ELSE CASE WHEN selection = 'over' THEN home_score + away_score - line ELSE line - home_score - away_score END END AS d FROM b), gr AS (SELECT *, CASE WHEN d IS NULL THEN 'open' WHEN d > 0 THEN 'won' WHEN d < 0 THEN 'lost' ELSE 'push' END AS result FROM x), gb AS (SELECT *, CASE result WHEN 'won' THEN CASE WHEN odds > 0 THEN stake * odds / 100 ELSE stake * 100 / abs(odds) END WHEN 'lost' THEN -stake ELSE 0.0 END AS pnl FROM gr)"


def bets(t):
    g = F.col("game_id")
    kind = F.when(g % 3 == 0, "winner").when(g % 3 == 1, "spread").otherwise("total")
    selection = F.when(g % 3 == 2, F.when(g % 2 == 0, "over").otherwise("under")).otherwise(F.when(g % 2 == 0, "home").otherwise("away"))
    line = F.when(g % 3 == 1, (g % 11 - 5).cast("double")).when(g % 3 == 2, (150 + g % 60).cast("double"))
    return t.games.select("game_id", "sport", "date", kind.alias("kind"), selection.alias("selection"), line.alias("line"), F.when(g % 5 < 2, 120.0).otherwise(-110.0).alias("odds"), (50 + g % 4 * 25).cast("double").alias("stake"))


@query("j8_grade_bets", f"WITH {GRADED} SELECT game_id, kind, selection, result, round(pnl, 6) AS pnl FROM gb")
def _(t):
    return rounded(M.grade_bets(bets(t), t.games).select("game_id", "kind", "selection", "result", "pnl"))


@query(
    "j9_settle_slips",
    f"""WITH {GRADED}, s AS (SELECT game_id // 4 AS slip, count(CASE WHEN result = 'lost' THEN 1 END) AS l, count(CASE WHEN result = 'open' THEN 1 END) AS o, count(CASE WHEN result = 'won' THEN 1 END) AS w, coalesce(product(CASE WHEN result = 'won' THEN CASE WHEN odds > 0 THEN 1 + odds / 100 ELSE 1 + 100 / abs(odds) END END), 1) AS p FROM gb GROUP BY 1)
 SELECT slip, CASE WHEN l > 0 THEN 'lost' WHEN o > 0 THEN 'open' WHEN w = 0 THEN 'push' ELSE 'won' END AS result, round(CASE WHEN l > 0 THEN -100 WHEN o > 0 OR w = 0 THEN 0 ELSE 100 * (p - 1) END, 4) AS pnl FROM s""",
)
def _(t):
    from ..functions.scalars import american_to_decimal

    g = M.grade_bets(bets(t), t.games)
    slips = g.groupBy(F.floor(F.col("game_id") / 4).alias("slip")).agg(F.sort_array(F.collect_list(F.struct("game_id", "result", american_to_decimal("odds").alias("price")))).alias("legs"), F.lit(100.0).alias("stake"))
    return M.settle_slips(slips).select("slip", "result", F.round("pnl", 4).alias("pnl"))


@query(
    "e16_ledger_stats",
    f"WITH {GRADED} SELECT sport, kind, CAST(grouping(sport, kind) AS BIGINT) AS level, count(*) AS bets, count(CASE WHEN result = 'won' THEN 1 END) AS won, count(CASE WHEN result = 'lost' THEN 1 END) AS lost, count(CASE WHEN result = 'push' THEN 1 END) AS push, round(sum(pnl), 4) AS pnl, sum(stake) AS staked, round(sum(pnl) / sum(stake), 6) AS roi FROM gb GROUP BY GROUPING SETS ((sport), (kind), ())",
)
def _(t):
    d = M.ledger_stats(M.grade_bets(bets(t), t.games))
    return d.withColumn("pnl", F.round("pnl", 4)).withColumn("roi", F.round("roi", 6))


@query("f13_bankroll", f"WITH {GRADED}, w AS (SELECT sport, game_id, 1000 + sum(pnl) OVER (PARTITION BY sport ORDER BY date, game_id) AS bal, date FROM gb), p AS (SELECT *, greatest(max(bal) OVER (PARTITION BY sport ORDER BY date, game_id), 1000) AS pk FROM w) SELECT sport, game_id, round(bal, 4) AS balance, round(pk, 4) AS peak, round((pk - bal) / pk, 5) AS drawdown FROM p")
def _(t):
    d = windows.bankroll(M.grade_bets(bets(t), t.games), 1000.0, "sport", ["date", "game_id"])
    # drawdowns are fractions of elevenths: exact ties, which sums of doubles leave just below
    return d.select("sport", "game_id", half_up("balance", 4).alias("balance"), half_up("peak", 4).alias("peak"), half_up(F.col("drawdown") + 1e-10, 5).alias("drawdown"))


@query(
    "j5_dynamic_thresholds",
    f"""WITH {GRADED}, r AS (SELECT sport, exp(-(row_number() OVER (PARTITION BY sport ORDER BY date DESC, game_id DESC) - 1) * ln(2) / 25) AS w, CASE result WHEN 'won' THEN 1.0 WHEN 'push' THEN 0.5 ELSE 0.0 END AS v FROM gb WHERE result <> 'open'), e AS (SELECT sport, sum(w * v) / sum(w) AS ema, count(*) AS n FROM r GROUP BY 1)
 SELECT sport, n, round(ema, 6) AS ema, round(0.55 + CASE WHEN n >= 10 AND abs(0.55 - ema) > 0.02 THEN greatest(least(0.55 - ema, 0.05), -0.05) ELSE 0 END, 6) AS threshold FROM e""",
)
def _(t):
    return rounded(M.dynamic_thresholds(M.grade_bets(bets(t), t.games).where("result <> 'open'")))


@query("d15_leaderboard", f"WITH {GRADED}, u AS (SELECT game_id % 17 AS user, 1000 + sum(pnl) - sum(CASE WHEN result = 'open' THEN stake ELSE 0 END) AS bal, sum(CASE WHEN result = 'open' THEN stake ELSE 0.0 END) AS exposure, count(*) AS bets FROM gb GROUP BY 1) SELECT \"user\", round(bal, 4) AS balance, exposure, bets, CAST(row_number() OVER (ORDER BY bal DESC, \"user\") AS INT) AS rank FROM u")
def _(t):
    d = M.leaderboard(M.grade_bets(bets(t), t.games).withColumn("user", F.col("game_id") % 17), "user")
    return d.withColumn("balance", F.round("balance", 4))


@query(
    "j11_opportunities",
    "WITH l AS (SELECT game_id, arg_max(sign(home_score - away_score), seq) AS m FROM live_snapshots GROUP BY 1), c AS (SELECT p.game_id, sport, greatest(least(greatest(home_win_prob, away_win_prob) + 0.1 * coalesce(m, 0), 0.95), 0.05) AS c FROM predictions p LEFT JOIN l ON p.game_id = l.game_id) SELECT game_id, sport, round(c, 6) AS confidence, CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.55 THEN 'medium' ELSE 'low' END AS tier FROM c ORDER BY round(c, 9) DESC, c.game_id LIMIT 50",
)
def _(t):
    p = t.predictions.withColumn("home_win_prob", F.round("home_win_prob", 9)).withColumn("away_win_prob", F.round("away_win_prob", 9))
    return rounded(M.opportunities(p, t.live_snapshots, 50).drop("grade"))


# ---------------------------------------------------------------- evaluation


@query("k2_accuracy_leaderboard", f"WITH {SCORED}, a AS (SELECT sport, count(*) AS evaluated, avg(correct) AS acc, avg({BRIER}) AS b, avg({LOGLOSS}) AS l FROM sc GROUP BY 1) SELECT sport, evaluated, round(acc, 6) AS accuracy, round(b, 6) AS brier, round(l, 6) AS log_loss, CAST(row_number() OVER (ORDER BY acc DESC, sport) AS INT) AS rank FROM a WHERE evaluated >= 20")
def _(t):
    return rounded(V.accuracy_leaderboard(t.predictions))


@query("k3_calibration", f"WITH {SCORED}, b AS (SELECT least(CAST(floor(home_win_prob * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(home_win_prob) AS p, avg(outcome) AS s FROM sc GROUP BY 1) SELECT r.i AS bin, coalesce(n, 0) AS n, round(p, 6) AS mean_prob, round(s, 6) AS share FROM range(10) r(i) LEFT JOIN b ON b.bin = r.i")
def _(t):
    return rounded(V.calibration(t.predictions))


@query("k3_calibration_summary", f"WITH {SCORED}, b AS (SELECT least(CAST(floor(home_win_prob * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(home_win_prob) AS p, avg(outcome) AS s FROM sc GROUP BY 1), e AS (SELECT sum(n * abs(p - s)) / sum(n) AS ece FROM b), m AS (SELECT count(*) AS n, avg({BRIER}) AS b, avg({LOGLOSS}) AS l FROM sc) SELECT n, round(b, 6) AS brier, round(l, 6) AS log_loss, round(ece, 6) AS ece FROM m, e")
def _(t):
    return rounded(V.calibration_summary(t.predictions))


@query("k4_calibration_trend", f"WITH {SCORED}, d AS (SELECT *, date_diff('day', date, DATE '1998-01-01') AS age FROM sc), b AS (SELECT (age - 1) // 30 AS bucket, count(*) AS n, avg(correct) AS a, avg({BRIER}) AS b FROM d WHERE age BETWEEN 1 AND 200 GROUP BY 1) SELECT r.i AS bucket, coalesce(n, 0) AS n, round(a, 6) AS accuracy, round(b, 6) AS brier FROM range(7) r(i) LEFT JOIN b ON b.bucket = r.i")
def _(t):
    return rounded(V.calibration_trend(t.predictions, "1998-01-01", 200, 30))


@query("k5_tier_table", f"WITH {SCORED}, d AS (SELECT {BAND} AS band, correct, CASE WHEN correct = 1 THEN 100 * (1 / confidence - 1) ELSE -100 END AS pnl FROM sc) SELECT band, count(*) AS n, round(avg(correct), 6) AS win_rate, round(sum(pnl), 3) AS pnl, round(sum(pnl) / (count(*) * 100), 6) AS roi FROM d GROUP BY 1")
def _(t):
    return rounded(V.tier_table(t.predictions).withColumn("pnl", F.round("pnl", 3)))


@query("k6_daily", f"WITH {SCORED} SELECT date, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg({BRIER}), 6) AS brier FROM sc GROUP BY 1")
def _(t):
    return rounded(V.daily(t.predictions))


_TYPES = {"home_win": "home_score > away_score", "over": "home_score + away_score > 180", "margin_3": "abs(home_score - away_score) <= 3", "margin_10": "abs(home_score - away_score) <= 10", "both_80": "home_score >= 80 AND away_score >= 80", "even_total": "(home_score + away_score) % 2 = 0", "home_100": "home_score >= 100", "away_100": "away_score >= 100"}


@query("k7_backtest", f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{n}' AS bet_type, count(*) AS n, round(avg(CASE WHEN ({c}) = (home_win_prob >= 0.5) THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(CASE WHEN {c} THEN 1 ELSE 0 END), 6) AS base_rate FROM sc" for n, c in _TYPES.items()))
def _(t):
    return rounded(V.backtest(t.predictions))


@query("k8_backtest_summary", f"WITH {SCORED}, d AS (SELECT *, {BAND} AS band FROM sc) SELECT sport, band, CAST(grouping(sport, band) AS BIGINT) AS level, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg({BRIER}), 6) AS brier FROM d GROUP BY GROUPING SETS ((sport), (band), ())")
def _(t):
    return rounded(V.backtest_summary(t.predictions))


@query("k9_completed_games", "SELECT game_id, date FROM games WHERE home_score IS NOT NULL AND away_score IS NOT NULL AND NOT (home_score = 0 AND away_score = 0)")
def _(t):
    return V.completed_games(t.games.unionByName(t.games)).select("game_id", "date")


@query("k10_drift", f"WITH {SCORED}, d AS (SELECT *, date_diff('day', date, DATE '1998-01-01') AS age FROM sc), a AS (SELECT sport, count(CASE WHEN age BETWEEN 1 AND 60 THEN 1 END) AS n_recent, count(CASE WHEN age BETWEEN 61 AND 240 THEN 1 END) AS n_base, avg(CASE WHEN age BETWEEN 1 AND 60 THEN correct END) AS r, avg(CASE WHEN age BETWEEN 61 AND 240 THEN correct END) AS b FROM d GROUP BY 1) SELECT sport, n_recent, n_base, round(r, 6) AS recent, round(b, 6) AS base, round(r - b, 6) AS gap, CASE WHEN n_recent < 5 OR n_base < 5 THEN 'too_few' WHEN r - b < -0.02 THEN 'worse' WHEN r - b > 0.02 THEN 'better' ELSE 'stable' END AS state FROM a")
def _(t):
    return rounded(V.drift(t.predictions, "1998-01-01", 60, 180, 5))


@query("k11_health", f"WITH {SCORED}, l AS (SELECT sport, max(date) AS last, count(CASE WHEN date = DATE '1998-07-01' THEN 1 END) AS today FROM predictions GROUP BY 1), a AS (SELECT sport, avg(correct) AS accuracy FROM sc GROUP BY 1) SELECT l.sport, last, today, round(accuracy, 6) AS accuracy, CASE WHEN date_diff('day', last, DATE '1998-07-01') * 24 > 48 THEN 'stale' WHEN accuracy < 0.52 THEN 'poor' WHEN today = 0 THEN 'idle' ELSE 'healthy' END AS state FROM l LEFT JOIN a ON l.sport = a.sport")
def _(t):
    return rounded(V.health(t.predictions, "1998-07-01"))


@query("k12_live_gap", f"WITH {SCORED}, b AS (SELECT sport, avg(correct) AS b FROM sc WHERE date < DATE '1996-01-01' GROUP BY 1), v AS (SELECT sport, avg(correct) AS v, count(*) AS n FROM sc WHERE date >= DATE '1996-01-01' GROUP BY 1) SELECT b.sport, round(b, 6) AS backtest, round(v, 6) AS live, n, round(b - v, 6) AS gap, round(greatest(b - v, 0) * sqrt(n), 6) AS priority FROM b JOIN v ON b.sport = v.sport")
def _(t):
    p = t.predictions
    return rounded(V.live_gap(p.where("date < DATE'1996-01-01'"), p.where("date >= DATE'1996-01-01'")))


# ---------------------------------------------------------------- quality


@query("l1_fill_rates", "SELECT 'game_id' AS \"column\", count(game_id) AS filled, count(*) AS rows, round(count(game_id) / count(*), 6) AS rate FROM games UNION ALL SELECT 'home_score', count(home_score), count(*), round(count(home_score) / count(*), 6) FROM games UNION ALL SELECT 'status', count(status), count(*), round(count(status) / count(*), 6) FROM games")
def _(t):
    return rounded(Q.fill_rates(t.games.select("game_id", "home_score", "status")))


@query("l2_game_checks", "SELECT sport, count(*) AS rows, count(*) - count(DISTINCT game_id) AS repeated, min(date) AS first, max(date) AS last, count(CASE WHEN home_score < 0 OR away_score < 0 THEN 1 END) AS negative, count(CASE WHEN home_score > CASE sport WHEN 'BUILDING' THEN 120 WHEN 'MACHINERY' THEN 100 ELSE 1e9 END OR away_score > CASE sport WHEN 'BUILDING' THEN 120 WHEN 'MACHINERY' THEN 100 ELSE 1e9 END THEN 1 END) AS too_high FROM games GROUP BY 1")
def _(t):
    return Q.game_checks(t.games, {"BUILDING": 120.0, "MACHINERY": 100.0})


@query("l3_negative_share", "SELECT 'spread_home' AS stat, round(avg(CASE WHEN spread_home < 0 THEN 1.0 ELSE 0 END), 6) AS share, false AS flag FROM odds UNION ALL SELECT 'h2h_home', round(avg(CASE WHEN h2h_home < 0 THEN 1.0 ELSE 0 END), 6), true FROM odds")
def _(t):
    return rounded(Q.negative_share(t.odds, ["spread_home", "h2h_home"], ("spread_home",)))


@query("l5_feature_audit", "WITH m AS (SELECT mode(season) AS s, mode(home_team_id) AS h FROM games) SELECT 'season' AS feature, 0.0 AS missing, count(DISTINCT season) AS n_distinct, false AS leaky FROM games UNION ALL SELECT 'home_score', round(avg(CASE WHEN home_score IS NULL THEN 1.0 ELSE 0 END), 6), count(DISTINCT home_score), true FROM games")
def _(t):
    return rounded(Q.feature_audit(t.games, ["season", "home_score"], "home_score").select("feature", "missing", "n_distinct", "leaky"))


@query("l6_feature_ranking", "SELECT 'reb' AS feature, round(var_samp(reb), 6) AS variance, round(avg(CASE WHEN reb <> 0 THEN 1.0 ELSE 0 END), 6) AS nonzero, round(abs(corr(reb, pts)), 6) AS corr FROM player_stats UNION ALL SELECT 'ast', round(var_samp(ast), 6), round(avg(CASE WHEN ast <> 0 THEN 1.0 ELSE 0 END), 6), round(abs(corr(ast, pts)), 6) FROM player_stats")
def _(t):
    return rounded(Q.feature_ranking(t.player_stats, ["reb", "ast"], "pts"))


@query("l8_vendor_coverage", "WITH s AS (SELECT DISTINCT lang AS sport FROM documents), e AS (SELECT * FROM (VALUES ('src0'), ('src1'), ('srcX')) v(provider)) SELECT s.sport, e.provider, count(d.doc_id) AS hits, CASE WHEN count(d.doc_id) > 0 THEN 'present' ELSE 'missing' END AS status FROM s CROSS JOIN e LEFT JOIN documents d ON d.lang = s.sport AND d.source = e.provider GROUP BY 1, 2")
def _(t):
    return Q.vendor_coverage(t.base("documents").select("lang", "source"), "source", "lang", ["src0", "src1", "srcX"])


@query("l10_coverage_matrix", "SELECT sport, " + ", ".join(f"count(CASE WHEN season = {y} THEN 1 END) AS \"{y}\"" for y in range(1995, 2002)) + " FROM games GROUP BY 1")
def _(t):
    return Q.coverage_matrix(t.games, "sport", "season", list(range(1995, 2002)))


@query(
    "l11_blend",
    """WITH r AS (SELECT game_id, source, max(pts) AS pts, max(CASE WHEN reb > 3 THEN reb END) AS reb FROM player_stats GROUP BY 1, 2)
 SELECT game_id, coalesce(max(CASE WHEN source = 'b' THEN pts END), max(CASE WHEN source = 'a' THEN pts END)) AS pts, CASE WHEN max(CASE WHEN source = 'b' THEN pts END) IS NOT NULL THEN 'b' ELSE 'a' END AS pts_from,
  coalesce(max(CASE WHEN source = 'a' THEN reb END), max(CASE WHEN source = 'b' THEN reb END)) AS reb, CASE WHEN max(CASE WHEN source = 'a' THEN reb END) IS NOT NULL THEN 'a' WHEN max(CASE WHEN source = 'b' THEN reb END) IS NOT NULL THEN 'b' END AS reb_from FROM r GROUP BY 1""",
)
def _(t):
    r = t.player_stats.groupBy("game_id", "source").agg(F.max("pts").alias("pts"), F.max(F.when(F.col("reb") > 3, F.col("reb"))).alias("reb"))
    return Q.blend(r, "game_id", "source", ["pts", "reb"], {"pts": ["b", "a"], "*": ["a", "b"]})


# ---------------------------------------------------------------- live and models


@query("m4_latest_live", "SELECT game_id, arg_max(status, (snapshot_time, seq)) AS status, arg_max(home_score, (snapshot_time, seq)) AS home_score, arg_max(away_score, (snapshot_time, seq)) AS away_score, max(snapshot_time) AS snapshot_time FROM live_snapshots GROUP BY 1")
def _(t):
    return live.latest(t.live_snapshots)


@query(
    "m2_changes",
    "WITH d AS (SELECT game_id, seq, status, home_score, away_score, row(status, home_score, away_score) AS r, lag(row(status, home_score, away_score)) OVER (PARTITION BY game_id ORDER BY snapshot_time, seq) AS p FROM live_snapshots) SELECT game_id, seq, status, home_score, away_score FROM d WHERE p IS NULL OR r <> p",
)
def _(t):
    return live.changes(t.live_snapshots)


@query(
    "m6_win_probability",
    "WITH l AS (SELECT game_id, seq, home_score - away_score AS m, least((period - 1) / 4.0 + 0.125, 1) AS e FROM live_snapshots), p AS (SELECT l.*, ln(home_win_prob / (1 - home_win_prob)) AS z FROM l JOIN predictions p ON l.game_id = p.game_id) SELECT game_id, seq, round(1 / (1 + exp(-(z * (1 - e) + m * 0.08 / sqrt(1 - e + 0.02)))), 6) AS home_win_prob FROM p",
)
def _(t):
    return rounded(live.win_probability(t.live_snapshots, t.predictions, "basketball").select("game_id", "seq", "home_win_prob"))


@query("m7_projection", "SELECT game_id, seq, round(home_score / least((period - 1) / 4.0 + 0.125, 1), 6) AS home_final, round(away_score / least((period - 1) / 4.0 + 0.125, 1), 6) AS away_final FROM live_snapshots")
def _(t):
    return rounded(live.projection(t.live_snapshots).select("game_id", "seq", "home_final", "away_final"))


@query("m8_play_series", "SELECT game_id, seq, CAST(row_number() OVER (PARTITION BY game_id ORDER BY snapshot_time, seq) - 1 AS INT) AS play FROM live_snapshots")
def _(t):
    return live.play_series(t.live_snapshots)


@query("m9_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, snapshot_time) AS start, status, count(*) AS n, CAST(sum(home_score) AS BIGINT) AS total FROM live_snapshots GROUP BY 1, 2")
def _(t):
    return live.tumbling(t.live_snapshots, "1 hour")


@query(
    "n1_feature_matrix",
    f"""WITH {PAST}, f AS (SELECT game_id, is_home, coalesce(avg(CASE WHEN k <= 10 THEN win END), 0) AS w, coalesce(avg(CASE WHEN k <= 10 THEN pf - pa END), 0) AS m, coalesce(avg(CASE WHEN k <= 10 THEN pf END), 0) AS p, coalesce(date_diff('day', max(pdate), date), 7) AS rest, count(CASE WHEN pdate >= date - INTERVAL 7 DAY THEN 1 END) AS g7 FROM past GROUP BY game_id, is_home, team_id, date)
 SELECT g.game_id, round(h.w - a.w, 6) + 0.0 AS delta_form_win_pct, round(h.m - a.m, 6) + 0.0 AS delta_form_margin, round(h.p - a.p, 6) + 0.0 AS delta_form_ppg, CAST(h.rest - a.rest AS INT) AS delta_rest_days, CAST(h.g7 - a.g7 AS BIGINT) AS delta_games_7d, CASE WHEN home_score > away_score THEN 1.0 ELSE 0.0 END AS label
 FROM games g JOIN f h ON h.game_id = g.game_id AND h.is_home JOIN f a ON a.game_id = g.game_id AND NOT a.is_home WHERE home_score <> away_score""",
)
def _(t):
    return rounded(models.feature_matrix(t.games).select("game_id", *models.FEATURES, "label"))


@query("n2_temporal_split", "WITH d AS (SELECT game_id, percent_rank() OVER (ORDER BY date, game_id) AS r FROM games WHERE home_score IS NOT NULL) SELECT game_id, r >= 0.8 AS test FROM d")
def _(t):
    return models.temporal_split(t.games.where("home_score IS NOT NULL"), 0.2).select("game_id", "test")


@query("n3_walk_forward", "SELECT game_id, CAST(ntile(6) OVER (ORDER BY date, game_id) AS INT) AS fold FROM games WHERE home_score IS NOT NULL")
def _(t):
    return models.walk_forward(t.games.where("home_score IS NOT NULL"), 6).select("game_id", "fold")


@query("n7_market_labels", "SELECT game_id, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS home_win, CASE WHEN home_score + away_score > 180 THEN 1 ELSE 0 END AS over, CASE WHEN abs(home_score - away_score) <= 10 THEN 1 ELSE 0 END AS close FROM games WHERE home_score IS NOT NULL")
def _(t):
    return models.market_labels(t.games)
