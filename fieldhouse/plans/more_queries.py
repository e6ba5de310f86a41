"""The remaining table operators as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, games as G, market as M, more, quality as Q, windows
from .evaluation_queries import CANDS
from .registry import query
from .table_queries import rounded


@query("c5_drives", "SELECT l_orderkey AS game_id, l_linenumber AS seq FROM lineitem WHERE (l_suppkey = 3 OR l_partkey % 100 = 3) AND l_returnflag = 'R'")
def _(t):
    p = t.base("lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("offence"), (F.col("l_partkey") % 100).alias("defence"), (F.col("l_returnflag") == "R").alias("scoring"))
    return more.drives(p, 3, True).select("game_id", "seq")


@query("c7_nested_filter", "SELECT CASE c_nationkey % 3 WHEN 0 THEN 'minor' WHEN 1 THEN 'major' ELSE 'severe' END AS severity, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def _(t):
    s = F.when(F.col("c_nationkey") % 3 == 0, "minor").when(F.col("c_nationkey") % 3 == 1, "major").otherwise("severe")
    return more.severity_counts(t.base("customer").select(F.struct(F.col("c_mktsegment").alias("area"), s.alias("severity")).alias("detail")), "detail.area", "BUILDING")


@query("c8_sorted", "SELECT game_id, home_score FROM games ORDER BY home_score DESC NULLS FIRST, game_id LIMIT 40")
def _(t):
    return filters.ordered(t.games.select("game_id", "home_score"), "-home_score", "game_id").limit(40)


@query("c13_columns_there", "SELECT game_id, season FROM games")
def _(t):
    return filters.pick_columns(t.games, ["game_id", "venue", "season", "weather"])


@query("d3_officials", "SELECT g.game_id, p.l_suppkey AS official FROM games g LEFT JOIN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A') p ON g.game_id = p.l_orderkey")
def _(t):
    p = t.base("lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_suppkey").alias("person"), F.when(F.col("l_returnflag") == "A", "official").otherwise("coach").alias("role"))
    return more.game_people(t.games.select("game_id"), p, "official")


@query("d6_lineups", "SELECT p.game_id, p.player_id, p.seq, g.date, g.sport, CASE WHEN p.team_id = g.home_team_id THEN 'home' ELSE 'away' END AS side FROM player_stats p JOIN games g ON p.game_id = g.game_id")
def _(t):
    return more.lineups(t.player_stats, t.games).select("game_id", "player_id", "seq", "date", "sport", "side")


@query("d10_fill_ids", "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS team_id FROM customer")
def _(t):
    c = t.base("customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).alias("team_id"))
    known = t.base("customer").select("c_name", F.col("c_custkey").alias("team_id"))
    return G.fill_ids(c, known, "c_name", "team_id").select("c_custkey", "team_id")


@query(
    "d13_sharp_signals",
    """WITH m AS (SELECT game_id, bookmaker, arg_max(total_line, (ts, seq, tie)) - arg_min(total_line, (ts, seq, tie)) AS move FROM odds GROUP BY 1, 2), s AS (SELECT game_id, move FROM m QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY bookmaker) = 1),
 t AS (SELECT game_id, home_win_prob AS lean FROM predictions WHERE game_id % 3 = 0) SELECT coalesce(t.game_id, s.game_id) AS game_id, round(lean, 6) AS lean, move FROM t FULL JOIN s ON t.game_id = s.game_id""",
)
def _(t):
    trends = t.predictions.where("game_id % 3 = 0").select("game_id", F.col("home_win_prob").alias("lean"))
    return rounded(more.sharp_signals(trends, windows.line_movement(t.odds, "total_line")).select("game_id", "lean", "move"))


@query("d14_joined_opportunities", "WITH l AS (SELECT game_id, arg_max(home_score, (snapshot_time, seq)) AS live_home, arg_max(away_score, (snapshot_time, seq)) AS live_away FROM live_snapshots GROUP BY 1) SELECT p.game_id, round(home_win_prob, 6) AS home_win_prob, status AS game_status, live_home, live_away FROM predictions p LEFT JOIN games g ON p.game_id = g.game_id LEFT JOIN l ON p.game_id = l.game_id")
def _(t):
    from ..streaming.live import latest

    return rounded(more.opportunities_joined(t.predictions, t.games, latest(t.live_snapshots)))


@query("e2_guarded_rates", "SELECT season, team_id, count(DISTINCT game_id) AS games, round(sum(pts) / count(DISTINCT game_id), 6) AS total_pts_per_game, round(sum(ast) / count(DISTINCT game_id), 6) AS total_ast_per_game FROM player_stats GROUP BY 1, 2")
def _(t):
    d = more.guarded_rates(G.team_from_players(t.player_stats, ["pts", "ast"]), ["total_pts", "total_ast"])
    return rounded(d.select("season", "team_id", "games", "total_pts_per_game", "total_ast_per_game"))


@query("e7_canonical_names", "SELECT lower(trim(c_name)) AS key, c_name AS name, CAST(2 AS BIGINT) AS spellings FROM customer")
def _(t):
    c = t.base("customer").select("c_name")
    return G.canonical_names(c.unionByName(c.select(F.upper("c_name").alias("c_name"))), "c_name")


@query("e18_market_catalog", "WITH m AS (SELECT sport, 'winner' AS kind, home_win_prob AS p FROM predictions UNION ALL SELECT sport, 'upset', away_win_prob FROM predictions) SELECT sport, kind, count(*) AS n, count(CASE WHEN p >= 0.7 THEN 1 END) AS high, count(CASE WHEN p >= 0.55 AND p < 0.7 THEN 1 END) AS medium, count(CASE WHEN p < 0.55 THEN 1 END) AS low FROM m GROUP BY 1, 2")
def _(t):
    from ..functions.scalars import tier

    m = F.array(*(F.struct(F.lit(k).alias("kind"), tier(c).alias("tier")) for k, c in (("winner", "home_win_prob"), ("upset", "away_win_prob"))))
    return more.market_catalog(t.predictions.select("sport", m.alias("markets")))


@query("f6_top_n", "SELECT player_id, game_id, seq, pts FROM player_stats ORDER BY pts DESC, game_id, seq LIMIT 20")
def _(t):
    return t.player_stats.select("player_id", "game_id", "seq", "pts").orderBy(F.desc("pts"), "game_id", "seq").limit(20)


@query("g2_cross_sport", "SELECT sport, game_id, date FROM games WHERE sport IN ('BUILDING', 'MACHINERY') QUALIFY row_number() OVER (PARTITION BY sport ORDER BY date DESC, game_id) <= 30")
def _(t):
    of = lambda s: t.games.where(F.col("sport") == s).drop("sport")
    return more.cross_sport({"BUILDING": of("BUILDING"), "MACHINERY": of("MACHINERY").drop("season")}, ["game_id", "date"], 30)


@query("g5_distinct", "SELECT DISTINCT sport, season, status FROM games")
def _(t):
    return t.games.select("sport", "season", "status").dropDuplicates()


@query("j2_open_close", "SELECT game_id, bookmaker, arg_min(h2h_home, (ts, seq, tie)) AS open, arg_max(h2h_home, (ts, seq, tie)) AS close FROM odds GROUP BY 1, 2")
def _(t):
    return windows.line_movement(t.odds, "h2h_home").select("game_id", "bookmaker", "open", "close")


@query(
    "j7_ladder",
    f"""WITH {CANDS}, s AS (SELECT * FROM c WHERE prob >= 0.6),
 p AS (SELECT a.date, a.price * b.price AS price, round(a.prob * b.prob * 0.97 * (a.price * b.price - 1) - (1 - a.prob * b.prob * 0.97), 9) AS ev, a.game_id AS g1, a.selection AS s1, b.game_id AS g2, b.selection AS s2 FROM s a JOIN s b ON a.date = b.date AND a.game_id < b.game_id WHERE a.price * b.price >= 3)
 SELECT 'double' AS step, date, round(price, 6) AS price, round(ev, 6) AS ev FROM p WHERE ev >= 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY ev DESC, g1, s1, g2, s2) = 1""",
)
def _(t):
    return rounded(more.ladder(M.candidates(t.predictions, t.odds), [("double", 2, 0.6, 3.0)]).drop("games"))


@query("k1_evaluable", "SELECT game_id, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS outcome, CASE WHEN (home_win_prob >= 0.5) = (home_score > away_score) THEN 1 ELSE 0 END AS correct FROM predictions WHERE home_score <> away_score AND home_win_prob BETWEEN 0 AND 1")
def _(t):
    from ..operators.evaluation import scored

    return scored(t.predictions).select("game_id", "outcome", "correct")


@query("l4_referential", "SELECT 'home' AS side, count(CASE WHEN home_team_id NOT IN (SELECT team_id FROM teams) THEN 1 END) AS orphans FROM games UNION ALL SELECT 'away', count(CASE WHEN away_team_id NOT IN (SELECT team_id FROM teams) THEN 1 END) FROM games")
def _(t):
    n = G.orphans(t.games, t.teams).groupBy("is_home").agg(F.count("*").alias("n"))
    sides = t.games.select(F.explode(F.array(F.lit(True), F.lit(False))).alias("is_home")).distinct()
    return sides.join(n, "is_home", "left").select(F.when(F.col("is_home"), "home").otherwise("away").alias("side"), F.coalesce("n", F.lit(0)).alias("orphans"))


@query("l9_registry_problems", "SELECT 'repeated' AS problem, 'x/*' AS key WHERE false UNION ALL SELECT 'unknown provider', lang || '/*' FROM documents WHERE source = 'src0' GROUP BY lang, source")
def _(t):
    r = t.base("documents").select(F.col("lang").alias("kind"), F.lit("*").alias("field"), F.col("source").alias("provider")).where("provider = 'src0'").distinct()
    return Q.registry_problems(r, ["kind", "field"], ["src1"])
