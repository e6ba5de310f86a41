"""Scans, filters, joins, rollups, windows and set operations as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters, games as G, windows
from ..sources import readers, writers
from .registry import query

TG = """tg AS (
 SELECT game_id, sport, date, season, status, home_team_id AS team_id, away_team_id AS opp_id, true AS is_home, home_score AS pf, away_score AS pa,
  lower(status) LIKE '%final%' OR (home_score IS NOT NULL AND away_score IS NOT NULL) AS completed FROM games
 UNION ALL
 SELECT game_id, sport, date, season, status, away_team_id, home_team_id, false, away_score, home_score,
  lower(status) LIKE '%final%' OR (home_score IS NOT NULL AND away_score IS NOT NULL) FROM games)"""
LATEST = "latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY game_id, bookmaker ORDER BY ts DESC, seq DESC, tie DESC) AS rn FROM odds) WHERE rn = 1)"


def half_up(x, places: int):
    """The scaled double rounded half away from zero; ``F.round`` rounds the decimal text of the double, which ties differently."""
    x, k = F.col(x) if isinstance(x, str) else x, 10.0**places
    scaled = F.signum(x) * F.floor(F.abs(x) * k + 0.5) / k
    return F.when(F.abs(x) < 1e9, scaled).otherwise(F.round(x, places)) + 0.0  # floor gives a long


def rounded(df, places: int = 6):
    """Doubles rounded, so that the order of sums does not show."""
    return df.select(*((half_up(c, places)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---------------------------------------------------------------- scans


@query("a2_load_season", "SELECT game_id, date, home_score FROM games WHERE season = 1996 AND status = 'final'")
def _(t):
    return t.games.where("season = 1996 AND status = 'final'").select("game_id", "date", "home_score")


@query("a3_current_season", "SELECT game_id, season FROM games WHERE season = (SELECT max(season) FROM games WHERE home_score IS NOT NULL)")
def _(t):
    return readers.in_season(t.games, None).select("game_id", "season")


@query("a5_seasons", "SELECT DISTINCT season FROM games")
def _(t):
    return readers.seasons(t.games)


@query("a6_inventory")
def _(t):
    return readers.inventory(t.base("orders"), ["o_orderstatus"])


@query("a4_lineage")
def _(t):
    return readers.with_lineage(t.base("orders")).groupBy("raw_category").count()


@query(
    "a18_weather_blend",
    """WITH a AS (SELECT o_orderkey AS game_id, CAST(o_custkey % 30 AS DOUBLE) AS lo, CAST(o_custkey % 30 + 12 AS DOUBLE) AS hi, CAST(o_orderkey % 360 AS DOUBLE) AS deg, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 25 AS DOUBLE) END AS ws FROM orders)
 SELECT game_id, (lo + hi) / 2 AS temperature, coalesce(ws, CAST(game_id % 7 AS DOUBLE)) AS wind_speed,
  (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[CAST(floor((deg + 11.25) / 22.5) AS INT) % 16 + 1] AS wind FROM a""",
)
def _(t):
    o = t.base("orders")
    a = o.select(F.col("o_orderkey").alias("game_id"), (F.col("o_custkey") % 30).cast("double").alias("temp_min"), (F.col("o_custkey") % 30 + 12).cast("double").alias("temp_max"), F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 25).cast("double")).alias("wind_speed"), (F.col("o_orderkey") % 360).cast("double").alias("wind_degrees"))
    b = o.select(F.col("o_orderkey").alias("game_id"), F.lit(0.0).alias("temperature"), (F.col("o_orderkey") % 7).cast("double").alias("wind_speed"), F.lit("N").alias("wind"))
    return readers.weather_blend(a, b)


@query("a22_first_fetched", "SELECT player_id, game_id, seq, pts FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_id, seq, pts) AS r FROM player_stats) WHERE r = 1")
def _(t):
    d = t.player_stats.withColumn("_o", F.struct("game_id", "seq", "pts"))
    return readers.first_fetched(d, "player_id", "_o").select("player_id", "game_id", "seq", "pts")


@query("a21_bookmaker_lines", f"WITH {LATEST} SELECT game_id, CAST(bookmaker AS VARCHAR) AS bookmaker, h2h_home, h2h_away, spread_home, total_line FROM latest")
def _(t):
    o = G.latest_odds(t.odds)
    outcome = lambda n, p, x: F.struct(F.lit(n).alias("name"), F.col(p).cast("double").alias("price") if p else F.lit(None).cast("double").alias("price"), F.col(x).cast("double").alias("point") if x else F.lit(None).cast("double").alias("point"))
    market = lambda k, *o: F.struct(F.lit(k).alias("key"), F.array(*o).alias("outcomes"))
    markets = F.array(market("h2h", outcome("home", "h2h_home", None), outcome("away", "h2h_away", None)), market("spreads", outcome("home", None, "spread_home")), market("totals", outcome("over", None, "total_line")))
    book = F.struct(F.col("bookmaker").cast("string").alias("key"), F.col("ts").cast("string").alias("last_update"), markets.alias("markets"))
    nested = o.groupBy(F.col("game_id").cast("string").alias("id")).agg(F.collect_list(book).alias("bookmakers"))
    landed = nested.select(F.to_json(F.struct("id", "bookmakers")).alias("j")).select(F.from_json("j", readers.MARKETS).alias("x")).select("x.*")
    lines = readers.freshest_lines(readers.bookmaker_props(landed))
    return lines.select(F.col("game_id").cast("long").alias("game_id"), "bookmaker", "h2h_home", "h2h_away", "spread_home", "total_line")


@query("a7_box_score_players", "SELECT game_id, player_id, pts, minutes FROM (SELECT game_id, player_id, seq, CAST(floor(pts) AS INT) AS pts, CAST(floor(minutes) AS DOUBLE) AS minutes FROM player_stats)")
def _(t):
    stats = F.struct(F.concat(F.lit("PT"), F.floor("minutes").cast("string"), F.lit("M00.00S")).alias("minutes"), F.floor("pts").cast("int").alias("points"), F.lit(0).alias("rebounds"), F.lit(0).alias("assists"))
    player = F.struct(F.col("player_id").alias("personId"), F.lit("x").alias("name"), F.lit("G").alias("position"), stats.alias("statistics"))
    home = F.col("seq") % 2 == 0
    side = lambda c: F.struct(F.min(F.when(c, F.col("team_id"))).alias("teamId"), F.array_compact(F.collect_list(F.when(c, player))).alias("players"))
    d = t.player_stats.groupBy("game_id").agg(side(home).alias("homeTeam"), side(~home).alias("awayTeam"))
    landed = d.select(F.to_json(F.struct(F.struct(F.col("game_id").cast("string").alias("gameId"), F.lit("").alias("gameEt"), "homeTeam", "awayTeam").alias("game"))).alias("j"))
    rows = readers.box_score_players(landed.select(F.from_json("j", readers.BOX).alias("x")).select("x.*"))
    return rows.select(F.col("game_id").cast("long").alias("game_id"), "player_id", "pts", "minutes")


# ---------------------------------------------------------------- sinks


@query("b7_merge_keep_last", "SELECT game_id, player_id, seq, pts FROM (SELECT *, row_number() OVER (PARTITION BY game_id, player_id ORDER BY seq DESC) AS r FROM player_stats) WHERE r = 1")
def _(t):
    return writers.merge_last(t.player_stats, ["game_id", "player_id"], "seq").select("game_id", "player_id", "seq", "pts")


@query("b8_consolidate", "SELECT game_id, 'old' AS v FROM games WHERE season <= 1996 AND season < 1995 UNION ALL SELECT game_id, 'new' AS v FROM games WHERE season >= 1995")
def _(t):
    old = t.games.where("season <= 1996").select("game_id", F.lit("old").alias("v"))
    return writers.consolidate(old, t.games.where("season >= 1995").select("game_id", F.lit("new").alias("v")), ["game_id"])


@query("b4_write_if_absent", "SELECT game_id, season FROM games WHERE season NOT IN (SELECT season FROM games WHERE status = 'scheduled' AND season % 2 = 0)")
def _(t):
    return writers.absent(t.games.select("game_id", "season"), t.games.where("status = 'scheduled' AND season % 2 = 0"), ["season"])


@query("b3_routing", "SELECT sport, CASE sport WHEN 'BUILDING' THEN 'courts' WHEN 'MACHINERY' THEN 'rinks' ELSE sport END AS category, count(*) AS n FROM games GROUP BY 1, 2")
def _(t):
    routing = t.spark.sql("SELECT * FROM VALUES ('BUILDING', 'courts'), ('MACHINERY', 'rinks') AS r(kind, category)")
    return writers.route(t.games, routing, "sport").groupBy("sport", "category").agg(F.count("*").alias("n"))


@query("b9_fingerprint_changes", "SELECT sport, CASE WHEN sport = 'BUILDING' THEN 'changed' ELSE 'unchanged' END AS state FROM games GROUP BY sport")
def _(t):
    from ..operators.quality import changed, fingerprints

    new = t.games.withColumn("home_score", F.when(F.col("sport") == "BUILDING", F.col("home_score") + 1).otherwise(F.col("home_score")))
    return changed(fingerprints(t.games, ["sport"]), fingerprints(new, ["sport"]), ["sport"])


# ---------------------------------------------------------------- filters


@query("c1_on_date", "SELECT game_id FROM games WHERE CAST(date AS VARCHAR) LIKE '1995-03%'")
def _(t):
    return filters.on_date(t.games, "1995-03").select("game_id")


@query("c2_date_range", "SELECT game_id FROM games WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-06-30'")
def _(t):
    return filters.between_dates(t.games, "1995-01-01", "1995-06-30").select("game_id")


@query("c3_of_team", "SELECT team_id, name FROM teams WHERE lower(name) LIKE '%00001%' OR CAST(team_id AS VARCHAR) = '00001'")
def _(t):
    return filters.of_team(t.teams, "00001", ["name"], ["team_id"]).select("team_id", "name")


@query("c4_filter_eq", "SELECT game_id FROM games WHERE sport = 'BUILDING' AND season = 1995")
def _(t):
    return filters.filter_eq(t.games, sport="BUILDING", season=1995, nothing="x", status=None).select("game_id")


@query("c6_open_closed", "SELECT sport, CAST(sum(CASE WHEN status = 'final' THEN 1 ELSE 0 END) AS BIGINT) AS closed, CAST(sum(CASE WHEN status = 'final' THEN 0 ELSE 1 END) AS BIGINT) AS open FROM games GROUP BY sport")
def _(t):
    return t.games.groupBy("sport").agg(F.count_if(filters.is_closed()).alias("closed"), F.count_if(filters.is_open()).alias("open"))


@query("c9_page", "SELECT game_id, date FROM games ORDER BY date DESC, game_id LIMIT 50 OFFSET 100")
def _(t):
    return filters.page(filters.ordered(t.games.select("game_id", "date"), "-date", "game_id"), 50, 100)


@query("c10_current_week", "WITH w AS (SELECT sport, game_id, CAST(weekofyear(date) AS INT) AS week FROM games) SELECT sport, game_id, week FROM w QUALIFY week = max(week) OVER (PARTITION BY sport)")
def _(t):
    d = t.games.select("sport", "game_id", F.weekofyear("date").alias("week"))
    return filters.newest(d, "week", ["sport"])


@query("c11_upcoming", "SELECT game_id, date FROM games WHERE status <> 'final' AND date >= DATE '1997-01-01' AND date < DATE '1997-01-15'")
def _(t):
    return filters.upcoming(t.games, "1997-01-01", 14).select("game_id", "date")


@query("c12_live_window", "SELECT seq, game_id FROM live_snapshots WHERE snapshot_time >= (SELECT min(snapshot_time) FROM live_snapshots) AND snapshot_time BETWEEN TIMESTAMP '2024-01-10 07:00:00' AND TIMESTAMP '2024-01-10 14:00:00'")
def _(t):
    return filters.in_window(t.live_snapshots, "snapshot_time", "2024-01-10 12:00:00", 300, 120).select("seq", "game_id")


@query("c14_scrub", "SELECT game_id, CASE WHEN home_score <> 70 THEN home_score END AS x FROM games")
def _(t):
    x = F.when(F.col("home_score") == 70, F.lit(float("nan"))).otherwise(F.col("home_score"))
    return filters.scrub(t.games.select("game_id", x.alias("x")))


# ---------------------------------------------------------------- joins


@query("d1_game_core", "SELECT g.*, h.name AS home_name, h.conference AS home_conference, a.name AS away_name, a.conference AS away_conference FROM games g LEFT JOIN teams h ON g.home_team_id = h.team_id LEFT JOIN teams a ON g.away_team_id = a.team_id")
def _(t):
    return G.game_core(t.games, t.teams)


@query("d2_ml_dataset", "WITH s AS (SELECT game_id, count(*) AS n, sum(pts) AS pts FROM player_stats GROUP BY game_id) SELECT g.game_id, g.season, s.n, s.pts FROM games g LEFT JOIN s ON g.game_id = s.game_id")
def _(t):
    s = t.player_stats.groupBy("game_id").agg(F.count("*").alias("n"), F.sum("pts").alias("pts"))
    return G.with_stats(t.games.select("game_id", "season"), s)


@query("d4_daily_snapshot", f"WITH {LATEST} SELECT g.game_id, l.bookmaker, l.h2h_home, coalesce(CAST(l.ts AS DATE), g.date) AS snapshot_date FROM games g LEFT JOIN latest l ON g.game_id = l.game_id")
def _(t):
    return G.daily_snapshot(t.games, t.odds).select("game_id", "bookmaker", "h2h_home", "snapshot_date")


@query("d5_backfill_names", "SELECT team_id, name FROM teams")
def _(t):
    blank = t.teams.select("team_id", F.when(F.col("team_id") % 3 == 0, F.lit(" ")).when(F.col("team_id") % 3 == 1, F.col("name")).alias("name"))
    return G.backfill_names(blank, t.teams).select("team_id", "name")


@query(
    "d7_match_odds",
    """WITH o AS (SELECT game_id, date, home_team_id, away_team_id, CAST(game_id % 100 AS DOUBLE) AS line FROM games),
 d AS (SELECT g.game_id, o.line, 'id' AS matched_by FROM games g JOIN o ON g.game_id = o.game_id WHERE o.game_id % 2 = 0),
 k AS (SELECT date, home_team_id, away_team_id, line, row_number() OVER (PARTITION BY date, home_team_id, away_team_id ORDER BY line) AS r, count(*) OVER (PARTITION BY date, home_team_id, away_team_id) AS n FROM o)
 SELECT * FROM d UNION ALL SELECT g.game_id, k.line, 'keys' FROM games g JOIN k ON g.date = k.date AND g.home_team_id = k.home_team_id AND g.away_team_id = k.away_team_id WHERE g.game_id % 2 = 1 AND k.r = 1""",
)
def _(t):
    keys = ["date", "home_team_id", "away_team_id"]
    o = t.games.select(F.when(F.col("game_id") % 2 == 0, F.col("game_id")).alias("game_id"), *keys, (F.col("game_id") % 100).cast("double").alias("line"))
    o = o.withColumn("line", F.when(F.col("game_id").isNull(), F.col("line")).otherwise(F.col("line")))
    low = o.groupBy(*keys).agg(F.min("line").alias("low"))
    o = o.join(low, keys).select("game_id", *keys, F.when(F.col("game_id").isNotNull(), F.col("line")).otherwise(F.col("low")).alias("line"), "low")
    direct = o.where("game_id IS NOT NULL").select("game_id", *keys, "line")
    natural = o.select(F.lit(None).cast("long").alias("game_id"), *keys, F.col("low").alias("line")).distinct()
    return G.match_odds(t.games.select("game_id", *keys), direct.unionByName(natural), keys).select("game_id", "line", "matched_by")


@query("d8_reconcile_ids", "SELECT date, least(home_team_id, away_team_id) AS team_lo, greatest(home_team_id, away_team_id) AS team_hi, CAST(count(DISTINCT game_id) AS INT) AS candidates, CASE WHEN count(DISTINCT game_id) = 1 THEN 'single' ELSE 'multiple' END AS status, CASE WHEN count(DISTINCT game_id) = 1 THEN min(game_id) END AS game_id FROM games GROUP BY 1, 2, 3")
def _(t):
    return G.reconcile_ids(t.games)


@query("d9_bridge_ids", "WITH p AS (SELECT DISTINCT c_custkey AS a, c_custkey % 97 AS b, lower(trim(c_name)) AS k FROM customer), v AS (SELECT x.a AS a_id, y.b AS b_id, count(*) AS n FROM p x JOIN p y ON x.k = y.k GROUP BY 1, 2) SELECT a_id, b_id, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY n DESC, b_id) = 1")
def _(t):
    c = t.base("customer")
    return G.bridge_ids(c, c.withColumn("b", F.col("c_custkey") % 97), "c_name", "c_custkey", "b")


@query("d11_resolve_ids", "SELECT o_orderkey, o_custkey % 50 AS ext, max(c) AS canonical_id FROM (SELECT o_orderkey, o_custkey FROM orders) LEFT JOIN (SELECT c_custkey % 50 AS e, max(c_custkey) AS c FROM customer GROUP BY 1) ON o_custkey % 50 = e GROUP BY 1, 2")
def _(t):
    c = t.base("customer")
    m = c.select(F.lit("x").alias("provider"), (F.col("c_custkey") % 50).alias("external_id"), F.col("c_custkey").alias("canonical_id"), F.col("c_custkey").alias("load_order"))
    return G.resolve_external(t.base("orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("ext")), m, "x", "ext")


@query(
    "d12_fill_box_scores",
    """WITH s AS (SELECT game_id, team_id, sum(pts) AS s FROM player_stats GROUP BY 1, 2),
 b AS (SELECT DISTINCT game_id, team_id, season, CASE WHEN season % 2 = 1 OR game_id % 4 = 0 THEN 1.0 END AS pts FROM player_stats),
 r AS (SELECT *, avg(CASE WHEN pts IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY season) AS rate FROM b)
 SELECT r.game_id, r.team_id, CASE WHEN rate > 0.5 THEN coalesce(pts, s) ELSE pts END AS pts FROM r JOIN s ON r.game_id = s.game_id AND r.team_id = s.team_id""",
)
def _(t):
    box = t.player_stats.select("game_id", "team_id", "season").distinct().withColumn("pts", F.when((F.col("season") % 2 == 1) | (F.col("game_id") % 4 == 0), 1.0))
    return G.fill_box_scores(box, t.player_stats, "pts").select("game_id", "team_id", "pts")


@query("d17_interval_count", "SELECT a.home_team_id AS team_id, a.game_id, count(b.game_id) AS n FROM games a LEFT JOIN games b ON a.home_team_id = b.away_team_id AND b.date >= a.date - INTERVAL 60 DAY AND b.date < a.date GROUP BY 1, 2")
def _(t):
    return G.interval_count(t.games.select(F.col("home_team_id").alias("team_id"), "game_id", "date"), t.games.select(F.col("away_team_id").alias("team_id"), "date"), "team_id", 60)


@query("d19_orphans", "SELECT game_id, away_team_id AS team_id, false AS is_home FROM games WHERE away_team_id NOT IN (SELECT team_id FROM teams)")
def _(t):
    return G.orphans(t.games, t.teams)


@query("d20_expand_players", "SELECT g.game_id, g.sport, g.date, p.player_id, p.pts FROM games g JOIN player_stats p ON g.game_id = p.game_id")
def _(t):
    return G.expand_players(t.games, t.player_stats, ["pts"])


# ---------------------------------------------------------------- rollups


@query("e1_team_season_rollup", f"WITH {TG} SELECT season, team_id, count(*) AS games, CAST(sum(CASE WHEN pf > pa THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN pf > pa THEN 0 ELSE 1 END) AS BIGINT) AS losses, round(avg(pf), 6) AS avg_for, round(avg(pa), 6) AS avg_against, round(avg(pf - pa), 6) + 0.0 AS avg_margin, max(date) AS as_of FROM tg WHERE status = 'final' GROUP BY 1, 2")
def _(t):
    return rounded(G.team_season_rollup(t.games))


@query(
    "e1_standings",
    f"""WITH {TG}, r AS (SELECT season, team_id, count(*) AS g, sum(CASE WHEN pf > pa THEN 1 ELSE 0 END) AS w FROM tg WHERE status = 'final' GROUP BY 1, 2),
 x AS (SELECT season, conference, t.team_id, name, CAST(w AS VARCHAR) || '-' || CAST(g - w AS VARCHAR) AS record, w / g AS p, w, g FROM r JOIN teams t ON r.team_id = t.team_id)
 SELECT season, conference, team_id, name, record, round(p, 6) AS pct, CAST(row_number() OVER (PARTITION BY season, conference ORDER BY p DESC, w DESC, team_id) AS INT) AS rank, round((max(p) OVER (PARTITION BY season, conference) - p) * g / 2, 6) AS games_behind FROM x""",
)
def _(t):
    return rounded(G.standings(t.games, t.teams))


@query("e3_player_season", "SELECT season, player_id, count(*) AS games, round(avg(pts), 6) AS avg_pts, round(avg(reb), 6) AS avg_reb, round(avg(ast), 6) AS avg_ast, round(avg(minutes), 6) AS avg_minutes FROM player_stats GROUP BY 1, 2")
def _(t):
    return rounded(G.season_averages(t.player_stats.drop("game_id", "seq", "team_id"), ["season", "player_id"]))


@query("e4_entity_averages", "SELECT season, player_id AS entity_id, round(avg(pts), 6) AS avg_pts, round(avg(reb), 6) AS avg_reb, 'player' AS entity_type FROM player_stats GROUP BY 1, 2 UNION ALL SELECT season, team_id, round(avg(pts), 6), round(avg(reb), 6), 'team' FROM player_stats GROUP BY 1, 2")
def _(t):
    return rounded(G.entity_averages(t.player_stats, ["pts", "reb"]))


@query("e5_player_totals", "SELECT player_id, count(DISTINCT game_id) AS games, arg_max(team_id, (date, game_id, seq)) AS team_id, round(sum(pts), 2) AS total_pts, round(avg(reb), 4) AS mean_reb FROM player_stats GROUP BY 1")
def _(t):
    return G.player_totals(t.player_stats, ["pts"], ["reb"])


@query("e6_best_source", "WITH f AS (SELECT player_id, source, avg((CASE WHEN pts < 40 THEN 1 ELSE 0 END) + 1) AS fullness, count(*) AS rows FROM player_stats GROUP BY 1, 2) SELECT player_id, source, round(fullness, 6) AS fullness, rows FROM f QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY fullness DESC, rows DESC, source) = 1")
def _(t):
    d = t.player_stats.withColumn("pts", F.when(F.col("pts") < 40, F.col("pts")))
    return rounded(G.best_source(d, ["pts", "reb"]))


@query("e8_team_from_players", "SELECT season, team_id, count(DISTINCT game_id) AS games, count(DISTINCT player_id) AS players, round(sum(pts), 6) AS total_pts, round(avg(pts), 6) AS avg_pts FROM player_stats GROUP BY 1, 2")
def _(t):
    return rounded(G.team_from_players(t.player_stats, ["pts"]))


@query("e9_player_advanced", "SELECT player_id, round(avg(pts), 6) AS avg_pts, round(sum(pts), 6) AS total_pts, max(pts) AS max_pts, round(avg(ast), 6) AS avg_ast, round(sum(ast), 6) AS total_ast, max(ast) AS max_ast FROM player_stats GROUP BY 1")
def _(t):
    return rounded(G.player_advanced(t.player_stats, ["pts", "ast"]))


@query("e10_value_sets", "SELECT sport, array_to_string(list_sort(list(DISTINCT CAST(season AS VARCHAR))), ',') AS \"values\", CAST(count(DISTINCT season) AS INT) AS n_values, count(*) AS n_rows FROM games GROUP BY 1")
def _(t):
    return G.value_sets(t.games, "sport", "season")


@query(
    "e11_win_loss_ranking",
    f"WITH {TG}, x AS (SELECT sport, team_id, sum(CASE WHEN pf > pa THEN 1 ELSE 0 END) AS w, sum(CASE WHEN pf > pa THEN 0 ELSE 1 END) AS l FROM tg WHERE pf IS NOT NULL AND pa IS NOT NULL AND pf <> pa GROUP BY 1, 2), y AS (SELECT sport, team_id, CAST(w AS BIGINT) AS wins, CAST(l AS BIGINT) AS losses, CAST(row_number() OVER (PARTITION BY sport ORDER BY w DESC, l, team_id) AS INT) AS rank FROM x) SELECT * FROM y WHERE rank <= 100",
)
def _(t):
    return G.win_loss_ranking(t.games)


@query("e12_weighted_rates", "SELECT season, team_id, round(sum(minutes), 6) AS total_minutes, round(sum(pts * minutes) / sum(minutes), 6) AS w_pts, round(sum(reb * minutes) / sum(minutes), 6) AS w_reb FROM player_stats GROUP BY 1, 2")
def _(t):
    return rounded(G.weighted_rates(t.player_stats, "minutes", ["pts", "reb"], ["season", "team_id"]))


@query("e13_prop_thresholds", "SELECT player_id, count(pts) AS samples, round(avg(pts), 6) AS mean, quantile_cont(pts, 0.25) AS p25, quantile_cont(pts, 0.5) AS median, quantile_cont(pts, 0.75) AS p75, round(quantile_cont(pts, 0.9), 6) AS p90 FROM player_stats GROUP BY 1 HAVING count(pts) >= 20")
def _(t):
    return rounded(G.prop_thresholds(t.player_stats, "pts"))


@query("e14_market_rates", "SELECT sport, season, count(*) AS games, round(avg(CASE WHEN home_score >= 80 AND away_score >= 80 THEN 1.0 ELSE 0 END), 6) AS both_score, round(avg(CASE WHEN home_score = away_score THEN 1.0 ELSE 0 END), 6) AS draw, round(avg(CASE WHEN home_score + away_score > 180 THEN 1.0 ELSE 0 END), 6) AS over, round(avg(CASE WHEN home_score > away_score THEN 1.0 ELSE 0 END), 6) AS home_win, round(avg(CASE WHEN abs(home_score - away_score) <= 5 THEN 1.0 ELSE 0 END), 6) AS close FROM games WHERE home_score IS NOT NULL AND away_score IS NOT NULL GROUP BY 1, 2")
def _(t):
    return rounded(G.market_rates(t.games))


@query(
    "e15_team_strength",
    f"""WITH {TG}, f AS (SELECT *, CASE WHEN pf > pa THEN 1 ELSE 0 END AS win, row_number() OVER (PARTITION BY team_id ORDER BY date DESC, game_id DESC) AS rn FROM tg WHERE status = 'final'),
 a AS (SELECT team_id, count(*) AS games, sum(pf) AS pf, sum(pa) AS pa, avg(win) AS pct, avg(CASE WHEN rn <= 10 THEN win END) AS recent FROM f GROUP BY 1)
 SELECT team_id, games, round(greatest(least(50 + (0.5 / (1 + pow(pa / pf, 13.91)) + 0.3 * pct + 0.2 * recent - 0.5) * 98 * (games / (games + 10.0)), 99), 1), 6) AS rating FROM a""",
)
def _(t):
    return rounded(G.team_strength(t.games))


@query("e17_home_feed", "SELECT sport, count(*) AS rows, round(max(greatest(home_win_prob, away_win_prob)), 6) AS top, count(home_score) AS graded FROM predictions GROUP BY 1")
def _(t):
    return rounded(t.predictions.groupBy("sport").agg(F.count("*").alias("rows"), F.max(F.greatest("home_win_prob", "away_win_prob")).alias("top"), F.count("home_score").alias("graded")))


@query("e19_daily_mean", "SELECT date, round(avg(pts), 6) AS pts FROM player_stats GROUP BY 1")
def _(t):
    return rounded(t.player_stats.groupBy("date").agg(F.avg("pts").alias("pts")))


@query(
    "e20_histogram",
    """WITH e AS (SELECT min(home_score) AS lo, max(home_score) AS hi FROM games), b AS (SELECT least(CAST(floor((home_score - lo) / ((hi - lo) / 12)) AS BIGINT), 11) AS bin, count(*) AS n FROM games, e WHERE home_score IS NOT NULL GROUP BY 1)
 SELECT r.i AS bin, round(lo + r.i * (hi - lo) / 12, 6) AS low, coalesce(n, 0) AS n FROM range(12) r(i) CROSS JOIN e LEFT JOIN b ON b.bin = r.i""",
)
def _(t):
    return rounded(G.histogram(t.games, "home_score", 12))


@query("e21_correlations", "SELECT 'pts' AS a, 'reb' AS b, round(corr(pts, reb), 6) AS r FROM player_stats UNION ALL SELECT 'pts', 'ast', round(corr(pts, ast), 6) FROM player_stats UNION ALL SELECT 'reb', 'ast', round(corr(reb, ast), 6) FROM player_stats")
def _(t):
    return rounded(G.correlations(t.player_stats, ["pts", "reb", "ast"]))


@query("e22_modal", "WITH n AS (SELECT team_id, reb, count(*) AS c FROM player_stats GROUP BY 1, 2) SELECT team_id, reb AS mode, round(c / sum(c) OVER (PARTITION BY team_id), 6) AS share FROM n QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY c DESC, reb) = 1")
def _(t):
    return rounded(G.modal(t.player_stats, "team_id", "reb"))


@query("e23_entities", "SELECT lower(x) AS key, min(x) AS name, count(*) AS seen, 'division' AS kind FROM (SELECT conference AS x FROM teams UNION ALL SELECT division FROM teams) GROUP BY 1")
def _(t):
    return G.distinct_entities(t.teams, ["conference", "division"], "division")


@query("e24_player_dimension", "SELECT DISTINCT player_id, team_id FROM player_stats")
def _(t):
    return t.player_stats.select("player_id", "team_id").dropDuplicates()


# ---------------------------------------------------------------- windows


@query("f1_latest_odds", f"WITH {LATEST} SELECT * FROM latest")
def _(t):
    return G.latest_odds(t.odds)


_FORM = ", ".join(
    f"CAST(sum(CASE WHEN rn <= {n} THEN win END) AS BIGINT) AS wins_{n}, count(CASE WHEN rn <= {n} THEN 1 END) AS games_{n}, round(avg(CASE WHEN rn <= {n} THEN pf - pa END), 6) + 0.0 AS margin_{n}, round(avg(CASE WHEN rn <= {n} THEN pf END), 6) AS for_{n}, round(avg(CASE WHEN rn <= {n} THEN pa END), 6) AS against_{n}" for n in (3, 5, 10)
)


@query("f2_team_recent_form", f"WITH {TG}, f AS (SELECT *, CASE WHEN pf > pa THEN 1 ELSE 0 END AS win, row_number() OVER (PARTITION BY team_id ORDER BY date DESC, game_id DESC) AS rn FROM tg WHERE status = 'final') SELECT team_id, {_FORM}, max(date) AS last_date FROM f GROUP BY team_id")
def _(t):
    return rounded(G.recent_form(t.games))


@query("f3_capped", "SELECT sport, game_id, date FROM games QUALIFY row_number() OVER (PARTITION BY sport ORDER BY date DESC, game_id) <= 25")
def _(t):
    return filters.capped(t.games.select("sport", "game_id", "date"), ["sport"], [F.desc("date"), F.col("game_id")], 25)


@query("f4_leaders", "WITH s AS (SELECT player_id, sum(pts) AS pts, sum(reb) AS reb, avg(minutes) AS minutes FROM player_stats GROUP BY 1), u AS (SELECT player_id, 'pts' AS stat, pts AS value, 1 AS sg FROM s UNION ALL SELECT player_id, 'reb', reb, 1 FROM s UNION ALL SELECT player_id, 'minutes', minutes, -1 FROM s) SELECT player_id, stat, round(value, 6) AS value, CAST(row_number() OVER (PARTITION BY stat ORDER BY value * sg DESC, player_id) AS INT) AS rank FROM u QUALIFY rank <= 25")
def _(t):
    s = t.player_stats.groupBy("player_id").agg(F.sum("pts").alias("pts"), F.sum("reb").alias("reb"), F.avg("minutes").alias("minutes"))
    return rounded(windows.leaders(s, ["player_id"], {"pts": True, "reb": True, "minutes": False}))


@query("f5_projected_leaders", "WITH d AS (SELECT player_id, count(DISTINCT game_id) AS games, sum(pts) / count(DISTINCT game_id) * 82 AS pts, sum(reb) / count(DISTINCT game_id) * 82 AS reb FROM player_stats GROUP BY 1), b AS (SELECT max(pts) AS p, max(reb) AS r FROM d), s AS (SELECT player_id, games, pts, reb, (pts / p * 2 + reb / r * 1) / 3 AS score FROM d, b) SELECT player_id, games, round(pts, 6) AS proj_pts, round(reb, 6) AS proj_reb, round(score, 6) AS score FROM s ORDER BY s.score DESC, player_id LIMIT 25")
def _(t):
    return rounded(windows.projected_leaders(t.player_stats, {"pts": 2.0, "reb": 1.0}, 82))


@query("f7_news_dedup", "SELECT id, provider, headline FROM news QUALIFY row_number() OVER (PARTITION BY headline ORDER BY id) = 1")
def _(t):
    return G.keep_first(t.news.select("id", "provider", "headline"), [F.col("headline")], [F.col("id")])


@query("f8_streaks", f"WITH {TG}, f AS (SELECT team_id, game_id, date, is_home, CASE WHEN pf > pa THEN 1 ELSE 0 END AS win FROM tg WHERE status = 'final'), c AS (SELECT *, CASE WHEN lag(win) OVER w = win THEN 0 ELSE 1 END AS ch FROM f WINDOW w AS (PARTITION BY team_id ORDER BY date, game_id)), g AS (SELECT *, sum(ch) OVER (PARTITION BY team_id ORDER BY date, game_id) AS grp FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY team_id, grp ORDER BY date, game_id) AS k FROM g) SELECT team_id, game_id, CAST(CASE WHEN win = 1 THEN k ELSE -k END AS INT) AS streak FROM n")
def _(t):
    return windows.streaks(G.team_games(t.games).where("status = 'final'"), "team_id", ["date", "game_id"], "win").select("team_id", "game_id", "streak")


@query("f9_rolling_slope", "WITH d AS (SELECT player_id, game_id, seq, date, pts, reb, CAST(row_number() OVER (PARTITION BY player_id ORDER BY date, game_id, seq, pts, reb) AS DOUBLE) AS i FROM player_stats) SELECT player_id, game_id, seq, round(CASE WHEN count(*) OVER w > 1 THEN regr_slope(pts, i) OVER w END, 6) + 0.0 AS slope FROM d WINDOW w AS (PARTITION BY player_id ORDER BY date, game_id, seq, pts, reb ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(t):
    return rounded(windows.rolling_slope(t.player_stats, "player_id", ["date", "game_id", "seq", "pts", "reb"], "pts", 5).select("player_id", "game_id", "seq", "slope"))


@query("f10_recent_counts", f"WITH {TG} SELECT team_id, game_id, count(*) OVER (PARTITION BY team_id ORDER BY date RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS last_7d, count(*) OVER (PARTITION BY team_id ORDER BY date RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS last_14d, count(*) OVER (PARTITION BY team_id ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS last_30d FROM tg")
def _(t):
    return windows.recent_counts(G.team_games(t.games), "team_id").select("team_id", "game_id", "last_7d", "last_14d", "last_30d")


@query("f11_rest_days", "SELECT player_id, game_id, seq, CAST(coalesce(least(date_diff('day', lag(date) OVER (PARTITION BY player_id ORDER BY date, game_id, seq, pts, reb), date), 14), 7) AS INT) AS rest_days FROM player_stats")
def _(t):
    return windows.days_since(t.player_stats, "player_id", ["game_id", "seq", "pts", "reb"]).select("player_id", "game_id", "seq", "rest_days")


@query(
    "f12_shifted_stats",
    """WITH d AS (SELECT player_id, game_id, seq, date, pts, reb, lag(pts) OVER w AS last, avg(pts) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m5, max(pts) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x5, avg(pts) OVER (w ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS m15,
  coalesce(stddev_samp(pts) OVER (w ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 0) AS s15 FROM player_stats WINDOW w AS (PARTITION BY player_id ORDER BY date, game_id, seq, pts, reb)),
 a AS (SELECT *, coalesce(sum(CASE WHEN round(pts - m15, 9) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY player_id ORDER BY date, game_id, seq, pts, reb ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS above FROM d)
 SELECT player_id, game_id, seq, last, round(m5, 6) AS mean_5, x5 AS max_5, round(m15, 6) AS mean_15, round(s15, 6) AS std_15, round(m5 - m15, 6) + 0.0 AS trend, CAST(above AS BIGINT) AS above_5 FROM a""",
)
def _(t):
    d = windows.shifted_stats(t.player_stats, "player_id", ["date", "game_id", "seq", "pts", "reb"], "pts")
    return rounded(d.select("player_id", "game_id", "seq", "last", "mean_5", "max_5", "mean_15", "std_15", "trend", "above_5"))


@query("f15_field_ranks", "SELECT game_id, player_id, seq, CAST(row_number() OVER (PARTITION BY game_id ORDER BY pts DESC, player_id, seq) AS INT) AS field_rank, count(*) OVER (PARTITION BY game_id) AS field_size, round(percent_rank() OVER (PARTITION BY game_id ORDER BY pts), 6) AS beaten, round(pts - avg(pts) OVER (PARTITION BY game_id), 6) + 0.0 AS vs_field FROM player_stats")
def _(t):
    return rounded(windows.field_ranks(t.player_stats.select("game_id", "player_id", "seq", "pts"), "game_id", "pts", ["player_id", "seq"]).drop("pts"))


@query("f16_top_overlap", "WITH r AS (SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY minutes DESC, player_id, seq, reb) AS p, row_number() OVER (PARTITION BY game_id ORDER BY reb DESC, player_id, seq, minutes) AS a FROM player_stats) SELECT game_id, count(CASE WHEN p <= 2 AND a <= 2 THEN 1 END) AS hits, round(count(CASE WHEN p <= 2 AND a <= 2 THEN 1 END) / least(count(*), 2), 6) AS recall FROM r GROUP BY 1")
def _(t):
    return rounded(windows.top_overlap(t.player_stats, "game_id", "minutes", "reb", ["player_id", "seq"], 2))


@query("f17_line_movement", "WITH d AS (SELECT game_id, bookmaker, arg_min(total_line, (ts, seq, tie)) AS o, arg_max(total_line, (ts, seq, tie)) AS c, max(total_line) - min(total_line) AS r, count(*) AS ticks FROM odds GROUP BY 1, 2) SELECT game_id, bookmaker, o AS open, c AS close, c - o AS move, r AS range, ticks, CASE WHEN abs(c - o) >= 10 THEN 'steam' WHEN abs(c - o) >= 3 THEN 'drift' WHEN r >= 10 THEN 'volatile' ELSE 'stable' END AS regime FROM d")
def _(t):
    return windows.line_movement(t.odds, "total_line")


# ---------------------------------------------------------------- set operations and scalars


@query("g1_union_kinds", "SELECT 'a' AS stats_kind, player_id, pts, NULL AS reb FROM player_stats WHERE source = 'a' UNION ALL SELECT 'b', player_id, pts, reb FROM player_stats WHERE source = 'b'")
def _(t):
    p = t.player_stats
    return G.union_kinds({"a": p.where("source = 'a'").select("player_id", "pts"), "b": p.where("source = 'b'").select("player_id", "pts", "reb")})


@query("g6_team_games", f"WITH {TG} SELECT game_id, team_id, opp_id, is_home, pf, pa, completed, CASE WHEN pf > pa THEN 1 WHEN pf IS NOT NULL AND pa IS NOT NULL THEN 0 END AS win FROM tg")
def _(t):
    return G.team_games(t.games).select("game_id", "team_id", "opp_id", "is_home", "pf", "pa", "completed", "win")


@query("h1_odds_math", "WITH d AS (SELECT game_id, bookmaker, seq, h2h_home AS o, CASE WHEN h2h_home > 0 THEN 1 + h2h_home / 100 ELSE 1 + 100 / abs(h2h_home) END AS dec FROM odds) SELECT game_id, bookmaker, seq, round(dec, 6) AS decimal, round(1 / dec, 6) AS implied, round(CASE WHEN dec >= 2 THEN (dec - 1) * 100 ELSE -100 / (dec - 1) END, 4) AS back FROM d")
def _(t):
    d = t.odds.select("game_id", "bookmaker", "seq", S.american_to_decimal("h2h_home").alias("decimal"), S.american_to_implied("h2h_home").alias("implied"))
    return d.select("game_id", "bookmaker", "seq", F.round("decimal", 6).alias("decimal"), F.round("implied", 6).alias("implied"), F.round(S.decimal_to_american("decimal"), 4).alias("back"))


@query("h5_grades", "WITH p AS (SELECT game_id, greatest(home_win_prob, away_win_prob) AS c FROM predictions) SELECT game_id, CASE WHEN c >= 0.75 THEN 'S' WHEN c >= 0.65 THEN 'A' WHEN c >= 0.58 THEN 'B' WHEN c >= 0.52 THEN 'C' ELSE 'D' END AS grade, CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.55 THEN 'medium' ELSE 'low' END AS tier FROM p")
def _(t):
    c = F.greatest("home_win_prob", "away_win_prob")
    return t.predictions.select("game_id", S.grade(c).alias("grade"), S.tier(c).alias("tier"))


@query("h17_losses", "SELECT game_id, round(pow(home_win_prob - (CASE WHEN home_score > away_score THEN 1 ELSE 0 END), 2), 6) AS brier, round(-ln(CASE WHEN home_score > away_score THEN home_win_prob ELSE 1 - home_win_prob END), 6) AS log_loss FROM predictions WHERE home_score IS NOT NULL")
def _(t):
    y = (F.col("home_score") > F.col("away_score")).cast("int")
    return rounded(t.predictions.where("home_score IS NOT NULL").select("game_id", S.brier("home_win_prob", y).alias("brier"), S.log_loss("home_win_prob", y).alias("log_loss")))
