"""Scalar functions, catalog reads and live changes as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import games as G
from ..streaming import live
from .registry import query
from .table_queries import rounded

ODDS_KEY = "game_id, bookmaker, seq, tie"
KEY = ["game_id", "bookmaker", "seq", "tie"]


@query("h2_payouts", f"SELECT {ODDS_KEY}, round(CASE WHEN h2h_home > 0 THEN 100 * h2h_home / 100 ELSE 100 * 100 / abs(h2h_home) END, 6) AS profit, round(100 / greatest(least(seq / 8.0, 0.99), 0.01), 6) AS fair FROM odds")
def _(t):
    return rounded(t.odds.select(*KEY, S.profit(F.lit(100.0), "h2h_home").alias("profit"), S.fair_payout(F.col("seq") / 8.0).alias("fair")))


DEC = "CASE WHEN h2h_home > 0 THEN 1 + h2h_home / 100 ELSE 1 + 100 / abs(h2h_home) END"


@query("h3_kelly", f"WITH d AS (SELECT {ODDS_KEY}, {DEC} - 1 AS b, seq / 8.0 AS p FROM odds) SELECT {ODDS_KEY}, round(least(greatest(0.25 * (b * p - (1 - p)) / b, 0), 0.05), 6) AS stake FROM d")
def _(t):
    return rounded(t.odds.select(*KEY, S.kelly(F.col("seq") / 8.0, S.american_to_decimal("h2h_home")).alias("stake")))


@query("h4_value", f"WITH d AS (SELECT {ODDS_KEY}, {DEC} AS dec, seq / 8.0 AS p, spread_home FROM odds) SELECT {ODDS_KEY}, round(p * (dec - 1) - (1 - p), 6) AS ev, round(p - 1 / dec, 6) AS edge, round(least(greatest(p + spread_home * 0.03, 0.05), 0.95), 6) AS cover FROM d")
def _(t):
    p, dec = F.col("seq") / 8.0, S.american_to_decimal("h2h_home")
    return rounded(t.odds.select(*KEY, S.expected_value(p, dec).alias("ev"), S.edge(p, S.decimal_to_implied(dec)).alias("edge"), S.spread_cover(p, "spread_home").alias("cover")))


@query("h6_fold", "SELECT c_custkey AS team_id, lower(trim(replace(c_name, '#', ' '))) AS folded FROM customer")
def _(t):
    c = t.base("customer")
    marked = F.translate(F.concat(F.lit(" "), F.upper(F.translate("c_name", "#", " ")), F.lit(" ")), "AEIOU", "\u00c1\u00c9\u00cd\u00d3\u00dc")
    return c.select(F.col("c_custkey").alias("team_id"), S.fold(marked).alias("folded"))


@query(
    "h7_dates",
    "SELECT o_orderkey AS game_id, CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS DATE) AS day, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 10 THEN 1 ELSE 0 END + 1 AS BIGINT) AS season, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_orderkey AS VARCHAR) END AS BIGINT) AS cast_id FROM orders",
)
def _(t):
    o = t.base("orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(F.col("o_orderkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("game_id"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).cast("date").alias("day"), S.season_of("o_orderdate", 10, "end").alias("season"), text.try_cast("bigint").alias("cast_id"))


@query(
    "h8_durations",
    "SELECT l_orderkey AS game_id, l_linenumber AS seq, round(l_partkey % 48 + (l_suppkey % 60) / 60.0, 6) AS iso_minutes, CAST(l_partkey % 48 * 60 + l_suppkey % 60 AS INT) AS clock, round(l_partkey % 9 + (l_suppkey % 3) / 3.0, 6) AS innings FROM lineitem",
)
def _(t):
    m, s = F.col("l_partkey") % 48, F.col("l_suppkey") % 60
    d = t.base("lineitem").select(
        F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("seq"), F.format_string("PT%dM%d.00S", m, s).alias("iso"), F.format_string("%02d:%02d", m, s).alias("mmss"), F.concat_ws(".", (F.col("l_partkey") % 9).cast("string"), (F.col("l_suppkey") % 3).cast("string")).alias("ip")
    )
    return rounded(d.select("game_id", "seq", S.iso_minutes("iso").alias("iso_minutes"), S.clock_seconds("mmss").alias("clock"), S.innings("ip").alias("innings")))


@query("h9_records", "SELECT c_custkey AS team_id, CAST(c_custkey % 82 AS INT) AS wins, CAST(82 - c_custkey % 82 AS INT) AS losses, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 5 AS INT) END AS ties, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (1 + c_custkey % 9) AS INT) AS streak FROM customer")
def _(t):
    k = F.col("c_custkey")
    record = F.concat_ws("-", (k % 82).cast("string"), (82 - k % 82).cast("string"), F.when(k % 3 == 0, (k % 5).cast("string")))
    d = t.base("customer").select(k.alias("team_id"), record.alias("r"), F.concat(F.when(k % 2 == 0, "W").otherwise("l"), (1 + k % 9).cast("string")).alias("s"))
    return d.select("team_id", S.record_part("r", 0).alias("wins"), S.record_part("r", 1).alias("losses"), S.record_part("r", 2).alias("ties"), S.streak("s").alias("streak"))


@query("h10_names", "SELECT c_custkey AS team_id, c_mktsegment || ' ' || c_name AS full_name, 'home_team_' || lower(c_mktsegment) AS column_name FROM customer")
def _(t):
    return t.base("customer").select(F.col("c_custkey").alias("team_id"), S.last_first(F.concat_ws(", ", "c_name", "c_mktsegment")).alias("full_name"), S.snake(F.concat(F.lit("HomeTeam "), F.lower("c_mktsegment"))).alias("column_name"))


@query("h11_team_ids", "SELECT c_custkey AS raw_id, CASE WHEN c_custkey % 4 = 0 THEN 'T' || c_custkey % 1000 WHEN c_custkey % 4 IN (1, 2) THEN coalesce(substr(n_name, 1, 3), '') ELSE '' END AS team_id FROM customer LEFT JOIN nation ON c_custkey % 4 IN (1, 2) AND c_custkey = n_nationkey * 4 + 1")
def _(t):
    k = F.col("c_custkey")
    raw = t.base("customer").select(k.alias("raw_id"), F.when(k % 4 == 0, F.concat(F.lit("T"), (k % 1000).cast("string"))).when(k % 4 == 3, F.lit(None)).otherwise((1_610_000_000 + k).cast("string")).alias("t"))
    known = t.base("nation").select((1_610_000_001 + F.col("n_nationkey") * 4).cast("string").alias("numeric_id"), F.substring("n_name", 1, 3).alias("team_id"))
    return G.normal_team_ids(raw, known, "t").select("raw_id", "team_id")


@query(
    "h12_weather",
    "SELECT l_orderkey AS game_id, l_linenumber AS seq, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_partkey % 100 AS DOUBLE) END AS temperature, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_suppkey % 30 AS DOUBLE) END AS wind, l_linenumber % 3 = 0 AS dome FROM lineitem",
)
def _(t):
    text = F.when(F.col("l_linenumber") % 3 == 0, "Roof closed").otherwise(F.format_string("%d degrees, wind %d MPH", F.col("l_partkey") % 100, F.col("l_suppkey") % 30))
    temp, wind, dome = S.weather(text)
    return t.base("lineitem").select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("seq"), temp.alias("temperature"), wind.alias("wind"), dome.alias("dome"))


@query("h13_surface", "SELECT o_orderkey AS game_id, CASE o_orderkey % 3 WHEN 0 THEN 'grass' WHEN 1 THEN 'clay' ELSE 'hard' END AS surface FROM orders")
def _(t):
    k = F.col("o_orderkey")
    venue = F.when(k % 3 == 0, "Wimbledon Court 1").when(k % 3 == 1, "MADRID Open").otherwise("Indoor Arena")
    return t.base("orders").select(k.alias("game_id"), S.surface(venue).alias("surface"))


@query("h14_logits", "SELECT game_id, round(ln(home_win_prob / (1 - home_win_prob)), 6) AS logit, round(home_win_prob, 6) AS back FROM predictions")
def _(t):
    return rounded(t.predictions.select("game_id", S.logit("home_win_prob").alias("logit"), S.sigmoid(S.logit("home_win_prob")).alias("back")))


@query(
    "h15_over_chances",
    """WITH m AS (SELECT p_partkey AS player_id, 1 + p_size % 9 / 2.0 AS mean, CAST(p_partkey % 6 AS INT) AS k FROM part),
 s AS (SELECT player_id, sum(exp(-mean) * pow(mean, i) / (CASE i WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 6 WHEN 4 THEN 24 ELSE 120 END)) AS below FROM m, generate_series(0, 5) g(i) WHERE i <= k GROUP BY 1)
 SELECT player_id, round(greatest(1 - below, 0), 6) AS poisson_over FROM s""",
)
def _(t):
    mean = 1 + F.col("p_size") % 9 / 2.0
    return rounded(t.base("part").select(F.col("p_partkey").alias("player_id"), S.poisson_over((F.col("p_partkey") % 6).cast("double") + 0.5, mean).alias("poisson_over")))


@query("h16_over_line", "SELECT p_partkey AS prop_id, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS INT) END AS line FROM part")
def _(t):
    name = F.when(F.col("p_size") % 2 == 0, F.format_string("points_over_%d_game", "p_size")).otherwise("points_total")
    return t.base("part").select(F.col("p_partkey").alias("prop_id"), S.over_line(name).alias("line"))


@query("h18_vote_confidence", "SELECT game_id, round(least(greatest(0.5 + abs(home_win_prob - 0.5) * (game_id % 5 / 4.0), 0.5), 0.99), 6) AS confidence FROM predictions")
def _(t):
    return rounded(t.predictions.select("game_id", S.vote_confidence("home_win_prob", F.col("game_id") % 5 / 4.0).alias("confidence")))


@query(
    "h19_shooting",
    "WITH s AS (SELECT game_id, team_id, sum(pts) AS pts, sum(reb) AS reb, sum(ast) AS ast, sum(minutes) AS minutes FROM player_stats GROUP BY 1, 2) SELECT game_id, team_id, round((pts + 0.5 * reb) / minutes, 6) AS efg, round(pts / (2 * (minutes + 0.44 * ast)), 6) AS ts, round(minutes - reb + ast + 0.44 * pts, 6) AS possessions FROM s",
)
def _(t):
    s = t.player_stats.groupBy("game_id", "team_id").agg(*(F.sum(c).alias(c) for c in ("pts", "reb", "ast", "minutes")))
    return rounded(s.select("game_id", "team_id", S.effective_fg("pts", "reb", "minutes").alias("efg"), S.true_shooting("pts", "minutes", "ast").alias("ts"), S.possessions("minutes", "reb", "ast", "pts").alias("possessions")))


@query(
    "h20_batting",
    """WITH b AS (SELECT l_partkey AS player_id, sum(l_quantity) + 10 AS ab, sum(l_linenumber) AS h, sum(l_linenumber % 2) AS d, sum(l_linenumber % 3) AS t, sum(l_linenumber % 4) AS hr, sum(l_suppkey % 5) AS bb, sum(l_suppkey % 2) AS hbp, sum(l_suppkey % 3) AS sh, sum(l_suppkey % 4) AS sf FROM lineitem GROUP BY 1)
 SELECT player_id, round(ab + bb + hbp + sh + sf, 6) AS pa, CAST(h + d + 2 * t + 3 * hr AS BIGINT) AS total_bases, round(h / ab, 6) AS avg, round((h + bb + hbp) / (ab + bb + hbp + sf), 6) AS obp, round((h + d + 2 * t + 3 * hr) / ab, 6) AS slg, round((h + bb + hbp) / (ab + bb + hbp + sf) + (h + d + 2 * t + 3 * hr) / ab, 6) AS ops,
 round(9 * hr / ab, 6) AS era, round((h + bb) / ab, 6) AS whip, round(9 * d / ab, 6) AS k9 FROM b""",
)
def _(t):
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    b = t.base("lineitem").groupBy(F.col("l_partkey").alias("player_id")).agg((F.sum("l_quantity") + 10).alias("ab"), *(F.sum(c).alias(k) for k, c in (("h", n), ("d", n % 2), ("t", n % 3), ("hr", n % 4), ("bb", s % 5), ("hbp", s % 2), ("sh", s % 3), ("sf", s % 4))))
    cols = {**S.batting_line("ab", "h", "d", "t", "hr", "bb", "hbp", "sh", "sf"), **S.pitching_line("ab", "hr", "h", "bb", "d")}
    return rounded(b.select("player_id", *(c.alias(k) for k, c in cols.items())))


@query("i40_constants", "SELECT o_orderkey AS game_id, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1.2 WHEN 1 THEN 0.9 ELSE 1.0 END AS DOUBLE) AS park_factor, CAST(CASE o_orderkey % 4 WHEN 0 THEN 5280 ELSE 0 END AS DOUBLE) AS altitude, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS tournament FROM orders")
def _(t):
    k = F.col("o_orderkey")
    d = t.base("orders").select(k.alias("game_id"), F.when(k % 4 == 0, "Mile High Field").when(k % 4 == 1, "Sea Level Park").otherwise("Elsewhere").alias("venue"), F.when(k % 5 == 0, "semifinal").when(k % 5 == 1, "nan").alias("stage"))
    return G.venue_constants(d, {"mile_high": 1.2, "sea_level": 0.9}, {"mile_high": 5280.0}).select("game_id", "park_factor", "altitude", "tournament")


@query("l3_team_checks", "SELECT sport, count(*) AS teams, count(*) - count(DISTINCT team_id) AS duplicate_ids, count(CASE WHEN name IS NULL OR trim(name) = '' THEN 1 END) AS blank_names, count(*) - count(DISTINCT lower(name)) AS duplicate_names, count(CASE WHEN conference IS NULL THEN 1 END) AS no_conference FROM teams GROUP BY 1")
def _(t):
    from ..operators import quality as Q

    return Q.team_checks(t.teams)


@query(
    "m3_changed_odds",
    "WITH d AS (SELECT game_id, bookmaker, seq, tie, ts, h2h_home, h2h_away, spread_home, total_line, lag(row(h2h_home, h2h_away, spread_home, total_line)) OVER (PARTITION BY game_id, bookmaker ORDER BY ts, seq, tie) AS p FROM odds) SELECT game_id, bookmaker, seq, tie, h2h_home FROM d WHERE p IS NULL OR p <> row(h2h_home, h2h_away, spread_home, total_line)",
)
def _(t):
    lines = ["h2h_home", "h2h_away", "spread_home", "total_line"]
    return live.changed_rows(t.odds, ["game_id", "bookmaker"], ["ts", "seq", "tie"], lines).select("game_id", "bookmaker", "seq", "tie", "h2h_home")


@query(
    "m5_news_dedup",
    f"SELECT lang, headline, min(id) AS id FROM (SELECT id, lang, trim(translate(lower(headline), '{S.MARKED}', '{S.PLAIN_}')) AS headline FROM news WHERE headline IS NOT NULL) WHERE headline <> '' GROUP BY 1, 2",
)
def _(t):
    n = t.news.withColumn("headline", S.fold("headline")).where("headline <> ''")
    return n.groupBy("lang", "headline").agg(F.min("id").alias("id"))


@query(
    "m9_pregame_window",
    "SELECT g.game_id, count(*) AS quotes, min(o.h2h_home) AS low, max(o.h2h_home) AS high, max(date_diff('day', CAST(o.ts AS DATE), g.date)) AS oldest_days FROM games g JOIN odds o ON g.game_id = o.game_id AND CAST(o.ts AS DATE) BETWEEN g.date - 60 AND g.date + 60 GROUP BY 1",
)
def _(t):
    day = F.to_date("ts")
    o = t.odds.select("game_id", "h2h_home", day.alias("day")).join(t.games.select("game_id", "date"), "game_id").where(F.col("day").between(F.date_sub("date", 60), F.date_add("date", 60)))
    return o.groupBy("game_id").agg(F.count("*").alias("quotes"), F.min("h2h_home").alias("low"), F.max("h2h_home").alias("high"), F.max(F.datediff("date", "day")).cast("long").alias("oldest_days"))
