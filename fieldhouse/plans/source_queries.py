"""Readers and writers as registered queries: rows of the tables are written as providers write them, read back, and held against the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import games as G, quality as Q
from ..sources import readers as R, writers as Wr
from .registry import query
from .store_queries import path
from .table_queries import rounded

text = lambda c: F.col(c).cast("string").alias(c)


def landed(df, schema: str):
    """The rows as JSON texts, parsed by a provider's schema."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("j")).select(F.from_json("j", schema).alias("x")).select("x.*")


@query("a1_scan_by_name", "SELECT game_id, home_team_id, home_score, NULL AS status FROM games WHERE season < 1995 UNION ALL SELECT game_id, NULL, home_score, status FROM games WHERE season >= 1995")
def _(t):
    """Two folders whose columns and types differ, as one table by name."""
    a, b = path(t, "scan-a"), path(t, "scan-b")
    t.games.where("season < 1995").select("game_id", "home_team_id", "home_score").write.parquet(a)
    t.games.where("season >= 1995").select(text("game_id"), "status", F.col("home_score").cast("float").alias("home_score")).write.parquet(b)
    from pyspark.sql.types import _parse_datatype_string

    return R.scan(t.spark, [a, b], _parse_datatype_string("game_id long, home_team_id long, home_score double, status string"))


@query("a8_matrix", "SELECT game_id, player_id, seq, CAST(floor(pts) AS BIGINT) AS pts FROM player_stats")
def _(t):
    row = F.array(*(F.col(c).cast("long").cast("string") for c in ("game_id", "player_id", "seq", "pts")))
    d = t.player_stats.groupBy("game_id").agg(F.collect_list(row).alias("rowSet")).select(F.array(*map(F.lit, ("GAME_ID", "Player_ID", "SEQ", "PTS"))).alias("headers"), "rowSet")
    m = R.matrix(landed(d, "headers array<string>, rowSet array<array<string>>"), "headers", "rowSet", ["game_id", "player_id", "seq", "pts"])
    return m.select(*(F.col(c).cast("long").alias(c) for c in m.columns))


@query(
    "a9_bookmaker_props",
    "WITH q AS (SELECT game_id, bookmaker, max(h2h_home) AS h, max(h2h_away) AS a, max(total_line) AS l FROM odds GROUP BY 1, 2) SELECT CAST(game_id AS VARCHAR) || '_' || bookmaker || '_h2h_home' AS prop_id, game_id, CAST(bookmaker AS VARCHAR) AS bookmaker, 'h2h' AS market, 'home' AS outcome, h AS price, NULL AS point FROM q UNION ALL SELECT CAST(game_id AS VARCHAR) || '_' || bookmaker || '_h2h_away', game_id, CAST(bookmaker AS VARCHAR), 'h2h', 'away', a, NULL FROM q UNION ALL SELECT CAST(game_id AS VARCHAR) || '_' || bookmaker || '_totals_over_' || CAST(l AS VARCHAR), game_id, CAST(bookmaker AS VARCHAR), 'totals', 'over', 1.9, l FROM q",
)
def _(t):
    q = t.odds.groupBy("game_id", "bookmaker").agg(F.max("h2h_home").alias("h"), F.max("h2h_away").alias("a"), F.max("total_line").alias("l"))
    o = lambda n, p, x: F.struct(F.lit(n).alias("name"), p.cast("double").alias("price"), x.cast("double").alias("point"))
    markets = F.array(F.struct(F.lit("h2h").alias("key"), F.array(o("home", F.col("h"), F.lit(None)), o("away", F.col("a"), F.lit(None))).alias("outcomes")), F.struct(F.lit("totals").alias("key"), F.array(o("over", F.lit(1.9), F.col("l"))).alias("outcomes")))
    d = q.groupBy(text("game_id")).agg(F.collect_list(F.struct(F.col("bookmaker").cast("string").alias("key"), F.lit("2024-01-01").alias("last_update"), markets.alias("markets"))).alias("bookmakers"))
    rows = R.bookmaker_props(landed(d.withColumnRenamed("game_id", "id"), R.MARKETS))
    return rows.select("prop_id", F.col("game_id").cast("long").alias("game_id"), "bookmaker", "market", "outcome", "price", "point")


@query("a10_depth_chart", "SELECT c_nationkey AS team, c_mktsegment AS position, CAST(row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS INT) AS rank, c_name AS athlete FROM customer")
def _(t):
    names = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"])
    d = t.base("customer").groupBy(F.col("c_nationkey").alias("team"), "c_mktsegment").agg(names.alias("names"))
    d = d.groupBy("team").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "names"))).alias("chart"))
    return R.depth_chart(landed(d, "team int, chart map<string,array<string>>"), "team", "chart")


def races(t, *parts: str):
    """Race feeds made of the finishes, with the parts that are asked for: providers have results, qualifying, laps and pit stops each in a text of its own."""
    driver = F.struct(text("player_id").alias("driverId"), F.lit("A").alias("givenName"), F.lit("B").alias("familyName"))
    team = F.struct((F.col("player_id") % 10).cast("string").alias("constructorId"))
    place = F.col("position").cast("int").cast("string")
    clock = lambda n: F.concat(F.lit("1:"), F.lpad((F.col("player_id") % n).cast("string"), 2, "0"), F.lit(".250"))
    rows = {
        "Results": F.struct(place.alias("position"), F.col("score_to_par").cast("string").alias("points"), F.lit("3").alias("grid"), F.col("rounds").cast("int").cast("string").alias("laps"), F.lit("Finished").alias("status"), driver.alias("Driver"), team.alias("Constructor")),
        "QualifyingResults": F.struct(place.alias("position"), clock(50).alias("Q1"), F.when(F.col("player_id") % 2 == 0, clock(40)).alias("Q2"), F.when(F.col("player_id") % 4 == 0, F.lit("59.5")).alias("Q3"), driver.alias("Driver"), team.alias("Constructor")),
        "Laps": F.struct(text("player_id").alias("driverId"), place.alias("position"), clock(60).alias("time")),
        "PitStops": F.struct(text("player_id").alias("driverId"), F.lit("1").alias("stop"), F.lit("7").alias("lap"), F.concat((F.col("player_id") % 30 + 20).cast("string"), F.lit(".5")).alias("duration")),
    }
    keys = ["game_id", "date", "circuit_id"]
    d = t.finishes.groupBy(*keys).agg(*(F.collect_list(rows[p]).alias(p) for p in parts)) if parts else t.finishes.select(*keys).distinct()
    if "Laps" in parts:
        d = d.withColumn("Laps", F.array(F.struct(F.lit("1").alias("number"), F.col("Laps").alias("Timings"))))
    at = lambda n: F.struct(F.date_sub("date", n).cast("string").alias("date"), F.when(F.col("game_id") % 3 != 0, F.lit("14:30:00Z")).alias("time"))
    d = d.select(F.year("date").cast("string").alias("season"), text("game_id").alias("round"), F.lit("x").alias("raceName"), F.struct(text("circuit_id").alias("circuitId"), F.lit("c").alias("circuitName")).alias("Circuit"), F.col("date").cast("string").alias("date"), F.lit("15:00:00Z").alias("time"), *parts, at(2).alias("FirstPractice"), F.when(F.col("game_id") % 2 == 0, at(1)).alias("Qualifying"))
    race = F.struct(*d.columns)
    return landed(d.select(F.struct(F.struct(F.col("season"), F.array(race).alias("Races")).alias("RaceTable")).alias("MRData")), R.RACES)


@query("a11_race_results", "SELECT year(date) AS season, game_id AS round, CAST(circuit_id AS VARCHAR) AS circuit_id, date, CAST(player_id AS VARCHAR) AS driver_id, 'A B' AS driver, CAST(player_id % 10 AS VARCHAR) AS constructor_id, position, rounds AS laps, score_to_par AS points FROM finishes")
def _(t):
    return R.race_results(races(t, "Results")).select("season", "round", "circuit_id", "date", "driver_id", "driver", "constructor_id", "position", "laps", "points")


@query("a11_race_qualifying", "WITH q AS (SELECT game_id, player_id, position, 60 + player_id % 50 + 0.25 AS q1, CASE WHEN player_id % 2 = 0 THEN 60 + player_id % 40 + 0.25 END AS q2, CASE WHEN player_id % 4 = 0 THEN 59.5 END AS q3 FROM finishes) SELECT game_id AS round, CAST(player_id AS VARCHAR) AS driver_id, position, q1, q2, q3, coalesce(q3, q2, q1) AS best FROM q")
def _(t):
    return R.race_qualifying(races(t, "QualifyingResults")).select("round", "driver_id", "position", "q1", "q2", "q3", "best")


@query("a11_race_laps_and_stops", "SELECT game_id AS round, CAST(player_id AS VARCHAR) AS driver_id, 60 + player_id % 60 + 0.25 AS lap_seconds, 7 AS lap, player_id % 30 + 20.5 AS stop_seconds FROM finishes")
def _(t):
    laps = R.race_laps(races(t, "Laps")).select("round", "driver_id", F.col("seconds").alias("lap_seconds"))
    return laps.join(R.race_pit_stops(races(t, "PitStops")).select("round", "driver_id", "lap", F.col("seconds").alias("stop_seconds")), ["round", "driver_id"])


@query(
    "a11_race_sessions",
    "WITH r AS (SELECT DISTINCT game_id, date FROM finishes) SELECT game_id AS round, 'race' AS session, CAST(date AS TIMESTAMP) + INTERVAL 15 HOUR AS start FROM r UNION ALL SELECT game_id, 'first_practice', CAST(date - 2 AS TIMESTAMP) + CASE WHEN game_id % 3 <> 0 THEN INTERVAL 870 MINUTE ELSE INTERVAL 0 MINUTE END FROM r UNION ALL SELECT game_id, 'qualifying', CAST(date - 1 AS TIMESTAMP) + CASE WHEN game_id % 3 <> 0 THEN INTERVAL 870 MINUTE ELSE INTERVAL 0 MINUTE END FROM r WHERE game_id % 2 = 0",
)
def _(t):
    return R.race_sessions(races(t)).select("round", "session", F.col("start").cast("timestamp_ntz").alias("start"))


#: drivers of a season's table in one text
PAGE = 100


def standings(t):
    """Championship tables made of the finishes: the drivers in pages of ``PAGE`` ids, the constructors in a text of their own."""
    d = t.finishes.groupBy(F.year("date").alias("season"), "player_id").agg(F.sum("score_to_par").alias("points"), F.count_if(F.col("position") == 1).alias("wins"))
    row = lambda *more: F.struct(F.lit("1").alias("position"), F.col("points").cast("string").alias("points"), F.col("wins").cast("string").alias("wins"), *more)
    team = (F.col("player_id") % 10).cast("string")
    drivers = d.groupBy("season", F.floor(F.col("player_id") / PAGE).alias("page")).agg(F.collect_list(row(F.struct(text("player_id").alias("driverId")).alias("Driver"), F.array(F.struct(F.lit("old").alias("constructorId")), F.struct(team.alias("constructorId"))).alias("Constructors"))).alias("x"))
    teams = d.groupBy("season", team.alias("c")).agg(F.sum("points").alias("points"), F.sum("wins").alias("wins"))
    teams = teams.groupBy("season").agg(F.collect_list(row(F.struct(F.col("c").alias("constructorId")).alias("Constructor"))).alias("x"))

    def answer(rows, kind: str):
        """A text of its own for each page, as providers answer."""
        lists = F.array(F.struct(text("season"), F.lit("1").alias("round"), F.col("x").alias(kind)))
        return landed(rows.select(F.struct(F.struct(lists.alias("StandingsLists")).alias("StandingsTable")).alias("MRData")), R.STANDINGS)

    return answer(drivers, "DriverStandings").unionByName(answer(teams, "ConstructorStandings"))


@query(
    "a11_race_standings",
    "WITH p AS (SELECT year(date) AS season, player_id, sum(score_to_par) AS points, count(CASE WHEN position = 1 THEN 1 END) AS wins FROM finishes GROUP BY 1, 2) SELECT season, 'driver' AS kind, CAST(player_id AS VARCHAR) AS id, CAST(player_id % 10 AS VARCHAR) AS constructor_id, points, wins FROM p UNION ALL SELECT season, 'constructor', CAST(player_id % 10 AS VARCHAR), CAST(player_id % 10 AS VARCHAR), sum(points), CAST(sum(wins) AS BIGINT) FROM p GROUP BY season, player_id % 10",
)
def _(t):
    return R.race_standings(standings(t)).select("season", "kind", "id", "constructor_id", "points", F.col("wins").cast("long").alias("wins"))


@query("a12_play_by_play", "SELECT game_id, CAST(row_number() OVER (PARTITION BY game_id ORDER BY snapshot_time, seq) - 1 AS INT) AS seq, CAST(seq AS VARCHAR) AS id, status AS text, home_score, away_score FROM live_snapshots")
def _(t):
    play = F.struct("snapshot_time", "seq", F.struct(text("seq").alias("id"), "period", F.lit("1:00").alias("clock"), F.col("status").alias("text"), F.lit(True).alias("scoring"), F.col("home_score").cast("int").alias("home_score"), F.col("away_score").cast("int").alias("away_score")).alias("p"))
    d = t.live_snapshots.groupBy(text("game_id")).agg(F.transform(F.sort_array(F.collect_list(play)), lambda x: x["p"]).alias("plays"))
    rows = R.play_by_play(landed(d, R.PLAYS))
    return rows.select(F.col("game_id").cast("long").alias("game_id"), "seq", "id", "text", "home_score", "away_score")


def matches(t):
    g = F.col("game_id")
    maps = F.transform(F.sequence(F.lit(1), (g % 3 + 1).cast("int")), lambda i: F.struct(i.alias("position"), F.concat(F.lit("m"), i.cast("string")).alias("map"), F.when(i % 2 == 1, F.col("home_team_id")).otherwise(F.col("away_team_id")).cast("string").alias("winner"), (i * 100).alias("length")))
    who = F.array(*(F.struct(text(f"{s}_team_id").alias("id"), F.lit(s).alias("name")) for s in ("home", "away")))
    cup = F.struct((g % 40).cast("string").alias("id"), F.concat(F.lit("cup "), (g % 40).cast("string")).alias("name"), F.lit("a").alias("tier"), F.col("date").cast("string").alias("begin_at"), F.date_add("date", 3).cast("string").alias("end_at"))
    d = t.games.select(g.cast("string").alias("id"), "status", who.alias("opponents"), maps.alias("games"), F.when(g % 5 > 0, cup).alias("tournament"), F.struct(F.col("sport").alias("name")).alias("league"))
    return landed(d, R.MATCHES)


@query("a13_esports_maps", "SELECT game_id AS match_id, CAST(home_team_id AS VARCHAR) AS team_a, CAST(away_team_id AS VARCHAR) AS team_b, CAST(i AS INT) AS map_no, 'm' || i AS map, CAST(CASE WHEN i % 2 = 1 THEN home_team_id ELSE away_team_id END AS VARCHAR) AS winner, CAST(i * 100 AS INT) AS seconds FROM games, range(1, 4) r(i) WHERE i <= game_id % 3 + 1")
def _(t):
    return R.esports_maps(matches(t)).select(F.col("match_id").cast("long").alias("match_id"), "team_a", "team_b", "map_no", "map", "winner", "seconds")


@query(
    "a13_esports_tournaments",
    "WITH m AS (SELECT *, CAST(game_id % 40 AS VARCHAR) AS tid FROM games WHERE game_id % 5 > 0), w AS (SELECT tid, home_team_id AS team FROM m UNION SELECT tid, away_team_id FROM m) SELECT m.tid AS tournament_id, 'cup ' || m.tid AS name, max(sport) AS league, min(date) AS begins, max(date) + 3 AS ends, count(*) AS matches, (SELECT count(*) FROM w WHERE w.tid = m.tid) AS teams FROM m GROUP BY m.tid",
)
def _(t):
    return R.esports_tournaments(matches(t)).select("tournament_id", "name", "league", "begins", "ends", "matches", "teams")


@query("a14_labelled_stats", "SELECT game_id, CAST(player_id AS VARCHAR) AS player_id, CAST(floor(pts) AS DOUBLE) AS pts, CAST(reb AS DOUBLE) AS reb, CAST(floor(pts) AS INT) AS fg_made, 99 AS fg_att, CAST(-seq AS DOUBLE) AS plus_minus FROM player_stats")
def _(t):
    n = lambda c: F.floor(c).cast("long").cast("string")
    stats = F.array(n("pts"), F.concat(n("pts"), F.lit("-99")), n("reb"), F.concat(F.lit("-"), n("seq")))
    athlete = F.struct(F.struct(text("player_id").alias("id"), F.lit("n").alias("displayName"), F.struct(F.lit("G").alias("abbreviation")).alias("position")).alias("athlete"), stats.alias("stats"))
    d = t.player_stats.groupBy(text("game_id").alias("eventId")).agg(F.collect_list(athlete).alias("athletes"))
    block = F.struct(F.array(*map(F.lit, ("PTS", "FG", "REB", "+/-"))).alias("labels"), "athletes")
    summary = F.struct(F.struct(F.array(F.struct(F.lit("2024-01-01").alias("date"))).alias("competitions")).alias("header"), F.struct(F.array(F.struct(F.struct(F.lit("T").alias("abbreviation")).alias("team"), F.array(block).alias("statistics"))).alias("players")).alias("boxscore"))
    rows = R.labelled_box(landed(d.select("eventId", summary.alias("summary")), R.ESPN_BOX), ["pts", "reb", "fg_made", "fg_att", "plus_minus"])
    return rows.select(F.col("game_id").cast("long").alias("game_id"), "player_id", "pts", "reb", "fg_made", "fg_att", "plus_minus")


@query("a15_csv_history", "SELECT o_orderkey AS player_id, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_custkey AS DOUBLE) END AS home_runs, o_orderpriority AS team_name FROM orders")
def _(t):
    """Camel-case CSV with blanks and quoted texts, as snake-case columns (a19 as well)."""
    p = path(t, "csv")
    t.base("orders").select(F.col("o_orderkey").alias("playerID"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey").cast("string")).otherwise(" ").alias("HomeRuns"), F.col("o_orderpriority").alias("Team Name")).write.option("header", True).csv(p)
    d = R.snake_columns(R.read_csv(t.spark, p, "playerID long, HomeRuns string, `Team Name` string"), ["home_runs"])
    return d


@query("a16_rss_items", "SELECT 'Item ' || doc_id || ' of ' || source AS title, 'https://news.example.org/' || doc_id AS link, lang AS published, CASE WHEN doc_id % 3 = 0 THEN 'https://img.example.org/' || doc_id END AS media FROM documents")
def _(t):
    """Feeds with an item for each document, some in CDATA, some with markup in the title, some with a picture."""
    i = F.col("doc_id").cast("string")
    title = F.concat(F.lit("Item "), i, F.lit(" of "), F.col("source"))
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<![CDATA["), title, F.lit("]]>"))).otherwise(F.concat(F.lit(" <b>"), title, F.lit("</b> ")))
    media = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<enclosure type="image/png" url="https://img.example.org/'), i, F.lit('"/>'))).otherwise("")
    item = F.concat(F.lit("<item>\n<title>"), title, F.lit("</title><link>https://news.example.org/"), i, F.lit("</link><pubDate>"), F.col("lang"), F.lit("</pubDate>"), media, F.lit("</item>"))
    d = t.base("documents").groupBy("source", "lang", (F.col("doc_id") % 50).alias("part")).agg(F.concat(F.lit("<rss><channel>"), F.concat_ws("\n", F.collect_list(item)), F.lit("</channel></rss>")).alias("xml"))
    return R.rss_items(d, "xml")


@query(
    "a17_newest_predictions",
    "WITH f AS (SELECT sport, date, game_id, home_win_prob, dense_rank() OVER (PARTITION BY sport ORDER BY date DESC) AS r FROM predictions), k AS (SELECT * FROM f WHERE r <= 3 AND NOT (r = 1 AND sport = 'BUILDING')) SELECT sport, date AS file_date, game_id, round(home_win_prob, 6) AS home_win_prob FROM k QUALIFY r = min(r) OVER (PARTITION BY sport)",
)
def _(t):
    """The newest file of one sport is empty, so its next one counts."""
    newest = t.predictions.groupBy("sport").agg(F.max("date").alias("_top"))
    d = t.predictions.join(F.broadcast(newest), "sport")  # a row a sport
    files = d.groupBy("sport", F.col("date").alias("file_date")).agg(F.collect_list(F.when(~((F.col("sport") == "BUILDING") & (F.col("date") == F.col("_top"))), F.struct("game_id", "home_win_prob"))).alias("predictions"))
    return rounded(R.newest_predictions(files))


@query("a20_roster_union", "WITH a AS (SELECT c_nationkey AS team_id, c_name AS name, 'first' AS source FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT c_nationkey AS team_id, c_name AS name, 'second' AS source FROM customer WHERE c_custkey % 2 = 0) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.team_id = b.team_id AND a.name = b.name)")
def _(t):
    """The second provider writes names in another way; a player of both is the first one's row."""
    c = t.base("customer").select(F.col("c_nationkey").alias("team_id"), F.col("c_name").alias("name"), "c_custkey")
    a, b = c.where("c_custkey % 3 > 0").select("team_id", "name", F.lit("first").alias("source")), c.where("c_custkey % 2 = 0").select("team_id", F.upper(F.regexp_replace("name", "#", " - ")).alias("shown"), "name", F.lit("second").alias("source"))
    d = R.roster_union(a.withColumn("shown", F.col("name")), b, "shown")
    return d.select("team_id", "name", "source")


@query("b1_partitioned_write", "SELECT season, CAST(date AS VARCHAR) AS date, count(*) AS n FROM games WHERE season IS NOT NULL AND game_id % 9 > 0 GROUP BY 1, 2")
def _(t):
    """Rows without a season are left out (b2); files are compressed with zstd (b11); the layout gives the columns back."""
    p = path(t, "partitioned")
    Wr.write_partitioned(t.games.withColumn("season", F.when(F.col("game_id") % 9 > 0, F.col("season"))).where("season IS NULL OR season >= 1990").coalesce(2), p, "nba")
    return t.spark.read.parquet(p).groupBy(F.col("season").cast("long").alias("season"), F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


@query("b12_by_date", "SELECT date, sport, count(*) AS n FROM predictions GROUP BY 1, 2")
def _(t):
    p = path(t, "by-date")
    Wr.by_date([t.predictions.where("sport = 'BUILDING'"), t.predictions.where("sport <> 'BUILDING'").drop("away_score")], p)
    return t.spark.read.parquet(p).groupBy("date", "sport").agg(F.count("*").alias("n"))


@query("g3_union_kinds", "SELECT 'team' AS stats_kind, game_id, home_team_id AS id, home_score AS pts FROM games UNION ALL SELECT 'player', game_id, player_id, pts FROM player_stats")
def _(t):
    team = t.games.select("game_id", F.col("home_team_id").alias("id"), F.col("home_score").alias("pts"))
    return G.union_kinds({"team": team, "player": t.player_stats.select("game_id", F.col("player_id").alias("id"), "pts")})


@query("g4_first_existing", "SELECT game_id, status FROM games WHERE season = 1996")
def _(t):
    """The alias that is there, of a table that may go by several names."""
    tables = {"games": t.games}
    return G.first_existing(*(tables.get(n) for n in ("schedule", "fixtures", "games"))).where("season = 1996").select("game_id", "status")


@query("l7_live_features", "SELECT * FROM (VALUES ('reb'), ('pts'), ('ast')) v(feature)")
def _(t):
    """Of six features, those that are neither constant, nor almost all zero, nor mostly missing."""
    d = t.player_stats.withColumns({"one": F.lit(1.0), "rare": F.when(F.col("game_id") % 997 == 0, 1.0).otherwise(0.0), "missing": F.when(F.col("game_id") % 3 == 0, F.col("pts"))})
    return t.spark.createDataFrame([(f,) for f in Q.live_features(d, ["pts", "reb", "ast", "one", "rare", "missing"])], "feature string")
