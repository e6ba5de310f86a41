"""Readers of landed provider files: drifting parquet, nested JSON, matrices, CSV, RSS, prediction files.

Everything is a declared schema plus ``explode``; no Python runs on rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.scalars import compass, iso_minutes, snake

# ---------------------------------------------------------------- curated parquet


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in their types: absent ones null, others cast where they can be."""
    have = set(df.columns)
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def scan(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Partitions whose columns drifted, united by name in the registry's types."""
    return reduce(lambda a, b: a.unionByName(b), (conform(spark.read.parquet(p), schema) for p in paths))


def load(spark: SparkSession, path: str, season: int | str | None = None, where: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A partitioned table with a typed season filter (so partitions are pruned), a predicate and a projection."""
    df = spark.read.parquet(path)
    df = in_season(df, season)
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def in_season(df: DataFrame, season: int | str | None) -> DataFrame:
    """``all``, a season, or (None) the newest season that has completed games, else everything."""
    if season == "all" or "season" not in df.columns:
        return df
    if season is None:
        done = df.where("home_score IS NOT NULL") if "home_score" in df.columns else df
        season = done.agg(F.max("season")).first()[0]
        return df if season is None else df.where(F.col("season") == season)
    return df.where(F.col("season") == season)


def seasons(df: DataFrame) -> DataFrame:
    return df.select("season").distinct()


def with_lineage(df: DataFrame) -> DataFrame:
    """The category folder of each row's file."""
    return df.withColumn("raw_category", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/=]+)/(?:[^/=]+=[^/]*/)*[^/]+$", 1))


def inventory(df: DataFrame, keys: list[str]) -> DataFrame:
    """Files and their newest modification time per key."""
    m = df.select(*keys, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_modification_time").alias("_t"))
    return m.groupBy(*keys).agg(F.count_distinct("_f").alias("files"), F.max("_t").alias("newest"))


# ---------------------------------------------------------------- nested payloads

PLAYER = "struct<personId:long,name:string,position:string,statistics:struct<minutes:string,points:int,rebounds:int,assists:int>>"
BOX = f"game struct<gameId:string,gameEt:string,homeTeam:struct<teamId:long,players:array<{PLAYER}>>,awayTeam:struct<teamId:long,players:array<{PLAYER}>>>"


def box_score_players(df: DataFrame) -> DataFrame:
    """Player-game rows of nested box scores, both sides."""
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"game.{s}Team.teamId").alias("team_id"), F.col(f"game.{s}Team.players").alias("players"))
    d = df.select("game.gameId", F.explode(F.array(side("home"), side("away"))).alias("t")).select("gameId", "t.side", "t.team_id", F.explode("t.players").alias("p"))
    s = F.col("p.statistics")
    return d.select(F.col("gameId").alias("game_id"), "side", "team_id", F.col("p.personId").alias("player_id"), F.col("p.name").alias("name"), F.col("p.position").alias("position"), iso_minutes(s["minutes"]).alias("minutes"), s["points"].alias("pts"), s["rebounds"].alias("reb"), s["assists"].alias("ast"))


def matrix(df: DataFrame, headers: str, rows: str, keys: list[str]) -> DataFrame:
    """Header + rows matrices as tables of the wanted (snake-case) columns."""
    d = df.select(F.transform(headers, lambda h: F.lower(h)).alias("h"), F.explode(rows).alias("r"))
    m = F.map_from_arrays("h", "r")
    return d.select(m.alias("m")).select(*(F.get(F.array(F.col("m")[k]), F.lit(0)).alias(k) for k in keys))


MARKETS = "id string, bookmakers array<struct<key:string,last_update:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>"


def bookmaker_props(df: DataFrame) -> DataFrame:
    """Bookmaker, market and outcome levels as rows with a composite id."""
    d = df.select("id", F.explode("bookmakers").alias("b")).select("id", "b.key", "b.last_update", F.explode("b.markets").alias("m")).select("id", "key", "last_update", F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o"))
    pid = F.concat_ws("_", "id", "key", "market", "o.name", F.col("o.point").cast("string"))
    return d.select(pid.alias("prop_id"), F.col("id").alias("game_id"), F.col("key").alias("bookmaker"), "market", F.col("o.name").alias("outcome"), F.col("o.price").alias("price"), F.col("o.point").alias("point"), "last_update")


def freshest_lines(props: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """One wide row per game and enabled bookmaker, updated when its newest entry was."""
    d = props.where(F.col("bookmaker").isin(*enabled)) if enabled else props
    pick = lambda m, o, v: F.max_by(F.when((F.col("market") == m) & (F.col("outcome") == o), F.col(v)), F.when((F.col("market") == m) & (F.col("outcome") == o), F.col("last_update")))
    return d.groupBy("game_id", "bookmaker").agg(
        pick("h2h", "home", "price").alias("h2h_home"), pick("h2h", "away", "price").alias("h2h_away"), pick("spreads", "home", "point").alias("spread_home"), pick("spreads", "away", "point").alias("spread_away"),
        pick("totals", "over", "point").alias("total_line"), pick("totals", "over", "price").alias("total_over"), F.max("last_update").alias("updated_at"),
    )


def depth_chart(df: DataFrame, team: str, chart: str) -> DataFrame:
    """Position -> ordered athletes as rows with a rank from 1."""
    return df.select(team, F.explode(chart).alias("position", "names")).select(team, "position", F.posexplode("names").alias("i", "athlete")).select(team, "position", (F.col("i") + 1).alias("rank"), "athlete")


RACES = "MRData struct<RaceTable:struct<season:string,Races:array<struct<season:string,round:string,raceName:string,Circuit:struct<circuitId:string,circuitName:string>,date:string,Results:array<struct<position:string,points:string,grid:string,laps:string,status:string,Driver:struct<driverId:string,givenName:string,familyName:string>,Constructor:struct<constructorId:string>>>,Laps:array<struct<number:string,Timings:array<struct<driverId:string,position:string,time:string>>>>,PitStops:array<struct<driverId:string,stop:string,lap:string,duration:string>>,QualifyingResults:array<struct<position:string,Q1:string,Q2:string,Q3:string,Driver:struct<driverId:string>,Constructor:struct<constructorId:string>>>,FirstPractice:struct<date:string,time:string>,SecondPractice:struct<date:string,time:string>,ThirdPractice:struct<date:string,time:string>,Qualifying:struct<date:string,time:string>,Sprint:struct<date:string,time:string>,time:string>>>>"
STANDINGS = "MRData struct<StandingsTable:struct<StandingsLists:array<struct<season:string,round:string,DriverStandings:array<struct<position:string,points:string,wins:string,Driver:struct<driverId:string>,Constructors:array<struct<constructorId:string>>>>,ConstructorStandings:array<struct<position:string,points:string,wins:string,Constructor:struct<constructorId:string>>>>>>>"


def _races(df: DataFrame) -> DataFrame:
    # outer: for a plain explode Spark adds a filter on the size of the array, for which each text is parsed again
    r = df.select(F.explode_outer("MRData.RaceTable.Races").alias("r")).where("r IS NOT NULL")
    return r.select(F.col("r.season").try_cast("int").alias("season"), F.col("r.round").try_cast("int").alias("round"), F.col("r.Circuit.circuitId").alias("circuit_id"), F.to_date("r.date").alias("date"), "r")


def race_results(df: DataFrame) -> DataFrame:
    d = _races(df).select("season", "round", "circuit_id", "date", F.explode("r.Results").alias("x"))
    name = F.concat_ws(" ", "x.Driver.givenName", "x.Driver.familyName")
    return d.select("season", "round", "circuit_id", "date", F.col("x.Driver.driverId").alias("driver_id"), name.alias("driver"), F.col("x.Constructor.constructorId").alias("constructor_id"), *(F.col(f"x.{c}").try_cast(t).alias(c) for c, t in (("position", "int"), ("grid", "int"), ("laps", "int"), ("points", "double"))), F.col("x.status").alias("status"))


def race_laps(df: DataFrame) -> DataFrame:
    d = _races(df).select("season", "round", F.explode("r.Laps").alias("l")).select("season", "round", F.col("l.number").try_cast("int").alias("lap"), F.explode("l.Timings").alias("t"))
    m, s = F.split("t.time", ":")[0].try_cast("double"), F.get(F.split("t.time", ":"), F.lit(1)).try_cast("double")
    return d.select("season", "round", "lap", F.col("t.driverId").alias("driver_id"), F.col("t.position").try_cast("int").alias("position"), (m * 60 + s).alias("seconds"))


def race_pit_stops(df: DataFrame) -> DataFrame:
    d = _races(df).select("season", "round", F.explode("r.PitStops").alias("p"))
    return d.select("season", "round", F.col("p.driverId").alias("driver_id"), F.col("p.stop").try_cast("int").alias("stop"), F.col("p.lap").try_cast("int").alias("lap"), F.col("p.duration").try_cast("double").alias("seconds"))


def lap_seconds(text) -> Column:
    """Seconds of ``1:23.456`` or ``83.456``."""
    part = F.split(text, ":")
    return F.when(F.size(part) > 1, F.get(part, F.lit(0)).try_cast("double") * 60 + F.get(part, F.lit(1)).try_cast("double")).otherwise(F.get(part, F.lit(0)).try_cast("double"))


def race_qualifying(df: DataFrame) -> DataFrame:
    """Grid position and the times of the three parts; ``best`` is the time of the last part that was driven."""
    d = _races(df).select("season", "round", "circuit_id", F.explode("r.QualifyingResults").alias("q"))
    d = d.select("season", "round", "circuit_id", F.col("q.Driver.driverId").alias("driver_id"), F.col("q.Constructor.constructorId").alias("constructor_id"), F.col("q.position").try_cast("int").alias("position"), *(lap_seconds(F.col(f"q.Q{i}")).alias(f"q{i}") for i in (1, 2, 3)))
    return d.withColumn("best", F.coalesce("q3", "q2", "q1"))


#: fixed values: sessions of a race weekend, in order
SESSIONS = ("FirstPractice", "SecondPractice", "ThirdPractice", "Sprint", "Qualifying")


def race_sessions(df: DataFrame) -> DataFrame:
    """A row for each session that a weekend has, and the race itself, with its start (dates without a time begin at midnight)."""
    start = lambda d, t: F.coalesce(F.try_to_timestamp(F.concat_ws(" ", d, F.regexp_replace(t, "Z$", ""))), F.to_timestamp(d))
    one = lambda name, d, t: F.struct(F.lit(name).alias("session"), start(d, t).alias("start"))
    all_ = F.array(*(one(snake_name(n), F.col(f"r.{n}.date"), F.col(f"r.{n}.time")) for n in SESSIONS), one("race", F.col("r.date"), F.col("r.time")))
    return _races(df).select("season", "round", "circuit_id", F.explode(all_).alias("s")).select("season", "round", "circuit_id", "s.*").where("start IS NOT NULL")


def snake_name(name: str) -> str:
    from re import sub

    return sub(r"([a-z])([A-Z])", r"\1_\2", name).lower()


def race_standings(df: DataFrame) -> DataFrame:
    """Championship tables after a round: drivers (with their last constructor) and constructors as one table with ``kind``."""
    d = df.select(F.explode_outer("MRData.StandingsTable.StandingsLists").alias("l")).where("l IS NOT NULL").select(F.col("l.season").try_cast("int").alias("season"), F.col("l.round").try_cast("int").alias("round"), "l")
    numbers = lambda x: [F.col(f"{x}.position").try_cast("int").alias("position"), F.col(f"{x}.points").try_cast("double").alias("points"), F.col(f"{x}.wins").try_cast("int").alias("wins")]
    a = d.select("season", "round", F.explode("l.DriverStandings").alias("x")).select("season", "round", F.lit("driver").alias("kind"), F.col("x.Driver.driverId").alias("id"), F.try_element_at("x.Constructors", F.lit(-1))["constructorId"].alias("constructor_id"), *numbers("x"))
    b = d.select("season", "round", F.explode("l.ConstructorStandings").alias("x")).select("season", "round", F.lit("constructor").alias("kind"), F.col("x.Constructor.constructorId").alias("id"), F.col("x.Constructor.constructorId").alias("constructor_id"), *numbers("x"))
    return a.unionByName(b)


PLAYS = "game_id string, plays array<struct<id:string,period:int,clock:string,text:string,scoring:boolean,home_score:int,away_score:int>>"


def play_by_play(df: DataFrame) -> DataFrame:
    return df.select("game_id", F.posexplode("plays").alias("seq", "p")).select("game_id", "seq", "p.*")


MATCHES = "id string, status string, opponents array<struct<id:string,name:string>>, games array<struct<position:int,map:string,winner:string,length:int>>, tournament struct<id:string,name:string,tier:string,begin_at:string,end_at:string>, league struct<name:string>"


def esports_maps(df: DataFrame) -> DataFrame:
    """A row per map with both opponents."""
    a, b = F.get("opponents", F.lit(0)), F.get("opponents", F.lit(1))
    d = df.select("id", "status", a["id"].alias("team_a"), b["id"].alias("team_b"), F.explode("games").alias("g"))
    return d.select(F.col("id").alias("match_id"), "status", "team_a", "team_b", F.col("g.position").alias("map_no"), F.col("g.map").alias("map"), F.col("g.winner").alias("winner"), F.col("g.length").alias("seconds"))


def esports_rosters(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("match_id"), F.posexplode("opponents").alias("slot", "o")).select("match_id", "slot", F.col("o.id").alias("team_id"), F.col("o.name").alias("name"))


def esports_tournaments(df: DataFrame) -> DataFrame:
    """A row a tournament with its dates, the teams that are drawn in it, and its matches."""
    d = df.where("tournament.id IS NOT NULL").select("tournament", "league.name", "id", "opponents.id")
    d = d.toDF("t", "league", "match", "teams")
    t = d.groupBy(F.col("t.id").alias("tournament_id")).agg(
        F.max("t.name").alias("name"), F.max("league").alias("league"), F.max("t.tier").alias("tier"), F.to_date(F.min("t.begin_at")).alias("begins"), F.to_date(F.max("t.end_at")).alias("ends"), F.count_distinct("match").alias("matches")
    )
    n = d.select(F.col("t.id").alias("tournament_id"), F.explode("teams").alias("team")).groupBy("tournament_id").agg(F.count_distinct("team").alias("teams"))
    return t.join(n, "tournament_id", "left").withColumn("teams", F.coalesce("teams", F.lit(0)))


#: fixed values: labels that name the same stat
LABELS = {"FG": "fg", "FGMA": "fg", "3PT": "fg3", "FG3": "fg3", "FT": "ft", "REB": "reb", "TREB": "reb", "AST": "ast", "PTS": "pts", "STL": "stl", "BLK": "blk", "TO": "tov", "TOV": "tov", "MIN": "minutes", "OREB": "oreb", "DREB": "dreb", "PF": "fouls", "PLUSMINUS": "plus_minus", "": "plus_minus"}


def labelled_stats(labels: Column, values: Column, stats: list[str]) -> list[Column]:
    """Wanted stats of label/value arrays: labels folded to letters and digits, ``made-att`` pairs split in two."""
    clean = F.transform(labels, lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", ""))
    names = F.create_map(*(v for k, n in LABELS.items() for v in (F.lit(k), F.lit(n))))
    keys = F.transform(clean, lambda x: F.coalesce(F.element_at(names, x), F.lower(x)))
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: p["k"].isNotNull())
    get = lambda s: F.get(F.filter(pairs, lambda p: p["k"] == s), F.lit(0))["v"]
    out = []
    for s in stats:
        if s.endswith("_made") or s.endswith("_att"):
            out.append(F.get(F.split(get(s.rsplit("_", 1)[0]), "-"), F.lit(0 if s.endswith("_made") else 1)).try_cast("int").alias(s))
        else:
            out.append(F.regexp_replace(get(s), r"^\+", "").try_cast("double").alias(s))
    return out


ESPN_BOX = "eventId string, summary struct<header:struct<competitions:array<struct<date:string>>>,boxscore:struct<players:array<struct<team:struct<abbreviation:string>,statistics:array<struct<labels:array<string>,athletes:array<struct<athlete:struct<id:string,displayName:string,position:struct<abbreviation:string>>,stats:array<string>>>>>>>>>"


def labelled_box(df: DataFrame, stats: list[str]) -> DataFrame:
    d = df.select(F.col("eventId").alias("game_id"), F.get("summary.header.competitions", F.lit(0))["date"].alias("start_time"), F.explode("summary.boxscore.players").alias("t"))
    d = d.select("game_id", "start_time", F.col("t.team.abbreviation").alias("team"), F.explode("t.statistics").alias("s")).select("game_id", "start_time", "team", F.col("s.labels").alias("labels"), F.explode("s.athletes").alias("a"))
    return d.select("game_id", "start_time", "team", F.col("a.athlete.id").alias("player_id"), F.col("a.athlete.displayName").alias("name"), F.col("a.athlete.position.abbreviation").alias("position"), *labelled_stats(F.col("labels"), F.col("a.stats"), stats))


# ---------------------------------------------------------------- text formats


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def snake_columns(df: DataFrame, numbers: list[str] = ()) -> DataFrame:
    """Columns renamed to snake case; the named ones as numbers, blanks as null."""
    from re import sub

    names = [sub(r"[^a-z0-9]+", "_", sub(r"([a-z0-9])([A-Z])", r"\1_\2", c).lower()).strip("_") for c in df.columns]
    d = df.toDF(*names)
    return d.select(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).try_cast("double").alias(c) if c in numbers else F.col(c) for c in names))


def rss_items(df: DataFrame, text: str) -> DataFrame:
    """Items of RSS texts: title, link, date and media address."""
    item = F.explode(F.regexp_extract_all(text, F.lit(r"(?s)<item[^>]*>(.*?)</item>"), 1)).alias("i")
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_extract("i", rf"(?s)<{t}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{t}>", 1), "<[^>]+>", ""))
    media = F.regexp_extract("i", r"<(?:media:content|enclosure)[^>]*url=\"([^\"]+)\"", 1)
    return df.select(item).select(tag("title").alias("title"), tag("link").alias("link"), tag("pubDate").alias("published"), F.nullif(media, F.lit("")).alias("media"))


def newest_predictions(df: DataFrame, most_files: int = 3) -> DataFrame:
    """Per sport, rows of the first non-empty of its newest files (file_date, predictions array)."""
    w = W.partitionBy("sport").orderBy(F.desc("file_date"))
    d = df.withColumn("_r", F.dense_rank().over(w)).where((F.col("_r") <= most_files) & (F.size("predictions") > 0))
    d = d.withColumn("_m", F.min("_r").over(W.partitionBy("sport"))).where("_r = _m")
    return d.select("sport", "file_date", F.explode("predictions").alias("p")).select("sport", "file_date", "p.*")


# ---------------------------------------------------------------- blends


def weather_blend(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two providers' weather: temperature as the mean of extremes, wind direction as a compass point; the first wins."""
    x = a.select("game_id", ((F.col("temp_min") + F.col("temp_max")) / 2).alias("temperature"), "wind_speed", compass("wind_degrees").alias("wind"), F.lit(1).alias("_p"))
    y = b.select("game_id", "temperature", "wind_speed", "wind", F.lit(2).alias("_p"))
    d = x.unionByName(y)
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_p")))
    return d.groupBy("game_id").agg(*(pick(c).alias(c) for c in ("temperature", "wind_speed", "wind")))


def roster_union(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """Rosters of two providers, a player of a team once, the first provider's row."""
    d = a.withColumn("_p", F.lit(1)).unionByName(b.withColumn("_p", F.lit(2)), allowMissingColumns=True)
    w = W.partitionBy("team_id", snake(name)).orderBy("_p", name)
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_p")


def first_fetched(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of a key in load order."""
    w = W.partitionBy(key).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
