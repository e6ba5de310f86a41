"""Long team rows, rollups, joins and catalogs over games."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.scalars import fold, ratio


def col_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or typed nulls where the frame lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def completed() -> Column:
    """Final by status, or with both scores."""
    return F.lower("status").contains("final") | (F.col("home_score").isNotNull() & F.col("away_score").isNotNull())


def team_games(games: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per team and game (both sides from one scan): pf, pa, win, is_home, opp, completed, and columns to carry."""
    def side(me: str, other: str) -> Column:
        return F.struct(
            F.col(f"{me}_team_id").alias("team_id"), F.col(f"{other}_team_id").alias("opp_id"), F.lit(me == "home").alias("is_home"),
            F.col(f"{me}_score").alias("pf"), F.col(f"{other}_score").alias("pa"),
        )

    sides = games.withColumn("_x", F.explode(F.array(side("home", "away"), side("away", "home"))))
    out = sides.select("game_id", "sport", "date", "season", "status", completed().alias("completed"), "_x.*", *carry)
    return out.withColumn("win", F.when(F.col("pf") > F.col("pa"), 1).when(F.col("pf").isNotNull() & F.col("pa").isNotNull(), 0))


# ---------------------------------------------------------------- rollups


def team_season_rollup(games: DataFrame) -> DataFrame:
    """Record, averages and margin per season and team over final games."""
    tg = team_games(games.where(F.lower("status").contains("final")))
    return tg.groupBy("season", "team_id").agg(
        F.count("*").alias("games"), F.sum("win").alias("wins"), F.sum(1 - F.col("win")).alias("losses"),
        F.avg("pf").alias("avg_for"), F.avg("pa").alias("avg_against"), F.avg(F.col("pf") - F.col("pa")).alias("avg_margin"), F.max("date").alias("as_of"),
    )


def standings(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Season table with record text, win share, rank in the conference and games behind its best."""
    r = team_season_rollup(games).join(teams.select("team_id", "name", "conference"), "team_id")
    r = r.withColumn("pct", ratio("wins", "games"))
    w = W.partitionBy("season", "conference")
    behind = (F.max("pct").over(w) - F.col("pct")) * F.col("games") / 2
    rank = F.row_number().over(w.orderBy(F.desc("pct"), F.desc("wins"), "team_id"))
    return r.select("season", "conference", "team_id", "name", F.concat_ws("-", F.col("wins").cast("string"), F.col("losses").cast("string")).alias("record"), "pct", rank.alias("rank"), behind.alias("games_behind"))


def recent_form(games: DataFrame, spans: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Wins, games and averages of each team's last n final games, newest first by (date, game id)."""
    tg = team_games(games.where(F.lower("status").contains("final")))
    w = W.partitionBy("team_id").orderBy(F.desc("date"), F.desc("game_id"))
    tg = tg.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(spans))
    aggs = []
    for n in spans:
        inside = F.col("rn") <= n
        aggs += [
            F.sum(F.when(inside, F.col("win"))).alias(f"wins_{n}"), F.count_if(inside).alias(f"games_{n}"), F.avg(F.when(inside, F.col("pf") - F.col("pa"))).alias(f"margin_{n}"),
            F.avg(F.when(inside, F.col("pf"))).alias(f"for_{n}"), F.avg(F.when(inside, F.col("pa"))).alias(f"against_{n}"),
        ]
    return tg.groupBy("team_id").agg(*aggs, F.max("date").alias("last_date"))


def season_averages(df: DataFrame, keys: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """Averages of every numeric column but the keys, in one aggregation."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in {*keys, *skip}]
    return df.groupBy(*keys).agg(F.count("*").alias("games"), *(F.avg(c).alias(f"avg_{c}") for c in numbers))


def entity_averages(players: DataFrame, metrics: list[str]) -> DataFrame:
    """Season averages of players and teams in one table with entity_type."""
    def of(kind: str, key: str) -> DataFrame:
        return players.groupBy("season", F.col(key).alias("entity_id")).agg(*(F.avg(m).alias(f"avg_{m}") for m in metrics)).withColumn("entity_type", F.lit(kind))

    return of("player", "player_id").unionByName(of("team", "team_id"))


def player_totals(players: DataFrame, sums: list[str], means: list[str]) -> DataFrame:
    """Per player: distinct games, the latest team, sums of counts and means of rates, rounded."""
    last = F.max_by("team_id", F.struct("date", "game_id", "seq"))
    return players.groupBy("player_id").agg(
        F.count_distinct("game_id").alias("games"), last.alias("team_id"), *(F.round(F.sum(c), 2).alias(f"total_{c}") for c in sums), *(F.round(F.avg(c), 4).alias(f"mean_{c}") for c in means)
    )


def best_source(players: DataFrame, fields: list[str]) -> DataFrame:
    """The source whose rows of a player are fullest on average."""
    full = reduce(lambda a, b: a + b, (F.col(f).isNotNull().cast("int") for f in fields))
    by = players.groupBy("player_id", "source").agg(F.avg(full).alias("fullness"), F.count("*").alias("rows"))
    w = W.partitionBy("player_id").orderBy(F.desc("fullness"), F.desc("rows"), "source")
    return by.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def canonical_names(df: DataFrame, name: str) -> DataFrame:
    """One spelling per folded name: the longest, then the last in order."""
    return df.groupBy(fold(name).alias("key")).agg(F.max_by(name, F.struct(F.length(name), F.col(name))).alias("name"), F.count_distinct(name).alias("spellings"))


def team_from_players(players: DataFrame, stats: list[str]) -> DataFrame:
    """Team totals from player rows."""
    return players.groupBy("season", "team_id").agg(F.count_distinct("game_id").alias("games"), F.count_distinct("player_id").alias("players"), *(F.sum(s).alias(f"total_{s}") for s in stats), *(F.avg(s).alias(f"avg_{s}") for s in stats))


def player_advanced(players: DataFrame, stats: list[str]) -> DataFrame:
    """Average, total and best of each stat."""
    return players.groupBy("player_id").agg(*(f(s).alias(f"{n}_{s}") for s in stats for n, f in (("avg", F.avg), ("total", F.sum), ("max", F.max))))


def value_sets(df: DataFrame, key: str, value: str, sep: str = ",") -> DataFrame:
    """Distinct values of each key as sorted text, with their number."""
    s = F.sort_array(F.collect_set(F.col(value).cast("string")))
    return df.groupBy(key).agg(F.array_join(s, sep).alias("values"), F.size(s).alias("n_values"), F.count("*").alias("n_rows"))


def win_loss_ranking(games: DataFrame, most: int = 100) -> DataFrame:
    """Tally of wins and losses over decided games, ranked."""
    decided = games.where("home_score IS NOT NULL AND away_score IS NOT NULL AND home_score <> away_score")
    home = F.col("home_score") > F.col("away_score")
    sides = F.explode(F.array(F.struct(F.when(home, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("team_id"), F.lit(1).alias("won")), F.struct(F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id")).alias("team_id"), F.lit(0).alias("won"))))
    t = decided.select("sport", sides.alias("x")).groupBy("sport", "x.team_id").agg(F.sum("x.won").alias("wins"), F.sum(1 - F.col("x.won")).alias("losses"))
    w = W.partitionBy("sport").orderBy(F.desc("wins"), "losses", "team_id")
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def weighted_rates(players: DataFrame, weight: str, rates: list[str], keys: list[str]) -> DataFrame:
    """Rates averaged with weights."""
    return players.groupBy(*keys).agg(F.sum(weight).alias(f"total_{weight}"), *((F.sum(F.col(r) * F.col(weight)) / F.sum(weight)).alias(f"w_{r}") for r in rates))


def prop_thresholds(players: DataFrame, stat: str, least: int = 20) -> DataFrame:
    """Quantiles of a stat for players with enough rows."""
    q = [("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9)]
    return players.groupBy("player_id").agg(F.count(stat).alias("samples"), F.avg(stat).alias("mean"), *(F.percentile(stat, v).alias(n) for n, v in q)).where(F.col("samples") >= least)


def market_rates(games: DataFrame, total: float = 180.0, each: float = 80.0) -> DataFrame:
    """Season shares of outcomes per sport: both above a score, draws, overs, home wins."""
    done = games.where("home_score IS NOT NULL AND away_score IS NOT NULL")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    h, a = F.col("home_score"), F.col("away_score")
    return done.groupBy("sport", "season").agg(
        F.count("*").alias("games"), share((h >= each) & (a >= each)).alias("both_score"), share(h == a).alias("draw"), share(h + a > total).alias("over"), share(h > a).alias("home_win"), share(F.abs(h - a) <= 5).alias("close"),
    )


def team_strength(games: DataFrame, exponent: float = 13.91, half: float = 10.0) -> DataFrame:
    """Rating 1-99: Pythagorean, win share and recent form, drawn to 50 while few games are played."""
    r = team_games(games.where(F.lower("status").contains("final"))).groupBy("team_id").agg(F.count("*").alias("games"), F.sum("pf").alias("pf"), F.sum("pa").alias("pa"), F.avg("win").alias("pct"))
    r = r.join(recent_form(games, (10,)).select("team_id", (F.col("wins_10") / F.col("games_10")).alias("recent")), "team_id")
    pyth = 1 / (1 + F.pow(F.col("pa") / F.col("pf"), exponent))
    blend = 0.5 * pyth + 0.3 * F.col("pct") + 0.2 * F.col("recent")
    trust = F.col("games") / (F.col("games") + half)
    return r.select("team_id", "games", F.greatest(F.least(50 + (blend - 0.5) * 98 * trust, F.lit(99.0)), F.lit(1.0)).alias("rating"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins, empty ones kept; the last is closed."""
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    x = df.where(F.col(value).isNotNull()).join(F.broadcast(edges))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(0)
    n = x.groupBy(b.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    all_ = df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(F.broadcast(edges))
    return all_.join(n, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def correlations(df: DataFrame, fields: list[str]) -> DataFrame:
    """Pearson's correlation of each pair of fields over rows that have all."""
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    one = df.na.drop(subset=fields).agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs))).alias("x")).select("x.*")


def modal(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value of each key, the smaller on ties, and its share."""
    n = df.groupBy(key, value).count()
    w = W.partitionBy(key).orderBy(F.desc("count"), value)
    return n.withColumn("_r", F.row_number().over(w)).withColumn("share", F.col("count") / F.sum("count").over(W.partitionBy(key))).where("_r = 1").select(key, F.col(value).alias("mode"), "share")


def distinct_entities(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """Values of several candidate columns as one dimension, first seen by name."""
    names = F.explode(F.array(*(F.col(c).cast("string") for c in columns)))
    flat = df.select(names.alias("raw")).where("raw IS NOT NULL")
    each = flat.select(F.explode(F.split("raw", r"\s*[,;/]\s*")).alias("name")).where("trim(name) <> ''")
    return each.groupBy(fold("name").alias("key")).agg(F.min("name").alias("name"), F.count("*").alias("seen")).withColumn("kind", F.lit(kind))


# ---------------------------------------------------------------- joins


def game_core(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Games with both teams' names; games of unknown teams stay."""
    t = teams.dropDuplicates(["team_id"]).select("team_id", "name", "conference")
    home = t.select(F.col("team_id").alias("home_team_id"), F.col("name").alias("home_name"), F.col("conference").alias("home_conference"))
    away = t.select(F.col("team_id").alias("away_team_id"), F.col("name").alias("away_name"), F.col("conference").alias("away_conference"))
    return games.join(home, "home_team_id", "left").join(away, "away_team_id", "left")


def with_stats(games: DataFrame, stats: DataFrame, on: str = "game_id") -> DataFrame:
    """Games with a stats table; columns the games already have are dropped from it."""
    extra = [c for c in stats.columns if c == on or c not in games.columns]
    return games.join(stats.select(*extra), on, "left")


def latest_odds(odds: DataFrame) -> DataFrame:
    """Newest tick per game and bookmaker by (ts, seq, tie)."""
    return odds.groupBy("game_id", "bookmaker").agg(F.max_by(F.struct(*(c for c in odds.columns if c not in ("game_id", "bookmaker"))), F.struct("ts", "seq", "tie")).alias("x")).select("game_id", "bookmaker", "x.*")


def daily_snapshot(games: DataFrame, odds: DataFrame) -> DataFrame:
    """Games with every bookmaker's latest lines."""
    return games.join(latest_odds(odds), "game_id", "left").withColumn("snapshot_date", F.coalesce(F.to_date("ts"), F.col("date")))


def backfill_names(df: DataFrame, teams: DataFrame, name: str = "name") -> DataFrame:
    """Blank or missing names from the team table."""
    t = teams.select("team_id", F.col("name").alias("_t"))
    return df.join(t, "team_id", "left").withColumn(name, F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.col("_t"))).drop("_t")


def match_odds(games: DataFrame, odds: DataFrame, keys: list[str]) -> DataFrame:
    """Lines by game id, else by natural keys for the games that had none; of several lines without an id the smallest row."""
    direct = games.join(odds.drop(*keys), "game_id").withColumn("matched_by", F.lit("id"))
    rest = games.join(odds.select("game_id"), "game_id", "left_anti")
    others = [c for c in odds.columns if c not in ("game_id", *keys)]
    lines = odds.where("game_id IS NULL").groupBy(*keys).agg(F.min(F.struct(*others)).alias("_l")).select(*keys, "_l.*")
    natural = rest.join(lines, keys).withColumn("matched_by", F.lit("keys"))
    return direct.unionByName(natural, allowMissingColumns=True)


def event_key(date: str, a: str, b: str) -> list[Column]:
    return [F.col(date).alias("date"), F.least(a, b).alias("team_lo"), F.greatest(a, b).alias("team_hi")]


def reconcile_ids(games: DataFrame) -> DataFrame:
    """Unordered event keys and whether they name one game, several or none."""
    g = games.groupBy(*event_key("date", "home_team_id", "away_team_id")).agg(F.sort_array(F.collect_set("game_id")).alias("ids"))
    n = F.size("ids")
    return g.select("date", "team_lo", "team_hi", n.alias("candidates"), F.when(n == 1, "single").when(n > 1, "multiple").otherwise("none").alias("status"), F.when(n == 1, F.get("ids", F.lit(0))).alias("game_id"))


def bridge_ids(a: DataFrame, b: DataFrame, name: str, a_id: str, b_id: str) -> DataFrame:
    """Ids of provider b for those of a by majority of shared (folded) names."""
    left = a.select(fold(name).alias("k"), F.col(a_id).alias("a_id")).distinct()
    right = b.select(fold(name).alias("k"), F.col(b_id).alias("b_id")).distinct()
    votes = left.join(right, "k").groupBy("a_id", "b_id").count()
    w = W.partitionBy("a_id").orderBy(F.desc("count"), "b_id")
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("a_id", "b_id", F.col("count").alias("votes"))


def normal_team_ids(df: DataFrame, known: DataFrame, raw: str) -> DataFrame:
    """Short abbreviations as they are, provider numbers by a map (numeric_id, team_id); all else is blank."""
    t = F.col(raw)
    short = (F.length(t) <= 5) & ~t.rlike("^[0-9]+$")
    d = df.join(known.select(F.col("numeric_id").alias(raw), F.col("team_id").alias("_mapped")), raw, "left")
    return d.withColumn("team_id", F.when(short, t).otherwise(F.coalesce("_mapped", F.lit("")))).drop("_mapped")


def venue_constants(games: DataFrame, parks: dict[str, float], altitudes: dict[str, float], venue: str = "venue", stage: str = "stage") -> DataFrame:
    """Park factor (1 elsewhere) and altitude (0 elsewhere) of the first key in the venue's name, and whether a tournament stage is named."""
    v = F.replace(F.lower(F.coalesce(F.col(venue), F.lit(""))), F.lit(" "), F.lit("_"))

    def of(table: dict[str, float], default: float) -> Column:
        out = F.lit(default)
        for k, x in reversed(table.items()):
            out = F.when(v.contains(k), F.lit(x)).otherwise(out)
        return out

    named = ~F.lower(F.coalesce(F.col(stage), F.lit(""))).isin("", "nan", "none")
    return games.select("*", of(parks, 1.0).alias("park_factor"), of(altitudes, 0.0).alias("altitude"), F.when(named, 1.0).otherwise(0.0).alias("tournament"))


def fill_ids(df: DataFrame, known: DataFrame, name: str, id_col: str) -> DataFrame:
    """Missing ids from a name map; for the rest a synthetic id that is the same in every run."""
    m = known.groupBy(fold(name).alias("_k")).agg(F.min(F.col(id_col).cast("string")).alias("_m"))
    made = F.concat(F.lit("syn_"), F.pmod(F.xxhash64(fold(name)), F.lit(100000)).cast("string"))
    d = df.withColumn("_k", fold(name)).join(m, "_k", "left")
    return d.withColumn(id_col, F.coalesce(F.col(id_col).cast("string"), "_m", made)).drop("_k", "_m")


def fill_box_scores(box: DataFrame, players: DataFrame, stat: str, most_null: float = 0.5) -> DataFrame:
    """Team stat from summed player rows in seasons where more than ``most_null`` of it is missing."""
    sums = players.groupBy("game_id", "team_id").agg(F.sum(stat).alias("_sum"))
    rate = F.avg(F.col(stat).isNull().cast("double")).over(W.partitionBy("season"))
    return box.withColumn("_rate", rate).join(sums, ["game_id", "team_id"], "left").withColumn(stat, F.when(F.col("_rate") > most_null, F.coalesce(F.col(stat), F.col("_sum"))).otherwise(F.col(stat))).drop("_rate", "_sum")


def resolve_external(df: DataFrame, mapping: DataFrame, provider: str, external: str) -> DataFrame:
    """Canonical ids of a provider's external ids; the last mapping of a pair counts."""
    last = mapping.where(F.col("provider") == provider).groupBy("external_id").agg(F.max_by("canonical_id", "load_order").alias("canonical_id"))
    return df.join(last.withColumnRenamed("external_id", external), external, "left")


def orphans(games: DataFrame, teams: DataFrame) -> DataFrame:
    """Game sides whose team is not in the team table."""
    return team_games(games).select("game_id", "team_id", "is_home").join(teams.select("team_id"), "team_id", "left_anti")


def interval_count(events: DataFrame, other: DataFrame, key: str, days: int) -> DataFrame:
    """For each event, the rows of ``other`` with its key in the ``days`` before its date (that day excluded)."""
    day = lambda d: F.unix_date(d)
    both = events.select(key, day(F.col("date")).alias("_d"), F.col("game_id"), F.lit(0).alias("_o")).unionByName(other.select(key, day(F.col("date")).alias("_d"), F.lit(None).cast("long").alias("game_id"), F.lit(1).alias("_o")))
    n = F.sum("_o").over(W.partitionBy(key).orderBy("_d").rangeBetween(-days, -1))
    return both.withColumn("n", F.coalesce(n, F.lit(0))).where("_o = 0").select(key, "game_id", "n")


def expand_players(games: DataFrame, players: DataFrame, columns: list[str]) -> DataFrame:
    """Game x player rows of a field."""
    return games.select("game_id", "sport", "date").join(players.select("game_id", "player_id", *columns), "game_id")


# ---------------------------------------------------------------- set operations


def union_kinds(parts: dict[str, DataFrame], label: str = "stats_kind") -> DataFrame:
    """Rows of several tables by name, each with its kind."""
    tagged = [df.withColumn(label, F.lit(k)) for k, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def first_existing(*candidates: DataFrame | None) -> DataFrame:
    """The first source that exists."""
    return next(c for c in candidates if c is not None)


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """One row per key, first in order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
