"""Elo ratings.

Within a pool a game needs the ratings that all earlier games left, but only those of teams that are linked to its own by
games at all. So teams fall into groups that never meet, each group is one stream of rows, and groups run in parallel:
sorted by Spark, which spills; the task keeps one rating a team and the changes of one day, never the history. Groups come from two
levels of union-find: each task turns its pairs into a forest, forests of a pool (no more edges than teams) are joined.

Games of one day are rated on what was known before it, so a new day needs no order at all: ``EloBook`` stores the
ratings as a versioned table, and a day is two joins with it and one sum a team. Games without a date come last.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import written
from ..sources.versioned import VersionedTable

K, START = 32.0, 1500.0

# ---------------------------------------------------------------- one formula, for tasks and for columns


def expected(a: float, b: float) -> float:
    return 1 / (1 + 10 ** ((b - a) / 400))


def change(home: float, away: float, margin: float, k: float = K) -> float:
    """What the home team wins and the away team loses; margins count by their logarithm, less where the winner was ahead anyway."""
    won = 1.0 if margin > 0 else 0.0 if margin < 0 else 0.5
    lead = home - away if margin > 0 else away - home
    return k * math.log(abs(margin) + 1) * (2.2 / (max(lead, -2000) * 0.001 + 2.2)) * (won - expected(home, away))


def expected_column(a: str, b: str) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (F.col(b) - F.col(a)) / 400))


def change_column(home: str, away: str, margin: Column, k: float = K) -> Column:
    won = F.when(margin > 0, 1.0).when(margin < 0, 0.0).otherwise(0.5)
    gap = F.col(home) - F.col(away)
    lead = F.greatest(F.when(margin > 0, gap).otherwise(-gap), F.lit(-2000.0))
    return k * F.log(F.abs(margin) + 1) * (2.2 / (lead * 0.001 + 2.2)) * (won - expected_column(home, away))


# ---------------------------------------------------------------- teams that are linked


class Forest:
    """Union-find over the teams of one pool."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs that link something new, per pool."""
    pools: dict[str, Forest] = {}
    for pdf in batches:
        keep = [pools.setdefault(s, Forest()).join(a, b) or a == b for s, a, b in zip(pdf["sport"], pdf["a"], pdf["b"], strict=True)]
        yield pdf[keep]


def _labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smallest team that each team is linked to; pools come one after the other."""
    now, forest = None, Forest()
    out = lambda: pd.DataFrame([(now, t, forest.root(t)) for t in list(forest.up)], columns=["sport", "team_id", "component"])
    for pdf in batches:
        for s, a, b in zip(pdf["sport"], pdf["a"], pdf["b"], strict=True):
            if s != now:
                yield out()
                now, forest = s, Forest()
            forest.join(a, b)
    yield out()


def linked_teams(games: DataFrame) -> DataFrame:
    """(sport, team_id, component): teams of a pool that games link, directly or through others, share a component."""
    pairs = games.where("home_team_id IS NOT NULL AND away_team_id IS NOT NULL").select("sport", F.least("home_team_id", "away_team_id").alias("a"), F.greatest("home_team_id", "away_team_id").alias("b"))
    pairs = pairs.distinct().mapInPandas(_forests, "sport string, a long, b long")
    return pairs.repartition("sport").sortWithinPartitions("sport").mapInPandas(_labels, "sport string, team_id long, component long")


# ---------------------------------------------------------------- the whole history


def _rate(k: float, start: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rating: dict[int, float] = {}
        pending: list[tuple[int, float]] = []
        group, day = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.sport, r.component) != group:
                    rating, pending, group, day = {}, [], (r.sport, r.component), r.date
                elif r.date != day:  # games of a day are rated on what was known before it
                    for team, d in pending:
                        rating[team] = rating.get(team, start) + d
                    pending, day = [], r.date
                h, a = rating.get(r.home_team_id, start), rating.get(r.away_team_id, start)
                d = 0.0
                if pd.notna(r.home_score) and pd.notna(r.away_score):
                    d = change(h, a, r.home_score - r.away_score, k)
                    pending += [(r.home_team_id, d), (r.away_team_id, -d)]
                out.append((r.sport, r.game_id, r.date, r.home_team_id, r.away_team_id, h, a, expected(h, a), d))
            yield pd.DataFrame(out, columns=["sport", "game_id", "date", "home_team_id", "away_team_id", "home_elo", "away_elo", "home_expected", "home_change"])

    return run


_RATED = "sport string, game_id long, date date, home_team_id long, away_team_id long, home_elo double, away_elo double, home_expected double, home_change double"


def rated(games: DataFrame, k: float = K, start: float = START) -> DataFrame:
    """Every game with both teams' ratings before it and the change it made; games without two teams are left out."""
    d = games.select("sport", "game_id", "date", "home_team_id", "away_team_id", "home_score", "away_score")
    teams = linked_teams(games).withColumnRenamed("team_id", "home_team_id")
    d = d.where("away_team_id IS NOT NULL").join(teams, ["sport", "home_team_id"])
    d = d.repartition("sport", "component").sortWithinPartitions("sport", "component", F.asc_nulls_last("date"), "game_id")
    return d.mapInPandas(_rate(k, start), _RATED)


def elo(games: DataFrame, k: float = K, start: float = START) -> DataFrame:
    """Ratings of both teams before each game, with the difference and the expected result."""
    return rated(games, k, start).select("sport", "game_id", "home_elo", "away_elo", "home_expected", (F.col("home_elo") - F.col("away_elo")).alias("elo_diff"))


def ratings(history: DataFrame, start: float = START) -> DataFrame:
    """(sport, team_id, rating, games) after the games of ``rated``: the start plus all changes."""
    both = F.array(F.struct(F.col("home_team_id").alias("team_id"), F.col("home_change").alias("c")), F.struct(F.col("away_team_id").alias("team_id"), (-F.col("home_change")).alias("c")))
    d = history.select("sport", F.explode(both).alias("x")).select("sport", "x.*")
    return d.groupBy("sport", "team_id").agg((start + F.sum("c")).alias("rating"), F.count_if(F.col("c") != 0).alias("games"))


# ---------------------------------------------------------------- ratings that are stored


class EloBook:
    """Stored ratings, a version a day. A new day reads its own games and the ratings, no history."""

    SCHEMA = "sport string, team_id long, rating double, games long"

    def __init__(self, spark: SparkSession, path: str, k: float = K, start: float = START, parts: int = 32):
        self.table, self.k, self.start = VersionedTable(spark, path, self.SCHEMA, ["sport", "team_id"], parts), k, start

    def day(self) -> datetime.date | None:
        """The last day that is in the ratings."""
        d = self.table.manifest()["notes"].get("day")
        return datetime.date.fromisoformat(d) if d else None

    def found(self, games: DataFrame, until: datetime.date) -> None:
        """Begin with the ratings after all games up to a day."""
        if self.table.versions():
            raise ValueError("the book has begun; rewind it")
        history = rated(games.where(F.col("date") <= F.lit(until)), self.k, self.start)
        self.table.change(written(ratings(history, self.start), "elo"), lambda old, new: new, "days", until.toordinal(), {"day": until.isoformat()})

    def rate(self, day_games: DataFrame, version: int | None = None) -> DataFrame:
        """Games of one day on stored ratings, as ``rated``: joins alone."""
        r = self.table.read(version).select("sport", "team_id", "rating")
        d = day_games.where("home_team_id IS NOT NULL AND away_team_id IS NOT NULL").select("sport", "game_id", "date", "home_team_id", "away_team_id", "home_score", "away_score")
        for side in ("home", "away"):
            d = d.join(r.select("sport", F.col("team_id").alias(f"{side}_team_id"), F.col("rating").alias(f"{side}_elo")), ["sport", f"{side}_team_id"], "left")
        d = d.withColumn("home_elo", F.coalesce("home_elo", F.lit(self.start))).withColumn("away_elo", F.coalesce("away_elo", F.lit(self.start)))
        c = F.coalesce(change_column("home_elo", "away_elo", F.col("home_score") - F.col("away_score"), self.k), F.lit(0.0))
        return d.select("sport", "game_id", "date", "home_team_id", "away_team_id", "home_elo", "away_elo", expected_column("home_elo", "away_elo").alias("home_expected"), c.alias("home_change"))

    def advance(self, games: DataFrame) -> list[DataFrame]:
        """Rate the days after ``day()``, oldest first, and commit each; returns the rated games, a table for each day.

        A day that is committed already is skipped, so a run that was lost goes on where it ended. Results that come in for
        a day in the book are not seen: ``rewind`` before that day.
        """
        last = self.day()
        new = games.where(F.col("date") > F.lit(last)) if last else games.where("date IS NOT NULL")
        out = []
        for (day,) in sorted(tuple(r) for r in new.select("date").distinct().collect()):  # days since the last run
            done = written(self.rate(new.where(F.col("date") == F.lit(day))), "elo-day")
            self.table.change(ratings(done, 0.0), self._add, "days", day.toordinal(), {"day": day.isoformat()})
            out.append(done)
        return out

    def _add(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Changes of a day on top of the ratings; teams that are not there yet begin at the start."""
        d = old.withColumn("_start", F.lit(0.0)).unionByName(new.withColumn("_start", F.lit(self.start)))
        d = d.groupBy("sport", "team_id").agg(F.sum("rating").alias("r"), F.min("_start").alias("s"), F.sum("games").alias("games"))
        return d.select("sport", "team_id", (F.col("r") + F.col("s")).alias("rating"), "games")

    def rewind(self, before: datetime.date) -> None:
        """Take the ratings back to the newest version of an earlier day than ``before``."""
        for v in reversed(self.table.versions()):
            day = self.table.manifest(v)["notes"].get("day")
            if day and datetime.date.fromisoformat(day) < before:
                return self.table.restore(v)
        raise ValueError(f"no version before {before}")


#: days one after the other; a keyed recursion holds one row for each team and one for each game that has been rated
_STEPS = """WITH RECURSIVE days AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM games)),
 g AS MATERIALIZED (SELECT game_id, sport, d, home_team_id AS h, away_team_id AS a, home_score - away_score AS m FROM games JOIN days USING (date)),
 step(kind, sport, id, d, x, y, c) USING KEY (kind, sport, id) AS (
  SELECT 'day', '', 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION
  (WITH now AS (SELECT d + 1 AS d FROM step WHERE kind = 'day'),
   r AS (SELECT g.game_id, g.sport, g.d, g.h, g.a, g.m, coalesce(x.x, 1500) AS eh, coalesce(z.x, 1500) AS ea FROM g JOIN now ON g.d = now.d
     LEFT JOIN recurring.step x ON x.kind = 'team' AND x.sport = g.sport AND x.id = g.h LEFT JOIN recurring.step z ON z.kind = 'team' AND z.sport = g.sport AND z.id = g.a),
   e AS (SELECT *, 1 / (1 + pow(10, (ea - eh) / 400)) AS p FROM r),
   f AS (SELECT *, coalesce(32 * ln(abs(m) + 1) * (2.2 / (greatest(CASE WHEN m > 0 THEN eh - ea ELSE ea - eh END, -2000) * 0.001 + 2.2)) * ((CASE WHEN m > 0 THEN 1.0 WHEN m < 0 THEN 0.0 ELSE 0.5 END) - p), 0) AS c FROM e),
   t AS (SELECT sport, id, any_value(r) AS r, sum(c) AS c FROM (SELECT sport, h AS id, eh AS r, c FROM f UNION ALL SELECT sport, a, ea, -c FROM f) q GROUP BY sport, id)
   SELECT 'day', '', 0, d, 0.0, 0.0, 0.0 FROM now WHERE d <= (SELECT max(d) FROM days)
   UNION ALL SELECT 'team', sport, id, 0, r + c, 0.0, 0.0 FROM t
   UNION ALL SELECT 'game', sport, game_id, d, eh, ea, p FROM f))"""
ELO_SQL = _STEPS + " SELECT sport, id AS game_id, round(x, 4) AS home_elo, round(y, 4) AS away_elo, round(x - y, 4) + 0.0 AS elo_diff, round(c, 6) AS home_expected FROM step WHERE kind = 'game'"
RATINGS_SQL = _STEPS.replace("FROM games)", "FROM games WHERE home_score IS NOT NULL)").replace("FROM games JOIN days", "FROM (SELECT * FROM games WHERE home_score IS NOT NULL) q JOIN days") + " SELECT sport, id AS team_id, round(x, 4) AS rating FROM step WHERE kind = 'team'"
