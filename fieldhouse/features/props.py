"""Features of player props: one table of (player, game) with the features and targets of all stats, wide or long.

A row's features come from the player's games before it (date, then game), the opponent's and the team's games of
strictly earlier dates. What the schedule says comes first, by one join of a row a game; then all stats of a player share one shuffle
of narrow rows and one sort, and the wide row is made where the sorted rows are read. The long form comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.games import team_games
from . import asof

#: what a stat's features are, in the order of the array ``x``
NAMES = ("mean_5", "mean_15", "std_15", "max_5", "last", "above_5", "allowed", "is_home", "rest_days", "games")
#: the features that all stats of a player's game have in common
SHARED = NAMES[7:]
#: sums of stats that are props themselves
COMPOSITES = {"pts_reb_ast": ("pts", "reb", "ast"), "pts_reb": ("pts", "reb"), "pts_ast": ("pts", "ast"), "reb_ast": ("reb", "ast")}


def player_games(players: DataFrame, stats: tuple[str, ...]) -> DataFrame:
    """One row per player and game: stats summed, nulls as 0."""
    total = [F.sum(F.coalesce(F.col(s).cast("double"), F.lit(0.0))).alias(s) for s in stats]
    return players.groupBy("player_id", "game_id").agg(F.max("team_id").alias("team_id"), F.max("date").alias("date"), *total)


def with_composites(games: DataFrame, doubles: tuple[str, ...] = ("pts", "reb", "ast"), at: float = 10.0) -> DataFrame:
    """Sums of ``COMPOSITES`` whose stats are there, and whether two of ``doubles`` reach ``at``."""
    have = set(games.columns)
    sums = {n: sum((F.col(s) for s in of[1:]), F.col(of[0])) for n, of in COMPOSITES.items() if have.issuperset(of)}
    reached = [F.when(F.col(s) >= at, 1).otherwise(0) for s in doubles if s in have]
    double = {"double_double": F.when(sum(reached[1:], reached[0]) >= 2, 1.0).otherwise(0.0)} if reached else {}
    return games.withColumns(sums | double)


def rolling(games: DataFrame, stats: tuple[str, ...], short: int = 5, long_: int = 15) -> DataFrame:
    """Per stat columns of the player's last games before this one, and how many there were."""
    return rolled(by_player(games), stats, short, long_)


def by_player(games: DataFrame) -> DataFrame:
    """Each player's games in one task, in order."""
    return games.repartition("player_id").sortWithinPartitions("player_id", "date", "game_id")


def rolled(games: DataFrame, stats: tuple[str, ...], short: int = 5, long_: int = 15) -> DataFrame:
    """``rolling`` over rows that ``by_player`` has put in order. Rows stream through; of a batch only as many rows are kept as the next
    one looks back on."""
    made = [T.StructField("n_before", T.IntegerType()), *(T.StructField(f"{s}_{c}", T.DoubleType()) for s in stats for c in (f"mean_{short}", f"mean_{long_}", f"std_{long_}", f"max_{short}", "last", f"above_{short}"))]
    schema = T.StructType([*games.schema.fields, *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, nth = None, np.empty((0, len(stats))), np.empty(0, np.int64)  # rows kept of the batches before
        for b in batches:
            if not b.num_rows:
                continue
            kept, id_ = len(nth), b.column("player_id")
            ids = id_ if ids is None else pa.concat_arrays([ids, id_])
            y = np.concatenate([y, np.column_stack([b.column(s).to_numpy(zero_copy_only=False).astype(float) for s in stats])])
            code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            start = np.repeat(first, np.diff(np.append(first, len(code))))
            base = nth[0] if kept else 0
            nth = np.arange(len(code)) - start + np.where(start == 0, base, 0)
            columns = looked_back(y, np.arange(len(code)) - start, short, long_)
            n = nth[kept:]
            arrays = [*b.columns, pa.array(n.astype(np.int32))]
            for i in range(len(stats)):
                arrays += [pa.array(c[kept:, i], mask=n == 0 if empty else None) for c, empty in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
            keep = slice(max(0, len(code) - short - long_), None)
            ids, y, nth = ids[keep], y[keep], nth[keep]

    return games.mapInArrow(run, schema)


def looked_back(y: np.ndarray, nth: np.ndarray, short: int, long_: int) -> list[tuple[np.ndarray, bool]]:
    """Mean, mean, deviation, maximum, last and games above the mean over the rows before each, of which a player has ``nth``; and
    whether a column is empty where there are none."""

    def before(v: np.ndarray, k: int, none: float) -> np.ndarray:
        out = np.full(v.shape, none)
        out[k:] = np.where((nth[k:] >= k)[:, None], v[:-k], none)
        return out

    def sums(v: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(v.shape)
        for k in range(n, 0, -1):  # from the oldest, as a window adds
            out += before(v, k, 0.0)
        return out

    count = lambda n: np.maximum(np.minimum(nth, n), 1)[:, None]
    mean_short, mean_long = sums(y, short) / count(short), sums(y, long_) / count(long_)
    squares = np.zeros(y.shape)
    for k in range(long_, 0, -1):
        d = before(y, k, 0.0) - mean_long
        squares += np.where((nth >= k)[:, None], d * d, 0.0)
    deviation = np.where((nth > 1)[:, None], np.sqrt(squares / np.maximum(count(long_) - 1, 1)), 0.0)
    most = before(y, 1, -np.inf)
    for k in range(2, short + 1):
        most = np.maximum(most, before(y, k, -np.inf))
    hot = np.where((nth > 0)[:, None] & (np.round(y - mean_long, 9) > 0), 1.0, 0.0)
    return [(mean_short, True), (mean_long, True), (deviation, False), (most, True), (before(y, 1, 0.0), True), (sums(hot, short), False)]


def sides(games: DataFrame, schedule: DataFrame, stats: tuple[str, ...], n: int = 10, default: int = 7) -> DataFrame:
    """A row a game: an array of its teams with opponent, side, rest, and what players made against the team, per game, over its last
    n games of earlier dates. Games meet by game and teams by team, once each."""
    of = [F.col(f"made.{s}").alias(s) for s in stats]
    made = games.groupBy("game_id", "team_id").agg(*(F.sum(s).alias(s) for s in stats))
    made = made.groupBy("game_id").agg(F.collect_list(F.struct("team_id", *stats)).alias("made"))
    tg = team_games(schedule.join(made, "game_id", "left"), ("made",)).select("game_id", "team_id", "opp_id", "is_home", "date", "completed", F.get(F.filter("made", lambda m: m["team_id"] == F.col("opp_id")), F.lit(0)).alias("made"))
    tg = tg.select("*", F.col("made").isNotNull().alias("_made"), *of).drop("made").repartition("team_id")
    d = asof.as_of(tg, {"last_date": (1, lambda w: F.max("date").over(w))})
    d = asof.as_of(d, {f"{s}_allowed": (n, asof.mean(s)) for s in stats}, known="_made")
    rest = F.coalesce(F.datediff("date", "last_date"), F.lit(default)).cast("double")
    d = d.select("game_id", "team_id", "opp_id", F.col("is_home").cast("double").alias("is_home"), rest.alias("rest_days"), *(f"{s}_allowed" for s in stats)).repartition("game_id")
    d = d.groupBy("game_id", "team_id").agg(*(F.max(c).alias(c) for c in ("opp_id", "is_home", "rest_days", *(f"{s}_allowed" for s in stats))))
    return d.groupBy("game_id").agg(F.collect_list(F.struct(*d.columns[1:])).alias("sides"))


def wide_features(players: DataFrame, schedule: DataFrame, stats: tuple[str, ...], least: int = 3, most_rest: int = 14) -> DataFrame:
    """A row a player and game of ``prop_features``: player_id, game_id, team_id, date, n_before, what ``SHARED`` names, and per stat its
    value under its name and its own features as ``<stat>_<feature>``."""
    base = tuple(dict.fromkeys(b for s in stats for b in COMPOSITES.get(s, () if s == "double_double" else (s,))))
    base = tuple(dict.fromkeys(base + (("pts", "reb", "ast") if "double_double" in stats else ())))
    games = player_games(players, base)
    d = games.join(sides(with_composites(games), schedule, stats), "game_id", "left")
    team = lambda id_: F.get(F.filter("sides", lambda x: x["team_id"] == id_), F.lit(0))
    d = d.withColumn("_own", team(F.col("team_id"))).withColumn("_other", team(F.col("_own.opp_id")))
    rest = F.least(F.coalesce("_own.rest_days", F.lit(7.0)), F.lit(float(most_rest)))
    against = [F.coalesce(f"_other.{s}_allowed", F.lit(0.0)).alias(f"{s}_allowed") for s in stats]
    d = by_player(d.select("player_id", "game_id", "team_id", "date", *base, F.coalesce("_own.is_home", F.lit(0.0)).alias("is_home"), rest.alias("rest_days"), *against))
    d = rolled(with_composites(d), stats).where(F.col("n_before") >= least).withColumn("games", F.least("n_before", F.lit(50)).cast("double"))
    return d.select("player_id", "game_id", "team_id", "date", "n_before", *SHARED, *(c for s in stats for c in (s, *own_columns(s))))


def own_columns(stat: str) -> list[str]:
    """The wide table's columns of the features that are the stat's own."""
    return [f"{stat}_{c}" for c in NAMES if c not in SHARED]


def prop_features(players: DataFrame, schedule: DataFrame, stats: tuple[str, ...], least: int = 3, most_rest: int = 14) -> DataFrame:
    """(player_id, game_id, team_id, date, n_before, stat, x, y) for players with at least ``least`` games before.

    ``x`` has the values of ``NAMES``; where the opponent or the schedule says nothing, 0, away and 7 days.
    ``y`` is what the player made, ``stats`` may name composites.
    """
    d = wide_features(players, schedule, stats, least, most_rest)
    row = lambda s: F.struct(F.lit(s).alias("stat"), F.array(*own_columns(s), *SHARED).alias("x"), F.col(s).alias("y"))
    return d.select("player_id", "game_id", "team_id", "date", "n_before", F.inline(F.array(*map(row, stats))))
