"""Per-sport feature families as configuration: each feature is (name, kind, numerator, denominator, games).

All families are computed by the one as-of primitive over box-score rows per (game, entity); a family is data, not
code. Kinds: ``mean`` of a stat, ``rate`` of two sums, ``share`` of rows above a value, ``spread`` (deviation), ``best``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import asof

#: stats of a box-score row: made and tried shots and so on, by the names a family gives them
STATS = ["s1", "s2", "s3", "s4", "s5", "s6"]

Feature = tuple[str, str, str, str | float | None, int]

FAMILIES: dict[str, list[Feature]] = {
    # s1 made, s2 tried, s3 assists, s4 turnovers, s5 rebounds, s6 free throws
    "basketball": [
        ("fg_pct", "rate", "s1", "s2", 10), ("ast_to", "rate", "s3", "s4", 10), ("ft_rate", "rate", "s6", "s2", 10), ("tov_avg", "mean", "s4", None, 10), ("reb_avg", "mean", "s5", None, 10), ("pace", "mean", "s2", None, 5),
        ("fg_spread", "spread", "s1", None, 10),
    ],
    # s1 hits, s2 at bats, s3 earned runs, s4 innings, s5 walks, s6 strikeouts
    "baseball": [("avg", "rate", "s1", "s2", 15), ("runs_per_inning", "rate", "s3", "s4", 10), ("bb_rate", "rate", "s5", "s2", 15), ("k_rate", "rate", "s6", "s2", 15), ("bullpen", "mean", "s3", None, 5), ("clutch", "share", "s1", 20.0, 10)],
    # s1 goals, s2 shots, s3 penalty minutes, s4 saves, s5 power plays, s6 blocks
    "hockey": [("shooting", "rate", "s1", "s2", 10), ("pim", "mean", "s3", None, 10), ("power_play", "rate", "s1", "s5", 10), ("saves", "mean", "s4", None, 5), ("physical", "mean", "s6", None, 10), ("goals_short", "mean", "s1", None, 3)],
    # s1 yards, s2 plays, s3 turnovers, s4 first downs, s5 sacks, s6 penalties
    "football": [("yards_per_play", "rate", "s1", "s2", 8), ("turnovers", "mean", "s3", None, 8), ("first_downs", "mean", "s4", None, 8), ("sack_rate", "rate", "s5", "s2", 8), ("discipline", "mean", "s6", None, 8), ("big_days", "share", "s1", 30.0, 8)],
    # s1 goals, s2 shots, s3 corners, s4 cards, s5 saves, s6 possession
    "soccer": [("conversion", "rate", "s1", "s2", 10), ("corners", "mean", "s3", None, 10), ("cards", "mean", "s4", None, 10), ("keeper", "rate", "s5", "s2", 10), ("possession", "mean", "s6", None, 5), ("clean", "share", "s1", 25.0, 10)],
    # s1 serve points won, s2 serve points, s3 break points won, s4 break points, s5 aces, s6 double faults
    "tennis": [("serve", "rate", "s1", "s2", 15), ("breaks", "rate", "s3", "s4", 15), ("aces", "mean", "s5", None, 10), ("faults", "mean", "s6", None, 10), ("serve_recent", "rate", "s1", "s2", 5)],
    # s1 strikes landed, s2 thrown, s3 takedowns, s4 attempts, s5 knockdowns, s6 control
    "combat": [("accuracy", "rate", "s1", "s2", 5), ("takedowns", "rate", "s3", "s4", 5), ("knockdowns", "mean", "s5", None, 5), ("control", "mean", "s6", None, 5), ("finishes", "share", "s5", 5.0, 10)],
    # s1 kills, s2 deaths, s3 assists, s4 objectives, s5 gold, s6 vision
    "esports": [("kd", "rate", "s1", "s2", 10), ("kda_assists", "mean", "s3", None, 10), ("objectives", "mean", "s4", None, 10), ("economy", "mean", "s5", None, 10), ("vision", "mean", "s6", None, 10)],
    # s1 strokes, s2 holes, s3 putts, s4 greens, s5 fairways, s6 drives
    "golf": [("strokes_per_hole", "rate", "s1", "s2", 5), ("long_form", "mean", "s1", None, 20), ("putting", "mean", "s3", None, 10), ("best_round", "best", "s1", None, 10), ("steady", "spread", "s1", None, 10)],
    # s1 points, s2 laps, s3 positions gained, s4 pit stops, s5 pit seconds, s6 grid
    "motorsport": [("points_per_lap", "rate", "s1", "s2", 10), ("gained", "mean", "s3", None, 5), ("pit_time", "rate", "s5", "s4", 10), ("grid", "mean", "s6", None, 5), ("podium", "share", "s1", 40.0, 10)],
}

SOURCE_SQL = """SELECT game_id, player_id AS entity_id, min(date) AS date, sum(pts) AS s1, sum(minutes) AS s2, sum(ast) AS s3, sum(reb) AS s4, sum(pts * 0.5) AS s5, CAST(count(*) AS DOUBLE) AS s6 FROM player_stats GROUP BY 1, 2"""


def source(t) -> DataFrame:
    """Box-score rows per (game, entity) from player lines."""
    return t.player_stats.groupBy("game_id", F.col("player_id").alias("entity_id")).agg(
        F.min("date").alias("date"), F.sum("pts").alias("s1"), F.sum("minutes").alias("s2"), F.sum("ast").alias("s3"), F.sum("reb").alias("s4"), F.sum(F.col("pts") * 0.5).alias("s5"), F.count("*").cast("double").alias("s6")
    )


def _states(family: list[Feature]) -> asof.State:
    out: asof.State = {}
    for name, kind, a, b, n in family:
        if kind == "rate":
            out[f"{name}|a"], out[f"{name}|b"] = (n, asof.total(a)), (n, asof.total(str(b)))
        elif kind == "mean":
            out[name] = (n, asof.mean(a))
        elif kind == "share":
            out[name] = (n, asof.share(F.col(a) > b))
        elif kind == "spread":
            out[name] = (n, asof.deviation(a))
        else:
            out[name] = (n, lambda w, a=a: F.max(a).over(w))
    return out


def compute(rows: DataFrame, family: list[Feature]) -> DataFrame:
    """Features of each (game, entity) from its earlier rows; 0 where there are none."""
    d = asof.as_of(rows.withColumn("completed", F.lit(True)), _states(family), ("entity_id",))

    def value(name: str, kind: str) -> Column:
        if kind == "rate":
            return F.coalesce(F.col(f"{name}|a") / F.nullif(F.col(f"{name}|b"), F.lit(0.0)), F.lit(0.0))
        return F.coalesce(F.col(name), F.lit(0.0))

    return d.select("game_id", "entity_id", *(value(f[0], f[1]).alias(f[0]) for f in family))


def oracle_columns(family: list[Feature]) -> str:
    """The family's select list over a table ``past`` of numbered earlier rows."""
    def one(name: str, kind: str, a: str, b: object, n: int) -> str:
        when = lambda x: f"CASE WHEN k <= {n} AND pg IS NOT NULL THEN {x} END"
        e = {
            "rate": f"sum({when(a)}) / nullif(sum({when(b)}), 0)", "mean": f"avg({when(a)})", "share": f"avg({when(f'CASE WHEN {a} > {b} THEN 1.0 ELSE 0.0 END')})",
            "spread": f"stddev_samp({when(a)})", "best": f"max({when(a)})",
        }[kind]
        return f"round(coalesce({e}, 0), 6) + 0.0 AS {name}"

    return ", ".join(one(*f) for f in family)
