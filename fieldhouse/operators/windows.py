"""Leaders, streaks, trends and other ordered operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.stored import written


def leaders(df: DataFrame, keys: list[str], stats: dict[str, bool], most: int = 25) -> DataFrame:
    """Best ``most`` keys per stat (True: high is good), as (stat, rank, key, value)."""
    long_ = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value"), F.lit(1 if up else -1).alias("sign")) for s, up in stats.items()))).alias("x")).select(*keys, "x.*").where("value IS NOT NULL")
    w = W.partitionBy("stat").orderBy((F.col("value") * F.col("sign")).desc(), *keys)
    return long_.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("sign")


def streaks(df: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """Signed length of the run of equal flags that each row ends (wins positive)."""
    w = W.partitionBy(key).orderBy(*order)
    change = F.when(F.lag(flag).over(w) == F.col(flag), 0).otherwise(1)
    d = df.withColumn("_c", change).withColumn("_g", F.sum("_c").over(w))
    n = F.row_number().over(W.partitionBy(key, "_g").orderBy(*order))
    return d.withColumn("streak", F.when(F.col(flag) == 1, n).otherwise(-n)).drop("_c", "_g")


def rolling_slope(df: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """Least-squares slope of the last n values on their position, this row included."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w).cast("double")).withColumn("slope", F.regr_slope(F.col(value), F.col("_i")).over(w.rowsBetween(-(n - 1), 0))).drop("_i")


def recent_counts(df: DataFrame, key: str, days: tuple[int, ...] = (7, 14, 30)) -> DataFrame:
    """Rows of the key in the n days before each row's date."""
    w = W.partitionBy(key).orderBy("_d")
    d = df.withColumn("_d", F.unix_date("date"))
    return d.select(*df.columns, *(F.count("*").over(w.rangeBetween(-n, -1)).alias(f"last_{n}d") for n in days))


def days_since(df: DataFrame, key: str, order: list[str], most: int = 14, default: int = 7) -> DataFrame:
    """Days since the key's previous row, clipped; the default for the first."""
    w = W.partitionBy(key).orderBy("date", *order)
    return df.withColumn("rest_days", F.coalesce(F.least(F.datediff("date", F.lag("date").over(w)), F.lit(most)), F.lit(default)))


def shifted_stats(df: DataFrame, key: str, order: list[str], value: str, spans: tuple[int, ...] = (5, 15)) -> DataFrame:
    """Mean, maximum and deviation of the values before each row, and how many of the last five beat the mean of fifteen."""
    w = W.partitionBy(key).orderBy(*order)
    cols = [F.lag(value).over(w).alias("last")]
    for n in spans:
        f = w.rowsBetween(-n, -1)
        cols += [F.avg(value).over(f).alias(f"mean_{n}"), F.max(value).over(f).alias(f"max_{n}"), F.coalesce(F.stddev_samp(value).over(f), F.lit(0.0)).alias(f"std_{n}")]
    d = df.select(*df.columns, *cols)
    above = F.when(F.col(value) > F.col(f"mean_{spans[-1]}"), 1).otherwise(0)
    d = d.withColumn("_a", above).withColumn("above_5", F.coalesce(F.sum("_a").over(w.rowsBetween(-5, -1)), F.lit(0))).drop("_a")
    a, b = F.col(f"mean_{spans[0]}"), F.col(f"mean_{spans[-1]}")
    return d.withColumn("trend", a - b).withColumn("consistency", F.when(b > 0, 1 - F.least(F.col(f"std_{spans[-1]}") / F.when(b > 0, b), F.lit(1.0))).otherwise(0.0))


def running_totals(df: DataFrame, key: str, order: list[str], value: str, total: str = "running", peak: str = "highest") -> DataFrame:
    """Sum of ``value`` up to each row of its key, and the highest such sum so far, without a window over a bare key.

    (sum, highest sum) joins associatively: windows run inside a key's chunks, the values of the first column of ``order``
    (a day), and the totals of the chunks, one row each, are scanned by key. A row gets its chunk's start added.
    """
    chunk = order[0]
    inner = W.partitionBy(key, chunk).orderBy(*order[1:]).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("_in", F.sum(value).over(inner)).withColumn("_hi", F.max("_in").over(inner))
    chunks = d.groupBy(key, chunk).agg(F.sum(value).alias("_sum"), F.max("_in").alias("_top"))
    before = W.partitionBy(key).orderBy(F.asc_nulls_first(chunk)).rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    chunks = chunks.withColumn("_past", F.max(F.col("_base") + F.col("_top")).over(before))
    chunks = chunks.select(F.col(key).alias("_k"), F.col(chunk).alias("_c"), "_base", "_past")
    d = d.join(chunks, d[key].eqNullSafe(chunks["_k"]) & d[chunk].eqNullSafe(chunks["_c"]))
    return d.select(*df.columns, (F.col("_base") + F.col("_in")).alias(total), F.greatest(F.col("_past"), F.col("_base") + F.col("_hi")).alias(peak))


def bankroll(bets: DataFrame, start: float, key: str, order: list[str], pnl: str = "pnl") -> DataFrame:
    """Balance, peak so far and drawdown after each bet."""
    d = running_totals(bets, key, order, pnl, "_run", "_high")
    d = d.withColumn("balance", start + F.col("_run")).withColumn("peak", F.greatest(start + F.col("_high"), F.lit(start))).drop("_run", "_high")
    return d.withColumn("drawdown", (F.col("peak") - F.col("balance")) / F.col("peak"))


def ema_rate(df: DataFrame, keys: list[str], chunk: str, order: list[Column], value: str, half_life: float = 25.0) -> DataFrame:
    """Weighted mean per key with weights halving every ``half_life`` rows, newest ``chunk`` first, then by ``order``.

    (weighted sum, weight, rows) joins associatively: a key's chunks are weighed on their own, and each is then discounted by
    the rows of newer chunks.
    """
    w = W.partitionBy(*keys, chunk).orderBy(*order)
    fade = lambda n: F.exp(-n * math.log(2) / half_life)
    d = df.withColumn("_w", fade(F.row_number().over(w) - 1))
    chunks = d.groupBy(*keys, chunk).agg(F.sum(F.col("_w") * F.col(value)).alias("_v"), F.sum("_w").alias("_w"), F.count("*").alias("_n"))
    newer = W.partitionBy(*keys).orderBy(F.desc_nulls_last(chunk)).rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("_f", fade(F.coalesce(F.sum("_n").over(newer), F.lit(0))))
    return chunks.groupBy(*keys).agg((F.sum(F.col("_f") * F.col("_v")) / F.sum(F.col("_f") * F.col("_w"))).alias("ema"), F.sum("_n").alias("n"))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Place of each row in one order over all rows: ranges of the order are written, counted, and ranked each on its own."""
    d = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = d.groupBy("_part").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    d = d.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return d.withColumn(name, (F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy(*order))).cast("int")).drop("_part", "_before")


def field_ranks(df: DataFrame, group: str, value: str, tie: list[str]) -> DataFrame:
    """Rank, share of the field beaten and distance to its mean."""
    w = W.partitionBy(group)
    o = w.orderBy(F.desc(value), *tie)
    return df.select(*df.columns, F.row_number().over(o).alias("field_rank"), F.count("*").over(w).alias("field_size"), F.percent_rank().over(w.orderBy(value)).alias("beaten"), (F.col(value) - F.avg(value).over(w)).alias("vs_field"))


def top_overlap(df: DataFrame, group: str, predicted: str, actual: str, tie: list[str], n: int) -> DataFrame:
    """Share of the actual top n that the predicted top n holds, per group."""
    w = W.partitionBy(group)
    d = df.select(group, F.row_number().over(w.orderBy(F.desc(predicted), *tie, actual)).alias("p"), F.row_number().over(w.orderBy(F.desc(actual), *tie, predicted)).alias("a"))
    hit = F.count_if((F.col("p") <= n) & (F.col("a") <= n))
    return d.groupBy(group).agg(hit.alias("hits"), (hit / F.least(F.count("*"), F.lit(n))).alias("recall"))


def line_movement(odds: DataFrame, line: str) -> DataFrame:
    """Open, close, move and range of a line per game and bookmaker, and its regime by the size of the move."""
    o = F.struct("ts", "seq", "tie")
    d = odds.groupBy("game_id", "bookmaker").agg(F.min_by(line, o).alias("open"), F.max_by(line, o).alias("close"), F.max(line).alias("_hi"), F.min(line).alias("_lo"), F.count("*").alias("ticks"))
    move = F.col("close") - F.col("open")
    regime = F.when(F.abs(move) >= 10, "steam").when(F.abs(move) >= 3, "drift").when(F.col("_hi") - F.col("_lo") >= 10, "volatile").otherwise("stable")
    return d.select("game_id", "bookmaker", "open", "close", move.alias("move"), (F.col("_hi") - F.col("_lo")).alias("range"), "ticks", regime.alias("regime"))


def projected_leaders(players: DataFrame, stats: dict[str, float], season_games: int, most: int = 25) -> DataFrame:
    """Per-game rates times a season's games, and a score of weights on shares of the best."""
    d = players.groupBy("player_id").agg(F.count_distinct("game_id").alias("games"), *((F.sum(s) / F.count_distinct("game_id") * season_games).alias(f"proj_{s}") for s in stats))
    best = d.agg(*(F.max(f"proj_{s}").alias(f"_b_{s}") for s in stats))
    d = d.join(F.broadcast(best))  # one row
    total = sum(stats.values())
    score = sum((F.col(f"proj_{s}") / F.col(f"_b_{s}") * w for s, w in stats.items()), F.lit(0.0)) / total
    return d.withColumn("score", score).orderBy(F.desc("score"), "player_id").limit(most).select("player_id", "games", *(f"proj_{s}" for s in stats), "score")
