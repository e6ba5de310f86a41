"""Live snapshots: batch operators, and the same operators over streams.

Streams keep bounded state: the last emitted record of a key, until the watermark is a lifetime past it (changes); the rows
of an interval (quotes); the keys of a watermark (news). Newest rows lie in a versioned table, not in state. Batch and
stream share the column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import clock_seconds, fold, logit, sigmoid
from ..sources.versioned import VersionedTable

SCHEMA = "game_id long, seq long, snapshot_time timestamp, status string, home_score long, away_score long, period int"

#: fixed values: points that a lead is worth in log odds at the end of a game's first instant, and regulation periods
SPORTS = {"basketball": (0.08, 4), "football": (0.10, 4), "hockey": (0.9, 3), "soccer": (1.1, 2), "baseball": (0.45, 9), "volleyball": (0.12, 5)}


# ---------------------------------------------------------------- batch


def latest(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot of each game."""
    o = F.struct("snapshot_time", "seq")
    return snapshots.groupBy("game_id").agg(*(F.max_by(c, o).alias(c) for c in ("status", "home_score", "away_score")), F.max("snapshot_time").alias("snapshot_time"))


def changed_rows(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Rows whose values differ from those of their key's previous row, and each key's first."""
    r = F.struct(*values)
    d = rows.withColumn("_p", F.lag(r).over(W.partitionBy(*keys).orderBy(*order)))
    return d.where(~F.col("_p").eqNullSafe(r)).drop("_p")


def changes(snapshots: DataFrame) -> DataFrame:
    """Snapshots that differ from their game's previous one."""
    values = ["status", "home_score", "away_score"]
    return changed_rows(snapshots, ["game_id"], ["snapshot_time", "seq"], values).select("game_id", "seq", *values)


def elapsed(periods: int) -> Column:
    """Share of regulation played, counting half of the current period."""
    return F.least((F.col("period") - 1) / periods + 1 / (2 * periods), F.lit(1.0))


def win_probability(snapshots: DataFrame, pregame: DataFrame, sport: str) -> DataFrame:
    """Pregame log odds fading with time plus the lead, which counts more the less time is left."""
    weight, periods = SPORTS[sport]
    d = snapshots.join(pregame.select("game_id", F.col("home_win_prob").alias("_pre")), "game_id")
    e = elapsed(periods)
    z = logit("_pre") * (1 - e) + (F.col("home_score") - F.col("away_score")) * weight / F.sqrt(1 - e + 0.02)
    return d.withColumn("home_win_prob", sigmoid(z)).drop("_pre")


#: fixed values: length of a period and of regulation, in minutes (baseball: innings); least time that counts as left
CLOCKS = {"basketball": (12.0, 48.0, 0.1), "football": (15.0, 60.0, 0.1), "hockey": (20.0, 60.0, 0.1), "baseball": (1.0, 9.0, 0.5), "soccer": (45.0, 90.0, 0.1)}


def _by_sport(sport: str, of: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for name, value in of.items():
        out = F.when(F.col(sport) == name, value) if out is None else out.when(F.col(sport) == name, value)
    return out.otherwise(otherwise)


def played(sport: str = "sport", period: str = "period", clock: str = "clock") -> tuple[Column, Column, Column]:
    """Time played, time left and time in all, from a period ("Q3", "P2", "Top 7", "2nd Half", "OT") and what its clock shows ("4:30").

    Without a clock a period has just begun. Overtime comes after regulation; other sports are taken as half played.
    """
    text = F.lower(F.coalesce(F.col(period), F.lit("")))
    digit = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, "[0-9]", 0), F.lit("")), F.lit("9")).cast("double"), F.lit(0.0))
    left = clock_seconds(clock) / 60
    over = text.contains("ot")

    def periods(name: str) -> Column:
        length, all_, _ = CLOCKS[name]
        number = F.when(over, F.greatest(digit, F.lit(all_ / length + 1))).otherwise(digit) if name != "football" else digit
        return F.greatest(number - 1, F.lit(0.0)) * length + (length - F.coalesce(left, F.lit(length)))

    inning = F.greatest(F.when(digit == 0, 1.0).otherwise(digit) - 1, F.lit(0.0)) + F.when(text.contains("top"), 0.0).otherwise(0.5)
    rest = F.coalesce(left, F.lit(45.0))
    extra, second = text.contains("et") | text.contains("extra"), text.contains("2") | text.contains("second")
    half = F.when(extra, 90 + (30 - rest)).when(second, 45 + (45 - rest)).otherwise(45 - rest)
    elapsed_ = _by_sport(sport, {n: periods(n) for n in ("basketball", "football", "hockey")} | {"baseball": inning, "soccer": half}, F.lit(30.0))
    remaining = {n: F.greatest(all_ - (F.least(elapsed_, F.lit(90.0)) if n == "soccer" else elapsed_), F.lit(least)) for n, (_, all_, least) in CLOCKS.items()}
    return elapsed_, _by_sport(sport, remaining, F.lit(30.0)), _by_sport(sport, {n: F.lit(all_) for n, (_, all_, _) in CLOCKS.items()}, F.lit(60.0))


def live_win_probability(snapshots: DataFrame, pregame: DataFrame) -> DataFrame:
    """Home win probability by the formula of the snapshot's sport (sport, period, clock, scores), from the pregame one.

    Pregame log odds plus the lead, which weighs more the less time is left. ``snapshots`` may be a stream, ``pregame`` (game_id,
    home_win_prob) is a table. Null scores count as 0; games without a pregame probability are even.
    """
    d = snapshots.join(pregame.select("game_id", F.col("home_win_prob").alias("_pre")), "game_id", "left")
    gone, left, all_ = played()
    d = d.withColumns({"_gone": gone, "_left": left, "_share": gone / F.greatest(all_, F.lit(1.0)), "_lead": F.coalesce("home_score", F.lit(0)) - F.coalesce("away_score", F.lit(0))})
    lead, left, share, inning = F.col("_lead"), F.col("_left"), F.col("_share"), 9 - F.col("_left")
    leverage = F.when(inning >= 8, 2.0).when(inning >= 7, 1.5).otherwise(1.0)
    shift = _by_sport(
        "sport",
        {
            "basketball": 0.35 * lead / F.sqrt(left + 1) + 0.03,
            "football": (0.3 + 0.5 * share) * 0.15 * lead - F.when((share > 0.75) & (lead < 0), 0.03).otherwise(0.0),
            "hockey": lead * 0.8 / F.sqrt(left / 20 + 0.5),
            "baseball": 0.4 * leverage * lead / F.sqrt(left + 0.5),
            "soccer": lead * 1.2 / F.sqrt(left / 15 + 0.5),
        },
        0.2 * lead / F.sqrt(left + 1),
    )
    return d.withColumn("home_win_prob", sigmoid(logit(F.coalesce("_pre", F.lit(0.5))) + shift)).withColumn("elapsed", F.col("_gone")).drop("_pre", "_gone", "_left", "_share", "_lead")


def projection(snapshots: DataFrame, periods: int = 4) -> DataFrame:
    """Final scores at the pace so far, and momentum as the lead's share of all points."""
    e = elapsed(periods)
    lead, all_ = F.col("home_score") - F.col("away_score"), F.col("home_score") + F.col("away_score")
    return snapshots.select("*", (F.col("home_score") / e).alias("home_final"), (F.col("away_score") / e).alias("away_final"), F.when(all_ > 0, lead / F.nullif(all_, F.lit(0))).otherwise(0.0).alias("momentum"))


def play_series(snapshots: DataFrame) -> DataFrame:
    w = W.partitionBy("game_id").orderBy("snapshot_time", "seq")
    return snapshots.select("game_id", "seq", (F.row_number().over(w) - 1).alias("play"))


def tumbling(snapshots: DataFrame, width: str) -> DataFrame:
    """Snapshots and points per window and status."""
    return snapshots.groupBy(F.window("snapshot_time", width).alias("w"), "status").agg(F.count("*").alias("n"), F.sum("home_score").alias("total")).select(F.col("w.start").alias("start"), "status", "n", "total")


# ---------------------------------------------------------------- streams


def read_snapshots(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Snapshot files as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_snapshots(stream: DataFrame, path: str, checkpoint: str):
    """Append the stream to a partitioned table."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Changes(StatefulProcessor):
    """The last (order, values) of a key as texts; forgotten when the watermark passes the key's newest row by ``life_ms``."""

    def __init__(self, life_ms: int):
        self.life_ms = life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros long, rank string, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        micros, rank, value = self.last.get() if self.last.exists() else (None, None, None)
        new = sorted((int(m), r, v, row) for pdf in rows if len(pdf) for m, r, v, row in zip(pdf["x_micros"], pdf["x_rank"], pdf["x_value"], pdf["x_row"], strict=True))
        if not new:  # a batch without rows of this key
            yield pd.DataFrame({"_row": pd.Series([], dtype="object")})
            return
        out = []
        for m, r, v, row in new:
            if micros is not None and (m, r) < (micros, rank):
                continue  # older than what has been emitted
            if v != value:
                out.append(row)
            micros, rank, value = m, r, v
        self.last.update((micros, rank, value))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(micros // 1000 + self.life_ms)
        yield pd.DataFrame({"_row": pd.Series(out, dtype="object")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"_row": pd.Series([], dtype="object")})

    def close(self) -> None:
        pass


def changed_stream(stream: DataFrame, keys: list[str] = ["game_id"], time: str = "snapshot_time", order: tuple[str, ...] = ("seq",), values: tuple[str, ...] = ("status", "home_score", "away_score"), late: str = "10 minutes", life: str = "2 days") -> DataFrame:  # noqa: B006
    """Rows whose values differ from their key's last row, across micro-batches and restarts (A, B, A gives three).

    Any of the values may be null, which is a value of its own. A row older than its key's last one is dropped, as are rows without a
    time or later than ``late``; a key without rows for ``life`` is forgotten, and its next row counts as its first. ``order`` (not
    negative longs) breaks ties of ``time``.
    """
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # what this operator needs; a running query keeps its own
    life_ms = int(pd.Timedelta(life).total_seconds() * 1000)
    names = stream.columns
    rank = F.concat_ws("|", *(F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("")), 20, "0") for c in order)) if order else F.lit("")
    d = stream.where(F.col(time).isNotNull()).withWatermark(time, late)
    d = d.select(  # no name begins with an underscore: Spark hands groups on as named tuples
        F.to_json(F.struct(*keys), {**_STAMP}).alias("x_key"), F.col(time), F.unix_micros(F.col(time).cast("timestamp")).alias("x_micros"), rank.alias("x_rank"),
        F.to_json(F.struct(*values), {**_STAMP}).alias("x_value"), F.to_json(F.struct(*names), {**_STAMP}).alias("x_row"),
    )
    out = d.groupBy("x_key").transformWithStateInPandas(_Changes(life_ms), "_row string", "append", "eventTime")
    return out.select(F.from_json("_row", stream.schema, {**_STAMP}).alias("r")).select("r.*")


LATEST = "game_id long, seq long, snapshot_time timestamp, status string, home_score long, away_score long"


def latest_table(spark: SparkSession, path: str, parts: int = 32) -> VersionedTable:
    """Each game's newest row, in hashed partitions."""
    return VersionedTable(spark, path, LATEST, ["game_id"], parts)


def keep_latest(stream: DataFrame, table: VersionedTable, checkpoint: str, keep: int = 5):
    """Merge every micro-batch into the table of newest rows by (time, seq); only partitions that it touches are written.

    A batch that comes again (the driver was lost after the commit, or before it) gives the same rows: the newest one of a key
    stays the newest.
    """
    names = [f.name for f in table.schema]

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch.groupBy("game_id").agg(F.max_by(F.struct(*names[1:]), F.struct("snapshot_time", "seq")).alias("x")).select("game_id", "x.*")
        table.upsert(rows, ["snapshot_time", "seq"])
        if epoch % (10 * keep) == 0:
            table.vacuum(keep)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pregame_quotes(quotes: DataFrame, games: DataFrame, before: str = "2 days", after: str = "0 seconds", late: str | None = None) -> DataFrame:
    """Quotes (game_id, ts, ...) from ``before`` a game's start (game_id, start) until ``after`` it.

    With ``late`` both sides are streams: their watermarks and the interval say how long a row of either side is kept, so state
    holds the rows of an interval and no more.
    """
    q, g = quotes, games.select(F.col("game_id").alias("_game"), "start")
    if late is not None:
        q, g = q.withWatermark("ts", late), g.withWatermark("start", late)
    near = F.expr(f"game_id = _game AND ts >= start - INTERVAL {before} AND ts <= start + INTERVAL {after}")
    return q.join(g, near).drop("_game")


def news_dedup(stream: DataFrame, time: str, headline: str, delay: str = "1 day") -> DataFrame:
    """One item per folded headline within the watermark."""
    return stream.withWatermark(time, delay).withColumn("key", fold(headline)).dropDuplicatesWithinWatermark(["key"])


def windowed(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """Windowed counts with bounded state."""
    return tumbling(stream.withWatermark("snapshot_time", delay), width)
