"""Streams in many micro-batches, with restarts, late rows and nulls, give what one batch gives."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fieldhouse.plans.fixtures import Tables
from fieldhouse.streaming import live


@pytest.fixture(scope="module")
def landed(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("live") / "in")
    d = Tables(spark, sf).live_snapshots.selectExpr("game_id", "seq", "CAST(snapshot_time AS timestamp) AS snapshot_time", "status", "home_score", "away_score", "period").where("game_id < 40")
    rows = sorted(d.collect(), key=lambda r: (r.snapshot_time, r.seq))
    k = len(rows) // 3 + 1
    for i in range(3):  # one file for each micro-batch, in order of time
        spark.createDataFrame(rows[i * k : (i + 1) * k], live.SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, df, name, checkpoint):
    """What one run until all is read appends."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q.start().awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def collected(spark, df, out, checkpoint):
    """The same through a table of files, which a restarted query can append to."""
    df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(180)
    return sorted(map(tuple, spark.read.schema(df.schema).parquet(out).collect()), key=str)


def test_append(spark, landed, tmp_path):
    q = live.append_snapshots(live.read_snapshots(spark, landed), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(landed).count()


# ---------------------------------------------------------------- newest rows


def test_latest(spark, landed, tmp_path):
    table = live.latest_table(spark, f"file://{tmp_path}/t", parts=8)
    live.keep_latest(live.read_snapshots(spark, landed), table, str(tmp_path / "cp")).awaitTermination(120)
    cols = ["game_id", "status", "home_score", "away_score", "snapshot_time"]
    got = {tuple(r) for r in table.read().select(cols).collect()}
    assert got == {tuple(r) for r in live.latest(spark.read.parquet(landed)).select(cols).collect()}
    assert len(table.versions()) == 3


def test_latest_with_a_lost_and_a_repeated_epoch(spark, tmp_path, monkeypatch):
    """Ties of time go by seq, across batches too; an epoch that dies before its commit and one that comes twice change nothing."""
    at = lambda m: datetime.datetime(2024, 1, 1, 12, m)
    path, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    table = live.latest_table(spark, f"file://{tmp_path}/t", parts=4)
    land(spark, path, [(1, 5, at(1), "live", 1, 0, 1), (2, 1, at(1), None, None, None, 1)], live.SCHEMA)
    live.keep_latest(live.read_snapshots(spark, path), table, cp).awaitTermination(120)
    land(spark, path, [(1, 4, at(1), "older by seq", 0, 0, 1), (2, 2, at(3), "live", 3, None, 2)], live.SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            live.keep_latest(live.read_snapshots(spark, path), table, cp).awaitTermination(120)
    assert len(table.versions()) == 1
    live.keep_latest(live.read_snapshots(spark, path), table, cp).awaitTermination(120)
    want = [(1, 5, at(1), "live", 1, 0), (2, 2, at(3), "live", 3, None)]
    assert sorted(map(tuple, table.read().collect())) == want
    again = spark.read.schema(live.SCHEMA).parquet(path)
    table.upsert(again.groupBy("game_id").agg(F.max_by(F.struct("seq", "snapshot_time", "status", "home_score", "away_score"), F.struct("snapshot_time", "seq")).alias("x")).select("game_id", "x.*"), ["snapshot_time", "seq"])
    assert sorted(map(tuple, table.read().collect())) == want


# ---------------------------------------------------------------- changes


def test_changes(spark, landed, tmp_path):
    cols = ["game_id", "seq", "status", "home_score", "away_score"]
    s = live.changed_stream(live.read_snapshots(spark, landed), late="400 days", life="4000 days").select(cols)
    assert sorted(run(spark, s, "changed", str(tmp_path / "cp"))) == sorted(map(tuple, live.changes(spark.read.parquet(landed)).select(cols).collect()))


def test_changes_over_restarts_with_nulls_and_late_rows(spark, tmp_path):
    """Before kick-off scores are null. One file a run: state comes from the checkpoint each time."""
    at = lambda m: datetime.datetime(2024, 1, 1, 12, 0) + datetime.timedelta(minutes=m)
    path, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [
        [(1, 1, at(0), "pre", None, None, None), (1, 2, at(1), "pre", None, None, None), (2, 1, at(0), None, None, None, None)],
        [(1, 3, at(2), "live", 0, 0, 1), (1, 4, at(3), "live", 0, None, 1), (2, 2, at(2), None, None, None, None), (3, 1, None, "no time", 1, 1, 1)],
        [(1, 2, at(1), "late", 9, 9, 1), (1, 5, at(4), "live", 0, None, 1), (1, 6, at(5), "live", 0, 0, 1), (2, 3, at(3), "live", 0, 0, 1)],
    ]
    for rows in batches:
        land(spark, path, rows, live.SCHEMA)
        got = collected(spark, live.changed_stream(live.read_snapshots(spark, path), late="1 hour", life="1 day"), out, cp)
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in got] == [(1, 1, "pre", None, None), (1, 3, "live", 0, 0), (1, 4, "live", 0, None), (1, 6, "live", 0, 0), (2, 1, None, None, None), (2, 3, "live", 0, 0)]
    assert got[0][2] == at(0) and got[1][6] == 1


def test_state_of_a_quiet_key_expires(spark, tmp_path):
    """After its lifetime a key counts as new; a key that keeps reporting does not."""
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    path, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for h, games in ((0, [1, 2]), (8, [2]), (16, [2]), (30, [2]), (31, [1, 2])):
        land(spark, path, [(g, h, at(h), "live", 0, 0, 1) for g in games], live.SCHEMA)
        got = collected(spark, live.changed_stream(live.read_snapshots(spark, path), late="0 seconds", life="15 hours"), out, cp)
    assert [(r[0], r[1]) for r in got] == [(1, 0), (1, 31), (2, 0)]


ODDS = "game_id long, bookmaker long, ts timestamp, seq long, tie long, h2h_home double, h2h_away double, spread_home double, total_line double"


def test_changed_odds_by_game_and_bookmaker(spark, sf, tmp_path):
    """Several micro-batches of quotes give what the batch query gives."""
    odds = Tables(spark, sf).odds.where("game_id < 600").selectExpr(*(f"CAST({c.rsplit(' ', 1)[0]} AS {c.rsplit(' ', 1)[1]}) AS {c.rsplit(' ', 1)[0]}" for c in ODDS.split(", ")))
    rows = sorted(map(tuple, odds.collect()), key=lambda r: (r[2], r[3], r[4]))
    again = [(*r[:3], r[3] + 100, *r[4:]) for r in rows[::3]]  # each third quote comes a second time, unchanged
    rows = sorted(rows + again, key=lambda r: (r[2], r[3], r[4]))
    path, k = str(tmp_path / "in"), len(rows) // 4 + 1
    for i in range(4):
        land(spark, path, rows[i * k : (i + 1) * k], ODDS)
    values = ("h2h_home", "h2h_away", "spread_home", "total_line")
    stream = spark.readStream.schema(ODDS).option("maxFilesPerTrigger", 1).parquet(path)
    s = live.changed_stream(stream, ["game_id", "bookmaker"], "ts", ("seq", "tie"), values, late="4000 days", life="9000 days")
    want = live.changed_rows(spark.read.parquet(path), ["game_id", "bookmaker"], ["ts", "seq", "tie"], list(values))
    assert sorted(run(spark, s, "odds", str(tmp_path / "cp"))) == sorted(map(tuple, want.collect()))
    assert want.count() < len(rows)


# ---------------------------------------------------------------- quotes before a game


def test_pregame_quotes_of_two_streams(spark, tmp_path):
    """Both sides in pieces, quotes before their game is known and after; equal to the batch join, and state goes when it can."""
    r = random.Random(4)
    t0 = datetime.datetime(2024, 1, 1)
    games = [(g, t0 + datetime.timedelta(hours=6 * g)) for g in range(24)]
    quotes = sorted(((g, r.randrange(3), s + datetime.timedelta(minutes=r.randrange(-4000, 600)), float(r.randrange(-200, 200))) for g, s in games for _ in range(12)), key=lambda x: x[2])
    quotes.append((None, 1, t0, 1.0))
    a, b, gs, qs = str(tmp_path / "games"), str(tmp_path / "quotes"), "game_id long, start timestamp", "game_id long, bookmaker long, ts timestamp, price double"
    for i in range(3):
        land(spark, a, games[i * 8 : (i + 1) * 8], gs)
        land(spark, b, quotes[i * len(quotes) // 3 : (i + 1) * len(quotes) // 3], qs)
    read = lambda p, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(p)
    s = live.pregame_quotes(read(b, qs), read(a, gs), "2 days", "0 seconds", late="30 days")
    want = sorted(map(tuple, live.pregame_quotes(spark.read.parquet(b), spark.read.parquet(a), "2 days").collect()))
    assert sorted(run(spark, s, "pre", str(tmp_path / "cp"))) == want
    inside = [(g, k, t, p, dict(games)[g]) for g, k, t, p in quotes if g is not None and dict(games)[g] - datetime.timedelta(days=2) <= t <= dict(games)[g]]
    assert want == sorted(inside) and 0 < len(want) < len(quotes)
    # once the watermarks are past, rows of either side are gone from state
    q = live.pregame_quotes(read(b, qs), read(a, gs), "2 hours", late="1 hour").writeStream.format("memory").queryName("gone").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]) < len(games) + len(quotes)


def test_news_and_windows(spark, landed, tmp_path):
    s = live.read_snapshots(spark, landed)
    q = live.news_dedup(s, "snapshot_time", "status", "365 days").select("key").writeStream.format("memory").queryName("news").outputMode("append").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("news").count() == spark.table("news").distinct().count() == spark.read.parquet(landed).select("status").distinct().count()
    w = live.windowed(s, "1 hour", "1 day").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, live.tumbling(spark.read.parquet(landed), "1 hour").collect()))
