"""Sports-shaped views over the star-schema tables, as one SQL text for Spark and for the oracle."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

GAMES = """SELECT o_orderkey AS game_id, c_mktsegment AS sport, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS BIGINT) AS season,
 o_custkey AS home_team_id, o_custkey + 1 + (o_orderkey % 7) AS away_team_id,
 CAST(CASE WHEN o_orderstatus = 'F' THEN 70 + CAST(floor(o_totalprice) AS BIGINT) % 60 END AS DOUBLE) AS home_score,
 CAST(CASE WHEN o_orderstatus = 'F' THEN 70 + CAST(floor(o_totalprice / 7) AS BIGINT) % 60 END AS DOUBLE) AS away_score,
 CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'scheduled' ELSE 'in_progress' END AS status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

TEAMS = """SELECT c_custkey AS team_id, c_name AS name, c_mktsegment AS sport, n_name AS conference, r_name AS division
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

ODDS = """SELECT l_orderkey AS game_id, l_suppkey % 5 AS bookmaker, l_shipdate AS ts,
 CAST(CASE WHEN l_partkey % 2 = 0 THEN -(110 + l_partkey % 200) ELSE 110 + l_partkey % 200 END AS DOUBLE) AS h2h_home,
 CAST(CASE WHEN l_partkey % 2 = 0 THEN 100 + l_partkey % 180 ELSE -(120 + l_partkey % 180) END AS DOUBLE) AS h2h_away,
 CAST(l_linenumber - 4 AS DOUBLE) + 0.5 AS spread_home, 150.0 + l_quantity AS total_line, l_linenumber AS seq, l_partkey AS tie
FROM {lineitem}"""

PLAYER_STATS = """SELECT l_orderkey AS game_id, l_partkey AS player_id, l_linenumber AS seq,
 CASE WHEN l_linenumber % 2 = 0 THEN o_custkey ELSE o_custkey + 1 + (o_orderkey % 7) END AS team_id,
 CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS BIGINT) AS season, l_quantity AS pts,
 CAST(l_suppkey % 12 AS DOUBLE) AS reb, CAST(l_partkey % 9 AS DOUBLE) AS ast, l_quantity * 0.5 + 10 AS minutes,
 CASE WHEN l_returnflag = 'N' THEN 'a' ELSE 'b' END AS source
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""

PREDICTIONS = """SELECT o_orderkey AS game_id, c_mktsegment AS sport, CAST(o_orderdate AS DATE) AS date,
 0.05 + CAST((o_orderkey * 37) % 91 AS DOUBLE) / 100 AS home_win_prob, 0.95 - CAST((o_orderkey * 37) % 91 AS DOUBLE) / 100 AS away_win_prob,
 CAST(CASE WHEN o_orderstatus = 'F' THEN 70 + CAST(floor(o_totalprice) AS BIGINT) % 60 END AS DOUBLE) AS home_score,
 CAST(CASE WHEN o_orderstatus = 'F' THEN 70 + CAST(floor(o_totalprice / 7) AS BIGINT) % 60 END AS DOUBLE) AS away_score
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

INJURIES = """SELECT c_custkey AS player_id, c_custkey % 40 AS team_id,
 CASE c_nationkey % 4 WHEN 0 THEN 'Out' WHEN 1 THEN 'Day-To-Day' WHEN 2 THEN 'Questionable' ELSE 'Active' END AS status
FROM {customer}"""

SNAPSHOTS = """SELECT user_id AS game_id, event_id AS seq, ts AS snapshot_time, event_type AS status,
 CAST(floor(value) AS BIGINT) % 60 AS home_score, CAST(floor(value * 3) AS BIGINT) % 60 AS away_score, CAST(1 + event_id % 4 AS INT) AS period
FROM {events}"""

NEWS = """SELECT doc_id AS id, source AS provider, lower(trim(substr(text, 1, 40))) AS headline, lang FROM {documents}"""

BOUTS = """SELECT o_orderkey AS game_id, c_mktsegment AS sport, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS BIGINT) AS season,
 o_custkey AS home_team_id, o_custkey + 1 + (o_orderkey % 7) AS away_team_id,
 CAST(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) % 4 END AS DOUBLE) AS home_score,
 CAST(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice / 7) AS BIGINT) % 4 END AS DOUBLE) AS away_score,
 CASE o_orderstatus WHEN 'F' THEN 'final' ELSE 'scheduled' END AS status,
 CASE o_orderkey % 5 WHEN 0 THEN 'KO/TKO' WHEN 1 THEN 'Submission' WHEN 2 THEN 'Decision - Unanimous' WHEN 3 THEN '' END AS method,
 CAST(CASE WHEN o_orderkey % 11 <> 0 THEN 1 + o_orderkey % 3 END AS DOUBLE) AS finish_round,
 CASE o_custkey % 4 WHEN 0 THEN 'Clay' WHEN 1 THEN 'Grass' WHEN 2 THEN 'Hard' END AS surface
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

FINISHES = """SELECT l_orderkey AS game_id, l_partkey AS player_id, min(CAST(o_orderdate AS DATE)) AS date, min(o_custkey % 6) AS circuit_id,
 CAST(min(CASE WHEN l_suppkey % 9 > 0 THEN l_linenumber * 6 - 5 END) AS DOUBLE) AS position, CAST(min(l_suppkey % 21 - 10) AS DOUBLE) AS score_to_par,
 CAST(max(CASE WHEN l_suppkey % 9 > 0 THEN 4 ELSE 2 END) AS DOUBLE) AS rounds
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_partkey"""

_QUARTERS = ", ".join(f"CAST(CAST(floor(o_totalprice / {d}) AS BIGINT) % 3 AS DOUBLE) AS {side}_q{q}" for side, ds in (("home", (3, 11, 13, 17)), ("away", (5, 7, 19, 23))) for q, d in enumerate(ds, 1))
_EXTRA = ", ".join(f"CAST(CASE WHEN o_orderkey % 5 = 0 THEN CAST(floor(o_totalprice / {d}) AS BIGINT) % 2 END AS DOUBLE) AS {side}_ot" for side, d in (("home", 29), ("away", 31)))
PERIOD_SCORES = f"""SELECT *, home_q1 + home_q2 + home_q3 + home_q4 + coalesce(home_ot, 0) AS home_score, away_q1 + away_q2 + away_q3 + away_q4 + coalesce(away_ot, 0) AS away_score
FROM (SELECT o_orderkey AS game_id, o_orderpriority AS sport, {_QUARTERS}, {_EXTRA}, CAST(6 + o_orderkey % 3 AS DOUBLE) AS total_line, CAST(3 + o_orderkey % 2 AS DOUBLE) AS home_line, CAST(4 - o_orderkey % 2 AS DOUBLE) AS away_line FROM {{orders}} WHERE o_orderstatus = 'F') q"""

VIEWS = {"games": GAMES, "teams": TEAMS, "odds": ODDS, "player_stats": PLAYER_STATS, "predictions": PREDICTIONS, "injuries": INJURIES, "live_snapshots": SNAPSHOTS, "news": NEWS, "bouts": BOUTS, "finishes": FINISHES, "period_scores": PERIOD_SCORES}
BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


#: most bytes that a task reads of a file, and of a shuffle after merging: rows in memory take some 30 to 60 times that of narrow tables
BOUNDS = {"spark.sql.files.maxPartitionBytes": 16 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20}
#: bytes of the tables for a partition of a shuffle
A_PARTITION = 2 << 20


def in_bytes(size: str) -> int:
    """Bytes of a size as Spark writes it: 64MB, 16m, 1048576b."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)i?b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


class Tables:
    """The base tables of a folder and the sports views over them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.bytes = spark, sf_dir, 0
        for key, most in BOUNDS.items():
            if in_bytes(spark.conf.get(key)) > most:
                spark.conf.set(key, str(most))

    def base(self, name: str) -> DataFrame:
        """The table; shuffles get partitions by the bytes read so far, of which adaptive execution merges the small ones."""
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        self.bytes += int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
        need, key = self.bytes // A_PARTITION, "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
        if need > int(self.spark.conf.get(key, None) or self.spark.conf.get("spark.sql.shuffle.partitions")):
            self.spark.conf.set(key, str(need))
        return df

    def view(self, name: str) -> DataFrame:
        used = {b: self.base(b) for b in BASE if f"{{{b}}}" in VIEWS[name]}
        return self.spark.sql(VIEWS[name], **used)

    games = cached_property(lambda self: self.view("games"))
    teams = cached_property(lambda self: self.view("teams"))
    odds = cached_property(lambda self: self.view("odds"))
    player_stats = cached_property(lambda self: self.view("player_stats"))
    predictions = cached_property(lambda self: self.view("predictions"))
    injuries = cached_property(lambda self: self.view("injuries"))
    live_snapshots = cached_property(lambda self: self.view("live_snapshots"))
    news = cached_property(lambda self: self.view("news"))
    bouts = cached_property(lambda self: self.view("bouts"))
    finishes = cached_property(lambda self: self.view("finishes"))
    period_scores = cached_property(lambda self: self.view("period_scores"))


def with_views(sql: str) -> str:
    """The oracle text with the views it names in front."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({VIEWS[v].format(**{b: b for b in BASE})})" for v in used)
    body = sql.strip()
    if not head:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head}, {body[len(start):]}"
    return f"WITH {head} {body}"
