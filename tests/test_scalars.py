"""Golden values of scalar expressions and of landed-file readers."""

import math

import pytest
from pyspark.sql import functions as F

from fieldhouse.functions import scalars as S
from fieldhouse.sources import readers as R


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        (lambda: S.american_to_decimal(F.lit(150.0)), 2.5),
        (lambda: S.american_to_decimal(F.lit(-200.0)), 1.5),
        (lambda: S.american_to_decimal(F.lit(50.0)), 2.0),
        (lambda: S.american_to_implied(F.lit(-150.0)), 0.6),
        (lambda: S.moneyline_probability(F.lit(0.0)), 0.5),
        (lambda: S.decimal_to_american(F.lit(1.5)), -200.0),
        (lambda: S.profit(F.lit(100.0), F.lit(-110.0)), 90.9090909),
        (lambda: S.kelly(F.lit(0.6), F.lit(2.0)), 0.05),
        (lambda: S.kelly(F.lit(0.4), F.lit(2.0)), 0.0),
        (lambda: S.iso_minutes(F.lit("PT32M15.00S")), 32.25),
        (lambda: S.clock_seconds(F.lit("07:30")), 450),
        (lambda: S.innings(F.lit("6.1")), 6.3333333),
        (lambda: S.record_part(F.lit("10-4-1"), 2), 1),
        (lambda: S.record_part(F.lit("10-4"), 2), None),
        (lambda: S.streak(F.lit("L3")), -3),
        (lambda: S.last_first(F.lit("Ruth, Babe")), "Babe Ruth"),
        (lambda: S.snake(F.lit("RunsBattedIn (RBI)")), "runs_batted_in_rbi"),
        (lambda: S.fold(F.lit(" Dončić ")), "doncic"),
        (lambda: S.compass(F.lit(350.0)), "N"),
        (lambda: S.compass(F.lit(95.0)), "E"),
        (lambda: S.erf(F.lit(0.5)), math.erf(0.5)),
        (lambda: S.normal_over(F.lit(10.0), F.lit(12.0), F.lit(2.0)), 0.8413447),
        (lambda: S.poisson_over(F.lit(2.5), F.lit(3.0)), 0.5768099),
        (lambda: S.is_clean(F.lit(float("nan"))), None),
        (lambda: S.over_line(F.lit("points_over_25")), 25),
        (lambda: S.season_of(F.lit("2024-03-01").cast("date"), 10), 2023),
        (lambda: S.season_of(F.lit("2024-03-01").cast("date"), 10, "end"), 2024),
    ],
)
def test_values(spark, expr, want):
    got = one(spark, expr())
    assert got == want or got == pytest.approx(want, abs=1e-6)


def test_batting_line(spark):
    line = S.batting_line(*(F.lit(float(x)) for x in (100, 30, 5, 2, 4, 10, 2, 1, 3)))
    r = spark.range(1).select(*(c.alias(n) for n, c in line.items())).first()
    assert (r.pa, r.total_bases) == (116, 51)
    assert [round(x, 3) for x in (r.avg, r.obp, r.slg, r.ops)] == [0.3, 0.365, 0.51, 0.875]


def test_labelled_stats(spark):
    d = spark.createDataFrame([(["MIN", "FG", "3PT", "PTS", "+/-"], ["34", "8-17", "2-5", "20", "+11"])], "l array<string>, v array<string>")
    r = d.select(*R.labelled_stats(F.col("l"), F.col("v"), ["fg_made", "fg_att", "fg3_made", "pts", "plus_minus", "blk"])).first()
    assert tuple(r) == (8, 17, 2, 20.0, 11.0, None)


def test_matrix(spark):
    d = spark.createDataFrame([(["GAME_ID", "PTS"], [["1", "10"], ["2", None]])], "headers array<string>, rows array<array<string>>")
    assert [tuple(r) for r in R.matrix(d, "headers", "rows", ["game_id", "pts", "absent"]).collect()] == [("1", "10", None), ("2", None, None)]


def test_races(spark):
    j = '{"MRData":{"RaceTable":{"season":"2024","Races":[{"season":"2024","round":"1","raceName":"A","Circuit":{"circuitId":"c","circuitName":"C"},"date":"2024-03-02","Results":[{"position":"1","points":"25","grid":"2","laps":"57","status":"Finished","Driver":{"driverId":"d","givenName":"G","familyName":"F"},"Constructor":{"constructorId":"t"}}],"Laps":[{"number":"1","Timings":[{"driverId":"d","position":"1","time":"1:37.284"}]}],"PitStops":[{"driverId":"d","stop":"1","lap":"20","duration":"22.5"}]}]}}}'
    d = spark.createDataFrame([(j,)], "j string").select(F.from_json("j", R.RACES).alias("x")).select("x.*")
    r = R.race_results(d).first()
    assert (r.season, r.driver_id, r.driver, r.points, r.grid) == (2024, "d", "G F", 25.0, 2)
    assert R.race_laps(d).first().seconds == pytest.approx(97.284)
    assert R.race_pit_stops(d).first().seconds == 22.5


def test_rss(spark):
    x = '<rss><channel><item><title><![CDATA[One & <b>two</b>]]></title><link>http://a</link><pubDate>d</pubDate><media:content url="m"/></item><item><title>B</title></item></channel></rss>'
    rows = R.rss_items(spark.createDataFrame([(x,)], "t string"), "t").collect()
    assert [(r.title, r.link, r.media) for r in rows] == [("One & two", "http://a", "m"), ("B", "", None)]


def test_depth_chart_and_plays(spark):
    d = spark.createDataFrame([("t", {"QB": ["a", "b"]})], "team string, chart map<string,array<string>>")
    assert [(r.position, r["rank"], r.athlete) for r in R.depth_chart(d, "team", "chart").collect()] == [("QB", 1, "a"), ("QB", 2, "b")]
    j = '{"game_id":"g","plays":[{"id":"1","period":1,"clock":"10:00","text":"x","scoring":true,"home_score":2,"away_score":0}]}'
    p = spark.createDataFrame([(j,)], "j string").select(F.from_json("j", R.PLAYS).alias("x")).select("x.*")
    assert R.play_by_play(p).first().seq == 0


def test_esports(spark):
    j = '{"id":"m","status":"finished","opponents":[{"id":"a","name":"A"},{"id":"b","name":"B"}],"games":[{"position":1,"map":"x","winner":"a","length":1800}]}'
    d = spark.createDataFrame([(j,)], "j string").select(F.from_json("j", R.MATCHES).alias("x")).select("x.*")
    assert tuple(R.esports_maps(d).first())[:5] == ("m", "finished", "a", "b", 1)
    assert R.esports_rosters(d).count() == 2


def test_newest_predictions(spark):
    rows = [("s", "2024-01-03", []), ("s", "2024-01-02", [(0.6,)]), ("s", "2024-01-01", [(0.1,)])]
    d = spark.createDataFrame(rows, "sport string, file_date string, predictions array<struct<p:double>>")
    assert [(r.file_date, r.p) for r in R.newest_predictions(d).collect()] == [("2024-01-02", 0.6)]
