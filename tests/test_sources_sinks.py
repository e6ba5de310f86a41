"""Round trips through files."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldhouse.plans.fixtures import Tables
from fieldhouse.sources import readers as R
from fieldhouse.sources import writers as Wr


def test_partitioned_round_trip_and_overwrite(spark, sf, tmp_path):
    g = Tables(spark, sf).games
    path = str(tmp_path / "games")
    Wr.write_partitioned(g, path, "nba")
    assert R.load(spark, path, "all").count() == g.count()
    one = g.where("season = 1995").limit(1)
    Wr.write_partitioned(one.withColumn("home_score", F.lit(1.0)), path, "nba")
    day = one.first().date
    back = R.load(spark, path, 1995, f"date = DATE'{day}'")
    assert back.count() == 1 and back.first().home_score == 1.0
    assert R.load(spark, path, None).select("season").distinct().count() == 1
    plan = R.load(spark, path, 1995)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "season" in plan.split("PartitionFilters")[1][:80]


def test_weekly_layout_drops_null_partitions(spark):
    d = spark.createDataFrame([(2024, "2024-09-08", 1), (None, "2024-09-08", 2)], "season int, date string, id int").withColumn("date", F.to_date("date"))
    rows, by = Wr.partition_columns(d, "nfl")
    assert by == ["season", "week"] and [(r.id, r.week) for r in rows.collect()] == [(1, "36")]


def test_drifting_parquet(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, "x")], "id int, name string").write.parquet(a)
    spark.createDataFrame([("2", 5.0)], "id string, pts double").write.parquet(b)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("pts", T.DoubleType())])
    assert sorted(map(tuple, R.scan(spark, [a, b], schema).collect()), key=str) == [(1, "x", None), (2, None, 5.0)]


def test_csv_snake_columns(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("playerID,birthYear,HomeRuns\nruthba01,1895,714\nx,,\n")
    d = R.snake_columns(R.read_csv(spark, str(p), "playerID string, birthYear string, HomeRuns string"), ["birth_year", "home_runs"])
    assert d.columns == ["player_id", "birth_year", "home_runs"]
    assert [tuple(r) for r in d.collect()] == [("ruthba01", 1895.0, 714.0), ("x", None, None)]


def test_by_date_and_changed_since(spark, sf, tmp_path):
    p = Tables(spark, sf).predictions
    path = str(tmp_path / "p")
    Wr.by_date([p.where("sport = 'BUILDING'"), p.where("sport <> 'BUILDING'")], path)
    back = spark.read.parquet(path)
    assert back.count() == p.count()
    assert Wr.changed_since(back, "2000-01-01", ["date"]).count() == p.select("date").distinct().count()
    assert Wr.changed_since(back, "2100-01-01", ["date"]).count() == 0


def test_lineage_and_inventory(spark, tmp_path):
    """The category is the folder that a file lies in, below partition folders; files and newest times are counted by key."""
    path = str(tmp_path / "odds")
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, vendor string")
    d.where("vendor = 'a'").repartition(2, "id").write.parquet(path)
    d.where("vendor = 'b'").coalesce(1).write.mode("append").parquet(path)
    back = spark.read.parquet(path)
    assert {(r.id, r.raw_category) for r in R.with_lineage(back).collect()} == {(1, "odds"), (2, "odds"), (3, "odds")}
    got = {r.vendor: r for r in R.inventory(back, ["vendor"]).collect()}
    files = [p for p in (tmp_path / "odds").glob("part-*.parquet")]
    assert got["a"].files + got["b"].files == len(files) and got["b"].files == 1
    assert max(r.newest for r in got.values()).timestamp() == max(p.stat().st_mtime_ns // 10**6 for p in files) / 1000
