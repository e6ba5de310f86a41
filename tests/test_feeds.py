"""Race feeds of the fixtures: texts of bounded length, parsed once, with the parts that are asked for."""

from pyspark.sql import functions as F

from fieldhouse.plans import source_queries as S
from fieldhouse.plans.fixtures import Tables
from fieldhouse.sources import readers as R


def test_tables_of_a_season_come_in_pages(spark, sf):
    lists = S.standings(Tables(spark, sf)).select(F.explode("MRData.StandingsTable.StandingsLists").alias("l"))
    sizes = lists.agg(F.max(F.size("l.DriverStandings")), F.max(F.size("l.ConstructorStandings")), F.count("*"), F.countDistinct("l.season")).first()
    assert sizes[0] <= S.PAGE and sizes[1] <= 10 and sizes[2] > 2 * sizes[3]


def test_texts_are_parsed_once(spark, sf):
    t = Tables(spark, sf)
    for d in (R.race_results(S.races(t, "Results")), R.race_qualifying(S.races(t, "QualifyingResults")), R.race_sessions(S.races(t))):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1, plan


def test_feeds_have_the_parts_asked_for(spark, sf):
    r = S.races(Tables(spark, sf), "Laps").select(F.explode("MRData.RaceTable.Races").alias("r")).select("r.*").agg(*(F.count(c).alias(c) for c in ("Laps", "Results", "PitStops", "QualifyingResults"))).first()
    assert r.Laps > 0 and r.Results == r.PitStops == r.QualifyingResults == 0
