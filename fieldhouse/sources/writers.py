"""Curated writes: partition layout, routing, merges and incremental appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: sports whose seasons are split by week rather than by date
WEEKLY = ("nfl", "ncaaf")


def partition_columns(df: DataFrame, sport: str) -> tuple[DataFrame, list[str]]:
    """Rows with their partition columns; rows without a season are dropped (they would become a default partition)."""
    d = df.where("season IS NOT NULL")
    if sport in WEEKLY:
        week = F.col("week").cast("string") if "week" in df.columns else F.weekofyear("date").cast("string")
        return d.withColumn("week", F.lpad(week, 2, "0")).where("week IS NOT NULL"), ["season", "week"]
    return d.where("date IS NOT NULL"), ["season", "date"]


def write_partitioned(df: DataFrame, path: str, sport: str) -> None:
    """Overwrite the partitions that the rows touch, and no others; files are compressed with zstd.

    Rows are dealt by partition values first, so each partition is written by few tasks.
    """
    d, by = partition_columns(df, sport)
    d.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def route(df: DataFrame, routing: DataFrame, kind: str) -> DataFrame:
    """Storage category of each kind by a routing table; kinds without a route keep their name."""
    r = routing.select(F.col("kind").alias(kind), "category")
    return df.join(r, kind, "left").withColumn("category", F.coalesce("category", F.col(kind)))


def absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key is not stored yet."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def merge_last(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in load order."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return parts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def consolidate(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """History plus new rows; where both have a key the new row wins."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def changed_since(df: DataFrame, time: str, keys: list[str]) -> DataFrame:
    """Partitions with files newer than the last sync."""
    m = df.select(*keys, F.col("_metadata.file_modification_time").alias("_t"))
    return m.groupBy(*keys).agg(F.max("_t").alias("newest")).where(F.col("newest") > F.lit(time).cast("timestamp"))


def by_date(parts: list[DataFrame], path: str) -> None:
    """Per-sport prediction sets regrouped by date."""
    from functools import reduce

    d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    d.repartition("date").write.mode("overwrite").option("compression", "zstd").partitionBy("date").parquet(path)
