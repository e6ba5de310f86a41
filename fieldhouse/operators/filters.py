"""Filters, sorts and pages; ``now`` is always a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.scalars import is_clean

DATE_COLUMNS = ("date", "start_date", "game_date", "start_time")


def on_date(df: DataFrame, prefix: str) -> DataFrame:
    """Rows where any date column that is there begins with the text."""
    there = [c for c in DATE_COLUMNS if c in df.columns]
    if not there:
        return df
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.col(c).cast("string").startswith(prefix), F.lit(False)) for c in there)))


def between_dates(df: DataFrame, first: str | None, last: str | None, date: str = "date") -> DataFrame:
    """Inclusive range; an open end is null."""
    if first:
        df = df.where(F.col(date) >= F.lit(first).cast("date"))
    return df.where(F.col(date) <= F.lit(last).cast("date")) if last else df


def of_team(df: DataFrame, team: str, names: list[str], ids: list[str]) -> DataFrame:
    """A team by part of its name in any case, or by exact id."""
    hits = [F.lower(F.col(n)).contains(team.lower()) for n in names] + [F.col(i).cast("string") == team for i in ids]
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(h, F.lit(False)) for h in hits)))


def filter_eq(df: DataFrame, **wanted) -> DataFrame:
    """Equality on the columns that are there; a null wish or an absent column filters nothing."""
    for c, v in wanted.items():
        if v is not None and c in df.columns:
            df = df.where(F.col(c).cast("string") == str(v))
    return df


def is_closed(status: str = "status") -> Column:
    return F.lower(F.col(status)).rlike("final|closed|complete|finished|ended|^ft$")


def is_open(status: str = "status") -> Column:
    return ~F.coalesce(is_closed(status), F.lit(False))


def ordered(df: DataFrame, by: str, tie: str) -> DataFrame:
    """``name`` ascending with nulls last, ``-name`` descending with nulls first; ties by ``tie``."""
    return df.orderBy(F.col(by[1:]).desc_nulls_first() if by.startswith("-") else F.col(by).asc_nulls_last(), F.col(tie))


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Part of an ordered frame."""
    return df.offset(offset).limit(limit)


def page_info(df: DataFrame, limit: int) -> DataFrame:
    n = df.agg(F.count("*").alias("total"))
    return n.select("total", F.lit(limit).alias("limit"), F.ceil(F.col("total") / limit).alias("pages"))


def newest(df: DataFrame, order: str, partition: list[str]) -> DataFrame:
    """Rows of the largest ``order`` of each partition."""
    return df.withColumn("_m", F.max(order).over(W.partitionBy(*partition))).where(F.col(order) == F.col("_m")).drop("_m")


def upcoming(df: DataFrame, as_of: str, days: int, date: str = "date") -> DataFrame:
    """Open games from a day on, for so many days."""
    d = F.lit(as_of).cast("date")
    return df.where(is_open() & (F.col(date) >= d) & (F.col(date) < F.date_add(d, days)))


def in_window(df: DataFrame, time: str, as_of: str, before_min: int, after_min: int) -> DataFrame:
    """Rows whose time lies within ``before_min`` minutes before and ``after_min`` after."""
    now = F.lit(as_of).cast("timestamp_ntz")
    t = F.col(time).cast("timestamp_ntz")
    return df.where((t >= now - F.make_dt_interval(mins=F.lit(before_min))) & (t <= now + F.make_dt_interval(mins=F.lit(after_min))))


def pick_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Of the wanted columns those that are there, in the order wanted."""
    return df.select(*[c for c in wanted if c in df.columns])


def scrub(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns as null."""
    return df.select(*(is_clean(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields))


def capped(df: DataFrame, partition: list[str], order: list[Column], most: int) -> DataFrame:
    """At most so many rows of each partition, first in order."""
    w = W.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
