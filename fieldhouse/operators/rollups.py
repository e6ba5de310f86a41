"""Rollups kept as partial aggregates, one set for each source partition.

A rollup is a fold of numbers that add up (counts, sums, sums of squares, extremes). The store holds them by (source
partition, group); a refresh compares content fingerprints, computes the partials of new and changed partitions alone, drops
those of partitions that are gone, and leaves all others as they lie. Reading folds the partials, far fewer rows than the source.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import written
from ..sources.versioned import VersionedTable
from .quality import changed, fingerprints


@dataclass(frozen=True)
class Measure:
    """``parts``: name, column, how it folds (sum, min or max); ``value``: the result from the folded parts."""

    parts: tuple[tuple[str, Column, str], ...]
    value: Column
    types: tuple[str, ...] = field(default=())


def count(name: str, when: Column | None = None) -> tuple[str, Measure]:
    one = F.lit(1) if when is None else F.when(when, 1).otherwise(0)
    return name, Measure(((f"{name}_n", one.cast("long"), "sum"),), F.col(f"{name}_n"), ("long",))


def total(name: str, value: str | Column) -> tuple[str, Measure]:
    v = F.col(value) if isinstance(value, str) else value
    return name, Measure(((f"{name}_s", v.cast("double"), "sum"),), F.col(f"{name}_s"), ("double",))


def mean(name: str, value: str | Column) -> tuple[str, Measure]:
    """Null values count for nothing."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    parts = (f"{name}_s", v, "sum"), (f"{name}_n", F.when(v.isNotNull(), 1).otherwise(0).cast("long"), "sum")
    return name, Measure(parts, F.col(f"{name}_s") / F.nullif(F.col(f"{name}_n"), F.lit(0)), ("double", "long"))


def deviation(name: str, value: str | Column) -> tuple[str, Measure]:
    """Sample deviation; null under two values."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    parts = (f"{name}_s", v, "sum"), (f"{name}_q", v * v, "sum"), (f"{name}_n", F.when(v.isNotNull(), 1).otherwise(0).cast("long"), "sum")
    n, s, q = F.col(f"{name}_n"), F.col(f"{name}_s"), F.col(f"{name}_q")
    return name, Measure(parts, F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / F.when(n > 1, n - 1))), ("double", "double", "long"))


def extreme(name: str, value: str | Column, how: str) -> tuple[str, Measure]:
    v = F.col(value) if isinstance(value, str) else value
    return name, Measure(((f"{name}_x", v.cast("double"), how),), F.col(f"{name}_x"), ("double",))


_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


class Rollup:
    """``by``: name and type of the group's columns; ``partition``: those of the source's partitions (rows where one is null are left out)."""

    def __init__(self, spark: SparkSession, path: str, partition: dict[str, str], by: dict[str, str], measures: dict[str, Measure], parts: int = 32):
        self.partition, self.by, self.measures = list(partition), list(by), measures
        named = {f"p_{k}": t for k, t in partition.items()} | by
        columns = [*(f"{k} {t}" for k, t in named.items()), *(f"{p[0]} {t}" for m in measures.values() for p, t in zip(m.parts, m.types, strict=True))]
        self.partials = VersionedTable(spark, f"{path}/partials", ", ".join(columns), list(named), parts)
        marks = [*(f"{k} {t}" for k, t in partition.items()), "rows long", "hash long", "sum long"]
        self.marks = VersionedTable(spark, f"{path}/marks", ", ".join(marks), self.partition, 4)

    def _fold(self, df: DataFrame, keys: list[str], stored: bool) -> DataFrame:
        return df.groupBy(*keys).agg(*(_FOLD[how](F.col(n) if stored else c).alias(n) for m in self.measures.values() for n, c, how in m.parts))

    def refresh(self, source: DataFrame) -> dict[str, int]:
        """Bring the store up to ``source``; how many partitions were new, changed, gone and unchanged.

        Partials are committed before fingerprints: a run that is lost in between is done again by the next.
        """
        source = source.where(" AND ".join(f"{c} IS NOT NULL" for c in self.partition))
        now = written(fingerprints(source, self.partition), "marks")
        states = written(changed(self.marks.read(), now, self.partition), "states")
        counts = {r.state: r["count"] for r in states.groupBy("state").count().collect()}
        moved = states.where("state <> 'unchanged'").select(*self.partition)
        if set(counts) - {"unchanged"}:
            new = self._fold(source.join(moved, self.partition, "left_semi"), self.partition + self.by, False)
            new = new.select(*(F.col(c).alias(f"p_{c}") for c in self.partition), *self.by, *(n for m in self.measures.values() for n, _, _ in m.parts))
            old_ = self.partials.read().join(moved.select(*(F.col(c).alias(f"p_{c}") for c in self.partition)), [f"p_{c}" for c in self.partition], "left_semi")
            rows = written(new.withColumn("_new", F.lit(True)).unionByName(old_.withColumn("_new", F.lit(False))), "partials")

            def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
                gone = rows.select(*(f"p_{c}" for c in self.partition)).distinct()
                return old.join(gone, [f"p_{c}" for c in self.partition], "left_anti").unionByName(rows.where("_new").drop("_new"))

            self.partials.change(rows, merge)
            marks = now.withColumn("_new", F.lit(True)).unionByName(self.marks.read().withColumn("_new", F.lit(False)))

            def replace(old: DataFrame, rows: DataFrame) -> DataFrame:
                return rows.where("_new").drop("_new")

            self.marks.change(written(marks, "marks"), replace)
        return {s: counts.get(s, 0) for s in ("new", "changed", "gone", "unchanged")}

    def read(self, by: list[str] | None = None) -> DataFrame:
        """The rollup by its groups, or by fewer columns of them or of the partition (as ``p_<name>``)."""
        keys = self.by if by is None else by
        d = self._fold(self.partials.read(), keys, True)
        return d.select(*keys, *(m.value.alias(n) for n, m in self.measures.items()))
