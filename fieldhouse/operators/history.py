"""Reports kept by run, each compared with the run before it.

A report is rows of keys and values with the time of its run. Runs are logged into a versioned table by (run, keys), so that a run
that is done again takes the place of its first try. Comparison is as-of: a run's predecessor is the newest earlier run in the
log, whether or not it has a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.versioned import VersionedTable


def log(table: VersionedTable, report: DataFrame, run: str) -> None:
    """Put a report (with its ``run`` column, one value) into the log, in place of an earlier try of the same run."""
    keys = [k for k in table.keys if k != run]
    table.change(report, lambda old, new: old.join(new.select(run, *keys), [run, *keys], "left_anti").unionByName(new.select(*old.columns)))


def numbered(reports: DataFrame, run: str) -> DataFrame:
    """Runs with their place in time; a row a run."""
    return reports.select(run).distinct().withColumn("_no", F.row_number().over(W.orderBy(run)))


def against_previous(reports: DataFrame, run: str, keys: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """Each run's rows and what its predecessor lacks or had besides: values, ``<value>_before``, ``<value>_change``, and the state of
    the first value: first (no earlier run), new, gone, up, down or same."""
    runs = numbered(reports, run)
    d = reports.join(F.broadcast(runs), run)  # a row a run
    now = d.select("_no", *keys, *values, F.lit(True).alias("_now"))
    before = d.select((F.col("_no") + 1).alias("_no"), *keys, *(F.col(v).alias(f"{v}_before") for v in values), F.lit(True).alias("_then"))
    left, right = now.alias("l"), before.alias("r")
    same = F.col("l._no") == F.col("r._no")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    both = left.join(right, same, "full").select(F.coalesce("l._no", "r._no").alias("_no"), *(F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys), *values, *(f"{v}_before" for v in values), "_now", "_then")
    both = both.join(F.broadcast(runs), "_no")  # what would come after the last run has no run
    diff = F.col(values[0]) - F.col(f"{values[0]}_before")
    state = F.when(F.col("_no") == 1, "first").when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "gone").when(diff > tolerance, "up").when(diff < -tolerance, "down").otherwise("same")
    return both.select(run, *keys, *(c for v in values for c in (F.col(v), F.col(f"{v}_before"), (F.col(v) - F.col(f"{v}_before")).alias(f"{v}_change"))), state.alias("state"))


def trend(reports: DataFrame, run: str, keys: list[str], value: str, n: int = 3, flat: float = 0.0) -> DataFrame:
    """Newest value of each key, the one of its run before, and the slope a run over its last ``n`` runs: rising, falling, flat or short (one run)."""
    d = reports.join(F.broadcast(numbered(reports, run)), run)
    w = W.partitionBy(*keys).orderBy(F.desc("_no"))
    d = d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    at = lambda k: F.max(F.when(F.col("_k") == k, F.col(value)))
    slope = F.regr_slope(F.col(value), F.col("_no").cast("double"))
    t = d.groupBy(*keys).agg(at(1).alias("latest"), at(2).alias("previous"), F.count("*").alias("runs"), slope.alias("slope"))
    direction = F.when(F.col("runs") < 2, "short").when(F.col("slope") > flat, "rising").when(F.col("slope") < -flat, "falling").otherwise("flat")
    return t.select(*keys, "latest", "previous", (F.col("latest") - F.col("previous")).alias("change"), "runs", "slope", direction.alias("direction"))
