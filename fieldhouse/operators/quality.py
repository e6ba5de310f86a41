"""Data quality: fill rates, checks, feature audits, coverage, provider blends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def fill_rates(df: DataFrame) -> DataFrame:
    """Share of values that are there, per column, in one pass."""
    one = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), F.col("_n").alias("rows")) for c in df.columns))).alias("x")).select("x.*", F.when(F.col("x.rows") > 0, F.col("x.filled") / F.col("x.rows")).alias("rate"))


def game_checks(games: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """Per sport: rows, repeated ids, date range, negative scores and scores above the sport's bound."""
    top = F.coalesce(*(F.when(F.col("sport") == s, F.lit(b)) for s, b in bounds.items()), F.lit(1e9))
    h, a = F.col("home_score"), F.col("away_score")
    return games.groupBy("sport").agg(
        F.count("*").alias("rows"), (F.count("*") - F.count_distinct("game_id")).alias("repeated"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.count_if((h < 0) | (a < 0)).alias("negative"), F.count_if((h > top) | (a > top)).alias("too_high"),
    )


def negative_share(df: DataFrame, stats: list[str], signed: tuple[str, ...] = (), most: float = 0.05) -> DataFrame:
    """Share of negative values per stat, flagged above ``most`` unless the stat is signed."""
    one = df.agg(*(F.avg(F.when(F.col(s).isNotNull(), (F.col(s) < 0).cast("double"))).alias(s) for s in stats))
    rows = F.array(*(F.struct(F.lit(s).alias("stat"), F.coalesce(F.col(s), F.lit(0.0)).alias("share"), F.lit(s in signed).alias("signed")) for s in stats))
    return one.select(F.explode(rows).alias("x")).select("x.stat", "x.share", (~F.col("x.signed") & (F.col("x.share") > most)).alias("flag"))


def feature_audit(df: DataFrame, features: list[str], target: str, leaky: str = "score|result|final|outcome") -> DataFrame:
    """Missing share, distinct values, share of the most frequent value, leak-like names and severity per feature."""
    aggs = []
    for f in features:
        aggs += [F.avg(F.col(f).isNull().cast("double")).alias(f"{f}|missing"), F.count_distinct(f).alias(f"{f}|distinct"), F.mode(F.col(f)).alias(f"{f}|mode")]
    one = df.agg(*aggs)
    d = df.join(F.broadcast(one))  # one row
    two = d.agg(*(F.first(f"{f}|{k}").alias(f"{f}|{k}") for f in features for k in ("missing", "distinct")), *(F.avg(F.coalesce(F.col(f) == F.col(f"{f}|mode"), F.lit(False)).cast("double")).alias(f"{f}|modal") for f in features))
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"{f}|missing").alias("missing"), F.col(f"{f}|distinct").alias("n_distinct"), F.col(f"{f}|modal").alias("modal_share")) for f in features))
    x = two.select(F.explode(rows).alias("x")).select("x.*")
    leak = F.lower("feature").rlike(leaky)
    flat = (F.col("n_distinct") <= 2) & (F.col("modal_share") > 0.98)
    return x.select("*", leak.alias("leaky"), F.when(leak, "high").when((F.col("missing") > 0.5) | flat, "medium").when(F.col("missing") > 0.2, "low").otherwise("ok").alias("severity"))


def feature_ranking(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Variance, share of non-zero values and |correlation| with the target."""
    aggs = []
    for f in features:
        aggs += [F.var_samp(f).alias(f"{f}|v"), F.avg((F.col(f) != 0).cast("double")).alias(f"{f}|z"), F.abs(F.corr(f, target)).alias(f"{f}|c")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"{f}|v").alias("variance"), F.col(f"{f}|z").alias("nonzero"), F.col(f"{f}|c").alias("corr")) for f in features))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def live_features(df: DataFrame, features: list[str], least: float = 0.01, most_null: float = 0.3) -> list[str]:
    """Features that are neither constant, nor almost all zero, nor mostly null (one row comes to the driver)."""
    aggs = []
    for f in features:
        aggs += [F.avg(F.coalesce(F.col(f) != 0, F.lit(False)).cast("double")).alias(f"{f}|z"), F.avg(F.col(f).isNull().cast("double")).alias(f"{f}|m"), F.count_distinct(f).alias(f"{f}|d")]
    r = df.agg(*aggs).first()
    return [f for f in features if (r[f"{f}|z"] or 0) > least and (r[f"{f}|m"] or 0) <= most_null and r[f"{f}|d"] > 1]


def vendor_coverage(df: DataFrame, provider: str, sport: str, expected: list[str]) -> DataFrame:
    """Rows of each expected provider per sport and whether it is there; sports come from the data."""
    sports = df.select(F.col(sport).alias("sport")).distinct()
    wanted = sports.select("sport", F.explode(F.array(*map(F.lit, expected))).alias("provider"))
    n = df.groupBy(F.col(sport).alias("sport"), F.col(provider).alias("provider")).agg(F.count("*").alias("hits"))
    d = wanted.join(n, ["sport", "provider"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return d.withColumn("status", F.when(F.col("hits") > 0, "present").otherwise("missing"))


def registry_problems(registry: DataFrame, keys: list[str], providers: list[str]) -> DataFrame:
    """Rows of a registry that lack a key, repeat one, name an unknown provider, or kinds without a ``*`` row."""
    blank = [registry.where(F.col(k).isNull() | (F.trim(F.col(k)) == "")).select(F.lit(f"missing {k}").alias("problem"), F.concat_ws("/", *(F.coalesce(F.col(c), F.lit("")) for c in keys)).alias("key")) for k in keys]
    again = registry.groupBy(*keys).count().where("count > 1").select(F.lit("repeated").alias("problem"), F.concat_ws("/", *keys).alias("key"))
    unknown = registry.where(~F.col("provider").isin(*providers)).select(F.lit("unknown provider").alias("problem"), F.concat_ws("/", *keys).alias("key"))
    star = registry.groupBy("kind").agg(F.bool_or(F.col("field") == "*").alias("s")).where("NOT s").select(F.lit("no default").alias("problem"), F.col("kind").alias("key"))
    out = again.unionByName(unknown).unionByName(star)
    for b in blank:
        out = out.unionByName(b)
    return out


def coverage_matrix(df: DataFrame, kind: str, season: str, seasons: list[int]) -> DataFrame:
    """Rows per kind and season, seasons as columns."""
    return df.groupBy(kind).pivot(season, seasons).agg(F.count(F.lit(1))).na.fill(0)


def blend(rows: DataFrame, key: str, provider: str, fields: list[str], priority: dict[str, list[str]]) -> DataFrame:
    """One row per key: each field from the provider that comes first for it, nulls passed over.

    Priorities are looked up by exact field, then by prefix ``name.*``, then ``*``; providers not named come last
    by name.
    """
    def order(f: str) -> list[str]:
        for p in (f, *(".".join(f.split(".")[:i]) + ".*" for i in range(f.count("."), 0, -1)), f.split("_")[0] + ".*", "*"):
            if p in priority:
                return priority[p]
        return []

    def rank(f: str):
        at = F.coalesce(*(F.when(F.col(provider) == p, F.lit(i)) for i, p in enumerate(order(f))), F.lit(len(order(f))))
        return F.struct(at, F.col(provider))

    aggs = []
    for f in fields:
        there = F.col(f).isNotNull()
        aggs += [F.min_by(F.when(there, F.col(f)), F.when(there, rank(f))).alias(f), F.min_by(F.when(there, F.col(provider)), F.when(there, rank(f))).alias(f"{f}_from")]
    return rows.groupBy(key).agg(*aggs)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and an order-free hash of the contents per partition."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*cols)).alias("hash"), F.sum(F.xxhash64(F.lit(1), *cols).bitwiseAND(F.lit(0xFFFFFFFF))).alias("sum"))


def changed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Partitions as new, gone, changed or unchanged by their fingerprints."""
    a = old.select(*keys, F.struct("rows", "hash", "sum").alias("_a"))
    b = new.select(*keys, F.struct("rows", "hash", "sum").alias("_b"))
    d = a.join(b, keys, "full")
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed")
    return d.select(*keys, state.alias("state"))


def latest_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the last row of each key by load order."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def team_checks(teams: DataFrame) -> DataFrame:
    """Per sport: teams, repeated ids and names, blank names, teams without a conference."""
    blank = F.col("name").isNull() | (F.trim("name") == "")
    return teams.groupBy("sport").agg(
        F.count("*").alias("teams"), (F.count("*") - F.count_distinct("team_id")).alias("duplicate_ids"), F.count_if(blank).alias("blank_names"),
        (F.count("*") - F.count_distinct(F.lower("name"))).alias("duplicate_names"), F.count_if(F.col("conference").isNull()).alias("no_conference"),
    )
