"""Models of player props, one a prop, all fitted together from the long or the wide table of features.

Regressions need only sums of products, so every prop's ridge regression comes from one aggregation of the table;
yes/no props take a few such passes (Newton steps). What reaches the driver is some sums for each prop, of a
number that the number of features sets. A prop's value is the mean of the regression and of the player's own averages, weighted
by the inverse of their errors on the last rows by date; combined props add up their parts, and take their
deviation from the sum of the parts' errors, which carries how the parts depend on each other.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..features.props import NAMES, SHARED, own_columns
from ..functions.scalars import normal_over, poisson_at, poisson_over, sigmoid, tier


@dataclass(frozen=True)
class Prop:
    """A market on a stat: its ``value`` (a count or a real number), or whether it passes ``over``."""

    name: str
    stat: str
    kind: str = "count"
    over: float = 0.0


#: fixed values: the markets, and the stats that combined ones add up
PROPS = (
    Prop("points", "pts"), Prop("rebounds", "reb"), Prop("assists", "ast"), Prop("minutes", "minutes", "real"),
    Prop("pts_over_25", "pts", "flag", 25.0), Prop("reb_over_8", "reb", "flag", 8.0), Prop("ast_over_4", "ast", "flag", 4.0), Prop("double_double", "double_double", "flag", 0.5),
)
COMBOS = {"pts_reb_ast": ("points", "rebounds", "assists"), "pts_reb": ("points", "rebounds"), "pts_ast": ("points", "assists"), "reb_ast": ("rebounds", "assists")}
MEMBERS = ("ridge", "mean_5", "mean_15")
#: rows that a prop needs in all, for training and for validation
LEAST, LEAST_TRAIN, LEAST_VALID = 80, 60, 15


# ---------------------------------------------------------------- long table


def long_table(features: DataFrame, props: tuple[Prop, ...] = PROPS) -> DataFrame:
    """Rows of ``features`` once for each prop on their stat, with the prop's target."""
    def of(p: Prop) -> Column:
        y = F.when(F.col("y") > p.over, 1.0).otherwise(0.0) if p.kind == "flag" else F.col("y")
        return F.when(F.col("stat") == p.stat, F.struct(F.lit(p.name).alias("prop"), F.lit(p.kind).alias("kind"), y.alias("target")))

    none = F.lit(None).cast("struct<prop:string,kind:string,target:double>")
    d = features.withColumn("_p", F.explode(F.filter(F.array(none, *map(of, props)), lambda z: z.isNotNull())))
    return d.select("player_id", "game_id", "date", "_p.prop", "_p.kind", "x", F.col("_p.target").alias("y"))


def by_time(long_: DataFrame, share: float = 0.2) -> DataFrame:
    """``valid`` for each prop's rows of the last days that together hold about ``share`` of them: days are counted, and rows are neither sorted nor shuffled."""
    first = {p: x[0] for p, x in first_days(long_.groupBy("prop", "date").agg(F.count("*").alias("n")), "prop", share).items()}
    return long_.where("date IS NOT NULL").withColumn("valid", F.coalesce(F.col("date") >= _each(first, "date"), F.lit(False)))


def first_days(days: DataFrame, key: str, share: float) -> dict[str, tuple[datetime.date | None, int, int]]:
    """Of counted days (key, date, n): per key the first of the last days that together hold about ``share``, and the rows before and from it."""
    w = W.partitionBy(key).orderBy("date")
    until, all_ = F.sum("n").over(w), F.sum("n").over(W.partitionBy(key))
    days = days.where("date IS NOT NULL").select(key, "date", "n", (until > all_ * (1 - share)).alias("valid"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    got = days.groupBy(key).agg(F.min(F.when(F.col("valid"), F.col("date"))).alias("first"), of(~F.col("valid")).alias("t"), of(F.col("valid")).alias("v"))
    return {r[key]: (r.first, r.t, r.v) for r in got.collect()}  # a row for each key


def _each(values: dict, kind: str) -> Column:
    """The value of the row's prop: a literal map, an entry for each prop."""
    return F.element_at(F.create_map(*(F.lit(c) for item in values.items() for c in item)) if values else F.lit(None).cast(f"map<string,{kind}>"), F.col("prop"))


# ---------------------------------------------------------------- fits by sums

#: what a task adds up of a prop's rows (1 and x, target)
Sums = Callable[[Prop, np.ndarray, np.ndarray], np.ndarray]


def is_wide(features: DataFrame) -> bool:
    return "stat" not in features.columns


def flat(features: DataFrame, stats: list[str]) -> DataFrame:
    """What fits read: the day, and values and features of the stats as columns of numbers, with the stat where rows are long."""
    if is_wide(features):
        return features.where("date IS NOT NULL").select(F.unix_date("date").alias("_day"), *(F.col(s).cast("double").alias(s) for s in stats), *(c for s in stats for c in own_columns(s)), *SHARED)
    x = [F.get("x", F.lit(i)).alias(c) for i, c in enumerate(NAMES)]
    return features.where(F.col("date").isNotNull() & F.col("stat").isin(*stats)).select(F.unix_date("date").alias("_day"), "stat", F.col("y").cast("double").alias("y"), *x)


def by_stat(batch: pa.RecordBatch, stats: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(stat, days, 1 and features, values) of a batch of ``flat`` rows; rows without a value or a feature take no part."""
    number = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    long_ = "stat" in batch.schema.names
    day, of = number("_day"), number("stat") if long_ else None
    for s in stats:
        y, z = number("y" if long_ else s), np.empty((1 + len(NAMES), len(day))).T
        z[:, 0] = 1.0
        for i, c in enumerate(NAMES if long_ else (*own_columns(s), *SHARED), 1):
            z[:, i] = number(c)
        on = np.full(len(day), True) if not long_ else of == s
        if math.isnan(z.sum() + y.sum()):
            on &= ~(np.isnan(y) | np.isnan(z).any(axis=1))
        yield (s, day, z, y) if on.all() else (s, day[on], z[on], y[on])


def added(rows: DataFrame, props: list[Prop], first: dict[str, datetime.date], valid: bool, made: Sums) -> dict[str, np.ndarray]:
    """Per prop the sum of ``made`` over its training or its validation rows: tasks add up their rows, and their sums are added up by Spark."""
    stats = list(dict.fromkeys(p.stat for p in props))
    from_ = {p.name: (first[p.name] - datetime.date(1970, 1, 1)).days for p in props}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for s, day, z, y in by_stat(batch, stats):
                for p in props:
                    if p.stat != s:
                        continue
                    on = (day >= from_[p.name]) == valid
                    zp, yp = (z, y) if on.all() else (z[on], y[on])
                    if len(yp):
                        v = made(p, zp, np.where(yp > p.over, 1.0, 0.0) if p.kind == "flag" else yp)
                        total[p.name] = total[p.name] + v if p.name in total else v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["prop", "sums"])

    if not props:
        return {}
    rows = rows.where(F.col("date") >= F.lit(min(first[p.name] for p in props)) if valid else F.col("date") < F.lit(max(first[p.name] for p in props)))
    got = flat(rows, stats).mapInArrow(run, "prop string, sums array<double>").select("prop", F.posexplode("sums").alias("i", "v"))
    out: dict[str, dict[int, float]] = {}
    for r in got.groupBy("prop", "i").agg(F.sum("v").alias("v")).collect():  # a row for each prop and sum
        out.setdefault(r.prop, {})[r.i] = r.v
    return {p: np.array([v[i] for i in range(len(v))]) for p, v in out.items()}


def moments(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sums of products of the columns of z with themselves and with y, by weights."""
    zw = (z.T * w).T
    return np.append((zw.T @ z).ravel(), zw.T @ y)


def solved(sums: np.ndarray, l2: float) -> np.ndarray:
    k = len(NAMES) + 1
    return ridge(sums[: k * k].reshape(k, k), sums[k * k :], l2)


def ridge(m: np.ndarray, xy: np.ndarray, l2: float) -> np.ndarray:
    """Intercept and weights of least squares with ``l2`` times the squared standardised weights."""
    n = m[0, 0]
    mean, ymean = m[0, 1:] / n, xy[0] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    on = sd > np.maximum(1e-9, 1e-6 * np.abs(mean))  # below that a variance is what rounding leaves of the sums
    w = np.zeros(len(mean))
    if on.any():
        s = sd[on]
        c = cov[np.ix_(on, on)] / np.outer(s, s)
        w[on] = np.linalg.solve(c + l2 / n * np.eye(len(s)), (xy[1:] / n - mean * ymean)[on] / s) / s
    return np.append(ymean - mean @ w, w)


def fitted(rows: DataFrame, props: list[Prop], first: dict[str, datetime.date], l2: float = 1.0, steps: int = 8) -> dict[str, np.ndarray]:
    """Weights of all props. Regressions and the first of Newton's steps of yes/no props come from one aggregation, each further step from
    one; steps are damped while a prop's weights run away."""
    beta: dict[str, np.ndarray] = {}

    def made(p: Prop, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        if p.kind != "flag":
            return moments(z, y, np.ones(len(y)))
        if p.name not in beta:
            return moments(z, 4 * (y - 0.5), np.full(len(y), 0.25))
        score = z @ beta[p.name]
        chance = np.clip(logistic(score), 1e-5, 1 - 1e-5)
        w = chance * (1 - chance)
        return moments(z, score + (y - chance) / w, w)

    flags = [p for p in props if p.kind == "flag"]
    for step in range(steps):
        new = {name: solved(v, l2) for name, v in added(rows, flags if step else props, first, False, made).items()}
        far = max((np.abs(new[p.name] - beta.get(p.name, 0)).max() for p in flags), default=0.0)
        beta = beta | new
        if far < 1e-8:
            break
    return beta


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def with_weights(rows: DataFrame, beta: dict[str, np.ndarray]) -> DataFrame:
    """Rows with the weights ``_w`` of their prop: a literal map, an entry for each prop."""
    entries = [c for p, b in beta.items() for c in (F.lit(p), F.array(*map(F.lit, map(float, b))))]
    table = F.create_map(*entries) if entries else F.lit(None).cast("map<string,array<double>>")
    return rows.withColumn("_w", F.element_at(table, F.col("prop")))


def linear(x: str, w: str) -> Column:
    """Intercept plus weights times features."""
    return F.aggregate(F.zip_with(F.col(x), F.slice(w, 2, 10_000), lambda a, b: a * b), F.element_at(w, 1), lambda s, v: s + v)


# ---------------------------------------------------------------- models


@dataclass
class PropModels:
    """Weights of every prop's regression, of the members, deviations, and what they reach on validation rows."""

    beta: dict[str, np.ndarray]
    share: dict[str, tuple[float, ...]]
    deviation: dict[str, float]
    report: list[tuple]
    props: tuple[Prop, ...] = PROPS
    combos: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(COMBOS))

    def predict(self, features: DataFrame, since: dict[str, datetime.date] | None = None, line: dict[str, Column] | None = None) -> DataFrame:
        """(player_id, game_id, date, prop, kind, predicted, y) for all props and combined ones, of all rows or of each prop's from its day ``since``.

        Of wide rows, a row's props and their sums are made inside the row; ``line`` then may give props a line from its columns.
        """
        known = tuple(p for p in self.props if p.name in self.beta)
        if is_wide(features) and known:
            return self._within(features, known, since, line or {})
        if line:
            raise ValueError("lines come from the columns of wide rows")
        if is_wide(features):
            features = features.limit(0).select("player_id", "game_id", "date", F.lit("").alias("stat"), F.array(F.lit(0.0)).alias("x"), F.lit(0.0).alias("y"))
        d = value(with_weights(long_table(features, known), self.beta), self.share)
        single = d.select("player_id", "game_id", "date", "prop", "kind", "predicted", "y")
        if since is not None:
            single = single.where(F.col("date") >= _each(since, "date"))
        return single.unionByName(combined(single, self.combos))

    def _within(self, features: DataFrame, known: tuple[Prop, ...], since: dict[str, datetime.date] | None, line: dict[str, Column]) -> DataFrame:
        made, target = {}, {}
        for p in known:
            x = [F.col(c) for c in (*own_columns(p.stat), *SHARED)]
            score = sum((float(b) * v for b, v in zip(self.beta[p.name][1:], x, strict=True)), F.lit(float(self.beta[p.name][0])))
            mixed = sum((s * v for s, v in zip(self.share[p.name], (score, *(x[NAMES.index(m)] for m in MEMBERS[1:])), strict=True)), F.lit(0.0))
            made[p.name] = sigmoid(score) if p.kind == "flag" else F.greatest(mixed, F.lit(0.0))
            target[p.name] = F.when(F.col(p.stat) > p.over, 1.0).otherwise(0.0) if p.kind == "flag" else F.col(p.stat)
        for name, day in (since or {}).items():
            if name in made:
                made[name] = F.when(F.col("date") >= F.lit(day), made[name])
        if since:
            features = features.where(F.col("date") >= F.lit(min(since.values())))
        features = features.withColumns({f"_{name}": c for name, c in made.items()} | {f"_y_{name}": c for name, c in target.items()} | {f"_line_{name}": c.cast("double") for name, c in line.items()})
        single = {p.name for p in known if p.kind != "flag"}
        props = [(p.name, p.kind, (p.name,)) for p in known] + [(name, "combo", of) for name, of in self.combos.items() if single.issuperset(of)]
        add = lambda prefix, of: sum((F.col(f"{prefix}{m}") for m in of[1:]), F.col(f"{prefix}{of[0]}"))
        at = lambda name: [(F.col(f"_line_{name}") if name in line else F.lit(None).cast("double")).alias("line")] if line else []
        rows = [F.struct(F.lit(name).alias("prop"), F.lit(kind).alias("kind"), add("_", of).alias("predicted"), add("_y_", of).alias("y"), *at(name)) for name, kind, of in props]
        d = features.select("player_id", "game_id", "date", F.inline(F.array(*rows)))
        return d.where("predicted IS NOT NULL") if since else d

    def chances(self, predicted: DataFrame, lines: DataFrame | None = None, least: float = 0.55) -> DataFrame:
        """Chances over and under a line (``lines``: player_id, game_id, prop, line, or a column ``line`` of ``predicted``; the value itself where there is none)."""
        if lines is not None:
            predicted = predicted.join(lines, ["player_id", "game_id", "prop"], "left")
        d = predicted if "line" in predicted.columns else predicted.withColumn("line", F.lit(None).cast("double"))
        d = d.withColumn("line", F.when(F.col("kind") == "flag", F.lit(0.5)).otherwise(F.coalesce("line", "predicted")))
        deviations = _each({p: float(s) for p, s in self.deviation.items()}, "double")
        return recommended(d.withColumn("deviation", F.coalesce(deviations, F.lit(1.0))), least)


def value(d: DataFrame, share: dict[str, tuple[float, ...]]) -> DataFrame:
    """The members' values by their shares; the chance itself for a flag. Values of counts and reals are not below 0."""
    shares = F.create_map(*(c for p, s in share.items() for c in (F.lit(p), F.array(*map(F.lit, map(float, s)))))) if share else F.lit(None).cast("map<string,array<double>>")
    s = F.element_at(shares, F.col("prop"))
    score = linear("x", "_w")
    parts = zip((score, F.get("x", F.lit(NAMES.index("mean_5"))), F.get("x", F.lit(NAMES.index("mean_15")))), range(1, 4), strict=True)
    mixed = F.greatest(sum((v * F.element_at(s, i) for v, i in parts), F.lit(0.0)), F.lit(0.0))
    return d.withColumn("predicted", F.when(F.col("kind") == "flag", sigmoid(score)).otherwise(mixed))


def combined(single: DataFrame, combos: dict[str, tuple[str, ...]]) -> DataFrame:
    """Sums of the parts of combined props, for players of whom all parts are there."""
    member = F.filter(F.array(*(F.when(F.col("prop").isin(*of), F.struct(F.lit(n).alias("prop"), F.lit(len(of)).alias("parts"))) for n, of in combos.items())), lambda z: z.isNotNull())
    d = single.where("kind <> 'flag'").select("player_id", "game_id", "date", "predicted", "y", F.explode(member).alias("c"))
    d = d.groupBy("player_id", "game_id", "date", "c").agg(F.sum("predicted").alias("predicted"), F.sum("y").alias("y"), F.count("*").alias("n")).where("n = c.parts")
    return d.select("player_id", "game_id", "date", "c.prop", F.lit("combo").alias("kind"), "predicted", "y")


def recommended(d: DataFrame, least: float) -> DataFrame:
    """Chance over the line by the Poisson tail (counts), the normal tail (reals and sums) or itself (flags), side and tier.

    Whole lines can be met exactly: a count's chances over and under leave out that it is met. Counts over 200 take the normal tail.
    """
    count = (F.col("kind") == "count") & (F.col("predicted") <= 200)
    d = d.withColumn("_over", F.when(count, poisson_over("line", "predicted")).when(F.col("kind") == "flag", F.col("predicted")).otherwise(normal_over("line", "predicted", F.greatest("deviation", F.lit(0.5)))))
    over = F.col("_over")
    # a whole line can be met: what is left beside the chance over it and at it is under it
    met = F.when(F.floor("line") == F.col("line"), poisson_at("line", "predicted")).otherwise(0.0)
    under = F.when(count, F.when(F.col("line") > 0, F.greatest(1 - over - met, F.lit(0.0))).otherwise(0.0)).otherwise(1 - over)
    d = d.withColumn("over_prob", over).withColumn("under_prob", under).drop("_over")
    d = d.withColumn("confidence", F.least(F.greatest("over_prob", "under_prob"), F.lit(0.99)))
    side = F.when(F.col("confidence") < least, "PASS").when(F.col("over_prob") >= F.col("under_prob"), "OVER").otherwise("UNDER")
    return d.select("*", (F.col("predicted") - F.col("line")).alias("edge"), side.alias("recommendation"), tier("confidence").alias("tier"))


def fit(features: DataFrame, props: tuple[Prop, ...] = PROPS, combos: dict[str, tuple[str, ...]] | None = None, l2: float = 1.0, share: float = 0.2) -> PropModels:
    """Models of all props with enough rows of a long or wide table; the last ``share`` of the rows by date weigh the members.

    The table is read once a step and nothing of it is written or, if it is wide, shuffled: what tasks pass on is sums.
    """
    combos = dict(COMBOS) if combos is None else combos
    if is_wide(features):
        counted = first_days(features.groupBy(F.lit("").alias("stat"), "date").agg(F.count("*").alias("n")), "stat", share)
        days = {s: counted[""] for s in features.columns if f"{s}_{NAMES[0]}" in features.columns and counted}
    else:
        days = first_days(features.groupBy("stat", "date").agg(F.count("*").alias("n")), "stat", share)
    ready = [p for p in props if p.stat in days and sum(days[p.stat][1:]) >= LEAST and days[p.stat][1] >= LEAST_TRAIN and days[p.stat][2] >= LEAST_VALID]
    first = {p.name: days[p.stat][0] for p in ready}
    beta = fitted(features, ready, first, l2)

    def off(p: Prop, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        score = z @ beta[p.name]
        chance = logistic(score)
        values = (score, *(z[:, 1 + NAMES.index(m)] for m in MEMBERS[1:]), chance)
        return np.array([len(y), y.sum(), ((chance >= 0.5) == (y > 0.5)).sum(), *(np.square(v - y).sum() for v in values)], float)

    shares, report, errors = {}, [], added(features, [p for p in ready if p.name in beta], first, True, off)
    for p in ready:
        inverse = [1 / max(math.sqrt(e / errors[p.name][0]), 1e-9) for e in errors[p.name][3:6]]
        shares[p.name] = tuple(v / sum(inverse) for v in inverse) if p.kind != "flag" else (1.0, 0.0, 0.0)
    models = PropModels(beta, shares, {}, report, props, combos)
    gap = F.col("predicted") - F.col("y")
    both = models.predict(features, first).groupBy("prop").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae")) if ready else None
    reached = {r.prop: r for r in both.collect()} if ready else {}
    models.deviation = {p: r.rmse for p, r in reached.items()}
    for p in sorted(ready, key=lambda p: p.name):
        n, ones, right = errors[p.name][:3]
        report.append((p.name, p.kind, *days[p.stat][1:], reached[p.name].rmse, reached[p.name].mae, float(ones / n), float(right / n) if p.kind == "flag" else None, *shares[p.name]))
    return models


REPORT = "prop string, kind string, n_train long, n_valid long, rmse double, mae double, base double, accuracy double, share_ridge double, share_mean_5 double, share_mean_15 double"
