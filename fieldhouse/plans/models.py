"""Feature matrices, splits and Spark ML ensembles."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..features import asof
from ..operators.evaluation import completed_games

FEATURES = ["delta_form_win_pct", "delta_form_margin", "delta_form_ppg", "delta_rest_days", "delta_games_7d"]
#: fixed values: names of columns that hold a game's outcome
LEAKY = r"^(home_score|away_score|status|result|winner|final_.*|.*_outcome)$"


def feature_matrix(games: DataFrame) -> DataFrame:
    """As-of differences of form and rest with the label; nulls as 0."""
    form = asof.form(games).drop("date").join(asof.rest(games).drop("date", "back_to_back"), ["game_id", "team_id", "is_home"])
    d = asof.wide(completed_games(games).where("home_score <> away_score"), form)
    return d.withColumn("label", (F.col("home_score") > F.col("away_score")).cast("double")).na.fill(0)


def usable(df: DataFrame, meta: list[str]) -> list[str]:
    """Numeric columns that are neither meta nor leaky by name."""
    return [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float") and c not in meta and not re.match(LEAKY, c)]


def time_position(df: DataFrame, date: str = "date", tie: str = "game_id") -> DataFrame:
    """Rows with ``_pos`` (from 0, by date and tie) and ``_n``: days are counted first, so no task sorts all rows."""
    days = df.groupBy(date).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy(date).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a day
    days = days.select(F.col(date).alias("_day"), before.alias("_before"), F.sum("_c").over(W.orderBy(date).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_n"))
    d = df.withColumn("_k", F.row_number().over(W.partitionBy(date).orderBy(tie)) - 1)
    return d.join(days, d[date].eqNullSafe(days["_day"])).withColumn("_pos", F.col("_before") + F.col("_k")).drop("_day", "_before", "_k")


def temporal_split(df: DataFrame, share: float) -> DataFrame:
    """Rows with ``test`` true for the last share by time."""
    rank = F.when(F.col("_n") > 1, F.col("_pos") / (F.col("_n") - 1)).otherwise(0.0)
    return time_position(df).withColumn("test", rank >= 1 - share).drop("_pos", "_n")


def walk_forward(df: DataFrame, folds: int) -> DataFrame:
    """Fold numbers by time, the first ones larger by one; fold k is tested on what folds before it trained."""
    q, r = F.floor(F.col("_n") / folds), F.col("_n") % folds
    late = r + F.floor((F.col("_pos") - r * (q + 1)) / F.greatest(q, F.lit(1)))
    fold = F.when(F.col("_pos") < r * (q + 1), F.floor(F.col("_pos") / (q + 1))).otherwise(late) + 1
    return time_position(df).withColumn("fold", fold.cast("int")).drop("_pos", "_n")


def market_labels(games: DataFrame) -> DataFrame:
    d = games.where("home_score IS NOT NULL")
    flag = lambda c: F.when(c, 1).otherwise(0)
    return d.select("game_id", flag(F.col("home_score") > F.col("away_score")).alias("home_win"), flag(F.col("home_score") + F.col("away_score") > 180).alias("over"), flag(F.abs(F.col("home_score") - F.col("away_score")) <= 10).alias("close"))


def classifiers(seed: int = 7) -> dict:
    return {"logistic": LogisticRegression(maxIter=20), "forest": RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed), "boosted": GBTClassifier(maxIter=10, maxDepth=3, seed=seed)}


def regressors(seed: int = 7) -> dict:
    return {"linear": LinearRegression(maxIter=20), "forest": RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed), "boosted": GBTRegressor(maxIter=10, maxDepth=3, seed=seed)}


class Ensemble:
    """Classifiers weighted by max(0.01, accuracy * max(0.1, 1 - 2 * Brier)) on held-out rows."""

    def __init__(self, models: dict[str, PipelineModel], weights: dict[str, float]):
        self.models, self.weights = models, weights

    @classmethod
    def fit(cls, train: DataFrame, test: DataFrame, features: list[str]) -> Ensemble:
        models, weights = {}, {}
        for name, m in classifiers().items():
            fitted = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), m]).fit(train)
            p = vector_to_array(F.col("probability"))[1]
            r = fitted.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("acc"), F.avg(F.pow(p - F.col("label"), 2)).alias("brier")).first()
            models[name] = fitted
            weights[name] = max(0.01, (r.acc or 0.0) * max(0.1, 1 - 2 * (r.brier if r.brier is not None else 0.5)))
        return cls(models, weights)

    def score(self, df: DataFrame, key: str = "game_id") -> DataFrame:
        """Weighted probability, share of models on its side, and confidence."""
        d = df
        for name, m in self.models.items():
            d = m.transform(d).withColumn(f"p_{name}", vector_to_array(F.col("probability"))[1]).drop("features", "rawPrediction", "probability", "prediction")
        total = sum(self.weights.values())
        p = sum((F.col(f"p_{n}") * w for n, w in self.weights.items()), F.lit(0.0)) / total
        d = d.withColumn("home_win_prob", p)
        side = sum(((F.col(f"p_{n}") >= 0.5) == (F.col("home_win_prob") >= 0.5)).cast("double") for n in self.models) / len(self.models)
        return d.withColumn("consensus", side).withColumn("confidence", 0.5 + F.abs(F.col("home_win_prob") - 0.5) * side)

    def importance(self, features: list[str]) -> dict[str, float]:
        """Tree importances weighted like the models."""
        out = dict.fromkeys(features, 0.0)
        trees = {n: m.stages[-1] for n, m in self.models.items() if hasattr(m.stages[-1], "featureImportances")}
        total = sum(self.weights[n] for n in trees) or 1.0
        for n, m in trees.items():
            for f, v in zip(features, m.featureImportances.toArray(), strict=True):
                out[f] += float(v) * self.weights[n] / total
        return out


def fit_regressors(train: DataFrame, test: DataFrame, features: list[str], label: str) -> tuple[dict[str, PipelineModel], dict[str, float]]:
    """Regressors with weights by the inverse of their error on held-out rows."""
    models, rmse = {}, {}
    for name, m in regressors().items():
        fitted = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), m.setLabelCol(label)]).fit(train)
        models[name] = fitted
        rmse[name] = fitted.transform(test).agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(label), 2)))).first()[0] or 1.0
    total = sum(1 / r for r in rmse.values())
    return models, {n: 1 / r / total for n, r in rmse.items()}


def calibrate(scored: DataFrame, prob: str = "home_win_prob", label: str = "label"):
    """Isotonic or logistic calibration, whichever has the lower Brier score; returns (name, function)."""
    assembler = VectorAssembler(inputCols=[prob], outputCol="features")
    iso = Pipeline(stages=[assembler, IsotonicRegression(labelCol=label, featuresCol="features")]).fit(scored)
    platt = Pipeline(stages=[assembler, LogisticRegression(labelCol=label, maxIter=50)]).fit(scored)
    clip = lambda c: F.least(F.greatest(c, F.lit(0.05)), F.lit(0.95))

    def by_iso(df: DataFrame) -> DataFrame:
        return iso.transform(df).withColumn("calibrated", clip(F.col("prediction"))).drop("features", "prediction")

    def by_platt(df: DataFrame) -> DataFrame:
        return platt.transform(df).withColumn("calibrated", clip(vector_to_array(F.col("probability"))[1])).drop("features", "prediction", "rawPrediction", "probability")

    error = {n: f(scored).agg(F.avg(F.pow(F.col("calibrated") - F.col(label), 2))).first()[0] for n, f in (("isotonic", by_iso), ("platt", by_platt))}
    best = min(error, key=lambda n: (error[n], n))
    return best, {"isotonic": by_iso, "platt": by_platt}[best]
