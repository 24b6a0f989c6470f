"""Regression models over rides with MLlib: ensembles, expanding folds, forecasts and importances."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattloom.operators import activity as A
from wattloom.operators import trees as T
from wattloom.session import Files

FEATURES = ["days_training", "load_7", "load_28", "intensity_7", "intensity_28", "seconds_7", "seconds_28", "icu_fitness", "icu_fatigue"]


#: Rows of models in order of time, the day first.
ORDER = ("day", A.START, "id")
#: Trees of a forest and rounds of boosting.
TREES = ROUNDS = 100
#: Fits that run side by side.
FITS_AT_ONCE = 3


def regressors(few: bool = False) -> dict:
    """Straight line, forest and boosting; only the line where rows are few."""
    line = {"linear": LinearRegression(labelCol="label", regParam=1e-3)}
    if few:
        return line
    return line | {
        "forest": RandomForestRegressor(labelCol="label", numTrees=TREES, maxDepth=5, seed=7),
        "boosting": GBTRegressor(labelCol="label", maxIter=ROUNDS, maxDepth=3, seed=7),
    }


def pipeline(model, features: Sequence[str]) -> Pipeline:
    parts = VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    return Pipeline(stages=[*parts, model.copy()])


def folds(df: DataFrame, order: Sequence[str], k: int = 3) -> DataFrame:
    """``df`` with ``fold`` 0 to k in order: training on folds before i and testing on i is an
    expanding split. Folds 1 to k have n // (k + 1) rows each, fold 0 the rest. ``order`` begins with
    a number of few distinct values (a day), which tells the fold but for the at most k values that
    a fold begins within; only their rows are ranked."""
    return _folds(df, order, k)[0]


def _folds(df: DataFrame, order: Sequence[str], k: int) -> tuple[DataFrame, int]:
    """``folds`` and the number of rows. ``df`` is read three times."""
    first, *rest = order
    df = df.where(F.col(first).isNotNull())
    counts = sorted((r[0], r[1]) for r in df.groupBy(first).count().collect())
    n = sum(m for _, m in counts)
    size = n // (k + 1)
    begins = [n - j * size for j in range(k, 0, -1)] if size else []

    def fold(position: Column) -> Column:
        return sum((F.when(position >= b, 1).otherwise(0) for b in begins), F.lit(0)).cast("int")

    before, cut, after = 0, {}, [None] * len(begins)
    for value, m in counts:
        if any(before < b < before + m for b in begins):
            cut[value] = before
        after = [value if x is None and before >= b else x for x, b in zip(after, begins, strict=True)]
        before += m
    known = sum((F.when(F.col(first) >= x, 1).otherwise(0) for x in after if x is not None), F.lit(0)).cast("int")
    if not cut:
        return df.withColumn("fold", known), n
    within = F.row_number().over(Window.partitionBy(first).orderBy(*(rest or [first])))
    start = F.coalesce(*[F.when(F.col(first) == value, F.lit(x)) for value, x in cut.items()])
    ranked = df.where(F.col(first).isin(*cut)).withColumn("_within", within).withColumn("fold", fold(start + F.col("_within") - 1)).drop("_within")
    return df.where(~F.col(first).isin(*cut)).withColumn("fold", known).unionByName(ranked), n


def cross_validated(df: DataFrame, features: Sequence[str], k: int = 3) -> dict[str, float]:
    """R2 of each model, the mean over expanding folds, in ``ORDER``, that have rows on both sides."""
    return _validated(df, features, k)[0]


def _validated(df: DataFrame, features: Sequence[str], k: int, whole: bool = False) -> tuple[dict[str, float], dict[str, T.Line | T.Ensemble]]:
    """``cross_validated``, and if ``whole``, every model of all rows, fitted in the same jobs. ``df`` is read three times."""
    cut, n = _folds(df, ORDER, k)
    usable = list(range(1, k + 1)) if n > k else []
    models, fits = regressors(n < 10), [*usable, *[k + 1] * whole]
    if not fits:
        return dict.fromkeys(models, 0.0), {}
    training = T.prepared(cut, features, fits, n, ORDER)
    lines = T.lines(training, models["linear"].getRegParam())
    scores, grown = T.line_scores(training, lines, "linear"), {"linear": lines}
    if trees := [m for m in models if m != "linear"]:
        training.base.count()  # else each model's first job bins the rows
        training.raw.unpersist()
        grown |= dict(zip(trees, _together([lambda m=m: _grown(training, m) for m in trees]), strict=True))
        scores |= T.scores(training, {m: grown[m] for m in trees})
    training.unpersist()
    return {m: sum(scores[m, i] for i in usable) / len(usable) if usable else 0.0 for m in models}, {m: x[k + 1] for m, x in grown.items()} if whole else {}


def _grown(training: T.Training, name: str) -> dict[int, T.Ensemble]:
    """The forest or the boosting of each fit, with the parameters of ``regressors``."""
    model = regressors()[name]
    if name == "forest":
        return T.forests(training, model.getNumTrees(), model.getMaxDepth(), model.getSeed())
    return T.boosted(training, model.getMaxIter(), model.getMaxDepth(), model.getStepSize())


def _together(tasks: Sequence[Callable]) -> list:
    """Results of fits that do not depend on one another; their short jobs share the cores."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(lambda f: f(), tasks))


def training_rows(rides: DataFrame) -> DataFrame:
    """Features and label of the FTP models, with the columns of ``ORDER``."""
    day = F.unix_date(F.col(A.START).cast("date")).alias("day")
    return A.ftp_features(rides, A.START, day).withColumnRenamed("ftp", "label").na.drop(subset=[*FEATURES, "label", "id"])


FORECAST = "day int, predicted double, lower double, upper double, models int, r2_linear double, r2_forest double, r2_boosting double, best_model string, current_ftp double, expected_gain double, expected_gain_pct double"


def ftp_forecast(rides: DataFrame, days_ahead: int = 30) -> DataFrame:
    """(day, predicted, lower, upper, models): the latest state carried on day by day, the mean of the
    models with 1.96 deviations between them. Beside each day stand the models' cross-validated R2
    (null for a model that is not fitted), the best of them, the latest FTP and the gain on it by the
    last day. No rows below three distinct FTP values or three rows."""
    rows = training_rows(rides).persist()
    n, distinct = rows.agg(F.count("*"), F.count_distinct("label")).first()
    spark = rides.sparkSession
    if n < 3 or distinct < 3:
        rows.unpersist()
        return spark.createDataFrame([], FORECAST)
    last = rows.orderBy(*[F.desc(c) for c in ORDER]).first()
    # two folds, none below four rows
    scores, models = _validated(rows, FEATURES, 2 if n >= 4 else 0, whole=True)
    days = [(d, *[float(last[c]) + (d if c == "days_training" else 0) for c in FEATURES]) for d in range(1, days_ahead + 1)]
    values = np.array([d[1:] for d in days]).reshape(-1, len(FEATURES))
    every = spark.createDataFrame([(d[0], float(p)) for x in models.values() for d, p in zip(days, x.predict(values), strict=True)], "day int, p double")
    rows.unpersist()
    mean, std = F.avg("p"), F.coalesce(F.stddev_pop("p"), F.lit(0.0))
    out = every.groupBy("day").agg(mean.alias("predicted"), (mean - 1.96 * std).alias("lower"), (mean + 1.96 * std).alias("upper"), F.count("*").cast("int").alias("models"))
    current = F.lit(float(last["label"]))
    gain = F.max_by("predicted", "day").over(Window.partitionBy()) - current
    return out.select(
        "*", *[F.lit(scores.get(m)).cast("double").alias(f"r2_{m}") for m in ("linear", "forest", "boosting")],
        F.lit(max(scores, key=scores.get)).alias("best_model"), current.alias("current_ftp"), gain.alias("expected_gain"),
        (F.try_divide(gain, current) * 100).alias("expected_gain_pct"),
    )


def weekly_milestones(rides: DataFrame) -> DataFrame:
    return ftp_forecast(rides, 28).where("day % 7 = 0")


POWER_FEATURES = [
    "avg_power", "normalized_power", "max_power", "left_right_balance", "left_torque_effectiveness", "right_torque_effectiveness", "left_pedal_smoothness",
    "right_pedal_smoothness", "avg_cadence", "max_cadence", "avg_temperature", "max_temperature", "training_effect", "anaerobic_effect", "total_work_kj",
    "avg_hr", "max_hr", "efficiency_factor", "variability_index", "intensity_factor", "duration_hours", "distance_km", "calculated_tss",
    "avg_np_7d", "avg_np_14d", "avg_np_28d", "total_tss_7d", "total_tss_14d", "total_tss_28d",
]


def ftp_target(rides: DataFrame) -> DataFrame:
    """``rides`` with ``target_ftp``: the first of the three FTP columns, in this order, that has any
    value, for all rows; where none has, the estimate from normalised power."""
    names = [c for c in ("threshold_power", "functional_threshold_power", "icu_ftp") if c in rides.columns]
    known = rides.agg(*[F.count(c).alias(c) for c in names]).first() if names else {}
    chosen = next((c for c in names if known[c]), None)
    if chosen:
        return rides.withColumn("target_ftp", F.col(chosen).cast("double"))
    return rides.join(A.ftp_estimate(rides).select("id", F.col("estimated_ftp").alias("target_ftp")), "id", "left")


def power_rows(rides: DataFrame) -> DataFrame:
    """(id, start_date_local, day, label, POWER_FEATURES) of rides with power: what a ride or the
    table lacks takes the value that stands for unknown, history is the rider's rides before it. The
    label is the target FTP, else the ride's normalised power; rides with neither are left out."""
    kinds = set(rides.columns)

    def known(*names: str) -> Column:
        """The first of the columns that is there, not null and not 0."""
        return F.coalesce(*[F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in names if c in kinds], F.lit(None).cast("double"))

    def value(default: float, *names: str) -> Column:
        return F.coalesce(known(*names), F.lit(default))

    np_, avg = ("icu_normalized_watts", "normalized_power"), ("icu_average_watts", "average_power")
    of = [c for c in (*np_, *avg) if c in kinds]
    rows = ftp_target(rides).where(F.coalesce(*of).isNotNull())
    target, seconds, hr = F.nullif("target_ftp", F.lit(0.0)), known("moving_time"), known("average_heartrate", "avg_heart_rate")
    own_np = F.coalesce(*[F.col(c).cast("double") for c in np_ if c in kinds], F.lit(None).cast("double"))
    before = lambda k: Window.partitionBy("athlete_id").orderBy(A.START, "id").rowsBetween(-k, -1)
    n = lambda k: F.count(F.lit(1)).over(before(k))
    stress = seconds * known(*np_) * (known(*np_) / target) / (target * 3600) * 100
    return rows.select(
        "id", A.START, F.unix_date(F.col(A.START).cast("date")).alias("day"), F.coalesce(target, known(*np_)).alias("label"),
        value(0.0, *avg).alias("avg_power"), value(0.0, *np_).alias("normalized_power"), value(0.0, "max_power").alias("max_power"),
        value(50.0, "left_right_balance").alias("left_right_balance"),
        *[value(0.0, f"avg_{c}").alias(c) for c in POWER_FEATURES[4:8]],
        value(0.0, "avg_cadence", "average_cadence").alias("avg_cadence"), value(0.0, "max_cadence").alias("max_cadence"),
        value(20.0, "avg_temperature").alias("avg_temperature"), value(25.0, "max_temperature").alias("max_temperature"),
        value(0.0, "training_effect", "total_training_effect").alias("training_effect"),
        value(0.0, "anaerobic_training_effect", "total_anaerobic_training_effect").alias("anaerobic_effect"),
        (value(0.0, "total_work") / 1000).alias("total_work_kj"), F.coalesce(hr, F.lit(0.0)).alias("avg_hr"),
        value(0.0, "max_heartrate", "max_heart_rate").alias("max_hr"),
        F.when((hr > 0) & (known(*avg) > 0), known(*avg) / hr).otherwise(0.0).alias("efficiency_factor"),
        F.coalesce(known(*np_) / known(*avg), F.lit(1.0)).alias("variability_index"), value(0.0, "intensity_factor", "icu_intensity").alias("intensity_factor"),
        (value(0.0, "moving_time") / 3600).alias("duration_hours"), (value(0.0, "distance") / 1000).alias("distance_km"),
        F.when(stress.isNotNull(), F.least(F.lit(500.0), stress)).otherwise(0.0).alias("calculated_tss"),
        *[F.when(n(k) > 0, F.coalesce(F.avg(own_np).over(before(k)), F.lit(0.0))).otherwise(value(0.0, *np_)).alias(f"avg_np_{k}d") for k in (7, 14, 28)],
        *[(n(k) * 50).cast("double").alias(f"total_tss_{k}d") for k in (7, 14, 28)],
    ).where("label is not null")


def power_models(rides: DataFrame) -> DataFrame:
    """(model, r2, best, feature, importance): R2 of each model over three expanding folds, which is
    best, and the importances of the best tree model, fitted on all rows."""
    rows = power_rows(rides).persist()
    scores = cross_validated(rows, POWER_FEATURES, 3)
    best = max(scores, key=scores.get)
    out = [(m, float(s), m == best, None, None) for m, s in scores.items()]
    if trees := [m for m in scores if m != "linear"]:
        tree = max(trees, key=scores.get)
        training = T.prepared(rows.withColumn("fold", F.lit(0)), POWER_FEATURES, [1], rows.count(), ORDER)
        fitted = _grown(training, tree)[1]
        training.unpersist()
        out += [(tree, float(scores[tree]), tree == best, f, float(x)) for f, x in zip(POWER_FEATURES, fitted.importances(), strict=True)]
    rows.unpersist()
    return rides.sparkSession.createDataFrame(out, "model string, r2 double, best boolean, feature string, importance double")


def save_model(model, path: str, about: dict) -> None:
    """The fitted model, and beside it what is known about it (features, scores, rows) as JSON."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    Files(spark, folder or ".").write(f"{name}.json", json.dumps({"saved_at": datetime.now(timezone.utc).isoformat()} | about), overwrite=True)


def train_and_save(rides: DataFrame, path: str) -> dict:
    """The best of the power models by cross-validation, fitted to all rows and saved with its metadata."""
    rows = power_rows(rides).persist()
    n = rows.count()
    scores = cross_validated(rows, POWER_FEATURES)
    best = max(scores, key=scores.get)
    fitted = pipeline(regressors(n < 10)[best], POWER_FEATURES).fit(rows)
    rows.unpersist()
    about = {"model": best, "scores": scores, "features": POWER_FEATURES, "rows": n}
    save_model(fitted, path, about)
    return about

