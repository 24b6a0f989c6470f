"""Trees over many training sets at once: what MLlib fits one after the other, in few jobs."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from test_models import rides

from wattloom.operators import forecast, trees

FEATURES = ["a", "b", "c", "d", "same"]


@pytest.fixture(scope="module")
def table(spark):
    rng, n = np.random.default_rng(1), 2000
    x = np.column_stack([rng.integers(0, 30, n), rng.integers(0, 6, n), rng.random(n) * 100, rng.integers(0, 2, n), np.full(n, 3.0)]).astype(float)
    y = np.sin(x[:, 0] / 4) * 5 + x[:, 1] * x[:, 3] + x[:, 2] / 30 + rng.normal(0, 0.3, n)
    rows = [(i // 10, i, i, *map(float, v), float(t), i % 2) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "day int, s int, id int, a double, b double, c double, d double, same double, label double, fold int").persist()
    yield df, x
    df.unpersist()


def of_mllib(model, df):
    fitted = forecast.pipeline(model, FEATURES).fit(df)
    return np.array([r.prediction for r in fitted.transform(df).orderBy("id").select("prediction").collect()]), fitted.stages[-1].featureImportances.toArray()


def test_boosting_is_mllibs_by_level_and_whole(spark, table, monkeypatch):
    df, x = table
    t = trees.prepared(df, FEATURES, [1, 2], df.count(), ("day", "s", "id"))
    whole = trees.boosted(t, 8, 3, 0.1)
    monkeypatch.setattr(trees, "WHOLE_ROWS", 0)
    monkeypatch.setattr(trees, "REBUILD", 3)
    level = trees.boosted(t, 8, 3, 0.1)
    for fit, part in ((1, df.where("fold = 0")), (2, df)):
        p, importance = of_mllib(GBTRegressor(labelCol="label", maxIter=8, maxDepth=3), part)
        mine = x if fit == 2 else x[::2]
        assert whole[fit].predict(mine) == pytest.approx(p, abs=1e-9) and level[fit].predict(mine) == pytest.approx(p, abs=1e-9)
        assert whole[fit].importances() == pytest.approx(importance, abs=1e-9)
    y = np.array([r.label for r in df.where("fold = 1").orderBy("id").collect()])
    e = y - whole[1].predict(x[1::2])
    assert trees.scores(t, {"boosting": whole})["boosting", 1] == pytest.approx(1 - e @ e / ((y - y.mean()) @ (y - y.mean())))
    t.unpersist()


def test_a_forest_is_as_good_as_mllibs(spark, table):
    df, x = table
    t = trees.prepared(df, FEATURES, [2], df.count(), ("day", "s", "id"))
    mine = trees.forests(t, 60, 5, 7)[2]
    t.unpersist()
    p, importance = of_mllib(RandomForestRegressor(labelCol="label", numTrees=60, maxDepth=5, seed=7), df)
    assert len(mine.trees) == 60 and np.corrcoef(p, mine.predict(x))[0, 1] > 0.98
    assert mine.importances() == pytest.approx(importance, abs=0.12) and mine.importances()[4] == 0


def test_lines_are_mllibs(spark, table):
    df, x = table
    t = trees.prepared(df, FEATURES, [1, 2], df.count(), ("day", "s", "id"))
    t.unpersist()
    model = forecast.regressors()["linear"]
    lines = trees.lines(t, model.getRegParam())
    for fit, part in ((1, df.where("fold = 0")), (2, df)):
        fitted = forecast.pipeline(model, FEATURES).fit(part)
        p = [r.prediction for r in fitted.transform(df).orderBy("id").select("prediction").collect()]
        assert lines[fit].predict(x) == pytest.approx(p, abs=1e-9)
    fitted = forecast.pipeline(model, FEATURES).fit(df.where("fold = 0"))
    r2 = RegressionEvaluator(labelCol="label", metricName="r2").evaluate(fitted.transform(df.where("fold = 1")))
    assert trees.line_scores(t, lines, "linear") == {("linear", 1): pytest.approx(r2, abs=1e-9)}


def test_the_line_of_one_label_or_one_row_is_flat():
    flat = trees.line(trees.moments_of(np.array([[1.0, 2.0, 3.0], [0.1, 0.1, 0.1], [7.7, 7.7, 7.7]])), 1e-3)
    assert list(flat.coefficients) == [0, 0] and flat.intercept == 7.7
    assert trees.line(trees.moments_of(np.array([[1.0], [2.0]])), 1e-3).predict(np.array([[5.0]])) == [2.0]


def test_constant_and_many_values(spark):
    same = spark.createDataFrame([(1, i, i, 2.0, 5.0, 0) for i in range(30)], "day int, s int, id int, a double, label double, fold int")
    t = trees.prepared(same, ["a"], [1], 30, ("day", "s", "id"))
    for fits in (trees.boosted(t, 3, 3, 0.1), trees.forests(t, 3, 5, 7)):
        assert fits[1].predict(np.array([[2.0], [9.0]])) == pytest.approx([5.0, 5.0]) and fits[1].importances().sum() == 0
    t.unpersist()
    values, counts = trees.summed_up(np.arange(50_000.0), np.ones(50_000))
    assert len(values) <= trees.POINTS and counts.sum() == 50_000 and values[-1] == 49_999
    cuts = trees.thresholds(values, counts, 32)
    assert len(cuts) == 31 and np.abs(cuts - (np.arange(1, 32) / 32 * 50_000)).max() < 50


def jobs(spark) -> int:
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_ftp_forecast_takes_few_jobs(spark):
    before = jobs(spark)
    assert forecast.ftp_forecast(rides(spark, 24), 3).count() == 3
    assert jobs(spark) - before < 150


def test_power_models_take_few_jobs(spark):
    before = jobs(spark)
    rows = forecast.power_models(rides(spark, 40)).collect()
    assert sum(r.importance for r in rows if r.feature) == pytest.approx(1.0)
    assert jobs(spark) - before < 200


def test_milestones_are_the_weeks_of_the_forecast_in_few_jobs(spark):
    before = jobs(spark)
    assert sorted(r.day for r in forecast.weekly_milestones(rides(spark, 24)).collect()) == [7, 14, 21, 28]
    assert jobs(spark) - before < 150


def test_milestones_read_each_ride_once(spark):
    # a ride that landed twice is two rows, as in ftp_features; joined to itself by id it was four
    twice = rides(spark, 24).union(rides(spark, 1))
    rows = forecast.training_rows(twice)
    assert rows.count() == 25 and "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    before = jobs(spark)
    assert forecast.weekly_milestones(rides(spark, 24)).count() == 4
    assert jobs(spark) - before < 40
