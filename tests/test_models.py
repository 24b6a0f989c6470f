"""Size of the models, their folds, features and labels, and what the forecast says of them."""

import json
from datetime import datetime, timedelta

import pytest

from wattloom.operators import forecast

T0 = datetime(2024, 1, 1)
RIDE = "id string, athlete_id long, start_date_local timestamp_ntz, moving_time double, distance double, icu_average_watts double, icu_normalized_watts double, average_heartrate double, max_heartrate double, max_power double, icu_training_load double, icu_intensity double, icu_ftp double, threshold_power double, functional_threshold_power double, icu_fitness double, icu_fatigue double"


def rides(spark, n=12):
    rows = [
        (f"i{i:03}", 1, T0 + timedelta(days=i // 2, hours=i % 2), 3600.0, 30000.0, 180.0 + i, 200.0 + i, 150.0, 170.0, 400.0, 50.0 + i, 0.8, 250.0 + i % 6, 300.0 if i % 4 == 0 else None, None, 40.0 + i, 30.0)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, RIDE)


def test_models_have_a_hundred_trees_and_rounds(spark):
    models = forecast.regressors()
    assert models["forest"].getNumTrees() == 100 and models["boosting"].getMaxIter() == 100


@pytest.mark.parametrize(("n", "k"), [(11, 3), (8, 3), (9, 2), (3, 3)])
def test_folds_expand_by_equal_parts(spark, n, k):
    df = rides(spark, n).withColumn("day", forecast.F.unix_date(forecast.F.col("start_date_local").cast("date")))
    got = {r.id: r.fold for r in forecast.folds(df, forecast.ORDER, k).collect()}
    size = n // (k + 1)
    assert [got[f"i{i:03}"] for i in range(n)] == [max(0, k - (n - 1 - i) // size) if size else 0 for i in range(n)]


@pytest.mark.parametrize("days", [[5] * 11, [0] * 2 + [5] * 9, [0, 1, 1, 1, 1, 2, 2, 2, 3, 3, 3], [0] * 6 + [1] * 3 + [2] * 3, [0, 0, 1]])
def test_folds_are_equal_within_days_and_over_repeated_rows(spark, days):
    rows = [(d, i // 2) for i, d in enumerate(days)]
    got = sorted((r.day, r.id, r.fold) for r in forecast.folds(spark.createDataFrame([*rows, (None, 9)], "day int, id int"), ("day", "id"), 3).collect())
    n, size = len(days), len(days) // 4
    assert [r[:2] for r in got] == rows
    assert [r[2] for r in got] == [max(0, 3 - (n - 1 - i) // size) if size else 0 for i in range(n)]


def test_power_rows_have_all_features_and_the_ftp_label(spark):
    rows = forecast.power_rows(rides(spark)).orderBy("id").collect()
    assert len(forecast.POWER_FEATURES) == 29 and set(forecast.POWER_FEATURES) < set(rows[0].asDict())
    # the first FTP column with any value is the label; where it is null, the ride's normalised power
    assert [r.label for r in rows] == [300.0 if i % 4 == 0 else 200.0 + i for i in range(12)]
    a, b = rows[0], rows[8]
    assert (a.avg_np_7d, a.total_tss_7d, a.left_right_balance, a.avg_temperature, a.max_temperature) == (200.0, 0.0, 50.0, 20.0, 25.0)
    assert b.avg_np_7d == pytest.approx(204.0) and b.avg_np_14d == pytest.approx(203.5) and (b.total_tss_7d, b.total_tss_28d) == (350.0, 400.0)
    assert b.calculated_tss == pytest.approx(208 * (208 / 300) / 300 * 100) and rows[1].calculated_tss == 0.0
    assert b.efficiency_factor == pytest.approx(188 / 150) and b.variability_index == pytest.approx(208 / 188)
    none = rides(spark).withColumns({c: forecast.F.lit(None).cast("double") for c in ("icu_ftp", "threshold_power", "functional_threshold_power")})
    assert [r.label for r in forecast.power_rows(none).orderBy("id").collect()] == pytest.approx([0.95 * (200 + i) for i in range(12)])


def test_forecast_tells_scores_best_model_and_gain(spark, monkeypatch):
    monkeypatch.setattr(forecast, "ROUNDS", 5)
    rows = forecast.ftp_forecast(rides(spark, 24), 3).orderBy("day").collect()
    r = rows[-1]
    scores = {m: r[f"r2_{m}"] for m in ("linear", "forest", "boosting")}
    assert None not in scores.values() and r.best_model == max(scores, key=scores.get)
    # the latest ride is i023, whose threshold power is null
    assert r.current_ftp == 255.0 and r.expected_gain == pytest.approx(r.predicted - 255) and r.expected_gain_pct == pytest.approx((r.predicted - 255) / 2.55)
    assert len({x.expected_gain for x in rows}) == 1


def test_power_models_tell_every_importance(spark, monkeypatch):
    monkeypatch.setattr(forecast, "ROUNDS", 5)
    rows = forecast.power_models(rides(spark, 40)).collect()
    assert sum(r.feature is None for r in rows) == 3 and len({r.feature for r in rows if r.feature}) == 29
    assert sum(r.importance for r in rows if r.feature) == pytest.approx(1.0)
    assert sum(r.best for r in rows if r.feature is None) == 1


def test_the_best_model_is_saved_with_its_metadata(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = [(str(k), "r", f"2024-01-{1 + k:02d} 10:00:00", 200.0 + k, 210.0 + k, 250.0 + k, 140.0, 3600.0, 30000.0) for k in range(8)]
    df = spark.createDataFrame(rows, "id string, athlete_id string, start_date_local string, icu_average_watts double, icu_normalized_watts double, icu_ftp double, average_heartrate double, moving_time double, distance double")
    df = df.withColumn("start_date_local", forecast.F.col("start_date_local").cast("timestamp_ntz"))
    about = forecast.train_and_save(df, str(tmp_path / "model"))
    assert about["model"] == "linear" and about["rows"] == 8
    kept = json.loads((tmp_path / "model.json").read_text())
    assert kept["features"] == forecast.POWER_FEATURES and "saved_at" in kept
    fitted = PipelineModel.load(str(tmp_path / "model"))
    assert fitted.transform(forecast.power_rows(df)).where("prediction is not null").count() == 8
