"""Expectations on hand-written rows: zones, windows, rules, duplicates, quality, signals."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from wattloom.operators import activity as A
from wattloom.operators import dedup, forecast, normalize, quality, records, signal

T0 = datetime(2024, 1, 1)
COLUMNS = "id string, athlete_id long, start_date_local timestamp_ntz, name string, type string, moving_time double, distance double, total_elevation_gain double, icu_average_watts double, icu_normalized_watts double, average_heartrate double, icu_training_load double, icu_intensity double, icu_ftp double, threshold_power double, functional_threshold_power double, icu_fitness double, icu_fatigue double"


def series(spark, n=50):
    """Fifty rides every other day with rising values."""
    rows = [
        (f"i{i:03}", 1, T0 + timedelta(days=2 * i), f"Ride {i}", "Ride", 3600.0 + 60 * i, 30000.0 + 500 * i, 300.0 + 10 * i, 200.0 + i, 210.0 + i, 140.0 + i % 20, 50.0 + 2 * i,
         0.75 + 0.01 * (i % 10), 250.0 + 5 * (i // 10), None, None, 40 + 0.5 * i, 30 + 0.3 * i)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def test_zones_are_half_open(spark):
    powers = [0.0, 137.4, 137.5, 187.4, 187.5, 225.0, 262.5, 300.0, 375.0, -1.0, None]
    df = spark.createDataFrame([(p,) for p in powers], "p double").select(A.zone_of(A.F.col("p"), A.F.lit(250.0)).alias("z"))
    assert [r.z for r in df.collect()] == [1, 1, 2, 2, 3, 4, 5, 6, 7, None, None]


def test_best_efforts_and_ftp(spark):
    df = series(spark)
    assert [r.icu_normalized_watts for r in A.best_efforts(df, n=5).collect()] == [259.0, 258.0, 257.0, 256.0, 255.0]
    ftp = [r.ftp for r in A.ftp_progression(df).orderBy("day").collect()]
    assert ftp == sorted(ftp) and len(ftp) == 50
    gain = A.ftp_gain(df).first()
    assert (gain.first_ftp, gain.last_ftp, gain.gain) == (250.0, 270.0, 20.0)
    assert A.training_load(df, 42).first().rides == 22


def test_ftp_precedence(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 2.0, None), (1.0, None, None)], "icu_ftp double, threshold_power double, functional_threshold_power double")
    assert [r[0] for r in df.select(A.unified_ftp(df)).collect()] == [3.0, 2.0, 1.0]


def test_readiness_form_is_low_when_tired(spark):
    df = series(spark, 10).withColumns({"icu_fitness": A.F.lit(50.0), "icu_fatigue": A.F.lit(65.0)})
    assert A.readiness(df).first().form < 60
    assert A.season_forecast(series(spark), 2).where("metric = 'avg_watts'").first().trend == "increasing"


def test_empty_rides(spark):
    df = series(spark, 0)
    for f in (A.ftp_progression, A.power_zones, A.weekly_summary, A.power_curve, A.variability_index, A.training_phases, A.vo2max_monthly, A.season_forecast, A.ftp_estimate):
        assert f(df).count() == 0
    for f in (A.training_load, A.readiness, A.race_prediction, A.overview_kpis):
        assert f(df).count() == 1


def test_forecast(spark):
    rows = forecast.ftp_forecast(series(spark), 5).orderBy("day").collect()
    assert [r.day for r in rows] == [1, 2, 3, 4, 5] and all(r.lower <= r.predicted <= r.upper and r.models == 3 for r in rows)
    assert forecast.ftp_forecast(series(spark, 2)).count() == 0


DUP = "row_id long, id string, start_date_local string, type string, name string, distance double, moving_time long, file_source string, import_timestamp timestamp, copies long"


def five(spark):
    rows = [("act1", "f1"), ("act2", "f1"), ("act1", "f2"), ("act3", "f2"), ("act2", "f3")]
    return spark.createDataFrame([(i, a, f"2024-01-0{i}", "Ride", a, 30000.0 + 100 * i, 3600 + i, f"{f}.csv", T0 + timedelta(days=i), 9) for i, (a, f) in enumerate(rows, 1)], DUP)


def test_duplicates(spark):
    df = five(spark)
    assert {r.row_id for r in dedup.resolve(df).collect()} == {3, 4, 5} and {r.row_id for r in dedup.resolve(df, "keep_first").collect()} == {1, 2, 4}
    r = dedup.report(df).first()
    assert (r.total, r.unique_ids, r.exact) == (5, 3, 2)
    assert {r.id: r.sources for r in dedup.track_sources(df).collect()}["act2"] == "f1.csv, f3.csv"
    assert dedup.resolve(df, preserve_all=True).where("would_keep").count() == 3
    once = df.join(dedup.resolve(df), ["row_id", "id"], "left_semi")
    assert dedup.report(once).first().exact == 0
    nulls = df.withColumn("id", A.F.lit(None).cast("string"))
    assert not dedup.exact(nulls).where("is_duplicate").count() and dedup.exact(df.limit(0)).count() == 0


def test_quality(spark):
    df = spark.createDataFrame([("a", "n", "t", "s", 1, 1.0), (None, "n", "t", "s", 1, 1.0), ("c", "n", "t", "s", 1, 1.0)], "id string, name string, type string, start_date_local string, moving_time long, distance double")
    assert round(quality.quality_score(df).first().score, 1) == 94.4 and not quality.quality_gate(df).first().accepted
    with pytest.raises(ValueError):
        quality.require_quality(df)
    power = spark.createDataFrame([(None,)] * 13 + [(200.0,)] * 66, "p double")
    assert quality.equipment_coverage(power, ["p"]).first().coverage == 83.5


def test_fallbacks_and_repair(spark):
    df = spark.createDataFrame([(None, 5.0), (0.0, 6.0), (7.0, 8.0), (0.0, 0.0), (None, None)], "a double, b double").select(normalize.falsy_fallback(A.F.col("a"), A.F.col("b")).alias("x"))
    assert [r.x for r in df.collect()] == [5.0, 6.0, 7.0, 0.0, None]
    df = spark.createDataFrame([(536870912.0,), (45.0,), (None,)], "c double").select(normalize.degrees(A.F.col("c")).alias("d"))
    assert [r.d for r in df.collect()] == [45.0, 45.0, None]
    bad = spark.createDataFrame([(1, "", "x", "n", "t")], "row_id long, id string, start_date_local string, name string, type string")
    with pytest.raises(ValueError, match="No valid"):
        normalize.require_valid(bad)


def test_json_zones_ignore_what_is_malformed(spark):
    df = spark.createDataFrame([('[{"zoneNumber":2,"secsInZone":5}]',), ("{oops",), (None,), ('[{"zoneNumber":8,"secsInZone":5}]',)], "zones string")
    assert [r.z2_secs for r in normalize.json_zones(df).collect()] == [5.0, None, None, None]


REC = "activity_id string, record_id long, timestamp timestamp, power int, heart_rate int, cadence int, altitude double, temperature int, speed double"


def recording(spark, power, step=1, gap_at=None):
    rows = []
    t = 0
    for i, p in enumerate(power):
        t += 100_000 if i == gap_at else step
        rows.append(("a", i, T0 + timedelta(seconds=t), p, 140 + i % 5, 90, 100.0 + (i % 4) * 2, 20, 8.0))
    return spark.createDataFrame(rows, REC)


def test_positions_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(records, "BLOCK_S", 50)
    monkeypatch.setattr(records, "CHUNK", 40)
    power = [100 + (i * 37) % 90 for i in range(400)]
    df = recording(spark, power, gap_at=123)
    rows = records.ordered(df, ["power"]).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(1, 401)) and all(r.n == 400 for r in rows) and rows[0].prev is None
    assert all(b.prev.power == a.power for a, b in zip(rows, rows[1:]))
    means = {r.pos: r.mean for r in records.moving_mean(records.ordered(df, ["power"]), "power", 30).collect()}
    assert len(means) == 371 and all(abs(m - np.mean(power[p - 30 : p])) < 1e-9 for p, m in means.items())
    expected = np.mean(np.array(list(means.values())) ** 4) ** 0.25
    assert abs(records.normalized_power(df).first().normalized_power - expected) < 1e-5


def test_gain_and_short_recordings(spark):
    df = recording(spark, [200] * 9)
    assert records.elevation_gain(df).first().gain_m == 12.0 and records.normalized_power(df).first().normalized_power == 200.0
    assert records.power_fade(df).count() == 0 and records.power_skew(df).count() == 0
    empty = recording(spark, [200]).limit(0)
    for f in (records.normalized_power, records.elevation_gain, records.hr_zone_pct, records.hr_drift, signal.dfa):
        assert f(empty).count() == 0


def test_signals():
    t = np.arange(1024)
    f, h = signal.dominant_frequency(np.sin(2 * np.pi * t / 32))
    assert f == pytest.approx(1 / 32) and h < 0.1
    assert signal.autocorrelation_period(np.sin(2 * np.pi * t / 32)) in (15, 16, 17, 47, 48, 49)
    rng = np.random.default_rng(1)
    noise = rng.normal(size=4000)
    assert signal.fluctuation_slope(noise) == pytest.approx(0.5, abs=0.1) and signal.fluctuation_slope(np.cumsum(noise)) == pytest.approx(1.5, abs=0.15)
    assert signal.mean_coherence(noise, noise) == pytest.approx(1.0) and signal.mean_coherence(noise, rng.normal(size=4000)) < 0.2
    x = noise[:120]
    r = 0.2 * x.std()

    def phi(m):
        runs = [x[i : i + m] for i in range(len(x) - m + 1)]
        n = len(runs)
        return sum(np.abs(a - b).max() <= r for i, a in enumerate(runs) for j, b in enumerate(runs) if i != j) / n / (n - 1)

    assert signal.sample_entropy(x) == pytest.approx(-math.log(phi(3) / phi(2))) and signal.sample_entropy(np.ones(50)) in (0.0, pytest.approx(0.0, abs=0.1))
