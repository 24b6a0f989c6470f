"""Rules of validation, field bounds, merge and flattening on small rows."""

import pytest

from wattloom.operators import features as X
from wattloom.operators import normalize as N
from wattloom.operators import quality as Q

BOUNDS = [
    ("distance", 0, 1000000), ("moving_time", 0, 86400), ("elapsed_time", 0, 86400), ("total_elevation_gain", 0, 10000), ("average_heartrate", 50, 220),
    ("max_heartrate", 80, 250), ("average_speed", 0, 30), ("max_speed", 0, 50), ("average_cadence", 30, 180), ("max_cadence", 50, 220), ("average_watts", 0, 2000),
    ("max_watts", 0, 3000), ("normalized_power", 0, 2000), ("weighted_average_power", 0, 2000), ("training_stress_score", 0, 1000), ("intensity_factor", 0, 2.0),
    ("calories", 0, 10000),
]


def test_each_of_the_bounds(spark):
    names = [c for c, _, _ in BOUNDS]
    rows = [[float(lo) for _, lo, _ in BOUNDS], [float(hi) for _, _, hi in BOUNDS], [lo - 0.5 for _, lo, _ in BOUNDS], [hi + 0.5 for _, _, hi in BOUNDS], [hi + 9.0 for _, _, hi in BOUNDS], [None] * 17]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    assert {(r.column_name, r.below, r.above) for r in Q.check_ranges(df).collect()} == {(c, 1, 2) for c in names}
    assert Q.check_ranges(df.limit(0)).where("below + above > 0").count() == 0


@pytest.mark.parametrize("text, good", [
    ("2024-01-02T10:11:12", True), ("2024-01-02 10:11:12+02", True), ("2024-01-02", True), ("01/02/2024 7:00", True), ("1/2/2024", False), ("02.01.2024", False),
    ("2024-01-02T10:11", False), ("", False), (None, True),
])
def test_shapes_of_dates(spark, text, good):
    assert Q.check_datetime(spark.createDataFrame([(text,)], "d string"), ["d"]).first().not_datetime == (not good)


def test_consistency_and_report(spark):
    df = spark.createDataFrame(
        [("a", "x", 10, 5, 300, 200, 150, 140), ("b", None, 5, 5, 100, None, 100, 120), (None, "y", None, 5, None, None, None, None)],
        "id string, start_date_local string, moving_time long, elapsed_time long, average_watts long, max_watts long, average_heartrate long, max_heartrate long",
    )
    assert {(r.rule, r.severity, r.broken) for r in Q.check_consistency(df).collect()} == {
        ("moving_time<=elapsed_time", "ERROR", 1), ("average_watts<=max_watts", "WARNING", 1), ("average_heartrate<=max_heartrate", "WARNING", 1)
    }
    r = Q.validation_report(df).first()
    assert (r.criticals, r.errors, r.warnings, r.status) == (2, 1, 2, "critical") and r.score == pytest.approx(100 - 5 / 24 * 100 - 20 - 5 - 2, abs=1e-5)
    assert Q.check_consistency(df.select("id")).count() == 0


def test_one_rule_of_balance(spark):
    df = spark.createDataFrame([(x,) for x in (48.5, 100.0, 110.0, 128.0, 176.0, 228.0, 500.0, 4850.0, 48500.0, None, float("nan"))], "b double")
    got = [r[0] for r in df.select(N.balance(N.F.col("b"))).collect()]
    assert got == [48.5, 100.0, 1.1, 0.0, 48.0, 100.0, 5.0, 48.5, 48.5, None, None]


def test_merge(spark):
    acts = spark.createDataFrame([(1, "a", "9", 0, 120, 5.0), (2, "b", None, 140, None, None), (3, "b", None, 140, None, None)], "row_id long, id string, garmin_activity_id string, average_heartrate long, max_power long, avg_cadence double")
    ses = spark.createDataFrame(
        [("9", 1, 150, 300, 0, None, 12, [1, 2], "S1"), ("a", 2, 111, 1, 1, 1.0, 1, None, "no"), ("b", 3, 151, 310, 250, 80.0, None, None, None), ("b", 4, 152, 310, 250, 81.0, None, None, None)],
        "activity_id string, session_id long, avg_heart_rate int, max_power int, threshold_power int, avg_cadence double, avg_temperature int, avg_left_power_phase array<int>, serial_number string",
    )
    rows = N.fit_merge(acts, ses).orderBy("row_id").collect()
    a, b = rows[0], rows[1]
    assert (a.average_heartrate, a.max_power, a.avg_cadence, a.threshold_power, a.avg_temperature, a.avg_left_power_phase, a.device_serial_number) == (150, 120, 5.0, None, 12, "[1,2]", "S1")
    assert (b.average_heartrate, b.max_power, b.avg_cadence, b.threshold_power, b.has_fit_data) == (140, 310, 81.0, 250, True) and len(rows) == 3
    found = {tuple(r) for r in N.fit_update_or_join(acts, ses).collect()}
    assert found == {(1, 1), (2, 1), (3, 2), (4, 2)}


def test_flatten_and_quarantine(spark):
    ses = spark.createDataFrame([(1, {"z1": 5}, (3,), [1, 2]), (2, {"z2": 7}, None, None)], "session_id long, zones map<string,int>, device struct<serial:int>, laps array<int>")
    rows = [tuple(r) for r in N.fit_flatten(ses).orderBy("session_id").collect()]
    assert rows == [(1, 5, None, 3, 2, True), (2, None, 7, None, 0, True)]
    rec = spark.createDataFrame([(1, 300, 91.0, 5.0), (2, 100, 2.0**30, 5.0), (3, None, None, -1.0), (4, 100, -90.0, None)], "record_id long, heart_rate int, position_lat double, speed double")
    assert {tuple(r) for r in N.quarantined(rec).collect()} == {(1, "position_lat,heart_rate"), (3, "speed")}
    assert {(r.field_name, r.rejected) for r in N.fit_constraints(rec).collect()} == {("position_lat", 1), ("speed", 1), ("heart_rate", 1)}


def test_all_zones(spark):
    df = spark.createDataFrame([(1, '[{"zoneNumber":2,"secsInZone":5.5}]', None), (2, "broken", '[{"zoneNumber":7,"secsInZone":1},{"zoneNumber":9,"secsInZone":1}]')], "id int, power_zones string, hr_zones string")
    a, b = N.all_zones(df).orderBy("id").collect()
    assert a.z2_secs == 5.5 and a.hr_z1_secs is None and b.hr_z7_secs == 1.0 and b.z1_secs is None and len(a) == 15


def test_coverage_of_a_power_meter(spark):
    df = spark.createDataFrame([(1, 5, None), (2, None, None)], "id long, icu_average_watts long, avg_cadence long")
    assert tuple(Q.equipment_coverage(df).first()) == (50.0, "partial")  # a column that is null throughout does not count
    assert tuple(Q.equipment_coverage(df.select("id")).first()) == (0.0, "none")


def test_features_of_a_recording(spark):
    rec = spark.createDataFrame([("a", 100, 150, 80, 400.0, 10), ("a", 300, 150, 0, 600.0, 14), ("a", None, None, 90, None, None), (None, 1, 1, 1, 1.0, 1), ("b", None, None, None, None, None)], "activity_id string, power int, heart_rate int, cadence int, altitude double, temperature int")
    rows = {r.activity_id: r for r in X.recording(rec).collect()}
    a = rows["a"]
    assert (a.cadence_consistency, a.power_cv, a.hr_cv, a.above_100w_pct, a.altitude_zone, a.temp_variation, a.data_points) == (pytest.approx(1 / 6, abs=1e-6), 0.5, 0.0, 50.0, 2, 4.0, 3)
    assert rows["b"].altitude_zone is None and rows["b"].power_cv is None and set(rows) == {"a", "b"}
