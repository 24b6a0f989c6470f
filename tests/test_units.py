import pytest

from wattloom.operators import units


def test_compositions_and_cycles():
    table = {(q, u): (k, c, n) for q, u, _, k, c, n in units.compose()}
    assert table["distance", "mi"] == (1609.344, 0.0, 1)
    k, c, hops = table["left_right_balance", "percent_x1000"]
    assert abs(k - 0.001) < 1e-15 and hops == 2
    assert table["left_right_balance", "offset128"][:2] == (1.0, -128.0)
    with pytest.raises(units.InconsistentUnits):
        units.compose([*units.CONVERSIONS, ("speed", "mph", "m/s", 0.5, 0.0)])
    with pytest.raises(ValueError):
        units.compose([*units.CONVERSIONS, ("speed", "knot", "league", 0.5, 0.0)])


def test_text_quantities(spark):
    texts = ["6.0m/s", "5.0 M/S", "28,3", "20.2 mi/h", "0.00 mile(s)", "17743m", "41°06'16.3\"N", "57°41'41.6\"S", "48.90466 S", "-461270741", "47.5°", None, "", "abc def", "12 parsecs", "9" * 400]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", units.text_quantity(units.F.col("t")).alias("q"))
    got = {r.i: (r.q.number, r.q.unit) for r in df.collect()}
    assert got[0] == (6.0, "m/s") and got[1] == (5.0, "m/s") and got[2] == (28.3, None) and got[3] == (20.2, "mph")
    assert got[4] == (0.0, "mi") and got[5] == (17743.0, "m") and got[6][1] == "dms" and abs(got[6][0] - 41.104528) < 1e-6
    assert got[7][0] < -57 and got[8] == (-48.90466, "degrees") and got[9] == (-461270741.0, None) and got[10] == (47.5, "degrees")
    assert got[11] == (None, None) and got[12] == (None, None) and got[13] == (None, None) and got[14] == (12.0, None)


RECORDS = "record_id long, activity_id string, timestamp timestamp, speed double, distance double, position_lat double, v double, pace double"


def records(spark, rows):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, a, None if t is None else t0 + timedelta(seconds=t), s, d, lat, 1.0, 1.0) for i, (a, t, s, d, lat) in enumerate(rows)], RECORDS)


def test_recording_units(spark):
    rows = []
    for name, ks, kd in (("mps_m", 1, 1), ("kmh_km", 3.6, 0.001), ("mph_mi", 2.23694, 1 / 1609.344), ("kmh_m", 3.6, 1)):
        rows += [(name, 60 * i, 8.0 * ks, 480.0 * i * kd, 4e8 if name == "kmh_km" else 47.0) for i in range(20)]
    rows += [("none", 0, None, None, None), (None, 0, 1.0, 1.0, 1.0), ("nan", 0, float("nan"), float("nan"), None)]
    pace = spark.createDataFrame([(n, 7.5) for n in ("mps_m", "kmh_km", "mph_mi")], "activity_id string, pace double")
    got = {(r.activity_id, r.field_name): r.unit_name for r in units.recording_units(records(spark, rows), pace).collect()}
    assert got["mps_m", "speed"] == "m/s" and got["mps_m", "distance"] == "m" and got["mps_m", "position_lat"] == "degrees"
    assert got["kmh_km", "speed"] == "km/h" and got["kmh_km", "distance"] == "km" and got["kmh_km", "position_lat"] == "semicircles"
    assert got["mph_mi", "speed"] == "mph" and got["mph_mi", "distance"] == "mi"
    assert got["kmh_m", "speed"] == "km/h" and got["kmh_m", "distance"] == "m"
    assert not [k for k in got if k[0] in ("none", "nan", None)]
    assert units.recording_units(records(spark, []), pace).count() == 0


def test_text_units_take_the_recordings(spark):
    rows = [(1, "a", "5.0 km/h", "1 m", None), (2, "a", "6", None, "47.1"), (3, "a", "7,5 kph", "12", "900000000"), (4, None, "3", "4", "x"), (5, "b", "30.1", "4.20", "400000000")]
    raw = spark.createDataFrame(rows, "raw_id long, activity_id string, speed string, distance string, position_lat string")
    pace = spark.createDataFrame([("b", 8.0)], "activity_id string, pace double")
    got = {(r.raw_id, r.field_name): r.unit_name for r in units.text_units(raw, pace).collect()}
    assert got[2, "speed"] == "km/h" and got[3, "distance"] == "m" and got[3, "position_lat"] == "semicircles"
    assert got[5, "speed"] == "km/h" and got[5, "distance"] == "km" and (4, "speed") in got and (1, "position_lat") not in got


def test_to_canonical(spark):
    df = spark.createDataFrame([("speed", "km/h", 36.0, 1), ("left_right_balance", "offset128", 178.0, 2), ("speed", "furlong", 1.0, 3), (None, None, None, 4)], "q string, u string, v double, hops int")
    got = {r.hops: r.c for r in units.to_canonical(df, quantity="q", unit="u", value="v", out="c").collect()}
    assert abs(got[1] - 10) < 1e-9 and got[2] == 50.0 and got[3] is None and got[4] is None


def test_balance_scales(spark):
    df = spark.createDataFrame([(x,) for x in (49.9, 178.0, 4976.0, 49760.0, None, float("nan"))], "x double").select(units.balance_unit(units.F.col("x")).alias("u"))
    assert [r.u for r in df.collect()] == ["percent", "offset128", "percent_x100", "percent_x1000", None, None]
