from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from wattloom.functions import timetext as T
from wattloom.operators import instants

ACT = "row_id long, id string, athlete_id string, start_date_local string, start_date string, timezone string, file_source string, import_timestamp timestamp, zone string, day_first boolean"
ATH = "athlete_id string, timezone string"
RAW = "raw_id long, activity_id string, record_no int, timestamp string, near long"


def utc(*a, tz="UTC", fold=0):
    return int(datetime(*a, tzinfo=ZoneInfo(tz), fold=fold).timestamp())


def activities(spark, rows):
    full = [(i, r[0], r[1], r[2], r[3], r[4], r[5], datetime(2025, 1, 1), "z", True) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, ACT)


def athletes(spark, rows=(("r1", "Europe/Berlin"), ("r2", "America/New_York"))):
    return spark.createDataFrame(list(rows), ATH)


@pytest.mark.parametrize("text, wall", [
    ("2024-02-29T10:11:12", "2024-02-29 10:11:12"), ("2024-02-29 10:11:12.999", "2024-02-29 10:11:12"), ("29.02.2024, 7:05:01", "2024-02-29 07:05:01"),
    ("2/3/2024 12:30 AM", "2024-02-03 00:30:00"), ("Mar 5, 2024 12:00:00 PM", "2024-03-05 12:00:00"), ("Tue, 05 Mar 2024 12:00:00 GMT", "2024-03-05 12:00:00"),
    ("2023-02-29T10:11:12", None), ("", None), ("soon", None), (None, None), ("2024-02-29", None), ("x" * 100_000, None),
])
def test_shapes(spark, text, wall):
    df = spark.createDataFrame([(text,)], "t string").select(T.read_time(T.F.col("t"), T.F.lit(False)).alias("r"))
    got = df.select(T.F.date_format("r.wall", "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert got == wall


def test_starts(spark):
    rows = [
        ("a", "r1", "2024-07-01T08:00:00", None, None, "x_1.csv"),  # the rider's zone
        ("b", "r1", "2024-07-01T08:00:00Z", "2024-07-01T08:00:00+02:00", None, "x_1.csv"),
        ("c", "r1", "2024-07-01T08:00:00-0700", None, "(GMT+01:00) Europe/Madrid", "x_1.csv"),
        ("d", "r2", "13/4/2024 19:08", None, None, "euro_1.csv"), ("e", "r2", "3/4/2024 19:08", None, None, "euro_1.csv"),
        ("f", "r2", None, "1683500158", None, "x_1.csv"), ("g", "r2", "x", "1680703021959", None, "x_1.csv"),
        ("h", "r1", "2024-10-27T02:30:00", None, None, "x_1.csv"), ("i", "r1", "2024-03-31T02:30:00", None, None, "x_1.csv"),
        ("j", None, None, None, None, None), ("k", "nobody", "2024-07-01T08:00:00", None, None, "x_1.csv"),
    ]
    got = {r.id: r for r in instants.activity_instants(activities(spark, rows), athletes(spark)).collect()}
    assert len(got) == len(rows)
    assert got["a"].utc_s == utc(2024, 7, 1, 6) and got["b"].utc_s == utc(2024, 7, 1, 6) and got["c"].utc_s == utc(2024, 7, 1, 15)
    assert got["d"].utc_s == utc(2024, 4, 13, 19, 8, tz="America/New_York") and got["e"].utc_s == utc(2024, 4, 3, 19, 8, tz="America/New_York")
    assert got["f"].utc_s == 1683500158 and got["f"].wall == datetime.fromtimestamp(1683500158, ZoneInfo("America/New_York")).replace(tzinfo=None)
    assert got["g"].utc_s == 1680703021
    assert got["h"].utc_s == utc(2024, 10, 27, 2, 30, tz="Europe/Berlin") and got["i"].utc_s == utc(2024, 3, 31, 1, 30)
    assert got["j"].utc_s is None and got["k"].utc_s == utc(2024, 7, 1, 8)


def landed(spark, rows):
    """(athlete_id, start_date_local, start_date, timezone, landed)."""
    full = [(i, str(i), r[0], r[1], r[2], r[3], "x_1.csv", r[4], "z", True) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, ACT)


def test_zone_is_estimated_from_landing_times(spark):
    """Wall clocks only, landed soon after the start, on both sides of clock changes."""
    rows, ny, rome = [], ZoneInfo("America/New_York"), ZoneInfo("Europe/Rome")
    for who, zone in (("ny", ny), ("rome", rome)):
        for month, day in ((1, 15), (3, 15), (3, 28), (7, 1), (10, 30), (11, 4), (12, 1)):
            start = datetime(2024, month, day, 9, 30, tzinfo=zone)
            rows.append((who, f"2024-{month:02d}-{day:02d}T09:30:00", None, None, datetime.fromtimestamp(start.timestamp() + 120)))
        rows.append((who, "2024-05-01T09:30:00", None, None, datetime(2024, 9, 1)))  # landed late: says nothing
    rows += [("late", "2024-05-01T09:30:00", None, None, datetime(2024, 9, 1)), ("said", "2024-05-01T09:30:00", None, "Asia/Tokyo", datetime(2024, 9, 1)), ("none", None, None, None, None)]
    df = landed(spark, rows)
    zones = {r.athlete_id: r.home for r in instants.riders_zones(df, athletes(spark)).collect()}
    same = lambda a, z: all(
        datetime(2024, m, d, 12, tzinfo=ZoneInfo(a)).utcoffset() == datetime(2024, m, d, 12, tzinfo=z).utcoffset() for m in range(1, 13) for d in (1, 12, 28)
    )
    assert same(zones["ny"], ny) and same(zones["rome"], rome) and zones["said"] == "Asia/Tokyo"
    assert "late" not in zones and "none" not in zones
    starts = {(r.athlete_id, r.wall.month): r.utc_s for r in instants.activity_instants(df, athletes(spark)).where("athlete_id = 'ny'").collect()}
    assert starts["ny", 7] == utc(2024, 7, 1, 13, 30) and starts["ny", 1] == utc(2024, 1, 15, 14, 30)


def test_known_offsets_outweigh_a_single_late_landing(spark):
    rows = [("x", f"2024-0{m}-10T08:00:00", f"2024-0{m}-10T0{h}:00:00Z", None, datetime(2025, 1, 1)) for m, h in ((1, 7), (2, 7), (7, 6))]
    rows.append(("x", "2024-07-20T08:00:00", None, None, datetime(2024, 7, 20, 5, 0)))  # before its start in that zone
    zones = {r.athlete_id: r.home for r in instants.riders_zones(landed(spark, rows), athletes(spark)).collect()}
    assert ZoneInfo(zones["x"]).utcoffset(datetime(2024, 7, 1)).total_seconds() == 7200


def test_zone_is_estimated_from_known_offsets(spark):
    rows = [("a", "x", f"2024-{m:02d}-10T08:00:00", f"2024-{m:02d}-09T{h}:30:00Z", None, "i_1.csv") for m, h in ((1, "21"), (7, "22"))]
    zones = {r.athlete_id: r.home for r in instants.riders_zones(activities(spark, rows), athletes(spark)).collect()}
    offsets = [ZoneInfo(zones["x"]).utcoffset(datetime(2024, m, 10)).total_seconds() for m in (1, 7)]
    assert offsets == [10.5 * 3600, 9.5 * 3600]


def test_readings(spark):
    acts = activities(spark, [("a", "r1", "2024-10-27T02:30:00", None, "Europe/London", "x_1.csv"), ("a", "r1", "2024-10-27T02:30:00", None, None, "x_2.csv"), ("n", "r1", "2023-11-01T00:00:00", None, None, "x")])
    starts = instants.activity_instants(acts, athletes(spark))
    texts = ["2024-10-27 00:50:00", "2024-10-27 01:20:00", "2024-10-27 01:50:00", "2024-10-27 01:10:00", "2024-10-27 01:55:00", "2024-10-27 02:05:00"]
    rows = [(i, "a", i, t, 0) for i, t in enumerate(texts)]
    rows += [(20, "n", 0, "1067815582", 0), (21, "n", 1, "1698881182000", 0), (22, "n", 2, "1698881182.5", 0), (23, "n", 3, "Nov 2 2023 8:27:20 AM", 0), (24, "n", 4, "2023-11-02T08:27:57+0100", 0), (25, None, None, None, None), (26, "lost", 0, "2023-11-02 08:00:00", 0)]
    got = {r.raw_id: r.utc_s for r in instants.reading_instants(spark.createDataFrame(rows, RAW), starts).collect()}
    day = lambda h, m: utc(2024, 10, 27, h, m)
    assert [got[i] for i in range(6)] == [utc(2024, 10, 26, 23, 50), day(0, 20), day(0, 50), day(1, 10), day(1, 55), day(2, 5)]
    assert got[20] == 1067815582 + 631065600 and got[21] == 1698881182 and got[22] == 1698881182
    assert got[23] == utc(2023, 11, 2, 8, 27, 20, tz="Europe/Berlin") and got[24] == utc(2023, 11, 2, 7, 27, 57)
    assert got[25] is None and got[26] == utc(2023, 11, 2, 8)


def test_empty(spark):
    starts = instants.activity_instants(activities(spark, []), athletes(spark, []))
    assert starts.count() == 0 and instants.reading_instants(spark.createDataFrame([], RAW), starts).count() == 0


def test_zone_names(spark):
    df = spark.createDataFrame([("(GMT+09:30) Australia/Adelaide",), ("Mars/Olympus",), (None,), ("UTC",)], "t string").select(T.zone_name(T.F.col("t")).alias("z"))
    assert [r.z for r in df.collect()] == ["Australia/Adelaide", None, None, "UTC"]
    assert datetime.now(timezone.utc)
