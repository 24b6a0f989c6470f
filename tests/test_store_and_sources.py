import json
from datetime import datetime

import pytest

from wattloom import schema as S
from wattloom.sources import files
from wattloom.store import RideStore, archive_file, export_csv, export_excel, read_time_series, summary_text, write_time_series
from wattloom.streaming import ingest

RIDES = "id string, start_date_local string, name string, type string, moving_time long, distance double, file_source string, import_timestamp timestamp, odd string"


def rides(spark, rows):
    return spark.createDataFrame(rows, RIDES)


THREE = [(f"act{i}", f"2024-01-0{i + 1}T10:00:00", f"R{i}", "Ride", t, d, "f1.csv", datetime(2024, 2, 1), "x") for i, (t, d) in enumerate([(3600, 30000.0), (5400, 45000.0), (4500, 35000.0)])]


def test_upsert_is_idempotent_and_drops_unknown_columns(spark, tmp_path):
    store = RideStore(spark, str(tmp_path))
    assert store.read().count() == 0
    assert store.save(rides(spark, THREE)) == {"saved": 3, "updated": 0, "skipped": 0}
    assert store.save(rides(spark, THREE)) == {"saved": 0, "updated": 3, "skipped": 0}
    assert "odd" not in store.read().columns
    changed = [(*THREE[0][:5], 99999.0, "f2.csv", datetime(2024, 3, 1), "x"), (None, *THREE[0][1:]), THREE[0]]
    assert store.save(rides(spark, changed)) == {"saved": 0, "updated": 1, "skipped": 2}
    row = store.read().where("id = 'act0'").first()
    assert row.distance == 30000.0 and row.file_source == "f2.csv" and row.all_file_sources == "f1.csv; f2.csv"
    store.save(rides(spark, changed), refresh_metrics=True)
    assert store.read().where("id = 'act0'").first().distance == 99999.0
    assert store.read().agg({"moving_time": "sum"}).first()[0] == 13500


def test_store_filters(spark, tmp_path):
    store = RideStore(spark, str(tmp_path))
    store.save(rides(spark, THREE))
    assert store.activities("2024-01-02", "2024-01-03").count() == 2
    assert store.activities(end="2024-01-01 00:00:00").count() == 1
    assert [r.id for r in store.activities(limit=1).collect()] == ["act2"] and store.activities(kind="Run").count() == 0
    with pytest.raises(ValueError):
        store.save(rides(spark, [("x", None, None, None, None, None, None, None, None)]), least_quality=95.0)


def test_history_and_versions(spark, tmp_path):
    store = RideStore(spark, str(tmp_path))
    cols = "file_hash string, status string, ingestion_timestamp timestamp"
    store.record_ingestion(spark.createDataFrame([("a", "error", datetime(2024, 1, 1)), ("b", "success", datetime(2024, 1, 1))], cols))
    store.record_ingestion(spark.createDataFrame([("a", "success", datetime(2024, 1, 2))], cols))
    new = spark.createDataFrame([("a",), ("c",)], "file_hash string")
    assert [r.file_hash for r in store.unprocessed(new).collect()] == ["c"]
    assert store.schema_version() == 0
    store.set_schema_version(3)
    assert store.schema_version() == 3


def test_attempts_without_a_hash_are_all_kept(spark, tmp_path):
    store = RideStore(spark, f"file://{tmp_path}/on-any-file-system")
    cols = "file_hash string, status string, ingestion_timestamp timestamp"
    at = datetime(2024, 1, 1)
    store.record_ingestion(spark.createDataFrame([(None, "error", at), (None, "error", at), ("a", "success", at)], cols))
    store.record_ingestion(spark.createDataFrame([(None, "error", at)], cols))
    assert store.read("ingestion").count() == 4
    assert (tmp_path / "on-any-file-system").exists()


def test_a_reader_keeps_its_version(spark, tmp_path):
    store = RideStore(spark, str(tmp_path))
    store.save(rides(spark, THREE))
    before = store.read()
    store.save(rides(spark, [("new", *THREE[0][1:])]))
    assert before.count() == 3 and store.read().count() == 4
    for k in range(4):
        store.save(rides(spark, [(f"new{k}", *THREE[0][1:])]))
    assert store.read().count() == 8 and len(store._versions("rides")) == 3
    used = {p.split("/")[0] for v in store._versions("rides") for p in json.loads(store.files.read(v)).values()}
    assert {x for x in store.files.names() if x.startswith("rides-")} <= used | {p.split("/")[0] for p in store._folders("rides").values()}


def test_steps_of_a_file(spark, tmp_path):
    store = RideStore(spark, str(tmp_path))
    assert store.status("a.csv") is None
    for step in ("PENDING", "PROCESSING", "ERROR", "PROCESSING", "SUCCESS", "ARCHIVED"):
        store.set_status("a.csv", step, error="x" if step == "ERROR" else None, record_count=5)
    assert store.status("a.csv") == "ARCHIVED" and store.steps().count() == 6
    with pytest.raises(ValueError):
        store.set_status("a.csv", "PROCESSING")
    with pytest.raises(ValueError):
        store.set_status("b.csv", "ARCHIVED")


def test_types_by_name_and_conform(spark):
    expected = {"average_speed": "DoubleType", "moving_time": "DoubleType", "has_notes": "BooleanType", "is_heartrate": "LongType", "import_timestamp": "TimestampType", "name": "StringType", "fit_max_x": "DoubleType", "z1_secs": "LongType", "misc": "StringType"}
    assert {n: type(S.type_of_name(n)).__name__ for n in expected} == expected
    df = spark.createDataFrame([("a", "12.0", "x", float("nan"))], "id string, moving_time string, distance string, icu_ftp double")
    row = S.conform(df).first()
    assert row.moving_time == 12 and row.distance is None and row.icu_ftp is None and row.name is None


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    a = write(tmp_path / "a.csv", "id,name,distance\ni1001,Tür,42195.5\ni1002,NA,\n")
    write(tmp_path / "b.csv", "id,distance,icu_ftp\ni1001,1,250\ni3,null,None\n")
    rows = files.read_csv(spark, a).orderBy("id").collect()
    assert [(r.id, r.name, r.distance) for r in rows] == [("i1001", "Tür", "42195.5"), ("i1002", None, None)]
    assert rows[0].file_source == "a.csv" and len(rows[0].file_hash) == 64
    every = files.extract_all(spark, [str(tmp_path)])
    assert every.count() == 4 and {"name", "icu_ftp"} <= set(every.columns)
    assert files.extract_csv(spark, str(tmp_path / "none.csv"))[1]["status"] == "error"
    empty = write(tmp_path / "c.csv", "id,name\n")
    assert files.extract_csv(spark, empty)[1] == {"status": "success", "rows": 0, "error": None}
    ragged = write(tmp_path / "d.csv", "id,name\n1,2,3\n")
    assert files.extract_csv(spark, ragged)[1]["status"] == "error"
    assert [r.file_name for r in files.list_files(spark, str(tmp_path)).collect()] == ["a.csv", "b.csv", "c.csv", "d.csv"]


def test_json_and_vendor(spark, tmp_path):
    rows = [{"id": "1", "start_date_local": "2024-01-01T10:00:00", "icu_sync_error": "Strava activity"}, {"id": "2", "start_date_local": "2024-01-02T10:00:00"}, {"id": "3", "start_date_local": None}]
    path = write(tmp_path / "x.json", "\n".join(map(json.dumps, rows)))
    assert [r.id for r in files.activities_from_json(spark.read.json(path)).collect()] == ["2", "3"]
    path = write(tmp_path / "y.json", json.dumps({"activityId": 5, "deviceDTO": {"displayName": "Edge"}, "distance": 3.5}))
    row = files.vendor_activities(spark.read.json(path)).first()
    assert (row.id, row.garmin_activity_id) == ("garmin_5", "5") and row.device_name == "Edge" and row.weather_temp is None and row.distance == 3.5 and row.duration == 0 and row.sport_type == ""
    df = spark.createDataFrame([("1700000000000",), ("2024-01-01T00:00:00",), ("x",)], "t string").select(files.vendor_time(files.F.col("t")).alias("t"))
    assert [r.t is None for r in df.collect()] == [False, False, True]


def test_device_files(spark, tmp_path):
    (tmp_path / "77_x.fit").write_bytes(b"ab")
    (tmp_path / "78.fit").write_bytes(b"!")

    def decode(content):
        if content == b"!":
            raise ValueError("broken")
        return [{"power": c} for c in content]

    got = {(r.activity_id, r.power, r.error) for r in files.read_device_files(spark, str(tmp_path), decode, "power int").collect()}
    assert got == {("77", 97, None), ("77", 98, None), ("78", None, "broken")}


def api(data, size):
    return lambda newest: [r for r in data if newest is None or r["start_date_local"] <= newest][:size]


def test_pages():
    data = [{"id": i, "start_date_local": f"2024-01-01T10:{i:02d}:00"} for i in range(25, 0, -1)]
    assert [r["id"] for r in files.fetch_pages(api(data, 10), batch=10, seen={3})] == [i for i in range(25, 0, -1) if i != 3]


def test_pages_that_share_a_start_end():
    same = [{"id": i, "start_date_local": "2024-01-01T10:00:00"} for i in range(10)]
    older = [{"id": 100 + i, "start_date_local": f"2023-12-{31 - i}T10:00:00"} for i in range(5)]
    got = [r["id"] for r in files.fetch_pages(api([*same, *older], 10), batch=10)]
    assert got == [*range(10), *range(100, 105)]
    twice = [{"id": i, "start_date_local": f"2024-01-0{9 - i // 2}T10:00:00"} for i in range(12)]
    assert [r["id"] for r in files.fetch_pages(api(twice, 5), batch=5)] == list(range(12))


def test_ten_thousand_rows_in_five_seconds(spark, tmp_path):
    import time

    write(tmp_path / "big.csv", "id,start_date_local,name,type,moving_time,distance\n" + "".join(f"i{k},2024-01-01T10:00:00,Ride {k},Ride,{k},{k * 10.5}\n" for k in range(10_000)))
    files.read_csv(spark, str(tmp_path / "big.csv")).count()  # the first run starts Spark's own parts
    t = time.perf_counter()
    df, done = files.extract_csv(spark, str(tmp_path / "big.csv"))
    assert done["rows"] == 10_000 and time.perf_counter() - t < 5.0


def fit_file(*parts: bytes) -> bytes:
    import struct

    data = b"".join(parts)
    return struct.pack("<BBHI4sH", 14, 0x20, 2132, len(data), b".FIT", 0) + data + b"\0\0"


def definition(local, number, *fields, big=False):
    import struct

    return struct.pack(f"{'>' if big else '<'}BBBHB", 0x40 | local, 0, big, number, len(fields)) + b"".join(map(bytes, fields))


def fit_ride(readings=5):
    import struct

    body = [definition(0, 23, (2, 2, 0x84), (3, 4, 0x8C), (27, 8, 0x07)), struct.pack("<BHI8s", 0, 1, 4_000_000_001, b"Edge\0\0\0\0")]
    body.append(definition(1, 20, (253, 4, 0x86), (7, 2, 0x84), (3, 1, 0x02), (2, 2, 0x84), (99, 1, 0x02)))
    body += [struct.pack("<BIHBHB", 1, 1_000_000_000 + k, 200 + k if k else 0xFFFF, 140 + k, (100 + k + 500) * 5, 7) for k in range(readings)]
    body.append(struct.pack("<BIHBHB", 0x80 | 1 << 5 | (1_000_000_000 + readings + 2) & 0x1F, 1_000_000_000 + readings, 300, 150, 3000, 7)[:1] + struct.pack("<IHBHB", 1_000_000_000 + readings, 300, 150, 3000, 7))
    body += [definition(2, 19, (19, 2, 0x84), (9, 4, 0x86), big=True), struct.pack(">BHI", 2, 210, 1_234_500), struct.pack(">BHI", 2, 220, 100)]
    body += [definition(3, 18, (2, 4, 0x86), (20, 2, 0x84), (34, 2, 0x84), (36, 2, 0x84), (57, 1, 0x01), (24, 1, 0x02)), struct.pack("<BIHHHbB", 3, 1_000_000_000, 205, 0xFFFF, 850, -3, 0xFF)]
    return fit_file(*body)


def test_fit_files(spark, tmp_path):
    import io
    import zipfile
    from datetime import timedelta

    from wattloom.sources import fit

    (tmp_path / "77_ride.fit").write_bytes(fit_ride())
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("a.fit", fit_ride(2))
    (tmp_path / "78.zip").write_bytes(packed.getvalue())
    (tmp_path / "79.fit").write_bytes(fit_ride()[:-40])
    (tmp_path / "80.fit").write_bytes(b"no")
    decoded = fit.read_fit(spark, str(tmp_path)).cache()
    rows = {r.activity_id: r for r in fit.sessions(decoded).collect()}
    a = rows["77"]
    start = fit.EPOCH + timedelta(seconds=1_000_000_000)
    assert (a.avg_power, a.normalized_power, a.intensity_factor, a.avg_temperature, a.start_time, a.total_training_effect) == (205.0, None, 0.85, -3.0, start, None)
    assert (a.device_manufacturer, a.device_serial_number, a.device_product_name, a.num_laps, a.lap1_avg_power, a.lap1_total_distance) == (1.0, 4_000_000_001.0, "Edge", 2, 210.0, 12345.0)
    assert a.data_points == 6 and a.fit_parse_error is None and rows["78"].data_points == 3
    assert "early" in rows["79"].fit_parse_error and rows["80"].fit_parse_error == "not a FIT file" and rows["80"].avg_power is None
    readings = fit.of_message(decoded, "record").where("activity_id = '77'").orderBy("n").collect()
    assert [r.power for r in readings] == [None, 201.0, 202.0, 203.0, 204.0, 300.0] and readings[0].altitude == 100.0
    assert readings[-1].timestamp == start + timedelta(seconds=7)  # by its five bits
    assert decoded.where("message = 'record'").first().fields.count("99") == 0


def test_patience():
    now, slept, fails = [0.0], [], [2]

    def sleep(s):
        slept.append(s)
        now[0] += s

    def fetch(x):
        if fails[0]:
            fails[0] -= 1
            raise OSError("later")
        return x

    call = files.patient(fetch, per_minute=5, clock=lambda: now[0], sleep=sleep)
    assert [call(i) for i in range(5)] == list(range(5)) and slept[:2] == [1.0, 2.0] and max(slept) > 50
    fails[0] = 9
    with pytest.raises(OSError):
        call(1)


def test_archive(tmp_path):
    for _ in range(2):
        archive_file(write(tmp_path / "a.csv", "x"), str(tmp_path / "old"))
    assert len(list((tmp_path / "old").iterdir())) == 2
    assert archive_file(write(tmp_path / "b.csv", "x"), str(tmp_path / "old"), "LEAVE").endswith("b.csv")
    assert archive_file(str(tmp_path / "b.csv"), "", "DELETE") is None and not (tmp_path / "b.csv").exists()
    with pytest.raises(ValueError):
        archive_file("x", "y", "BURN")


def test_streams_are_exactly_once(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    head = "id,name,import_timestamp\n"
    write(landed / "1.csv", head + "a,x,2024-01-01 00:00:00\nb,x,2024-01-01 00:00:00\n")
    write(landed / "2.csv", head + "a,y,2024-01-01 01:00:00\nc,y,2024-01-01 01:00:00\n")
    cols = "id string, name string, import_timestamp timestamp"
    stream = lambda: ingest.first_arrivals(ingest.file_stream(spark, str(landed), cols, per_trigger=1))
    for _ in range(2):
        ingest.run_once(stream(), str(tmp_path / "out"), str(tmp_path / "cp"))
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    store = RideStore(spark, str(tmp_path / "store"))
    done = ingest.upsert_new(ingest.file_stream(spark, str(landed), cols, per_trigger=1), store, str(tmp_path / "cp2"))
    assert sum(d["saved"] for d in done) == 3 and sum(d["updated"] for d in done) == 1
    assert ingest.upsert_new(ingest.file_stream(spark, str(landed), cols), store, str(tmp_path / "cp2")) == []


def test_time_series_and_exports(spark, sf, tmp_path):
    from wattloom.adapter import rides as view

    records = spark.read.parquet(f"{sf}/fit_records.parquet")
    write_time_series(records, str(tmp_path / "ts"), 4)
    one = records.first().activity_id
    assert read_time_series(spark, str(tmp_path / "ts"), one, 4).count() == records.where(records.activity_id == one).count()
    df = view(spark, sf)
    paths = export_csv(df, str(tmp_path / "csv"), ["activities", "weekly"])
    assert spark.read.option("header", True).csv(paths[0]).count() == df.count()
    assert export_excel(df, str(tmp_path / "book.xlsx")) and summary_text(df).startswith("Rides: 1500 ")
