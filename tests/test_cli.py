from test_store_and_sources import fit_ride

from wattloom import cli
from wattloom.store import RideStore


def run(spark, *argv):
    args = cli.parser().parse_args([str(a) for a in argv])
    return args.run(spark, args)


def test_from_files_to_report(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    head = "id,start_date_local,name,type,moving_time,distance,icu_ftp,icu_training_load,icu_normalized_watts,icu_average_watts,average_heartrate,icu_intensity,icu_fitness,icu_fatigue\n"
    row = lambda i: f"i{i},2024-01-{i:02}T10:00:00,Ride {i},Ride,{3600 + i},{30000 + i},{200 + 2 * i},50,210,200,140,0.8,40,35\n"
    (incoming / "a.csv").write_text(head + "".join(row(i) for i in range(1, 16)))
    (incoming / "b.csv").write_text(head + "".join(row(i) for i in range(10, 26)))
    store, old = tmp_path / "store", tmp_path / "old"
    assert run(spark, "ingest", "--store", store, "--incoming", incoming, "--dry-run") == {"files": ["a.csv", "b.csv"]}
    done = run(spark, "ingest", "--store", store, "--incoming", incoming, "--archive", old, "--strategy", "COPY")
    assert (done["saved"], done["updated"]) == (25, 0) and len(list(old.iterdir())) == 2
    assert run(spark, "ingest", "--store", store, "--incoming", incoming) == {"files": []}
    assert run(spark, "report", "--store", store, "--out", tmp_path / "out").startswith("Rides: 25 from 2024-01-01 to 2024-01-25")
    assert run(spark, "quality", "--store", store)["score"] == 100.0
    assert len(run(spark, "predict", "--store", store, "--days", 14)) == 3
    steps = {r.file_name: r.status for r in RideStore(spark, str(store)).steps().where("step = 2").collect()}
    assert steps == {"a.csv": "ARCHIVED", "b.csv": "ARCHIVED"}
    assert len(run(spark, "dashboard", "--store", store, "--out", tmp_path / "dash")) == 4
    (tmp_path / "list.json").write_text('{"id": "x1", "start_date_local": "2024-03-01T10:00:00", "name": "A", "moving_time": 3600}\n{"id": "x2", "icu_sync_error": "Strava activity"}')
    assert run(spark, "sync", "--store", store, "--json", tmp_path / "list.json") == {"saved": 1, "updated": 0, "skipped": 0}
    (tmp_path / "vendor.json").write_text('{"activityId": 77, "activityName": "B", "startTimeLocal": "2024-03-02 10:00:00", "movingDuration": 1800.0, "distance": 9000.0, "avgPower": 180}')
    assert run(spark, "garmin", "--store", store, "--json", tmp_path / "vendor.json")["saved"] == 1
    row = RideStore(spark, str(store)).read().where("id = 'garmin_77'").first()
    assert (row.moving_time, row.icu_average_watts, row.start_date_local) == (1800, 180, "2024-03-02T10:00:00")
    (tmp_path / "fit").mkdir()
    (tmp_path / "fit" / "77_ride.fit").write_bytes(fit_ride())
    assert run(spark, "reprocess", "--store", store, "--files", tmp_path / "fit") == {"saved": 0, "updated": 1, "skipped": 0}
    row = RideStore(spark, str(store)).read().where("id = 'garmin_77'").first()
    assert (row.average_power, row.avg_temperature, row.device_product, row.name, row.has_fit_data) == (180.0, -3.0, "Edge", "B", True)
    assert {m["model"] for m in run(spark, "train", "--store", store)} == {"linear", "forest", "boosting"}
