"""The problems' queries on the smallest tables: columns, types, distinct rows, and known relations."""

import pytest

from wattloom.plans import problems

COLUMNS = {
    "p1_found": [("activity_id", "string"), ("field_name", "string"), ("period_start", "bigint")],
    "p4_found": [("source_table", "string"), ("row_key", "string"), ("field_name", "string"), ("unit_name", "string")],
    "p5_found": [("source_table", "string"), ("row_key", "bigint"), ("utc_s", "bigint")],
    "p6_found": [("athlete_id", "string"), ("ride_day", "string"), ("measure", "string")],
    "p7_found": [("record_id", "bigint"), ("field_name", "string")],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_queries(spark, sf, name):
    df = problems.queries()[name](spark, sf)
    assert df.dtypes == COLUMNS[name]
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows)) and not any(v is None for r in rows for v in r)


def test_every_row_has_its_instant(spark, sf):
    found = problems.p5_found(spark, sf)
    for name, key in (("activities", "row_id"), ("raw_records", "raw_id")):
        ids = {r[0] for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key).collect()}
        assert {r.row_key for r in found.where(found.source_table == name).collect()} == ids


def test_converted_values_are_plausible(spark, sf):
    rows = problems.p4_converted(spark, sf)
    assert rows.where("common_value is null").count() == 0
    limits = {"speed": (0, 40), "distance": (0, 500_000), "position_lat": (-90, 90), "left_right_balance": (0, 100)}
    for field, (lo, hi) in limits.items():
        bad = rows.where(f"field_name = '{field}' and (common_value < {lo} or common_value > {hi})")
        assert bad.count() == 0


def test_bad_readings_by_device_add_up(spark, sf):
    by = problems.p7_by_device(spark, sf).collect()
    assert sum(r.impossible + r.spike + r.stuck for r in by) == problems.p7_found(spark, sf).count()
    assert all(r.impossible + r.spike + r.stuck <= r.readings for r in by)
